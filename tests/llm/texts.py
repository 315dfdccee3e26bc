"""Texts for tests."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **extra):
    """Documents from texts or (id, text) pairs; further columns by name."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)
    from pyspark.sql import functions as F

    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def words(rnd: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " ", "\n\n", "one", "two words", "É à 中 🙂", "a b", "x" * 5000, "tab\tand\x0bvt\x0cff\rcr", "<|endoftext|> special", "\x00\x01"]
