"""Quality rules as weak supervision. Native.

Counts per text (words are runs of characters outside the contract's white space) give votes of ``RULES``: keep,
drop or abstain. Thresholds are strict on purpose, so that single drop votes may be wrong. Expectation-maximisation over the counts of
vote patterns (at most 3 to the number of rules rows, whatever the corpus) estimates the share of good documents and how often each rule,
where it votes, says drop of good and of bad ones; abstaining is no evidence. Its priors weigh ``WEAK`` documents, so they only keep
probabilities off zero. A document's posterior probability of being good is its quality, and it is kept where that
is at least ``KEEP``: votes that come with no others of their kind are outvoted. A document that fails the base rules is never kept.

Repeated five-word windows: each window is named by a 64-bit hash, the hashes of a text are sorted with their positions, and
the words under windows with an equal neighbour are counted; texts without repeats skip the sort. Nothing is shuffled but the
pattern counts.

Edge cases: null and empty texts have no words, all counts zero, base_failed true, kept false; null ids and repeated rows are each
answered; an empty table gives an empty result; extra columns are ignored; shares in rules of texts without words count as zero.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh_name, stash, table

SPAN, ROUNDS, KEEP, WEAK = 5, 1000, 0.5, 2.0
SYMBOLS, MARKS = "[#*$%&|<>]", "[!?~=_]"
BLANKS = " \t\n\x0b\f\r"

#: name: (SQL that is true for a vote to drop, SQL that is true for a vote to keep); neither: the rule abstains.
RULES = {
    "length": ("n_words < 30", "n_words >= 60"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 10 * n_words", "word_chars >= 4 * n_words and word_chars <= 9 * n_words"),
    "symbols": ("n_symbols > 0.05 * n_words", "n_symbols <= 0.01 * n_words"),
    "letters": ("n_other > 0.2 * word_chars", "n_other < 0.06 * word_chars"),
    "bare": ("n_bare > 0.1 * n_words", "n_bare <= 0.01 * n_words"),
    "marks": ("n_marks > 0.02 * n_words", "n_marks <= 0.002 * n_words"),
    "capitals": ("n_capitals > 0.15 * word_chars", "n_capitals < 0.08 * word_chars"),
    "lines": ("n_dup_lines >= 2 and n_dup_lines > 0.15 * n_lines", "n_dup_lines = 0"),
    "repeats": ("n_repeat_words > 0.04 * n_words", "n_repeat_words <= 0.01 * n_words"),
    "variety": ("n_distinct < 0.65 * least(n_words, 500)", "n_distinct >= 0.7 * least(n_words, 500)"),
    "sentences": ("n_ended < 0.3 * n_lines", "n_ended >= 0.5 * n_lines and n_lines > 0"),
}


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeat_words(h: Column) -> Column:
    """Words under windows whose hash occurs twice or more in the array h."""

    def repeated(pairs):
        # sorted by hash, then place: a window repeats if a neighbour has its hash
        alike = lambda x, k: F.get(pairs, k)["h"].eqNullSafe(x["h"])
        return F.array_sort(F.transform(F.filter(pairs, lambda x, k: F.when(k > 0, alike(x, k - 1)).otherwise(False) | alike(x, k + 1)), lambda x: x["i"]))

    def covered(at):
        new = F.transform(at, lambda i, k: F.when(k == 0, SPAN).otherwise(F.least(F.lit(SPAN), i - F.get(at, k - 1))))
        return F.aggregate(new, F.lit(0), lambda a, n: a + n)

    return _let(_let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated), covered)


def measure(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and the counts of every row."""
    plain = docs.select(F.col(id_col), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(fresh_name([id_col], "t")))
    t = F.col(plain.columns[1])
    held, seen = fresh_name([id_col], "w"), fresh_name([id_col], "h")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    solid = t
    for blank in BLANKS:
        solid = F.replace(solid, F.lit(blank), F.lit(""))
    d = plain.select(
        id_col,
        F.transform(F.array_remove(F.split(t, f"[{SPACE}]+"), ""), lambda x: F.xxhash64(x)).alias(held),
        F.char_length(solid).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(t, F.lit(MARKS)).cast("long").alias("n_marks"),
        F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.char_length(F.array_join(F.regexp_extract_all(t, F.lit(rf"[^\p{{L}}{SPACE}]+"), F.lit(0)), "")).cast("long").alias("n_other"),
        F.regexp_count(t, F.lit(rf"(?<![^{SPACE}])[^\p{{L}}{SPACE}]++(?![^{SPACE}])")).cast("long").alias("n_bare"),
        _let(lines, lambda l: F.struct(F.size(l).alias("all"), F.size(F.array_distinct(l)).alias("kinds"), F.size(F.filter(l, lambda x: x.rlike(rf"[.!?:;\"”»…][{SPACE}]*$"))).alias("ended"))).alias("n_lines"),
    )
    w = F.col(held)
    windows = F.transform(F.arrays_zip(*[F.slice(w, k + 1, F.size(w) - SPAN + 1) for k in range(SPAN)]), lambda x: F.xxhash64(x))
    d = d.select(
        id_col,
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        *["word_chars", "n_symbols", "n_marks", "n_capitals", "n_other", "n_bare"],
        (F.col("n_lines.all") - F.col("n_lines.kinds")).cast("long").alias("n_dup_lines"),
        F.col("n_lines.all").cast("long").alias("n_lines"),
        F.col("n_lines.ended").cast("long").alias("n_ended"),
        F.when(F.size(w) >= SPAN, windows).otherwise(F.array().cast("array<bigint>")).alias(seen),
    )
    again = F.size(F.array_distinct(seen)) < F.size(seen)
    return d.withColumn("n_repeat_words", F.when(again, _repeat_words(F.col(seen))).otherwise(0).cast("long")).drop(seen)


def votes() -> list[Column]:
    return [F.when(F.expr(drop), 0).when(F.expr(keep), 1).otherwise(2).alias(f"v_{name}") for name, (drop, keep) in RULES.items()]


def learn(patterns: list[tuple[tuple[int, ...], int]], weak: float = WEAK) -> tuple[float, list[list[float]]]:
    """EM over (votes, count): the share of good documents, and for each rule its share of drop votes among its votes on bad and on good ones.

    Starts from the votes themselves: documents without a drop vote are taken as good at first.
    """
    votes_ = np.array([p for p, _ in patterns])
    n, total = np.array([c for _, c in patterns], float), float(sum(c for _, c in patterns))
    good = np.where((votes_ == 0).any(1), 0.1, 0.9)
    share, drops = 0.5, []
    for _ in range(ROUNDS):
        share = (1 + float(good @ n)) / (2 + total)
        drops, z = [], np.full(len(n), math.log(share / (1 - share)))
        for j in range(votes_.shape[1]):
            drop, keep = votes_[:, j] == 0, votes_[:, j] == 1
            # bad documents first
            d, k = (np.array([n[v] @ (1 - good[v]), n[v] @ good[v]]) + weak for v in (drop, keep))
            p = d / (d + k)
            z += np.where(drop, math.log(p[1] / p[0]), 0.0) + np.where(keep, math.log((1 - p[1]) / (1 - p[0])), 0.0)
            drops.append(p.tolist())
        new = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        change, good = float(np.abs(new - good).max()), new
        if change < 1e-9:
            break
    if sum(bad - fine for bad, fine in drops) < 0:  # the class with fewer drop votes is the good one
        return 1 - share, [[fine, bad] for bad, fine in drops]
    return share, drops


def posterior(share: float, drops: list[list[float]]) -> Column:
    z = F.lit(math.log(share / (1 - share)))
    for name, (bad, good) in zip(RULES, drops, strict=True):
        v = F.col(f"v_{name}")
        z = z + F.when(v == 0, math.log(good / bad)).when(v == 1, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts, base_failed, quality (the posterior) and kept."""
    counted = stash(measure(docs, id_col, text).select("*", *votes()), "quality")
    names = [f"v_{r}" for r in RULES]
    # at most 3 ** len(RULES) rows
    patterns = [(tuple(r[:-1]), r[-1]) for r in counted.groupBy(*names).count().collect()]
    quality = posterior(*learn(sorted(patterns))) if patterns else F.lit(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
