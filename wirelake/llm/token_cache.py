"""Token counts through a digest cache.

Every text is normalised (null becomes the empty text; no other change, because a byte-level
tokenizer counts every byte) and digested with SHA-256. The cache is a Parquet table of
(content digest, tokenizer digest, n_bytes, n_tokens). A run joins its distinct digests to the
cache, encodes only the distinct misses and appends them; then each document looks its digest up. Digests meet the cache before any text
moves. Runs at the same time may append the same digest twice, so reading takes one row of each.

With a byte-level tokenizer that has no normaliser, inside a task, texts are cut before each run of blanks that follows a non-blank. No
pre-token of the byte-level pattern spans such a cut, so the count of a text is the sum over its
pieces, and repeated pieces are encoded once. Texts with other kinds of white space, control
characters or a special string go to the library whole, as do all texts of other tokenizers (.json or .model).

Edge cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and repeated ids are each
answered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices, stash, table, text_bytes

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces that a task remembers at most before it starts anew.
PIECES = 400_000
PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0 ᠎ -‏ -  -⁯　﻿]")
CACHE_SCHEMA = "digest binary, tokenizer string, n_bytes long, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Names the exact version of a tokenizer: the file's SHA-256 and the library's version."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        return f"{hashlib.sha256(f.read()).hexdigest()}:{(sentencepiece if path.endswith('.model') else tokenizers).__version__}"


class PieceCounter:
    """Counts tokens of texts as the library gives them, without begin, end or added special tokens."""

    def __init__(self, path: str):
        self.known: dict[str, int] = {}
        self.pieces = False
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.model = None
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        before = how.get("pre_tokenizer") or {}
        self.pieces = not how.get("normalizer") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)

    def _encode(self, texts: list[str]) -> list[int]:
        if self.model is not None:
            return [len(x) for x in self.model.encode(texts)]
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bool:
        return not self.pieces or bool(ODD.search(text)) or any(s in text for s in self.special)

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        cut = {}
        for i, text in enumerate(texts):
            if self.whole(text):
                out[i] = self._encode([text])[0]
            else:
                cut[i] = PIECE.findall(text)
        if len(self.known) > PIECES:
            self.known.clear()
        new = list(set().union(*cut.values()).difference(self.known)) if cut else []
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self._encode(part), strict=True))
        for i, pieces in cut.items():
            out[i] = sum(map(self.known.__getitem__, pieces))
        return out


def _encoder(path: str, version: str):
    def encode(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = PieceCounter(path)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            yield pa.record_batch(
                [b.column(0), pa.array([version] * len(texts), pa.string()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())],
                names=["digest", "tokenizer", "n_bytes", "n_tokens"],
            )

    return encode


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def extend_cache(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """Append the counts of all texts that the cache lacks; returns the cache's rows of this tokenizer.

    Equal texts meet in a partial aggregate before the shuffle, so a group of copies of any size sends
    at most one text from each task.
    """
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)
    version = tokenizer_digest(path)
    known = _rows(spark, cache, version)
    texts = docs.select(digest(text_bytes(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if known is not None:
        new = stash(texts.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "token-misses")
        # few misses are broadcast by their table's size, and then no text of a hit moves
        texts = texts.join(new, "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses.mapInArrow(_encoder(path, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    return _rows(spark, cache, version)


def _rows(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version).dropDuplicates(["digest"])


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = TOKENIZER, limit: int = LIMIT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. cache: a folder that all executors share; a new one if None."""
    # one row of each digest, written: an aggregate beside the join would keep AQE from splitting the copies of one text
    counts = stash(extend_cache(docs, cache or fresh_path(docs.sparkSession, "token-cache"), tokenizer, text), "token-counts")
    keys = docs.select(F.col(id_col), digest(text_bytes(text)).alias("digest"))
    # A text's copies may hold a third of the keys: a shuffled join whose skewed partitions AQE splits.
    return keys.join(counts.select("digest", "n_bytes", "n_tokens").hint("merge"), "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
