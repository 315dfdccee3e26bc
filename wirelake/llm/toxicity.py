"""Toxicity by compression distance.

Training takes a bounded sample of labelled documents (``SAMPLE`` of each class at most; held-out documents never) and splits it in halves. A
text of more than ``LONGEST`` bytes gives that many, in ``SLICES`` evenly spread slices. From the first half two zstandard
dictionaries are trained, one for each class: the ordinary one on the windows of ordinary texts, the toxic one on
the stretches of toxic texts whose d-mers (runs of ``DMER`` bytes) occur in a far larger share of toxic than of ordinary texts,
each with zeros around it, so that no match runs on into its neighbour. (Trained on whole toxic texts it would hold the prose that both
classes share, whose chance matches drown the signal.) Occurrences count once for each
different surrounding, so copies of a text don't make its words look frequent. Windows are compressed with the ordinary dictionary behind
zeros, or behind the toxic one: both have the same size and the ordinary part at the same distance, so that lengths differ by toxic matches alone.

Scoring cuts the whole text into windows of ``WINDOW`` bytes that overlap by ``WINDOW - STRIDE``, compresses each
with and without the toxic dictionary and takes the gain (bytes saved by it). The largest
gain and the sum of gains go through a logistic curve, calibrated on the second half of the sample.

Only the text is an input of a score. Edge cases: a null or empty text has no window and gets the curve's value
at no gain; rows without id are scored; repeated rows are each scored, and an id is learned from once; labels with other values than 0 and 1
or without a document are ignored; where the labels lack a class every score is the share of toxic rows among the usable ones
(0 if there are none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, table, text_bytes

SAMPLE, LONGEST, SLICES, DMER, WINDOW, STRIDE = 2500, 20_000, 20, 5, 56, 36
SHARED_BYTES, TOXIC_BYTES, RATIO, LEAST, CORE, AROUND, THRESHOLD = 512, 4096, 60.0, 4, 0.4, 6, 0.3
LEAST_SHARE, PAD = 0.008, bytes(5)
#: Around each window: a first match for every window, so that none is stored uncompressed, and bytes after the last place where zstandard looks for a match.
ANCHOR, TAIL = b"\x01\x02\x03before every window\x04\x05\x06", b"\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15"
FOLDS, HELD = 4, 2


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    bias: float
    weights: tuple[float, float]


def _lower(text: bytes) -> bytes:
    return text.lower()


def _dmers(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = len(a) - DMER + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(DMER):
        out |= a[i : i + n] << np.uint64(8 * i)
    return out


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """d-mers, and in how many different surroundings each stands; copies of a text add none."""
    pairs = np.zeros((0, 2), np.uint64)
    for at in range(0, len(texts), 500):
        each = [pairs]
        for t in texts[at : at + 500]:
            m = _dmers(b" " * AROUND + t + b" " * AROUND)
            n = len(m) - 2 * AROUND
            if n > 0:
                each.append(np.stack((m[AROUND : AROUND + n], m[:n] * np.uint64(0x9E3779B97F4A7C15) ^ m[2 * AROUND :]), 1))
        pairs = np.concatenate(each)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs
    return np.unique(pairs[:, 0], return_counts=True)


def toxic_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of d-mers that mark toxic texts, one for each occurrence."""
    kt, nt = _contexts(toxic)
    kt, nt = kt[nt >= LEAST], nt[nt >= LEAST]
    seen, docs = (sum((np.isin(kt, _dmers(t)) for t in texts), np.zeros(len(kt))) for texts in (ordinary, toxic))
    nt = np.minimum(nt, docs)
    least = max(LEAST, LEAST_SHARE * len(toxic))
    use = (nt >= least) & (nt / len(toxic) >= RATIO * (seen + 0.5) / max(1, len(ordinary)))
    marks, often, out = kt[use], nt[use], []
    for t in (b" " + t + b" " for t in toxic):
        m = _dmers(t)
        hit = np.flatnonzero(np.isin(m, marks))
        if len(hit):
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                # the core: without the d-mers that only reach into a neighbouring word
                n = often[np.searchsorted(marks, m[run])]
                core = run[n >= CORE * n.max()]
                out.append(t[core[0] : core[-1] + DMER])
    return out


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes | None:
    """The content of a COVER dictionary; None if there is too little text for one."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return None


def toxic_content(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    samples = [PAD + x + PAD for x in toxic_stretches(toxic, ordinary)]
    content = _trained(samples, TOXIC_BYTES, 16, 6)
    if content is None:
        content = b"".join(x for x, _ in reversed(Counter(samples).most_common()))[-TOXIC_BYTES:]
    else:
        content = content[max(0, content.find(PAD)) :]  # without the tables before the content
    # a length that keeps the ordinary part's place in the hash table's grid
    return content + bytes(-len(content) % 12)


def ordinary_content(texts: list[bytes]) -> bytes:
    content = _trained([t[i : i + 512] for t in texts for i in range(0, len(t), 512)], SHARED_BYTES, 64, 8)
    return b"".join(texts)[:SHARED_BYTES] if content is None else content


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Raw content, and windows too short for coded literals, so that lengths differ by matches alone; every window starts with a match of ANCHOR, so that none is stored uncompressed."""
    kind = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_LAZY2, min_match=DMER, target_length=0, write_checksum=False, write_content_size=False, write_dict_id=False)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=kind)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.pair = model, (_compressor(bytes(len(model.toxic)) + model.ordinary), _compressor(model.toxic + model.ordinary))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the largest gain, and the sum of gains over one byte, damped."""
        cut, of = [], []
        for i, t in enumerate(texts):
            t = b" " + _lower(t) + b" " if t else t
            cut += (w := [ANCHOR + t[a : a + WINDOW] + TAIL for a in range(0, max(1, len(t) - (WINDOW - STRIDE)), STRIDE)] if t else [])
            of += [i] * len(w)
        out = np.zeros((len(texts), 2))
        if cut:
            a, b = ([len(c.compress(w)) for w in cut] for c in self.pair)
            gain, of = np.array(a) - np.array(b), np.array(of)
            np.maximum.at(out[:, 0], of, gain)
            np.add.at(out[:, 1], of, np.maximum(gain - 1, 0))
        out[:, 1] = np.log1p(out[:, 1])
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = self.model.bias + self.features(texts) @ np.array(self.model.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple[float, float]]:
    """Ridge logistic regression by Newton steps, damped; weights never below zero."""
    a, w = np.column_stack((np.ones(len(x)), x)), np.zeros(3)
    ridge = np.array([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
    w[1:] = np.maximum(w[1:], 0)
    return float(w[0]), (float(w[1]), float(w[2]))


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """rows: (text, label) in an order that doesn't depend on the label."""
    both = [[_lower(t) for t, y in rows if y == c] for c in (0, 1)]
    if not both[0] or not both[1]:
        share = len(both[1]) / max(1, len(rows))
        return Model(b"", b"", float(np.clip(np.log(max(share, 1e-13) / max(1 - share, 1e-13)), -30, 30)), (0.0, 0.0))
    first = [x[::2] for x in both]
    second = [x[1::2] or x for x in both]
    model = Model(ordinary_content(first[0]), toxic_content(first[1], first[0]), 0.0, (0.0, 0.0))
    x = Scorer(model).features(second[0] + second[1])
    y = np.array([0] * len(second[0]) + [1] * len(second[1]))
    model.bias, model.weights = _logistic(x, y)
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model:
    usable = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(id_col, FOLDS) != HELD)).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y"))
    order = F.xxhash64("id")
    sample = None
    for y in (0, 1):
        part = usable.where(F.col("y") == y).select("id", "y", order.alias("o")).orderBy("o", "id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), _bounded(text_bytes(text)).alias("t"))
    # the sample's size is bounded by 2 * SAMPLE, so it may be broadcast; one text of each id, of bounded size
    rows = texts.join(F.broadcast(sample), "id").groupBy("o", "id", "y").agg(F.min("t").alias("t")).collect()
    return fit([(bytes(r.t), r.y) for r in sorted(rows, key=lambda r: (r.o, r.id, r.y))])


def _bounded(t: Column) -> Column:
    """The bytes of a text, or slices of a long one that are spread over all of it."""
    size, piece = F.octet_length(t), LONGEST // SLICES
    spread = F.concat(*[F.substring(t, F.floor((size - piece) * i / (SLICES - 1)).cast("int") + 1, F.lit(piece)) for i in range(SLICES)])
    return F.when(size <= LONGEST, t).otherwise(spread)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score of every row."""
    share = docs.sparkSession.sparkContext.broadcast(model)  # at most SHARED_BYTES + TOXIC_BYTES and a bit

    def run(batches):
        scorer = Scorer(share.value)
        for b in slices(batches):
            yield pa.record_batch([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("t")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    share, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        scorer = Scorer(share.value)
        for b in slices(batches):
            yield b.filter(pa.array(scorer.scores([(t or "").encode() for t in b.column(place).to_pylist()]) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
