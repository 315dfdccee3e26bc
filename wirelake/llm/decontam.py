"""Benchmark decontamination with spaced seeds.

Words are lower-cased (A-Z) and split at the contract's white space. Fixed masks, which ignore some word positions,
name places by a hash of the words they keep. Equal hashes of a document and an item give a diagonal; around it the words
are compared place by place, so substituted words cost a match and nothing else. A document is contaminated by an item where, in a window of
``WINDOW`` words of the item (the whole item if it is shorter), at least ``SIMILAR`` of the words agree.

The masks are lossless for this rule. Items of ``LONG`` words and more have masks of weight six: a window's first 15 words
are five blocks of three, at most three words are substituted, so two blocks agree, and there is a mask for each distance of two blocks. In
shorter items at most two words are substituted, and one mask of weight four falls on agreeing words only.

The items are joined in blocks of at most ``BLOCK_WORDS`` words: each block's table is broadcast (its size is bounded) and the documents are
scanned once for each block, so a large benchmark costs passes, not memory, and a passage in a third of the documents
moves no rows.

Edge cases: null and empty texts and items are never contaminated; items of fewer than ``SHORTEST`` words have no
five-word shingle, are no passages and are not reported;
repeated documents are each reported, repeated items under each id; an item with null id is reported with null; empty tables give an empty
result; extra columns are ignored by pairs() and kept by clean().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

LONG = 15
MASKS = {False: ("1111", "11101", "11011", "10111"), True: ("111111", "111000111", "111000000111", "111000000000111")}
WINDOW, SIMILAR, SHORTEST, BLOCK_WORDS, GAP = 16, 0.8, 5, 500_000, 16


class Index:
    """Seeds of one block of items: [(id, text)]."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.names, self.words, self.vocab = [], [], {}
        for name, text in items:
            words = text.lower().split()
            if len(words) >= SHORTEST:
                self.names.append(name)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32))
        rng = np.random.default_rng(11)
        self.value = rng.integers(1, 2**63, len(self.vocab) + 1, np.uint64)
        self.factor = rng.integers(0, 2**62, GAP, np.uint64) * np.uint64(2) + np.uint64(1)
        flat, item, place = self._flat()
        long, self.tables = np.array([len(w) >= LONG for w in self.words], bool), []
        for kind, masks in MASKS.items():
            for mask in masks if (long == kind).any() else ():
                at, h = self.seeds(flat, mask)
                mine = long[item[at]] == kind
                at, h = at[mine], h[mine]
                order = np.argsort(h, kind="stable")
                low = np.zeros(1 << 22, bool)
                low[(h >> np.uint64(42)).astype(np.int64)] = True
                self.tables.append((mask, h[order], item[at[order]], place[at[order]], low))

    def _flat(self):
        pad = np.zeros(GAP, np.int32)
        flat = np.concatenate([x for w in self.words for x in (w, pad)] or [pad])
        item = np.concatenate([np.full(len(w) + GAP, i) for i, w in enumerate(self.words)] or [pad])
        place = np.concatenate([np.arange(len(w) + GAP) for w in self.words] or [pad])
        return flat, item, place

    def seeds(self, flat: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
        """Places where the mask falls on known words only, and their hashes."""
        kept = [k for k, c in enumerate(mask) if c == "1"]
        n = max(0, len(flat) - len(mask) + 1)
        known = flat > 0
        here = known[:n].copy()
        for k in kept[1:]:
            here &= known[k : k + n]
        at = np.flatnonzero(here)
        h = np.zeros(len(at), np.uint64)
        for k in kept:
            h += self.value[flat[at + k]] * self.factor[k]
        h ^= h >> np.uint64(29)
        return at, h * np.uint64(0x9E3779B97F4A7C15)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, words that agree, words of the window) for the best window of each contaminated pair."""
        get = self.vocab.get
        each = [np.array([get(w, 0) for w in t.lower().split()], np.int32) for t in texts]
        pad = np.zeros(GAP, np.int32)
        flat = np.concatenate([x for w in each for x in (w, pad)] or [pad])
        starts = np.cumsum([0] + [len(w) + GAP for w in each])
        found = []
        for mask, keys, item, place, low in self.tables:
            at, h = self.seeds(flat, mask)
            maybe = low[(h >> np.uint64(42)).astype(np.int64)]
            at, h = at[maybe], h[maybe]
            a, b = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            n = b - a
            if n.sum():
                src = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                text = np.searchsorted(starts, at, "right") - 1
                found.append(np.stack((np.repeat(text, n), item[src], np.repeat(at, n) - place[src]), 1))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for k, i, d in np.unique(np.concatenate(found), axis=0).tolist() if found else ():
            words = self.words[i]
            w = min(len(words), WINDOW)
            lo, hi = max(d, int(starts[k])), min(d + len(words), int(starts[k]) + len(each[k]))
            if hi - lo >= w:
                same = np.concatenate(([0], np.cumsum(flat[lo:hi] == words[lo - d : hi - d])))
                n = int((same[w:] - same[:-w]).max())
                if n >= math.ceil(SIMILAR * w - 1e-9):
                    best[k, i] = max(best.get((k, i), (0, w)), (n, w))
        return [(k, i, *v) for (k, i), v in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text: str):
    """The items in blocks of bounded size, one on the driver at a time."""
    items = benchmark.select(F.col(id_col).alias("id"), text_bytes(text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(size / (4 * BLOCK_WORDS)))
    for k in range(n):
        yield Index([(r.id, bytes(r.t)) for r in items.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).collect()])


def pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id, item, n_same, n_window, similarity of every contaminated pair."""
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), text_bytes(text).alias("t"))
    out = None
    for index in _blocks(benchmark, item_col, item_text):
        share = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, share=share):
            index = share.value
            for b in slices(batches):
                hits = index.search(b.column(1).to_pylist())
                ids = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                cols = [ids, pa.array([index.names[h[1]] for h in hits]), *(pa.array([h[k] for h in hits], pa.int64()) for k in (2, 3)), pa.array([h[2] / h[3] for h in hits], pa.float64())]
                if hits:
                    yield pa.record_batch(cols, names=["id", "item", "n_same", "n_window", "similarity"])

        part = plain.mapInArrow(run, f"id {kind}, item {item_kind}, n_same long, n_window long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_same", "n_window", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    place = docs.columns.index(text)
    for index in _blocks(benchmark, item_col, item_text):
        share = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, share=share):
            for b in slices(batches):
                hit = {h[0] for h in share.value.search([(t or "").encode() for t in b.column(place).to_pylist()])}
                yield b.filter(pa.array([k not in hit for k in range(b.num_rows)], pa.bool_())) if hit else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
