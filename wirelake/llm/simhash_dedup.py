"""SimHash near-duplicates verified through pivot distance tables.

Fingerprints: 64 bits over the 4-word shingles of the lower-cased text, XXH64 with seed 42; a bit is
set where it is set in over half the shingles. Distinct fingerprints (with their smallest document)
are the nodes, so exact copies cost nothing further.

Candidates: six blocks of bits; two fingerprints with at most four differing bits agree in at least
two blocks, so each of the 15 pairs of blocks is a key and no link is lost. The distances of each
fingerprint to 16 reference fingerprints are computed once, and travel with it. Within a key, in the order of the first coordinate, a
breadth-first search looks only at fingerprints whose first coordinate is within the threshold, discards a pair when some other coordinate
of the two distance tables differs by more (the triangle inequality), verifies the survivors by their exact Hamming distance,
and emits only a spanning forest - never all pairs of a group. A key with more
fingerprints than ``HEAVY`` is not gathered: its rows are dealt again by finer keys over the bits that
are still free, until no key is heavy (distinct fingerprints that agree in all but 13 bits
are at most 8192, so this ends).

Components: alternating large and small stars over the forest's edges, each round written to the
shared folder. A hub's edges meet only partial aggregates and joins that AQE splits.

Edge cases: a null text is the empty text, fingerprint zero, linked like any other; null ids get a row
and belong to the component of their fingerprint; repeated rows each get a row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stash, fresh_prefix, slices, stash, table, text_bytes

WORDS, SEED, BITS, PIVOTS, BLOCKS, HEAVY = 4, 42, 4, 16, 6, 50_000


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: -WORDS]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[WORDS - 1 :] - 1).tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    n = len(hashes)
    for at in range(0, n, 4096):
        part = np.array(hashes[at : at + 4096], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches):
    for b in slices(batches):
        yield pa.record_batch([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivots() -> list[int]:
    return [_signed(xxhash.xxh64_intdigest(f"pivot {i}", SEED)) for i in range(PIVOTS)]


def _packed_distances() -> list:
    """Eight distances to pivots in each long."""
    out = []
    for at in range(0, PIVOTS, 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(_pivots()[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * i))
        out.append(packed.alias(f"d{at // 8}"))
    return out


def _cover(free: list[int]) -> list[int]:
    """Masks of which at least one agrees for any two values that differ in at most BITS of the free bits."""
    blocks = [free[i::BLOCKS] for i in range(BLOCKS)]
    return [sum(1 << b for x in pair for b in x) for pair in combinations(blocks, BLOCKS - BITS)]


def _differ(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(fp: np.ndarray, dist: np.ndarray, bits: int) -> tuple[list, list]:
    """Edges of a spanning forest over the links of one key's fingerprints."""
    order = np.argsort(dist[:, 0], kind="stable")
    fp, dist = fp[order], dist[order]
    first, free = dist[:, 0], np.ones(len(fp), bool)
    lo, hi = np.searchsorted(first, first - bits, "left"), np.searchsorted(first, first + bits, "right")
    roots, found = [], []
    for root in range(len(fp)):
        if not free[root]:
            continue
        free[root], queue = False, [root]
        while queue:
            x = queue.pop()
            rest = lo[x] + np.flatnonzero(free[lo[x] : hi[x]])
            maybe = rest[np.abs(dist[rest] - dist[x]).max(1, initial=0) <= bits]
            near = maybe[_differ(fp[maybe], fp[x]) <= bits]
            if len(near):
                roots.extend([fp[root]] * len(near))
                found.extend(fp[near])
                queue.extend(near.tolist())
                free[near] = False
    return roots, found


def _linker(bits: int, heavy: int):
    """Over rows (key, fp, d0, d1) sorted by key: edges (key null), and the rows of keys that hold too many (with their key)."""

    def out(a, b, key=None):
        n = len(a)
        return pa.record_batch([pa.array([None] * n if key is None else key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["key", "a", "b"])

    def link(key, fp, d):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        near = (np.abs(d[two] - d[two + 1]).max(1) <= bits) if len(two) else np.zeros(0, bool)
        two = two[near]
        two = two[_differ(fp[two], fp[two + 1]) <= bits]
        a, b = fp[two].tolist(), fp[two + 1].tolist()
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            r, f = _forest(fp[s : s + n], d[s : s + n], bits)
            a.extend(r)
            b.extend(f)
        return a, b

    def run(batches):
        held, over = None, None  # rows of the key that is not over yet; the key whose rows pass by
        for batch in batches:
            key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            d = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], 1).copy().view(np.uint8).astype(np.int16)
            if held is not None:
                key, fp, d = np.concatenate((held[0], key)), np.concatenate((held[1], fp)), np.concatenate((held[2], d))
                held = None
            if over is not None:
                n = int(np.searchsorted(key, over, "right"))
                if n:
                    yield out(fp[:n], fp[:n], key[:n])
                if n < len(key):
                    over = None
                key, fp, d = key[n:], fp[n:], d[n:]
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - last > heavy:
                over = key[-1]
                yield out(fp[last:], fp[last:], key[last:])
            else:
                held = key[last:], fp[last:], d[last:]
            big = last and np.bincount(np.cumsum(np.concatenate(([0], key[1:last] != key[: last - 1])))).max() > heavy
            key, fp, d = key[:last], fp[:last], d[:last]
            if big:
                _, inverse, sizes = np.unique(key, return_inverse=True, return_counts=True)
                many = sizes[inverse] > heavy
                yield out(fp[many], fp[many], key[many])
                key, fp, d = key[~many], fp[~many], d[~many]
            if len(key):
                yield out(*link(key, fp, d))
        if held is not None:
            yield out(*link(*held))

    return run


def links(nodes: DataFrame, bits: int = BITS, heavy: int = HEAVY) -> DataFrame:
    """Edges (u, v) of a spanning forest of all links between the distinct fingerprints fp of nodes."""
    rows, edges = nodes.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).cast("long").alias("used")), None
    while True:
        masks = [(F.lit(i), F.lit(_signed(m))) for i, m in enumerate(_cover(list(range(64))))] if edges is None else None
        if masks:
            keyed = rows.select("fp", F.explode(F.array(*[F.struct(F.xxhash64(i, F.col("fp").bitwiseAND(m)).alias("key"), m.alias("used")) for i, m in masks])).alias("k"))
            keyed = keyed.select("k.key", "fp", "k.used")
        else:
            keyed = _finer(rows)
        keyed = keyed.select("key", "fp", *_packed_distances(), "used")
        out = stash(keyed.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp", "d0", "d1").mapInArrow(_linker(bits, heavy), "key long, a long, b long"), "simhash-links")
        new = out.where("key IS NULL").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = new if edges is None else edges.unionByName(new)
        passed = out.where("key IS NOT NULL")
        if passed.isEmpty():
            return edges
        used = keyed.select("key", "used").distinct()
        rows = stash(passed.select("key", F.col("a").alias("fp")).join(used.join(passed.select("key").distinct(), "key", "left_semi"), "key"), "simhash-heavy")


def _finer(rows: DataFrame) -> DataFrame:
    """Heavy keys' rows under finer keys: the masks of a cover of the bits that each key's mask leaves free."""
    masks = []
    for (used,) in rows.select("used").distinct().collect():  # at most 15 masks to a power of the depth
        free = [b for b in range(64) if not used >> b & 1]
        masks += [(used, i, _signed(m), _signed((used & (2**64 - 1)) | m)) for i, m in enumerate(_cover(free))]
    covers = F.broadcast(rows.sparkSession.createDataFrame(masks, "used long, i int, mask long, all long"))
    return rows.join(covers, "used").select(F.xxhash64("key", "i", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", F.col("all").alias("used"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    side = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return side.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the smallest node of u's component; nodes that are smallest themselves have no row."""
    now, sign = stash(_small_star(edges.where("u != v")), "components"), None
    while True:
        new = stash(_small_star(_large_star(now)), "components")
        stamp = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stash(now)
        if tuple(stamp) == sign:
            return new
        now, sign = new, tuple(stamp)


def _labelled(docs: DataFrame, bits: int, heavy: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, top, component_id) of every fingerprint; top names the component."""
    prints = stash(fingerprints(docs, id_col, text), "simhash")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    comp = components(links(nodes, bits, heavy)).select(F.col("u").alias("fp"), F.col("v").alias("top"))
    named = nodes.join(comp, "fp", "left").select("fp", "first", F.coalesce("top", "fp").alias("top"))
    best = named.groupBy("top").agg(F.min("first").alias("component_id"))
    return prints, stash(named.join(best, "top").select("fp", "top", "component_id"), "simhash-labels")


def near_duplicates(docs: DataFrame, bits: int = BITS, heavy: int = HEAVY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row."""
    prints, label = _labelled(docs, bits, heavy, id_col, text)
    return prints.join(label.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = BITS, heavy: int = HEAVY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each component with the smallest id, with all its columns; of rows that share that id, one."""
    prints, label = _labelled(docs, bits, heavy, id_col, text)
    n, kinds = prints.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == kinds:
        return docs.join(label.select(F.col("component_id").alias(id_col)).distinct().hint("merge"), id_col, "left_semi").select(docs.columns)
    place, own = docs.columns.index(text), fresh_prefix(docs.columns)

    def run(batches):
        for b in slices(batches):
            yield b.append_column(f"{own}fp", pa.array([fingerprint((t or "").encode()) for t in b.column(place).to_pylist()], pa.int64()))

    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(f"{own}fp", T.LongType())]))
    rows = rows.join(label.select(*[F.col(c).alias(own + c) for c in ("fp", "top", "component_id")]).hint("merge"), f"{own}fp")
    return rows.where(F.col(id_col).eqNullSafe(F.col(f"{own}component_id"))).dropDuplicates([f"{own}top"]).select(docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
