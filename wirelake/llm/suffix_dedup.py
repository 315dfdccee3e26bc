"""Removal of repeated strings by distributed prefix doubling over sampled positions.

Wanted: every byte under a ``LENGTH``-byte string that also starts earlier (smaller id, or same document and earlier start). Rank pairs of all
positions would be some 35 times the table on disk for each doubling, so the ranked positions are a sample that equal strings share:

* Sample: each window of ``LENGTH`` bytes is owned by the position of its least ``PREFIX``-byte name (leftmost of equals). The choice depends
  on the window's bytes alone, so equal windows have owners at equal places. An owner has a run of consecutive windows.
* Doubling: Spark sorts the positions by their names of 24 bytes and reranks them: equal names get one dense rank, and positions that
  are alone are dropped. Runs whose whole texts are equal too repeat as wholes, all but the first. The first ones are sorted by the pair
  (rank, name of the next 24 bytes), which ranks 48 bytes, then by (rank, name of the next 48), which ranks 96. A position that is alone
  at a length can share no window that reaches further to its right: only its windows with a shorter reach go on.
* Past the threshold: runs that are left are cut into pieces of ``FINE`` windows, sorted by the pair (bytes that all windows of a piece share,
  bytes that any covers); pieces that differ only in the second go on window by window, ranked by the overlapping pair of names of 64 bytes
  at offsets 0 and ``LENGTH - 64``, after which nothing is left to tell apart.

Every sort orders by (rank, name, document, place) over range partitions, so the first of a class is its earliest place, and a class of any
size lies over as many partitions as it needs; ranks are joined up over the partitions' borders from one row for each partition. Equality rests
on 128 bits throughout. Equal rows of one task meet before the shuffle, so copies and passages in a third of the documents send a row from
each task. Each round's shuffle files go when its table is written, and each table when the next one is.

Edge cases: null and empty texts have no strings and keep the digest of no bytes; texts are bytes, a cut may fall inside a character; rows
that repeat both id and text count as one document and each get its row; rows with equal ids and different texts, and null ids (before all
others), are ordered by their texts' hashes; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import drop_stash, slices, stash, table, text_bytes

LENGTH, PREFIX, FINE, OVERLAP = 100, 24, 8, 64
PIECE, CHUNK = 1 << 20, 400_000
#: Rows of a sort's partition and bytes of text of a join's partition, beyond which there are more partitions than the session's number.
SORT_ROWS, JOIN_BYTES = 4_000_000, 256_000_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
OWNERS = ("key", "mid", "name", "doc", "run")
PIECES = ("key", "name", "doc", "run", "of")
WINDOWS = ("key", "name", "doc", "run")


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    m = x * M1 + y * M2
    m ^= m >> np.uint64(32)
    m *= M3
    m ^= m >> np.uint64(29)
    return m


def names(a: np.ndarray) -> np.ndarray:
    """Names of the PREFIX bytes from each position: 1, 2, 4 and 8 bytes exactly, 16 and 24 by hashes."""
    n = a.astype(np.uint64)
    for k in (1, 2, 4):
        n = n[:-k] | n[k:] << np.uint64(8 * k)
    return _mix(_mix(n[:-16], n[8:-8]), n[16:])


def owners(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(position, its name, first window, last window, names of the next bytes) of every owner, in order.

    The last column holds 32 bits of the name of the next 24 bytes, then 32 bits of that of the 48 bytes after them; zero where no window
    of the run reaches so far. Long texts go by pieces that share no window.
    """
    span, out = length - PREFIX + 1, []
    for lo in range(0, max(1, len(text) - length + 1), PIECE):
        a = np.frombuffer(text, np.uint8)[lo : lo + PIECE + length - 1]
        if len(a) < length:
            continue
        h = names(a)
        low = np.uint64((1 << 21) - 1)
        m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < span:  # least over a window of span positions, by doubling
            k = min(have, span - have)
            m = np.minimum(m[:-k], m[k:])
            have += k
        q = (m & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        last = np.append(first[1:], len(q)) - 1
        q = q[first]
        end, top = last + length - q, len(h) - 1
        second = np.where(end >= 2 * PREFIX, h[np.minimum(q + PREFIX, top)], 0)
        third = np.where(end >= 4 * PREFIX, _mix(h[np.minimum(q + 2 * PREFIX, top)], h[np.minimum(q + 3 * PREFIX, top)]), 0)
        out.append((q + lo, h[q], first + lo, last + lo, (second >> np.uint64(32)) << np.uint64(32) | third >> np.uint64(32)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _pack(first, inside, n):
    """A run as one number that sorts by its first window: first window, owner's distance from it, windows."""
    return first << 14 | inside << 7 | n


def _own(doc: int, text: bytes):
    """Owners' names, and the names of all bytes that their windows cover."""
    q, h, l, r, mid = owners(text)
    digest = xxhash.xxh3_64_intdigest
    whole = [digest(text[a : b + LENGTH], c) for a, b, c in zip(l.tolist(), r.tolist(), (q - l).tolist(), strict=True)]
    return h.view(np.int64), mid.view(np.int64), np.array(whole, np.uint64).view(np.int64), np.full(len(q), doc, np.int64), _pack(l, q - l, r - l + 1)


def _cut(doc: int, run: int, b: bytes):
    """The run's pieces, cut at multiples of FINE windows before the owner: the bytes that all windows of a piece share against those that any covers. b: the bytes from the run's first window."""
    key, name, out = [], [], []
    digest = xxhash.xxh3_64_intdigest
    l, inside, n = run >> 14, run >> 7 & 127, run & 127
    at = 0
    while at < n:
        g = (inside - at) // FINE
        end = min(n - 1, inside - g * FINE)  # last window of the piece
        near = inside - g * FINE  # a whole piece would end here, and all its windows hold the bytes from here
        key.append(digest(b[near : near - FINE + 1 + LENGTH], g))
        name.append(digest(b[at : end + LENGTH], inside - at))
        out.append(_pack(l + at, 0, end - at + 1))
        at = end + 1
    k = len(out)
    return np.array(key, np.uint64).view(np.int64), np.array(name, np.uint64).view(np.int64), np.full(k, doc, np.int64), np.array(out, np.int64), np.full(k, run, np.int64)


def _single(doc: int, run: int, of: int, b: bytes):
    """Each window of a piece by itself, as the overlapping pair of names of OVERLAP bytes."""
    lo, n, digest = (run >> 14) - (of >> 14), run & 127, xxhash.xxh3_64_intdigest
    cut = [b[p : p + LENGTH] for p in range(lo, lo + n)]
    key = np.array([digest(c[:OVERLAP], 2) for c in cut], np.uint64)
    name = np.array([digest(c[-OVERLAP:], 3) for c in cut], np.uint64)
    return key.view(np.int64), name.view(np.int64), np.full(n, doc, np.int64), _pack((run >> 14) + np.arange(n, dtype=np.int64), 0, 1)


def _merged(doc: np.ndarray, run: np.ndarray):
    """Byte spans of runs of windows, joined where they touch in a document."""
    order = np.lexsort((run, doc))
    doc, run = doc[order], run[order]
    s, e = run >> 14, (run >> 14) + (run & 127) - 1 + LENGTH
    # spans of a document lie in order of their starts and have about equal lengths; a running maximum of ends joins them
    base = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64)))) * (int(e.max(initial=0)) + 1)
    reach = np.maximum.accumulate(e + base)
    new = np.concatenate(([True], (s + base)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return s[at], np.maximum.reduceat(e, at) if len(at) else e, doc[at]


def _combined(names_: tuple[str, ...], parts: list[tuple]):
    """One chunk's rows: the first run of each pair of key and name, and the spans of all others, which repeat it."""
    c = dict(zip(names_, (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))
    order = np.lexsort((c["run"], c["doc"], c["name"], c["key"]))
    c = {k: v[order] for k, v in c.items()}
    first = np.concatenate(([True], (c["key"][1:] != c["key"][:-1]) | (c["name"][1:] != c["name"][:-1])))
    s, e, d = _merged(c["doc"][~first], c["run"][~first]) if not first.all() else (np.zeros(0, np.int64),) * 3
    back = np.lexsort((c["run"][first], c["doc"][first]))  # in the order of documents the last columns take little room
    spans = {"key": s, "name": e, "doc": d}
    cols = [np.concatenate((v[first][back], spans.get(k, np.zeros(len(s), np.int64)))) for k, v in c.items()]
    dup = np.concatenate((np.zeros(len(back), bool), np.ones(len(s), bool)))
    return pa.record_batch([pa.array(dup), *map(pa.array, cols)], names=["dup", *names_])


def _made(make, names_: tuple[str, ...]):
    """Over rows of make's arguments: rows of names_, and the spans (doc, key, name) that repeat earlier bytes of the same chunk."""

    def run(batches):
        parts, n = [], 0
        for b in slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cols = make(*row)
                if len(cols[0]):
                    parts.append(cols)
                    n += len(cols[0])
                if n >= CHUNK:
                    yield _combined(names_, parts)
                    parts, n = [], 0
        if parts:
            yield _combined(names_, parts)

    return run


def _schema(cols) -> str:
    return ", ".join(f"{c} long" for c in cols)


def _rerank(cols: tuple[str, ...], by: int, least: int):
    """Over rows in order of their first by columns, then place: the partition's number, the row's class in it, and how it shares.

    depth: how many of the first by columns the row has in common with a neighbour (a partition's first and last row: all of them, for what
    lies beyond is unknown here); rows of less than least are dropped. head: the first row of its class here; second: a head whose first
    column stood before it under another class.
    """
    out = [*cols, "pid", "cls", "depth", "head", "second"]

    def run(batches):
        from pyspark import TaskContext

        pid, classes, before, held = TaskContext.get().partitionId(), 0, None, None

        def annotated(x: np.ndarray, after):
            """x: rows, whose neighbours are before (None: the border) and after."""
            nonlocal classes, before
            same = np.zeros(len(x) + 1, np.int64)  # with the row before it; the last: of the row after
            alike = np.ones(max(0, len(x) - 1), bool)
            for k in range(by):
                alike &= x[1:, k] == x[:-1, k]
                same[1:-1] += alike
            for place, other, own in ((0, before, x[0]), (len(x), after, x[-1])):
                same[place] = by if other is None else int(np.cumprod(other[:by] == own[:by]).sum())
            head = same[:-1] < by
            if before is None:
                head[0] = True
            cls = classes + np.cumsum(head) - 1
            second = head & (same[:-1] >= 1)
            depth = np.maximum(same[:-1], same[1:])
            classes, before = int(cls[-1]) + 1, x[-1]
            keep = depth >= least
            flags = [pa.array(v[keep]) for v in (np.full(len(x), pid, np.int32), cls, depth.astype(np.int32), head, second)]
            return pa.record_batch([*(pa.array(x[keep, k]) for k in range(len(cols))), *flags], names=out)

        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) if b.num_rows else None
            if x is None:
                continue
            if held is not None:
                yield annotated(held, x[0])
            held = x
        if held is not None:
            yield annotated(held, None)

    return run


def _parts(spark: SparkSession, n: int, most: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / most))


def _sorted(rows: DataFrame, by: tuple[str, ...], least: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (of written tables) sorted by (by, doc, run) and reranked: with ranked (dense ranks of the classes), and depth, head and second as in _rerank; and the written table behind it."""
    spark, order = rows.sparkSession, [*by, "doc", "run"]
    cols = (*by, *(c for c in rows.columns if c not in by))
    dealt = rows.select(*cols).repartitionByRange(_parts(spark, rows.count(), SORT_ROWS), *order).sortWithinPartitions(*order)
    out = stash(dealt.mapInArrow(_rerank(cols, len(by), least), _schema(cols) + ", pid int, cls long, depth int, head boolean, second boolean"), name, "zstd")
    # one row for each partition; its first and last rows are always there
    ends = out.groupBy("pid").agg(F.min(F.struct(*by)), F.max(F.struct(*by)), F.max("cls")).collect()
    base, at, before = [], 0, None
    for pid, first, last, top in sorted(ends):
        goes_on = before == first
        at -= goes_on
        base.append((pid, at, goes_on))
        at, before = at + top + 1, last
    base = F.broadcast(spark.createDataFrame(base or [(0, 0, False)], "pid int, base long, goes_on boolean"))
    onward = F.col("goes_on") & (F.col("cls") == 0)
    ranked = out.join(base, "pid").select(*cols, (F.col("base") + F.col("cls")).alias("ranked"), "depth", (F.col("head") & ~onward).alias("head"), (F.col("second") & ~onward).alias("second"))
    return ranked, out


def _span(run: str = "run") -> list:
    return [F.shiftright(run, 14).alias("s"), (F.shiftright(run, 14) + F.col(run).bitwiseAND(127) - 1 + LENGTH).alias("e")]


def _dups(rows: DataFrame) -> DataFrame:
    return rows.where("dup").select("doc", F.col("key").alias("s"), F.col("name").alias("e"))


def _live(rows: DataFrame) -> DataFrame:
    return rows.where("not dup").drop("dup")


def _far(runs: DataFrame, low: int) -> DataFrame:
    """The runs' windows that start at least low bytes before the owner."""
    n = F.least(F.col("run").bitwiseAND(127), F.shiftright("run", 7).bitwiseAND(127) - low + 1)
    return runs.where(n > 0).select("doc", (F.shiftleft(F.shiftright("run", 7), 7) + n).alias("run"))


def _joined(texts: DataFrame, runs: DataFrame, size: int, how: str) -> DataFrame:
    """texts with their lists of runs; doc numbers are unique on both sides."""
    n = _parts(texts.sparkSession, size, JOIN_BYTES)
    return texts.repartition(n, "doc").join(runs.repartition(n, "doc").hint("merge"), "doc", how)


def _bytes_of(batches):
    for b in slices(batches):
        out = [(doc, run, text[run >> 14 : (run >> 14) + (run & 127) - 1 + LENGTH]) for doc, text, runs in zip(*(c.to_pylist() for c in b.columns), strict=True) for run in runs]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc", "run", "b"])


def repeats(texts: DataFrame, size: int) -> DataFrame:
    """Byte spans (doc, s, e) that repeat earlier ones, over texts (doc, t) of size bytes."""
    spans = []

    def found(df: DataFrame) -> None:
        spans.append(stash(df, "suffix-spans", "zstd"))

    rows = stash(texts.mapInArrow(_made(_own, OWNERS), "dup boolean, " + _schema(OWNERS)), "suffix-owners", "zstd")
    found(_dups(rows))
    # 24 bytes: positions that are alone are dropped
    r24, t24 = _sorted(_live(rows), ("key",), 1, "suffix-24")
    drop_stash(rows)
    # whole runs: all but the first repeat
    whole, t_whole = _sorted(r24.select(F.col("ranked").alias("rank"), "mid", "name", "doc", "run"), ("rank", "name"), 0, "suffix-whole")
    drop_stash(t24)
    found(whole.where("not head").select("doc", *_span()))
    # 48 bytes, then 96, of the first ones
    heads = whole.where("head").select("rank", F.shiftright("mid", 32).alias("next"), F.col("mid").bitwiseAND(0xFFFFFFFF).alias("after"), "doc", "run")
    r48, t48 = _sorted(heads, ("rank", "next"), 1, "suffix-48")
    drop_stash(t_whole)
    r96, t96 = _sorted(r48.where("depth = 2").select(F.col("ranked").alias("rank"), "after", "doc", "run"), ("rank", "after"), 0, "suffix-96")
    left = _far(r48.where("depth = 1"), LENGTH - 2 * PREFIX + 1).unionByName(_far(r96.where("depth < 2"), LENGTH - 4 * PREFIX + 1))
    left = stash(left.unionByName(r96.where("depth = 2").select("doc", "run")), "suffix-left", "zstd")
    drop_stash(t48)
    drop_stash(t96)
    each = left.groupBy("doc").agg(F.collect_list("run").alias("runs"))  # at most a number for each window of a document
    runs = stash(_joined(texts, each, size, "inner").select("doc", "t", "runs").mapInArrow(_bytes_of, "doc long, run long, b binary"), "suffix-runs", "zstd")
    drop_stash(left)
    # pieces, then single windows
    rows = stash(runs.mapInArrow(_made(_cut, PIECES), "dup boolean, " + _schema(PIECES)), "suffix-pieces", "zstd")
    found(_dups(rows))
    pieces, t_pieces = _sorted(_live(rows), ("key", "name"), 1, "suffix-pieces")
    drop_stash(rows)
    found(pieces.where("not head").select("doc", *_span()))
    several = pieces.where("second").select("key").distinct()
    more = stash(pieces.where("head").join(several.hint("merge"), "key", "left_semi").select("doc", "run", "of"), "suffix-more", "zstd")
    drop_stash(t_pieces)
    cut = more.hint("merge").join(runs.withColumnRenamed("run", "of"), ["doc", "of"]).select("doc", "run", "of", "b")
    rows = stash(cut.mapInArrow(_made(_single, WINDOWS), "dup boolean, " + _schema(WINDOWS)), "suffix-windows", "zstd")
    drop_stash(runs)
    drop_stash(more)
    found(_dups(rows))
    windows, t_windows = _sorted(_live(rows), ("key", "name"), 2, "suffix-windows")
    drop_stash(rows)
    found(windows.where("not head").select("doc", *_span()))
    drop_stash(t_windows)
    return reduce(DataFrame.unionByName, spans)


def _numbered(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame | None, int]:
    """(doc, t): every document once under a number in the order of ids; (doc, id, n) if ids repeat or are null, else None and the ids themselves; and the bytes of all texts."""
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text).alias("t"))
    n, kinds, size = plain.agg(F.count(F.lit(1)), F.count_distinct("id"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    if n == kinds:
        return plain.withColumnRenamed("id", "doc"), None, size
    keyed = plain.withColumn("th", F.xxhash64("t"))
    each = keyed.groupBy("id", "th").agg(F.count(F.lit(1)).alias("n"))
    dealt = stash(each.repartitionByRange(F.col("id").asc_nulls_first(), "th").withColumn("pid", F.spark_partition_id()), "suffix-ids")
    sizes = sorted((r.pid, r["count"]) for r in dealt.groupBy("pid").count().collect())  # one row for each partition
    before, at = [], 0
    for pid, count in sizes:
        before.append((pid, at))
        at += count
    offset = docs.sparkSession.createDataFrame(before or [(0, 0)], "pid int, at long")
    order = Window.partitionBy("pid").orderBy(F.col("id").asc_nulls_first(), "th")
    ids = stash(dealt.withColumn("r", F.row_number().over(order)).join(F.broadcast(offset), "pid").select("id", "th", "n", (F.col("at") + F.col("r")).alias("doc")), "suffix-numbers")
    same = keyed["id"].eqNullSafe(ids["id"]) & (keyed["th"] == ids["th"])
    numbered = keyed.join(ids, same).select("doc", "t").groupBy("doc").agg(F.first("t").alias("t"))
    return stash(numbered, "suffix-texts", "zstd"), ids.select("doc", "id", "n"), size


def _last(batches):
    for b in slices(batches):
        out = []
        for doc, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            kept, at, removed, n, reach = hashlib.sha256(), 0, 0, 0, -1
            for x in sorted((x["s"], x["e"]) for x in spans or ()):
                if x[0] > reach:  # touching spans are one run
                    if reach >= 0:
                        at = reach
                    kept.update(text[at : x[0]])
                    n += 1
                    removed += x[1] - x[0]
                    reach = at = x[1]
                elif x[1] > reach:
                    removed += x[1] - reach
                    reach = at = x[1]
            kept.update(text[at:])
            out.append((doc, len(text), removed, n, kept.hexdigest()))
        cols = list(zip(*out, strict=True))
        yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts, ids, size = _numbered(docs, id_col, text)
    each = repeats(texts, size).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    out = _joined(texts, each, size, "left").select("doc", "t", "spans").mapInArrow(_last, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if ids is None:
        return out.withColumnRenamed("doc", id_col)
    rest = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.join(ids, "doc").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(F.col("id").alias(id_col), *rest)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
