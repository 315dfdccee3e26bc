"""Mixing sources to target weights by Pfair scheduling. Native.

Each source's documents, in the order of a hash, are cut into blocks of equal size. With the rates that the weights give to the
sources that still have blocks, block j of a source is released when the source's fluid share reaches
j - 1 blocks and due when it reaches j. Earliest deadline first over the released blocks puts one block in each
slot. The rates sum to one at any time, so every block meets its deadline, and after any number of slots every source is less than
one block from its fluid share; when a source ends, the others share its rate in proportion.

A block is one ``SLOTS``-th of the rows at every size of the corpus (one row at least), so a source is never off its share by that part of
the corpus, and the schedule is a table of about ``SLOTS`` rows (plus one for each source), made on the driver from
one count for each source. Rows get their place in their source without a
window over the source: counts of hash buckets give offsets, and only the rows of one bucket are
ordered together.

Edge cases: every row comes out once, nothing is dropped or repeated; a null source is a source of its own; sources without
a weight get the mean of the given ones; weights of zero or less are taken as the smallest positive share (1e-6); ties and repeated rows
take neighbouring places in any order; an empty table gives an empty result; existing columns named mix_slot and mix_position are replaced, all others stay.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import fresh_prefix, table

SLOTS, BUCKET_ROWS, BUCKET_GROUP = 20_000, 256, 1024


def fluid(weights: list[float], blocks: list[int]) -> list[tuple[list[float], list[float]]]:
    """For each source the corners (time, share so far) of its fluid schedule: rates in proportion to the weights of sources that aren't over."""
    live = [i for i, n in enumerate(blocks) if n]
    corners = [([0.0], [0.0]) for _ in blocks]
    left, now = [float(n) for n in blocks], 0.0
    while live:
        total = sum(weights[i] for i in live)
        last = min(live, key=lambda i: left[i] / weights[i])
        span = left[last] / weights[last] * total
        now += span
        for i in live:
            left[i] -= span * weights[i] / total
        left[last] = 0.0
        for i in live:
            corners[i][0].append(now)
            corners[i][1].append(blocks[i] - left[i])
        live = [i for i in live if left[i] > 1e-9 * blocks[i]]
    return corners


def schedule(weights: list[float], blocks: list[int]) -> list[int]:
    """The source of each slot."""
    corners, slots = fluid(weights, blocks), sum(blocks)
    jobs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(slots + 1)]
    for i, n in enumerate(blocks):
        times, shares = corners[i]
        k, at = 1, 0.0
        for j in range(1, n + 1):
            release = at
            while k < len(shares) - 1 and shares[k] < j - 1e-7:
                k += 1
            s0, s1, t0, t1 = shares[k - 1], shares[k], times[k - 1], times[k]
            at = t1 if s1 <= j + 1e-7 else t0 + (j - s0) * (t1 - t0) / (s1 - s0)
            jobs[min(slots, math.floor(release + 1e-6))].append((math.ceil(at - 1e-6), i, j, 0))
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(slots):
        for job in jobs[slot]:
            heapq.heappush(ready, job)
        if not ready:  # rounding: take what the next slots release
            later = next(k for k in range(slot + 1, slots + 1) if jobs[k])
            heapq.heappush(ready, jobs[later].pop())
        out.append(heapq.heappop(ready)[1])
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", slots: int = SLOTS) -> DataFrame:
    """docs with mix_slot (the block's place) and mix_position (the row's place, from 0, without gaps)."""
    spark = docs.sparkSession
    weights = weights or {}
    docs = docs.drop("mix_slot", "mix_position")
    o = fresh_prefix(docs.columns)
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    rows = docs.withColumn(f"{o}source", key).withColumn(f"{o}hash", _row_hash(docs))
    counts = dict(rows.groupBy(f"{o}source").count().collect())  # one row for each source
    names, total = sorted(counts), sum(counts.values())
    size = max(1, math.ceil(total / slots))
    mean = sum(weights.values()) / len(weights) if weights else 1.0
    share = [max(1e-6, weights.get(None if n == "null" else n[1:], mean)) for n in names]
    blocks = [math.ceil(counts[n] / size) for n in names]
    place, at, seen = [], 0, [0] * len(names)
    for slot, i in enumerate(schedule(share, blocks)):
        place.append((names[i], seen[i], slot, at))
        at += min(size, counts[names[i]] - seen[i] * size)
        seen[i] += 1
    places = spark.createDataFrame(place, T.StructType([T.StructField(f"{o}source", T.StringType()), T.StructField(f"{o}block", T.LongType()), T.StructField("mix_slot", T.LongType()), T.StructField(f"{o}start", T.LongType())]))

    # offsets of hash buckets within each source
    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    rows = rows.withColumn(f"{o}bucket", F.pmod(f"{o}hash", F.lit(buckets)))
    filled = rows.groupBy(f"{o}source", f"{o}bucket").agg(F.count(F.lit(1)).alias(f"{o}n"))
    # sums before a bucket in two steps, so that no window holds all buckets of a source
    filled = filled.withColumn(f"{o}group", F.floor(F.col(f"{o}bucket") / BUCKET_GROUP))
    groups = filled.groupBy(f"{o}source", f"{o}group").agg(F.sum(f"{o}n").alias(f"{o}m"))
    earlier = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(f"{o}source", f"{o}group", F.coalesce(F.sum(f"{o}m").over(earlier([f"{o}source"], f"{o}group")), F.lit(0)).alias(f"{o}base"))
    inner = F.coalesce(F.sum(f"{o}n").over(earlier([f"{o}source", f"{o}group"], f"{o}bucket")), F.lit(0))
    offsets = filled.select(f"{o}source", f"{o}group", f"{o}bucket", inner.alias(f"{o}inner")).join(groups, [f"{o}source", f"{o}group"])
    offsets = offsets.select(f"{o}source", f"{o}bucket", (F.col(f"{o}base") + F.col(f"{o}inner")).alias(f"{o}before"))
    inside = Window.partitionBy(f"{o}source", f"{o}bucket").orderBy(f"{o}hash")
    ranked = rows.withColumn(f"{o}rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, [f"{o}source", f"{o}bucket"]).withColumn(f"{o}rank", F.col(f"{o}rank") + F.col(f"{o}before"))
    ranked = ranked.withColumn(f"{o}block", F.floor(F.col(f"{o}rank") / size).cast("long"))
    # about SLOTS rows and one for each source
    mixed = ranked.join(F.broadcast(places), [f"{o}source", f"{o}block"])
    return mixed.withColumn("mix_position", F.col(f"{o}start") + F.col(f"{o}rank") - F.col(f"{o}block") * size).select(*docs.columns, "mix_slot", "mix_position")


def _row_hash(docs: DataFrame) -> Column:
    """Of the id if there is one, else of all columns: repeated ids still spread by their text's length."""
    cols = [F.col(c) for c in docs.columns]
    if "doc_id" in docs.columns:
        cols = [F.col("doc_id")] + ([F.octet_length("text")] if "text" in docs.columns else [])
    return F.xxhash64(*cols)


def weights_of(spark: SparkSession, docs: DataFrame, source: str = "source", temperature: float = 0.5) -> dict[str | None, float]:
    """Target weights from sizes: the size to the power of temperature; one row for each source."""
    return {r[0]: r[1] ** temperature for r in docs.groupBy(F.col(source).cast("string")).count().collect()}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, weights_of(spark, docs)).select("doc_id", "source", "mix_slot", "mix_position")
