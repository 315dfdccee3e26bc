"""Putting packets together from their tables: ranges of ids, repeated layers in order, wide rows for export, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.search import ORDER, Scope, matching, scoped
from ..plans.store import Store
from ..registry import COMPONENTS, KEYS, UPPER_LAYERS, in_sessions
from . import codec, files


#: Numbers that one window holds at most when runs are looked for, and nanoseconds of one when gaps are.
RUN_BUCKET, GAP_BUCKET = 1 << 16, 60_000_000_000


def id_ranges(df: DataFrame, group: str = "session_id", number: str = "packet_id") -> DataFrame:
    """Runs of consecutive numbers: group, first, last, n.

    Runs are found within buckets of numbers first, where members share number minus rank; then runs that meet at a border are
    joined, over runs only. So a group with a third of all rows is spread over many tasks.
    """
    cut = F.floor(F.col(number) / RUN_BUCKET)
    rank = F.row_number().over(Window.partitionBy(group, "_cut").orderBy(number))
    marked = df.select(group, number).distinct().withColumn("_cut", cut).withColumn("_run", F.col(number) - rank)
    runs = marked.groupBy(group, "_cut", "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy("first")
    fresh = F.coalesce(F.col("first") != F.lag("last").over(order) + 1, F.lit(True)).cast("int")
    return runs.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(order)).groupBy(group, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").cast("long").alias("n")).drop("_run")


def arrays_by_layer(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row for each key with one array for each column, all in the same order. order must be total."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in columns])))
    each = df.groupBy(*keys).agg(items.alias("_items"))
    return each.select(*keys, *[F.transform("_items", _field(f"_v_{c}")).alias(c) for c in columns])


def _field(name: str):
    return lambda x: x[name]


def export_rows(store: Store, text: str = "", scope: Scope = Scope()) -> DataFrame:
    """Matching packets with all their layers, in export order: (ts, session_id, packet_id)."""
    out = store.table("packets").join(matching(store, text, scope).select(*KEYS), list(KEYS), "left_semi")
    for name, comp in COMPONENTS.items():
        fields = [c.name for c in comp.columns]
        items = F.array_sort(F.collect_list(F.struct("layer_index", F.struct(*fields).alias("v")))).alias(name)
        side = store.table(name).groupBy(*KEYS).agg(items)
        out = out.join(side, list(KEYS), "left")
    return out.orderBy(*ORDER)


def export_frames(store: Store, text: str = "", scope: Scope = Scope()) -> DataFrame:
    """(session_id, packet_id, ts, orig_len, components, frame, error) of matching packets, in no order.

    Every table's rows become header bytes, and one shuffle by packet brings all of them together: the last written of each layer counts,
    and the layers in order give the frame. A packet that can't be rebuilt has no frame and says why. Only a filter or time bounds cost a semi join.
    """
    whole = not text.strip() and scope.start is None and scope.end is None
    keys = None if whole else matching(store, text, scope).select(*KEYS)
    head_type = "struct<ts:bigint,incl_len:bigint,trunc_extra:bigint,components:bigint>"

    def side(name: str) -> DataFrame:
        rows = store.versions(name)
        rows = scoped(rows, scope) if name == "packets" else rows.where(in_sessions(scope.sessions)) if scope.sessions else rows
        return rows if keys is None else rows.join(keys, list(KEYS), "left_semi")

    def items(name: str, at, mask: int, data: Column, head: Column) -> DataFrame:
        older = (-F.col("_ingest_seq")).alias("older")
        return side(name).select(*KEYS, F.struct(at.cast("int").alias("layer_index"), F.lit(mask).cast("long").alias("mask"), older, data.alias("bytes"), head.cast(head_type).alias("head")).alias("_item"))

    rows = items("packets", F.lit(-1), 0, F.col("payload"), F.struct("ts", "incl_len", "trunc_extra", "components"))
    for name, comp in COMPONENTS.items():
        rows = rows.unionByName(items(name, F.col("layer_index"), comp.mask, codec.header(name, F.col), F.lit(None)))
    each = rows.repartition(*KEYS).groupBy(*KEYS).agg(F.array_sort(F.collect_list("_item")).alias("_all"))

    def last(x: Column, i: Column) -> Column:
        before = F.get("_all", i - 1)
        return (i == 0) | (before["layer_index"] != x["layer_index"]) | (before["mask"] != x["mask"])

    each = each.select(*KEYS, F.filter("_all", last).alias("_all")).where(F.get("_all", F.lit(0))["layer_index"] == -1)
    each = each.select(*KEYS, F.get("_all", F.lit(0)).alias("_p"), F.slice("_all", F.lit(2), F.size("_all")).alias("_layers"))
    head = F.col("_p")["head"]
    frame, error = codec.joined_frame(F.col("_layers"), F.col("_p")["bytes"], head["components"], head["incl_len"])
    return each.select(*KEYS, head["ts"].alias("ts"), (head["incl_len"] + head["trunc_extra"]).alias("orig_len"), head["components"].alias("components"), frame.alias("frame"), error.alias("error"))


def merge_order(store: Store, text: str = "", scope: Scope = Scope()) -> DataFrame:
    """(n, ts, session_id, packet_id) of all matching packets: their places from 1 in export order, over all captures.

    One range sort; a row's place is its place in its sorted partition and the sizes of the partitions before it. The sorted keys are written
    to the checkpoint folder first, so that sizes and places come from the same partitions.
    """
    # the upper bits of the number are the partition, the lower 33 the place in it
    rows = files.checkpointed(matching(store, text, scope).orderBy(*ORDER).withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.select("ts", *KEYS, F.shiftright("_at", 33).cast("int").alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place"))
    before, total = [], 0
    for part, size in sorted(rows.groupBy("_part").count().collect()):  # one row for each partition
        before.append((part, total))
        total += size
    offsets = store.spark.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").select((F.col("_before") + F.col("_place") + 1).alias("n"), *ORDER)


def export_meta(captures: DataFrame) -> DataFrame:
    """The header of a capture made of several: largest snap length (65535 at least), the link type if all agree, else Ethernet."""
    types = F.collect_set("linktype")  # a handful of link types exist
    return captures.agg(F.greatest(F.coalesce(F.max("snaplen"), F.lit(0)), F.lit(65535)).cast("long").alias("snaplen"), F.when(F.size(types) == 1, F.get(types, F.lit(0))).otherwise(1).cast("long").alias("linktype")).select(F.lit("le").alias("endianness"), F.lit("us").alias("time_res"), "snaplen", "linktype")


def missing_components(store: Store) -> DataFrame:
    """(session_id, packet_id, component) where the presence bit and the component's table disagree."""
    out = None
    for name, comp in COMPONENTS.items():
        p = store.table("packets").select(*KEYS, (F.col("components").bitwiseAND(comp.mask) != 0).alias("said"))
        t = store.table(name).select(*KEYS).distinct().withColumn("found", F.lit(True))
        both = p.join(t, list(KEYS), "full").where(F.coalesce("said", F.lit(False)) != F.coalesce("found", F.lit(False)))
        part = both.select(*KEYS, F.lit(name).alias("component"))
        out = part if out is None else out.unionByName(part)
    return out


def reencode_candidates(packets: DataFrame) -> DataFrame:
    """Packets without any decoded layer from 4 up."""
    return packets.where(F.col("components").bitwiseAND(UPPER_LAYERS) == 0).select(*KEYS).orderBy(*KEYS)


def parse_ratio(packets: DataFrame) -> DataFrame:
    """All packets, and those with bytes that no layer took."""
    return packets.agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.octet_length("payload") > 0).alias("with_tail"))


def inter_arrival(packets: DataFrame) -> DataFrame:
    """Nanoseconds since the previous packet of the session. Windows hold a minute of a session; a minute's first packet looks up the last time before it."""
    rows = packets.select("session_id", "packet_id", "ts", F.floor(F.col("ts") / F.lit(GAP_BUCKET)).alias("_cut"))
    last = rows.groupBy("session_id", "_cut").agg(F.max("ts").alias("_last"))
    last = last.select("session_id", "_cut", F.lag("_last").over(Window.partitionBy("session_id").orderBy("_cut")).alias("_before"))
    inside = F.lag("ts").over(Window.partitionBy("session_id", "_cut").orderBy(*ORDER))
    return rows.withColumn("_prev", inside).join(last, ["session_id", "_cut"]).select("session_id", "packet_id", (F.col("ts") - F.coalesce("_prev", "_before")).alias("gap_ns"))


def share_of_total(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sums by a column, and their share of the whole."""
    sums = df.groupBy(by).agg(F.sum(value).alias("total"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()))


def limit_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")
