"""A store of packet tables: one DataFrame for each table, read whole or from a folder of Parquet."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..registry import CAPTURE_COLUMNS, COMPONENTS, HTTP_COLUMNS, KEYS, PACKET_COLUMNS, STREAM_COLUMNS, schema_of

#: The columns that make a row of a table itself; of rows with equal keys the last written counts.
TABLE_KEYS = {"packets": KEYS, "captures": ("session_id",), "stream_captures": ("session_id", "stream_id"), "stream_http": ("session_id", "stream_id")} | {n: (*KEYS, "layer_index") for n in COMPONENTS}


def day_of(ts: Column) -> Column:
    """The UTC day of nanoseconds since 1970."""
    return F.date_from_unix_date(F.floor(ts / F.lit(86_400_000_000_000)).cast("int"))


def table_schema(name: str):
    special = {"packets": PACKET_COLUMNS, "captures": CAPTURE_COLUMNS, "stream_captures": STREAM_COLUMNS, "stream_http": HTTP_COLUMNS}
    return schema_of(special[name]) if name in special else COMPONENTS[name].schema


def last_written(df: DataFrame, keys: Iterable[str], seq: str = "_ingest_seq") -> DataFrame:
    """Of rows with equal keys the one with the largest seq."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", seq)


@dataclass
class Store:
    """Tables by name: packets, captures, components, stream_captures, stream_http. Missing ones are empty."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        if name not in TABLE_KEYS:
            raise KeyError(name)
        if name not in self.tables:
            # a relation that the optimizer knows to be empty, so joins with it fold away
            none = self.spark.range(1).limit(0)
            self.tables[name] = none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in table_schema(name).fields])
        return self.tables[name]

    def versions(self, name: str) -> DataFrame:
        """All written rows with their sequence number, before the last written are chosen."""
        return self.table(name).withColumn("_ingest_seq", F.lit(0).cast("long"))

    def register(self) -> None:
        """Temporary views for free SQL: packets, captures, streams and each component."""
        for name in TABLE_KEYS:
            self.table(name).createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        self.register()
        return self.spark.sql(text)

    def sessions(self) -> DataFrame:
        return self.table("captures").dropDuplicates(["session_id"]).orderBy("session_id")


class ParquetStore(Store):
    """Tables in one folder each; packets by day. Rows carry _ingest_seq, and reading keeps the last written of equal keys.

    Packets hold the partition column day, which readers give as a bound beside ts so that other days aren't listed.
    """

    def __init__(self, spark: SparkSession, root: str, compacted: bool = False):
        super().__init__(spark)
        self.root, self.compacted = root.rstrip("/"), compacted

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(path) and any(s.isDirectory() or s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path))

    def raw(self, name: str) -> DataFrame:
        schema = table_schema(name).add("_ingest_seq", "long")
        if name == "packets":
            schema = schema.add("day", "date")
        return self.spark.read.schema(schema).parquet(self.path(name))

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            if not self.exists(name):
                return super().table(name)
            raw = self.raw(name)
            # a packet's ts never changes: as part of the key it lets bounds on day and ts through the window, down to the scan
            keys = (*KEYS, "day", "ts") if name == "packets" else TABLE_KEYS[name]
            self.tables[name] = raw.drop("_ingest_seq") if self.compacted else last_written(raw, keys)
        return self.tables[name]

    def versions(self, name: str) -> DataFrame:
        return self.raw(name) if self.exists(name) else super().versions(name)

    def refresh(self) -> None:
        self.tables.clear()

    def append(self, name: str, df: DataFrame, seq: int) -> None:
        """Write rows under a sequence number, sorted by key so that row groups have narrow ranges."""
        out = df.select(*[F.col(c).cast(t.dataType) for c, t in zip(table_schema(name).names, table_schema(name).fields, strict=True)]).withColumn("_ingest_seq", F.lit(seq).cast("long"))
        if name == "packets":
            out = out.withColumn("day", day_of(F.col("ts"))).repartition("day", "session_id").sortWithinPartitions("day", "ts", "session_id", "packet_id")
            out.write.mode("append").partitionBy("day").parquet(self.path(name))
        else:
            bloom = {"parquet.bloom.filter.enabled#src": "true", "parquet.bloom.filter.enabled#dst": "true"} if name in ("tcp", "udp", "ipv4") else {}
            out.sortWithinPartitions(*TABLE_KEYS[name]).write.mode("append").options(**bloom).parquet(self.path(name))
        self.refresh()

    def compact(self, name: str) -> None:
        """Rewrite a table with one row for each key."""
        if self.exists(name):
            from ..operators.files import replace_folder

            keys = TABLE_KEYS[name]
            raw = self.raw(name)
            newest = Window.partitionBy(*keys).orderBy(F.desc("_ingest_seq"))
            once = raw.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
            replace_folder(once, self.path(name), ["day"] if name == "packets" else [])
            self.refresh()


def wide(store: Store) -> DataFrame:
    """Packets with one nullable struct for each single component and one array of structs, by layer, for each repeatable one."""
    out = store.table("packets")
    for name, comp in COMPONENTS.items():
        t = store.table(name)
        fields = [c.name for c in comp.columns]
        if comp.repeatable:
            item = F.struct("layer_index", *fields)
            side = t.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias(name))
        else:
            first = Window.partitionBy(*KEYS).orderBy("layer_index")
            side = t.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select(*KEYS, F.struct(*fields).alias(name))
        out = out.join(side, list(KEYS), "left")
    return out
