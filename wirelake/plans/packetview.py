"""Packet tables made from the driver's tables, with the same expressions in Spark and in SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store

#: Expressions that mean the same in Spark SQL and DuckDB.
COMPONENT_BITS = "CASE event_type WHEN 'click' THEN 530 WHEN 'view' THEN 1042 WHEN 'purchase' THEN 546 WHEN 'error' THEN 3090 ELSE 8194 END + CASE WHEN event_id % 7 = 0 THEN 4 ELSE 0 END"
PORT = "CASE event_id % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53 ELSE 8080 END"
FLAGS = "CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 16 WHEN 3 THEN 24 ELSE 17 END"
KEY = "CAST(user_id % 8 AS BIGINT) AS session_id, event_id AS packet_id"
SRC4, DST4 = "CAST(167772160 + user_id AS BIGINT)", "CAST(167772160 + event_id % 97 AS BIGINT)"

#: Nanoseconds of a time without zone, whatever the session's zone.
NANOS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) * 1000"

#: name: (columns after the keys, condition)
PARTS = {
    "ethernet": (f"CASE WHEN event_type = 'purchase' THEN 34525 WHEN event_type = 'signup' THEN 2054 ELSE 2048 END AS type, CAST(length(props) + 14 AS INT) AS len", "true"),
    "ipv4": (f"CASE WHEN event_type = 'click' THEN 6 ELSE 17 END AS protocol, {SRC4} AS src, {DST4} AS dst, CAST(length(props) + 40 AS INT) AS total_len, CAST(32 + event_id % 64 AS INT) AS ttl", "event_type IN ('click', 'view', 'error')"),
    "tcp": (f"CAST(1024 + event_id % 5000 AS INT) AS src, {PORT} AS dst, {FLAGS} AS flags", "event_type IN ('click', 'purchase')"),
    "udp": (f"CAST(1024 + event_id % 5000 AS INT) AS src, {PORT} AS dst, CAST(length(props) + 8 AS INT) AS length", "event_type IN ('view', 'error')"),
    "dns": ("CAST(event_id % 2 AS INT) AS qr, CAST(event_id % 4 AS INT) AS rcode", "event_type = 'error'"),
    "arp": (f"CAST(1 + event_id % 2 AS INT) AS arp_op, {SRC4} AS sender_ip, {DST4} AS target_ip", "event_type = 'signup'"),
    "ipv6": ("CAST(32 + event_id % 64 AS INT) AS hop_limit, CAST(length(props) AS INT) AS payload_len", "event_type = 'purchase'"),
}
PACKETS = f"{KEY}, {{ts}} AS ts, CAST(length(props) AS BIGINT) AS incl_len, CAST(floor(value) AS BIGINT) % 3 AS trunc_extra, CAST({COMPONENT_BITS} AS BIGINT) AS components"
DOT1Q = f"{KEY}, l AS layer_index, CAST((event_id + l) % 100 AS INT) AS vlan_id, CAST(l AS INT) AS priority"
CAPTURES = "CAST(n_nationkey AS BIGINT) AS session_id, n_name AS sensor, CAST(65535 + n_nationkey AS BIGINT) AS snaplen, CAST(1 AS BIGINT) AS linktype"


def oracle_views() -> str:
    """WITH clauses for DuckDB: p, captures and a table for each component."""
    parts = [f"p AS (SELECT {PACKETS.format(ts='epoch_ns(ts)')} FROM events)"]
    parts += [f"{n} AS (SELECT {KEY}, 1 AS layer_index, {cols} FROM events WHERE {cond})" for n, (cols, cond) in PARTS.items()]
    parts.append(f"dot1q AS (SELECT {DOT1Q} FROM events, (SELECT unnest([1, 2]) AS l) WHERE event_id % 7 = 0)")
    parts.append(f"captures AS (SELECT {CAPTURES} FROM nation WHERE n_nationkey < 8)")
    return "WITH " + ", ".join(parts)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fill(df: DataFrame, name: str) -> DataFrame:
    """The columns of a store's table, in its types; what the view lacks is null."""
    from .store import table_schema

    fields = table_schema(name).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def store(spark: SparkSession, sf_dir: str) -> Store:
    events = read(spark, sf_dir, "events")
    tables = {"packets": _fill(events.selectExpr(*_cols(PACKETS.format(ts=NANOS))), "packets")}
    for name, (cols, cond) in PARTS.items():
        tables[name] = _fill(events.where(cond).selectExpr(*_cols(KEY), "1 AS layer_index", *_cols(cols)), name)
    dot1q = events.where("event_id % 7 = 0").withColumn("l", F.explode(F.array(F.lit(1), F.lit(2))))
    tables["dot1q"] = _fill(dot1q.selectExpr(*_cols(DOT1Q)), "dot1q")
    tables["captures"] = _fill(read(spark, sf_dir, "nation").where("n_nationkey < 8").selectExpr(*_cols(CAPTURES)), "captures")
    return Store(spark, tables)


def _cols(text: str) -> list[str]:
    """The expressions of a select list: commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


FLOW = "CAST(user_id % 8 AS BIGINT) AS session_id, event_id AS packet_id, CASE WHEN event_id % 2 = 0 THEN user_id % 10 ELSE 100 + user_id % 3 END AS src_n, CASE WHEN event_id % 2 = 0 THEN 100 + user_id % 3 ELSE user_id % 10 END AS dst_n, CASE WHEN event_id % 2 = 0 THEN 1024 + user_id % 4 ELSE 80 END AS src_port, CASE WHEN event_id % 2 = 0 THEN 80 ELSE 1024 + user_id % 4 END AS dst_port"


def flow_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP packets in a few flows of two directions; every first packet of a flow is a SYN, payloads alternate protocols."""
    from ..functions.address import ip6_of_ip4

    e = read(spark, sf_dir, "events").selectExpr(*_cols(FLOW), "props", "event_type", f"{FLAGS} AS flags")
    text = F.when(F.col("event_type") == "click", F.concat(F.lit("GET /"), F.col("props"), F.lit(" HTTP/1.1\r\nHost: h.example\r\n\r\n"))).when(F.col("event_type") == "view", F.lit("SSH-2.0")).otherwise(F.col("props"))
    return e.select("session_id", "packet_id", ip6_of_ip4(F.col("src_n").cast("long")).alias("src_ip"), ip6_of_ip4(F.col("dst_n").cast("long")).alias("dst_ip"), "src_port", "dst_port", "flags", text.cast("binary").alias("payload"), "src_n", "dst_n", "props")


#: Folders of captures that were made before, by tables' folder.
PREPARED: dict[str, str] = {}


def prepare_captures(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write the captures as rows of Parquet; the queries over captures then read them."""
    capture_files(spark, sf_dir).write.mode("overwrite").parquet(folder)
    PREPARED[sf_dir] = folder


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (path, content) as of binaryFile: one classic capture for each range of events, with real frames of five kinds."""
    if sf_dir in PREPARED:
        return spark.read.schema("path string, content binary").parquet(PREPARED[sf_dir])
    import struct

    import pyarrow as pa

    from ..sources import pcap

    mac = bytes.fromhex("001122334455") + bytes.fromhex("66778899aabb")

    def frame(user: int, event: int, kind: str, props: bytes) -> bytes:
        src, dst, sport, dport = 0x0A000000 + user, 0x0A000000 + event % 97, 1024 + event % 5000, (80, 443, 22, 7000, 8080)[event % 5]
        tcp = struct.pack(">HHIIHHHH", sport, dport, event, 0, 5 << 12 | 24, 512, 0, 0) + props
        udp = lambda p, d: struct.pack(">HHHH", sport, d, 8 + len(p), 0) + p
        ip4 = lambda p, proto: mac + b"\x08\0" + struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(p), event & 0xFFFF, 0, 64, proto, 0, src, dst) + p
        if kind == "click":
            return ip4(tcp, 6)
        if kind == "view":
            return ip4(udp(props, dport), 17)
        if kind == "purchase":
            return mac + b"\x86\xdd" + struct.pack(">IHBB", 6 << 28, len(tcp), 6, 64) + bytes(12) + struct.pack(">I", src) + bytes(12) + struct.pack(">I", dst) + tcp
        if kind == "error":
            return ip4(udp(struct.pack(">HHHHHH", event & 0xFFFF, 0x0100, 1, 0, 0, 0) + b"\x01a\x02bc\0" + struct.pack(">HH", 1, 1), 53), 17)
        return mac + b"\x08\x06" + struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + mac[:6] + struct.pack(">I", src) + mac[6:] + struct.pack(">I", dst)

    def run(batches):
        for b in batches:
            out, first = [pcap.header_bytes()], None
            for r in b.to_pylist():
                data = frame(r["user_id"], r["event_id"], r["event_type"], r["props"].encode())
                out.append(pcap.record_bytes(r["ts"], data, len(data) + r["event_id"] % 3))
                first = r["event_id"] if first is None else first
            if first is not None:
                yield pa.record_batch([pa.array([f"events-{first}.pcap"]), pa.array([b"".join(out)], pa.binary())], names=["path", "content"])

    rows = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props", F.expr(NANOS).alias("ts"))
    parts = max(1, spark.sparkContext.defaultParallelism)
    return rows.repartitionByRange(parts, "event_id").sortWithinPartitions("event_id").mapInArrow(run, "path string, content binary")
