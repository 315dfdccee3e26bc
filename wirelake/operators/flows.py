"""TCP flows: both directions under one key, handshake, size, application protocol. Without Python on the executors but for HTTP lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import address as A
from ..plans.search import clamp_streams
from ..plans.store import Store
from ..registry import KEYS, in_sessions

TCP, FIN, SYN, ACK = 6, 1, 2, 16
#: Starts of HTTP messages. Fixed values.
HTTP_STARTS = ("GET ", "POST", "HEAD", "PUT ", "DELETE ", "OPTIONS ", "PATCH ", "HTTP/")
PREFIX = 8
FLOW = ["session_id", "lo_ip", "hi_ip", "lo_port", "hi_port"]


def detect(first: Column) -> Column:
    """tls, ssh, http or null, by the first bytes of a flow. Tried in this order."""
    text = first.cast("string")
    tls = (F.octet_length(first) >= 3) & (F.substring(first, 1, 2) == F.unhex(F.lit("1603")))
    http = F.lit(False)
    for start in HTTP_STARTS:
        http = http | (F.substring(first, 1, len(start)) == F.lit(start).cast("binary"))
    return F.when(tls, "tls").when(text.startswith("SSH-"), "ssh").when(http, "http")


def detect_bytes(data: bytes) -> str | None:
    if len(data) >= 3 and data[:2] == b"\x16\x03":
        return "tls"
    if data.startswith(b"SSH-"):
        return "ssh"
    return "http" if data.startswith(tuple(s.encode() for s in HTTP_STARTS)) else None


def http_session(payloads: list[bytes]) -> tuple[str, str, str] | None:
    """(method, host, path) from a flow's payloads: the first request line and the first Host header after it, wherever the packets were cut."""
    method = path = host = ""
    for line in b"".join(payloads).decode("latin-1").split("\n"):
        line = line.rstrip("\r")
        if not method:
            parts = line.split(" ", 2)
            if len(parts) >= 2 and parts[0]:
                method, path = parts[0], parts[1]
        elif re.match("host:", line, re.I):
            host = line[5:].strip()
            break
        elif not line:
            break
    return (method, host, path) if method else None


def canonical(df: DataFrame) -> DataFrame:
    """Rows with src_ip, dst_ip, src_port, dst_port get lo_ip, hi_ip, lo_port, hi_port, equal for both directions; rows that have them stay."""
    if "lo_ip" in df.columns:
        return df
    forward = (F.col("src_ip") < F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") <= F.col("dst_port")))
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return df.withColumns({"lo_ip": pick("src_ip", "dst_ip"), "hi_ip": pick("dst_ip", "src_ip"), "lo_port": pick("src_port", "dst_port"), "hi_port": pick("dst_port", "src_port")})


def tcp_packets(store: Store) -> DataFrame:
    """TCP packets with 16-byte addresses, ports, flags and payload, from the tables."""
    p, t = store.table("packets"), store.table("tcp").select(*KEYS, F.col("src").alias("src_port"), F.col("dst").alias("dst_port"), "flags")
    v4 = store.table("ipv4").select(*KEYS, A.ip6_of_ip4(F.col("src")).alias("s4"), A.ip6_of_ip4(F.col("dst")).alias("d4"), F.col("total_len").alias("_len"), F.col("ihl").alias("_ihl"))
    v6 = store.table("ipv6").select(*KEYS, F.col("src").alias("s6"), F.col("dst").alias("d6"))
    both = p.select(*KEYS, "payload").join(t, list(KEYS)).join(v4, list(KEYS), "left").join(v6, list(KEYS), "left")
    return both.select(*KEYS, F.coalesce("s4", "s6").alias("src_ip"), F.coalesce("d4", "d6").alias("dst_ip"), "src_port", "dst_port", "flags", F.coalesce("payload", F.lit(b"")).alias("payload")).where("src_ip is not null")


def flow_aggregate(packets: DataFrame) -> DataFrame:
    """One row for each flow, without order: first and last packet, counts, bytes."""
    return canonical(packets).groupBy(*FLOW).agg(F.min("packet_id").alias("first_packet_id"), F.max("packet_id").alias("last_packet_id"), F.count(F.lit(1)).alias("packet_count"), F.sum(F.octet_length("payload")).cast("long").alias("byte_count"))


def streams(packets: DataFrame) -> DataFrame:
    """Flows with a whole handshake and a known protocol, as rows of stream_captures and the head of their payload.

    The first SYN without ACK gives the direction; a SYN with ACK after it completes the handshake. Detection needs the first bytes only, so
    each packet gives at most eight to the fold, and the flow's earliest packets with payload decide. The id is a hash of the flow and its first
    packet, the same for every run.
    """
    syn = (F.col("flags").bitwiseAND(SYN) != 0) & (F.col("flags").bitwiseAND(ACK) == 0)
    synack = (F.col("flags").bitwiseAND(SYN) != 0) & (F.col("flags").bitwiseAND(ACK) != 0)
    rows = canonical(packets).withColumn("_back", (F.col("src_ip") != F.col("lo_ip")) | (F.col("src_port") != F.col("lo_port")))
    # numbers only, so that flows are hashed and not sorted; the first SYN's lowest bit says which way it went
    each = rows.groupBy(*FLOW).agg(
        F.min("packet_id").alias("first_packet_id"), F.max("packet_id").alias("last_packet_id"), F.count(F.lit(1)).alias("packet_count"), F.sum(F.octet_length("payload")).cast("long").alias("byte_count"),
        F.min(F.when(syn, F.col("packet_id") * 2 + F.col("_back").cast("long"))).alias("syn"), F.max(F.when(synack, F.col("packet_id"))).alias("synack"),
    )
    each = each.where("syn is not null and synack > shiftright(syn, 1)")
    # the first PREFIX packets with payload hold the first PREFIX bytes: ranked per flow with a handshake, cut before anything is gathered
    rank = F.row_number().over(Window.partitionBy(*FLOW).orderBy("packet_id"))
    heads = rows.where(F.octet_length("payload") > 0).join(each.select(*FLOW), FLOW, "left_semi").withColumn("_rn", rank).where(F.col("_rn") <= PREFIX)
    joined = heads.groupBy(*FLOW).agg(F.array_sort(F.collect_list(F.struct("packet_id", F.substring("payload", 1, PREFIX).alias("b")))).alias("h"))
    head = joined.select(*FLOW, F.aggregate("h", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["b"])).alias("head"))
    out = each.join(head, FLOW).withColumn("l7_proto", detect(F.col("head"))).where("l7_proto is not null")
    back = F.col("syn").bitwiseAND(1) == 1
    end = lambda a, c: F.when(back, F.col(a)).otherwise(F.col(c))
    name = F.sha2(F.concat_ws("|", F.col("session_id").cast("string"), F.hex("lo_ip"), F.hex("hi_ip"), F.col("lo_port").cast("string"), F.col("hi_port").cast("string"), F.col("first_packet_id").cast("string")), 256)
    return out.select(
        "session_id", F.substring(name, 1, 32).alias("stream_id"), "l7_proto", F.lit(TCP).cast("short").alias("proto"), end("hi_ip", "lo_ip").alias("src_ip"), end("lo_ip", "hi_ip").alias("dst_ip"),
        end("hi_port", "lo_port").alias("src_port"), end("lo_port", "hi_port").alias("dst_port"), F.lit(True).alias("is_complete"), "first_packet_id", "last_packet_id", "packet_count", "byte_count",
        "lo_ip", "hi_ip", "lo_port", "hi_port",
    )


class HttpFold:
    """What a flow's payloads, fed in order, say: the first request line and the first Host that isn't empty. Holds one unfinished line at most, and no more of a line than can matter."""

    def __init__(self):
        self.method = self.path = self.host = ""
        self.first, self.line, self.size, self.skip, self.spaces = True, [], 0, False, 0

    @property
    def done(self) -> bool:
        return not self.first and bool(self.host)

    def feed(self, payload: bytes) -> None:
        *whole, rest = payload.split(b"\n")
        for part in whole:
            self._add(part)
            self.end()
            if self.done:
                return
        self._add(rest)

    def _add(self, part: bytes) -> None:
        if self.skip or not part:
            return
        self.line.append(part)
        self.size += len(part)
        if self.first:
            self.spaces += part.count(b" ")
            self.skip = self.spaces >= 2  # method and path are whole
        elif self.size >= 5:
            if len(self.line) > 1 and self.size - len(part) < 5:
                self.line = [b"".join(self.line)]
            if self.line[0][:5].lower() != b"host:":
                self.skip, self.line = True, []

    def end(self) -> None:
        """The line is over."""
        text = b"".join(self.line).decode("latin-1").rstrip("\r")
        if self.first:
            self.method, self.path = (*text.split(" ", 2), "")[:2]
            self.first = False
        elif not self.host and text[:5].lower() == "host:":
            self.host = text[5:].strip()
        self.line, self.size, self.skip = [], 0, False


def _fold_http(batches):
    """Payloads sorted by stream and packet to one row for each stream."""
    import pyarrow as pa

    now, fold = None, HttpFold()

    def row(rows):
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.decimal128(20, 0), pa.string(), pa.string(), pa.string(), pa.string()])], names=["session_id", "stream_id", "method", "host", "path"])

    def close():
        if not fold.done:
            fold.end()
        return (*now, fold.method, fold.host, fold.path)

    for batch in batches:
        out = []
        for session, stream, payload in zip(*(c for c in batch.columns), strict=True):
            key = (session.as_py(), stream.as_py())
            if key != now:
                if now is not None:
                    out.append(close())
                now, fold = key, HttpFold()
            if not fold.done:
                fold.feed(payload.as_py())
        if out:
            yield row(out)
    if now is not None:
        yield row([close()])


def http_streams(packets: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of stream_http: request line and Host of HTTP flows, folded over their payloads in order until both are found, however many packets that takes.

    Packets after a flow's first one that holds a whole Host line can't matter and are left out before the rows are dealt and sorted.
    """
    http = found.where("l7_proto = 'http'").select(*FLOW, "stream_id")
    rows = canonical(packets).where(F.octet_length("payload") > 0).join(http, FLOW).select(F.col("session_id").cast("decimal(20,0)").alias("session_id"), "stream_id", "packet_id", "payload")
    whole = F.decode("payload", "ISO-8859-1").rlike(r"(?i)\nhost:[^\n]*[!-~][^\n]*\n")
    last = rows.where(whole).groupBy("stream_id").agg(F.min("packet_id").alias("_last"))
    rows = rows.join(last, "stream_id", "left").where("_last is null or packet_id <= _last")
    sorted_ = rows.repartition("stream_id").sortWithinPartitions("stream_id", "packet_id").select("session_id", "stream_id", "payload")
    out = sorted_.mapInArrow(_fold_http, "session_id decimal(20,0), stream_id string, method string, host string, path string")
    return out.withColumn("session_id", F.col("session_id").cast(packets.schema["session_id"].dataType))


def _condition(sessions: tuple[int, ...], l7: str | None):
    out = F.lit(True)
    if sessions:
        out = out & in_sessions(sessions)
    return out & (F.col("l7_proto") == l7) if l7 else out


def _timed(store: Store, rows: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Streams whose first packet is in [start, end)."""
    if start is None and end is None:
        return rows
    p = store.table("packets").select("session_id", F.col("packet_id").alias("first_packet_id"), "ts")
    bounds = [F.col("ts") >= start] * (start is not None) + [F.col("ts") < end] * (end is not None)
    for b in bounds:
        p = p.where(b)
    return rows.join(p.drop("ts"), ["session_id", "first_packet_id"], "left_semi")


def all_streams(store: Store, sessions: tuple[int, ...] = (), l7: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Streams with their HTTP request, without order or limit."""
    rows = _timed(store, store.table("stream_captures").where(_condition(sessions, l7)), start, end)
    http = store.table("stream_http")
    out = rows.join(http, ["session_id", "stream_id"], "left")
    ip = lambda c: A.strip_mapped(A.ip6_text(F.col(c))).alias(c)
    return out.select("session_id", "stream_id", "l7_proto", ip("src_ip"), ip("dst_ip"), "src_port", "dst_port", "is_complete", "first_packet_id", "last_packet_id", "packet_count", "byte_count", *[F.coalesce(c, F.lit("")).alias(c) for c in ("method", "host", "path")])


def list_streams(store: Store, sessions: tuple[int, ...] = (), l7: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of streams with their HTTP request, newest first within a session."""
    return all_streams(store, sessions, l7, start, end).orderBy(F.asc("session_id"), F.desc("first_packet_id")).offset(offset).limit(clamp_streams(limit))


def count_streams(store: Store, sessions: tuple[int, ...] = (), l7: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    return _timed(store, store.table("stream_captures").where(_condition(sessions, l7)), start, end).agg(F.count(F.lit(1)).alias("count"))
