"""Captures into a store, and out of it again."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import session_id
from ..plans.search import ORDER, Scope
from ..plans.store import ParquetStore
from ..registry import COMPONENTS, HTTP_COLUMNS, KEYS, STREAM_COLUMNS, UPPER_LAYERS, in_sessions
from ..sources import pcap
from . import codec, files, flows, reassembly, retention

#: Tables that are written at the same time.
WRITERS = 4
log = logging.getLogger(__name__)


@dataclass
class Ingested:
    captures: int
    packets: int
    streams: int


def retry(act: Callable, tries: int = 5, first: float = 0.5, most: float = 30.0, factor: float = 2.0):
    """Call until it succeeds; waits grow by the factor and vary by half, so that writers don't meet again. Errors of the plan or of its arguments go up at once.

    Spark repeats lost tasks itself: this is for a driver's commit.
    """
    wait = first
    for left in range(tries - 1, -1, -1):
        try:
            return act()
        except (AnalysisException, TypeError, KeyError):
            raise
        except Exception:  # the last try's error goes up
            if not left:
                raise
            log.warning("trying again in about %.1f s", wait, exc_info=True)
            time.sleep(wait * random.uniform(0.5, 1.5))
            wait = min(most, wait * factor)


def next_seq(store: ParquetStore) -> int:
    """A sequence number above all that were used, by any writer; a small ledger keeps them. Nanoseconds of the clock keep writers at the same time apart."""
    path = f"{store.root}/_seq"
    used = (store.spark.read.schema("seq long").parquet(path).agg(F.max("seq")).first()[0] or 0) if files.exists(store.spark, path) else 0
    seq = max(used + 1, time.time_ns())
    store.spark.createDataFrame([(seq,)], "seq long").write.mode("append").parquet(path)
    return seq


def ingest(store: ParquetStore, found: DataFrame, sensor: str = "", with_streams: bool = True, most_bytes: int | None = None, seq: int | None = None) -> Ingested:
    """Rows of binaryFile (path, content) into the store.

    Frames are dissected once, into a staged table from which every table is written. All keys follow from the files, so the same file again gives the same
    rows under a higher sequence number, of which readers keep the last. A failure in between leaves rows without harm; the next run completes them.
    """
    spark = store.spark
    if most_bytes is not None:
        retention.enforce(store, most_bytes)
    seq = seq if seq is not None else next_seq(store)
    stage = f"{store.root}/_stage/{seq}"
    meta = pcap.captures(found, sensor).drop("path")
    frames = pcap.read_frames(found)
    codec.dissect_frames(frames.withColumn("linktype", F.col("linktype").cast("long"))).write.mode("overwrite").parquet(f"{stage}/packets")
    packets = spark.read.schema(codec.DISSECTED).parquet(f"{stage}/packets")
    present = packets.agg(F.count(F.lit(1)).alias("n"), F.bit_or("components").alias("bits")).first()
    parts = {n: codec.component_rows(packets, n) for n, c in COMPONENTS.items() if (present.bits or 0) & c.mask}
    parts["packets"] = packets.select("session_id", "packet_id", "ts", "incl_len", "trunc_extra", "components", "payload")
    acts = [lambda: retry(lambda: store.append("captures", meta, seq))]
    acts += [lambda n=n, rows=rows: retry(lambda: store.append(n, rows, seq)) for n, rows in parts.items()]
    if with_streams and (present.bits or 0) & COMPONENTS["tcp"].mask:
        acts.append(lambda: write_streams(store, tcp_of(packets), seq))
    else:
        acts.append(lambda: 0)
    # the tables' jobs share the executors: one's tail doesn't leave them idle
    with ThreadPoolExecutor(WRITERS) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(a)) for a in acts]
    streams = [d.result() for d in done][-1]  # any writer's error goes up
    n = store.versions("captures").where(F.col("_ingest_seq") == seq).count()
    files.delete(spark, stage)
    return Ingested(n, present.n, streams)


def tcp_of(packets: DataFrame) -> DataFrame:
    """TCP packets of dissected rows with addresses, ports, flags and the payload that the IP length covers (padding isn't payload)."""
    from ..functions.address import ip6_of_ip4

    p = packets.where(F.col("components").bitwiseAND(COMPONENTS["tcp"].mask) != 0)
    tcp, v4, v6 = (F.element_at(n, -1) if n == "tcp" else F.when(F.size(n) > 0, F.element_at(n, -1)) for n in ("tcp", "ipv4", "ipv6"))
    room = F.coalesce(v4["total_len"] - v4["ihl"] * 4, v6["payload_len"]) - tcp["data_offset"] * 4
    size = F.greatest(F.lit(0), F.least(F.octet_length("payload"), F.when(room > 0, room).otherwise(0)))
    return p.select(*KEYS, F.coalesce(ip6_of_ip4(v4["src"]), v6["src"]).alias("src_ip"), F.coalesce(ip6_of_ip4(v4["dst"]), v6["dst"]).alias("dst_ip"), tcp["src"].alias("src_port"), tcp["dst"].alias("dst_port"), tcp["flags"].alias("flags"), F.substr("payload", F.lit(1), size).alias("payload")).where("src_ip is not null")


def write_streams(store: ParquetStore, tcp: DataFrame, seq: int) -> int:
    """The streams of TCP packets. These are written once with both ends in order, for they are read several times and derived from nested columns."""
    spark, stage = store.spark, f"{store.root}/_stage/{seq}-tcp"
    rows = flows.canonical(tcp)
    rows.write.mode("overwrite").parquet(stage)
    rows = spark.read.schema(rows.schema).parquet(stage)
    found = flows.streams(rows).persist()
    try:
        n = found.count()
        if n:
            store.append("stream_captures", found.select(*[c.name for c in STREAM_COLUMNS]), seq)
            store.append("stream_http", flows.http_streams(rows, found).select(*[c.name for c in HTTP_COLUMNS]), seq)
        return n
    finally:
        found.unpersist()
        files.delete(spark, stage)


def create_capture(store: ParquetStore, rows: DataFrame) -> int:
    """Add captures that aren't there yet; returns how many were."""
    new = rows.join(store.table("captures").select("session_id"), "session_id", "left_anti")
    n = new.count()
    if n:
        store.append("captures", new, next_seq(store))
    return n


def export(store: ParquetStore, path: str, text: str = "", scope: Scope = Scope()) -> int:
    """Matching packets as one capture file in the order of time, session and packet. One session keeps its own file header. ValueError where a packet can't be rebuilt."""
    rows = reassembly.export_frames(store, text, scope).orderBy(*ORDER)
    captures = store.table("captures")
    if scope.sessions:
        captures = captures.where(in_sessions(scope.sessions))
    head = captures.limit(2).collect()
    if len(head) == 1:
        c = head[0]
        meta = pcap.Meta(c.endianness, c.time_res, c.snaplen, c.linktype, bytes(c.global_header_raw or b""))
        return pcap.write_pcap(rows, path, meta, c.snaplen, c.linktype)
    made = reassembly.export_meta(captures).first()
    return pcap.write_pcap(rows, path, None, made.snaplen, made.linktype)


@dataclass
class Reencoded:
    candidates: int
    written: int
    upgraded: int


def reencode(store: ParquetStore, text: str = "", scope: Scope = Scope()) -> Reencoded:
    """Read packets without upper layers anew, and write those that gain some, under a higher sequence number. Packets that can't be rebuilt are left."""
    rows = reassembly.export_frames(store, text, scope).where(F.col("components").bitwiseAND(UPPER_LAYERS) == 0)
    frames = rows.drop("components").where("error IS NULL").join(store.table("captures").select("session_id", "linktype"), "session_id")
    seq = next_seq(store)
    stage = f"{store.root}/_stage/{seq}"
    codec.dissect_frames(frames).write.parquet(f"{stage}/packets")
    new = store.spark.read.schema(codec.DISSECTED).parquet(f"{stage}/packets")
    old = store.table("packets").select(*KEYS, F.col("components").alias("_old"))
    better = new.join(old, list(KEYS)).where(F.col("components").bitwiseAND(UPPER_LAYERS) != F.col("_old").bitwiseAND(UPPER_LAYERS)).drop("_old")
    counts = Reencoded(new.count(), 0, better.count())
    if counts.upgraded:
        for name in COMPONENTS:
            part = codec.component_rows(better, name)
            if not part.isEmpty():
                store.append(name, part, seq)
        store.append("packets", better.select("session_id", "packet_id", "ts", "incl_len", "trunc_extra", "components", "payload"), seq)
        counts.written = counts.upgraded
    files.delete(store.spark, stage)
    return counts


__all__ = ["Ingested", "Reencoded", "create_capture", "export", "ingest", "next_seq", "reencode", "retry", "session_id", "tcp_of", "write_streams"]
