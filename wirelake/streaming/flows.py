"""Flows and histograms over packets that stream in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.flows import ACK, FLOW, HTTP_STARTS, SYN, canonical, detect_bytes

RESULT = "session_id decimal(20,0), lo_ip binary, hi_ip binary, lo_port int, hi_port int, l7_proto string, src_ip binary, dst_ip binary, src_port int, dst_port int, first_packet_id long, last_packet_id long, packet_count long, byte_count long"
STATE = "first long, last long, packets long, bytes long, syn long, synack long, src_ip binary, dst_ip binary, src_port int, dst_port int, head binary"
HEAD = max(len(s) for s in HTTP_STARTS)


def _flow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        first, last, packets, size, syn, synack, src, dst, sport, dport, head = state.get
        state.remove()
        proto = detect_bytes(bytes(head or b""))
        if syn >= 0 and synack > syn and proto:
            row = (*key, proto, src, dst, sport, dport, first, last, packets, size)
            yield pd.DataFrame([row], columns=[c.split()[0] for c in RESULT.replace("(20,0)", "").split(", ")])
        return
    first, last, packets, size, syn, synack, src, dst, sport, dport, head = state.get if state.exists else (-1, -1, 0, 0, -1, -1, None, None, 0, 0, b"")
    rows = pd.concat(list(batches)).sort_values("packet_id")
    newest = None
    for r in rows.itertuples(index=False):
        data = bytes(r.payload or b"")
        first, last = (r.packet_id if first < 0 else min(first, r.packet_id)), max(last, r.packet_id)
        packets, size = packets + 1, size + len(data)
        if r.flags & SYN and not r.flags & ACK and syn < 0:
            syn, src, dst, sport, dport = r.packet_id, bytes(r.src_ip), bytes(r.dst_ip), r.src_port, r.dst_port
        elif r.flags & SYN and r.flags & ACK and syn >= 0 and synack < 0:
            synack = r.packet_id
        if len(head) < HEAD:
            head = bytes(head) + data[: HEAD - len(head)]
        newest = r.event_time if newest is None else max(newest, r.event_time)
    state.update((int(first), int(last), int(packets), int(size), int(syn), int(synack), src, dst, int(sport), int(dport), bytes(head)))
    wait = int(newest.timestamp() * 1000)
    state.setTimeoutTimestamp(max(wait, state.getCurrentWatermarkMs()) + _flow.idle_ms)  # type: ignore[attr-defined]


def track_flows(packets: DataFrame, late: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """Streaming TCP packets (session_id, packet_id, ts, src_ip, dst_ip, src_port, dst_port, flags, payload) to finished flows.

    A flow is finished when the watermark has passed its newest packet by idle_ms: then it is given out if it had a handshake and a known protocol, and
    forgotten, so state is bounded by the flows that are active. Packets later than the watermark are dropped.
    """

    def fold(key, batches, state):
        _flow.idle_ms = idle_ms  # type: ignore[attr-defined]
        yield from _flow(key, batches, state)

    timed = canonical(packets).withColumn("event_time", F.timestamp_micros((F.col("ts") / 1000).cast("long"))).withWatermark("event_time", late)
    return timed.groupBy(*FLOW).applyInPandasWithState(fold, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rolling_histogram(packets: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Packets and bytes for each window of a stream, given out when the watermark has passed it."""
    timed = packets.withColumn("event_time", F.timestamp_micros((F.col("ts") / 1000).cast("long"))).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width)).agg(F.count(F.lit(1)).alias("count"), F.sum("incl_len").alias("bytes")).select(F.col("window.start").alias("start"), "count", "bytes")
