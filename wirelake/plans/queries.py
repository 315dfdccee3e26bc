"""The engine's queries over the driver's tables, each through the engine's own operators, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..operators import flows, geoip, reassembly
from ..registry import COMPONENTS, KEYS
from . import packetview as V
from . import search as S
from .search import Cursor, Scope
from .store import day_of, last_written, wide

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR, MINUTE = 3_600_000_000_000, 60_000_000_000
#: 2024-01-05 and 2024-01-12, in nanoseconds.
T0, T1 = 1704412800000000000, 1705017600000000000


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name; sql is DuckDB's, with the packet view's clauses before it."""

    def take(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (V.oracle_views() + " " if views else "") + sql
        return f

    return take


def plain(df: DataFrame) -> DataFrame:
    """Wide decimals as BIGINT: the views' session ids are small."""
    return df.select(*[(F.col(f.name).cast("long") if f.dataType.simpleString().startswith("decimal") else F.col(f.name)).alias(f.name) for f in df.schema])


def _match(text: str, **kw) -> Query:
    return lambda spark, d: plain(S.matching(V.store(spark, d), text, **kw))


IDS = "SELECT DISTINCT p.ts, p.session_id, p.packet_id FROM p"
J = "JOIN {0} ON p.session_id = {0}.session_id AND p.packet_id = {0}.packet_id"

_FILTERS: dict[str, tuple[str, str]] = {
    "filter_empty": ("", IDS),
    "filter_alias_eq": ("tcp.port = 443", f"{IDS} {J.format('tcp')} WHERE tcp.src = 443 OR tcp.dst = 443"),
    "filter_alias_ne": ("ipv4.addr != '10.0.0.1'", f"{IDS} {J.format('ipv4')} WHERE ipv4.src <> 167772161 AND ipv4.dst <> 167772161"),
    "filter_alias_between": ("udp.port BETWEEN 50 AND 90", f"{IDS} {J.format('udp')} WHERE udp.src BETWEEN 50 AND 90 OR udp.dst BETWEEN 50 AND 90"),
    "filter_alias_in": ("ipv4.addr in ('10.0.0.5', '10.0.0.7')", f"{IDS} {J.format('ipv4')} WHERE ipv4.src IN (167772165, 167772167) OR ipv4.dst IN (167772165, 167772167)"),
    "filter_alias_not_in": ("tcp.port not in (80, 443)", f"{IDS} {J.format('tcp')} WHERE tcp.src NOT IN (80, 443) AND tcp.dst NOT IN (80, 443)"),
    "filter_alias_greater": ("tcp.port > 5000", f"{IDS} {J.format('tcp')} WHERE tcp.src > 5000 OR tcp.dst > 5000"),
    "filter_alias_func": ("startsWith(ipv4.addr, '10.0.0.9')", f"{IDS} {J.format('ipv4')} WHERE ('10.0.' || ((ipv4.src >> 8) & 255) || '.' || (ipv4.src & 255)) LIKE '10.0.0.9%' OR ('10.0.' || ((ipv4.dst >> 8) & 255) || '.' || (ipv4.dst & 255)) LIKE '10.0.0.9%'"),
    "filter_cidr": ("isIPAddressInRange(ipv4.src, '10.0.0.64/26')", f"{IDS} {J.format('ipv4')} WHERE ipv4.src BETWEEN 167772224 AND 167772287"),
    "filter_arp_alias": ("arp.ip = '10.0.0.20'", f"{IDS} {J.format('arp')} WHERE arp.sender_ip = 167772180 OR arp.target_ip = 167772180"),
    "filter_bare_bitmask": ("dns", f"{IDS} WHERE (p.components & 2048) <> 0"),
    "filter_bare_or": ("arp or ipv6", f"{IDS} WHERE (p.components & 8192) <> 0 OR (p.components & 32) <> 0"),
    "filter_bare_and_not": ("udp and not dns", f"{IDS} WHERE (p.components & 1024) <> 0 AND NOT (p.components & 2048) <> 0"),
    "filter_component_join": ("ipv4.ttl < 40 and tcp.flags = 2", f"{IDS} {J.format('ipv4')} {J.format('tcp')} WHERE ipv4.ttl < 40 AND tcp.flags = 2"),
    "filter_capture_sensor": ("capture.sensor = 'NATION_2' and tcp", f"{IDS} JOIN captures ON p.session_id = captures.session_id WHERE captures.sensor = 'NATION_2' AND (p.components & 512) <> 0"),
    "filter_packet_field": ("packet.incl_len > 8 and p.trunc_extra = 1", f"{IDS} WHERE p.incl_len > 8 AND p.trunc_extra = 1"),
    "filter_boolean_combo": ("(dns.qr = 1 or udp.dst = 53) and not (ipv4.ttl between 40 and 80) and packet.packet_id % 3 != 0", f"{IDS} {J.format('dns')} {J.format('udp')} {J.format('ipv4')} WHERE (dns.qr = 1 OR udp.dst = 53) AND NOT (ipv4.ttl BETWEEN 40 AND 80) AND p.packet_id % 3 <> 0"),
    "filter_repeatable": ("dot1q.vlan_id < 30", f"{IDS} {J.format('dot1q')} WHERE dot1q.vlan_id < 30"),
}
for _name, (_text, _sql) in _FILTERS.items():
    QUERIES[_name] = _match(_text)
    ORACLES[_name] = f"{V.oracle_views()} {_sql}"

QUERIES["filter_sessions"] = _match("tcp", scope=Scope(sessions=(1, 3, 5)))
ORACLES["filter_sessions"] = f"{V.oracle_views()} {IDS} WHERE (p.components & 512) <> 0 AND p.session_id IN (1, 3, 5)"
QUERIES["filter_time_range"] = _match("udp", scope=Scope(start=T0, end=T1))
ORACLES["filter_time_range"] = f"{V.oracle_views()} {IDS} WHERE (p.components & 1024) <> 0 AND p.ts BETWEEN {T0} AND {T1}"
QUERIES["filter_presence_mode"] = _match("ipv6.hop_limit < 40 or ipv4.ttl < 40", mode="presence")
ORACLES["filter_presence_mode"] = f"{V.oracle_views()} {IDS} LEFT {J.format('ipv4')} LEFT {J.format('ipv6')} WHERE ipv6.hop_limit < 40 OR ipv4.ttl < 40"


def _hist(**kw) -> Query:
    return lambda spark, d: S.histogram(V.store(spark, d), **kw)


_BIN = "(p.ts + {tz}) // {w} * {w} - {tz} AS bin"
QUERIES["hist_bins"] = _hist(width=HOUR)
ORACLES["hist_bins"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=0, w=HOUR)}, count(*) AS count FROM p GROUP BY 1"
QUERIES["hist_bins_tz"] = _hist(text="tcp", width=24 * HOUR, tz=19_800_000_000_000)
ORACLES["hist_bins_tz"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=19_800_000_000_000, w=24 * HOUR)}, count(*) AS count FROM p WHERE (p.components & 512) <> 0 GROUP BY 1"
QUERIES["hist_breakdown"] = _hist(width=24 * HOUR, breakdown="tcp.dst")
ORACLES["hist_breakdown"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=0, w=24 * HOUR)}, CAST(tcp.dst AS VARCHAR) AS breakdown_value, count(*) AS count FROM p {J.format('tcp')} GROUP BY 1, 2"
QUERIES["hist_breakdown_multi"] = _hist(width=24 * HOUR, breakdown="ipv4.protocol, udp.dst")
ORACLES["hist_breakdown_multi"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=0, w=24 * HOUR)}, ipv4.protocol || ' / ' || udp.dst AS breakdown_value, count(*) AS count FROM p {J.format('ipv4')} {J.format('udp')} GROUP BY 1, 2"
QUERIES["hist_breakdown_alias"] = _hist(width=24 * HOUR, breakdown="ipv4.addr")
ORACLES["hist_breakdown_alias"] = f"{V.oracle_views()} SELECT bin, '10.0.' || ((a >> 8) & 255) || '.' || (a & 255) AS breakdown_value, count(*) AS count FROM (SELECT {_BIN.format(tz=0, w=24 * HOUR)}, unnest([ipv4.src, ipv4.dst]) AS a FROM p {J.format('ipv4')}) GROUP BY 1, 2"
QUERIES["hist_breakdown_proto"] = _hist(width=24 * HOUR, breakdown="proto")
_LABEL = "concat_ws('/', " + ", ".join(f"CASE WHEN (p.components & {c.mask}) <> 0 THEN '{n}' END" for n, c in COMPONENTS.items()) + ")"
ORACLES["hist_breakdown_proto"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=0, w=24 * HOUR)}, {_LABEL} AS breakdown_value, count(*) AS count FROM p GROUP BY 1, 2"
QUERIES["hist_exact"] = _hist(text="dot1q.priority > 0", width=24 * HOUR, exact=True)
ORACLES["hist_exact"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=0, w=24 * HOUR)}, count(*) AS count FROM p WHERE EXISTS (SELECT 1 FROM dot1q WHERE dot1q.session_id = p.session_id AND dot1q.packet_id = p.packet_id AND priority > 0) GROUP BY 1"
QUERIES["hist_joined_rows"] = _hist(text="dot1q.priority > 0", width=24 * HOUR)
ORACLES["hist_joined_rows"] = f"{V.oracle_views()} SELECT {_BIN.format(tz=0, w=24 * HOUR)}, count(*) AS count FROM p {J.format('dot1q')} WHERE priority > 0 GROUP BY 1"


def _page(text: str, limit: int, **kw) -> Query:
    return lambda spark, d: plain(S.page(V.store(spark, d), text, limit, **kw))


_ASC, _DESC = "ORDER BY p.ts, p.session_id, p.packet_id", "ORDER BY p.ts DESC, p.session_id DESC, p.packet_id DESC"
QUERIES["page_asc"] = _page("tcp.dst = 443", 50)
ORACLES["page_asc"] = f"{V.oracle_views()} {IDS} {J.format('tcp')} WHERE tcp.dst = 443 {_ASC} LIMIT 50"
QUERIES["page_desc"] = _page("tcp.dst = 443", 50, descending=True)
ORACLES["page_desc"] = f"{V.oracle_views()} {IDS} {J.format('tcp')} WHERE tcp.dst = 443 {_DESC} LIMIT 50"
QUERIES["page_offset"] = _page("udp", 40, offset=100)
ORACLES["page_offset"] = f"{V.oracle_views()} {IDS} WHERE (p.components & 1024) <> 0 {_ASC} LIMIT 40 OFFSET 100"
QUERIES["keyset_page2"] = _page("arp", 30, cursor=Cursor(T0, 3, 500))
ORACLES["keyset_page2"] = f"{V.oracle_views()} {IDS} WHERE (p.components & 8192) <> 0 AND (p.ts, p.session_id, p.packet_id) > ({T0}, 3, 500) {_ASC} LIMIT 30"

_HEAD = "p.session_id, p.packet_id, p.ts AS timestamp_ns, p.incl_len, p.incl_len + p.trunc_extra AS orig_len, p.components"
_TEXT4 = "'10.0.' || (({0} >> 8) & 255) || '.' || ({0} & 255)"


@query(f"SELECT {_HEAD}, tcp.src AS tcp_src, tcp.dst AS tcp_dst, tcp.flags AS tcp_flags, {_TEXT4.format('ipv4.src')} AS ipv4_src, ipv4.ttl AS ipv4_ttl FROM p {J.format('tcp')} {J.format('ipv4')} WHERE (tcp.src = 443 OR tcp.dst = 443) AND ipv4.src <> 167772161 AND ipv4.dst <> 167772161 {_DESC} LIMIT 50")
def search_projection(spark, d):
    out = S.search(V.store(spark, d), "tcp.port = 443 and ipv4.addr != '10.0.0.1'", ("ipv4", "tcp"), 50, descending=True)
    return plain(out.select("session_id", "packet_id", "timestamp_ns", "incl_len", "orig_len", "components", "tcp_src", "tcp_dst", "tcp_flags", "ipv4_src", "ipv4_ttl"))


@query(f"SELECT {_HEAD}, coalesce(tcp.dst, 0) AS tcp_dst, coalesce({_TEXT4.format('arp.sender_ip')}, '0.0.0.0') AS arp_sender_ip, coalesce(arp.arp_op, 0) AS arp_op FROM p LEFT {J.format('tcp')} LEFT {J.format('arp')} {_ASC} LIMIT 200")
def search_left_join_defaults(spark, d):
    out = S.search(V.store(spark, d), "", ("tcp", "arp"), 200)
    return plain(out.select("session_id", "packet_id", "timestamp_ns", "incl_len", "orig_len", "components", "tcp_dst", "arp_sender_ip", "arp_op"))


@query(f"SELECT {_HEAD}, coalesce(captures.sensor, '') AS sensor FROM p LEFT JOIN captures ON p.session_id = captures.session_id WHERE (p.components & 2048) <> 0 {_ASC} LIMIT 100")
def search_sensor(spark, d):
    return plain(S.search(V.store(spark, d), "dns", limit=100, sensor=True))


@query(f"SELECT {_HEAD}, dot1q.vlan_id AS dot1q_vlan_id FROM p {J.format('dot1q')} WHERE dot1q.layer_index = 1 {_ASC} LIMIT 60")
def search_repeatable_first(spark, d):
    return plain(S.search(V.store(spark, d), "dot1q", ("dot1q",), 60).select("session_id", "packet_id", "timestamp_ns", "incl_len", "orig_len", "components", "dot1q_vlan_id"))


@query(f"SELECT p.session_id, p.packet_id, p.ts FROM p WHERE (p.session_id, p.packet_id) IN (SELECT p.session_id, p.packet_id FROM p {J.format('tcp')} WHERE tcp.flags = 2)")
def explain_semi_join(spark, d):
    """The engine's own SQL text, run."""
    store = V.store(spark, d)
    return plain(store.sql(S.explain_sql("tcp.flags = 2")).select("session_id", "packet_id", "ts"))


@query(f"SELECT p.session_id, p.packet_id, udp.dst AS dst, udp.length AS length FROM p {J.format('udp')} WHERE udp.dst = 53")
def explain_star_except(spark, d):
    store = V.store(spark, d)
    return plain(store.sql(S.explain_sql("udp.dst = 53", ("udp",))).select("session_id", "packet_id", "dst", "length"))


@query("SELECT p.session_id, p.packet_id, p.ts AS timestamp_ns, {l} AS proto, tcp.dst AS tcp_dst, ipv4.ttl AS ipv4_ttl FROM p {a} {b} WHERE p.packet_id = (SELECT min(packet_id) FROM tcp JOIN ipv4 USING (session_id, packet_id))".format(l=_LABEL, a=J.format("tcp"), b=J.format("ipv4")))
def packet_details_nested(spark, d):
    store = V.store(spark, d)
    first = store.table("tcp").join(store.table("ipv4"), list(KEYS)).orderBy("packet_id").select(*KEYS).first()
    out = S.details(store, int(first.session_id), first.packet_id)
    return out.select(F.col("session_id").cast("long").alias("session_id"), "packet_id", "timestamp_ns", "proto", F.col("tcp.tcp_dst").alias("tcp_dst"), F.col("ipv4.ipv4_ttl").cast("int").alias("ipv4_ttl"))


@query("SELECT session_id, packet_id, ts, incl_len, trunc_extra, components FROM p WHERE packet_id = 500")
def packet_point_lookup(spark, d):
    store = V.store(spark, d)
    s = V.read(spark, d, "events").where("event_id = 500").selectExpr("user_id % 8").first()[0]
    return plain(S.point(store, s, 500).drop("payload"))


@query("SELECT count(*) AS count FROM p WHERE EXISTS (SELECT 1 FROM dot1q WHERE dot1q.session_id = p.session_id AND dot1q.packet_id = p.packet_id AND vlan_id >= 50)")
def export_count(spark, d):
    return S.count_matching(V.store(spark, d), "dot1q.vlan_id >= 50")


@query("SELECT count(*) AS count FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)", views=False)
def count_packets_final(spark, d):
    return V.read(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT DISTINCT session_id FROM p WHERE (components & 512) <> 0")
def distinct_sessions(spark, d):
    return plain(S.matching(V.store(spark, d), "tcp").select("session_id").distinct())


@query("SELECT session_id, sensor, snaplen FROM captures")
def sessions_list(spark, d):
    return plain(V.store(spark, d).sessions().select("session_id", "sensor", "snaplen"))


@query("SELECT 'le' AS endianness, 'us' AS time_res, CAST(greatest(max(snaplen), 65535) AS BIGINT) AS snaplen, CASE WHEN count(DISTINCT linktype) = 1 THEN min(linktype) ELSE 1 END AS linktype FROM captures")
def export_meta_synth(spark, d):
    return reassembly.export_meta(V.store(spark, d).table("captures"))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_partkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_suppkey FROM lineitem GROUP BY l_orderkey", views=False)
def export_group_array(spark, d):
    return reassembly.arrays_by_layer(V.read(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ["l_partkey", "l_suppkey"])


@query(f"SELECT p.session_id, p.packet_id, p.ts, len(v.l) AS n_tags, v.l[1] AS first_vlan, v.l[2] AS last_vlan, coalesce(ipv4.ttl, 0) AS ttl FROM p JOIN (SELECT session_id, packet_id, list(vlan_id ORDER BY layer_index) AS l FROM dot1q GROUP BY ALL) v ON v.session_id = p.session_id AND v.packet_id = p.packet_id LEFT {J.format('ipv4')}")
def export_wide_join(spark, d):
    rows = reassembly.export_rows(V.store(spark, d), "dot1q")
    return plain(rows.select("session_id", "packet_id", "ts", F.size("dot1q").cast("long").alias("n_tags"), F.col("dot1q")[0].v.vlan_id.alias("first_vlan"), F.col("dot1q")[1].v.vlan_id.alias("last_vlan"), F.coalesce(F.get("ipv4", F.lit(0)).v.ttl.cast("int"), F.lit(0)).alias("ttl")))


@query("SELECT p.session_id, p.packet_id, ipv4.ttl AS ttl, len(v.l) AS n_tags FROM p LEFT JOIN (SELECT session_id, packet_id, list(vlan_id ORDER BY layer_index) AS l FROM dot1q GROUP BY ALL) v ON v.session_id = p.session_id AND v.packet_id = p.packet_id JOIN ipv4 ON p.session_id = ipv4.session_id AND p.packet_id = ipv4.packet_id WHERE ipv4.ttl < 40")
def wide_view_filter(spark, d):
    """A component filter as a predicate on the wide rows' nested column."""
    w = wide(V.store(spark, d)).where("ipv4.ttl < 40")
    return plain(w.select("session_id", "packet_id", F.col("ipv4.ttl").cast("int").alias("ttl"), F.when(F.col("dot1q").isNotNull(), F.size("dot1q")).cast("long").alias("n_tags")))


@query("SELECT row_number() OVER (ORDER BY ts, session_id, packet_id) AS n, session_id, packet_id FROM p")
def merge_captures(spark, d):
    """The merge of all captures: every packet with its place."""
    return plain(reassembly.merge_order(V.store(spark, d)).select("n", *KEYS))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) = 1", views=False)
def limit_1_by(spark, d):
    order = [F.asc(c) for c in _LINE[1:]]
    return reassembly.limit_by(V.read(spark, d, "lineitem"), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, max(l_partkey * 1000000 + l_suppkey) AS seq FROM lineitem GROUP BY 1, 2", views=False)
def replacing_last_wins(spark, d):
    rows = V.read(spark, d, "lineitem").withColumn("_ingest_seq", F.col("l_partkey") * 1000000 + F.col("l_suppkey"))
    return last_written(rows.withColumn("seq", F.col("_ingest_seq")), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "seq")


@query("SELECT session_id, min(packet_id) AS first, max(packet_id) AS last, count(*) AS n FROM (SELECT session_id, packet_id, packet_id - row_number() OVER (PARTITION BY session_id ORDER BY packet_id) AS r FROM p) GROUP BY session_id, r")
def id_ranges(spark, d):
    return plain(reassembly.id_ranges(V.store(spark, d).table("packets")))


@query("SELECT session_id, packet_id, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, session_id, packet_id) AS gap_ns FROM p")
def inter_arrival(spark, d):
    return plain(reassembly.inter_arrival(V.store(spark, d).table("packets")))


@query("SELECT event_type, sum(length(props))::BIGINT AS total, sum(length(props))::DOUBLE / sum(sum(length(props))) OVER ()::DOUBLE AS share FROM events GROUP BY event_type", views=False)
def share_of_total(spark, d):
    return reassembly.share_of_total(V.read(spark, d, "events").withColumn("n", F.length("props").cast("long")), "event_type", "n")


_LO = "least(src_n * 100000 + src_port, dst_n * 100000 + dst_port)"
_HI = "greatest(src_n * 100000 + src_port, dst_n * 100000 + dst_port)"


@query(f"SELECT session_id, {_LO} // 100000 AS lo, {_LO} % 100000 AS lo_port, {_HI} // 100000 AS hi, {_HI} % 100000 AS hi_port, min(packet_id) AS first_packet_id, max(packet_id) AS last_packet_id, count(*) AS packet_count, sum(length(props))::BIGINT AS byte_count FROM (SELECT {V.FLOW}, props FROM events) GROUP BY ALL", views=False)
def flow_aggregate(spark, d):
    rows = V.flow_packets(spark, d).withColumn("payload", F.col("props").cast("binary"))
    out = flows.flow_aggregate(rows)
    n = lambda c: F.conv(F.substring(F.hex(c), 25, 8), 16, 10).cast("long")
    return out.select("session_id", n("lo_ip").alias("lo"), F.col("lo_port").cast("long").alias("lo_port"), n("hi_ip").alias("hi"), F.col("hi_port").cast("long").alias("hi_port"), "first_packet_id", "last_packet_id", "packet_count", "byte_count")


_STREAMS = f"""WITH f AS (SELECT {V.FLOW}, {V.FLAGS} AS flags, CASE event_type WHEN 'click' THEN 'http' WHEN 'view' THEN 'ssh' END AS l7, props, event_type FROM events),
g AS (SELECT *, {_LO} AS lo, {_HI} AS hi FROM f),
a AS (SELECT session_id, lo, hi, min(CASE WHEN flags = 2 THEN packet_id END) AS syn, max(CASE WHEN flags = 18 THEN packet_id END) AS synack, min(packet_id) AS first_packet_id, max(packet_id) AS last_packet_id, count(*) AS packet_count, sum(CASE event_type WHEN 'click' THEN length(props) + 38 WHEN 'view' THEN 7 ELSE length(props) END)::BIGINT AS byte_count, nullif(first(coalesce(l7, '') ORDER BY packet_id), '') AS l7_proto FROM g GROUP BY ALL)"""


@query(_STREAMS + " SELECT a.session_id, l7_proto, g.src_n AS src, g.dst_n AS dst, g.src_port::INT AS src_port, g.dst_port::INT AS dst_port, first_packet_id, last_packet_id, packet_count FROM a JOIN g ON g.session_id = a.session_id AND g.packet_id = a.syn WHERE synack > syn AND l7_proto IS NOT NULL", views=False)
def streams_list(spark, d):
    out = flows.streams(V.flow_packets(spark, d))
    n = lambda c: F.conv(F.substring(F.hex(c), 25, 8), 16, 10).cast("long")
    return out.select("session_id", "l7_proto", n("src_ip").alias("src"), n("dst_ip").alias("dst"), F.col("src_port").cast("int").alias("src_port"), F.col("dst_port").cast("int").alias("dst_port"), "first_packet_id", "last_packet_id", "packet_count")


def _stream_store(spark, d):
    store = V.store(spark, d)
    rows = V.flow_packets(spark, d)
    found = flows.streams(rows)
    store.tables["stream_captures"], store.tables["stream_http"] = found.drop("lo_ip", "hi_ip", "lo_port", "hi_port"), flows.http_streams(rows, found)
    return store


@query(_STREAMS + " SELECT count(*) AS count FROM a WHERE synack > syn AND l7_proto IS NOT NULL", views=False)
def streams_count(spark, d):
    return flows.count_streams(_stream_store(spark, d))


@query(_STREAMS + f", p AS (SELECT event_id AS packet_id, epoch_ns(ts) AS ts FROM events) SELECT a.session_id, a.l7_proto, a.first_packet_id, a.packet_count FROM a JOIN p ON p.packet_id = a.first_packet_id WHERE synack > syn AND l7_proto IS NOT NULL AND ts >= 0 AND ts < {T0}", views=False)
def streams_time_filter(spark, d):
    out = flows.all_streams(_stream_store(spark, d), start=0, end=T0)
    return out.select("session_id", "l7_proto", "first_packet_id", "packet_count")


@query(_STREAMS + " SELECT a.session_id, 'GET' AS method, 'h.example' AS host, '/' || g.props[1:1] AS path FROM a JOIN g ON g.session_id = a.session_id AND g.packet_id = a.first_packet_id WHERE synack > syn AND l7_proto = 'http'", views=False)
def streams_http(spark, d):
    out = flows.all_streams(_stream_store(spark, d), l7="http")
    return out.select("session_id", "method", "host", F.substring("path", 1, 2).alias("path"))


_NET = "n_nationkey * 16777216 * 5 % 3221225472 + n_nationkey * 65536"
_RANGES = f"SELECT CAST({_NET} AS BIGINT) AS lo, CAST({_NET} + 1000 * (n_nationkey + 1) AS BIGINT) AS hi, n_name AS country_code FROM nation"


@query(f"SELECT country_code, lo, hi, CAST(hi - lo + 1 AS BIGINT) AS covered, true AS aligned FROM ({_RANGES})", views=False)
def range_to_cidr(spark, d):
    """Every range as exact prefixes: their sizes sum to the range, and each starts at a multiple of its size."""
    r = V.read(spark, d, "nation").selectExpr(f"CAST({_NET} AS BIGINT) AS lo", f"CAST({_NET} + 1000 * (n_nationkey + 1) AS BIGINT) AS hi", "n_name AS country_code")
    out = geoip.prefixes(r, "lo", "hi").withColumn("size", F.pow(F.lit(2.0), 32 - F.col("len")).cast("long"))
    return out.groupBy("country_code", "lo", "hi").agg(F.sum("size").alias("covered"), F.bool_and(F.col("network") % F.col("size") == 0).alias("aligned"))


_CIDRS = "SELECT CAST(167772160 + (n_nationkey % 4) * 32 AS BIGINT) AS network, CASE WHEN n_nationkey < 4 THEN 27 ELSE 28 + n_nationkey % 4 END AS len, n_name AS country_code FROM nation"


_NET6 = "concat('20010db8', lpad(lower(hex(n_nationkey * 4096 + 3)), 8, '0'), '0000000000000000')"
_END6 = "concat('20010db8', lpad(lower(hex(n_nationkey * 4096 + 3 + 37 * (n_nationkey + 1))), 8, '0'), '0000000000000005')"


@query("SELECT n_name AS country_code, CAST(37 * (n_nationkey + 1) AS BIGINT) AS upper_blocks, CAST(6 AS BIGINT) AS lower_rest, true AS disjoint FROM nation", views=False)
def range_to_cidr6(spark, d):
    """Every IPv6 range as exact prefixes: sizes in blocks of 2^64 addresses and single ones above them sum to the range, and no prefix holds another."""
    r = V.read(spark, d, "nation").selectExpr(f"unhex({_NET6}) AS lo", f"unhex({_END6}) AS hi", "n_name AS country_code")
    out = geoip.prefixes6(r, "lo", "hi")
    size = lambda top: F.sum(F.when(F.col("len").between(top - 63, top), F.pow(F.lit(2.0), top - F.col("len")).cast("long")).otherwise(0))
    return out.groupBy("country_code").agg(size(64).cast("long").alias("upper_blocks"), size(128).cast("long").alias("lower_rest"), (F.count_distinct("prefix") == F.count(F.lit(1))).alias("disjoint"))


@query("SELECT DISTINCT '2001:db8::' || lower(to_hex(user_id)) AS ip, coalesce('N' || CASE WHEN user_id < 256 THEN CAST(user_id // 32 AS VARCHAR) END, '') AS country_code, CASE WHEN user_id % 64 = 5 THEN 'single' WHEN user_id < 256 THEN 'block' ELSE '' END AS city FROM events", views=False)
def geo_lookup6(spark, d):
    """IPv6 addresses against ranges of 32 addresses, and every 64th address in a range of its own.

    The ranges of one address go as far as the users; only places below 256 have a country. A user above 16 bits takes two groups of the address.
    """
    address = lambda n: f"concat('2001:db8::', lower(hex(shiftright({n}, 16))), ':', lower(hex({n} & 65535)))"
    ips = V.read(spark, d, "events").select("user_id").distinct().selectExpr("concat('2001:db8::', lower(hex(user_id))) AS ip", f"{address('user_id')} AS address")
    blocks = spark.range(8).selectExpr("concat('2001:db8::', lower(hex(id * 32))) AS ip_range_start", "concat('2001:db8::', lower(hex(id * 32 + 31))) AS ip_range_end", "concat('N', id) AS country_code", "'block' AS city")
    last = V.read(spark, d, "events").agg(F.max("user_id")).first()[0] or 0
    single = spark.range(last // 64 + 1).selectExpr(f"{address('(id * 64 + 5)')} AS ip_range_start", f"{address('(id * 64 + 5)')} AS ip_range_end", "CASE WHEN id < 4 THEN concat('N', id * 2) END AS country_code", "'single' AS city")
    return geoip.lookup(ips, blocks.unionByName(single), spark.createDataFrame([], geoip.ASN_SCHEMA), "address").select("ip", "country_code", "city")


@query("SELECT ip, coalesce(c.country_code, '') AS country_code FROM (SELECT DISTINCT 167772160 + user_id AS ip FROM events) LEFT JOIN (SELECT a.ip AS i, max_by(country_code, len * 1000 + ascii(country_code) * 1.0 + 0) AS country_code FROM (SELECT DISTINCT 167772160 + user_id AS ip FROM events) a JOIN (SELECT network, len, max(country_code) AS country_code FROM (" + _CIDRS + ") GROUP BY 1, 2) n ON a.ip >= n.network AND a.ip < n.network + (1 << (32 - len)) GROUP BY 1) c ON c.i = ip", views=False)
def geo_longest_prefix(spark, d):
    table = V.read(spark, d, "nation").selectExpr("CAST(167772160 + (n_nationkey % 4) * 32 AS BIGINT) AS network", "CASE WHEN n_nationkey < 4 THEN 27 ELSE 28 + n_nationkey % 4 END AS len", "n_name AS country_code")
    ips = V.read(spark, d, "events").selectExpr("CAST(167772160 + user_id AS BIGINT) AS ip").distinct()
    return geoip.longest_prefix(ips, table, "ip", ("country_code",))


@query("SELECT DISTINCT CAST(make_timestamp_ns(ts) AS DATE) AS day FROM p")
def retention_partitions(spark, d):
    return V.store(spark, d).table("packets").select(day_of(F.col("ts")).alias("day")).distinct().orderBy("day")


@query("SELECT CAST(n_nationkey AS BIGINT) AS session_id FROM nation WHERE n_nationkey NOT IN (SELECT session_id FROM p WHERE ts >= 1704153600000000000)")
def retention_orphans(spark, d):
    from ..operators.retention import orphans

    store = V.store(spark, d)
    sessions = V.read(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS session_id")
    return orphans(sessions, store.table("packets").where("ts >= 1704153600000000000").withColumn("session_id", F.col("session_id").cast("long")))


@query("SELECT session_id, packet_id FROM p WHERE ((CASE WHEN packet_id % 7 = 0 THEN components & 511 ELSE components END) & 65024) = 0")
def reencode_candidates(spark, d):
    """Every seventh packet has lost what was decoded above the network layer."""
    p = V.store(spark, d).table("packets").withColumn("components", F.expr("CASE WHEN packet_id % 7 = 0 THEN components & 511 ELSE components END"))
    return plain(reassembly.reencode_candidates(p))


@query("SELECT p.session_id, p.packet_id, 'udp' AS component FROM p WHERE (components & 1024) <> 0 AND packet_id % 50 = 0")
def missing_component_check(spark, d):
    store = V.store(spark, d)
    store.tables["udp"] = store.table("udp").where("packet_id % 50 != 0")
    return plain(reassembly.missing_components(store))


@query("SELECT count(*) AS packets, count(*) FILTER (WHERE length(props) > 8) AS with_tail FROM events", views=False)
def parse_ratio(spark, d):
    p = V.read(spark, d, "events").withColumn("payload", F.expr("CASE WHEN length(props) > 8 THEN cast(props AS binary) ELSE X'' END"))
    return reassembly.parse_ratio(p)


@query("SELECT o_orderkey, CAST(('0x' || substr(sha256(o_orderpriority || chr(0) || o_orderkey), 1, 16))::UBIGINT AS DECIMAL(20, 0)) AS session_id FROM orders", views=False)
def session_id_hash(spark, d):
    o = V.read(spark, d, "orders")
    return o.select("o_orderkey", A.session_id(F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("session_id"))


@query(f"{IDS} WHERE (components & 512) <> 0 UNION {IDS} WHERE (components & 2048) <> 0 EXCEPT {IDS} WHERE (components & 32) <> 0")
def setop_equivalence(spark, d):
    return _match("(tcp or dns) and not ipv6")(spark, d)


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


@query("SELECT DISTINCT 167772160 + user_id AS ip, '10.0.' || (((167772160 + user_id) >> 8) & 255) || '.' || ((167772160 + user_id) & 255) AS text, 167772160 + user_id AS back FROM events", views=False)
def address_text(spark, d):
    ips = V.read(spark, d, "events").selectExpr("CAST(167772160 + user_id AS BIGINT) AS ip").distinct()
    return ips.withColumn("text", A.ip4_text(F.col("ip"))).withColumn("back", A.ip4_parse(F.col("text")))


# HMAC-SHA256 under the key 00 01 … 1f, said with sha256 alone; then the octets, and the networks that aren't public
_PAD = {n: bytes(k ^ n for k in bytes(range(32)).ljust(64, b"\0")).hex() for n in (0x36, 0x5C)}
_PRIVATE = " OR ".join(f"ip >> {32 - bits} = {net >> (32 - bits)}" for net, bits in ((0x0A000000, 8), (0xAC100000, 12), (0xC0A80000, 16), (0x7F000000, 8), (0xA9FE0000, 16), (0xE0000000, 4), (0, 32)))
_PSEUDONYMS = f"""WITH e AS (SELECT DISTINCT (134744072 + user_id * 65536)::BIGINT AS ip FROM events),
h AS (SELECT ip, sha256(unhex('{_PAD[0x5C]}') || unhex(sha256(unhex('{_PAD[0x36]}04') || unhex(printf('%08x', ip))))) AS h FROM e),
o AS (SELECT ip, ('0x' || h[1:2])::BIGINT AS a, ('0x' || h[3:4])::BIGINT AS b, ('0x' || h[5:6])::BIGINT AS c FROM h)
SELECT ip, CASE WHEN {_PRIVATE} THEN ip ELSE (ip >> 24) * 16777216 + a * 65536 + b * 256 + CASE c WHEN 0 THEN 1 WHEN 255 THEN 254 ELSE c END END AS pseudonym FROM o"""


@query(_PSEUDONYMS, views=False)
def pseudonymise(spark, d):
    """Keyed pseudonyms of addresses; held against hmac in the tests too."""
    from ..functions import pseudonym

    ips = V.read(spark, d, "events").selectExpr("CAST(134744072 + user_id * 65536 AS BIGINT) AS ip").distinct()
    return ips.withColumn("pseudonym", pseudonym.ip4(bytes(range(32)), F.col("ip")))


_KINDS = """SELECT CASE event_type WHEN 'click' THEN 'ethernet/ipv4/tcp' WHEN 'view' THEN 'ethernet/ipv4/udp' WHEN 'purchase' THEN 'ethernet/ipv6/tcp' WHEN 'error' THEN 'ethernet/ipv4/udp/dns' ELSE 'ethernet/arp' END AS proto,
count(*) AS packets, sum(CASE event_type WHEN 'click' THEN 54 + length(props) WHEN 'view' THEN 42 + length(props) WHEN 'purchase' THEN 74 + length(props) WHEN 'error' THEN 64 ELSE 42 END)::BIGINT AS bytes,
sum(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN length(props) ELSE 0 END)::BIGINT AS tail, sum(event_id % 3)::BIGINT AS cut"""


def _dissected(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import codec
    from ..sources import pcap

    return codec.dissect_frames(pcap.read_frames(V.capture_files(spark, d)))


@query(_KINDS + " FROM events GROUP BY 1", views=False)
def pcap_ingest(spark, d):
    """Capture files read, dissected and summed by protocol."""
    rows = _dissected(spark, d)
    return rows.groupBy(S.proto_label(F.col("components")).alias("proto")).agg(F.count(F.lit(1)).alias("packets"), F.sum("incl_len").alias("bytes"), F.sum(F.octet_length("payload")).cast("long").alias("tail"), F.sum("trunc_extra").alias("cut"))


@query("SELECT count(*) AS packets, count(*) AS same FROM events", views=False)
def pcap_export(spark, d):
    """Every frame rebuilt from its layers and compared with the file's bytes."""
    from ..operators import codec
    from ..sources import pcap

    there = pcap.read_frames(V.capture_files(spark, d)).select(*KEYS, F.sha2("frame", 256).alias("want"))
    back = codec.rebuild_frames(_dissected(spark, d)).select(*KEYS, F.sha2("frame", 256).alias("got"))
    # Spark takes a few columns of wide dissected rows for a few MB, and would send every packet through the driver
    return there.join(back.hint("merge"), list(KEYS)).agg(F.count(F.lit(1)).alias("packets"), F.count_if(F.col("want") == F.col("got")).alias("same"))


@query("SELECT event_id % 97 + 167772160 AS dst, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1", views=False)
def component_table(spark, d):
    """A component's table out of dissected packets."""
    from ..operators import codec

    return codec.component_rows(_dissected(spark, d), "ipv4").groupBy("dst").agg(F.count(F.lit(1)).alias("n"))


@query()
def sanitize_frames(spark, d):
    """Frames with pseudonymous addresses and right checksums; held against hmac and RFC 1071 in the tests."""
    from ..operators import sanitize
    from ..sources import pcap

    return sanitize.sanitize(pcap.read_frames(V.capture_files(spark, d)), bytes(range(32))).select(F.col("session_id").cast("string").alias("session_id"), "packet_id", F.hex("frame").alias("frame"))


@query("SELECT count(*) FILTER (WHERE event_type = 'click') AS v4, count(*) FILTER (WHERE event_type = 'purchase') AS v6 FROM events", views=False)
def tcp_payload_bounds(spark, d):
    """TCP packets with the payload that the IP length covers."""
    from ..operators import ingest

    return ingest.tcp_of(_dissected(spark, d)).agg(F.count_if(F.hex(F.substring("src_ip", 11, 2)) == "FFFF").alias("v4"), F.count_if(F.hex(F.substring("src_ip", 11, 2)) != "FFFF").alias("v6"))
