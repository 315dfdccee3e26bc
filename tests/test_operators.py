import hashlib
import hmac
import ipaddress
import os
import random

import pytest
from pyspark.sql import functions as F

from tests import packets as P
from wirelake.functions import address as A
from wirelake.functions import pseudonym
from wirelake.operators import flows, geoip, reassembly, sanitize
from wirelake.plans import search as S
from wirelake.plans.language import FilterError
from wirelake.plans.store import Store
from wirelake.registry import display_schema, identifier


def test_l7_detection():
    cases = {b"\x16\x03\x01": "tls", b"\x16\x03": None, b"\x16\x02\x01": None, b"SSH-2.0": "ssh", b"SSH": None, b"GET / ": "http", b"POST": "http", b"HEAD /": "http", b"PUT x": "http", b"DELETE /": "http", b"OPTIONS *": "http", b"PATCH /": "http", b"HTTP/1.1": "http", b"GETX": None, b"": None, b"\x00GET ": None}
    assert {k: flows.detect_bytes(k) for k in cases} == cases


def test_detection_as_a_column(spark):
    cases = [b"\x16\x03\x01", b"SSH-2.0", b"GET / HT", b"OPTIONS ", b"HTTP/1.1", b"\xff\xfe", b""]
    rows = spark.createDataFrame([(bytearray(c),) for c in cases], "b binary").select(flows.detect(F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == [flows.detect_bytes(c) for c in cases]


def test_http_lines():
    assert flows.http_session([b"GET /a HTTP/1.1\r\nHost: x.y\r\n\r\n"]) == ("GET", "x.y", "/a")
    assert flows.http_session([b"POST /b HT", b"TP/1.1\r\nA: 1\r\nhOST:  z \r\n"]) == ("POST", "z", "/b")
    assert flows.http_session([b"GET / HTTP/1.0\r\n\r\nHost: no"]) == ("GET", "", "/")
    assert flows.http_session([b"nothing"]) is None


def literal_flows(rows):
    """The definition, one packet after the other."""
    state = {}
    for sess, pid, src, dst, sp, dp, flags, data in sorted(rows, key=lambda r: (r[0], r[1])):
        key = (sess, *(((src, sp), (dst, dp)) if (src, sp) <= (dst, dp) else ((dst, dp), (src, sp))))
        s = state.setdefault(key, {"first": pid, "n": 0, "bytes": 0, "syn": None, "ack": False, "buf": b"", "l7": None})
        s["n"], s["bytes"], s["last"] = s["n"] + 1, s["bytes"] + len(data), pid
        if flags & 2 and not flags & 16 and s["syn"] is None:
            s["syn"] = (src, dst, sp, dp)
        if flags & 2 and flags & 16 and s["syn"]:
            s["ack"] = True
        if s["l7"] is None and len(s["buf"]) < 1024:
            s["buf"] += data
            s["l7"] = flows.detect_bytes(s["buf"])
    return {(k[0], v["first"], v["last"], v["n"], v["bytes"], v["l7"], v["syn"]) for k, v in state.items() if v["syn"] and v["ack"] and v["l7"]}


def test_flows_equal_the_fold(spark):
    rnd = random.Random(4)
    ips = [bytes(12) + bytes([10, 0, 0, i]) for i in range(3)]
    rows = []
    for pid in range(600):
        src, dst = rnd.sample(ips, 2)
        sp, dp = rnd.choice([(80, 1000), (1000, 80)])
        data = rnd.choice([b"", b"", b"G", b"ET / HTTP/1.1\r\n", b"SSH-", b"SS", b"H-2", b"\x16\x03", b"\x01", b"zzz"])
        rows.append((rnd.randint(0, 12), pid, src, dst, sp, dp, rnd.choice([2, 18, 16, 24]), data))
    df = spark.createDataFrame([(s, p, bytearray(a), bytearray(b), x, y, f, bytearray(d)) for s, p, a, b, x, y, f, d in rows], "session_id long, packet_id long, src_ip binary, dst_ip binary, src_port int, dst_port int, flags int, payload binary")
    got = {(r.session_id, r.first_packet_id, r.last_packet_id, r.packet_count, r.byte_count, r.l7_proto, (bytes(r.src_ip), bytes(r.dst_ip), r.src_port, r.dst_port)) for r in flows.streams(df).collect()}
    want = literal_flows(rows)
    assert got == want and want
    again = {r.stream_id for r in flows.streams(df.orderBy(F.rand(3))).collect()}
    assert again == {r.stream_id for r in flows.streams(df).collect()}


def test_prefixes_cover_ranges_exactly(spark):
    rnd = random.Random(1)
    ranges = [(0, 2**32 - 1), (5, 5), (4, 5), (5, 6), (0, 2**31), (2**32 - 1, 2**32 - 1)] + [tuple(sorted((rnd.randrange(2**32), rnd.randrange(2**32)))) for _ in range(40)]
    df = spark.createDataFrame(ranges, "lo long, hi long")
    got = {}
    for r in geoip.prefixes(df, "lo", "hi").collect():
        got.setdefault((r.lo, r.hi), []).append((r.network, r.len))
    for lo, hi in ranges:
        want = [(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi))]
        assert sorted(got[lo, hi]) == want


def test_prefixes_of_six_cover_ranges_exactly(spark):
    rnd = random.Random(2)
    top = 2**128 - 1
    ranges = [(0, top), (5, 5), (4, 5), (5, 6), (0, 2**127), (top, top), (0, top - 1), (1, top), (2**64, 2**65 - 1)] + [tuple(sorted((rnd.getrandbits(128), rnd.getrandbits(128)))) for _ in range(25)]
    ranges += [(a, a + rnd.getrandbits(20)) for a in (rnd.getrandbits(127) for _ in range(25))]
    df = spark.createDataFrame([(i, bytearray(a.to_bytes(16, "big")), bytearray(b.to_bytes(16, "big"))) for i, (a, b) in enumerate(ranges)], "i int, lo binary, hi binary")
    got = {}
    for r in geoip.prefixes6(df, "lo", "hi").collect():
        got.setdefault(r.i, []).append((int(r.prefix.ljust(128, "0"), 2), r.len))
    for i, (lo, hi) in enumerate(ranges):
        want = [(int(n.network_address), n.prefixlen) for n in ipaddress.summarize_address_range(ipaddress.IPv6Address(lo), ipaddress.IPv6Address(hi))]
        assert sorted(got[i]) == want


def test_texts_of_six(spark):
    good = ["::", "::1", "2001:db8::5", "1:2:3:4:5:6:7:8", "fe80::", "::ffff:10.0.0.9", "1::8", "ABCD:ef01::1"]
    bad = ["", "x", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "12345::", ":1:2:3:4:5:6:7", "10.0.0.1", "1:2:3:4:5:6:7:"]
    rows = spark.createDataFrame([(t,) for t in good + bad + [None]], "t string").select("t", A.ip6_parse(F.col("t")).alias("b")).collect()
    assert {r.t: bytes(r.b) for r in rows if r.b is not None} == {t: ipaddress.ip_address(t).packed for t in good}


def test_lookup_answers_both_families(spark):
    city = spark.createDataFrame([("10.0.0.0", "10.255.255.255", "AA", "", "", "big", "", 0.0, 0.0, ""), ("2001:db8::3", "2001:db8::ff", "CC", "", "", "six", "", 0.0, 0.0, ""), ("2001:db8::7", "2001:db8::7", "DD", "", "", "one", "", 0.0, 0.0, "")], geoip.CITY_SCHEMA)
    asn = spark.createDataFrame([("2001:db8::", "2001:db8::6", "64501", "six net")], geoip.ASN_SCHEMA)
    ips = spark.createDataFrame([("10.0.0.9",), ("2001:db8::5",), ("2001:db8::7",), ("2001:db8::2",), ("::ffff:10.0.0.9",)], "ip string")
    rows = {r.ip: (r.country_code, r.city, r.asn, r.org) for r in geoip.lookup(ips, city, asn).collect()}
    assert rows == {"10.0.0.9": ("AA", "big", "", ""), "2001:db8::5": ("CC", "six", "64501", "six net"), "2001:db8::7": ("DD", "one", "", ""), "2001:db8::2": ("", "", "64501", "six net"), "::ffff:10.0.0.9": ("AA", "big", "", "")}


def test_lookup_takes_the_longest_prefix(spark):
    city = spark.createDataFrame([("10.0.0.0", "10.255.255.255", "AA", "", "", "big", "", 0.0, 0.0, ""), ("10.1.0.0", "10.1.0.255", "BB", "", "", "small", "", 0.0, 0.0, ""), ("2001:db8::", "2001:db8::ff", "CC", "", "", "six", "", 0.0, 0.0, "")], geoip.CITY_SCHEMA)
    asn = spark.createDataFrame([("10.1.0.0", "10.1.255.255", "64500", "net")], geoip.ASN_SCHEMA)
    ips = spark.createDataFrame([("10.1.0.7",), ("10.2.0.0",), ("11.0.0.0",), ("x",)], "ip string")
    rows = {r.ip: (r.country_code, r.city, r.asn, r.org) for r in geoip.lookup(ips, city, asn).collect()}
    assert rows == {"10.1.0.7": ("BB", "small", "64500", "net"), "10.2.0.0": ("AA", "big", "", ""), "11.0.0.0": ("", "", "", ""), "x": ("", "", "", "")}
    none = geoip.lookup(ips, *(spark.createDataFrame([], s) for s in (geoip.CITY_SCHEMA, geoip.ASN_SCHEMA))).collect()
    assert {r.city for r in none} == {""}


def test_longest_prefix_of_six(spark):
    pair = lambda a, b: (bytearray(ipaddress.ip_address(a).packed), bytearray(ipaddress.ip_address(b).packed))
    t = spark.createDataFrame([(*pair("2001:db8::", "2001:db8:ffff:ffff:ffff:ffff:ffff:ffff"), "wide"), (*pair("2001:db8:1::", "2001:db8:1:7fff:ffff:ffff:ffff:ffff"), "narrow")], "lo binary, hi binary, city string")
    net, length = geoip.prefix6(F.col("lo"), F.col("hi"))
    table = t.select(net.alias("network"), length.alias("len"), "city")
    assert {r.city: r.len for r in table.collect()} == {"wide": 32, "narrow": 49}
    ips = spark.createDataFrame([(bytearray(ipaddress.ip_address(x).packed), x) for x in ("2001:db8:1:1::1", "2001:db8:1:8000::", "::1")], "ip binary, t string")
    assert {r.t: r.city for r in geoip.longest_prefix6(ips, table, "ip", ("city",)).collect()} == {"2001:db8:1:1::1": "narrow", "2001:db8:1:8000::": "wide", "::1": ""}


def test_pseudonyms_equal_hmac(spark):
    seed = bytes(range(32))
    v4 = [0x08080808, 0x0A000001, 0xC0A80101, 0xE0000001, 0x01020304, 0xFFFFFFFF]
    rows = spark.createDataFrame([(x,) for x in v4], "a long").select("a", pseudonym.ip4(seed, F.col("a")).alias("p")).collect()
    assert {r.a: r.p for r in rows} == {x: sanitize.ip4(seed, x) for x in v4}
    h = hmac.new(seed, b"\x04\x08\x08\x08\x08", hashlib.sha256).digest()
    assert sanitize.ip4(seed, 0x08080808) == int.from_bytes(bytes([8, h[0], h[1], {0: 1, 255: 254}.get(h[2], h[2])]), "big")
    v6 = [ipaddress.ip_address(x).packed for x in ("2001:db8::1", "fe80::1", "::1", "::ffff:8.8.8.8", "::ffff:10.0.0.1")]
    rows = spark.createDataFrame([(bytearray(x),) for x in v6], "a binary").select("a", pseudonym.ip6(seed, F.col("a")).alias("p")).collect()
    assert {bytes(r.a): bytes(r.p) for r in rows} == {x: sanitize.ip6(seed, x) for x in v6}
    macs = [P.MAC_A, b"\x01" * 6, b"\xff" * 6, b"\0" * 6]
    rows = spark.createDataFrame([(bytearray(x),) for x in macs], "a binary").select("a", pseudonym.mac(seed, F.col("a")).alias("p")).collect()
    assert {bytes(r.a): bytes(r.p) for r in rows} == {x: sanitize.mac(seed, x) for x in macs}
    assert pseudonym.parse_seed("00" * 32) == bytes(32)
    with pytest.raises(ValueError):
        pseudonym.parse_seed("00")


def test_session_id_is_unsigned(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x%d" % i)) for i in range(20)], "n string, b binary").select("b", A.session_id(F.col("n"), F.col("b")).alias("s")).collect()
    for r in rows:
        assert int(r.s) == int.from_bytes(hashlib.sha256(b"a\0" + bytes(r.b)).digest()[:8], "big")


def test_limits_and_breakdowns():
    assert [S.clamp_search(x) for x in (None, 5, 10_000, 10_001, -1)] == [1000, 5, 10_000, 1000, 1000]
    assert [S.clamp_preview(x) for x in (None, 20_000)] == [1000, 10_000]
    assert [S.clamp_streams(x) for x in (0, 1000, 1001)] == [100, 1000, 100]
    assert S.breakdown_fields("ipv4.addr, tcp.dst,") == [("ipv4", "addr"), ("tcp", "dst")]
    for bad in ("", "tcp", "x.y", "tcp.x", " , "):
        with pytest.raises(FilterError):
            S.breakdown_fields(bad)


def test_registry():
    assert identifier("a_1") == "a_1" and "tcp" in display_schema()
    with pytest.raises(ValueError):
        identifier("a;b")


def test_arrays_keep_the_order_of_layers(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c"), (1, 3, None)], "k int, i int, v string")
    assert {r.k: r.v for r in reassembly.arrays_by_layer(df, ["k"], ["i"], ["v"]).collect()} == {1: ["a", "b", None], 2: ["c"]}


def test_the_merge_numbers_every_packet(spark):
    from wirelake.plans import queries as Q

    rows = [(i * 7919 % 3000, i % 8, i) for i in range(5000)]
    store = Store(spark, {"packets": spark.createDataFrame(rows, "ts long, session_id long, packet_id long").withColumn("components", F.lit(0).cast("long"))})
    got = [(r.n, r.ts, r.session_id, r.packet_id) for r in reassembly.merge_order(store).collect()]
    assert sorted(got) == [(n, *r) for n, r in enumerate(sorted(rows), 1)]
    events = "/root/testdata/sf0.001"
    if os.path.isdir(events):
        assert Q.QUERIES["merge_captures"](spark, events).count() == spark.read.parquet(f"{events}/events.parquet").count() > 500


def http_packets(spark, parts, session=1):
    """A flow: handshake, then (from the client?, payload) of each packet."""
    rows = [(session, 0, True, 2, b""), (session, 1, False, 18, b"")] + [(session, 2 + i, c, 24, p) for i, (c, p) in enumerate(parts)]
    return spark.createDataFrame([(s, i, bytearray(b"c" * 16 if c else b"s" * 16), bytearray(b"s" * 16 if c else b"c" * 16), 4000 if c else 80, 80 if c else 4000, f, bytearray(p)) for s, i, c, f, p in rows], "session_id long, packet_id long, src_ip binary, dst_ip binary, src_port int, dst_port int, flags int, payload binary")


def test_http_host_after_many_packets(spark):
    head = b"GET /far HTTP/1.1\r\nCookie: " + b"x" * 300 + b"\r\nhOsT:  far.example \r\n\r\n"
    cases = [[(True, head[i : i + 1]) for i in range(len(head))], [(True, head[:30])] + [(False, b"chatter\n")] * 100 + [(True, b"\nHost: late\r\n")], [(True, b"GET / HTTP/1.0\r\n")] + [(True, b"A: 1\r\n")] * 70 + [(True, b"\r\n")], [(True, b"GET /end HTTP/1.1\r\nHost:"), (True, b"cut")], [(True, head), (True, b"\nHost: second\n")]]
    packets = http_packets(spark, cases[0])
    for n, c in enumerate(cases[1:], 2):
        packets = packets.unionByName(http_packets(spark, c, n))
    rows = {r.session_id: (r.method, r.host, r.path) for r in flows.http_streams(packets, flows.streams(packets)).collect()}
    assert rows == {1: ("GET", "far.example", "/far"), 2: ("GET", "late", "/far"), 3: ("GET", "", "/"), 4: ("GET", "cut", "/end"), 5: ("GET", "far.example", "/far")}


def test_the_stream_queries_have_no_cap(spark, monkeypatch):
    from wirelake.plans import queries as Q

    n = 1100
    ip = F.lit(bytearray(b"\0" * 16))
    streams = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.col("id").cast("string").alias("stream_id"), F.lit("http").alias("l7_proto"), ip.alias("src_ip"), ip.alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(80).alias("dst_port"), F.lit(True).alias("is_complete"), F.col("id").alias("first_packet_id"), F.col("id").alias("last_packet_id"), F.lit(3).alias("packet_count"), F.lit(9).alias("byte_count"))
    http = streams.select("session_id", "stream_id", F.lit("GET").alias("method"), F.lit("h").alias("host"), F.lit("/").alias("path"))
    packets = streams.select("session_id", F.col("first_packet_id").alias("packet_id"), F.lit(5).cast("long").alias("ts"))
    store = Store(spark, {"stream_captures": streams, "stream_http": http, "packets": packets})
    monkeypatch.setattr(Q, "_stream_store", lambda spark, d: store)
    assert Q.QUERIES["streams_http"](spark, "").count() == Q.QUERIES["streams_time_filter"](spark, "").count() == n
    assert flows.list_streams(store, limit=1000).count() == 1000
