import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F

from tests import packets as P
from wirelake.operators import codec, flows, ingest, migrations, retention, sanitize
from wirelake.plans import search as S
from wirelake.plans.store import ParquetStore
from wirelake.service import Service, ServiceError
from wirelake.sources import pcap

T = 1_700_000_000_000_000_000


def write(path, data):
    path.write_bytes(data)
    return str(path)


def mixed(offset=0):
    frames = [f for _, f, *_ in [(0, x) for x in (P.eth(0x0800, P.ip4(P.udp(b"x" * 30))), P.eth(0x0806, P.arp()), P.eth(0x0800, P.ip4(P.udp(P.dns(answers=[(1, b"\x01\x02\x03\x04")]), 999, 53))), P.eth(0x8100, b"\0\x05\x81\0\0\x06\x08\0" + P.ip4(P.udp(b"v"))), b"short")]]
    return [(T + offset + i * 2_000_000_000 + 123000, f) for i, f in enumerate(frames)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("caps")
    a = write(d / "a.pcap", P.pcap(mixed()))
    b = write(d / "b.pcap", P.pcap(P.http_flow(T + 500_000_000) + [(T + 90_000_000_000_000, P.eth(0x0806, P.arp(2)), 80)], ">", nano=True))
    out = ParquetStore(spark, str(tmp_path_factory.mktemp("store")))
    got = ingest.ingest(out, pcap.read_files(spark, [a, b]), sensor="s1")
    assert (got.captures, got.packets, got.streams) == (2, 13, 1)
    out.files = (a, b)
    return out


def test_each_capture_comes_back_byte_for_byte(store, tmp_path):
    for path in store.files:
        data = open(path, "rb").read()
        session = int.from_bytes(hashlib.sha256(os.path.basename(path).encode() + b"\0" + data).digest()[:8], "big")
        out = tmp_path / "out.pcap"
        ingest.export(store, str(out), scope=S.Scope(sessions=(session,)))
        assert out.read_bytes() == data


def test_captures_merge_by_time(store, tmp_path):
    out = tmp_path / "all.pcap"
    assert ingest.export(store, str(out)) == 13
    times = [f.ts for f in pcap.frames(out.read_bytes())]
    assert times == sorted(times)
    assert ingest.export(store, str(tmp_path / "some.pcap"), "arp") == 2


def test_the_same_file_again_changes_nothing(spark, store):
    before = store.table("packets").count()
    ingest.ingest(store, pcap.read_files(spark, [store.files[0]]), sensor="again")
    assert store.table("packets").count() == before and store.table("dot1q").count() == 2
    assert {r.sensor for r in store.table("captures").collect()} == {"again", "s1"}
    store.compact("packets")
    assert store.table("packets").count() == before


def test_streams_and_http(store):
    rows = flows.list_streams(store).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.l7_proto, r.src_ip, r.dst_ip, r.src_port, r.dst_port) == ("http", "10.0.0.1", "93.184.216.34", 40000, 80)
    assert (r.method, r.host, r.path, r.packet_count) == ("GET", "www.example.com", "/index.html", 7)


def test_service(store):
    s = Service(store)
    found = s.search("tcp.port = 80", ("tcp",), limit=3)
    assert found["count"] == 3 and found["total"] == 7 and found["rows"][0]["sensor"] == "s1"
    assert sum(x["count"] for x in s.histogram("", breakdown="proto")) == 13
    session = found["rows"][0]["session_id"]
    assert s.packet(session, 0)["proto"] == "ethernet/ipv4/tcp" and s.packet(session, 0)["tcp"]["tcp_flags"] == 2
    assert bytes.fromhex(s.frame(session, 0)) == P.http_flow(T + 500_000_000)[0][1]
    assert s.streams()["total"] == 1 and len(s.captures()) == 2
    assert s.execute("SELECT count(*) AS n FROM dns")["rows"] == [{"n": 1}]
    for call, status in ((lambda: s.search("tcp.port ="), 422), (lambda: s.search("nothing.x = 1"), 422), (lambda: s.packet(session, 999), 404), (lambda: s.packet("x", 1), 400)):
        with pytest.raises(ServiceError) as e:
            call()
        assert e.value.status == status


def test_reencode_finds_layers_that_an_older_reader_left(spark, store, tmp_path):
    other, first = ParquetStore(spark, str(tmp_path / "old")), ParquetStore(spark, str(tmp_path / "first"))
    frame = P.eth(0x0800, P.ip4(P.udp(b"later")))
    path = write(tmp_path / "c.pcap", P.pcap([(T, frame)]))
    ingest.ingest(first, pcap.read_files(spark, [path]))
    p = first.table("packets")
    other.append("captures", first.table("captures"), 1)
    other.append("ethernet", first.table("ethernet"), 1)
    old = p.withColumn("components", F.lit(2).cast("long")).withColumn("payload", F.lit(frame[14:]))
    other.append("packets", old, ingest.next_seq(other))
    got = ingest.reencode(other)
    assert (got.candidates, got.upgraded) == (1, 1)
    assert other.table("packets").first().components == 2 | 16 | 1024


def test_time_bounds_reach_the_scan(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path / "days"))
    paths = [write(tmp_path / f"{d}.pcap", P.pcap(mixed(d * 100_000 * 10**9))) for d in range(3)]
    ingest.ingest(s, pcap.read_files(spark, paths))
    ingest.ingest(s, pcap.read_files(spark, paths[:1]))  # a second sequence number
    bound = s.table("packets").agg(F.max("ts")).first()[0] - 50_000 * 10**9
    found = S.matching(s, "", S.Scope(start=bound))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ", plan)
    assert "day" in scan[1] and "GreaterThanOrEqual(ts" in scan[2]
    assert found.count() == 5 and s.table("packets").count() == 15


def test_retention_drops_old_days_and_orphans(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path / "r"))
    old = write(tmp_path / "old.pcap", P.pcap(mixed()))
    new = write(tmp_path / "new.pcap", P.pcap(mixed(200_000 * 10**9)))
    ingest.ingest(s, pcap.read_files(spark, [old, new]))
    size = retention.stored_bytes(s)
    assert retention.enforce(s, size).dropped_days == []
    report = retention.enforce(s, size - 1)
    assert len(report.dropped_days) == 1 and report.dropped_sessions == 1 and report.after < size
    assert s.table("captures").count() == 1 and s.table("packets").count() == 5
    left = s.table("captures").first().session_id
    kept = retention.enforce(s, 1, protected=(int(left),))
    assert len(kept.kept_days) == 1 and s.table("packets").count() == 5


def test_sanitized_frames(spark, tmp_path):
    seed = bytes(range(32))
    frame = P.eth(0x0800, P.ip4(P.tcp(b"data"), 6, "8.8.8.8", "10.0.0.1"))
    path = write(tmp_path / "s.pcap", P.pcap([(T, frame)]))
    rows = sanitize.sanitize(pcap.read_frames(pcap.read_files(spark, [path])), seed)
    new = bytes(rows.first().frame)
    layers = dict(codec.dissect(1, new, len(new))[1])
    assert layers["ipv4"]["dst"] == 0x0A000001 and layers["ipv4"]["src"] >> 24 == 8 and layers["ipv4"]["src"] != 0x08080808
    assert sanitize.checksum(new[14:34]) == 0
    assert sanitize.transport_checksum(new[26:30], new[30:34], 6, new[34:]) == 0
    assert new[-4:] == b"data" and len(new) == len(frame)


def test_migrations(spark, tmp_path):
    s = ParquetStore(spark, str(tmp_path / "m"))
    seen = []
    known = {"002_b": lambda st: seen.append("b"), "001_a": "-- nothing\n;SELECT 1;\n"}
    assert migrations.init_schema(s, known) == ["001_a", "002_b"] and seen == ["b"]
    assert migrations.init_schema(s, known) == [] and migrations.last_migration(s) == "002_b"
    with pytest.raises(migrations.NewerStore):
        migrations.migrate(s, {"001_a": known["001_a"]})
    assert s.table("tcp").count() == 0


def test_sizes():
    good = {"42": 42, "42B": 42, "336b": 42, "1K": 1024, "2M": 2 << 20, "1G": 1 << 30, "1MB": 10**6, "1MiB": 1 << 20, "8Kb": 1000, "1.5K": 1536}
    assert {k: retention.parse_size(k) for k in good} == good
    for bad in ("", "x", "-1", "7b", "1iB", "1.3B", "1Ki"):
        with pytest.raises(ValueError):
            retention.parse_size(bad)


def test_retry_waits_and_gives_up_at_once_on_errors_of_the_plan():
    calls = []

    def act(error, times):
        calls.append(1)
        if len(calls) <= times:
            raise error
        return "done"

    assert ingest.retry(lambda: act(OSError("store"), 2), first=0.001) == "done" and len(calls) == 3
    calls.clear()
    with pytest.raises(KeyError):
        ingest.retry(lambda: act(KeyError("table"), 9), first=0.001)
    assert len(calls) == 1
