from pyspark.sql import functions as F

from tests import packets as P
from wirelake.operators import codec, ingest
from wirelake.plans.store import ParquetStore
from wirelake.sources import pcap
from wirelake.streaming import flows, landing

T = 1_700_000_000_000_000_000


def test_landing_folder_is_drained_once(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    store = ParquetStore(spark, str(tmp_path / "store"))
    (land / "a.pcap").write_bytes(P.pcap([(T, P.eth(0x0806, P.arp()))]))
    (land / "notes.txt").write_text("no capture")
    for want in (1, 3):
        q = landing.watch(spark, str(land), store, str(tmp_path / "cp"), trigger={"availableNow": True})
        q.awaitTermination(120)
        assert store.table("packets").count() == want
        (land / "b.pcapng").write_bytes(P.pcapng([(T, P.eth(0x0806, P.arp())), (T + 1, b"xx")]))


def test_flows_are_given_out_when_they_fall_silent(spark, tmp_path):
    source = tmp_path / "in"
    frames = P.http_flow(T) + P.http_flow(T + 1_000_000_000, port=40001)[:3] + [(T + 600 * 10**9, f) for _, f in P.http_flow(T, port=5)[:1]] + [(T + 1200 * 10**9, f) for _, f in P.http_flow(T, port=6)[:1]]
    path = tmp_path / "a.pcap"
    path.write_bytes(P.pcap(frames))
    rows = pcap.read_frames(pcap.read_files(spark, [str(path)]))
    d = codec.dissect_frames(rows)
    tcp = ingest.tcp_of(d).join(d.select("session_id", "packet_id", "ts"), ["session_id", "packet_id"]).withColumn("session_id", F.col("session_id").cast("decimal(20,0)"))
    tcp.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(tcp.schema).parquet(str(source))
    late = tmp_path / "late"
    q = flows.track_flows(stream).writeStream.format("memory").queryName("flows_out").outputMode("append").option("checkpointLocation", str(late)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.table("flows_out").collect()
    assert [(r.l7_proto, r.src_port, r.packet_count, r.first_packet_id, r.last_packet_id) for r in got] == [("http", 40000, 7, 0, 6)]


def test_rolling_histogram(spark, tmp_path):
    rows = spark.createDataFrame([(T + i * 30 * 10**9, 100) for i in range(12)], "ts long, incl_len long")
    rows.write.parquet(str(tmp_path / "p"))
    q = flows.rolling_histogram(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p"))).writeStream.format("memory").queryName("hist_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.table("hist_out").collect()
    assert out and all(r["count"] <= 2 and r.bytes == 100 * r["count"] for r in out)
