import pytest

from tests import packets as P
from wirelake.sources import pcap

T = 1_700_000_000_123_456_789


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("nano", [False, True])
def test_all_four_headers(order, nano):
    data = P.pcap([(T, b"abc", 10)], order, nano, linktype=113, snaplen=99)
    m = pcap.parse_header(data)
    assert (m.endianness, m.time_res, m.snaplen, m.linktype) == ("le" if order == "<" else "be", "ns" if nano else "us", 99, 113)
    (f,) = pcap.frames(data)
    assert f.ts == (T if nano else T // 1000 * 1000) and (f.orig_len, f.data) == (10, b"abc")


def test_pcapng_and_errors():
    for res in (6, 9):
        (f,) = pcap.frames(P.pcapng([(T, b"abcd")], tsresol=res))
        assert f.ts == T // 10 ** (9 - res) * 10 ** (9 - res) and f.data == b"abcd"
    with pytest.raises(pcap.CaptureError):
        pcap.parse_header(b"not a capture file at all")
    with pytest.raises(pcap.CaptureError):
        list(pcap.frames(P.pcap([(T, b"x" * 100)]), most=50))
    assert len(list(pcap.frames(P.pcap([(T, b"abc"), (T, b"defgh")])[:-2]))) == 1


def test_record_edges():
    assert pcap.record_bytes(-5, b"ab", 1) == b"\0" * 8 + b"\x02\0\0\0\x02\0\0\0ab"
    assert pcap.record_bytes(2**34 * 10**9, b"", 0)[:4] == b"\xff" * 4


def test_paths(tmp_path):
    a, b = tmp_path / "a.pcap", tmp_path / "b.pcap"
    a.write_bytes(b"")
    b.write_bytes(b"")
    assert pcap.resolve([str(b), str(tmp_path / "*.pcap")]) == [str(b), str(a)]
    assert pcap.resolve(["-"]) == ["-"]
    with pytest.raises(ValueError):
        pcap.resolve(["-", str(a)])
    with pytest.raises(FileNotFoundError):
        pcap.resolve([str(tmp_path / "none*")])


def test_data_source_splits_large_files(spark, tmp_path):
    path = tmp_path / "x.pcap"
    path.write_bytes(P.pcap([(T + i, bytes([i % 256]) * (i % 50)) for i in range(500)]))
    pcap.register(spark)
    one = spark.read.format("pcap").load(str(path))
    many = spark.read.format("pcap").option("splitBytes", 2000).load(str(path))
    assert many.rdd.getNumPartitions() > 5
    rows = [tuple(r) for r in one.orderBy("packet_id").collect()]
    assert rows == [tuple(r) for r in many.orderBy("packet_id").collect()] and len(rows) == 500 and rows[7][5] == b"\x07" * 7
