import random
import struct

import pytest

from tests import packets as P
from wirelake.operators import codec
from wirelake.registry import COMPONENTS, RAW_FRAME, TRUNCATED


def names(bits):
    return {n for n, c in COMPONENTS.items() if bits & c.mask}


CASES = {
    "udp": (1, P.eth(0x0800, P.ip4(P.udp(b"x" * 18))), ["ethernet", "ipv4", "udp"], 18),
    "options": (1, P.eth(0x0800, P.ip4(P.udp(b"x"), options=b"\x94\x04\0\0")), ["ethernet", "ipv4", "udp"], 1),
    "stacked tags": (1, P.eth(0x8100, struct.pack(">HH", 10, 0x8100) + struct.pack(">HH", 0xE014, 0x0800) + P.ip4(P.udp(b"\x9a" * 18))), ["ethernet", "dot1q", "dot1q", "ipv4", "udp"], 18),
    "tcp6": (1, P.eth(0x86DD, P.ip6(P.tcp(b"hi", options=b"\x01\x01\x08\x0a" + b"\0" * 8), 6)), ["ethernet", "ipv6", "tcp"], 2),
    "ext": (1, P.eth(0x86DD, P.ip6(bytes([60, 0]) + b"\0" * 6 + bytes([17, 0]) + b"\0" * 6 + P.udp(b"z"), 0)), ["ethernet", "ipv6", "ipv6_ext", "ipv6_ext", "udp"], 1),
    "fragment": (1, P.eth(0x0800, P.ip4(b"abcdefgh", frag=0x2000)), ["ethernet", "ipv4"], 8),
    "arp": (1, P.eth(0x0806, P.arp() + b"\0" * 18), ["ethernet", "arp"], 18),
    "short arp": (1, P.eth(0x0806, b"abc"), ["ethernet"], 3),
    "icmp": (1, P.eth(0x0800, P.ip4(struct.pack(">BBHHH", 8, 0, 1, 2, 3) + b"ping", 1)), ["ethernet", "ipv4", "icmpv4"], 4),
    "icmp6": (1, P.eth(0x86DD, P.ip6(struct.pack(">BBH", 135, 0, 9) + b"body", 58)), ["ethernet", "ipv6", "icmpv6"], 4),
    "gre": (1, P.eth(0x0800, P.ip4(struct.pack(">HHHHII", 0xB000, 0x86DD, 7, 0, 9, 11) + P.ip6(P.udp(b"in")), 47)), ["ethernet", "ipv4", "gre", "ipv6", "udp"], 2),
    "ip in ip": (1, P.eth(0x0800, P.ip4(P.ip4(P.udp(b"q")), 4)), ["ethernet", "ipv4", "ipv4", "udp"], 1),
    "dns": (1, P.eth(0x0800, P.ip4(P.udp(P.dns(answers=[(1, bytes([1, 2, 3, 4]))]), 5353, 53))), ["ethernet", "ipv4", "udp", "dns"], 0),
    "dns too short": (1, P.eth(0x0800, P.ip4(P.udp(b"abc", 5353, 53))), ["ethernet", "ipv4", "udp"], 3),
    "ntp": (1, P.eth(0x0800, P.ip4(P.udp(bytes([0x23]) + bytes(range(47)), 123, 123))), ["ethernet", "ipv4", "udp", "ntp"], 0),
    "sll": (113, b"\0\0\0\x01\0\x06" + P.MAC_A + b"\0\0\x08\0" + P.ip4(P.udp(b"s")), ["linuxsll", "ipv4", "udp"], 1),
    "raw ip": (101, P.ip4(P.udp(b"r")), ["ipv4", "udp"], 1),
    "short udp": (1, P.eth(0x0800, P.ip4(b"\0\x01\0\x02")), ["ethernet", "ipv4"], 4),
    "short ipv4": (1, P.eth(0x0800, b"E" + b"\0" * 9), ["ethernet"], 10),
    "length field": (1, P.eth(38, b"x" * 38), ["ethernet"], 38),
}


@pytest.mark.parametrize("name", CASES)
def test_layers_and_round_trip(name):
    linktype, frame, want, tail = CASES[name]
    bits, layers, payload = codec.dissect(linktype, frame, len(frame))
    assert [n for n, _ in layers] == want and len(payload) == tail
    assert names(bits) == set(want) and not bits & TRUNCATED
    assert codec.rebuild(bits, layers, payload) == frame


def test_unknown_link_type_and_truncation():
    bits, layers, payload = codec.dissect(147, b"abc", 13)
    assert bits == RAW_FRAME | TRUNCATED and layers == [] and payload == b"abc"
    assert codec.rebuild(bits, layers, payload) == b"abc"
    assert codec.dissect(101, b"", 0)[0] == RAW_FRAME


def test_dns_fields():
    frame = CASES["dns"][1]
    row = dict(codec.dissect(1, frame, len(frame))[1])["dns"]
    assert row["questions_name"] == ["www.example"] and row["answers_ip"] == ["1.2.3.4"] and row["answers_ttl"] == [300]
    assert (row["qr"], row["rcode"], row["flags"]) == (1, 0, 0b0011)


def test_gre_fields():
    frame = CASES["gre"][1]
    row = dict(codec.dissect(1, frame, len(frame))[1])["gre"]
    assert (row["protocol"], row["flags"], row["checksum"], row["key"], row["seq"]) == (0x86DD, 7, 7, 9, 11)


def test_missing_layer_is_noticed():
    bits, layers, payload = codec.dissect(1, CASES["udp"][1], 100)
    with pytest.raises(ValueError):
        codec.rebuild(bits, layers[:-1], payload)


def test_any_bytes_come_back():
    rnd = random.Random(2)
    base = [c[1] for c in CASES.values()]
    for _ in range(3000):
        frame = bytearray(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            frame[rnd.randrange(len(frame))] = rnd.randrange(256)
        frame = bytes(frame[: rnd.randint(0, len(frame))])
        linktype = rnd.choice([1, 1, 1, 101, 113, 228, 229])
        bits, layers, payload = codec.dissect(linktype, frame, len(frame))
        assert codec.rebuild(bits, layers, payload) == frame


def test_columns_at_once_and_one_by_one_agree():
    """Whole, damaged, cut, empty and null frames of all cases through both ways."""
    import pyarrow as pa

    rnd, rows = random.Random(7), []
    for i in range(3000):
        linktype, frame, *_ = rnd.choice(list(CASES.values()))
        f = bytearray(frame)
        for _ in range(rnd.randrange(4)):
            f[rnd.randrange(len(f))] = rnd.randrange(256)
        f = f[: rnd.randrange(len(f) + 1)] if rnd.random() < 0.3 else f
        rows.append({"session_id": None, "packet_id": i, "ts": 0, "orig_len": rnd.choice([None, 0, 40, 2000]), "linktype": rnd.choice([linktype, linktype, None]), "frame": None if rnd.random() < 0.02 else bytes(f)})
    kind = pa.schema([("session_id", pa.decimal128(20, 0)), ("packet_id", pa.int64()), ("ts", pa.int64()), ("orig_len", pa.int64()), ("linktype", pa.int64()), ("frame", pa.binary())])
    batch = pa.RecordBatch.from_pylist(rows, schema=kind).slice(10)
    for row, got in zip(batch.to_pylist(), codec._dissected(batch, codec._arrow(codec.DISSECTED)).to_pylist(), strict=True):
        frame = row["frame"] or b""
        bits, layers, payload = codec.dissect(row["linktype"], frame, max(row["orig_len"] or 0, len(frame)))
        assert (got["components"], got["payload"], got["incl_len"]) == (bits, payload, len(frame))
        flat = sorted(((x.pop("layer_index"), n, x) for n in codec.LAYERS for x in got[n] or ()), key=lambda x: x[0])
        assert [(n, x) for _, n, x in flat] == layers
    assert codec._dissected(batch.slice(0, 0), codec._arrow(codec.DISSECTED)).num_rows == 0


def test_native_headers_give_the_frames_back(spark):
    """Every case through dissect_frames and rebuild_frames; wrong bits and columns out of range say why."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    rows = [(Decimal(2**64 - 1), i, 5, len(f) + i, linktype, bytes(f)) for i, (linktype, f, *_) in enumerate(CASES.values())]
    df = spark.createDataFrame(rows, "session_id decimal(20,0), packet_id long, ts long, orig_len long, linktype long, frame binary")
    found = codec.dissect_frames(df)
    back = {r.packet_id: r for r in codec.rebuild_frames(found).collect()}
    assert {i: (bytes(back[i].frame), back[i].orig_len, back[i].error) for i in back} == {r[1]: (r[5], r[3], None) for r in rows}
    wrong = codec.rebuild_frames(found.withColumn("components", F.lit(2 | 512).cast("long"))).where("packet_id = 0").first()
    assert wrong.frame is None and "presence bits" in wrong.error
    none = codec.rebuild_frames(found.withColumn("ethernet", F.transform("ethernet", lambda x: x.withField("type", F.lit(70000))))).where("packet_id = 0").first()
    assert none.frame is None and "header" in none.error
