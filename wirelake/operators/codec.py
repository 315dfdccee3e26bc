"""Frames to layers and back, byte for byte.

A frame is walked from its link type down. The walk stops before the first layer that is unknown, cut short, or holds bits that its columns don't keep
(so that it would not be rebuilt exactly); what remains is the packet's payload. So a packet's layers plus its payload always
give the captured bytes. Formats: RFC 791, 8200, 9293, 768, 826, 792, 4443, 1035, 5905, 2784, 2890 and IEEE 802.1Q.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import COMPONENTS, KEYS, RAW_FRAME, SESSION, TRUNCATED

ETHERNET, RAW, SLL, IPV4_LINK, IPV6_LINK = 1, 101, 113, 228, 229
VLAN = (0x8100, 0x88A8)
VERSION = 1
Layer = tuple[str, dict, bytes]


class Stop(Exception):
    """The bytes aren't this layer."""


def _need(b: bytes, n: int) -> None:
    if len(b) < n:
        raise Stop


_S_BBBBIIIQQQQ = struct.Struct(">BBbbIIIQQQQ")
_S_BBH = struct.Struct(">BBH")
_S_BBHHH = struct.Struct(">BBHHH")
_S_BBHHHBBHII = struct.Struct(">BBHHHBBHII")
_S_H = struct.Struct(">H")
_S_HH = struct.Struct(">HH")
_S_HHBBH = struct.Struct(">HHBBH")
_S_HHHH = struct.Struct(">HHHH")
_S_HHHHHH = struct.Struct(">HHHHHH")
_S_HHIH = struct.Struct(">HHIH")
_S_HHIIHHHH = struct.Struct(">HHIIHHHH")
_S_I = struct.Struct(">I")
_S_IHBB = struct.Struct(">IHBB")


def _ethernet(b: bytes):
    _need(b, 14)
    (kind,) = _S_H.unpack_from(b, 12)
    typed = kind >= 0x600
    return {"src": b[6:12], "dst": b[:6], "type": kind if typed else 0, "len": 0 if typed else kind}, 14, ("ether", kind if typed else None)


def _dot1q(b: bytes):
    _need(b, 4)
    tag, kind = _S_HH.unpack_from(b)
    return {"priority": tag >> 13, "drop_eligible": tag >> 12 & 1, "vlan_id": tag & 0xFFF, "type": kind}, 4, ("ether", kind)


def _linuxsll(b: bytes):
    _need(b, 16)
    return {"l2_len": 16, "l2_hdr_raw": b[:16]}, 16, ("ether", _S_H.unpack_from(b, 14)[0])


def _options_fit(o: bytes) -> bool:
    at = 0
    while at < len(o):
        if o[at] == 0:
            return True
        if o[at] == 1:
            at += 1
            continue
        if at + 1 >= len(o) or o[at + 1] < 2 or at + o[at + 1] > len(o):
            return False
        at += o[at + 1]
    return True


def _ipv4(b: bytes):
    _need(b, 20)
    first, tos, total, ident, frag, ttl, proto, check, src, dst = _S_BBHHHBBHII.unpack_from(b)
    size = (first & 15) * 4
    if first >> 4 != 4 or size < 20:
        raise Stop
    _need(b, size)
    if not _options_fit(b[20:size]):
        raise Stop
    row = {"protocol": proto, "src": src, "dst": dst, "ihl": first & 15, "tos": tos, "total_len": total, "id": ident, "flags": frag >> 13, "frag_offset": frag & 0x1FFF, "ttl": ttl, "hdr_checksum": check, "options_raw": b[20:size]}
    whole = not frag & 0x1FFF and not frag >> 13 & 1
    return row, size, ("ip", proto) if whole else None


def _ipv6(b: bytes):
    _need(b, 40)
    first, size, follow, hops = _S_IHBB.unpack_from(b)
    if first >> 28 != 6:
        raise Stop
    return {"protocol": follow, "src": b[8:24], "dst": b[24:40], "payload_len": size, "hop_limit": hops, "flow_label": first & 0xFFFFF, "traffic_class": first >> 20 & 0xFF}, 40, ("ip6", follow)


def _ipv6_ext(b: bytes, kind: int):
    _need(b, 8)
    size = 8 if kind == 44 else (b[1] + 1) * 8
    _need(b, size)
    fragment = kind == 44 and _S_H.unpack_from(b, 2)[0] & 0xFFF9
    return {"ext_type": kind, "ext_raw": b[:size]}, size, None if fragment else ("ip6", b[0])


def _tcp(b: bytes):
    _need(b, 20)
    src, dst, seq, ack, bits, window, check, urgent = _S_HHIIHHHH.unpack_from(b)
    size = (bits >> 12) * 4
    if size < 20 or bits & 0x0E00:
        raise Stop
    _need(b, size)
    return {"src": src, "dst": dst, "seq": seq, "ack": ack, "data_offset": bits >> 12, "flags": bits & 0x1FF, "window": window, "checksum": check, "urgent": urgent, "options_raw": b[20:size]}, size, None


def _udp(b: bytes):
    _need(b, 8)
    src, dst, size, check = _S_HHHH.unpack_from(b)
    return {"src": src, "dst": dst, "length": size, "checksum": check}, 8, ("dns",) if 53 in (src, dst) else ("ntp",) if 123 in (src, dst) else None


def _icmpv4(b: bytes):
    _need(b, 8)
    kind, code, check, ident, seq = _S_BBHHH.unpack_from(b)
    return {"type": kind, "code": code, "checksum": check, "id": ident, "seq": seq}, 8, None


def _icmpv6(b: bytes):
    _need(b, 4)
    kind, code, check = _S_BBH.unpack_from(b)
    return {"type": kind, "code": code, "checksum": check}, 4, None


def _arp(b: bytes):
    _need(b, 28)
    hard, proto, hlen, plen, op = _S_HHBBH.unpack_from(b)
    if (hard, proto, hlen, plen) != (1, 0x0800, 6, 4):
        raise Stop
    return {"arp_op": op, "sender_mac": b[8:14], "sender_ip": _S_I.unpack_from(b, 14)[0], "target_mac": b[18:24], "target_ip": _S_I.unpack_from(b, 24)[0]}, 28, None


#: GRE's optional words and the bits that announce them. Fixed values.
GRE_CHECKSUM, GRE_KEY, GRE_SEQ = 0x8000, 0x2000, 0x1000


def _gre(b: bytes):
    _need(b, 4)
    bits, proto = _S_HH.unpack_from(b)
    row, at = {"protocol": proto, "flags": 0, "version": bits & 7, "checksum": 0, "key": 0, "seq": 0}, 4
    for i, (bit, name) in enumerate(((GRE_CHECKSUM, "checksum"), (GRE_KEY, "key"), (GRE_SEQ, "seq"))):
        if bits & bit:
            _need(b, at + 4)
            row["flags"] |= 1 << i
            row[name] = struct.unpack_from(">H" if name == "checksum" else ">I", b, at)[0]
            at += 4
    if _gre_bytes(row) != b[:at]:
        raise Stop
    return row, at, ("ether", proto)


def _name(b: bytes, at: int) -> tuple[str, int]:
    """A domain name and where it ends; labels are bytes in Latin-1."""
    out, end, jumps = [], None, 0
    while True:
        _need(b, at + 1)
        n = b[at]
        if n >= 0xC0:
            _need(b, at + 2)
            end = at + 2 if end is None else end
            at = (n & 0x3F) << 8 | b[at + 1]
            jumps += 1
            if jumps > 64:
                raise Stop
            continue
        if n & 0xC0:
            raise Stop
        if n == 0:
            return ".".join(out), at + 1 if end is None else end
        _need(b, at + 1 + n)
        out.append(b[at + 1 : at + 1 + n].decode("latin-1"))
        at += 1 + n


SECTIONS = ("answers", "authority", "additional")


def _dns(b: bytes):
    _need(b, 12)
    ident, bits, *counts = _S_HHHHHH.unpack_from(b)
    # Z, then AA, TC, RD, RA from high to low
    flags = (bits >> 4 & 7) << 4 | (bits >> 10 & 1) << 3 | (bits >> 9 & 1) << 2 | (bits >> 8 & 1) << 1 | bits >> 7 & 1
    row = {"raw_len": len(b), "transaction_id": ident, "qr": bits >> 15, "opcode": bits >> 11 & 15, "rcode": bits & 15, "flags": flags, "an_count": counts[1], "ns_count": counts[2], "ar_count": counts[3], "dns_raw": b}
    row |= {f"questions_{k}": [] for k in ("name", "type", "class")} | {f"{s}_{k}": [] for s in SECTIONS for k in ("name", "type", "class", "ttl", "rdata")} | {"answers_ip": []}
    at = 12
    for _ in range(counts[0]):
        name, at = _name(b, at)
        _need(b, at + 4)
        for k, v in zip(("name", "type", "class"), (name, *_S_HH.unpack_from(b, at)), strict=True):
            row[f"questions_{k}"].append(v)
        at += 4
    for s, n in zip(SECTIONS, counts[1:], strict=True):
        for _ in range(n):
            name, at = _name(b, at)
            _need(b, at + 10)
            kind, cls, ttl, size = _S_HHIH.unpack_from(b, at)
            _need(b, at + 10 + size)
            data = b[at + 10 : at + 10 + size]
            for k, v in zip(("name", "type", "class", "ttl", "rdata"), (name, kind, cls, ttl, data), strict=True):
                row[f"{s}_{k}"].append(v)
            if s == "answers":
                row["answers_ip"].append(str(ipaddress.ip_address(data)) if (kind, size) in ((1, 4), (28, 16)) else "")
            at += 10 + size
    return row, len(b), None


def _ntp(b: bytes):
    _need(b, 48)
    first, stratum, poll, precision, delay, spread, ref, *stamps = _S_BBBBIIIQQQQ.unpack_from(b)
    row = {"leap_indicator": first >> 6, "version": first >> 3 & 7, "mode": first & 7, "stratum": stratum, "poll": poll, "precision": precision, "root_delay": delay, "root_dispersion": spread, "reference_id": ref, "ntp_raw": b}
    return row | dict(zip(("reference_ts", "origin_ts", "receive_ts", "transmit_ts"), stamps, strict=True)), len(b), None


_READ: dict[str, Callable] = {"ethernet": _ethernet, "dot1q": _dot1q, "linuxsll": _linuxsll, "ipv4": _ipv4, "ipv6": _ipv6, "tcp": _tcp, "udp": _udp, "dns": _dns, "ntp": _ntp, "arp": _arp, "icmpv4": _icmpv4, "icmpv6": _icmpv6, "gre": _gre}


def _gre_bytes(r: dict) -> bytes:
    bits = r["version"]
    tail = b""
    for i, (bit, name) in enumerate(((GRE_CHECKSUM, "checksum"), (GRE_KEY, "key"), (GRE_SEQ, "seq"))):
        if r["flags"] >> i & 1:
            bits |= bit
            tail += struct.pack(">HH", r[name], 0) if name == "checksum" else struct.pack(">I", r[name])
    return struct.pack(">HH", bits, r["protocol"]) + tail


_BUILD: dict[str, Callable[[dict], bytes]] = {
    "ethernet": lambda r: r["dst"] + r["src"] + struct.pack(">H", r["type"] or r["len"]),
    "dot1q": lambda r: struct.pack(">HH", r["priority"] << 13 | r["drop_eligible"] << 12 | r["vlan_id"], r["type"]),
    "linuxsll": lambda r: r["l2_hdr_raw"],
    "ipv4": lambda r: struct.pack(">BBHHHBBHII", 4 << 4 | r["ihl"], r["tos"], r["total_len"], r["id"], r["flags"] << 13 | r["frag_offset"], r["ttl"], r["protocol"], r["hdr_checksum"], r["src"], r["dst"]) + r["options_raw"],
    "ipv6": lambda r: struct.pack(">IHBB", 6 << 28 | r["traffic_class"] << 20 | r["flow_label"], r["payload_len"], r["protocol"], r["hop_limit"]) + r["src"] + r["dst"],
    "ipv6_ext": lambda r: r["ext_raw"],
    "tcp": lambda r: struct.pack(">HHIIHHHH", r["src"], r["dst"], r["seq"], r["ack"], r["data_offset"] << 12 | r["flags"], r["window"], r["checksum"], r["urgent"]) + r["options_raw"],
    "udp": lambda r: struct.pack(">HHHH", r["src"], r["dst"], r["length"], r["checksum"]),
    "dns": lambda r: r["dns_raw"],
    "ntp": lambda r: r["ntp_raw"],
    "arp": lambda r: struct.pack(">HHBBH", 1, 0x0800, 6, 4, r["arp_op"]) + r["sender_mac"] + struct.pack(">I", r["sender_ip"]) + r["target_mac"] + struct.pack(">I", r["target_ip"]),
    "icmpv4": lambda r: struct.pack(">BBHHH", r["type"], r["code"], r["checksum"], r["id"], r["seq"]),
    "icmpv6": lambda r: struct.pack(">BBH", r["type"], r["code"], r["checksum"]),
    "gre": _gre_bytes,
}

#: What follows a layer. Fixed values (IEEE ether types, IANA protocol numbers).
_ETHER = {0x0800: "ipv4", 0x86DD: "ipv6", 0x0806: "arp", 0x8100: "dot1q", 0x88A8: "dot1q", 0x6558: "ethernet"}
_PROTO = {1: "icmpv4", 6: "tcp", 17: "udp", 47: "gre", 4: "ipv4", 41: "ipv6", 58: "icmpv6"}
_EXT = (0, 43, 44, 60)


def _after(follow) -> tuple[str, tuple] | None:
    if not follow:
        return None
    kind, *rest = follow
    if kind in ("dns", "ntp"):
        return kind, ()
    if kind == "ether":
        return (_ETHER[rest[0]], ()) if rest[0] in _ETHER else None
    if kind == "ip6" and rest[0] in _EXT:
        return "ipv6_ext", (rest[0],)
    return (_PROTO[rest[0]], ()) if rest[0] in _PROTO else None


def _first(linktype: int, frame: bytes) -> str | None:
    if linktype in (RAW, 12, 14):
        return {4: "ipv4", 6: "ipv6"}.get(frame[0] >> 4) if frame else None
    return {ETHERNET: "ethernet", SLL: "linuxsll", IPV4_LINK: "ipv4", IPV6_LINK: "ipv6"}.get(linktype)


def dissect(linktype: int, frame: bytes, orig_len: int) -> tuple[int, list[tuple[str, dict]], bytes]:
    """(presence bits, layers in order, payload). A frame without any layer is kept raw."""
    layers: list[tuple[str, dict]] = []
    bits = TRUNCATED if orig_len > len(frame) else 0
    name, args, at = _first(linktype, frame), (), 0
    while name:
        rest = frame[at:]
        if name in ("dns", "ntp") and layers[-1][0] == "udp":
            rest = rest[: max(0, layers[-1][1]["length"] - 8)]  # padding after the datagram stays payload
        try:
            row, size, follow = _ipv6_ext(rest, *args) if name == "ipv6_ext" else _READ[name](rest)
        except (Stop, UnicodeError):
            break
        layers.append((name, row))
        bits |= COMPONENTS[name].mask
        at += size
        name, args = _after(follow) or (None, ())
    return (bits, layers, frame[at:]) if layers else (bits | RAW_FRAME, [], frame)


def rebuild(bits: int, layers: list[tuple[str, dict]], payload: bytes) -> bytes:
    """The captured bytes. Raises ValueError where presence bits and layers disagree."""
    have = 0
    for name, _ in layers:
        have |= COMPONENTS[name].mask
    said = bits & ~(RAW_FRAME | TRUNCATED)
    if said != have:
        raise ValueError(f"the presence bits are {said:#x}, the layers {have:#x}")
    return b"".join(_BUILD[name](row) for name, row in layers) + payload


LAYERS = [n for n in COMPONENTS]
_ITEM = {n: T.StructType([T.StructField("layer_index", T.IntegerType()), *c.struct.fields]) for n, c in COMPONENTS.items()}
DISSECTED = T.StructType([T.StructField("session_id", SESSION), T.StructField("packet_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("incl_len", T.LongType()), T.StructField("trunc_extra", T.LongType()), T.StructField("components", T.LongType()), T.StructField("payload", T.BinaryType()), *[T.StructField(n, T.ArrayType(_ITEM[n])) for n in LAYERS]])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _decimal(v):
    from decimal import Decimal

    return None if v is None else Decimal(v)


class _Bytes:
    """A batch's frames as one run of bytes, read at many places at once. Places up to PAD past the end read zeros."""

    PAD = 128

    def __init__(self, frames: pa.Array):
        frames = frames.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
        data = frames.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.data = np.concatenate([data, np.zeros(self.PAD, np.uint8)])
        self.start = offsets[:-1] - offsets[0]
        self.size = np.diff(offsets)

    def u8(self, at: np.ndarray) -> np.ndarray:
        return self.data[at].astype(np.int64)

    def u16(self, at: np.ndarray) -> np.ndarray:
        return self.u8(at) << 8 | self.u8(at + 1)

    def u32(self, at: np.ndarray) -> np.ndarray:
        return self.u16(at) << 16 | self.u16(at + 2)

    def slices(self, at: np.ndarray, size: np.ndarray | int) -> pa.Array:
        """The bytes from each place on."""
        ends = np.cumsum(np.broadcast_to(size, at.shape), dtype=np.int64)
        begins = np.concatenate([[0], ends])
        total = int(begins[-1])
        places = np.arange(total) + np.repeat(at - begins[:-1], np.diff(begins))
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(begins.astype(np.int32)), pa.py_buffer(self.data[places])])


def _common(b: _Bytes, linktype: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, dict]]]:
    """Frames of the usual shapes, all at once: Ethernet with ARP, or with IP whose TCP or UDP follows at once.

    Returns where each one's payload starts (-1: another shape, for dissect to walk), and by layer the frames' numbers and the columns.
    Both ways say the same of every frame; the tests hold them against each other.
    """
    at = b.start
    ether = (linktype == ETHERNET) & (b.size >= 34)
    kind = b.u16(at + 12)
    v4 = ether & (kind == 0x0800) & (b.u8(at + 14) == 0x45) & (b.u16(at + 20) & 0x3FFF == 0)
    v6 = ether & (kind == 0x86DD) & (b.u8(at + 14) >> 4 == 6) & (b.size >= 54)
    arp = ether & (kind == 0x0806) & (b.size >= 42) & (b.u32(at + 14) == 0x00010800) & (b.u16(at + 18) == 0x0604)
    proto = np.where(v4, b.u8(at + 23), np.where(v6, b.u8(at + 20), 0))
    l4 = at + np.where(v6, 54, 34)
    room, words, bits = at + b.size - l4, b.u8(l4 + 12) >> 4, b.u16(l4 + 12)
    sport, dport = b.u16(l4), b.u16(l4 + 2)
    tcp = (proto == 6) & (room >= 20) & (words >= 5) & (bits & 0x0E00 == 0) & (room >= words * 4)
    udp = (proto == 17) & (room >= 8) & ~np.isin(sport, (53, 123)) & ~np.isin(dport, (53, 123))
    rest = np.where(tcp, l4 + words * 4, np.where(udp, l4 + 8, np.where(arp, at + 42, -1)))
    out = {}

    def layer(name: str, index: int, which: np.ndarray, columns: Callable[[np.ndarray, np.ndarray], dict], base: np.ndarray) -> None:
        rows = np.flatnonzero(which)
        if len(rows):
            out[name] = rows, columns(base[rows], rows) | {"layer_index": np.full(len(rows), index)}

    none = lambda p: b.slices(p, 0)
    layer("ethernet", 0, rest >= 0, lambda p, r: {"src": b.slices(p + 6, 6), "dst": b.slices(p, 6), "type": kind[r], "len": np.zeros(len(r), np.int64)}, at)
    layer("ipv4", 1, v4 & (rest >= 0), lambda p, r: {"protocol": proto[r], "src": b.u32(p + 12), "dst": b.u32(p + 16), "ihl": np.full(len(r), 5), "tos": b.u8(p + 1), "total_len": b.u16(p + 2), "id": b.u16(p + 4), "flags": b.u16(p + 6) >> 13, "frag_offset": b.u16(p + 6) & 0x1FFF, "ttl": b.u8(p + 8), "hdr_checksum": b.u16(p + 10), "options_raw": none(p)}, at + 14)
    layer("ipv6", 1, v6 & (rest >= 0), lambda p, r: {"protocol": proto[r], "src": b.slices(p + 8, 16), "dst": b.slices(p + 24, 16), "payload_len": b.u16(p + 4), "hop_limit": b.u8(p + 7), "flow_label": b.u32(p) & 0xFFFFF, "traffic_class": b.u32(p) >> 20 & 0xFF}, at + 14)
    layer("arp", 1, arp, lambda p, r: {"arp_op": b.u16(p + 6), "sender_mac": b.slices(p + 8, 6), "sender_ip": b.u32(p + 14), "target_mac": b.slices(p + 18, 6), "target_ip": b.u32(p + 24)}, at + 14)
    layer("tcp", 2, tcp, lambda p, r: {"src": sport[r], "dst": dport[r], "seq": b.u32(p + 4), "ack": b.u32(p + 8), "data_offset": words[r], "flags": bits[r] & 0x1FF, "window": b.u16(p + 14), "checksum": b.u16(p + 16), "urgent": b.u16(p + 18), "options_raw": b.slices(p + 20, words[r] * 4 - 20)}, l4)
    layer("udp", 2, udp, lambda p, r: {"src": sport[r], "dst": dport[r], "length": b.u16(p + 4), "checksum": b.u16(p + 6)}, l4)
    return rest, out


def _struct(kind: pa.StructType, columns: dict) -> pa.StructArray:
    cols = []
    for f in kind:
        v = columns[f.name]
        if isinstance(v, list):
            v = pa.array([_decimal(x) for x in v] if pa.types.is_decimal(f.type) else v, f.type)
        cols.append(v if isinstance(v, pa.Array) else pa.array(v).cast(f.type))
    return pa.StructArray.from_arrays(cols, fields=list(kind))


def _dissected(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Frames to layers, column by column: the usual shapes at once, the others one by one."""
    frames, orig, linktype, *keys = (batch.column(batch.schema.get_field_index(c)) for c in ("frame", "orig_len", "linktype", *KEYS, "ts"))
    n, b = batch.num_rows, _Bytes(frames)
    linktype = linktype.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    rest, common = _common(b, linktype)
    orig = np.maximum(orig.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), b.size)
    bits = np.where(orig > b.size, TRUNCATED, 0).astype(np.int64)
    for name, (rows, _) in common.items():
        bits[rows] |= COMPONENTS[name].mask
    others: dict[str, tuple[list[int], list[dict]]] = {}
    start = rest.copy()
    for i in np.flatnonzero(rest < 0).tolist():
        lo, hi = int(b.start[i]), int(b.start[i] + b.size[i])
        bits[i], layers, payload = dissect(int(linktype[i]), b.data[lo:hi].tobytes(), int(orig[i]))
        start[i] = hi - len(payload)
        for k, (name, row) in enumerate(layers):
            row["layer_index"] = k
            at, rows = others.setdefault(name, ([], []))
            at.append(i)
            rows.append(row)
    cols = [*keys, pa.array(b.size), pa.array(orig - b.size), pa.array(bits), b.slices(start, b.start + b.size - start)]
    for name in LAYERS:
        kind = schema.field(name).type
        found = []
        if name in common:
            found.append((common[name][0], _struct(kind.value_type, common[name][1])))
        if name in others:
            at, rows = others[name]
            found.append((np.array(at), _struct(kind.value_type, {f.name: [r[f.name] for r in rows] for f in kind.value_type})))
        if not found:
            cols.append(pa.nulls(n, kind))
            continue
        at, values = found[0]
        if len(found) > 1:
            # all layers of a frame come from one side, so a stable order by frame keeps them in theirs
            at = np.concatenate([x for x, _ in found])
            order = np.argsort(at, kind="stable")
            values = pa.concat_arrays([v for _, v in found]).take(pa.array(order))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(offsets), values, type=kind))
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, schema, strict=True)], schema=schema)


def dissect_frames(frames: DataFrame) -> DataFrame:
    """Rows (session_id, packet_id, ts, orig_len, linktype, frame) to packets with an array of rows for each component."""
    schema = _arrow(DISSECTED)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                yield _dissected(batch.slice(lo, 5000), schema)

    return frames.select("session_id", "packet_id", "ts", "orig_len", "linktype", "frame").mapInArrow(run, DISSECTED)


def component_rows(dissected: DataFrame, name: str) -> DataFrame:
    """One component's table out of dissected packets."""
    each = dissected.where(F.col("components").bitwiseAND(COMPONENTS[name].mask) != 0).select(*KEYS, F.explode(name).alias("_c"))
    return each.select(*KEYS, F.lit(VERSION).alias("codec_version"), F.col("_c.layer_index"), *[F.col(f"_c.{c.name}") for c in COMPONENTS[name].columns])


#: A header's parts in order: name:bits are numbers from high to low (a number alone is a constant) of one word of up to 64 bits, a name alone is bytes as they are.
_LAYOUT = {
    "ethernet": "dst src kind:16",
    "dot1q": "priority:3,drop_eligible:1,vlan_id:12,type:16",
    "linuxsll": "l2_hdr_raw",
    "ipv4": "4:4,ihl:4,tos:8,total_len:16,id:16,flags:3,frag_offset:13 ttl:8,protocol:8,hdr_checksum:16,src:32 dst:32 options_raw",
    "ipv6": "6:4,traffic_class:8,flow_label:20,payload_len:16,protocol:8,hop_limit:8 src dst",
    "ipv6_ext": "ext_raw",
    "tcp": "src:16,dst:16,seq:32 ack:32,data_offset:4,0:3,flags:9,window:16 checksum:16,urgent:16 options_raw",
    "udp": "src:16,dst:16,length:16,checksum:16",
    "dns": "dns_raw",
    "ntp": "ntp_raw",
    "arp": "1:16,2048:16,6:8,4:8,arp_op:16 sender_mac sender_ip:32 target_mac target_ip:32",
    "icmpv4": "type:8,code:8,checksum:16,id:16,seq:16",
    "icmpv6": "type:8,code:8,checksum:16",
    "gre": "bits:16,protocol:16",
}


def _word(fields: list[tuple[Column, int]]) -> Column:
    """Numbers side by side as big-endian bytes; null where one needs more bits than it has."""
    total, out, fits = sum(n for _, n in fields), None, None
    below = total
    for value, n in fields:
        below -= n
        value = value.cast("long")
        part = F.shiftleft(value, below) if below else value
        out = part if out is None else out.bitwiseOR(part)
        ok = F.shiftrightunsigned(value, n) == 0
        fits = ok if fits is None else fits & ok
    return F.when(fits, F.unhex(F.lpad(F.hex(out), total // 4, "0")))


def header(name: str, of: Callable[[str], Column]) -> Column:
    """A layer's header bytes out of its columns; null where they don't give one."""
    special = {}
    if name == "ethernet":
        special["kind"] = F.when(of("type") != 0, of("type")).otherwise(of("len"))
    if name == "gre":
        announced = [F.when(of("flags").bitwiseAND(1 << i) != 0, bit).otherwise(0) for i, bit in enumerate((GRE_CHECKSUM, GRE_KEY, GRE_SEQ))]
        special["bits"] = announced[0].bitwiseOR(announced[1]).bitwiseOR(announced[2]).bitwiseOR(of("version").cast("int"))
    pieces = []
    for part in _LAYOUT[name].split(" "):
        if ":" not in part:
            pieces.append(of(part))
            continue
        fields = [f.split(":") for f in part.split(",")]
        pieces.append(_word([(F.lit(int(f)) if f.isdigit() else special[f] if f in special else of(f), int(n)) for f, n in fields]))
    if name == "gre":
        optional = (_word([(of("checksum"), 16), (F.lit(0), 16)]), _word([(of("key"), 32)]), _word([(of("seq"), 32)]))
        pieces += [F.when(of("flags").bitwiseAND(1 << i) != 0, w).otherwise(F.lit(b"")) for i, w in enumerate(optional)]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def joined_frame(layers: Column, payload: Column, components: Column, incl_len: Column) -> tuple[Column, Column]:
    """(frame, error) of a packet out of its ordered layers, structs with mask and bytes. One of them is null."""
    have = F.aggregate(layers, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x["mask"]))
    said = components.bitwiseAND(F.lit(~(RAW_FRAME | TRUNCATED)).cast("long"))
    # a null header makes the whole null
    heads = F.aggregate(layers, F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
    whole = F.substr(F.concat(heads, F.coalesce(payload, F.lit(b""))), F.lit(1), incl_len.cast("int"))
    differ = F.concat(F.lit("the presence bits are 0x"), F.lower(F.hex(said)), F.lit(", the layers 0x"), F.lower(F.hex(have)))
    return F.when(said == have, whole), F.when(said != have, differ).when(heads.isNull(), "a layer's columns don't fit its header")


def rebuild_frames(rows: DataFrame) -> DataFrame:
    """Dissected rows to (session_id, packet_id, ts, orig_len, frame, error).

    A packet whose layers disagree with its presence bits has no frame and says why.
    """

    def each(name: str) -> Column:
        made = F.transform(name, lambda x: F.struct(x["layer_index"].alias("layer_index"), F.lit(COMPONENTS[name].mask).cast("long").alias("mask"), header(name, lambda c: x[c]).alias("bytes")))
        return F.coalesce(made, F.array().cast("array<struct<layer_index:int,mask:bigint,bytes:binary>>"))

    cols = [F.col(c) for c in ("payload", "components", "incl_len")]
    put = rows.withColumn("_layers", F.array_sort(F.concat(*[each(n) for n in LAYERS])))
    frame, error = joined_frame(F.col("_layers"), *cols)
    return put.select(*KEYS, "ts", (F.col("incl_len") + F.col("trunc_extra")).alias("orig_len"), frame.alias("frame"), error.alias("error"))


def has(name: str) -> Column:
    return F.col("components").bitwiseAND(COMPONENTS[name].mask) != 0
