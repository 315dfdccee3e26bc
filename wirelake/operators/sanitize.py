"""Captures with pseudonymous addresses and right checksums."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.address import NOT_PUBLIC4, NOT_PUBLIC6
from ..functions.pseudonym import TAG4, TAG6, TAG_MAC
from . import codec

_NETS4, _NETS6 = [ipaddress.ip_network(n) for n in NOT_PUBLIC4], [ipaddress.ip_network(n) for n in NOT_PUBLIC6]


def checksum(data: bytes) -> int:
    """RFC 1071."""
    if len(data) % 2:
        data += b"\0"
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def transport_checksum(src: bytes, dst: bytes, proto: int, segment: bytes) -> int:
    """With the pseudo-header of IPv4 or IPv6; a UDP sum of zero is sent as all ones."""
    size = struct.pack(">IHBB", len(segment), 0, 0, proto) if len(src) == 16 else struct.pack(">BBH", 0, proto, len(segment))
    c = checksum(src + dst + size + segment)
    return 0xFFFF if proto == 17 and c == 0 else c


def ip4(seed: bytes, ip: int) -> int:
    if any(ipaddress.IPv4Address(ip) in n for n in _NETS4):
        return ip
    b = ip.to_bytes(4, "big")
    h = hmac.new(seed, TAG4 + b, hashlib.sha256).digest()
    return int.from_bytes(bytes([b[0], h[0], h[1], {0: 1, 255: 254}.get(h[2], h[2])]), "big")


def ip6(seed: bytes, ip: bytes) -> bytes:
    a = ipaddress.IPv6Address(ip)
    if a.ipv4_mapped is not None:
        return ip if any(a.ipv4_mapped in n for n in _NETS4) else ip[:2] + hmac.new(seed, TAG6 + ip, hashlib.sha256).digest()[:14]
    return ip if any(a in n for n in _NETS6) else ip[:2] + hmac.new(seed, TAG6 + ip, hashlib.sha256).digest()[:14]


def mac(seed: bytes, m: bytes) -> bytes:
    return m if m[0] & 1 or m == b"\0" * 6 else b"\x02" + hmac.new(seed, TAG_MAC + m, hashlib.sha256).digest()[:5]


def sanitize_frame(seed: bytes, linktype: int, frame: bytes, orig_len: int) -> bytes:
    """All addresses in all layers replaced, checksums that were there made right again where the whole segment was captured."""
    bits, layers, payload = codec.dissect(linktype, frame, orig_len)
    for name, r in layers:
        if name == "ethernet":
            r["src"], r["dst"] = mac(seed, r["src"]), mac(seed, r["dst"])
        elif name == "ipv4":
            r["src"], r["dst"] = ip4(seed, r["src"]), ip4(seed, r["dst"])
            r["hdr_checksum"] = 0
            r["hdr_checksum"] = checksum(codec._BUILD["ipv4"](r))
        elif name == "ipv6":
            r["src"], r["dst"] = ip6(seed, r["src"]), ip6(seed, r["dst"])
        elif name == "arp":
            r["sender_mac"], r["target_mac"] = mac(seed, r["sender_mac"]), mac(seed, r["target_mac"])
            r["sender_ip"], r["target_ip"] = ip4(seed, r["sender_ip"]), ip4(seed, r["target_ip"])
        elif name == "linuxsll" and r["l2_hdr_raw"][4:6] == b"\x00\x06":
            r["l2_hdr_raw"] = r["l2_hdr_raw"][:6] + mac(seed, r["l2_hdr_raw"][6:12]) + r["l2_hdr_raw"][12:]
    for i, (name, r) in enumerate(layers):
        if name not in ("tcp", "udp") or (name == "udp" and r["checksum"] == 0):
            continue
        over = next((x for x in reversed(layers[:i]) if x[0] in ("ipv4", "ipv6")), None)
        if over is None:
            continue
        head = sum(len(codec._BUILD[n](x)) for n, x in layers[layers.index(over) + 1 : i])
        room = (over[1]["total_len"] - over[1]["ihl"] * 4 if over[0] == "ipv4" else over[1]["payload_len"]) - head
        r["checksum"] = 0
        segment = b"".join(codec._BUILD[n](x) for n, x in layers[i:]) + payload
        if len(segment) < room:  # cut short when captured: the right sum isn't known
            continue
        src, dst = (over[1][k].to_bytes(4, "big") if over[0] == "ipv4" else over[1][k] for k in ("src", "dst"))
        r["checksum"] = transport_checksum(src, dst, 6 if name == "tcp" else 17, segment[:room])
    return b"".join(codec._BUILD[n](x) for n, x in layers) + payload


def sanitize(frames: DataFrame, seed: bytes) -> DataFrame:
    """Rows with linktype, orig_len and frame, with the frame sanitised and everything else kept."""
    place = {c: frames.columns.index(c) for c in ("linktype", "orig_len", "frame")}

    def run(batches):
        for b in batches:
            cols = [b.column(place[c]).to_pylist() for c in ("linktype", "frame", "orig_len")]
            new = [sanitize_frame(seed, k, f or b"", o or 0) for k, f, o in zip(*cols, strict=True)]
            yield b.set_column(place["frame"], b.schema.field(place["frame"]), pa.array(new, pa.binary()))

    return frames.mapInArrow(run, T.StructType(frames.schema.fields))
