"""The packet model: tables, columns, Spark types, presence bits, layers and field aliases."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

#: Name, presence bit, layer, whether a packet may hold several. Fixed values, in canonical order.
_KINDS = [
    ("ethernet", 1, "l2", False),
    ("dot1q", 2, "l2tag", True),
    ("linuxsll", 3, "l2", False),
    ("ipv4", 4, "l3", False),
    ("ipv6", 5, "l3", False),
    ("ipv6_ext", 6, "l3ext", True),
    ("tcp", 9, "l4", False),
    ("udp", 10, "l4", False),
    ("dns", 11, "l7", False),
    ("ntp", 12, "l7", False),
    ("arp", 13, "l4", False),
    ("icmpv4", 14, "l4", False),
    ("icmpv6", 15, "l4", False),
    ("gre", 16, "l3", False),
]
RAW_FRAME, TRUNCATED = 1 << 0, 1 << 8
#: Presence bits of everything from layer 4 up, without GRE, which counts as layer 3.
UPPER_LAYERS = 0xFE00

#: Columns after the key columns. ip4: a number from 0 to 2^32-1; ip6: 16 bytes; mac: 6 bytes; u64: DECIMAL(20,0).
_COLUMNS = {
    "ethernet": "src mac, dst mac, type int, len int",
    "dot1q": "priority short, drop_eligible short, vlan_id int, type int",
    "linuxsll": "l2_len int, l2_hdr_raw binary",
    "ipv4": "protocol short, src ip4, dst ip4, ihl short, tos short, total_len int, id int, flags short, frag_offset int, ttl short, hdr_checksum int, options_raw binary",
    "ipv6": "protocol short, src ip6, dst ip6, payload_len int, hop_limit short, flow_label long, traffic_class short",
    "ipv6_ext": "ext_type int, ext_raw binary",
    "tcp": "src int, dst int, seq long, ack long, data_offset short, flags int, window int, checksum int, urgent int, options_raw binary",
    "udp": "src int, dst int, length int, checksum int",
    "dns": "raw_len int, transaction_id int, qr short, opcode short, rcode short, flags short, an_count int, ns_count int, ar_count int, "
    "questions_name strings, questions_type ints, questions_class ints, answers_name strings, answers_type ints, answers_class ints, answers_ttl longs, answers_rdata binaries, answers_ip strings, "
    "authority_name strings, authority_type ints, authority_class ints, authority_ttl longs, authority_rdata binaries, "
    "additional_name strings, additional_type ints, additional_class ints, additional_ttl longs, additional_rdata binaries, dns_raw binary",
    "ntp": "leap_indicator short, version short, mode short, stratum short, poll byte, precision byte, root_delay long, root_dispersion long, reference_id long, "
    "reference_ts u64, origin_ts u64, receive_ts u64, transmit_ts u64, ntp_raw binary",
    "arp": "arp_op int, sender_mac mac, sender_ip ip4, target_mac mac, target_ip ip4",
    "icmpv4": "type short, code short, checksum int, id int, seq int",
    "icmpv6": "type short, code short, checksum int",
    "gre": "protocol int, flags short, version short, checksum int, key long, seq long",
}
_TYPES: dict[str, T.DataType] = {
    "short": T.ShortType(), "byte": T.ByteType(), "int": T.IntegerType(), "long": T.LongType(), "binary": T.BinaryType(), "mac": T.BinaryType(), "ip4": T.LongType(), "ip6": T.BinaryType(), "u64": T.DecimalType(20, 0),
    "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()), "longs": T.ArrayType(T.LongType()), "binaries": T.ArrayType(T.BinaryType()), "string": T.StringType(), "bool": T.BooleanType(), "date": T.DateType(),
}
KEYS = ("session_id", "packet_id")
SESSION = T.DecimalType(20, 0)


@dataclass(frozen=True)
class Column:
    name: str
    kind: str

    @property
    def type(self) -> T.DataType:
        return _TYPES[self.kind]


@dataclass(frozen=True)
class Component:
    name: str
    bit: int
    layer: str
    repeatable: bool
    columns: tuple[Column, ...]

    @property
    def mask(self) -> int:
        return 1 << self.bit

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def shown(self, name: str) -> str:
        """A column's name in results that mix components."""
        return name if name.startswith(self.name + "_") else f"{self.name}_{name}"

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type) for c in self.columns])

    @property
    def schema(self) -> T.StructType:
        keys = [T.StructField("session_id", SESSION), T.StructField("packet_id", T.LongType()), T.StructField("codec_version", T.IntegerType()), T.StructField("layer_index", T.IntegerType())]
        return T.StructType(keys + self.struct.fields)


def _columns(text: str) -> tuple[Column, ...]:
    return tuple(Column(*c.split()) for c in text.split(", "))


COMPONENTS: dict[str, Component] = {n: Component(n, bit, layer, many, _columns(_COLUMNS[n])) for n, bit, layer, many in _KINDS}

PACKET_COLUMNS = _columns("session_id u64, packet_id long, ts long, incl_len long, trunc_extra long, components long, payload binary")
CAPTURE_COLUMNS = _columns("session_id u64, sensor string, endianness string, snaplen long, linktype long, time_res string, global_header_raw binary, codec_version int, codec_profile string")
STREAM_COLUMNS = _columns("session_id u64, stream_id string, l7_proto string, proto short, src_ip ip6, dst_ip ip6, src_port int, dst_port int, is_complete bool, first_packet_id long, last_packet_id long, packet_count long, byte_count long")
HTTP_COLUMNS = _columns("session_id u64, stream_id string, method string, host string, path string")


def schema_of(columns: tuple[Column, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.type) for c in columns])


#: component.alias: the two columns it stands for. Fixed values.
ALIASES = {
    ("ipv4", "addr"): ("src", "dst"),
    ("ipv6", "addr"): ("src", "dst"),
    ("tcp", "port"): ("src", "dst"),
    ("udp", "port"): ("src", "dst"),
    ("ethernet", "mac"): ("src", "dst"),
    ("arp", "ip"): ("sender_ip", "target_ip"),
    ("arp", "mac"): ("sender_mac", "target_mac"),
}


def session_literal(number: int):
    """A session id, which may need all 64 bits, as a column."""
    from pyspark.sql import functions as F

    return F.lit(str(int(number))).cast(SESSION)


def in_sessions(numbers, column: str = "session_id"):
    from pyspark.sql import functions as F

    return F.col(column).isin(*[session_literal(n) for n in numbers])


def default_sql(kind: str) -> str:
    """What an absent layer shows for a column of a kind."""
    return {
        "string": "''", "binary": "X''", "mac": "X'000000000000'", "ip6": "X'00000000000000000000000000000000'", "bool": "false",
        "strings": "cast(array() as array<string>)", "ints": "cast(array() as array<int>)", "longs": "cast(array() as array<bigint>)", "binaries": "cast(array() as array<binary>)",
    }.get(kind, "0")


def identifier(name: str) -> str:
    """A checked name for a table or database."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def display_schema() -> dict[str, dict[str, str]]:
    """Tables and their columns' Spark types, for people who write filters."""
    out = {"packet": {c.name: c.type.simpleString() for c in PACKET_COLUMNS}, "capture": {c.name: c.type.simpleString() for c in CAPTURE_COLUMNS}}
    return out | {n: {c.name: c.type.simpleString() for c in comp.columns} for n, comp in COMPONENTS.items()}
