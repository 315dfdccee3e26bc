"""Addresses: literals on the driver, formatting and tests as column expressions."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip4_number(text: str) -> int:
    return int(ipaddress.IPv4Address(text))


def ip6_bytes(text: str) -> bytes:
    """16 bytes; IPv4 text becomes its mapped form."""
    a = ipaddress.ip_address(text)
    return a.packed if a.version == 6 else b"\0" * 10 + b"\xff\xff" + a.packed


def mac_bytes(text: str) -> bytes:
    plain = re.sub("[:.-]", "", text)
    if not re.fullmatch("[0-9A-Fa-f]{12}", plain):
        raise ValueError(f"not a MAC address: {text!r}")
    return bytes.fromhex(plain)


def cidr_range(kind: str, text: str) -> tuple[int | bytes, int | bytes]:
    net = ipaddress.ip_network(text, strict=False)
    if kind == "ip4":
        return int(net[0]), int(net[-1])
    return net[0].packed, net[-1].packed


def ip4_text(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))


def ip4_parse(c: Column) -> Column:
    """The number of dotted text; null if it isn't an address."""
    parts = F.split(c, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).cast("long")
    return F.when(c.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$") & ~c.endswith("."), number)


def mac_text(c: Column) -> Column:
    h = F.lower(F.hex(c))
    return F.when(c.isNotNull(), F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)]))


def ip6_text(c: Column) -> Column:
    """Canonical text of 16 bytes: groups without leading zeros, the first longest run of two or more zero groups as ::; a mapped IPv4 address with ::ffff: and dots."""
    h = F.lower(F.hex(c))
    groups = [F.regexp_replace(F.substring(h, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]
    plain = F.concat_ws(":", *groups)
    short = plain
    for n in range(2, 9):  # the longest run is replaced last, from the original
        found = plain.rlike("(^|:)" + ":".join(["0"] * n) + "(:|$)")
        once = F.regexp_replace(plain, f"^(.*?)(?:^|(?<=:)){':'.join(['0'] * n)}(?=:|$)(.*)$", "$1:$2")
        short = F.when(found, once).otherwise(short)
    short = F.regexp_replace(F.regexp_replace(short, "^:(?!:)", "::"), "(?<!:):$", "::")
    short = F.regexp_replace(short, ":{3,}", "::")
    low = F.conv(F.substring(h, 25, 8), 16, 10).cast("long")
    return F.when(h.startswith("00000000000000000000ffff"), F.concat(F.lit("::ffff:"), ip4_text(low))).when(c.isNotNull(), short)


def ip6_parse(c: Column) -> Column:
    """The 16 bytes of an IPv6 text (with "::", and with a dotted tail); null if it is none."""
    four = F.regexp_extract(c, r":([0-9]+\.[0-9.]+)$", 1)
    tail = ip4_parse(F.when(four != "", four))
    plain = F.when(four == "", c).otherwise(F.concat(F.substr(c, F.lit(1), F.char_length(c) - F.char_length(four)), F.conv(F.shiftright(tail, 16).cast("string"), 10, 16), F.lit(":"), F.conv(tail.bitwiseAND(0xFFFF).cast("string"), 10, 16)))
    halves = F.split(plain, "::", -1)
    groups = lambda i: F.array_remove(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), "")
    left, right = groups(0), groups(1)
    n, short = F.size(left) + F.size(right), F.size(halves) == 2
    whole = F.when(short, n <= 7).otherwise((F.size(halves) == 1) & (n == 8)) & ~plain.rlike("^:[^:]|[^:]:$|:::")
    good = whole & F.forall(F.concat(left, right), lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    digits = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    return F.when(good, F.unhex(F.concat(digits(left), F.repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - n)), digits(right))))


def strip_mapped(text: Column) -> Column:
    """Text of an address without the prefix of a mapped IPv4 one."""
    return F.regexp_replace(text, "^::ffff:", "")


def ip6_of_ip4(c: Column) -> Column:
    return F.concat(F.unhex(F.lit("00000000000000000000ffff")), F.unhex(F.lpad(F.hex(c), 8, "0")))


#: Networks whose addresses aren't public. Fixed values (RFC 1918, 1122, 3927, 5771, 4193, 4291).
NOT_PUBLIC4 = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "0.0.0.0/32")
NOT_PUBLIC6 = ("fc00::/7", "fe80::/10", "ff00::/8", "::1/128", "::/128")


def is_public4(c: Column) -> Column:
    out = F.lit(True)
    for net in NOT_PUBLIC4:
        lo, hi = cidr_range("ip4", net)
        out = out & ~c.between(lo, hi)
    return out


def is_public6(c: Column) -> Column:
    out = F.lit(True)
    for net in NOT_PUBLIC6:
        lo, hi = cidr_range("ip6", net)
        out = out & ~c.between(F.lit(lo), F.lit(hi))
    mapped = F.lower(F.hex(c)).startswith("00000000000000000000ffff")
    return F.when(mapped, is_public4(F.conv(F.substring(F.hex(c), 25, 8), 16, 10).cast("long"))).otherwise(out)


def session_id(base: Column, content: Column) -> Column:
    """First eight bytes of SHA-256 over file name, zero byte and content, as an unsigned number."""
    digest = F.sha2(F.concat(base.cast("binary"), F.unhex(F.lit("00")), content.cast("binary")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
