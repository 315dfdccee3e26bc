"""Address pseudonyms: keyed, stable, keeping the parts that say what kind of address it is. Built-in functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import address as A

BLOCK = 64
#: What is put before an address under the key, for each kind. Fixed values.
TAG4, TAG6, TAG_MAC = b"\x04", b"\x06", b"\x0e"


def parse_seed(text: str) -> bytes:
    """32 bytes from 64 hex digits."""
    if not re.fullmatch("[0-9A-Fa-f]{64}", text.strip()):
        raise ValueError("a seed is 64 hex digits")
    return bytes.fromhex(text.strip())


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 (RFC 2104) of binary messages."""
    import hashlib

    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))


def ip4(seed: bytes, c: Column) -> Column:
    """First octet kept, the others from the key; a last octet of 0 or 255 becomes 1 or 254. Addresses that aren't public stay.

    A number above 32 bits goes under the key with all its bytes, and what stands before its last three octets is kept.
    """
    digits = F.hex(c)
    whole = F.lpad(digits, F.greatest(F.lit(8), F.length(digits)), "0")  # lpad cuts what is longer
    h = F.hex(hmac_sha256(seed, F.concat(F.lit(TAG4), F.unhex(whole))))
    octets = [F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10).cast("long") for i in range(3)]
    last = F.when(octets[2] == 0, 1).when(octets[2] == 255, 254).otherwise(octets[2])
    new = F.shiftright(c, 24) * (1 << 24) + octets[0] * (1 << 16) + octets[1] * (1 << 8) + last
    return F.when(A.is_public4(c), new).otherwise(c).cast("long")


def ip6(seed: bytes, c: Column) -> Column:
    """First two bytes kept, fourteen from the key. Addresses that aren't public stay."""
    h = hmac_sha256(seed, F.concat(F.lit(TAG6), c))
    return F.when(A.is_public6(c), F.concat(F.substring(c, 1, 2), F.substring(h, 1, 14))).otherwise(c)


def mac(seed: bytes, c: Column) -> Column:
    """A locally administered address from the key; multicast, broadcast and zero stay."""
    h = F.hex(c)
    group = F.conv(F.substring(h, 1, 2), 16, 10).cast("int").bitwiseAND(1) == 1
    new = F.concat(F.lit(b"\x02"), F.substring(hmac_sha256(seed, F.concat(F.lit(TAG_MAC), c)), 1, 5))
    return F.when(group | (h == "000000000000"), c).otherwise(new)
