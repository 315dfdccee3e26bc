"""Places and networks of addresses: ranges to prefixes, and the longest prefix that holds an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A

CITY_SCHEMA = "ip_range_start string, ip_range_end string, country_code string, state1 string, state2 string, city string, postcode string, latitude double, longitude double, timezone string"
ASN_SCHEMA = "ip_range_start string, ip_range_end string, autonomous_system_number string, autonomous_system_organization string"


def read_city(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CITY_SCHEMA).csv(path)


def read_asn(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASN_SCHEMA).csv(path)


def load(spark: SparkSession, reader, path: str | None, schema: str) -> DataFrame:
    """A table, or an empty one where there is no file: lookups then give empty values."""
    from .files import exists

    return reader(spark, path) if path and exists(spark, path) else spark.createDataFrame([], schema)


def bits_of(x: Column) -> Column:
    """How many bits a number below 2^32 needs."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def prefixes(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each range [lo, hi] of IPv4 numbers as the prefixes that cover it exactly: columns network and len are added, a row for each prefix.

    A prefix may start at x if x is a multiple of its size and it ends by hi; the greedy choice gives at most 62 prefixes, so a fold over a fixed sequence does it.
    """
    start = F.struct(F.col(lo).cast("long").alias("x"), F.array().cast("array<struct<network:bigint,len:int>>").alias("out"))

    def step(a, _):
        x = a["x"]
        free = F.when(x == 0, 32).otherwise(F.length(F.bin(x)) - F.length(F.rtrim(F.translate(F.bin(x), "0", " ")))).cast("int")  # trailing zero bits
        left = bits_of(F.col(hi) - x + 1) - 1
        size = F.least(F.least(free, F.lit(32)), left)
        item = F.struct(x.alias("network"), (32 - size).cast("int").alias("len"))
        done = x > F.col(hi)
        return F.struct(F.when(done, x).otherwise(x + F.pow(F.lit(2.0), size).cast("long")).alias("x"), F.when(done, a["out"]).otherwise(F.concat(a["out"], F.array(item))).alias("out"))

    all_ = F.aggregate(F.sequence(F.lit(1), F.lit(62)), start, step, lambda a: a["out"])
    return df.withColumn("_p", F.explode(all_)).withColumns({"network": F.col("_p.network"), "len": F.col("_p.len")}).drop("_p")


def single_prefix(lo: Column, hi: Column) -> tuple[Column, Column]:
    """(network, length) of the one prefix that both ends share."""
    length = 32 - bits_of(lo.bitwiseXOR(hi))
    return _network(lo, length), length


def _network(ip: Column, length: Column) -> Column:
    size = F.pow(F.lit(2.0), 32 - length).cast("long")
    return ip - ip % size


def longest_prefix(addresses: DataFrame, table: DataFrame, ip: str = "ip", values: tuple[str, ...] = ("country_code", "city")) -> DataFrame:
    """addresses with the values of the longest prefix of table(network, len, …) that holds ip; empty text where none does.

    Distinct addresses meet prefixes by equality of (length, network), once for each length that the table has; at most 33 lengths exist.
    Everything is an equi-join and a partial aggregate, so neither side is gathered.
    """
    lengths = [r[0] for r in table.select("len").distinct().collect()]  # 33 at most
    if not lengths:
        return addresses.withColumns({v: F.lit("") for v in values})
    each = addresses.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("len", F.explode(F.array(*[F.lit(x) for x in sorted(lengths)])))
    each = each.withColumn("network", _network(F.col(ip), F.col("len")))
    found = each.join(table.select("len", "network", *values), ["len", "network"])
    best = found.groupBy(ip).agg(F.max_by(F.struct(*values), F.struct("len", *values)).alias("_v"))
    out = addresses.join(best, ip, "left")
    return out.withColumns({v: F.coalesce(F.col(f"_v.{v}"), F.lit("")) for v in values}).drop("_v")


def lookup(addresses: DataFrame, city: DataFrame, asn: DataFrame, text: str = "ip") -> DataFrame:
    """Addresses of either family with country_code, city, asn and org, from range tables as read by read_city and read_asn. A mapped IPv4 address counts as IPv4."""
    plain = A.strip_mapped(F.col(text))
    rows = addresses.withColumns({"_ip": A.ip4_parse(plain), "_ip6": F.when(plain.contains(":"), A.ip6_parse(plain))})
    for table, values, columns in ((city, ("country_code", "city"), ("country_code", "city")), (asn, ("asn", "org"), ("autonomous_system_number", "autonomous_system_organization"))):
        named = table.select("ip_range_start", "ip_range_end", *[F.coalesce(F.col(c), F.lit("")).alias(v) for c, v in zip(columns, values, strict=True)])
        six = F.col("ip_range_start").contains(":")
        four = named.where(~six).withColumns({"lo": A.ip4_parse(F.col("ip_range_start")), "hi": A.ip4_parse(F.col("ip_range_end"))}).where("lo is not null and hi >= lo")
        more = named.where(six).withColumns({"lo": A.ip6_parse(F.col("ip_range_start")), "hi": A.ip6_parse(F.col("ip_range_end"))}).where("lo is not null and hi >= lo")
        rows = longest_prefix(rows, prefixes(four, "lo", "hi").select("network", "len", *values), "_ip", values)
        again = tuple(f"_{v}" for v in values)
        long = prefixes6(more, "lo", "hi").select("prefix", "len", *[F.col(v).alias(w) for v, w in zip(values, again, strict=True)])
        rows = longest_prefix6(rows, long, "_ip6", again)
        rows = rows.withColumns({v: F.when(F.col("_ip6").isNotNull(), F.col(w)).otherwise(F.col(v)) for v, w in zip(values, again, strict=True)}).drop(*again)
    return rows.drop("_ip", "_ip6")


def _bits6(h: Column) -> Column:
    """Hex digits as a text of bits."""
    return F.array_join(F.transform(F.split(h, ""), lambda c: F.when(c == "", "").otherwise(F.lpad(F.conv(c, 16, 2), 4, "0"))), "")


def prefixes6(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each range [lo, hi] of 16-byte addresses as the prefixes that cover it exactly: columns prefix (its bits as text) and len are added, a row for each.

    Below the bits that both ends share, a range holds the right-hand sides of lo's path and the left-hand sides of hi's path through the tree of bits, and
    the largest subtrees that end these paths: at most 254 prefixes, each read off the ends.
    """
    d = df.withColumns({"_a": _bits6(F.hex(lo)), "_b": _bits6(F.hex(hi))})
    places = F.sequence(F.lit(1), F.lit(128))
    bit = lambda c, i: F.substr(F.col(c), i, F.lit(1))
    shared = F.coalesce(F.get(F.filter(places, lambda i: bit("_a", i) != bit("_b", i)), F.lit(0)), F.lit(129)) - 1
    d = d.withColumns({"_c": shared, "_z": 128 - F.char_length(F.rtrim(F.translate("_a", "01", " 1"))), "_o": 128 - F.char_length(F.rtrim(F.translate("_b", "10", " 0")))})
    # where lo's and hi's last subtrees begin: below the first bit that differs
    d = d.withColumns({"_l": F.greatest(128 - F.col("_z"), F.col("_c") + 1), "_r": F.greatest(128 - F.col("_o"), F.col("_c") + 1)})
    whole = (F.col("_c") == 128) | ((F.col("_l") == F.col("_c") + 1) & (F.col("_r") == F.col("_c") + 1) & (128 - F.col("_z") <= F.col("_c") + 1) & (128 - F.col("_o") <= F.col("_c") + 1))
    side = lambda c, end, own, other: F.transform(F.filter(places, lambda i: (i > F.col("_c") + 1) & (i <= F.col(end)) & (bit(c, i) == own)), lambda i: F.concat(F.substr(F.col(c), F.lit(1), i - 1), F.lit(other)))
    ends = F.array(F.substr(F.col("_a"), F.lit(1), F.col("_l")), F.substr(F.col("_b"), F.lit(1), F.col("_r")))
    each = F.when(whole, F.array(F.substr(F.col("_a"), F.lit(1), F.col("_c")))).otherwise(F.concat(ends, side("_a", "_l", "0", "1"), side("_b", "_r", "1", "0")))
    return d.withColumn("prefix", F.explode(each)).withColumn("len", F.char_length("prefix")).drop("_a", "_b", "_c", "_z", "_o", "_l", "_r")


def prefix6(lo: Column, hi: Column) -> tuple[Column, Column]:
    """(network as 32 hex digits, length) of the one IPv6 prefix that two 16-byte ends share."""
    a, b = F.lower(F.hex(lo)), F.lower(F.hex(hi))
    same = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(
            (s["n"] + F.when(s["on"], 4 - bits_of(F.conv(F.substr(a, i, F.lit(1)), 16, 10).cast("long").bitwiseXOR(F.conv(F.substr(b, i, F.lit(1)), 16, 10).cast("long")))).otherwise(0)).cast("int").alias("n"),
            (s["on"] & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))).alias("on"),
        ),
        lambda s: s["n"],
    )
    return a, same


def longest_prefix6(addresses: DataFrame, table: DataFrame, ip: str, values: tuple[str, ...]) -> DataFrame:
    """Like longest_prefix for 16-byte addresses; table(network hex or prefix as bits, len, …). Networks are compared on their bits as text."""
    lengths = [r[0] for r in table.select("len").distinct().collect()]  # 129 at most
    if not lengths:
        return addresses.withColumns({v: F.lit("") for v in values})
    each = addresses.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("_b", _bits6(F.hex(ip))).withColumn("len", F.explode(F.array(*[F.lit(x) for x in sorted(lengths)])))
    each = each.withColumn("_k", F.substr("_b", F.lit(1), F.col("len"))).drop("_b")
    prefix = F.col("prefix") if "prefix" in table.columns else F.substr(_bits6(F.col("network")), F.lit(1), F.col("len"))
    keyed = table.withColumn("_k", prefix).select("len", "_k", *values)
    best = each.join(keyed, ["len", "_k"]).groupBy(ip).agg(F.max_by(F.struct(*values), F.struct("len", *values)).alias("_v"))
    return addresses.join(best, ip, "left").withColumns({v: F.coalesce(F.col(f"_v.{v}"), F.lit("")) for v in values}).drop("_v")
