"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score. Native.

Kinds of the base: email, ip (parts at most 255), card (13 to 19 digits that pass Luhn), phone (9 to 15
digits). The method adds iban spans (ISO 13616 form, confirmed by mod 97). All positions are code points, ends exclusive.

The patterns here are written so that a scan is linear and never recurses: a match may only start where a run of
its characters starts or the last match ended (every later start in the run would need the same
continuation), repeated groups are possessive, and digit runs of a card are matched only when they are whole and of a length that can pass. The
strings between matches and the matches themselves give the positions, so each text is scanned twice for a
kind, and only if a cheap test finds its characters. Positions are running sums by chunks, and parts of a text are
taken from its blocks of ``2 ** BLOCK`` code points, so that a text with very many spans costs time in proportion to its length.

Score of a span: the kind's own confidence, raised by ``NEAR`` when one of the kind's context words stands within
``REACH`` code points before or after it. Base spans stay whatever their score; added spans need ``LEAST``.

Edge cases: null and empty texts have no spans; repeated rows and null ids are each answered; an empty table gives an empty
result; extra columns are ignored by find() and kept by redact(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, table

LOCAL = "A-Za-z0-9._%+-"
LABEL = "A-Za-z0-9-"
#: kind: (what a text must contain, pattern, confidence, context words)
KINDS = {
    "email": ("@", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)++", 0.9, "e-?mail|mail|contact|write|courriel|correo"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\bip\b|address|host|server|login|adresse"),
    "card": (r"[0-9][ -]?[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])", 0.8, "card|visa|master|credit|debit|carte|karte|tarjeta"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.5, "phone|tel|call|mobile|fax|anruf|llam"),
    "iban": ("[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, r"iban|bank|account|konto|compte|cuenta"),
}
BASE = ("email", "ip", "card", "phone")
NEAR, REACH, LEAST = 0.2, 40, 0.5
#: Logarithms of the rows of a chunk of running values and of the code points of a block of text.
CHUNK, BLOCK = 8, 10
SPANS = "array<struct<s:int,e:int,kind:string,score:double>>"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _fold(values: Column, op) -> Column:
    """Running values of a short array, by copying what was there."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc, x):
        return _let(op(acc["at"], x), lambda v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out")))

    return F.aggregate(values, start, add, lambda acc: acc["out"])


def _running(values: Column, op, levels: int = 1) -> Column:
    """op over all values up to each one of an array that isn't empty; values are at least 0, op has 0 as its neutral element."""
    if levels == 0:
        return _fold(values, op)

    def from_parts(parts):
        totals = F.transform(parts, lambda p: F.element_at(p, -1))
        return _let(_running(totals, op, levels - 1), lambda upto: F.flatten(F.transform(parts, lambda p, c: _let(F.when(c == 0, 0).otherwise(F.get(upto, c - 1)), lambda base: F.transform(p, lambda v: op(base, v))))))

    def from_values(v):
        chunks = F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, CHUNK))
        return _let(F.transform(chunks, lambda c: _fold(F.slice(v, F.shiftleft(c, CHUNK) + 1, 1 << CHUNK), op)), from_parts)

    return _let(values, from_values)


def _found(t: Column, pattern: str) -> Column:
    """All matches (s, e, m) with their positions, from the strings between them and the matches."""
    both = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("b"))

    def placed(x):
        steps = F.transform(x["m"], lambda m, i: F.char_length(F.get(x["b"], i)) + F.char_length(m))
        ends = F.arrays_zip(x["m"].alias("m"), _running(steps, lambda p, q: p + q).alias("e"))
        out = F.transform(ends, lambda y: F.struct((y["e"] - F.char_length(y["m"])).alias("s"), y["e"].alias("e"), y["m"].alias("m")))
        return F.when(F.size(x["m"]) > 0, out)

    return F.coalesce(_let(both, placed), F.array().cast("array<struct<s:int,e:int,m:string>>"))


def _blocks(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{1 << BLOCK}}}"), F.lit(0))


def _part(blocks: Column, lo: Column, hi: Column) -> Column:
    """The text's code points from lo up to hi; hi is not below lo."""
    first = F.shiftright(lo, BLOCK)
    few = F.array_join(F.slice(blocks, first + 1, F.shiftright(hi - 1, BLOCK) - first + 1), "")
    return F.substring(few, lo - F.shiftleft(first, BLOCK) + 1, hi - lo)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the right, with every second doubled, sum to a multiple of ten."""
    each = F.split(F.reverse(digits), "")

    def value(c, i):
        d = F.ascii(c) - 48
        twice = d * 2
        return F.when(c == "", 0).when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(each, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(m: Column) -> Column:
    plain = F.translate(m, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).when(c < "A", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return (F.char_length(plain).between(15, 34)) & (rest == 1)


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return _luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    if kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _test(kind: str):
    return lambda x: _valid(kind, x["m"])


def _scored(kind: str, sure: float, words: str, blocks: Column):
    def scored(x):
        around = F.lower(F.concat(_part(blocks, F.greatest(x["s"] - REACH, F.lit(0)), x["s"]), F.lit("\n"), _part(blocks, x["e"], x["e"] + REACH)))
        score = F.lit(sure) + F.when(around.rlike(words), NEAR).otherwise(0.0)
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), score.cast("double").alias("score"))

    return scored


def _spans(t: Column, kind: str) -> Column:
    """The spans (s, e, kind, score) of a kind in a text, in order."""
    needs, pattern, sure, words = KINDS[kind]

    def judged(good):
        scored = _let(_blocks(t), lambda blocks: F.transform(good, _scored(kind, sure, words, blocks)))
        return F.when(F.size(good) > 0, scored if kind in BASE else F.filter(scored, lambda x: x["score"] >= LEAST))

    test = F.contains(t, F.lit(needs)) if needs == "@" else t.rlike(needs)
    found = F.when(test, _let(F.filter(_found(t, pattern), _test(kind)), judged))
    return F.coalesce(found, F.array()).cast(SPANS)


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _joined(spans: Column, score: bool = False) -> Column:
    def one(x):
        cells = [x["kind"], x["s"].cast("string"), x["e"].cast("string")]
        return F.concat_ws(":", *cells, *([F.format_number(x["score"], 2)] if score else []))

    return F.concat_ws(",", F.transform(spans, one))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, the number of spans of each base kind, the digest of the base spans, all spans, and all with their scores."""
    cols = {k: fresh_name([id_col, text], k) for k in KINDS}
    found = docs.select(id_col, *[_spans(_text(text), k).alias(c) for k, c in cols.items()])
    base, all_ = (F.concat(*[F.col(cols[k]) for k in kinds]) for kinds in (BASE, KINDS))
    return found.select(
        id_col,
        *[F.size(cols[k]).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(all_).alias("spans"),
        _joined(all_, score=True).alias("scores"),
    )


def redacted(t: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans give one replacement, by the one that starts first."""

    def cut(x):
        reach = _running(F.transform(x["spans"], lambda y: y["e"]), F.greatest)  # the end of all spans so far

        def pieces(reach):
            before = lambda i: F.when(i == 0, 0).otherwise(F.get(reach, i - 1))
            each = F.transform(x["spans"], lambda y, i: F.when(y["s"] >= before(i), F.concat(_part(x["blocks"], before(i), y["s"]), F.lit("<"), F.upper(y["kind"]), F.lit(">"))).otherwise(""))
            return F.concat(F.array_join(each, ""), _part(x["blocks"], F.element_at(reach, -1), F.greatest(F.char_length(t), F.element_at(reach, -1))))

        return _let(reach, pieces)

    def replaced(spans):
        return F.when(F.size(spans) > 0, _let(F.struct(spans.alias("spans"), _blocks(t).alias("blocks")), cut)).otherwise(t)

    return _let(F.array_sort(F.concat(*[_spans(t, k) for k in KINDS])), replaced)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with redacted texts. A null text stays null."""
    new = F.when(F.col(text).isNotNull(), redacted(_text(text)))
    return docs.withColumn(text, new)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
