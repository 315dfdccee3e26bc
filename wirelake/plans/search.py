"""Questions about packets: search pages, histograms, breakdowns, counts, details, and the SQL that says the same."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import address as A
from ..registry import ALIASES, COMPONENTS, KEYS, Component, default_sql, in_sessions, session_literal
from .language import Filter, FilterError, compile_filter
from .store import Store, day_of

ORDER = ("ts", "session_id", "packet_id")
#: Page sizes of the service. Fixed values.
SEARCH_DEFAULT, SEARCH_MOST, PREVIEW_MOST, STREAMS_DEFAULT, STREAMS_MOST = 1000, 10_000, 10_000, 100, 1000


@dataclass(frozen=True)
class Cursor:
    ts: int
    session_id: int
    packet_id: int


@dataclass(frozen=True)
class Scope:
    """Which packets a question is about, beside its filter. Time bounds are nanoseconds, both inclusive; None is open."""

    sessions: tuple[int, ...] = ()
    start: int | None = None
    end: int | None = None


def clamp_search(limit: int | None) -> int:
    return SEARCH_DEFAULT if not limit or limit < 0 or limit > SEARCH_MOST else limit


def clamp_preview(limit: int | None) -> int:
    return SEARCH_DEFAULT if not limit or limit < 0 else min(limit, PREVIEW_MOST)


def clamp_streams(limit: int | None) -> int:
    return STREAMS_DEFAULT if not limit or limit < 0 or limit > STREAMS_MOST else limit


def _on(left: str, right: str) -> Column:
    return (F.col(f"{left}.session_id") == F.col(f"{right}.session_id")) & (F.col(f"{left}.packet_id") == F.col(f"{right}.packet_id"))


def scoped(p: DataFrame, scope: Scope) -> DataFrame:
    """Packet rows within the scope."""
    if scope.sessions:
        p = p.where(in_sessions(scope.sessions))
    for bound, sign in ((scope.start, ">="), (scope.end, "<=")):
        if bound is not None:
            p = p.where(f"ts {sign} {int(bound)}")
            if "day" in p.columns:  # partitions of other days aren't read
                day = day_of(F.lit(int(bound)))
                p = p.where(F.col("day") >= day if sign == ">=" else F.col("day") <= day)
    return p


def joined(store: Store, f: Filter, scope: Scope = Scope(), components: tuple[str, ...] = (), mode: str = "inner") -> DataFrame:
    """Packets joined to what the filter refers to, and filtered. Sides are aliased p, captures and by component.

    mode inner: a packet needs a row in every referenced component; presence: a missing component makes only its own predicates fail.
    """
    if mode not in ("inner", "presence"):
        raise ValueError(mode)
    out = scoped(store.table("packets"), scope).alias("p")
    for name in sorted({*f.components, *components}):
        how = "inner" if mode == "inner" or name in components else "left"
        out = out.join(store.table(name).alias(name), _on("p", name), how)
    if f.needs_captures:
        # Spark broadcasts the captures if their size allows it
        out = out.join(store.table("captures").alias("captures"), F.col("p.session_id") == F.col("captures.session_id"))
    return out.where(f.column())


def _filter(text: str | Filter) -> Filter:
    return text if isinstance(text, Filter) else compile_filter(text)


def matching(store: Store, text: str | Filter, scope: Scope = Scope(), mode: str = "inner") -> DataFrame:
    """(ts, session_id, packet_id) of the packets that match, each once."""
    f = _filter(text)
    rows = joined(store, f, scope, mode=mode).select("p.ts", "p.session_id", "p.packet_id")
    many = any(COMPONENTS[c].repeatable for c in f.components)
    return rows.dropDuplicates(list(KEYS)) if many else rows


def page(store: Store, text: str | Filter, limit: int, scope: Scope = Scope(), descending: bool = False, offset: int = 0, cursor: Cursor | None = None, mode: str = "inner") -> DataFrame:
    """One page of matching keys in the order of time, session and packet. A cursor goes on after its key; the offset counts only without one."""
    rows = matching(store, text, scope, mode)
    if cursor is not None:
        sign = "<" if descending else ">"
        t, s, p = cursor.ts, cursor.session_id, cursor.packet_id
        rows = rows.where(f"ts {sign} {t} or (ts = {t} and (session_id {sign} {s} or (session_id = {s} and packet_id {sign} {p})))")
    rows = rows.orderBy(*[F.desc(c) if descending else F.asc(c) for c in ORDER])
    if offset and cursor is None:
        rows = rows.offset(offset)
    return rows.limit(limit)


def _display(comp: Component, name: str, raw: bool) -> Column:
    c, kind = F.col(f"{comp.name}.{name}"), comp.column(name).kind
    if raw:
        return F.coalesce(c, F.expr(default_sql(kind)).cast(comp.column(name).type))
    shown = {"ip4": A.ip4_text, "ip6": A.ip6_text, "mac": lambda x: F.lower(F.hex(x)), "binary": lambda x: F.lower(F.hex(x))}.get(kind, lambda x: x)
    empty = {"ip4": "'0.0.0.0'", "ip6": "'::'", "mac": "'000000000000'", "binary": "''"}.get(kind, default_sql(kind))
    return F.coalesce(shown(c), F.expr(empty))


def search(store: Store, text: str, components: tuple[str, ...] = (), limit: int = SEARCH_DEFAULT, scope: Scope = Scope(), descending: bool = False, offset: int = 0, cursor: Cursor | None = None, sensor: bool = False, raw: bool = False, mode: str = "inner") -> DataFrame:
    """A page of packets with the columns of chosen components; layers that a packet lacks show their types' defaults.

    Keys are found, ordered and cut first; only the page is joined to packets and components. Of a repeatable component the first layer is shown.
    """
    for c in components:
        if c not in COMPONENTS:
            raise FilterError(f"unknown component {c!r}")
    keys = page(store, text, limit, scope, descending, offset, cursor, mode).select(*KEYS)
    out = scoped(store.table("packets"), scope).alias("p").join(keys.alias("k"), _on("p", "k"), "left_semi")
    for name in components:
        side = store.table(name)
        if COMPONENTS[name].repeatable:
            first = Window.partitionBy(*KEYS).orderBy("layer_index")
            side = side.join(keys, list(KEYS), "left_semi").withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
        out = out.join(side.alias(name), _on("p", name), "left")
    head = [F.col("p.session_id"), F.col("p.packet_id"), F.col("p.ts").alias("timestamp_ns"), F.col("p.incl_len"), (F.col("p.incl_len") + F.col("p.trunc_extra")).alias("orig_len"), F.col("p.components")]
    if sensor:
        out = out.join(store.table("captures").alias("captures"), F.col("p.session_id") == F.col("captures.session_id"), "left")
        head.append(F.coalesce("captures.sensor", F.lit("")).alias("sensor"))
    rest = [_display(COMPONENTS[n], c.name, raw).alias(COMPONENTS[n].shown(c.name)) for n in components for c in COMPONENTS[n].columns]
    sign = F.desc if descending else F.asc
    return out.select(*head, *rest).orderBy(sign("timestamp_ns"), sign("session_id"), sign("packet_id"))


def to_json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON text: wide unsigned numbers as decimal strings, bytes as hex."""
    cols = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        cols.append((c.cast("string") if kind.startswith("decimal") else F.lower(F.hex(c)) if kind == "binary" else c).alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def bin_start(ts: Column, width: int, tz: int = 0) -> Column:
    """The start of a time bin; widths and shifts are nanoseconds, division truncates toward zero."""
    shifted = ts + F.lit(tz).cast("long")
    return (shifted - shifted % F.lit(width).cast("long") - F.lit(tz).cast("long")).cast("long")


PROTO = "proto"


def proto_label(components: Column) -> Column:
    """Names of the layers that are present, in canonical order, joined by /."""
    names = F.array(*[F.when(components.bitwiseAND(c.mask) != 0, c.name).otherwise("") for c in COMPONENTS.values()])
    return F.array_join(F.filter(names, lambda x: x != ""), "/")


def breakdown_fields(text: str) -> list[tuple[str, str]]:
    """component.column pairs of a breakdown; raises for anything else."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if not part:
            continue
        comp, dot, name = part.partition(".")
        if not dot:
            raise FilterError(f"a breakdown field is component.column, got {part!r}")
        if comp not in COMPONENTS:
            raise FilterError(f"unknown component {comp!r} in a breakdown")
        if (comp, name) not in ALIASES:
            try:
                COMPONENTS[comp].column(name)
            except KeyError as e:
                raise FilterError(f"unknown column {part!r} in a breakdown") from e
        out.append((comp, name))
    if not out:
        raise FilterError("a breakdown needs a field")
    return out


def _value(comp: str, name: str) -> Column:
    c, kind = F.col(f"{comp}.{name}"), COMPONENTS[comp].column(name).kind
    show = {"ip4": A.ip4_text, "ip6": A.ip6_text, "mac": lambda x: F.lower(F.hex(x)), "binary": lambda x: F.lower(F.hex(x))}.get(kind, lambda x: x.cast("string"))
    return show(c)


def histogram(store: Store, text: str = "", width: int = 60_000_000_000, tz: int = 0, scope: Scope = Scope(), breakdown: str | None = None, exact: bool = False, mode: str = "inner") -> DataFrame:
    """Counts by time bin, and by the values of a breakdown if one is given; only bins with packets.

    A packet counts once for each joined row (stacked layers, both ends of an alias); with exact, once for each value.
    """
    if width < 1:
        width = 60_000_000_000
    f = _filter(text)
    if breakdown is None:
        rows = joined(store, f, scope, mode=mode).select(*[F.col(f"p.{k}") for k in KEYS], F.col("p.ts").alias("ts"))
        rows = rows.dropDuplicates(list(KEYS)) if exact else rows
        return rows.groupBy(bin_start(F.col("ts"), width, tz).alias("bin")).agg(F.count(F.lit(1)).alias("count")).orderBy("bin")
    if breakdown.strip() == PROTO:
        value, comps = proto_label(F.col("p.components")), ()
    else:
        fields = breakdown_fields(breakdown)
        comps = tuple(c for c, _ in fields)
        each = [F.array(*[_value(c, n) for n in ALIASES.get((c, name), (name,))]) for c, name in fields]
        value = each[0]
        for more in each[1:]:
            value = F.flatten(F.transform(value, _paired(more)))
        value = F.explode(value)
    rows = joined(store, f, scope, comps, mode).select(*[F.col(f"p.{k}") for k in KEYS], F.col("p.ts").alias("ts"), value.alias("breakdown_value"))
    rows = rows.dropDuplicates([*KEYS, "breakdown_value"]) if exact else rows
    return rows.groupBy(bin_start(F.col("ts"), width, tz).alias("bin"), "breakdown_value").agg(F.count(F.lit(1)).alias("count")).orderBy("bin", "breakdown_value")


def _paired(more: Column):
    return lambda x: F.transform(more, lambda y: F.concat_ws(" / ", x, y))


def count_matching(store: Store, text: str = "", scope: Scope = Scope()) -> DataFrame:
    return matching(store, text, scope).agg(F.count(F.lit(1)).alias("count"))


def point(store: Store, session_id: int, packet_id: int) -> DataFrame:
    return store.table("packets").where((F.col("session_id") == session_literal(session_id)) & (F.col("packet_id") == packet_id))


def details(store: Store, session_id: int, packet_id: int) -> DataFrame:
    """One row: the packet's head, and for each component that it has a struct of display values, or an array of them by layer."""
    out = point(store, session_id, packet_id).alias("p")
    cols = [F.col("p.session_id").cast("string").alias("session_id"), F.col("p.packet_id"), F.col("p.ts").alias("timestamp_ns"), F.col("p.incl_len"), (F.col("p.incl_len") + F.col("p.trunc_extra")).alias("orig_len"), proto_label(F.col("p.components")).alias("proto")]
    for name, comp in COMPONENTS.items():
        t = store.table(name).where((F.col("session_id") == session_literal(session_id)) & (F.col("packet_id") == packet_id)).alias(name)
        shown = [_display(comp, c.name, False).alias(comp.shown(c.name)) for c in comp.columns]
        side = t.groupBy(*[F.col(f"{name}.{k}").alias(k) for k in KEYS]).agg(F.array_sort(F.collect_list(F.struct(F.col(f"{name}.layer_index").alias("layer_index"), *shown))).alias("items")).alias(f"s_{name}")
        out = out.join(side, (F.col("p.session_id") == F.col(f"s_{name}.session_id")) & (F.col("p.packet_id") == F.col(f"s_{name}.packet_id")), "left")
        cols.append((F.col(f"s_{name}.items") if comp.repeatable else F.get(F.col(f"s_{name}.items"), F.lit(0))).alias(name))
    return out.select(*cols)


def explain_sql(text: str, components: tuple[str, ...] = (), scope: Scope = Scope(), limit: int | None = None) -> str:
    """Spark SQL over the store's views that finds the packets and shows chosen components."""
    f = compile_filter(text)
    joins = "".join(f" JOIN {c} AS {c} ON p.session_id = {c}.session_id AND p.packet_id = {c}.packet_id" for c in f.components)
    if f.needs_captures:
        joins += " JOIN captures AS captures ON p.session_id = captures.session_id"
    where = [f.sql()]
    if scope.sessions:
        where.append(f"p.session_id IN ({', '.join(str(int(s)) for s in scope.sessions)})")
    where += [f"p.ts {sign} {int(x)}" for x, sign in ((scope.start, ">="), (scope.end, "<=")) if x is not None]
    ids = f"SELECT p.session_id, p.packet_id FROM packets AS p{joins} WHERE {' AND '.join(where)}"
    show = "".join(f", {c}.* EXCEPT (session_id, packet_id, codec_version, layer_index)" for c in components)
    left = "".join(f" LEFT JOIN {c} AS {c} ON p.session_id = {c}.session_id AND p.packet_id = {c}.packet_id" for c in components)
    tail = f" ORDER BY p.ts, p.session_id, p.packet_id LIMIT {limit}" if limit else ""
    return f"SELECT p.*{show} FROM packets AS p{left} WHERE (p.session_id, p.packet_id) IN ({ids}){tail}"
