"""Ordered changes of a store, each applied once, with a ledger beside the tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..plans.store import TABLE_KEYS, ParquetStore, table_schema
from . import files

#: A migration is a function of the store, or SQL statements separated by ; with {{ root }} for the store's folder.
Migration = Callable[[ParquetStore], None] | str


class NewerStore(RuntimeError):
    """The ledger names a migration that this version doesn't know."""


def statements(text: str, root: str) -> list[str]:
    out = []
    for part in text.replace("{{ root }}", root).split(";"):
        lines = [x for x in part.splitlines() if x.strip() and not x.strip().startswith("--")]
        if lines:
            out.append("\n".join(lines).strip())
    return out


def ledger(store: ParquetStore) -> list[str]:
    path = f"{store.root}/_migrations"
    if not files.exists(store.spark, path):
        return []
    return [r.id for r in store.spark.read.schema("id string, applied_at timestamp").parquet(path).select("id").distinct().orderBy("id").collect()]


def migrate(store: ParquetStore, known: dict[str, Migration]) -> list[str]:
    """Apply what isn't in the ledger, in the order of names. Refuses a store that is ahead of what is known."""
    done = ledger(store)
    last = max(known, default="")
    ahead = [m for m in done if m not in known and m > last]
    if ahead:
        raise NewerStore(f"the store has migrations of a newer version: {', '.join(ahead)}")
    applied = []
    for name in sorted(set(known) - set(done)):
        step = known[name]
        if callable(step):
            step(store)
        else:
            for s in statements(step, store.root):
                store.spark.sql(s)
        row = store.spark.createDataFrame([(name, datetime.now(timezone.utc))], "id string, applied_at timestamp")
        row.coalesce(1).write.mode("append").parquet(f"{store.root}/_migrations")
        applied.append(name)
    store.refresh()
    return applied


def init_schema(store: ParquetStore, known: dict[str, Migration] | None = None) -> list[str]:
    """Empty tables where there are none, then the migrations. May be called again."""
    for name in TABLE_KEYS:
        if not files.exists(store.spark, store.path(name)):
            store.append(name, store.spark.createDataFrame([], table_schema(name)), 0)
    return migrate(store, known or {})


def last_migration(store: ParquetStore) -> str | None:
    path = f"{store.root}/_migrations"
    return store.spark.read.parquet(path).agg(F.max("id")).first()[0] if files.exists(store.spark, path) else None
