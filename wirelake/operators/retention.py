"""Keeping a store under a size: whole days go first, oldest first, then sessions without packets."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import TABLE_KEYS, ParquetStore
from ..registry import in_sessions
from . import files

log = logging.getLogger(__name__)
MANAGED = tuple(TABLE_KEYS)
_UNITS = {"": 1024, "k": 1024, "m": 1024**2, "g": 1024**3, "t": 1024**4}


def parse_size(text: str) -> int:
    """Bytes: 42, 42B; bare K, M, G, T and KiB … are powers of 1024, KB … of 1000; a small b counts bits, which must make whole bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([KkMmGgTt]?)(i?)([bB]?)\s*", text)
    if not m or (m[3] and not m[2]) or (m[3] and not m[4]):
        raise ValueError(f"not a size: {text!r}")
    power = " kmgt".index(m[2].lower()) if m[2] else 0
    base = 1000 if m[2] and m[4] and not m[3] else 1024
    amount = float(m[1]) * base**power if "." in m[1] else int(m[1]) * base**power
    if m[4] == "b":
        amount = amount / 8
    if amount != int(amount) or amount <= 0:
        raise ValueError(f"not a positive number of whole bytes: {text!r}")
    return int(amount)


def orphans(sessions: DataFrame, packets: DataFrame) -> DataFrame:
    """Sessions without packets."""
    return sessions.join(packets.select("session_id").distinct(), "session_id", "left_anti")


@dataclass
class Report:
    before: int
    after: int = 0
    dropped_days: list[str] = field(default_factory=list)
    kept_days: list[str] = field(default_factory=list)
    dropped_sessions: int = 0


def stored_bytes(store: ParquetStore) -> int:
    return sum(files.size(store.spark, store.path(t)) for t in MANAGED)


def enforce(store: ParquetStore, most: int, protected: tuple[int, ...] = ()) -> Report:
    """Drop the oldest days until the store fits; days with packets of protected sessions stay. Then rows of sessions that have no packets left go."""
    spark, report = store.spark, Report(stored_bytes(store))
    report.after = report.before
    if report.before <= most:
        return report
    for day in files.folders(spark, store.path("packets")):
        if report.after <= most:
            break
        path = f"{store.path('packets')}/{day}"
        if protected and not spark.read.parquet(path).where(in_sessions(protected)).isEmpty():
            report.kept_days.append(day)
            continue
        files.delete(spark, path)
        report.dropped_days.append(day)
        report.after = stored_bytes(store)
    if report.dropped_days:
        store.refresh()
        gone = orphans(store.table("captures").select("session_id"), store.table("packets"))
        if protected:
            gone = gone.where(~in_sessions(protected))
        gone = spark.createDataFrame(gone.collect(), gone.schema)  # one row for each capture; the files behind it are replaced below
        report.dropped_sessions = gone.count()
        for name in MANAGED:
            if name != "packets" and report.dropped_sessions and store.exists(name):
                files.replace_folder(store.raw(name).join(gone, "session_id", "left_anti"), store.path(name), [])
        store.refresh()
        report.after = stored_bytes(store)
    if report.after > most:
        log.warning("the store has %d bytes, more than %d; protected days stay", report.after, most)
    return report
