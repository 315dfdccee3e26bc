"""The engine's calls as a service would offer them: plain values in, plain values out, errors with a status."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from .operators import flows, geoip, ingest, reassembly
from .plans import search as S
from .plans.language import FilterError
from .plans.store import ParquetStore, Store
from .registry import display_schema


class ServiceError(Exception):
    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def _scope(sessions=(), start=None, end=None) -> S.Scope:
    try:
        return S.Scope(tuple(int(x) for x in sessions or ()), start, end)
    except ValueError as e:
        raise ServiceError(400, f"a session is a decimal number: {e}") from e


class Service:
    def __init__(self, store: Store, city=None, asn=None):
        self.store, self.spark = store, store.spark
        self.city = city if city is not None else self.spark.createDataFrame([], geoip.CITY_SCHEMA)
        self.asn = asn if asn is not None else self.spark.createDataFrame([], geoip.ASN_SCHEMA)

    def _rows(self, df) -> list[dict]:
        return [json.loads(r.json) for r in S.to_json_rows(df).collect()]

    def _try(self, f: Callable):
        try:
            return f()
        except (FilterError, AnalysisException) as e:
            raise ServiceError(422, str(e)) from e

    def search(self, filter: str = "", components=(), sessions=(), start=None, end=None, limit=None, offset=0, descending=True) -> dict:
        n = S.clamp_search(limit)
        rows = self._try(lambda: self._rows(S.search(self.store, filter, tuple(components), n, _scope(sessions, start, end), descending, offset, sensor=True)))
        total = self._try(lambda: S.count_matching(self.store, filter, _scope(sessions, start, end)).first()[0])
        return {"rows": rows, "count": len(rows), "total": total}

    def histogram(self, filter: str = "", bin_seconds: int = 60, breakdown: str | None = None, sessions=(), start=None, end=None, tz_seconds: int = 0) -> list[dict]:
        width = max(0, bin_seconds) * 1_000_000_000
        return self._try(lambda: self._rows(S.histogram(self.store, filter, width, tz_seconds * 1_000_000_000, _scope(sessions, start, end), breakdown)))

    def packet(self, session: str, packet_id: int) -> dict:
        rows = S.details(self.store, _scope([session]).sessions[0], packet_id).select(F.to_json(F.struct("*")).alias("j")).collect()
        if not rows:
            raise ServiceError(404, "no such packet")
        return json.loads(rows[0].j)

    def frame(self, session: str, packet_id: int) -> str:
        text = f"packet.packet_id = {int(packet_id)}"
        rows = reassembly.export_frames(self.store, text, _scope([session])).collect()
        if not rows:
            raise ServiceError(404, "no such packet")
        if rows[0].error:
            raise ServiceError(422, rows[0].error)
        return bytes(rows[0].frame).hex()

    def captures(self) -> list[dict]:
        return self._rows(self.store.sessions())

    def count_packets(self, session: str) -> int:
        return S.count_matching(self.store, "", _scope([session])).first()[0]

    def export(self, path: str, filter: str = "", sessions=(), start=None, end=None) -> int:
        return self._try(lambda: ingest.export(self.store, path, filter, _scope(sessions, start, end)))

    def streams(self, sessions=(), l7=None, start=None, end=None, limit=None, offset=0) -> dict:
        s = _scope(sessions).sessions
        rows = self._rows(flows.list_streams(self.store, s, l7, start, end, limit, offset))
        return {"rows": rows, "total": flows.count_streams(self.store, s, l7, start, end).first()[0]}

    def places(self, addresses: list[str]) -> list[dict]:
        if not addresses:
            return []
        df = self.spark.createDataFrame([(a,) for a in dict.fromkeys(addresses)], "ip string")
        return self._rows(geoip.lookup(df, self.city, self.asn))

    def schema(self) -> dict:
        return display_schema()

    def preview(self, filter: str = "", components=(), limit=None, sessions=(), start=None, end=None) -> dict:
        return self._try(lambda: {"sql": S.explain_sql(filter, tuple(components), _scope(sessions, start, end), S.clamp_preview(limit))})

    def execute(self, sql: str) -> dict:
        df = self._try(lambda: self.store.sql(sql))
        return {"columns": df.columns, "rows": self._try(lambda: self._rows(df))}

    def reencode(self, filter: str = "", sessions=()) -> dict:
        if not isinstance(self.store, ParquetStore):
            raise ServiceError(400, "this store can't be written")
        return vars(ingest.reencode(self.store, filter, _scope(sessions)))


#: path: (method of Service, HTTP verb). Bodies and answers are JSON.
ROUTES = {
    "/v1/search": ("search", "POST"), "/v1/stats/hist": ("histogram", "POST"), "/v1/packet": ("packet", "POST"), "/v1/frame": ("frame", "POST"), "/v1/captures": ("captures", "GET"), "/v1/streams": ("streams", "POST"),
    "/v1/geoip/batch": ("places", "POST"), "/v1/query/schema": ("schema", "GET"), "/v1/query/preview": ("preview", "POST"), "/v1/query/execute": ("execute", "POST"), "/v1/export": ("export", "POST"), "/v1/admin/re-encode": ("reencode", "POST"),
}


def application(service: Service):
    """A WSGI application over a service."""

    def app(environ, start_response):
        def answer(status: int, value) -> list[bytes]:
            start_response(f"{status} {'OK' if status == 200 else 'Error'}", [("Content-Type", "application/json")])
            return [json.dumps(value).encode()]

        route = ROUTES.get(environ.get("PATH_INFO", ""))
        if route is None or environ.get("REQUEST_METHOD") != route[1]:
            return answer(404, {"error": "no such call"})
        try:
            size = int(environ.get("CONTENT_LENGTH") or 0)
            args = json.loads(environ["wsgi.input"].read(size) or b"{}") if size else {}
            return answer(200, getattr(service, route[0])(**args))
        except ServiceError as e:
            return answer(e.status, {"error": str(e)})
        except (TypeError, ValueError) as e:
            return answer(400, {"error": str(e)})

    return app
