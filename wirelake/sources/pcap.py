"""Capture files: classic PCAP and PCAPng to rows, rows to PCAP.

``read_captures`` goes through Spark's binaryFile source, so it reads from any store; a file is one row there, which bounds it to 2 GB.
The data source ``pcap`` (register with ``register``) streams records instead, splits large classic files at record borders found
by hopping from header to header, and needs a file system that executors can open.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.address import session_id
from ..registry import SESSION

#: First bytes of a file: (byte order, nanoseconds). Fixed values.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True)}
NG = b"\x0a\x0d\x0d\x0a"
SNAPLEN = 65535
FRAMES = T.StructType([T.StructField("path", T.StringType()), T.StructField("packet_id", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("orig_len", T.LongType()), T.StructField("linktype", T.LongType()), T.StructField("frame", T.BinaryType())])


class CaptureError(ValueError):
    """Not a capture file, or a broken one."""


@dataclass(frozen=True)
class Meta:
    endianness: str
    time_res: str
    snaplen: int
    linktype: int
    header: bytes

    @property
    def order(self) -> str:
        return "<" if self.endianness == "le" else ">"

    @property
    def unit(self) -> int:
        return 1 if self.time_res == "ns" else 1000


@dataclass(slots=True)
class Frame:
    ts: int
    orig_len: int
    linktype: int
    data: bytes


def parse_header(b: bytes) -> Meta:
    if b[:4] == NG:
        return Meta("le", "ns", SNAPLEN, _ng_linktype(b), b"")
    if len(b) < 24 or b[:4] not in MAGIC:
        raise CaptureError("neither PCAP nor PCAPng")
    order, nano = MAGIC[b[:4]]
    snaplen, linktype = struct.unpack_from(order + "II", b, 16)
    return Meta("le" if order == "<" else "be", "ns" if nano else "us", snaplen, linktype & 0x0FFFFFFF, b[:24])


def frames(data: bytes, most: int | None = None) -> Iterator[Frame]:
    """All records; a record that is cut short at the end of the file is left out. most: the longest frame that is believed."""
    if data[:4] == NG:
        yield from _ng_frames(data)
        return
    meta, at = parse_header(data), 24
    while at + 16 <= len(data):
        sec, frac, incl, orig = struct.unpack_from(meta.order + "IIII", data, at)
        if most is not None and incl > most:
            raise CaptureError(f"a frame of {incl} bytes at {at}")
        if at + 16 + incl > len(data):
            return
        yield Frame(sec * 1_000_000_000 + frac * meta.unit, max(orig, incl), meta.linktype, data[at + 16 : at + 16 + incl])
        at += 16 + incl


def _ng_blocks(data: bytes) -> Iterator[tuple[str, int, bytes]]:
    at, order = 0, "<"
    while at + 12 <= len(data):
        if data[at : at + 4] == NG:
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or size % 4 or at + size > len(data):
            return
        yield order, kind, data[at + 8 : at + size - 4]
        at += size


def _ng_interface(order: str, body: bytes) -> tuple[int, int, int]:
    """Link type, and ticks per second as (base, exponent)."""
    (linktype,) = struct.unpack_from(order + "H", body)
    base, exp, at = 10, 6, 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9 and size == 1:
            v = body[at + 4]
            base, exp = (2, v & 0x7F) if v & 0x80 else (10, v)
        at += 4 + (size + 3) // 4 * 4
    return linktype, base, exp


def _ng_linktype(data: bytes) -> int:
    for order, kind, body in _ng_blocks(data):
        if kind == 1:
            return _ng_interface(order, body)[0]
    return 1


def _ng_frames(data: bytes) -> Iterator[Frame]:
    faces: list[tuple[int, int, int]] = []
    for order, kind, body in _ng_blocks(data):
        if kind == 0x0A0D0D0A:
            faces = []
        elif kind == 1:
            faces.append(_ng_interface(order, body))
        elif kind in (6, 2):
            if kind == 6:
                face, hi, lo, incl, orig = struct.unpack_from(order + "IIIII", body)
            else:
                face, _, hi, lo, incl, orig = struct.unpack_from(order + "HHIIII", body)
            if face >= len(faces):
                raise CaptureError("a packet of an unknown interface")
            linktype, base, exp = faces[face]
            yield Frame((hi << 32 | lo) * 1_000_000_000 // base**exp, max(orig, incl), linktype, body[20 : 20 + incl])
        elif kind == 3 and faces:
            (orig,) = struct.unpack_from(order + "I", body)
            yield Frame(0, orig, faces[0][0], body[4 : 4 + orig])


def resolve(patterns: list[str]) -> list[str]:
    """Files that patterns name, each once, in the order found; a pattern that names none is an error, and standard input (-) stands alone."""
    if "-" in patterns:
        if len(patterns) > 1:
            raise ValueError("standard input can't be mixed with files")
        return ["-"]
    out: dict[str, None] = {}
    for p in patterns:
        found = sorted(glob.glob(p)) or ([p] if os.path.exists(p) else [])
        if not found:
            raise FileNotFoundError(p)
        out.update(dict.fromkeys(found))
    return list(out)


def spool(stream, folder: str, name: str = "stdin.pcap") -> str:
    """Copy a stream into a file that can be read like others; its session id then comes from its bytes."""
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        while chunk := stream.read(1 << 20):
            f.write(chunk)
    return path


def captures(files: DataFrame, sensor: str = "") -> DataFrame:
    """Rows of binaryFile to capture rows, with the path."""
    name = F.element_at(F.split("path", "/"), -1)
    head = files.select("path", session_id(name, F.col("content")).alias("session_id"), F.col("content"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    m = parse_header(r["content"])
                except CaptureError:
                    continue
                out.append({"path": r["path"], "session_id": r["session_id"], "sensor": sensor, "endianness": m.endianness, "snaplen": m.snaplen, "linktype": m.linktype, "time_res": m.time_res, "global_header_raw": m.header, "codec_version": 1, "codec_profile": "layers-v1"})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from ..registry import CAPTURE_COLUMNS, schema_of

    kind = T.StructType([T.StructField("path", T.StringType()), *schema_of(CAPTURE_COLUMNS).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)
    return head.mapInArrow(run, kind)


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def _batch(row: dict, found: list[Frame], first: int, schema: pa.Schema) -> pa.RecordBatch:
    n = len(found)
    cols = [[row["session_id"]] * n, [row["path"]] * n, range(first, first + n), [f.ts for f in found], [f.orig_len for f in found], [f.linktype for f in found], [f.data for f in found]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def read_frames(files: DataFrame, most: int | None = None) -> DataFrame:
    """Rows of binaryFile to frames with their session id. Files that aren't captures give none."""
    name = F.element_at(F.split("path", "/"), -1)
    keyed = files.select("path", "content", session_id(name, F.col("content")).alias("session_id"))
    kind = T.StructType([T.StructField("session_id", SESSION), *FRAMES.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(kind)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                found, first = [], 0
                try:
                    for f in frames(row["content"], most):
                        found.append(f)
                        if len(found) == 5000:
                            yield _batch(row, found, first, schema)
                            first += len(found)
                            found = []
                except CaptureError:
                    pass
                if found:
                    yield _batch(row, found, first, schema)

    return keyed.mapInArrow(run, kind)


def header_bytes(meta: Meta | None = None, snaplen: int = SNAPLEN, linktype: int = 1) -> bytes:
    """The file's own header, or one for version 2.4."""
    return meta.header if meta and meta.header else struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snaplen, linktype)


def record_bytes(ts: int, frame: bytes, orig_len: int, order: str = "<", unit: int = 1000) -> bytes:
    sec, frac = divmod(max(ts, 0), 1_000_000_000)
    return struct.pack(order + "IIII", min(sec, 0xFFFFFFFF), frac // unit, len(frame), max(orig_len, len(frame))) + frame


#: Bytes of records that one row holds on their way to the driver, and the type of such rows.
CHUNK_BYTES = 8 << 20
CHUNKS = T.StructType([T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])


def record_chunks(rows: DataFrame, order: str = "<", unit: int = 1000) -> DataFrame:
    """Rows (ts, orig_len, frame, and error where there is one) to runs of capture records, in the order of rows. An error ends a partition's records."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(CHUNKS)

    def run(batches):
        for b in batches:
            out, size = [], 0
            for ts, orig, frame, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if error is not None:
                    yield pa.RecordBatch.from_pylist([{"n": 0, "data": b"", "error": error}], schema=schema)
                    return
                out.append(record_bytes(ts, frame, orig, order, unit))
                size += len(out[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist([{"n": len(out), "data": b"".join(out), "error": None}], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([{"n": len(out), "data": b"".join(out), "error": None}], schema=schema)

    error = F.concat(F.lit("packet "), F.col("packet_id").cast("string"), F.lit(" of session "), F.col("session_id").cast("string"), F.lit(": "), F.col("error")) if "error" in rows.columns else F.lit(None).cast("string")
    return rows.select("ts", "orig_len", "frame", error.alias("error")).mapInArrow(run, CHUNKS)


def write_pcap(rows: DataFrame, path: str, meta: Meta | None = None, snaplen: int = SNAPLEN, linktype: int = 1) -> int:
    """Ordered rows (ts, orig_len, frame) to one file on the driver. Returns the number of records.

    Executors make runs of records at the same time and write them to the checkpoint folder; the driver puts them one after the other, a partition in
    memory at a time. A row with an error raises ValueError and leaves no file.
    """
    from ..operators import files

    order, unit = (meta.order, meta.unit) if meta and meta.header else ("<", 1000)
    chunks, n, beside = files.checkpointed(record_chunks(rows, order, unit)), 0, f"{path}.part"
    try:
        with open(beside, "wb") as f:
            f.write(header_bytes(meta, snaplen, linktype))
            for r in chunks.toLocalIterator(prefetchPartitions=True):
                if r.error is not None:
                    raise ValueError(r.error)
                f.write(r.data)
                n += r.n
        os.replace(beside, path)
    finally:
        if os.path.exists(beside):
            os.remove(beside)
        files.drop_checkpoint(chunks)
    return n


@dataclass
class _Piece(InputPartition):
    path: str
    offset: int
    first: int
    count: int | None

    def __init__(self, path: str, offset: int, first: int, count: int | None):
        self.path, self.offset, self.first, self.count = path, offset, first, count


class PcapReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = resolve(options["path"].split(","))
        self.split = int(options.get("splitbytes", 64 << 20))
        self.most = int(options["maxframe"]) if "maxframe" in options else None

    def partitions(self):
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                head = f.read(24)
                if head[:4] == NG or os.path.getsize(path) <= self.split:
                    out.append(_Piece(path, 24, 0, None))
                    continue
                order, at, first, n, end = MAGIC.get(head[:4], ("<", 0))[0], 24, 0, 0, os.path.getsize(path)
                start = at
                while at + 16 <= end:
                    f.seek(at + 8)
                    (incl,) = struct.unpack(order + "I", f.read(4))
                    at += 16 + incl
                    n += 1
                    if at - start >= self.split:
                        out.append(_Piece(path, start, first, n))
                        start, first, n = at, first + n, 0
                if n:
                    out.append(_Piece(path, start, first, n))
        return out

    def read(self, piece):
        with open(piece.path, "rb") as f:
            head = f.read(24)
            if head[:4] == NG:
                f.seek(0)
                for i, x in enumerate(_ng_frames(f.read())):
                    yield piece.path, i, x.ts, x.orig_len, x.linktype, x.data
                return
            meta = parse_header(head)
            f.seek(piece.offset)
            i = 0
            while piece.count is None or i < piece.count:
                h = f.read(16)
                if len(h) < 16:
                    return
                sec, frac, incl, orig = struct.unpack(meta.order + "IIII", h)
                if self.most is not None and incl > self.most:
                    raise CaptureError(f"a frame of {incl} bytes in {piece.path}")
                data = f.read(incl)
                if len(data) < incl:
                    return
                yield piece.path, piece.first + i, sec * 1_000_000_000 + frac * meta.unit, max(orig, incl), meta.linktype, data
                i += 1


class PcapSource(DataSource):
    """spark.read.format("pcap").load(path): path, packet_id, ts, orig_len, linktype, frame."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return PcapReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
