"""WARC archives: a writer with revisit records, and a reader that salvages what it can.

Writing: each page becomes a WARC/1.1 record whose block is an HTTP response with the page as payload, in a gzip member of its own.
Of pages with equal payloads the one with the largest id is written whole; the others are revisit records that refer
to it and hold only the HTTP header. Archives are written by Spark's text writer, one member a row, with a zero byte after each
(gzip readers skip zero padding), so they go to any store that Spark writes to.

Reading: archives of gzip members or of plain records. Every record must have a version line, the headers that the format
requires (each once), a whole block of the stated length, and the
digests it names. After a failed check the reader searches for the next valid member or version line and goes
on there; the bytes between are logged as a quarantined gap with the reason. The same holds inside a member of many records,
which is read as far as it can be decompressed.

Edge cases: a null payload is empty; a null id is written as null and read back as null, and loses against any id of
its group; pages with the same id and payload are all responses if that id is the largest; a null url is left out, line breaks in
urls are percent-encoded; an empty table writes no record and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices, table, text_bytes

MIN_REVISIT, RECORDS_PER_FILE, LEVEL = 0, 2000, 4
DATE = "2024-01-01T00:00:00Z"
URN = "urn:wirelake:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Compressed bytes that are decompressed at a time.
STEP = 1 << 16
GZIP, VERSION, END = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
LINE, MARK = re.compile(re.escape(VERSION)), re.compile(re.escape(GZIP) + b"|" + re.escape(VERSION))
#: Headers that every record has. Fixed values.
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORDS = "path string, start long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, gap_end long, reason string, inner_start long, inner_end long"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Record:
    start: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]


@dataclass
class Gap:
    start: int
    end: int
    reason: str
    #: Places in a member's decompressed bytes, for gaps inside one.
    inner_start: int | None = None
    inner_end: int | None = None


class Bad(ValueError):
    pass


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the plain record at a place."""
    if data[at : at + len(VERSION)] != VERSION:
        raise Bad("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Bad("header without end")
    headers = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Bad("bad header line")
        name = name.strip().lower()
        if name in headers and name != "warc-concurrent-to":
            raise Bad("headers of two records")
        headers[name] = value.strip()
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise Bad(f"no {missing[0]}")
    size = headers["content-length"]
    if not size.isascii() or not size.isdigit():
        raise Bad("bad content length")
    first = stop + len(END)
    end = first + int(size)
    block = data[first:end]
    if end > len(data):
        raise Bad("block cut short")
    if data[end : end + len(END)] != END:
        raise Bad("block of another length")
    wanted = headers.get("warc-block-digest")
    if wanted and wanted != "sha1:" + sha1_base32(block):
        raise Bad("block digest differs")
    payload = headers.get("warc-payload-digest")
    if payload and headers.get("warc-type") == "response" and payload != "sha1:" + sha1_base32(block.partition(END)[2]):
        raise Bad("payload digest differs")
    return headers, block, end + len(END)


def _member(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the member at a place decompresses to, where it ends, and what is wrong with it: then the bytes are those before the error."""
    d, out, place, step = zlib.decompressobj(31), [], at, STEP
    while not d.eof and place < len(data):
        before = d.copy() if step > 1 else d
        try:
            out.append(d.decompress(data[place : place + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), place, "member can't be decompressed"
            # the piece with the error again, byte by byte, for what comes before the error
            d, step = before, 1
            continue
        place += step
    if not d.eof:
        return b"".join(out), len(data), "member cut short"
    return b"".join(out), min(place, len(data)) - len(d.unused_data), ""


def _next(data: bytes, at: int, mark: re.Pattern[bytes] = MARK) -> int:
    """The next place where a member or a version line begins."""
    found = mark.search(data, at)
    return found.start() if found else len(data)


def _inside(inner: bytes, start: int, end: int, wrong: str) -> Iterator[Record | Gap]:
    """Valid records of a member's bytes, and gaps with their places in the bytes."""
    at, bad, reason = 0, None, ""
    while at < len(inner):
        try:
            headers, block, after = _parse(inner, at)
        except Bad as e:
            if bad is None:
                bad, reason = at, str(e)
            at = _next(inner, at + 1, LINE)
            continue
        if bad is not None:
            yield Gap(start, end, reason, bad, at)
            bad = None
        yield Record(start, headers, block)
        at = after
    if bad is not None or wrong:
        yield Gap(start, end, wrong or reason, len(inner) if bad is None else bad, len(inner))


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All valid records in order, and the gaps between them that no valid record covers.

    A damaged member gives the records before, between and after its bad ones, as far as it can be decompressed; its gaps
    name its start and end and the places in its decompressed bytes. If none of its records is valid, it is a plain gap.
    """
    at, bad, reason = 0, None, ""
    while at < len(data):
        if data[at] == 0 and bad is None:
            at += 1
            continue
        try:
            if data[at : at + len(GZIP)] == GZIP:
                inner, end, wrong = _member(data, at)
                if wrong:
                    end = _after(data, at, end, inner)
                found = list(_inside(inner, at, end, wrong))
                if found and not any(isinstance(x, Record) for x in found):
                    raise Bad(found[-1].reason)
            else:
                headers, block, end = _parse(data, at)
                found = [Record(at, headers, block)]
        except Bad as e:
            if bad is None:
                bad, reason = at, str(e)
            at = _next(data, at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        yield from found
        at = end
    if bad is not None:
        yield Gap(bad, len(data), reason)


def _after(data: bytes, at: int, error: int, inner: bytes) -> int:
    """Where a damaged member is left: at the next place with a valid record, if it comes before the place of the error, else at the next mark after the error."""
    place = _next(data, at + 1)
    while place < error:
        # deflate may store bytes as they are: what the member gave already doesn't count again
        if data[place : place + 64] not in inner and _begins(data, place):
            return place
        place = _next(data, place + 1)
    return _next(data, error)


def _begins(data: bytes, at: int) -> bool:
    """Whether a whole record, or a member with one, begins at a place."""
    if data[at : at + len(GZIP)] == GZIP:
        return any(isinstance(x, Record) for x in _inside(_member(data, at)[0], at, at, ""))
    try:
        _parse(data, at)
    except Bad:
        return False
    return True


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = MIN_REVISIT) -> None:
    d = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), text_bytes(html).alias("payload"))
    d = d.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    whole = d.groupBy("digest").agg(F.max("id").alias("top"))
    # copies of one page may be a third of the rows: a shuffled join whose skewed partitions AQE splits
    rows = d.join(whole.hint("merge"), "digest").select("id", "url", "payload", "top")

    def run(batches):
        for b in slices(batches):
            ids, urls, payloads, tops = (c.to_pylist() for c in b.columns)
            out = []
            for i, u, p, t in zip(ids, urls, payloads, tops, strict=True):
                revisit = len(p) >= least and t is not None and i != t
                out.append(member(record(i, u, p, t if revisit else None, revisit)))
            yield pa.record_batch([pa.array(out, pa.binary())], names=["member"])

    rows.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _id(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(URN)
    return int(name) if name.lstrip("-").isdigit() else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps: path, start, then for records page_id, payload_bytes, payload_digest, record_type, refers_to, and for gaps gap_end and reason."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches):
        for b in slices(batches, 1):
            where, data = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            out = []
            for x in salvage(data):
                if isinstance(x, Gap):
                    out.append((where, x.start, None, None, None, None, None, x.end, x.reason, x.inner_start, x.inner_end))
                    continue
                kind = x.headers.get("warc-type")
                http = dict(line.partition(":")[::2] for line in x.block.partition(END)[0].decode("utf-8", "replace").lower().split("\r\n")[1:])
                size = int(http.get("content-length", "0")) if kind == "revisit" else len(x.payload)
                digest = x.headers.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else sha1_base32(x.payload)
                out.append((where, x.start, _id(x.headers.get("warc-record-id")), size, digest, kind, _id(x.headers.get("warc-refers-to")), None, None, None, None))
            if out:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORDS)


def quarantine(records: DataFrame) -> DataFrame:
    """The log of gaps: path, start, end, reason, and for gaps inside a member their places in its decompressed bytes."""
    return records.where("reason IS NOT NULL").select("path", "start", F.col("gap_end").alias("end"), "reason", "inner_start", "inner_end")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
