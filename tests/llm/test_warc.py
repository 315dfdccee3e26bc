import base64
import gzip
import hashlib
import random
import time

import pytest

from wirelake.llm import warc as W


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, extra int")


def sha1(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é"), (2, "http://b/\r\nX: y", "<p>é"), (3, None, ""), (4, "u", None), (5, "u", "a\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 200_000), (6, "u", "x" * 200_000), (None, "u", "<p>é"), (None, "u", "alone"), (7, "u", "\x00\x1f")]
    path = str(tmp_path / "w")
    W.write(pages(spark, rows), path)
    got = W.read(spark, path)
    assert W.quarantine(got).collect() == []
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        t, b = top[h or ""], (h or "").encode()
        first = t == -1 or i == t
        want.append((str(i), len(b), sha1(b), "response" if first else "revisit", None if first else t))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got.collect())


def test_files_are_gzip_with_a_member_each(spark, tmp_path):
    path = tmp_path / "w"
    W.write(pages(spark, [(i, "u", f"page {i}") for i in range(5)]), str(path))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in path.glob("part-*") if f.stat().st_size)
    assert data.count(b"WARC/1.1\r\n") == 5 and sum(f.read_bytes().count(W.GZIP) for f in path.glob("part-*")) >= 5


def test_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write(pages(spark, []), path)
    assert W.read(spark, path).collect() == []


def plain(n):
    return [W.record(i, "u", f"payload {i} ".encode() * 20, None, False) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_salvage_after_damage(packed):
    rnd = random.Random(5)
    for _ in range(200):
        records = [W.member(r) if packed else r for r in plain(6)]
        hit = rnd.randrange(6)
        bad = bytearray(records[hit])
        kind = rnd.choice(["cut", "flip", "junk", "missing head"])
        if kind == "cut":
            bad = bad[: rnd.randrange(12, len(bad) - 6)]
        elif kind == "flip":
            bad[rnd.randrange(20, len(bad) - 10)] ^= 0xFF
        elif kind == "junk":
            bad = bytearray(rnd.randbytes(rnd.randrange(1, 300)))
        else:
            bad = bad[10:]
        data = b"".join([*records[:hit], bytes(bad), *records[hit + 1 :]])
        out = list(W.salvage(data))
        ids = [W._id(x.headers["warc-record-id"]) for x in out if isinstance(x, W.Record)]
        assert set(range(6)) - {hit} <= set(ids), (kind, hit, ids)
        gaps = [x for x in out if isinstance(x, W.Gap)]
        start = sum(len(r) for r in records[:hit])
        if len(ids) == 5:  # a changed header line that no digest covers may still make a record
            assert gaps[0].start == start and gaps[-1].end == start + len(bad) and all(g.reason for g in gaps)


def test_payload_that_looks_like_a_record():
    inner = W.record(9, "u", b"inside", None, False)
    out = list(W.salvage(W.record(1, "u", inner, None, False) + W.record(2, "u", b"", None, False)))
    assert [W._id(x.headers["warc-record-id"]) for x in out] == [1, 2] and out[0].payload == inner


def test_gap_log(spark, tmp_path):
    a, b = plain(2)
    (tmp_path / "x.warc").write_bytes(a + b"garbage" + b)
    df = W.read(spark, str(tmp_path / "x.warc"))
    (gap,) = W.quarantine(df).collect()
    assert (gap.start, gap.end) == (len(a), len(a) + 7) and df.where("reason is null").count() == 2


def ids_of(out):
    return [W._id(x.headers["warc-record-id"]) for x in out if isinstance(x, W.Record)]


def test_a_member_of_many_records_with_a_bad_one():
    records = plain(6)
    records[2] = records[2].replace(b"payload 2", b"payload X", 1)
    out = list(W.salvage(W.member(b"".join(records)) + W.member(plain(8)[7])))
    (gap,) = [x for x in out if isinstance(x, W.Gap)]
    assert ids_of(out) == [0, 1, 3, 4, 5, 7] and gap.reason
    assert (gap.start, gap.inner_start, gap.inner_end) == (0, sum(map(len, records[:2])), sum(map(len, records[:3])))


def test_a_truncated_member_of_many_records():
    rnd = random.Random(4)
    records = [W.record(i, "u", rnd.randbytes(3000), None, False) for i in range(100)]
    whole = W.member(b"".join(records))
    for cut in (len(whole) // 2, len(whole) - 4):
        out = list(W.salvage(whole[:cut]))
        got = ids_of(out)
        assert got == list(range(len(got))) and len(got) >= 100 * cut // len(whole) - 2
        assert out[-1].reason == "member cut short" and (out[-1].start, out[-1].end) == (0, cut)


def test_a_flipped_byte_in_a_member_of_many_records():
    rnd = random.Random(6)
    records = [W.record(i, "u", rnd.randbytes(3000), None, False) for i in range(100)]
    whole = bytearray(W.member(b"".join(records)))
    whole[len(whole) * 3 // 4] ^= 0xFF
    after = W.member(W.record(200, "u", b"after", None, False))
    out = list(W.salvage(bytes(whole) + after))
    assert set(range(70)) | {200} <= set(ids_of(out)) and any(isinstance(x, W.Gap) for x in out)


def test_time_grows_with_the_archive():
    """Members, and plain bytes full of version lines that begin no record, are read once."""
    rnd = random.Random(4)
    some = [W.record(i, None, rnd.randbytes(3000), None, False) for i in range(4000)]
    began = time.perf_counter()
    assert sum(isinstance(x, W.Record) for x in W.salvage(b"".join(map(W.member, some)))) == 4000
    bad = b"".join(some[:2000]).replace(b"WARC-Record-ID", b"WARC-Record-IE")
    gaps = list(W.salvage(bad + some[0] + bad))
    assert [type(x) for x in gaps] == [W.Gap, W.Record, W.Gap]
    assert time.perf_counter() - began < 20
