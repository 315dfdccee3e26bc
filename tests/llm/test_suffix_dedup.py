import hashlib
import random

import numpy as np
import pytest

from tests.llm.texts import ODD, frame
from wirelake.llm import suffix_dedup as S


def brute(docs, length=100):
    """docs: (key, bytes) in order -> key: the contract's columns."""
    seen, out = set(), {}
    for d, b in docs:
        cov = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cov[p : p + length] = b"\1" * length
            seen.add(w)
        n = sum(c and not (i and cov[i - 1]) for i, c in enumerate(cov))
        out[d] = (len(b), sum(cov), n, hashlib.sha256(bytes(x for x, c in zip(b, cov) if not c)).hexdigest())
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    shared = "".join(rnd.choice("abcd é\n") for _ in range(3000))
    docs = []
    for i in range(50):
        t = ""
        for _ in range(rnd.randint(0, 6)):
            r = rnd.random()
            if r < 0.3:
                t += "".join(rnd.choice("abcd é\n") for _ in range(rnd.randint(0, 300)))
            elif r < 0.8:
                a = rnd.randint(0, 2900)
                t += shared[a : a + rnd.randint(1, 400)]
            else:
                t += rnd.choice(["ab", "x", "abc "]) * rnd.randint(1, 200)
        docs.append((i * 3 - 20, t))
    near = list(shared)
    for k in range(6):
        near[k * 450 + rnd.randrange(400)] = "#"
        docs.append((600 + k, "".join(near)))
    return docs + [(500 + i, t) for i, t in enumerate(ODD)] + [(520, "q" * 100), (521, "q" * 99), (522, "q" * 150), (523, shared)]


def columns(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256


@pytest.mark.parametrize("chunk", [500, 400_000])
def test_against_brute_force(spark, corpus, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = S.remove_repeats(frame(spark, corpus, doc=1, run=2, t="x", spans=3)).collect()
    want = brute([(d, (t or "").encode()) for d, t in sorted(corpus)])
    assert {r.doc_id: columns(r) for r in rows} == want and len(rows) == len(corpus)


def test_repeated_and_null_ids(spark, corpus):
    docs = corpus[:12] + [(None, corpus[3][1])] + corpus[:3] + [(corpus[0][0], "another text " * 20)]
    rows = S.remove_repeats(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    nulls = [r for r in rows if r.doc_id is None]
    assert len(nulls) == 1 and nulls[0].n_bytes == len(corpus[3][1].encode())
    once = brute([(None, (corpus[3][1] or "").encode())] + [(d, t.encode()) for d, t in sorted(corpus[1:12])])
    for r in rows:
        if r.doc_id in dict(corpus[3:12]):
            assert columns(r)[0] == once[r.doc_id][0]
    assert sum(r.doc_id == corpus[1][0] for r in rows) == 2


def test_empty(spark):
    assert S.remove_repeats(frame(spark, [])).collect() == []


def test_owners_depend_on_windows_only(monkeypatch):
    rnd = random.Random(6)
    monkeypatch.setattr(S, "PIECE", 700)
    text = bytes(rnd.choice(b"abc") for _ in range(3000))
    q, h, l, r, _ = S.owners(text)
    assert l[0] == 0 and r[-1] == len(text) - 100 and (l[1:] == r[:-1] + 1).all() and ((q >= r) & (q - l <= 76)).all()
    part = text[700:1500]
    q2, h2, l2, _, _ = S.owners(part)
    inside = {(int(a) - 700, int(b)) for a, b in zip(q, h.view(np.int64))}
    assert all((int(a), int(b)) in inside for a, b in zip(q2, h2.view(np.int64)))
