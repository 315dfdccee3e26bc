import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.texts import ODD, frame, words
from wirelake.llm import hmm_score as H


def tokens(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w] + [""]


def check_base(rows, docs):
    learn = [i for i, _ in docs if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    c = Counter(t for i, x in docs if i in learn for t in tokens(x))
    total, types = sum(c.values()), len(c)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in rows))
    want = sorted((i is None, i or 0, len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), i not in learn, round(sum(math.log10((c[t] + 1) / (total + types + 1)) for t in tokens(x)), 6)) for i, x in docs)
    assert got == want and {r.train_tokens for r in rows} == {total}


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(0)
    docs = [(i, " ".join(f"{'abc'[i % 3]}{rnd.randrange(40)}" for _ in range(rnd.randint(5, 60)))) for i in range(120)]
    return docs + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (5, docs[5][1])]


def test_whole(spark, corpus, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_TOKENS", 500)
    docs = frame(spark, corpus, id=7, block="x", word="y", t=1)
    sequences, lex = H.prepare(docs)
    model = H.train(sequences, lex, rounds=2, states=4)
    rows = H.score(sequences, lex, model).collect()
    check_base(rows, corpus)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in rows)
    # one text by the plain definition: probability of the state paths, one token after the other
    c = Counter(t for i, x in corpus if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for t in tokens(x))
    top = sequences.sparkSession.createDataFrame([(w,) for w in c], "w string").selectExpr("w", "xxhash64(cast(w as binary)) wh", f"pmod(xxhash64(substring(cast(w as binary), -3, 3)), {H.ENDINGS}) + {H.TOP} e").collect()
    order = sorted(top, key=lambda r: (-c[r.w], r.wh))
    kind = {r.w: (k if k < H.TOP else r.e) for k, r in enumerate(order)}
    for i, x in corpus[:5] + [(1003, ODD[3])]:
        p, scale, first = None, 0.0, True
        for t in tokens(x):
            k = kind.get(t, H.UNKNOWN)
            share = c[t] / lex.mass[k] if c[t] else 1.0
            e = model.emit[:, k] * share
            p = (model.start if first else p @ model.move) * e
            first = False
            scale += math.log10(p.sum())
            p = p / p.sum()
        got = next(r.score for r in rows if r.doc_id == i)
        assert got == pytest.approx(scale, rel=1e-9)


def test_probabilities_sum_to_one(spark, corpus):
    sequences, lex = H.prepare(frame(spark, corpus[:50]))
    m = H.train(sequences, lex, rounds=1, states=3)
    assert m.emit.sum(1) == pytest.approx(1) and m.move.sum(1) == pytest.approx(1) and m.start.sum() == pytest.approx(1)


def test_recursions_against_enumeration():
    rnd = np.random.default_rng(1)
    k, c = 3, 5
    norm = lambda x: x / x.sum(-1, keepdims=True)
    m = H.Model(norm(rnd.random(k)), norm(rnd.random((k, k))), norm(rnd.random((k, c))))
    lens = np.array([4, 1, 3, 4])
    seqs = [rnd.integers(0, c, n) for n in lens]
    steps = H.Steps(np.concatenate(seqs), lens)
    like = steps.forward(m)
    start, moves, counts = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    import itertools

    for n, s in enumerate(seqs):
        total, a, b, e = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
        for path in itertools.product(range(k), repeat=len(s)):
            p = m.start[path[0]] * m.emit[path[0], s[0]]
            for x, y, o in zip(path, path[1:], s[1:]):
                p *= m.move[x, y] * m.emit[y, o]
            total += p
            a[path[0]] += p
            for x, y in zip(path, path[1:]):
                b[x, y] += p
            for x, o in zip(path, s):
                e[x, o] += p
        assert like[n] == pytest.approx(math.log(total))
        start, moves, counts = start + a / total, moves + b / total, counts + e / total
    for room in (1, 4, 1000):  # long texts go by spans
        for x, y in zip(steps.expect(m, room), (start, moves, counts)):
            assert x == pytest.approx(y)


def test_empty_table_and_no_training(spark):
    sequences, lex = H.prepare(frame(spark, []))
    assert H.score(sequences, lex, H.train(sequences, lex, 1, 2)).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    sequences, lex = H.prepare(frame(spark, [(held, "a b")]))
    (r,) = H.score(sequences, lex, H.train(sequences, lex, 1, 2)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score == pytest.approx(0, abs=1e-9)


def test_numbers_survive_packing():
    x = np.array([0, 1, 255, 256, 65536, 2**31])
    assert (H._swell(H._squeeze(x)) == x).all() and len(H._swell(H._squeeze(x[:0]))) == 0


@pytest.mark.parametrize("states", [1, 3])
def test_unknown_words_keep_the_mass_of_words_seen_once(spark, corpus, states):
    sequences, lex = H.prepare(frame(spark, corpus))
    m = H.train(sequences, lex, rounds=2, states=states)
    want = lex.once / (lex.total + lex.once)
    assert lex.rare.sum() == lex.once and m.emit[:, H.UNKNOWN].max() > 0.9 * want
    if states == 1:
        assert m.emit[0, H.UNKNOWN] == pytest.approx(want, rel=0.05)
