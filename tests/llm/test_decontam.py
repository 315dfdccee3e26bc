import math
import random
from itertools import combinations

from tests.llm.texts import ODD, frame
from wirelake.llm import decontam as D


def brute(texts, items):
    out = set()
    for k, t in enumerate(texts):
        tw = (t or "").lower().split()
        for i, x in enumerate(items):
            xw = (x or "").lower().split()
            w = min(16, len(xw))
            if len(xw) >= 5 and any(sum(tw[a + j] == xw[b + j] for j in range(w)) >= math.ceil(0.8 * w - 1e-9) for a in range(len(tw) - w + 1) for b in range(len(xw) - w + 1)):
                out.add((k, i))
    return out


def sample(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 30))) for _ in range(6)]
    texts = []
    for _ in range(8):
        t = [rnd.choice([*vocab, "zz"]) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.8:
            x = rnd.choice(items).split()
            x = [rnd.choice(vocab) if rnd.random() < 0.15 else y for y in x]
            p = rnd.choice([0, len(t), rnd.randint(0, len(t))])
            t = t[:p] + x + t[p:]
        texts.append(" ".join(t))
    return texts, items


def test_search_against_brute_force():
    found = 0
    for seed in range(40):
        texts, items = sample(seed)
        index = D.Index([(i, x.encode()) for i, x in enumerate(items)])
        got = {(k, index.names[i]) for k, i, _, _ in index.search([t.encode() for t in texts])}
        assert got == brute(texts, items)
        found += len(got)
    assert found > 50


def test_masks_are_lossless():
    for n in range(5, 17):
        for subs in combinations(range(n), n - math.ceil(0.8 * n - 1e-9)):
            masks = D.MASKS[n >= D.LONG]
            assert any(all(m[k] == "0" or i + k not in subs for k in range(len(m))) for m in masks for i in range(n - len(m) + 1))


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)  # several blocks of items
    texts, items = sample(3)
    texts, items = [*texts, *ODD, items[0].upper()], [*items, None, "", "short one"]
    docs = frame(spark, texts, item="x", id=1)
    bench = spark.createDataFrame([(i, x, 1) for i, x in enumerate(items)], "item_id long, text string, extra int")
    rows = D.pairs(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == brute(texts, items) and all(0.8 <= r.similarity <= 1 for r in rows)
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {k for k, _ in brute(texts, items)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.pairs(frame(spark, ["a b c d e f"]), none).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.pairs(frame(spark, []), some).collect() == [] and D.clean(frame(spark, ["x"]), none).count() == 1
    assert [(r.doc_id, r.item_id) for r in D.pairs(frame(spark, [(None, "a b c d e f")]), some).collect()] == [(None, 1)]
