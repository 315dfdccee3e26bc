import random
import re

import numpy as np
import xxhash

from tests.llm.texts import ODD, frame, words
from wirelake.llm import simhash_dedup as S


def brute_print(text):
    w = [a for a in re.split("[\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if a]
    if not w:
        return 0
    sh = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_groups(prints, bits=4):
    """prints: {node: fingerprint} -> {node: smallest node reachable}."""
    top = {n: n for n in prints}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if j < i and bin(prints[i] ^ prints[j]).count("1") <= bits:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {n: find(n) for n in ids}


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = []
    for _ in range(25):
        t = words(rnd, rnd.randint(3, 400)).split()
        for _ in range(rnd.randint(1, 6)):
            u = list(t)
            if rnd.random() < 0.7:
                u[rnd.randrange(len(u))] = "changed"
            texts.append(" ".join(u).upper() if rnd.random() < 0.2 else " \n".join(u))
    texts += ODD
    rows = S.near_duplicates(frame(spark, texts, fp=1, key=2, top=3)).collect()
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    groups = brute_groups(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


def links_of(spark, prints, heavy):
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long")
    comp = {r.u: r.v for r in S.components(S.links(df, heavy=heavy)).collect()}
    return {p: comp.get(S._signed(p), S._signed(p)) for p in prints}


def test_heavy_keys_are_split_without_losing_links(spark):
    rnd = random.Random(2)
    prints = set()
    for _ in range(4):
        x = rnd.getrandbits(64)
        for _ in range(60):  # a dense cloud and a long chain
            y = x
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                y ^= 1 << b
            prints.add(y)
        for _ in range(30):
            for b in rnd.sample(range(64), 4):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    want = brute_groups({S._signed(p): p for p in prints})
    for heavy in (50_000, 20):
        assert links_of(spark, prints, heavy) == {p: want[S._signed(p)] for p in prints}


def test_masks_cover_every_pair():
    rnd = random.Random(3)
    masks = S._cover(list(range(64)))
    assert len(masks) == 15
    for _ in range(2000):
        d = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(not d & m for m in masks)


def test_pivots_never_discard_a_link(spark):
    rnd = random.Random(4)
    prints = [rnd.getrandbits(64) for _ in range(50)]
    rows = spark.createDataFrame([(S._signed(p),) for p in prints], "fp long").select("fp", *S._packed_distances()).collect()
    for r in rows:
        d = np.array([r.d0, r.d1]).view(np.uint8)
        assert d.tolist() == [bin((r.fp ^ p) & (2**64 - 1)).count("1") for p in S._pivots()]


def test_keep_one(spark):
    a, b = "the same text of some words here", "another text that differs a lot from it"
    docs = frame(spark, [(5, a), (3, a), (9, b), (7, None), (8, "")], extra=1)
    kept = S.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9] and kept.columns == docs.columns
    again = S.keep_one(frame(spark, [(3, a), (3, a), (None, b), (None, b), (4, b)]))
    assert sorted(str(r.doc_id) for r in again.collect()) == ["3", "4"]
    assert S.keep_one(frame(spark, [])).collect() == [] and S.near_duplicates(frame(spark, [])).collect() == []


def test_null_ids(spark):
    rows = S.near_duplicates(frame(spark, [(None, "a"), (None, "a"), (2, "a"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("2", "2"), ("None", "2"), ("None", "2"), ("None", "None")]


def test_keep_one_with_repeated_ids_and_clashing_columns(spark):
    rnd = random.Random(8)
    texts = [words(rnd, 40) for _ in range(4)]
    own = {"top": 1, "component_id": 2, "fp": 3, "_fp": 4, "_top": 5}
    docs = frame(spark, [(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (1, texts[2]), (None, texts[3]), (None, None)], **own)
    rows = S.keep_one(docs).collect()
    assert all(r[k] == v for r in rows for k, v in own.items())
    assert sorted((str(r.doc_id), r.text or "") for r in rows) == sorted([("1", texts[0]), ("3", texts[1]), ("1", texts[2]), ("None", texts[3]), ("None", "")])


def test_dense_keys_lose_no_link(spark):
    rnd = random.Random(9)
    seeds = [rnd.getrandbits(64) for _ in range(6)]
    fps = {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for x in seeds for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {}
    for a in signed:
        want.setdefault(a, a)
    parent = {a: a for a in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 4:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    found = {r.u: r.v for r in S.components(S.links(nodes)).collect()}
    assert all(found.get(a, a) == root(a) for a in signed)
