import random
import re
from collections import Counter

from tests.llm.texts import ODD, frame, words
from wirelake.llm import quality as Q


def measured(text):
    text = text or ""
    w = [a for a in re.split("[\x20\x09-\x0d]+", text) if a]
    lines = [a for a in text.split("\n") if re.search("[^\x20\x09-\x0d]", a)]
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(win)
    under = {k for i, x in enumerate(win) if c[x] > 1 for k in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(under)


def test_counts(spark):
    rnd = random.Random(1)
    texts = [*ODD]
    for _ in range(150):
        t = words(rnd, rnd.randint(0, 80), rnd.choice([2, 5, 300])).split()
        texts.append("".join(x + rnd.choice([" ", "\n", "  ", "\n\n", " # ", "|", "\t"]) for x in t))
    texts.append("same line here.\n" * 50)
    rows = Q.judge(frame(spark, [*enumerate(texts), (None, "null id " * 3)], w=1, l=2, h=3, n_words=4)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = measured("null id " * 3 if r.doc_id is None else texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_long_repetitive_texts_take_time_in_proportion(spark):
    texts = ["same " * 200_000, "a b c d e f g " * 30_000]
    rows = {r.doc_id: r for r in Q.judge(frame(spark, texts)).collect()}
    assert [rows[i].n_repeat_words for i in (0, 1)] == [200_000, 210_000]


def sentences(rnd, n):
    return " ".join(f"{a.capitalize()} {words(rnd, 9, 9000)}." for a in words(rnd, n, 9000).split()).replace("w", "word")


def test_verdict(spark):
    rnd = random.Random(2)
    good = [(i, sentences(rnd, 8)) for i in range(300)]
    junk = [(1000 + i, " ".join(x + " $$$ " for x in sentences(rnd, 8).split())) for i in range(30)]
    table = [(2000 + i, " | ".join(sentences(rnd, 6).split())) for i in range(20)]
    short = [(3000 + i, sentences(rnd, 2)) for i in range(15)]  # a drop vote for their length and no other
    rows = {r.doc_id: r for r in Q.judge(frame(spark, good + junk + table + short)).collect()}
    assert all(rows[i].kept for i, _ in good + short) and not any(rows[i].kept for i, _ in junk + table)
    assert all(0 <= r.quality <= 1 for r in rows.values())


def brute_posterior(patterns, share, drops):
    out = {}
    for p, _ in patterns:
        like = [1 - share, share]
        for v, d in zip(p, drops):
            for c in (0, 1):
                like[c] *= (d[c], 1 - d[c], 1)[v]
        out[p] = like[1] / sum(like)
    return out


def test_em_is_a_fixed_point_and_finds_the_accurate_rules():
    rnd = random.Random(3)
    counts = Counter()
    for _ in range(5000):
        bad = rnd.random() < 0.2
        counts[tuple(2 if rnd.random() < 0.1 else int(rnd.random() > ((0.4 if bad else 0.01) if j else 0.05)) for j, _ in enumerate(Q.RULES))] += 1
    patterns = sorted(counts.items())
    share, drops = Q.learn(patterns)
    assert 0.77 < share < 0.83 and all(0.35 < bad < 0.45 and good < 0.03 for bad, good in drops[1:]) and abs(drops[0][0] - drops[0][1]) < 0.03
    post = brute_posterior(patterns, share, drops)
    total = sum(counts.values())
    assert abs(share - (1 + sum(post[p] * n for p, n in patterns)) / (2 + total)) < 1e-6
    for j, (bad, good) in enumerate(drops):
        for c, want in enumerate((bad, good)):
            on = [Q.WEAK + sum(n * (post[p] if c else 1 - post[p]) for p, n in patterns if p[j] == v) for v in (0, 1)]
            assert abs(on[0] / sum(on) - want) < 1e-6


def test_quality_is_the_posterior_and_overrules_single_votes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    voted = Q.measure(docs).select("doc_id", *Q.votes()).collect()
    votes = {r[0]: tuple(r[1:]) for r in voted}
    patterns = sorted(Counter(votes.values()).items())
    post = brute_posterior(patterns, *Q.learn(patterns))
    rows = Q.judge(docs).collect()
    for r in rows:
        assert abs(r.quality - post[votes[r.doc_id]]) < 1e-9
        assert r.kept == (not r.base_failed and r.quality >= Q.KEEP)
    strict = [r for r in rows if not r.base_failed and 0 in votes[r.doc_id]]
    assert any(r.kept for r in strict) and any(not r.kept for r in strict)
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    told = [(r.kept, label[r.doc_id]) for r in rows if r.doc_id in label and not r.base_failed]
    assert sum(k == bool(y) for k, y in told) > 0.97 * len(told)


def test_empty_and_native(spark):
    assert Q.judge(frame(spark, [])).collect() == []
    plan = Q.measure(frame(spark, ["a b c"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("PythonUDF", "Pandas", "MapInArrow"))
