import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.texts import ODD, frame, words
from wirelake.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(1)
    out = []
    for i in range(900):
        t = words(rnd, rnd.randint(10, 120), 2000).split()
        y = int(rnd.random() < 0.25)
        if y:
            for _ in range(rnd.randint(1, 4)):
                t.insert(rnd.randint(0, len(t)), rnd.choice(["horrid", "rotten", "vile!", "wretched"]))
        out.append((i, " ".join(t), y))
    return out


def test_held_out_accuracy(spark, corpus):
    docs = frame(spark, [(i, t) for i, t, _ in corpus], o=1, y=2, id=3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus] + [(99999, 1, 1), (None, 1, 0), (3, 0, None), (4, 0, 7)], "doc_id long, quality int, toxic int")
    model = T.train(docs, labels)
    rows = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    held = [(rows[i], y) for i, _, y in corpus if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = sum((s >= T.THRESHOLD) != bool(y) for s, y in held)
    assert len(held) > 150 and wrong <= 0.03 * len(held) and all(0 <= s <= 1 for s, _ in held)
    kept = T.keep_ordinary(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in rows.items() if s < T.THRESHOLD}


def test_held_out_labels_are_not_learned_from(spark, corpus):
    docs = frame(spark, [(i, t) for i, t, _ in corpus])
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in corpus]
    a, b = (T.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in ([(i, y) for i, _, y in corpus], flip))
    assert a == b


def test_edges(spark, corpus):
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int")
    model = T.train(frame(spark, [(i, t) for i, t, _ in corpus]), labels)
    rows = T.score(frame(spark, [*enumerate(ODD), (None, "vile! rotten horrid"), (None, "vile! rotten horrid")]), model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in rows)
    low = [r.score for r in rows if r.doc_id in (0, 1)]
    assert low[0] == low[1] < T.THRESHOLD and sum(r.score > T.THRESHOLD for r in rows) == 2
    assert T.score(frame(spark, []), model).collect() == []


def test_without_labels(spark):
    docs = frame(spark, ["a", "b", "c", "d"])
    none = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in T.score(docs, none).collect()} == {0.0}
    one = T.train(docs, spark.createDataFrame([(i, 1) for i in range(4)], "doc_id long, toxic int"))
    assert all(r.score > 0.99 for r in T.score(docs, one).collect())
    assert T.train(frame(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).weights == (0.0, 0.0)


def test_segments_ignore_copies():
    rnd = random.Random(2)
    ordinary = [words(rnd, 60, 5000).encode() for _ in range(200)]
    copied = words(rnd, 60, 5000).encode()
    toxic = [copied] * 50 + [f"{words(rnd, 30, 5000)} horrid {words(rnd, 30, 5000)}".encode() for _ in range(50)]
    found = T.toxic_content(toxic, ordinary)
    assert b"horrid" in found and copied[100:120] not in found


def scored(model, text):
    """The score by its definition, one window at a time."""
    t, gains = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text) + " ", []
    b, at = t.encode(), 0
    while text and (at == 0 or at + T.WINDOW - T.STRIDE < len(b)):
        length = []
        for content in (bytes(len(model.toxic)) + model.ordinary, model.toxic + model.ordinary):
            how = zstandard.ZstdCompressionParameters.from_level(1, strategy=zstandard.STRATEGY_LAZY2, min_match=T.DMER, target_length=0, write_checksum=False, write_content_size=False, write_dict_id=False)
            kind = zstandard.ZstdCompressionDict(content + T.ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            length.append(len(zstandard.ZstdCompressor(compression_params=how, dict_data=kind).compress(T.ANCHOR + b[at : at + T.WINDOW] + T.TAIL)))
        gains.append(length[0] - length[1])
        at += T.STRIDE
    z = model.bias + model.weights[0] * max([0, *gains]) + model.weights[1] * math.log1p(sum(max(0, g - 1) for g in gains))
    return 1 / (1 + math.exp(-z))


def test_scores_by_the_definition(spark, corpus):
    model = T.train(frame(spark, [(i, t) for i, t, _ in corpus]), spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int"))
    texts = [t for _, t, _ in corpus[:60]] + [t or "" for t in ODD]
    rows = {r.doc_id: r.score for r in T.score(frame(spark, texts), model).collect()}
    assert all(abs(rows[i] - scored(model, t)) < 1e-9 for i, t in enumerate(texts))


def test_long_and_repeated_training_texts(spark, corpus):
    """A long text is learned from in slices that reach its end; rows that repeat an id count once."""
    long = "z" * 60_000
    assert [len(r[0]) for r in frame(spark, [long, "short"]).select(T._bounded(T.text_bytes())).collect()] == [T.LONGEST, 5]
    marked = long[:-4] + "END!"
    assert bytes(frame(spark, [marked]).select(T._bounded(T.text_bytes())).first()[0]).endswith(b"END!")
    labels = spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in corpus])
    assert T.train(docs.unionByName(docs), labels) == T.train(docs, labels)
