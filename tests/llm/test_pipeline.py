import random

import pytest

from tests.llm.texts import frame, words

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture()
def tables(spark, tmp_path):
    rnd = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        t = words(rnd, rnd.randint(40, 80), 4000).split()
        y = int(i % 4 == 0)
        if y:
            t[5] = t[20] = "horrid"
            t[30] = "wretched"
        docs.append((i, " ".join(t)))
        labels.append((i, 1, y))
    passage = words(random.Random(9), 25, 4000)
    docs += [(1000, docs[1][1]), (1001, f"{words(rnd, 30, 4000)} {passage} {words(rnd, 30, 4000)}"), (1002, f"write to me@mail.org {words(rnd, 40, 4000)}"), (1003, None), (1004, "")]
    frame(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_decisions_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = pipeline.run(spark, tables)
    rows = {r.doc_id: r for r in out.collect()}
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert set(docs.columns) <= set(out.columns)
    clean = [i for i in range(400) if i % 4]
    assert sum(i in rows for i in clean) >= 0.99 * len(clean)
    assert sum(i in rows for i in range(0, 400, 4)) <= 5
    assert 1 in rows and 1000 not in rows and 1001 not in rows and 1003 in rows and 1004 not in rows
    assert rows[1002].text.startswith("write to <EMAIL> ") and rows[1002].n_chars == len(rows[1002].text)
    assert sorted(r.mix_position for r in rows.values()) == list(range(len(rows)))


def test_stages_keep_the_columns(spark, tables):
    docs = frame(spark, ["some words " * 10, None])
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        out.collect()
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame(spark, []), tables).collect() == []
