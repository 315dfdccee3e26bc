import bisect
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.texts import frame
from wirelake.llm import mixing as M


def test_less_than_one_block_from_the_fluid_schedule():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 8)
        w, b = [rnd.random() ** 2 + 0.01 for _ in range(n)], [rnd.randint(0, 50) for _ in range(n)]
        slots = M.schedule(w, b)
        assert [slots.count(i) for i in range(n)] == b
        corners, seen = M.fluid(w, b), [0] * n
        for t, i in enumerate(slots, 1):
            seen[i] += 1
            for k in range(n):
                times, shares = corners[k]
                j = bisect.bisect_left(times, t)
                fluid = shares[-1] if j >= len(times) else shares[j - 1] + (shares[j] - shares[j - 1]) * (t - times[j - 1]) / (times[j] - times[j - 1])
                assert abs(fluid - seen[k]) < 1


def test_rows_come_out_once_in_proportion(spark):
    docs = frame(spark, [(i, "t" * (i % 7)) for i in range(1500)]).withColumn("source", F.when(F.col("doc_id") < 1000, "big").when(F.col("doc_id") < 1400, "mid"))
    rows = M.mix(docs, {"big": 0.5, "mid": 0.3, None: 0.2}, slots=150).orderBy("mix_position").collect()
    assert [r.mix_position for r in rows] == list(range(1500)) and len({r.doc_id for r in rows}) == 1500
    first = rows[:400]
    for name, share in (("big", 0.5), ("mid", 0.3), (None, 0.2)):
        assert abs(sum(r.source == name for r in first) - 400 * share) < 10
    for slot in {r.mix_slot for r in rows}:
        assert len({r.source for r in rows if r.mix_slot == slot}) == 1


def test_edges(spark):
    assert M.mix(frame(spark, [])).collect() == []
    same = M.mix(frame(spark, [(1, "a")] * 200 + [(None, None)] * 3), slots=13).collect()
    assert sorted(r.mix_position for r in same) == list(range(203))
    clash = frame(spark, ["a", "b"], mix_position=9, mix_slot=9)
    assert sorted(r.mix_position for r in M.mix(clash, {"s0": 0, "s9": -1}).collect()) == [0, 1]


def test_main_path_is_native(spark):
    plan = M.mix(frame(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("total", [10, 1000])
def test_the_schedule_is_bounded_and_alike_at_every_size(spark, total):
    rows = M.mix(frame(spark, ["x"] * total), slots=20).collect()
    assert len({r.mix_slot for r in rows}) <= 23 and len(rows) == total
    assert max(Counter(r.mix_slot for r in rows).values()) == max(1, total // 20)


def test_columns_of_any_name_stay(spark):
    own = {"_rank": 7, "_hash": 8, "_source": "a", "_bucket": 1, "_block": 2, "_start": 3, "__n": 4}
    rows = M.mix(frame(spark, ["a", "b", None], **own)).collect()
    assert len(rows) == 3 and all(r[k] == v for r in rows for k, v in own.items())
