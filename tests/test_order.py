"""Places in groups of any size, and what stands on them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import logs, order, rank


def test_places_in_a_hot_group_and_small_ones(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"g{i % 40}", r.choice([None, *range(9)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    for by in (["v", "id"], ["v"]):
        got = order.placed(df, ["g"], by).collect()
        assert len(got) == 900
        for g in {x[0] for x in rows}:
            own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
            mine = sorted((x for x in got if x["g"] == g), key=lambda x: x["_i"])
            assert [x["_i"] for x in mine] == list(range(len(own))) and {x["_n"] for x in mine} == {len(own)}
            assert [x["v"] for x in mine] == [x[1] for x in own]
            if len(by) == 2:
                assert [x["id"] for x in mine] == [x[2] for x in own]
    assert sorted(x["_i"] for x in order.placed(df, [], ["id"]).collect()) == list(range(900))
    assert order.placed(df.where("false"), ["g"], ["v"]).collect() == []


@pytest.mark.parametrize("values", [[1], [1, 2], [3, 1, 2, 2, 2, 9], list(range(100)), [5] * 300 + list(range(100)), [None, 4.5], [None]])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([("a", None if v is None else float(v)) for v in values] + [("b", 7.0)], "k string, v double").repartition(4)
    got = {x["k"]: (x["p50"], x["p95"]) for x in logs.nearest_rank(df, "v", "k").collect()}
    known = sorted(float(v) for v in values if v is not None)
    want = tuple(known[math.ceil(round(p * len(known), 9)) - 1] if known else None for p in (0.5, 0.95))
    assert got == {"a": want, "b": (7.0, 7.0)}


def test_partners_in_a_hot_kind(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(301)] + [(1000, "one"), (2000, "two"), (2001, "two")], "id long, kind string")
    got = {x["id"]: x["partner"] for x in rank.derangement(df, "id", "kind").collect()}
    assert set(got) == set(got.values()) == set(range(301)) | {2000, 2001} and all(a != b for a, b in got.items())
    assert got[2000] == 2001


def test_tasks_of_spans_do_not_grow_with_the_input(spark, monkeypatch):
    """Spans of many paths are sorted in as many tasks as there are rows for, whatever number is set for shuffles."""
    from ledgerloom.operators import order
    from ledgerloom.sources import code

    rows = spark.range(4000).select((F.col("id") % 400).alias("path"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    monkeypatch.setattr(order.spread, "__defaults__", (100,))
    out = code.merged_intervals(rows, "path", "a", "b")
    assert out.rdd.getNumPartitions() == 40 and out.count() == 4000


def test_tasks_of_marks_do_not_grow_with_the_input(spark, monkeypatch, tmp_path):
    from ledgerloom.plans import catalog

    spark.range(2000).select(F.col("id").alias("l_orderkey"), (F.col("id") * 4).alias("l_partkey"), (F.col("id") % 3).alias("l_linenumber")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(order.spread, "__defaults__", (50,))
    out = catalog.queries()["marker_rules"](spark, str(tmp_path))
    assert out.rdd.getNumPartitions() >= 80  # 40 of each rule
    assert out.count() == sum(i * 4 % 40 >= 30 for i in range(2000)) + sum(i * 4 % 40 != i * 4 % 30 for i in range(2000))
