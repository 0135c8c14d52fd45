import random

import pytest
from pyspark.sql import functions as F

from raschmill.config import ResponseSchema
from raschmill.operators import moments, prep
from raschmill.sources import responses as src

TINY = [(p, f"I{i + 1}", s) for p, row in ((1, (1, 0, 1)), (2, (0, 0, 0)), (3, (0, 1, 1))) for i, s in enumerate(row)]


def test_drop_perfect_scores_by_hand(spark):
    df = spark.createDataFrame(TINY, "id int, Item string, score int")
    got = sorted(tuple(r) for r in prep.drop_perfect_scores(df).collect())
    assert got == [(1, "I1", 1), (1, "I2", 0), (3, "I1", 0), (3, "I2", 1)]


def test_drop_perfect_scores_edges(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "id int, Item string, score int")
    assert prep.drop_perfect_scores(df).count() == 0
    assert prep.drop_perfect_scores(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a", 1), (1, "a", 0), (2, "a", 1), (2, "a", 0)], "id int, Item string, score int")
    assert prep.drop_perfect_scores(twice).count() == 4


def test_complete(spark):
    good = spark.createDataFrame([(1, 1)], "id int, score int")
    prep.require_complete(good)
    with pytest.raises(ValueError):
        prep.require_complete(spark.createDataFrame([(None, 1)], "id int, score int"))
    with pytest.raises(TypeError):
        prep.require_complete(spark.createDataFrame([(1, "1")], "id int, score string"))


def test_dense_index_sorts_strings_as_strings(spark):
    df = spark.createDataFrame([("10",), ("9",), ("2",), ("9",)], "k string")
    assert {r["original"]: r["new"] for r in prep.dense_index(df, "k").collect()} == {"10": 1, "2": 2, "9": 3}


def hinges(v):
    v = sorted(v)
    n = len(v)
    d = ((n + 3) // 2) / 2
    lo, hi = int(d), int(-(-d // 1))
    return (v[lo - 1] + v[hi - 1]) / 2, (v[n - lo] + v[n - hi]) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 50, 51])
def test_fences(spark, n):
    r = random.Random(n)
    v = [r.gauss(0, 1) for _ in range(n)]
    got = moments.fences(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()
    assert (got["lower_hinge"], got["upper_hinge"]) == pytest.approx(hinges(v))


def test_ranks_without_gathering(spark, monkeypatch):
    monkeypatch.setattr(moments, "FEW", 5)
    r = random.Random(1)
    v = [r.choice([r.gauss(0, 1), 0.25]) for _ in range(400)] + [1e9, -1e9]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    ranks = [1, 2, 100, 101, 201, 401, 402]
    assert moments.order_statistics(df, "v", ranks) == [sorted(v)[k - 1] for k in ranks]


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([("p", "i", "s", 1), ("q", "i", "s", 0)], src.RESPONSES)
    src.write_csv(df, f"{tmp_path}/c")
    assert sorted(src.read_csv(spark, f"{tmp_path}/c").collect()) == sorted(df.collect())
    src.write_parquet(df.withColumnRenamed("Item", "question").withColumn("other", F.lit(1)), f"{tmp_path}/p")
    back = src.read_parquet(spark, f"{tmp_path}/p", ResponseSchema(item="question"))
    assert back.columns == ["id", "Item", "Scale", "score"] and "other" not in back._jdf.queryExecution().executedPlan().toString()
    assert src.grid(spark, 3, 2, 2).count() == 12


def test_splits_and_samples(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("id"), F.col("id").alias("k"))
    s = prep.split_within_person(df, [F.col("k")], 0.9)
    assert s.where("not is_training").groupBy("id").count().where("count <> 2").count() == 0
    assert prep.top_k_per_person(df, [F.rand(1)], 3).count() == 15
    assert prep.sample_rows(df, 3).count() == 100
