import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import skew


@pytest.mark.parametrize(("hot", "keys"), [(2, 3), (2, 1_000), (10_000, 1_000)])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_counted_equals_a_join(spark, monkeypatch, rows_of, hot, keys, how):
    monkeypatch.setattr(skew, "HOT_ROWS", hot)
    monkeypatch.setattr(skew, "HOT_KEYS", keys)
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.choice(["a", "a", "a", "b", "c", None, "z"]), i) for i in range(200)], "k string, i long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k <> 'z'")
    plain = rows.join(keyed, "k", how)
    assert rows_of(skew.join_counted(rows, keyed, ["k"], "n", F.xxhash64("i"), how), "k", "i", "n") == rows_of(plain, "k", "i", "n")


def test_pairs_within_blocks(spark, monkeypatch, rows_of):
    monkeypatch.setattr(skew, "BLOCK", 3)
    members = spark.createDataFrame([("g", i, 10) for i in range(10)] + [("h", 50, 1)], "g string, m long, n long")
    assert rows_of(skew.pairs_within(members, "g", "m", "n"), "m_a", "m_b") == [(a, b) for a in range(10) for b in range(a + 1, 10)]


def test_prefilter_loses_no_partner(spark):
    rows = spark.range(20_000).select((F.col("id") % 5_000).alias("a"), (F.col("id") % 7).alias("b"), "id")
    keys = spark.range(0, 5_000, 50).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    kept = skew.prefiltered(rows, keys, ["a", "b"])
    assert kept.columns == rows.columns
    assert kept.join(keys, ["a", "b"], "left_semi").count() == rows.join(keys, ["a", "b"], "left_semi").count() > 0
    assert kept.count() < 500 and skew.prefiltered(rows, keys.limit(0), ["a", "b"]).count() == 0
