import random

from pyspark.sql import functions as F

from patchloom.llm.topn import heaps, top_n

SCHEMA = "g string, h int, s double, id int, position string, _id string"


def run(spark, rows, n=3):
    df = spark.createDataFrame([(g, h, s, i, "x", "y") for g, h, s, i in rows], SCHEMA).repartition(4)
    out = top_n(df, ["g", "h"], [F.col("s")], "id", n).select("g", "h", "position", "id").collect()
    return {(r.g, r.h, r.position): r.id for r in out}


def test_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1, 2]), rng.choice([None, 0.0, 1.0, 2.0]), i) for i in range(300)]
    rows += rng.sample(rows, 50)
    got = run(spark, rows, 5)
    for g in "ab":
        for h in (1, 2):
            own = sorted({r for r in rows if r[:2] == (g, h)}, key=lambda r: (r[2] is None, -(r[2] or 0), r[3]))
            assert [got[g, h, p] for p in range(1, 6)] == [r[3] for r in own[:5]]


def test_ties_nulls_repeats_and_small_groups(spark):
    rows = [(None, 1, 1.0, 7), (None, 1, 1.0, 7), ("a", None, None, 2), ("a", None, 1.0, 3), ("b", 1, 1.0, 5), ("b", 1, 1.0, 4), ("b", 1, 1.0, None)]
    got = run(spark, rows)
    assert got == {(None, 1, 1): 7, ("a", None, 1): 3, ("a", None, 2): 2, ("b", 1, 1): 4, ("b", 1, 2): 5, ("b", 1, 3): None}


def test_a_redelivery_with_a_higher_score_holds_once(spark):
    assert run(spark, [("a", 1, 1.0, 1), ("a", 1, 9.0, 1), ("a", 1, 5.0, 2)]) == {("a", 1, 1): 1, ("a", 1, 2): 2}


def test_one_huge_group(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), (F.col("id") % 1000).alias("s"), F.col("id").alias("i"))
    got = top_n(df, ["g"], [F.col("s")], "i", 3).collect()
    assert sorted((r.position, r.i) for r in got) == [(1, 999), (2, 1999), (3, 2999)]


def test_empty(spark):
    assert run(spark, []) == {}


def test_heaps_come_before_the_shuffle(spark):
    df = spark.range(0, 400_000, 1, 8).select((F.col("id") % 40).alias("g"), F.hash("id").alias("s"), (F.col("id") % 390_000).alias("i"))
    partial = heaps(df, ["g"], [F.col("s")], "i", 5)
    assert partial.count() <= 40 * 5 * 8
    plan = top_n(df, ["g"], [F.col("s")], "i", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_more_groups_than_a_task_holds(spark):
    df = spark.range(0, 9_000, 1, 2).select((F.col("id") % 3_000).cast("string").alias("g"), F.col("id").alias("s"), F.col("id").alias("i"))
    small = heaps(df, ["g"], [F.col("s")], "i", 2, buffer=500)
    assert small.select("_g0").distinct().count() == 3_000
    best = {r.g: r.i for r in top_n(df, ["g"], [F.col("s")], "i", 2).where("position = 1").collect()}
    assert best == {str(g): 6_000 + g for g in range(3_000)}


def test_nan_scores_and_text_identifiers(spark):
    df = spark.createDataFrame([("a", float("nan"), "x"), ("a", 1.0, "z"), ("a", 1.0, "y"), ("a", None, "w")], "g string, s double, i string")
    got = {r.position: r.i for r in top_n(df, ["g"], [F.col("s")], "i", 3).collect()}
    assert got == {1: "y", 2: "z", 3: "w"}
