import random

from patchloom.operators.budget import bounded_sources, context_prefix, fitting_chunks, pruned_list

SCHEMA = "review_id string, chunk_id long, file_path string, diff_text string, line_start int, line_end int, symbol string, symbol_kind string"


def chunk(i, path, size, review="r"):
    return (review, i, path, "x" * size, i, i + 1, "f", "function")


def greedy(chunks, budget):
    """One chunk after the other, as a list on the driver."""
    if sum(len(c[3]) // 4 for c in chunks) <= budget:
        return {c[1] for c in chunks}
    largest = {}
    for c in chunks:
        if c[2] not in largest or len(c[3]) > len(largest[c[2]][3]):
            largest[c[2]] = c
    first = list(largest.values())
    rest = sorted((c for c in chunks if c not in first), key=lambda c: -len(c[3]))
    used, kept = 0, set()
    for c in first + rest:
        if used + len(c[3]) // 4 <= budget:
            used += len(c[3]) // 4
            kept.add(c[1])
    return kept


def run(spark, chunks, limits):
    df = spark.createDataFrame(chunks, SCHEMA)
    lim = spark.createDataFrame(limits, "review_id string, max_tokens int")
    return df, fitting_chunks(df, lim)


def test_examples(spark, rows_of):
    df, kept = run(spark, [chunk(i, "a.py", 40) for i in range(3)], [("r", 10)])
    assert rows_of(kept.where("kept"), "chunk_id") == [(0,)]
    assert rows_of(pruned_list(df, kept), "pruned") == [("a.py:1-2",), ("a.py:2-3",)]
    _, kept = run(spark, [chunk(0, "a", 40), chunk(1, "a", 40), chunk(2, "b", 40), chunk(3, "b", 40)], [("r", 20)])
    assert rows_of(kept.where("kept"), "chunk_id") == [(0,), (2,)]


def test_equals_the_list_form(spark):
    rng = random.Random(5)
    every, limits, expected = [], [], set()
    for n in range(60):
        review, budget = f"r{n}", rng.choice([1, 5, 20, 60, 1000])
        own = [chunk(n * 100 + i, rng.choice("abcd"), rng.choice([0, 3, 4, 8, 8, 30, 90]), review) for i in range(rng.randint(1, 14))]
        every += own
        limits.append((review, budget))
        expected |= {(review, c) for c in greedy(own, budget)}
    _, kept = run(spark, every, limits)
    assert {(r.review_id, r.chunk_id) for r in kept.where("kept").collect()} == expected


def test_null_text_missing_limit_and_empty(spark, rows_of):
    _, kept = run(spark, [("r", 1, "a", None, 1, 1, None, None)], [])
    assert rows_of(kept) == [("r", 1, True)]
    _, kept = run(spark, [], [])
    assert kept.count() == 0


def test_context_prefix(spark):
    df = spark.createDataFrame([chunk(i, "a", 6000) for i in range(4)], SCHEMA)
    got = [r.entry for r in context_prefix(df).orderBy("chunk_id").collect()]
    assert len(got) == 3 and got[2].endswith("... [truncated]\n") and sum(map(len, got[:2])) + len(got[2]) - len("\n... [truncated]\n") == 16000


def test_sources(spark, rows_of):
    s = spark.createDataFrame([("r", "a", "x" * 9), ("r", "b", "y" * 9), ("r", "c", None)], "review_id string, file_path string, source string")
    c = spark.createDataFrame([("r", "a")], "review_id string, file_path string")
    assert rows_of(bounded_sources(s, c, 5), "file_path", "source") == [("a", "xxxxx"), ("b", "yyyyy\n... [truncated]"), ("c", None)]
