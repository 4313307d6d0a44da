import pytest

from patchloom.operators import findings as ops
from patchloom.operators import verdict

SCHEMA = (
    "review_id string, agent string, seq int, category string, severity string, title string, description string, file_path string, line_start int, "
    "line_end int, evidence string, recommendation string, confidence double"
)


def finding(seq, severity="low", confidence=0.9, agent="security", path="a.py", line=1, category="security", title="t", evidence="e", review="r"):
    return (review, agent, seq, category, severity, title, "", path, line, None, evidence, "", confidence)


@pytest.fixture
def make(spark):
    return lambda *f: spark.createDataFrame(list(f), SCHEMA)


@pytest.mark.parametrize(
    ("rows", "failed", "expected"),
    [
        ([("low", 0.9)], False, "approve"), ([("medium", 0.9)], False, "approve"), ([("high", 0.9)], False, "request_changes"),
        ([("high", 0.5)], False, "approve"), ([("critical", 0.1)], False, "block"), ([], True, "request_changes"), ([("critical", 0.1)], True, "block"),
    ],
)
def test_verdict(spark, make, rows, failed, expected):
    found = make(*[finding(i, s, c) for i, (s, c) in enumerate(rows)])
    errors = spark.createDataFrame([("r",)] if failed else [], "review_id string")
    assert [r.recommendation for r in verdict.verdicts(found, errors).collect()] == [expected]


def test_overall_severity_ignores_unknown_ones(make):
    (row,) = verdict.verdicts(make(finding(1, "blocker"), finding(2, "medium"), finding(3, None))).collect()
    assert (row.overall_severity, row.n_findings) == ("medium", 3)


def test_throttle_keeps_the_gravest(make, rows_of):
    df = make(*[finding(i, "low", line=i) for i in range(150)], finding(150, "critical"))
    kept = rows_of(ops.throttled(df), "seq")
    assert len(kept) == 100 and (150,) in kept and (98,) in kept and (99,) not in kept
    assert [r.n_suppressed for r in ops.suppressed(df).collect()] == [51]


def test_first_agent_wins_and_paths_are_normalised(make, rows_of):
    df = make(finding(1, agent="code_quality", severity="critical", path="./a.py"), finding(2, path="a.py"), finding(3, agent="test", path=None), finding(4, agent="test", line=None))
    assert rows_of(ops.first_by_agent(df), "seq") == [(2,), (3,), (4,)]


def test_best_per_place_prefers_the_later_of_equals(make, rows_of):
    df = make(finding(1, confidence=0.7), finding(2, confidence=0.95), finding(3, confidence=0.95), finding(4, "high", 0.1, line=2), finding(5, "low", 0.9, line=2))
    assert rows_of(ops.best_per_place(df), "seq") == [(3,), (4,)]


def test_titles_and_blank_evidence(make, rows_of):
    df = make(finding(1, title="A"), finding(2, title="B", evidence="  "), finding(3, title=None, evidence=None))
    assert rows_of(ops.without_titles(df, make(finding(9, title="A"))), "seq") == [(2,), (3,)]
    assert rows_of(ops.with_evidence_only(df), "seq") == [(1,)]


def test_summary(make):
    df = make(*[finding(i, "high" if i == 5 else "low", title=f"t{i}", line=i) for i in range(11)], finding(20, "info"))
    (row,) = ops.notable_summary(df).collect()
    told = row.summary.split("; ")
    assert told[0] == "t5 [high] at a.py:5" and told[-1] == "+3 more finding(s)" and len(told) == 9


def test_concatenated(make, rows_of):
    got = ops.concatenated(make(finding(5, title="x")), make(finding(1, title="y"), finding(2, title="z")))
    assert [t for _, t in rows_of(got, "seq", "title")] == ["x", "y", "z"]


@pytest.fixture
def places(spark):
    chunks = spark.createDataFrame([("r", 1, "a.py", "@@ -1 +1 @@\n+one\n+two", 1, 2)], "review_id string, chunk_id long, file_path string, diff_text string, line_start int, line_end int")
    sources = spark.createDataFrame([("r", "b.py", "l1\nl2\nl3\nl4\nl5\nl6")], "review_id string, file_path string, source string")
    return chunks, sources


def test_evidence_is_filled_only_where_the_place_is_real(make, places):
    df = make(
        finding(1, evidence="", line=2), finding(2, evidence="", path="b.py", line=6), finding(3, evidence="", path="b.py", line=99),
        finding(4, evidence="kept"), finding(5, evidence=None, path=None), finding(6, evidence=" ", path="b.py", line=None),
    )
    got = {r.seq: r.evidence for r in ops.with_evidence(df, *places).collect()}
    assert got[1].startswith("@@") and got[2].startswith("L3…     3 | l3") and got[3] == "" and got[4] == "kept" and got[5] is None and got[6] == "l1\nl2\nl3\nl4\nl5\nl6"
    assert len(got) == 6


def test_grounding(spark, make):
    texts = spark.createDataFrame([("r", None, "+key = secret_value(1)"), ("r", "b.py", "x = 1")], "review_id string, file_path string, text string")
    df = make(
        finding(1, evidence="key = secret_value(1)"), finding(2, evidence="  2 | key = secret_value(1)"), finding(3, evidence="absent = thing(2)"),
        finding(4, evidence="x", path="b.py"), finding(5, evidence="x = 1", path="a.py"), finding(6, evidence=""), finding(7, evidence="key", path=None),
    )
    got = {r.seq: r.grounded for r in ops.grounded(df, texts).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False}


def test_empty_tables(make, places):
    none = make()
    for df in (ops.best_per_place(none), ops.first_by_agent(none), ops.throttled(none), ops.notable_summary(none), verdict.verdicts(none), ops.with_evidence(none, *places)):
        assert df.count() == 0


def test_stricter_verdict_wins(spark, make, rows_of):
    proposed = spark.createDataFrame([("r", "critical", "nonsense")], "review_id string, overall_severity string, recommendation string")
    assert rows_of(verdict.combined(verdict.verdicts(make(finding(1))), proposed), "overall_severity", "recommendation") == [("critical", "approve")]


def test_latest_reports_and_errors(spark, rows_of):
    reports = spark.createDataFrame([("r", "a", "old", 1), ("r", "a", "new", 2)], "review_id string, agent string, summary string, at int")
    assert rows_of(verdict.latest_reports(reports, "at"), "summary") == [("new",)]
    errors = spark.createDataFrame([("r", "e", 2), ("r", "e", 1), ("r", "f", 3)], "review_id string, error string, seq int")
    assert rows_of(verdict.distinct_errors(errors), "error", "seq") == [("e", 1), ("f", 3)]
