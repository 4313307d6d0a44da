import random

from patchloom.operators import evals

LABEL = "scenario_id string, label_seq long, agent string, category string, severity string, file_path string, line_start int, line_end int, keywords array<string>"
FINDING = "scenario_id string, finding long, agent string, category string, severity string, file_path string, line_start int, title string, evidence string, description string"
WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def label(n, severity="high", line=5, path="a.py", words=(), agent="security", end=None):
    return ("s", n, agent, "security", severity, path, line, end, list(words))


def found(n, severity="high", line=5, path="a.py", title="Key", agent="security"):
    return ("s", n, agent, "security", severity, path, line, title, "ev", "")


def score(spark, labels, findings):
    lab, fin = spark.createDataFrame(labels, LABEL), spark.createDataFrame(findings, FINDING)
    pairs = evals.assigned(evals.candidates(lab, fin))
    return pairs, {r.scenario_id: r for r in evals.scenario_scores(lab, fin, pairs).collect()}


def test_one_match_and_noise(spark):
    _, got = score(spark, [label(1)], [found(1), found(2, line=50), found(3, severity="info")])
    r = got["s"]
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 0, 0.5, 1.0) and abs(r.f1 - 2 / 3) < 1e-12


def test_calibration_and_zero_division(spark):
    _, got = score(spark, [label(1, severity="critical")], [found(1, severity="high")])
    assert (got["s"].severity_exact, got["s"].severity_within_one) == (0.0, 1.0)
    _, got = score(spark, [label(1)], [])
    assert (got["s"].precision, got["s"].recall, got["s"].f1, got["s"].severity_exact) == (0.0, 0.0, 0.0, None)


def test_keywords_agents_and_open_places(spark):
    pairs, _ = score(spark, [label(1, words=["KEY"], line=None, path=None), label(2, words=["other"])], [found(1, title="a key", line=99), found(2, agent="test")])
    assert [(r.label_seq, r.finding) for r in pairs.collect()] == [(1, 1)]


def test_greedy_assignment_equals_brute_force(spark):
    rng = random.Random(3)
    for _ in range(5):
        labels = [label(n, rng.choice(list(WEIGHT)), rng.randint(1, 8), end=rng.randint(8, 12)) for n in range(8)]
        findings = [found(n, rng.choice(list(WEIGHT)), rng.randint(1, 12)) for n in range(8)]
        used, expected = set(), set()
        for lab in sorted(labels, key=lambda x: -WEIGHT[x[4]]):
            free = [f for f in findings if f[1] not in used and lab[6] <= f[6] <= (lab[7] or lab[6])]
            if free:
                best = min(free, key=lambda f: (f[6] != lab[6], abs(f[6] - lab[6]), -WEIGHT[f[4]], f[1]))
                used.add(best[1])
                expected.add((lab[1], best[1]))
        pairs, _ = score(spark, labels, findings)
        assert {(r.label_seq, r.finding) for r in pairs.collect()} == expected


def test_suite(spark):
    rows = spark.createDataFrame([("a", 1, 1, 0, 1.0, 1.0, 0.5), ("b", 1, 0, 1, None, None, None)], "scenario_id string, tp long, fp long, fn long, severity_exact double, severity_within_one double, evidence_ratio double")
    (r,) = evals.suite_score(rows).collect()
    assert (r.tp, r.fp, r.fn, r.mean_severity_exact, r.mean_evidence_ratio) == (2, 1, 1, 1.0, 0.5) and abs(r.f1 - 2 / 3) < 1e-12


def test_selection(spark, rows_of):
    df = spark.createDataFrame([("a", ["x"]), ("b", ["y", "llm-only"]), ("c", ["y"])], "id string, tags array<string>")
    assert rows_of(evals.selected_scenarios(df, ids=["a"], tags=["y"]), "id") == [("a",)]
    assert rows_of(evals.selected_scenarios(df, tags=["y"], fake=True), "id") == [("c",)]


def test_negative_labels(spark, rows_of):
    lab, fin = spark.createDataFrame([label(1)], LABEL), spark.createDataFrame([found(1), found(2, line=50)], FINDING)
    pairs = evals.assigned(evals.candidates(lab, fin))
    absent = spark.createDataFrame([label(7, line=5), label(8, line=50)], LABEL)
    assert rows_of(evals.negative_violations(absent, fin, pairs)) == [("s", 1)]


def test_scores_with_negatives_clean_scenarios_and_equal_labels(spark):
    # Two equal labels of which one finding meets one, a label that nothing meets, a negative label met by the used finding.
    lab = spark.createDataFrame([label(1), label(2), label(3, line=70)], LABEL)
    fin = spark.createDataFrame([found(1), found(2, line=50)], FINDING)
    pairs = evals.assigned(evals.candidates(lab, fin))
    absent = spark.createDataFrame([label(7, line=5)], LABEL)
    (r,) = evals.scenario_scores(lab, fin, pairs, absent).collect()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1)
    clean = spark.createDataFrame([("s",)], "scenario_id string")
    (r,) = evals.scenario_scores(lab, fin, pairs, absent, clean).collect()
    assert (r.tp, r.fp, r.fn) == (1, 3, 1)
    (r,) = evals.scenario_scores(lab.limit(0), fin, pairs.limit(0), clean=clean).collect()
    assert (r.tp, r.fp, r.fn, r.precision, r.f1) == (0, 2, 0, 0.0, 0.0)


def test_suite_of_completed_scenarios(spark):
    rows = spark.createDataFrame([("completed", 1, 1, 0, 7, True), ("completed", 1, 0, 1, 5, None), ("error", 9, 9, 9, 9, False)], "status string, tp long, fp long, fn long, tokens long, recommendation_match boolean")
    (r,) = evals.suite_score(rows).collect()
    assert (r.n_scenarios, r.n_errors, r.tp, r.fp, r.fn, r.tokens, r.recommendation_accuracy) == (2, 1, 2, 1, 1, 12, 1.0)
    (r,) = evals.suite_score(rows.limit(0)).collect()
    assert (r.n_scenarios, r.tp, r.precision, r.recommendation_accuracy) == (0, 0, 0.0, None)
