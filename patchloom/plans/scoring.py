"""Queries that score findings against expected issues, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..operators import evals
from ..operators.findings import distinct_findings
from ..session import materialise
from ..sources.tables import table

#: The located security findings of a review stand for its expected issues; found are those of all agents.
_LABEL = "agent = 'security' and severity in ('critical', 'high') and file_path <> '' and line_start is not null"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distinct_findings(table(spark, sf_dir, "findings"))
    return rows.withColumn("scenario_id", F.col("review_id")).withColumn("finding", F.col("seq").cast("long"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the graver security findings; odd ones ask for a path and lines, even ones only for a word of the title."""
    rows = _findings(spark, sf_dir).where(_LABEL)
    odd = F.col("seq") % 2 == 1
    return rows.select(
        "scenario_id", F.col("seq").cast("long").alias("label_seq"), "agent", "category", "severity", F.when(odd, F.col("file_path")).alias("file_path"),
        F.when(odd, F.greatest(F.lit(1), F.col("line_start") - 2)).alias("line_start"), F.when(odd, F.col("line_start") + 2).alias("line_end"),
        F.when(odd, F.array().cast("array<string>")).otherwise(F.array(F.element_at(F.split("title", " "), 2))).alias("keywords"),
    )


def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.candidates(_labels(spark, sf_dir), _findings(spark, sf_dir)).select("scenario_id", "label_seq", "finding", "off_line", "distance")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with negative labels: nothing of the category style may be found; reviews that run no tests and have no message should be clean."""
    labels, findings = _labels(spark, sf_dir), _findings(spark, sf_dir)
    negatives = labels.where("category = 'style'")
    clean = table(spark, sf_dir, "reviews").where("not run_tests and commit_message is null").select(F.col("review_id").alias("scenario_id"))
    # Pairs are narrow and read three times.
    pairs = materialise(evals.assigned(evals.candidates(labels, findings)), "pairs")
    return evals.scenario_scores(labels, findings, pairs, negatives, clean)


def scenario_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def scenario_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the scores does not hang on which finding a label takes: findings told, with evidence, and labels asked."""
    scores = _scored(spark, sf_dir).select("scenario_id", F.round("evidence_ratio", 6).alias("evidence_ratio"), (F.col("tp") + F.col("fn")).alias("n_labels"))
    return scores.where("evidence_ratio is not null")


def suite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.suite_score(scenario_scores(spark, sf_dir))


def suite_of_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suite's score over figures that each review has of itself; reviews without a usable budget count as failed."""
    rows = table(spark, sf_dir, "reviews").groupBy("review_id").agg(F.max(F.coalesce("max_tokens", F.lit(0))).alias("tokens"), F.bool_or("run_tests").alias("ran"))
    findings = _findings(spark, sf_dir).groupBy("review_id").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("tp"), F.count_if(F.col("severity") == "info").alias("fp"), F.count_if(F.col("line_start").isNull()).alias("fn")
    )
    scores = rows.join(findings, "review_id").select(
        F.when(F.col("tokens") > 0, "completed").otherwise("error").alias("status"), "tokens", "tp", "fp", "fn", F.col("ran").alias("recommendation_match"), F.when(F.col("ran"), F.col("tp") > F.col("fp")).alias("checks_passed")
    )
    out = evals.suite_score(scores)
    return out.select("n_scenarios", "n_errors", "tp", "fp", "fn", "tokens", *[F.round(c, 9).alias(c) for c in ("recommendation_accuracy", "checks_passed", "precision", "recall", "f1")])


def missed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels missed if each took the finding it was made of and those of odd lines took none; equal labels are one."""
    labels = _labels(spark, sf_dir)
    pairs = labels.where("label_seq % 3 = 0").select("scenario_id", "label_seq")
    return evals.missed_labels(labels, pairs)


def finding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By agent: shares of grave, merely noted and unlocated findings as rates with zero guards."""
    rows = _findings(spark, sf_dir).groupBy("agent").agg(
        F.count_if(F.col("severity").isin("critical", "high")).alias("tp"),
        F.count_if(F.col("severity") == "info").alias("fp"),
        F.count_if(F.col("line_start").isNull()).alias("fn"),
    )
    rated = evals.with_rates(rows)
    return rated.select("agent", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def severity_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often security and code_quality findings of one review and category agree in severity."""
    rows = _findings(spark, sf_dir)
    a, b = (
        rows.where(F.col("agent") == agent).groupBy("scenario_id", "category").agg(F.max(evals.severity_weight(F.col("severity"))).alias(name))
        for agent, name in (("security", "w1"), ("code_quality", "w2"))
    )
    return a.join(b, ["scenario_id", "category"]).groupBy("category").agg(
        F.round(F.avg((F.col("w1") == F.col("w2")).cast("double")), 6).alias("exact"),
        F.round(F.avg((F.abs(F.col("w1") - F.col("w2")) <= 1).cast("double")), 6).alias("within_one"),
    )


def scenario_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews chosen by tag, as in fake mode; their tags are what can be said of them."""
    tags = F.array_compact(F.array(F.when(F.col("run_tests"), "tests-enabled"), F.when(F.col("max_tokens") > 4096, "large"), F.when(F.col("commit_message").isNull(), "silent"), F.lit("all")))
    rows = table(spark, sf_dir, "reviews").dropDuplicates().select(F.col("review_id").alias("id"), "ingested_at", tags.alias("tags"))
    return evals.selected_scenarios(rows, tags=["large", "silent"], fake=True).select("id", F.array_join("tags", ",").alias("tags"))


def review_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a review's changed files for which a source was kept."""
    changed = table(spark, sf_dir, "diff_chunks").groupBy("review_id").agg(F.countDistinct("file_path").alias("changed"))
    read = table(spark, sf_dir, "file_sources").groupBy("review_id").agg(F.countDistinct("file_path").alias("reviewed"))
    rows = changed.join(read, "review_id", "left")
    return rows.select("review_id", F.round(evals.coverage(F.coalesce("reviewed", F.lit(0)), F.col("changed")), 6).alias("coverage"))


QUERIES = {
    f.__name__: f
    for f in (label_candidates, scenario_scores, scenario_ratios, suite_score, suite_of_reviews, missed_labels, finding_rates, severity_calibration, scenario_selection, review_coverage)
}

_F = "g AS (SELECT DISTINCT ON (review_id, agent, seq) *, review_id AS scenario_id FROM findings)"
_WEIGHT = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

_L = """l AS (SELECT *, seq % 2 = 1 AS odd FROM g WHERE agent = 'security' AND severity IN ('critical', 'high') AND file_path <> '' AND line_start IS NOT NULL)"""

SQL = {
    "scenario_ratios": f"""WITH {_F}, {_L}, n AS (SELECT scenario_id, round(avg((trim(coalesce(evidence, ''), '{WHITE_SPACE}') <> '')::INT), 6) AS evidence_ratio
          FROM g WHERE severity IS NULL OR severity <> 'info' GROUP BY scenario_id)
        SELECT scenario_id, evidence_ratio, (SELECT count(*) FROM l WHERE l.scenario_id = n.scenario_id) AS n_labels FROM n""",
    "suite_of_reviews": f"""WITH {_F}, r AS (SELECT review_id, max(coalesce(max_tokens, 0)) AS tokens, bool_or(run_tests) AS ran FROM reviews GROUP BY review_id),
        c AS (SELECT review_id, count(*) FILTER (severity IN ('critical', 'high')) AS tp, count(*) FILTER (severity = 'info') AS fp, count(*) FILTER (line_start IS NULL) AS fn FROM g GROUP BY review_id),
        d AS (SELECT * FROM r JOIN c USING (review_id)), a AS (
          SELECT count(*) FILTER (tokens > 0) AS n_scenarios, count(*) FILTER (tokens <= 0) AS n_errors, CAST(sum(tp) FILTER (tokens > 0) AS BIGINT) AS tp, CAST(sum(fp) FILTER (tokens > 0) AS BIGINT) AS fp,
            CAST(sum(fn) FILTER (tokens > 0) AS BIGINT) AS fn, CAST(sum(tokens) FILTER (tokens > 0) AS BIGINT) AS tokens, round(avg(ran::INT) FILTER (tokens > 0), 9) AS recommendation_accuracy,
            round(avg((tp > fp)::INT) FILTER (tokens > 0 AND ran), 9) AS checks_passed FROM d),
        p AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS q FROM a)
        SELECT n_scenarios, n_errors, tp, fp, fn, tokens, recommendation_accuracy, checks_passed, round(p, 9) AS precision, round(q, 9) AS recall, round(2 * p * q / (p + q), 9) AS f1 FROM p""",
    "missed_labels": f"""WITH {_F}, {_L}, k AS (SELECT scenario_id, seq, (category, severity, CASE WHEN odd THEN (file_path, line_start) END, CASE WHEN odd THEN NULL ELSE string_split(title, ' ')[2] END)::VARCHAR AS k FROM l),
        m AS (SELECT scenario_id, k, count(*) AS n, bool_or(seq % 3 = 0) AS met FROM k GROUP BY ALL)
        SELECT scenario_id, CAST(sum(CASE WHEN met THEN 0 ELSE n END) AS BIGINT) AS fn FROM m GROUP BY scenario_id""",
    "label_candidates": f"""WITH {_F}, l AS (SELECT * FROM g WHERE agent = 'security' AND severity IN ('critical', 'high') AND file_path <> '' AND line_start IS NOT NULL)
        SELECT l.scenario_id, CAST(l.seq AS BIGINT) AS label_seq, CAST(g.seq AS BIGINT) AS finding,
          CASE WHEN l.seq % 2 = 1 AND g.line_start = greatest(1, l.line_start - 2) THEN 0 ELSE 1 END AS off_line,
          abs(coalesce(g.line_start, 0) - CASE WHEN l.seq % 2 = 1 THEN greatest(1, l.line_start - 2) ELSE 0 END) AS distance
        FROM l JOIN g ON g.scenario_id = l.scenario_id AND g.agent = l.agent AND g.category = l.category AND coalesce(g.severity <> 'info', true)
          AND CASE WHEN l.seq % 2 = 1 THEN g.file_path = l.file_path AND g.line_start BETWEEN greatest(1, l.line_start - 2) AND l.line_start + 2
              ELSE contains(lower(coalesce(g.title, '') || chr(10) || coalesce(g.evidence, '') || chr(10) || coalesce(g.description, '')), lower(string_split(l.title, ' ')[2])) END""",
    "finding_rates": f"""WITH {_F}, c AS (SELECT agent, count(*) FILTER (severity IN ('critical', 'high')) AS tp, count(*) FILTER (severity = 'info') AS fp,
          count(*) FILTER (line_start IS NULL) AS fn FROM g GROUP BY agent),
        p AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM c)
        SELECT agent, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall,
          round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 9) AS f1 FROM p""",
    "severity_calibration": f"""WITH {_F}, a AS (SELECT scenario_id, category, max({_WEIGHT}) AS w1 FROM g WHERE agent = 'security' GROUP BY ALL),
        b AS (SELECT scenario_id, category, max({_WEIGHT}) AS w2 FROM g WHERE agent = 'code_quality' GROUP BY ALL)
        SELECT category, round(avg((w1 = w2)::INT), 6) AS exact, round(avg((abs(w1 - w2) <= 1)::INT), 6) AS within_one FROM a JOIN b USING (scenario_id, category) GROUP BY category""",
    "scenario_selection": """WITH d AS (SELECT DISTINCT * FROM reviews), t AS (SELECT review_id AS id, list_filter([CASE WHEN run_tests THEN 'tests-enabled' END, CASE WHEN max_tokens > 4096 THEN 'large' END,
          CASE WHEN commit_message IS NULL THEN 'silent' END, 'all'], lambda x: x IS NOT NULL) AS tags FROM d)
        SELECT id, array_to_string(tags, ',') AS tags FROM t WHERE list_has_any(tags, ['large', 'silent']) AND NOT list_has_any(tags, ['llm-only', 'tests-enabled'])""",
    "review_coverage": """WITH c AS (SELECT review_id, count(DISTINCT file_path) AS n FROM diff_chunks GROUP BY 1), r AS (SELECT review_id, count(DISTINCT file_path) AS m FROM file_sources GROUP BY 1)
        SELECT review_id, round(coalesce(m, 0) / n, 6) AS coverage FROM c LEFT JOIN r USING (review_id)""",
}
