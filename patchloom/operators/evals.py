"""Findings scored against expected issues.

Labels meet findings in an equi join on scenario, agent, category and, where they name one, path.
The greedy assignment (labels gravest first, each taking the nearest free finding) depends on
order only among labels that share candidates, so it is folded per scenario, agent and category
over narrow candidate rows; the counts and ratios around it are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import severity_weight
from ..functions.text import is_blank, ratio

SKIPPED_IN_FAKE_MODE = ["llm-only", "tests-enabled"]


def selected_scenarios(scenarios: DataFrame, ids: list[str] | None = None, tags: list[str] | None = None, fake: bool = False) -> DataFrame:
    """Scenarios by id, or else by any of the tags; fake mode leaves out those that need a model or test runs."""
    out = scenarios
    if ids:
        out = out.where(F.col("id").isin(ids))
    elif tags:
        out = out.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if fake:
        out = out.where(~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in SKIPPED_IN_FAKE_MODE])))
    return out


def candidates(labels: DataFrame, findings: DataFrame) -> DataFrame:
    """(scenario_id, agent, category, label_seq, finding, label_weight, weight, off_line, distance) of the pairs that match.

    labels: scenario_id, label_seq, agent, category, severity, file_path, line_start, line_end,
    keywords. findings: scenario_id, finding (an identifier in list order), and a finding's columns.
    """
    f = findings.where("severity is null or severity <> 'info'").select(
        "scenario_id", "agent", "category", "finding", F.col("file_path").alias("f_path"), F.col("line_start").alias("f_line"), severity_weight(F.col("severity")).alias("weight"),
        F.lower(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("evidence", F.lit("")), F.coalesce("description", F.lit("")))).alias("hay"),
    )
    at_path = F.coalesce(F.col("file_path"), F.lit("")) == ""
    in_lines = F.col("line_start").isNull() | F.col("f_line").between(F.col("line_start"), F.coalesce("line_end", "line_start"))
    words = F.coalesce(F.size("keywords"), F.lit(0)) <= 0
    holds = F.exists("keywords", lambda k: F.contains(F.col("hay"), F.lower(k)))
    weighed = labels.withColumn("label_weight", severity_weight(F.col("severity")))
    keys = ["scenario_id", "agent", "category"]
    placed = weighed.where(~at_path).join(f.withColumn("file_path", F.col("f_path")), [*keys, "file_path"])
    anywhere = weighed.where(at_path).join(f, keys)
    pairs = placed.unionByName(anywhere).where(F.coalesce(in_lines, F.lit(False)) & (words | holds))
    exact = F.when(F.col("line_start").isNotNull() & (F.col("f_line") == F.col("line_start")), 0).otherwise(1)
    distance = F.abs(F.coalesce("f_line", F.lit(0)) - F.coalesce("line_start", F.lit(0)))
    return pairs.select(*keys, "label_seq", "finding", "label_weight", "weight", exact.alias("off_line"), distance.alias("distance"))


_PAIR = pa.schema([("scenario_id", pa.string()), ("label_seq", pa.int64()), ("finding", pa.int64()), ("label_weight", pa.int32()), ("weight", pa.int32())])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, label, taken, used = None, None, False, set()
    for batch in batches:
        keep = []
        for i, row in enumerate(zip(*(batch[c].to_pylist() for c in ("scenario_id", "agent", "category", "label_seq", "finding")))):
            if row[:3] != group:
                group, label, used = row[:3], None, set()
            if row[3] != label:
                label, taken = row[3], False
            if not taken and row[4] not in used:
                taken = True
                used.add(row[4])
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64())).select(_PAIR.names).cast(_PAIR)


def assigned(pairs: DataFrame) -> DataFrame:
    """(scenario_id, label_seq, finding, label_weight, weight): labels gravest first, each with its nearest finding that is still free.

    Candidates lie sorted in their partition and are folded as they pass; what is held is the set
    of findings taken in one group.
    """
    group = ["scenario_id", "agent", "category"]
    nearest = [F.col("off_line"), F.col("distance"), F.col("weight").desc(), F.col("finding")]
    rows = pairs.repartition(*group).sortWithinPartitions(*group, F.col("label_weight").desc(), "label_seq", *nearest)
    return rows.mapInArrow(_fold, "scenario_id string, label_seq long, finding long, label_weight int, weight int")


#: What makes two labels of a scenario equal.
LABEL = ["agent", "category", "severity", "file_path", "line_start", "line_end", "keywords"]


def missed_labels(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scenario_id, fn): labels without a finding; of equal labels one that is met meets all."""
    met = labels.join(pairs.select("scenario_id", "label_seq", F.lit(1).alias("met")), ["scenario_id", "label_seq"], "left")
    alike = met.groupBy("scenario_id", *LABEL).agg(F.count("*").alias("n"), F.max("met").alias("met"))
    return alike.groupBy("scenario_id").agg(F.sum(F.when(F.col("met").isNull(), F.col("n")).otherwise(0)).alias("fn"))


def scenario_scores(labels: DataFrame, findings: DataFrame, pairs: DataFrame, negatives: DataFrame | None = None, clean: DataFrame | None = None) -> DataFrame:
    """(scenario_id, tp, fp, fn, precision, recall, f1, severity_exact, severity_within_one, evidence_ratio) from assigned pairs.

    negatives are labels of issues that must be absent: each one met by a finding that also met a positive label
    is a false positive more. In the scenarios of clean (scenario_id) every finding is a false positive.
    """
    shown = findings.where("severity is null or severity <> 'info'").groupBy("scenario_id").agg(
        F.count("*").alias("n_findings"), F.avg((~is_blank(F.col("evidence"))).cast("double")).alias("evidence_ratio")
    )
    hits = pairs.groupBy("scenario_id").agg(
        F.count("*").alias("tp"),
        F.avg((F.col("weight") == F.col("label_weight")).cast("double")).alias("severity_exact"),
        F.avg((F.abs(F.col("weight") - F.col("label_weight")) <= 1).cast("double")).alias("severity_within_one"),
    )
    rows = missed_labels(labels, pairs).join(shown, "scenario_id", "full").join(hits, "scenario_id", "left")
    if negatives is not None:
        rows = rows.join(negative_violations(negatives, findings, pairs), "scenario_id", "left")
    if clean is not None:
        rows = rows.join(clean.select("scenario_id", F.lit(True).alias("clean")).distinct(), "scenario_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in rows.columns else F.lit(0)
    forgiven = F.when(F.col("clean"), 0).otherwise(count("tp")) if clean is not None else count("tp")
    fp = count("n_findings") - forgiven + count("n_violations")
    counted = rows.select(
        "scenario_id", count("tp").alias("tp"), fp.alias("fp"), count("fn").alias("fn"), "severity_exact", "severity_within_one", "evidence_ratio"
    )
    return with_rates(counted)


def with_rates(rows: DataFrame) -> DataFrame:
    """precision, recall and f1 of tp, fp and fn; 0.0 where they divide by zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = rows.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Means over the completed scenarios that have a value, by the column of scores they are taken of.
SUITE_MEANS = {
    "severity_exact": "mean_severity_exact", "severity_within_one": "mean_severity_within_one", "evidence_ratio": "mean_evidence_ratio",
    "evidence_grounded": "mean_evidence_grounded", "recommendation_match": "recommendation_accuracy", "checks_passed": "checks_passed", "judge": "mean_judge",
}


def suite_score(scores: DataFrame) -> DataFrame:
    """One row: summed counts of the completed scenarios with their rates, and means of their own ratios where they have one.

    scores may have status (completed or error; all are completed without it), tokens and the columns of SUITE_MEANS.
    """
    done = F.col("status") == "completed" if "status" in scores.columns else F.lit(True)
    failed = F.col("status") == "error" if "status" in scores.columns else F.lit(False)
    of_done = lambda c: F.when(done, F.col(c))
    sums = [F.coalesce(F.sum(of_done(c)), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tokens") if c in scores.columns]
    means = [F.avg(of_done(c).cast("double")).alias(name) for c, name in SUITE_MEANS.items() if c in scores.columns]
    return with_rates(scores.agg(F.count_if(done).alias("n_scenarios"), F.count_if(failed).alias("n_errors"), *sums, *means))


def negative_violations(negatives: DataFrame, findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """(scenario_id, n_violations): labels of issues that must be absent, met by a finding that also met a positive label."""
    used = findings.join(pairs.select("scenario_id", "finding"), ["scenario_id", "finding"], "left_semi")
    return candidates(negatives, used).select("scenario_id", "label_seq").distinct().groupBy("scenario_id").agg(F.count("*").alias("n_violations"))


def coverage(reviewed: Column, changed: Column) -> Column:
    """Share of changed files that were reviewed; null where none changed."""
    return F.try_divide(reviewed.cast("double"), changed)


def missing_dependents(expected: Column, checked: Column) -> Column:
    return F.size(F.array_except(expected, checked)) > 0
