"""Queries over diffs and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import entropy, truncation_note
from ..operators import budget
from ..operators.detect import MIN_ENTROPY, PLACEHOLDERS, RULES, private_keys_in_sources, secrets_in_diffs
from ..operators.diffs import HUNK_HEADER, LARGE_DIFF, added_lines, chunked, file_sections, header_path, hunks, merged_adjacent
from ..operators.lists import first_distinct
from ..operators.models import summarised
from ..operators.registry import Detector, Registry
from ..sources.files import MARKERS, told_frameworks
from ..sources.tables import table


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as delivered, repeats and all: for operators that reduce a chunk before they tell repeats."""
    return table(spark, sf_dir, "diff_chunks")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "diff_chunks").dropDuplicates(["chunk_id"])


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "reviews").groupBy("review_id").agg(F.max(F.struct("ingested_at", "created_at", "max_tokens")).alias("x"))
    return rows.select("review_id", F.when(F.col("x.max_tokens") > 0, F.col("x.max_tokens")).alias("max_tokens"))


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hunks(deliveries(spark, sf_dir), ["chunk_id"])
    return rows.select("chunk_id", "hunk", "line_start", "line_end", F.length("diff_text").alias("n_chars")).distinct()


def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return added_lines(chunks(spark, sf_dir), ["chunk_id"]).groupBy("chunk_id").agg(
        F.count("*").alias("n_added"), F.sum("line_no").alias("line_nos"), F.sum(F.length("text")).alias("n_chars")
    )


def _raw_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk as the one-file diff of a review of its own."""
    head = F.concat(F.lit("diff --git a/"), F.col("file_path"), F.lit(" b/"), F.col("file_path"), F.lit("\n+++ b/"), F.col("file_path"), F.lit("\n"))
    return deliveries(spark, sf_dir).select(F.col("chunk_id").cast("string").alias("review_id"), F.concat(head, F.coalesce("diff_text", F.lit(""))).alias("raw"))


def diff_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk written as a raw diff of two files and taken apart again."""
    raw = _raw_diffs(spark, sf_dir)
    # A diff is one row, so repeats need only be told at the end.
    other = F.lit('\ndiff --git "a/docs/read me.md" "b/docs/read me.md"\nBinary files differ')
    return file_sections(raw.withColumn("raw", F.concat("raw", other))).select(
        "review_id", "seq", "file_path", F.sha2("diff_text", 256).alias("diff_hash")
    ).distinct()


def diff_header_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = chunks(spark, sf_dir).select("file_path").distinct()
    line = F.concat(F.lit('diff --git "a/'), F.col("file_path"), F.lit('" "b/'), F.col("file_path"), F.lit('"'))
    return paths.select("file_path", header_path(line).alias("new_path"))


def diff_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every diff by the symbols of its review's snapshot."""
    runs = table(spark, sf_dir, "reviews").groupBy("review_id").agg(F.max(F.struct("ingested_at", "repo_path", "git_hash")).alias("x"))
    symbols = table(spark, sf_dir, "symbols").dropDuplicates(["symbol_id"])
    own = runs.select("review_id", "x.repo_path", "x.git_hash").join(symbols, ["repo_path", "git_hash"])
    files = chunks(spark, sf_dir).where("diff_text is not null").select("review_id", "file_path", "chunk_id", "diff_text")
    # One diff a file: the chunks of a file in order, one after the other.
    rows = F.array_sort(F.collect_list(F.struct("chunk_id", "diff_text")))
    whole = files.groupBy("review_id", "file_path").agg(F.array_join(F.transform(rows, lambda r: r["diff_text"]), "\n").alias("diff_text"))
    return chunked(whole, own).select("review_id", "file_path", "symbol", "line_start", "line_end", "n_merged", F.length("diff_text").alias("n_chars"))


def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_adjacent(chunks(spark, sf_dir)).select("review_id", "file_path", "chunk_id", "symbol", "line_start", "line_end", "n_merged", F.length("diff_text").alias("n_chars"))


def large_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deliveries(spark, sf_dir).where(F.length("diff_text") > LARGE_DIFF).select("chunk_id", F.length("diff_text").alias("n_chars")).distinct()


def summarised_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summarised(deliveries(spark, sf_dir).where("diff_text is not null"), None)
    return rows.select("chunk_id", F.length("diff_text").alias("n_chars")).distinct()


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.token_totals(deliveries(spark, sf_dir))


def budget_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.fitting_chunks(deliveries(spark, sf_dir), limits(spark, sf_dir))


def pruned_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deliveries(spark, sf_dir)
    return budget.pruned_list(rows, budget.fitting_chunks(rows, limits(spark, sf_dir)))


def context_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.context_prefix(chunks(spark, sf_dir)).select("review_id", "chunk_id", F.length("entry").alias("n_chars"), F.sha2("entry", 256).alias("entry_hash"))


def full_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = budget.full_diff(chunks(spark, sf_dir).where("diff_text is not null"), "chunk_id")
    return rows.select("review_id", F.sha2("full_diff", 256).alias("diff_hash"))


def bounded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "file_sources").groupBy("review_id", "file_path").agg(F.max("source").alias("source"))
    rows = budget.bounded_sources(sources, chunks(spark, sf_dir))
    return rows.select("review_id", "file_path", F.length("source").alias("n_chars"), F.sha2("source", 256).alias("source_hash"))


def secret_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's hits on added lines, by rule."""
    return secrets_in_diffs(chunks(spark, sf_dir), ["chunk_id"]).select("chunk_id", "line_no", "rule", "severity", F.sha2("value", 256).alias("value_hash"))


def private_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "file_sources").groupBy("review_id", "file_path").agg(F.max("source").alias("source"))
    return private_keys_in_sources(sources, ["review_id", "file_path"])


def evidence_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = table(spark, sf_dir, "findings").select("evidence").distinct()
    return evidence.select("evidence", F.round(entropy(F.col("evidence")), 6).alias("entropy"))


def _unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a review that were read and not changed, by path: what stands for its dependents."""
    read = table(spark, sf_dir, "file_sources").where("file_path <> ''").groupBy("review_id", "file_path").agg(F.max("source").alias("source"))
    return read.join(deliveries(spark, sf_dir).select("review_id", "file_path").distinct(), ["review_id", "file_path"], "left_anti")


def review_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt's context of each review, of the chunks with an even number; reviews with none fall back on their whole diff."""
    rows = chunks(spark, sf_dir)
    some = rows.where("chunk_id % 2 = 0 and file_path <> ''")
    files = _unchanged(spark, sf_dir)
    dependents = files.withColumn("position", F.row_number().over(Window.partitionBy("review_id").orderBy("file_path")))
    diffs = budget.full_diff(rows.where("diff_text is not null"), "chunk_id")
    out = budget.review_contexts(some, dependents, files, diffs)
    return out.select("review_id", F.length("context").alias("n_chars"), F.sha2("context", 256).alias("context_hash"))


def truncation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deliveries(spark, sf_dir).select("chunk_id", truncation_note(F.col("diff_text")).alias("note")).distinct()
    return rows.where("note <> ''")


def first_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty files that each review changes, in the order of its chunks."""
    return first_distinct(deliveries(spark, sf_dir), ["review_id"], "file_path", F.col("chunk_id"), 20)


def frameworks_of_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test frameworks of reviews whose sources are laid out as trees: every third file stands for a marker, every fifth for a test."""
    n = F.pmod(F.length("file_path") + F.length("review_id"), F.lit(12))
    names = F.array(*[F.lit(x) for x in (*[m[1] for m in MARKERS[:4]], "package.json", "go.mod", "tests/test_a.py", "test/test_b.py", "src/test_c.py", "a.py", "tests/deep/test_d.py", "conftest.py")])
    files = table(spark, sf_dir, "file_sources").select(F.col("review_id").alias("repo_path"), F.get(names, n.cast("int")).alias("rel_path"), "source")
    return told_frameworks(files.where("rel_path is not null"))


def detector_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two registered detectors, the second of which leaves out the files in which the first found anything."""
    def secrets(inputs: dict[str, DataFrame]) -> DataFrame:
        return secrets_in_diffs(inputs["chunks"], ["chunk_id", "review_id", "file_path"]).select("review_id", "file_path", "line_no")

    def keys(inputs: dict[str, DataFrame]) -> DataFrame:
        found = private_keys_in_sources(inputs["sources"], ["review_id", "file_path"])
        return found.join(inputs["secrets"].select("review_id", "file_path").distinct(), ["review_id", "file_path"], "left_anti").select("review_id", "file_path", "line_no")

    registry = Registry([Detector("keys", "Private keys", keys, ("secrets",)), Detector("secrets", "Secrets", secrets)])
    sources = table(spark, sf_dir, "file_sources").groupBy("review_id", "file_path").agg(F.max("source").alias("source"))
    found = registry.run({"chunks": chunks(spark, sf_dir), "sources": sources})
    return found.groupBy("agent").agg(F.count("*").alias("n_hits"), F.countDistinct("review_id").alias("n_reviews"))


QUERIES = {
    f.__name__: f
    for f in (
        diff_hunks, diff_added_lines, diff_sections, diff_header_paths, diff_chunked, merge_adjacent, large_diffs, summarised_diffs, token_totals,
        budget_prune, pruned_places, context_prefix, full_diffs, bounded_sources, secret_lines, private_keys, evidence_entropy,
        review_contexts, truncation_notes, first_changed_files, frameworks_of_trees, detector_runs,
    )
}

_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM diff_chunks)"
_HEADER = HUNK_HEADER
_ROWS = f"""x AS (SELECT chunk_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT chunk_id, string_split(diff_text, chr(10)) AS ls FROM c)),
  h AS (SELECT *, sum(regexp_matches(line, '{_HEADER}')::INT) OVER (PARTITION BY chunk_id ORDER BY pos) AS hunk FROM x),
  hh AS (SELECT * FROM h WHERE hunk > 0)"""
_LIMITS = """lim AS (SELECT review_id, CASE WHEN max_tokens > 0 THEN max_tokens ELSE 100000 END AS budget FROM reviews
  QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY ingested_at DESC, created_at DESC, max_tokens DESC NULLS LAST) = 1)"""
_FIT = f"""{_C}, {_LIMITS},
  s AS (SELECT c.review_id, chunk_id, file_path, coalesce(length(diff_text), 0) AS size, coalesce(length(diff_text), 0) // 4 AS cost, coalesce(budget, 100000) AS budget FROM c LEFT JOIN lim USING (review_id)),
  tot AS (SELECT review_id, sum(cost) AS total FROM s GROUP BY 1),
  l AS (SELECT *, row_number() OVER (PARTITION BY review_id, file_path ORDER BY size DESC, chunk_id) AS r, min(chunk_id) OVER (PARTITION BY review_id, file_path) AS file_order FROM s),
  o AS (SELECT l.*, row_number() OVER (PARTITION BY review_id ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END,
          CASE WHEN r = 1 THEN file_order ELSE 0 END, size DESC, chunk_id) AS n FROM l JOIN tot USING (review_id) WHERE total > budget),
  fold AS (
    SELECT review_id, n, chunk_id, CASE WHEN cost <= budget THEN cost ELSE 0 END AS used, cost <= budget AS kept FROM o WHERE n = 1
    UNION ALL
    SELECT o.review_id, o.n, o.chunk_id, CASE WHEN f.used + o.cost <= o.budget THEN f.used + o.cost ELSE f.used END, f.used + o.cost <= o.budget
    FROM fold f JOIN o ON o.review_id = f.review_id AND o.n = f.n + 1),
  fit AS (SELECT review_id, chunk_id, kept FROM fold UNION ALL SELECT s.review_id, chunk_id, true FROM s JOIN tot USING (review_id) WHERE total <= budget)"""
_ENTRY = """'### ' || file_path || ' :: ' || coalesce(symbol_kind, '') || ' ' || coalesce(symbol, '') || ' (L' || line_start || '-' || line_end || ')' || chr(10)
  || '```diff' || chr(10) || coalesce(diff_text, '') || chr(10) || '```' || chr(10)"""
_RULE_ROWS = " UNION ALL ".join(
    f"SELECT chunk_id, line_no, {i} AS p, '{r.name}' AS rule, '{r.severity}' AS severity, {r.gated} AS gated, regexp_extract(t, '{r.pattern.replace(chr(39), chr(39) * 2)}', 1) AS value FROM a"
    for i, r in enumerate(RULES)
)
_ENTROPY = """CASE WHEN {0} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c:
  -(len(list_filter(string_split({0}, ''), lambda d: d = c)) / len({0})) * log2(len(list_filter(string_split({0}, ''), lambda d: d = c)) / len({0})))) END"""

SQL = {
    "diff_hunks": f"""WITH {_C}, {_ROWS} SELECT chunk_id, hunk::INT AS hunk, CAST(regexp_extract(arg_min(line, pos), '{_HEADER}', 1) AS INT) AS line_start,
        CAST(CAST(regexp_extract(arg_min(line, pos), '{_HEADER}', 1) AS INT) + greatest(0, count(*) FILTER (NOT (line[1:2] = '@@' OR line[1:3] = '---' OR line[1:3] = '+++' OR line[1:1] = '-')) - 1) AS INT) AS line_end,
        CAST(sum(length(line)) + count(*) - 1 AS INT) AS n_chars FROM hh GROUP BY chunk_id, hunk""",
    "diff_added_lines": f"""WITH {_C}, {_ROWS}, n AS (SELECT *, CAST(regexp_extract(first_value(line) OVER w, '{_HEADER}', 1) AS INT)
          + sum((NOT regexp_matches(line, '{_HEADER}') AND line[1:1] <> '-' AND line[1:1] <> '\\')::INT) OVER w - 1 AS line_no
          FROM hh WINDOW w AS (PARTITION BY chunk_id, hunk ORDER BY pos))
        SELECT chunk_id, count(*) AS n_added, CAST(sum(line_no) AS BIGINT) AS line_nos, CAST(sum(length(line) - 1) AS BIGINT) AS n_chars FROM n
        WHERE line[1:1] = '+' AND line[1:4] <> '+++ ' GROUP BY chunk_id""",
    "diff_sections": f"""WITH {_C} SELECT CAST(chunk_id AS VARCHAR) AS review_id, 1 AS seq, file_path,
          sha256('diff --git a/' || file_path || ' b/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || coalesce(diff_text, '')) AS diff_hash FROM c
        UNION ALL SELECT CAST(chunk_id AS VARCHAR), 2, 'docs/read me.md', sha256('diff --git "a/docs/read me.md" "b/docs/read me.md"' || chr(10) || 'Binary files differ') FROM c""",
    "diff_header_paths": "SELECT DISTINCT file_path, file_path AS new_path FROM diff_chunks",
    "merge_adjacent": f"""WITH {_C}, a AS (SELECT *, CASE WHEN lag(chunk_id) OVER w IS NOT NULL AND lag(symbol) OVER w IS NOT DISTINCT FROM symbol
            AND lag(symbol_kind) OVER w IS NOT DISTINCT FROM symbol_kind THEN 0 ELSE 1 END AS f FROM c WINDOW w AS (PARTITION BY review_id, file_path ORDER BY line_start, chunk_id)),
        b AS (SELECT *, sum(f) OVER (PARTITION BY review_id, file_path ORDER BY line_start, chunk_id) AS run FROM a),
        d AS (SELECT *, CASE WHEN line_start > max(line_end) OVER (PARTITION BY review_id, file_path, run ORDER BY line_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 5
            OR max(line_end) OVER (PARTITION BY review_id, file_path, run ORDER BY line_start, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS g FROM b),
        e AS (SELECT *, sum(g) OVER (PARTITION BY review_id, file_path, run ORDER BY line_start, chunk_id) AS island FROM d)
        SELECT review_id, file_path, arg_min(chunk_id, (line_start, chunk_id)) AS chunk_id, first(symbol) AS symbol, min(line_start) AS line_start, max(line_end) AS line_end,
          count(*) AS n_merged, CAST(coalesce(sum(length(diff_text)) + greatest(count(diff_text) - 1, 0), 0) AS INT) AS n_chars FROM e GROUP BY review_id, file_path, run, island""",
    "large_diffs": f"WITH {_C} SELECT chunk_id, CAST(length(diff_text) AS INT) AS n_chars FROM c WHERE length(diff_text) > 24000",
    "summarised_diffs": f"WITH {_C} SELECT chunk_id, CAST(CASE WHEN length(diff_text) > 24000 THEN least(length(diff_text), 48000) ELSE length(diff_text) END AS INT) AS n_chars FROM c WHERE diff_text IS NOT NULL",
    "token_totals": f"WITH {_C} SELECT review_id, CAST(sum(coalesce(length(diff_text), 0) // 4) AS BIGINT) AS n_tokens, count(*) AS n_chunks FROM c GROUP BY review_id",
    "budget_prune": f"WITH RECURSIVE {_FIT} SELECT review_id, chunk_id, kept FROM fit",
    "pruned_places": f"WITH RECURSIVE {_FIT} SELECT review_id, chunk_id, file_path || ':' || line_start || '-' || line_end AS pruned FROM fit JOIN c USING (review_id, chunk_id) WHERE NOT kept",
    "context_prefix": f"""WITH {_C}, e AS (SELECT review_id, chunk_id, {_ENTRY} AS entry FROM c), r AS (SELECT *, sum(length(entry)) OVER (PARTITION BY review_id ORDER BY chunk_id) AS until FROM e),
        k AS (SELECT review_id, chunk_id, CASE WHEN until <= 16000 THEN entry ELSE left(entry, CAST(16000 - (until - length(entry)) AS INT)) || chr(10) || '... [truncated]' || chr(10) END AS entry
          FROM r WHERE until <= 16000 OR (until - length(entry) <= 16000 AND 16000 - (until - length(entry)) > 200))
        SELECT review_id, chunk_id, CAST(length(entry) AS INT) AS n_chars, sha256(entry) AS entry_hash FROM k""",
    "full_diffs": f"WITH {_C} SELECT review_id, sha256(string_agg(diff_text, chr(10) ORDER BY chunk_id)) AS diff_hash FROM c WHERE diff_text IS NOT NULL GROUP BY review_id",
    "bounded_sources": """WITH s AS (SELECT review_id, file_path, max(source) AS source FROM file_sources GROUP BY ALL), k AS (SELECT DISTINCT review_id, file_path, true AS own FROM diff_chunks),
        b AS (SELECT review_id, file_path, CASE WHEN own THEN left(source, 8000) WHEN length(source) > 8000 THEN left(source, 8000) || chr(10) || '... [truncated]' ELSE source END AS source
          FROM s LEFT JOIN k USING (review_id, file_path))
        SELECT review_id, file_path, CAST(length(source) AS INT) AS n_chars, sha256(source) AS source_hash FROM b""",
    "review_contexts": f"""WITH {_C}, e AS (SELECT review_id, chunk_id, {_ENTRY} AS entry FROM c WHERE chunk_id % 2 = 0 AND file_path <> ''),
        r AS (SELECT *, sum(length(entry)) OVER (PARTITION BY review_id ORDER BY chunk_id) AS until FROM e),
        k AS (SELECT review_id, chunk_id, until <= 16000 AS whole, CASE WHEN until <= 16000 THEN entry ELSE left(entry, CAST(16000 - (until - length(entry)) AS INT)) || chr(10) || '... [truncated]' || chr(10) END AS entry
          FROM r WHERE until <= 16000 OR (until - length(entry) <= 16000 AND 16000 - (until - length(entry)) > 200)),
        t AS (SELECT review_id, string_agg(entry, chr(10) ORDER BY chunk_id) AS entries, coalesce(sum(length(entry)) FILTER (whole), 0) AS used FROM k GROUP BY review_id),
        f AS (SELECT review_id, file_path, max(source) AS source FROM file_sources s WHERE file_path <> '' AND NOT EXISTS (SELECT 1 FROM c WHERE c.review_id = s.review_id AND c.file_path = s.file_path) GROUP BY ALL),
        d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY file_path) AS position FROM f) WHERE position <= 10),
        full_diff AS (SELECT review_id, string_agg(diff_text, chr(10) ORDER BY chunk_id) AS whole FROM c WHERE diff_text IS NOT NULL GROUP BY review_id),
        ids AS (SELECT review_id FROM full_diff UNION SELECT review_id FROM t UNION SELECT review_id FROM d),
        room AS (SELECT ids.review_id, entries, 16000 - coalesce(used, 0) AS room FROM ids LEFT JOIN t USING (review_id)),
        h AS (SELECT d.review_id, position, file_path, left(source, 800) AS snippet, room, coalesce(sum(length(left(source, 800)) + 200) OVER (PARTITION BY d.review_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN room USING (review_id) WHERE source <> ''),
        p AS (SELECT review_id, string_agg('### ' || file_path || chr(10) || '```python' || chr(10) || snippet || chr(10) || '```' || chr(10), chr(10) ORDER BY position) AS parts FROM h WHERE before = 0 OR room - before >= 200 GROUP BY review_id),
        o AS (SELECT room.review_id, entries, whole, CASE WHEN room > 1000 AND EXISTS (SELECT 1 FROM d WHERE d.review_id = room.review_id)
            THEN chr(10) || '## Dependent files (affected but not changed):' || chr(10) || coalesce(chr(10) || parts, '') END AS more FROM room LEFT JOIN p USING (review_id) LEFT JOIN full_diff USING (review_id)),
        x AS (SELECT review_id, CASE WHEN entries IS NULL AND more IS NULL THEN coalesce(left(whole, 16000), '') ELSE concat_ws(chr(10), entries, more) END AS context FROM o)
        SELECT review_id, CAST(length(context) AS INT) AS n_chars, sha256(context) AS context_hash FROM x""",
    "truncation_notes": f"""WITH {_C} SELECT chunk_id, 'LLM diff excerpt truncated to first 8000 chars of ' || length(diff_text) || ' (full raw diff scanned by the deterministic detector).' AS note
        FROM c WHERE length(diff_text) > 8000""",
    "first_changed_files": """WITH o AS (SELECT review_id, file_path, min(chunk_id) AS f FROM diff_chunks WHERE file_path <> '' GROUP BY ALL)
        SELECT review_id, file_path, CAST(row_number() OVER (PARTITION BY review_id ORDER BY f, file_path) AS INT) AS position FROM o QUALIFY position <= 20""",
    "frameworks_of_trees": """WITH t AS (SELECT review_id AS r, source, (length(file_path) + length(review_id)) % 12 AS n FROM file_sources WHERE file_path IS NOT NULL AND review_id IS NOT NULL),
        m AS (SELECT r, CASE WHEN n IN (0, 2, 3) OR n = 1 AND contains(coalesce(source, ''), 'pytest') THEN 'pytest' WHEN n = 4 THEN 'npm' WHEN n = 5 THEN 'go' WHEN n = 11 THEN 'unittest' END AS f, n IN (6, 7) AS is_test FROM t),
        k AS (SELECT DISTINCT r, f FROM m WHERE f IS NOT NULL UNION SELECT r, 'pytest' FROM m GROUP BY r HAVING count(f) = 0 AND bool_or(is_test))
        SELECT r AS repo_path, f AS framework, CASE f WHEN 'pytest' THEN 'pytest -x --tb=short' WHEN 'npm' THEN 'npm test' WHEN 'go' THEN 'go test ./...' ELSE 'python -m pytest -x --tb=short' END AS command FROM k""",
    "secret_lines": f"""WITH {_C}, {_ROWS}, n AS (SELECT *, CAST(regexp_extract(first_value(line) OVER w, '{_HEADER}', 1) AS INT)
          + sum((NOT regexp_matches(line, '{_HEADER}') AND line[1:1] <> '-' AND line[1:1] <> '\\')::INT) OVER w - 1 AS line_no
          FROM hh WINDOW w AS (PARTITION BY chunk_id, hunk ORDER BY pos)),
        a AS (SELECT chunk_id, CAST(line_no AS INT) AS line_no, line[2:] AS t FROM n WHERE line[1:1] = '+' AND line[1:4] <> '+++ '),
        r AS ({_RULE_ROWS}),
        ok AS (SELECT * FROM r WHERE value <> '' AND (NOT gated OR (NOT (lower(trim(value, ' ')) IN ({", ".join(f"'{p}'" for p in PLACEHOLDERS)})
          OR len(list_distinct(string_split(value, ''))) <= 1 OR regexp_matches(value, '^\\$|^<.*>$|\\$\\{{|environ|getenv')) AND {_ENTROPY.format("value")} >= {MIN_ENTROPY})))
        SELECT chunk_id, line_no, arg_min(rule, p) AS rule, arg_min(severity, p) AS severity, sha256(value) AS value_hash FROM ok GROUP BY chunk_id, line_no, value""",
    "private_keys": """WITH s AS (SELECT review_id, file_path, max(source) AS source FROM file_sources GROUP BY ALL),
        x AS (SELECT review_id, file_path, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM (SELECT *, string_split(source, chr(10)) AS ls FROM s))
        SELECT review_id, file_path, line_no FROM x WHERE regexp_matches(line, '-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----')""",
    "evidence_entropy": f"WITH e AS (SELECT DISTINCT evidence FROM findings) SELECT evidence, round({_ENTROPY.format('evidence')}, 6) AS entropy FROM e",
}
SQL["detector_runs"] = f"""WITH s AS ({SQL["secret_lines"]}), k AS ({SQL["private_keys"]}), c AS (SELECT DISTINCT ON (chunk_id) * FROM diff_chunks), h AS (SELECT review_id, file_path FROM s JOIN c USING (chunk_id))
        SELECT 'secrets' AS agent, count(*) AS n_hits, count(DISTINCT review_id) AS n_reviews FROM h HAVING count(*) > 0
        UNION ALL SELECT 'keys', count(*), count(DISTINCT review_id) FROM k WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.review_id = k.review_id AND h.file_path = k.file_path) HAVING count(*) > 0"""
