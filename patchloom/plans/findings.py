"""Queries over findings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE, lines, plain_line, stripped
from ..operators import findings as ops
from ..operators import verdict
from ..operators.detect import MIN_ENTROPY, PLACEHOLDERS
from ..operators.lists import first_distinct
from ..operators.render import review_json, review_text
from ..operators.reports import parsed_answers, scanner_findings
from ..sources.tables import table


def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_findings(table(spark, sf_dir, "findings"))


#: What choosing among findings reads; titles, texts and evidence stay out of its shuffles.
PLACED = ["review_id", "agent", "seq", "category", "severity", "file_path", "line_start", "confidence"]


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.distinct_findings(table(spark, sf_dir, "findings").select(PLACED))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that an orchestrator keeps, narrow: of one place the first by agent, at most 100 a report."""
    return ops.throttled(ops.first_by_agent(placed(spark, sf_dir)))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept findings with all their columns."""
    keys = ["review_id", "agent", "seq"]
    return distinct(spark, sf_dir).join(chosen(spark, sf_dir).select(keys), keys, "left_semi")


def dedupe_best_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_per_place(placed(spark, sf_dir)).select("review_id", "agent", "seq")


def dedupe_by_agent_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_by_agent(placed(spark, sf_dir)).select("review_id", "agent", "seq")


def throttle_per_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.throttled(placed(spark, sf_dir)).select("review_id", "agent", "seq")


def suppressed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.suppressed(distinct(spark, sf_dir))


def overall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.verdicts(distinct(spark, sf_dir))


def merged_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every review over its merged findings."""
    return verdict.verdicts(chosen(spark, sf_dir))


def degraded_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts where reviews of snapshots that were never indexed count as failed."""
    runs = table(spark, sf_dir, "index_runs").select("repo_path", "git_hash")
    failed = table(spark, sf_dir, "reviews").join(runs, ["repo_path", "git_hash"], "left_anti").select("review_id").distinct()
    return verdict.verdicts(distinct(spark, sf_dir), failed)


def combined_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stricter of the verdict over the security reports and the one over all others."""
    rows = distinct(spark, sf_dir)
    return verdict.combined(verdict.verdicts(rows.where("agent = 'security'")), verdict.verdicts(rows.where("agent <> 'security'")))


def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.by_severity(distinct(spark, sf_dir))


def notable_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.notable_summary(distinct(spark, sf_dir))


def findings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.findings_table(distinct(spark, sf_dir)).select("review_id", "agent", "seq", "position")


def title_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distinct(spark, sf_dir)
    known = rows.where("agent = 'security' and severity = 'critical'")
    return ops.without_titles(rows.where("agent <> 'security'"), known).select("review_id", "agent", "seq")


def concatenated_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of critical, then high, then all other findings of a report, in that order by seq."""
    rows = distinct(spark, sf_dir)
    parts = [rows.where("severity = 'critical'"), rows.where("severity = 'high'"), rows.where("severity is null or severity not in ('critical', 'high')")]
    return ops.concatenated(*parts).select("review_id", "agent", "seq", "title")


def evidence_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.with_evidence_only(distinct(spark, sf_dir))
    return kept.groupBy("agent").agg(F.count("*").alias("n_findings"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_sources").groupBy("review_id", "file_path").agg(F.max("source").alias("source"))


def evidence_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "diff_chunks").dropDuplicates(["chunk_id"])
    texts = chunks.select("review_id", F.lit(None).cast("string").alias("file_path"), F.col("diff_text").alias("text"))
    texts = texts.unionByName(_sources(spark, sf_dir).withColumnRenamed("source", "text"))
    return ops.grounded(ops.notable(distinct(spark, sf_dir)), texts)


def grounded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence_grounded(spark, sf_dir).groupBy("review_id").agg(F.avg(F.col("grounded").cast("double")).alias("r"))
    return rows.select("review_id", F.round("r", 6).alias("grounded_ratio"))


def evidence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for a finding of each chunk's third line (or of the chunk, for every third) and of each source's sixth."""
    chunks = table(spark, sf_dir, "diff_chunks").dropDuplicates(["chunk_id"]).where("diff_text is not null")
    sources = _sources(spark, sf_dir)
    no_line = F.lit(None).cast("int")
    located = F.when(F.col("chunk_id") % 3 == 0, no_line).otherwise(F.col("line_start") + 2)
    rows = chunks.select("review_id", F.lit("chunks").alias("agent"), F.col("chunk_id").alias("seq"), "file_path", located.alias("line_start"), no_line.alias("line_end"), F.lit("").alias("evidence"))
    more = sources.select(
        "review_id", F.lit("sources").alias("agent"), F.xxhash64("review_id", "file_path").alias("seq"), "file_path", F.lit(6).alias("line_start"), F.lit(7).alias("line_end"), F.lit(" ").alias("evidence")
    )
    filled = ops.with_evidence(rows.unionByName(more), chunks, sources).where("trim(evidence) <> ''")
    return filled.select("review_id", "agent", "file_path", F.coalesce("line_start", F.lit(0)).alias("line_start"), F.sha2("evidence", 256).alias("evidence_hash"))


def plain_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines without the numbers before them."""
    rows = distinct(spark, sf_dir).select("review_id", "agent", "seq", F.posexplode(lines(F.col("evidence"))).alias("pos", "line"))
    return rows.select("review_id", "agent", "seq", F.col("pos").cast("int").alias("pos"), plain_line(stripped(F.col("line"))).alias("line"))


def parsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding written as a model's JSON answer and parsed again; malformed ones by what is wrong with the original."""
    rows = distinct(spark, sf_dir)
    answer = F.concat(F.lit("```json\n["), F.to_json(F.struct("category", "severity", "title", "confidence"), {"ignoreNullFields": "false"}), F.lit("]\n```"))
    return parsed_answers(rows.select("review_id", "agent", answer.alias("text"))).groupBy("agent", "malformed").agg(
        F.count("*").alias("n_items"), F.round(F.sum(F.when(~F.col("malformed"), F.col("confidence"))), 4).alias("confidence")
    )


def reviews_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_json(verdict.verdicts(chosen(spark, sf_dir)), merged(spark, sf_dir))


def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report of every review: its verdict and the rows of its table."""
    rows = distinct(spark, sf_dir)
    texts = review_text(verdict.verdicts(rows), ops.findings_table(rows))
    return texts.select("review_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


def _scanner_raw() -> Column:
    """A finding as one scanner's report of it: bandit, semgrep or gitleaks by its place in the list."""
    code = F.concat(F.col("line_start").cast("string"), F.lit(" x = '"), F.col("category"), F.lit("'"))
    bandit = F.struct(
        F.when(F.col("seq") % 2 == 0, "B101").when(F.col("seq") % 5 == 0, "B105").otherwise("B602").alias("test_id"), F.col("file_path").alias("filename"),
        F.col("line_start").alias("line_number"), F.col("title").alias("issue_text"), F.upper("severity").alias("issue_severity"), F.lit("HIGH").alias("issue_confidence"), code.alias("code"),
    )
    extra = F.struct(F.when(F.col("severity") == "high", "error").when(F.col("severity") == "info", "Info").otherwise("odd").alias("severity"), F.col("title").alias("message"))
    semgrep = F.struct(F.col("category").alias("check_id"), F.col("file_path").alias("path"), F.struct(F.col("line_start").alias("line")).alias("start"), F.struct(F.col("line_end").alias("line")).alias("end"), extra.alias("extra"))
    gitleaks = F.struct(F.when(F.col("seq") % 2 == 0, F.col("category")).alias("RuleID"), F.col("file_path").alias("File"), F.col("line_start").alias("StartLine"), F.col("title").alias("Secret"))
    return (
        F.when(F.col("tool") == "bandit", F.to_json(F.struct(F.array(bandit).alias("results"))))
        .when(F.col("tool") == "semgrep", F.to_json(F.struct(F.array(semgrep).alias("results"))))
        .otherwise(F.to_json(F.array(gitleaks)))
    )


def scanner_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as scanner reports and parsed again, without what is noise in test code or no password."""
    tool = F.element_at(F.array(F.lit("bandit"), F.lit("semgrep"), F.lit("gitleaks")), F.pmod("seq", F.lit(3)).cast("int") + 1)
    rows = distinct(spark, sf_dir).withColumn("tool", tool).select(F.concat_ws("#", "review_id", "agent", F.col("seq").cast("string")).alias("review_id"), "tool", _scanner_raw().alias("raw"))
    return scanner_findings(rows).select(
        F.col("review_id").alias("id"), "tool", "title", "severity", "description", "file_path", "line_start", "line_end", F.length("evidence").alias("n_evidence"), "confidence"
    )


def last_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the deliveries of a report the last one, by seq."""
    return verdict.latest_reports(distinct(spark, sf_dir).select("review_id", "agent", "seq", "title"), "seq")


def first_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a review once, at their first place."""
    return verdict.distinct_errors(distinct(spark, sf_dir).select("review_id", F.col("title").alias("error"), "seq"))


def first_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three categories of each review in the order of agents and lists."""
    return first_distinct(table(spark, sf_dir, "findings"), ["review_id"], "category", F.struct("agent", "seq"), 3)


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_best_finding, dedupe_by_agent_priority, throttle_per_agent, suppressed_notes, overall_verdict, merged_verdict, degraded_verdict,
        combined_verdict, severity_histogram, notable_summary, findings_table, title_antijoin, concatenated_reports, evidence_only,
        evidence_grounded, grounded_ratio, evidence_window, plain_evidence, parsed_findings, reviews_as_json,
        review_texts, scanner_parsed, last_reports, first_errors, first_categories,
    )
}

F_ONE = "f AS (SELECT DISTINCT ON (review_id, agent, seq) * FROM findings)"
WEIGHT = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
PRIORITY = "CASE agent WHEN 'security' THEN 0 WHEN 'code_quality' THEN 1 WHEN 'test' THEN 2 WHEN 'index' THEN 3 ELSE 99 END"
LOCATED = "coalesce(file_path <> '' AND line_start IS NOT NULL, false)"
KEY = r"regexp_replace(file_path, '^[./]+', '')"
_BY_AGENT = f"""by_agent AS (
  SELECT * FROM f WHERE {LOCATED} QUALIFY row_number() OVER (PARTITION BY review_id, category, {KEY}, line_start ORDER BY {PRIORITY}, seq, agent) = 1
  UNION ALL SELECT * FROM f WHERE NOT {LOCATED})"""
_RANKED = f"row_number() OVER (PARTITION BY review_id, agent ORDER BY {WEIGHT} DESC, confidence DESC NULLS LAST, seq)"
_SEVERITY = f"CASE max({WEIGHT}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END"


def _verdict(source: str, errors: str = "false") -> str:
    return f"""SELECT review_id, {_SEVERITY} AS overall_severity,
      CASE WHEN coalesce(bool_or(severity = 'critical'), false) THEN 'block'
           WHEN coalesce(bool_or(severity = 'high' AND confidence >= 0.7), false) THEN 'request_changes'
           WHEN {errors} THEN 'request_changes' ELSE 'approve' END AS recommendation,
      count(severity_row) AS n_findings FROM ({source}) GROUP BY review_id"""


_ALL = "SELECT review_id, severity, confidence, 1 AS severity_row, false AS failed FROM f"
_STRIP = f"trim({{0}}, '{WHITE_SPACE}')"
_PLAIN = _STRIP.format(r"CASE WHEN regexp_matches({0}, '^\s*\d+\s*\|') THEN regexp_extract({0}, '^\s*\d+\s*\|\s*(.*)$', 1) ELSE {0} END")
_LINES = r"CASE WHEN {0} = '' THEN [] ELSE string_split_regex(regexp_replace({0}, '\r?\n$', ''), '\r?\n') END"
_GROUNDED = f"""
  {F_ONE}, src AS (SELECT review_id, file_path, max(source) AS source FROM file_sources GROUP BY ALL),
  c AS (SELECT DISTINCT ON (chunk_id) * FROM diff_chunks),
  asked AS (SELECT DISTINCT review_id, agent, seq, file_path, {_PLAIN.format(_STRIP.format("line"))} AS line
            FROM (SELECT *, unnest({_LINES.format("evidence")}) AS line FROM f WHERE severity IS NULL OR severity <> 'info') WHERE file_path <> ''),
  hits AS (
    SELECT DISTINCT a.review_id, a.agent, a.seq FROM asked a JOIN c USING (review_id) WHERE line <> '' AND contains(c.diff_text, line)
    UNION SELECT DISTINCT a.review_id, a.agent, a.seq FROM asked a JOIN src USING (review_id, file_path) WHERE line <> '' AND contains(src.source, line)),
  g AS (SELECT f.review_id, f.agent, f.seq, h.seq IS NOT NULL AS grounded FROM f LEFT JOIN hits h ON f.review_id = h.review_id AND f.agent = h.agent AND f.seq = h.seq
        WHERE severity IS NULL OR severity <> 'info')"""

_ENTROPY = """CASE WHEN {0} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c:
  -(len(list_filter(string_split({0}, ''), lambda d: d = c)) / len({0})) * log2(len(list_filter(string_split({0}, ''), lambda d: d = c)) / len({0})))) END"""
_PLACEHOLDERS = ", ".join(f"'{p}'" for p in PLACEHOLDERS)

SQL = {
    "dedupe_best_finding": f"""WITH {F_ONE}
        SELECT review_id, agent, seq FROM f WHERE {LOCATED}
        QUALIFY row_number() OVER (PARTITION BY review_id, agent, category, {KEY}, line_start ORDER BY {WEIGHT} DESC, confidence DESC NULLS LAST, seq DESC) = 1
        UNION ALL SELECT review_id, agent, seq FROM f WHERE NOT {LOCATED}""",
    "dedupe_by_agent_priority": f"WITH {F_ONE}, {_BY_AGENT} SELECT review_id, agent, seq FROM by_agent",
    "throttle_per_agent": f"WITH {F_ONE} SELECT review_id, agent, seq FROM f QUALIFY {_RANKED} <= 100",
    "suppressed_notes": f"""WITH {F_ONE} SELECT review_id, agent, count(*) - 100 AS n_suppressed,
        (count(*) - 100) || ' low-priority finding(s) suppressed (cap 100).' AS note FROM f GROUP BY ALL HAVING count(*) > 100""",
    "overall_verdict": f"WITH {F_ONE} {_verdict(_ALL)}",
    "merged_verdict": f"""WITH {F_ONE}, {_BY_AGENT}, kept AS (SELECT * FROM by_agent QUALIFY {_RANKED} <= 100)
        {_verdict("SELECT *, 1 AS severity_row FROM kept")}""",
    "degraded_verdict": f"""WITH {F_ONE}, failed AS (SELECT DISTINCT review_id FROM reviews r WHERE NOT EXISTS (
          SELECT 1 FROM index_runs i WHERE i.repo_path = r.repo_path AND i.git_hash = r.git_hash))
        {_verdict(f"{_ALL} UNION ALL SELECT review_id, NULL, NULL, NULL, true FROM failed", "bool_or(failed)")}""",
    "combined_verdict": f"""WITH {F_ONE}, a AS ({_verdict(_ALL + " WHERE agent = 'security'")}), b AS ({_verdict(_ALL + " WHERE agent <> 'security'")}),
        ranked AS (SELECT a.*, b.overall_severity AS s2, b.recommendation AS r2,
          {WEIGHT.replace("severity", "a.overall_severity")} AS w1, coalesce({WEIGHT.replace("severity", "b.overall_severity")}, 0) AS w2,
          CASE a.recommendation WHEN 'block' THEN 2 WHEN 'request_changes' THEN 1 ELSE 0 END AS k1,
          CASE b.recommendation WHEN 'block' THEN 2 WHEN 'request_changes' THEN 1 ELSE 0 END AS k2 FROM a LEFT JOIN b USING (review_id))
        SELECT review_id, CASE WHEN w2 > w1 THEN s2 ELSE overall_severity END AS overall_severity,
          CASE WHEN k2 > k1 THEN r2 ELSE recommendation END AS recommendation, n_findings FROM ranked""",
    "severity_histogram": f"WITH {F_ONE} SELECT review_id, severity, count(*) AS n_findings FROM f GROUP BY ALL",
    "notable_summary": f"""WITH {F_ONE}, n AS (SELECT *, row_number() OVER (PARTITION BY review_id, agent
            ORDER BY {WEIGHT} DESC, coalesce(file_path, ''), coalesce(line_start, 0), seq) AS r,
            count(*) OVER (PARTITION BY review_id, agent) AS n FROM f WHERE severity IS NULL OR severity <> 'info')
        SELECT review_id, agent, string_agg(coalesce(title, '') || ' [' || coalesce(severity, '') || ']'
          || CASE WHEN file_path <> '' THEN ' at ' || file_path || ':' || coalesce(line_start::VARCHAR, 'None') ELSE '' END, '; ' ORDER BY r)
          || CASE WHEN max(n) > 8 THEN '; +' || (max(n) - 8) || ' more finding(s)' ELSE '' END AS summary
        FROM n WHERE r <= 8 GROUP BY review_id, agent""",
    "findings_table": f"""WITH {F_ONE} SELECT review_id, agent, seq, CAST(row_number() OVER (PARTITION BY review_id
          ORDER BY {WEIGHT} DESC, {PRIORITY}, agent, seq) AS INTEGER) AS position FROM f WHERE severity IS NULL OR severity <> 'info' QUALIFY position <= 100""",
    "title_antijoin": f"""WITH {F_ONE} SELECT review_id, agent, seq FROM f WHERE agent <> 'security' AND NOT EXISTS (
        SELECT 1 FROM f k WHERE k.agent = 'security' AND k.severity = 'critical' AND k.review_id = f.review_id AND k.title = f.title)""",
    "concatenated_reports": f"""WITH {F_ONE} SELECT review_id, agent, title,
        seq + (CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END * 1099511627776) AS seq FROM f""",
    "evidence_only": f"WITH {F_ONE} SELECT agent, count(*) AS n_findings FROM f WHERE {_STRIP.format("evidence")} <> '' GROUP BY agent",
    "evidence_grounded": f"WITH {_GROUNDED} SELECT * FROM g",
    "grounded_ratio": f"WITH {_GROUNDED} SELECT review_id, round(avg(grounded::INT), 6) AS grounded_ratio FROM g GROUP BY review_id",
    "evidence_window": f"""WITH src AS (SELECT review_id, file_path, max(source) AS source FROM file_sources GROUP BY ALL),
        c AS (SELECT DISTINCT ON (chunk_id) * FROM diff_chunks WHERE diff_text IS NOT NULL),
        needy AS (
          SELECT review_id, 'chunks' AS agent, chunk_id AS k, file_path, CASE WHEN chunk_id % 3 = 0 THEN NULL ELSE line_start + 2 END AS line_start, NULL::INT AS line_end FROM c
          UNION ALL SELECT review_id, 'sources', NULL, file_path, 6, 7 FROM src),
        n AS (SELECT *, row_number() OVER () AS seq FROM needy WHERE file_path <> ''),
        chosen AS (SELECT n.seq, min(c.chunk_id) AS chunk_id FROM n JOIN c USING (review_id, file_path)
          WHERE n.line_start IS NULL OR n.line_start BETWEEN c.line_start AND c.line_end GROUP BY ALL),
        t AS (SELECT n.*, c.diff_text, c.line_start AS c_start, {_LINES.format("c.diff_text")} AS cl, s.source, {_LINES.format("s.source")} AS sl
          FROM n LEFT JOIN chosen h USING (seq) LEFT JOIN c ON c.chunk_id = h.chunk_id LEFT JOIN src s ON s.review_id = n.review_id AND s.file_path = n.file_path),
        w AS (SELECT *, CASE WHEN line_start IS NULL THEN left(diff_text, 1000)
            ELSE array_to_string(cl[greatest(0, greatest(0, line_start - c_start) - 5) + 1 : least(len(cl), greatest(0, line_start - c_start) + 6)], chr(10)) END AS a,
          CASE WHEN line_start IS NULL THEN left(source, 600) WHEN line_start >= 1 AND line_start <= len(sl) THEN
            CASE WHEN line_start > 4 THEN '  L' || (line_start - 3) || '…' ELSE '' END
            || array_to_string([ '  ' || lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || sl[i]
                 for i in range(greatest(0, line_start - 4) + 1, least(len(sl), coalesce(line_end, line_start) + 3) + 1)], chr(10)) END AS b FROM t)
        SELECT review_id, agent, file_path, coalesce(line_start, 0)::INT AS line_start, sha256(trim(coalesce(nullif(a, ''), b), ' ')) AS evidence_hash FROM w
        WHERE trim(coalesce(nullif(a, ''), b), ' ') <> ''""",
    "plain_evidence": f"""WITH {F_ONE}, l AS (SELECT review_id, agent, seq, {_LINES.format("evidence")} AS ls FROM f),
        x AS (SELECT review_id, agent, seq, unnest(range(0, len(ls)))::INT AS pos, unnest(ls) AS line FROM l)
        SELECT review_id, agent, seq, pos, {_PLAIN.format(_STRIP.format("line"))} AS line FROM x""",
    "review_texts": f"""WITH {F_ONE}, v AS ({_verdict(_ALL)}), n AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {WEIGHT} DESC, {PRIORITY}, agent, seq) AS position
          FROM f WHERE severity IS NULL OR severity <> 'info' QUALIFY position <= 100),
        l AS (SELECT review_id, string_agg(position || '. [' || upper(coalesce(severity, '')) || '] '
            || array_to_string(list_transform(string_split(replace(coalesce(category, ''), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ': ' || coalesce(title, '')
            || CASE WHEN file_path <> '' THEN ' (' || file_path || coalesce(':' || line_start, '') || ')' ELSE '' END, chr(10) ORDER BY position) AS lines FROM n GROUP BY review_id),
        t AS (SELECT review_id, rtrim('Recommendation: ' || recommendation || chr(10) || 'Severity: ' || overall_severity || chr(10) || 'Findings: ' || n_findings || chr(10) || coalesce(lines, ''), ' ') AS text
          FROM v LEFT JOIN l USING (review_id))
        SELECT review_id, CAST(length(text) AS INT) AS n_chars, sha256(text) AS text_hash FROM t""",
    "scanner_parsed": f"""WITH {F_ONE}, t AS (SELECT *, review_id || '#' || agent || '#' || seq AS id, CASE seq % 3 WHEN 0 THEN 'bandit' WHEN 1 THEN 'semgrep' ELSE 'gitleaks' END AS tool,
          CASE WHEN seq % 2 = 0 THEN 'B101' WHEN seq % 5 = 0 THEN 'B105' ELSE 'B602' END AS rule, line_start || ' x = ' || chr(39) || category || chr(39) AS code, {KEY} AS key FROM f),
        k AS (SELECT *, coalesce(starts_with(key, 'tests/') OR starts_with(key, 'test/') OR starts_with(regexp_extract(key, '([^/]*)$', 1), 'test_') OR ends_with(key, '_test.py') OR regexp_extract(key, '([^/]*)$', 1) = 'conftest.py', false) AS in_test,
          CASE WHEN code IS NOT NULL AND NOT contains(category, chr(34)) THEN category END AS literal FROM t)
        SELECT id, tool, '[bandit] ' || rule || ': ' || left(coalesce(title, ''), 200) AS title, CASE WHEN upper(severity) = 'LOW' THEN 'low' WHEN upper(severity) = 'HIGH' THEN 'high' ELSE 'medium' END AS severity,
          coalesce(title, '') AS description, file_path, line_start, NULL::INT AS line_end, CAST(length(coalesce(code, '')) AS INT) AS n_evidence, 0.9::DOUBLE AS confidence
        FROM k WHERE tool = 'bandit' AND NOT (rule <> 'B602' AND in_test) AND NOT (rule = 'B105' AND literal IS NOT NULL AND coalesce({_ENTROPY.format("literal")} < {MIN_ENTROPY} OR lower(literal) IN ({_PLACEHOLDERS}), false))
        UNION ALL SELECT id, tool, '[semgrep] ' || coalesce(category, ''), CASE severity WHEN 'high' THEN 'high' WHEN 'info' THEN 'info' ELSE 'medium' END, coalesce(title, ''), file_path, line_start, line_end, 0, 0.7 FROM k WHERE tool = 'semgrep'
        UNION ALL SELECT id, tool, '[gitleaks] ' || coalesce(CASE WHEN seq % 2 = 0 THEN category END, 'secret') || ': potential secret detected', 'critical', 'Potential secret or credential in code.', file_path, line_start, NULL,
          CASE WHEN coalesce(title, '') = '' THEN 0 ELSE least(length(title), 100) + 3 END, 0.9 FROM k WHERE tool = 'gitleaks'""",
    "last_reports": f"WITH {F_ONE} SELECT review_id, agent, max(seq) AS seq, arg_max(title, seq) AS title FROM f WHERE title IS NOT NULL GROUP BY ALL",
    "first_errors": f"WITH {F_ONE} SELECT review_id, title AS error, min(seq) AS seq FROM f GROUP BY ALL",
    "first_categories": f"""WITH {F_ONE}, o AS (SELECT review_id, category, min((agent, seq)) AS f FROM f WHERE category <> '' GROUP BY ALL)
        SELECT review_id, category, CAST(row_number() OVER (PARTITION BY review_id ORDER BY f, category) AS INT) AS position FROM o QUALIFY position <= 3""",
    "parsed_findings": f"""WITH {F_ONE}, v AS (SELECT agent, coalesce(confidence, 0.7) AS c,
          severity IS NULL OR lower(severity) NOT IN ('critical', 'high', 'medium', 'low', 'info') OR title IS NULL
          OR coalesce(isnan(confidence) OR confidence < 0 OR confidence > 1, false) AS malformed FROM f)
        SELECT agent, malformed, count(*) AS n_items, round(sum(CASE WHEN NOT malformed THEN c END), 4) AS confidence FROM v GROUP BY ALL""",
}
