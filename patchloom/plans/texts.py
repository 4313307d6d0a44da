"""Queries over texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.models import answered, stub_answer, usage
from ..operators.reports import is_json
from ..sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as delivered; what is derived from a text is what repeats are told by, so texts are not shuffled."""
    return table(spark, sf_dir, "documents")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("content_hash")).distinct()


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "kind", text.tokens(F.col("text")).alias("n")).dropDuplicates(["doc_id"])
    return rows.groupBy("kind").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_documents"))


def used_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by source: reported for the texts whose n_chars is known, else estimated."""
    rows = documents(spark, sf_dir).dropDuplicates(["doc_id"]).select(
        F.col("source").alias("review_id"), F.col("kind").alias("agent"), F.col("text").alias("answer"), F.col("n_chars").alias("input_tokens"),
        F.when(F.col("n_chars").isNotNull(), 10).alias("output_tokens"),
    )
    return usage(rows).select(F.col("review_id").alias("source"), F.col("agent").alias("kind"), "tokens")


def markdown_to_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.plain_text(F.col("text")), 256).alias("plain_hash")).distinct()


def without_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```text\n"), F.col("text"), F.lit("\n```"))
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.without_fence(fenced), 256).alias("body_hash")).distinct()


def truncated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", text.truncated(F.col("text"), 8000).alias("t"))
    return rows.select("doc_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("hash")).distinct()


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).where("text is not null").select("doc_id", F.size(text.lines(F.col("text"))).alias("n_lines")).distinct()


def kind_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with a known language, by kind, as a ratio and for display."""
    rows = documents(spark, sf_dir).select("doc_id", "kind", "lang").dropDuplicates(["doc_id"]).groupBy("kind").agg(F.count("lang").alias("known"), F.count("*").alias("n"))
    share = text.ratio(F.col("known"), F.col("n"))
    return rows.select(text.title_case(F.col("kind")).alias("kind"), F.round(share, 6).alias("share"), text.percentage(share).alias("shown"))


def content_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of answers that come as lists of parts, made of the text, source and kind of documents."""
    part = lambda name, c: F.to_json(F.struct(F.col(c).alias(name)))
    # A lone string as JSON is a list of it without the brackets.
    quoted = F.coalesce(F.regexp_replace(F.to_json(F.array("source")), r"^\[|\]$", ""), F.lit("null"))
    listed = F.concat(F.lit("["), part("text", "text"), F.lit(","), quoted, F.lit(","), part("content", "kind"), F.lit(',{"other":1}]'))
    rows = documents(spark, sf_dir).select("doc_id", F.try_parse_json(listed).alias("content"))
    return rows.select("doc_id", F.sha2(text.content_text("content"), 256).alias("text_hash")).distinct()


def parseable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether documents, two of three made JSON strings or fenced ones, parse."""
    inner = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    answer = F.when(F.col("doc_id") % 3 == 0, inner).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), inner, F.lit("\n```\n"))).otherwise(F.concat(F.lit("{"), F.coalesce("text", F.lit(""))))
    return documents(spark, sf_dir).select("doc_id", is_json(answer).alias("parses")).distinct()


def stub_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the deterministic stand-in model to prompts made of documents."""
    prompts = {0: "Summarize this: ", 1: "List the findings: ", 2: "Give overall_severity: ", 3: ""}
    head = F.lit("")
    for n, words in prompts.items():
        head = F.when(F.col("doc_id") % 4 == n, words).otherwise(head)
    rows = documents(spark, sf_dir).select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("prompt"))
    return rows.select("doc_id", stub_answer(F.col("prompt")).alias("answer")).distinct()


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers through the partition operator; texts of 5 000 characters and more are refused by the client."""

    def make_client():
        def client(prompt: str) -> str:
            if len(prompt) >= 5000:
                raise ValueError("too long")
            return str(len(prompt))

        return client

    rows = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    return answered(rows, make_client).select("doc_id", "answer", "error").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, document_tokens, used_tokens, markdown_to_plain, without_fences, truncated_texts, line_counts, kind_shares, content_texts, parseable_answers, stub_model, model_calls,
    )
}

_D = "d AS (SELECT DISTINCT ON (doc_id) * FROM documents)"
_PLAIN = f"regexp_replace(text, '(?s)```.*?```', '{text.CODE_LEFT_OUT}', 'g')"
for _construct, _kept in text.INLINE:
    _PLAIN = f"regexp_replace({_PLAIN}, '{_construct.replace('(?md)', '(?m)')}', '{_kept.replace('$1', chr(92) + '1')}', 'g')"

SQL = {
    "content_hash": f"WITH {_D} SELECT doc_id, sha256(text) AS content_hash FROM d",
    "document_tokens": f"WITH {_D} SELECT kind, CAST(sum(coalesce(length(text), 0) // 4) AS BIGINT) AS n_tokens, count(*) AS n_documents FROM d GROUP BY kind",
    "used_tokens": f"WITH {_D} SELECT source, kind, CAST(sum(CASE WHEN n_chars IS NOT NULL THEN n_chars + 10 ELSE greatest(1, coalesce(length(text), 0) // 4) END) AS BIGINT) AS tokens FROM d GROUP BY ALL",
    "markdown_to_plain": f"WITH {_D} SELECT doc_id, sha256(trim({_PLAIN}, '{text.WHITE_SPACE}')) AS plain_hash FROM d",
    "without_fences": f"WITH {_D} SELECT doc_id, sha256(text) AS body_hash FROM d",
    "truncated_texts": f"""WITH {_D}, t AS (SELECT doc_id, CASE WHEN length(text) > 8000 THEN left(text, 8000) || chr(10) || '... [truncated]' ELSE text END AS t FROM d)
        SELECT doc_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS hash FROM t""",
    "line_counts": rf"""WITH {_D} SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n')) END::INT AS n_lines FROM d WHERE text IS NOT NULL""",
    "kind_shares": f"""WITH {_D}, s AS (SELECT kind, count(lang) / count(*) AS share FROM d GROUP BY kind)
        SELECT array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS kind, round(share, 6) AS share, CAST(round_even(share * 100, 0) AS INT) || '%' AS shown FROM s""",
    "content_texts": f"WITH {_D} SELECT doc_id, sha256(concat_ws(chr(10), nullif(text, ''), source, nullif(kind, ''))) AS text_hash FROM d",
    "parseable_answers": f"WITH {_D} SELECT doc_id, doc_id % 3 <> 2 AS parses FROM d",
    "stub_model": f"""WITH {_D}, p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Summarize this: ' WHEN 1 THEN 'List the findings: ' WHEN 2 THEN 'Give overall_severity: ' ELSE '' END || coalesce(text, '') AS p FROM d)
        SELECT doc_id, CASE WHEN contains(p, 'overall_severity') THEN '{{"overall_severity": "info", "recommendation": "approve", "summary": "stub"}}'
          WHEN contains(p, 'findings') THEN '[{{"category": "code_quality", "severity": "low", "title": "Stub finding", "confidence": 0.5}}]'
          WHEN contains(p, 'Summarize') THEN 'Summary: ' || left(p, 80) ELSE '[]' END AS answer FROM p""",
    "model_calls": f"""WITH {_D} SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 5000 THEN CAST(length(coalesce(text, '')) AS VARCHAR) END AS answer,
        CASE WHEN length(coalesce(text, '')) >= 5000 THEN 'ValueError: too long' END AS error FROM d""",
}
