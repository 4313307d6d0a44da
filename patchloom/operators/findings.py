"""Findings of many detectors: one row each, merged, capped, given evidence and checked.

A findings table has review_id, agent, seq, category, severity, title, description, file_path,
line_start, line_end, evidence, recommendation and confidence. List order is seq everywhere.
Rows of one key are reduced by mergeable aggregates, so a key of any size is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import path_key
from ..functions.ranks import agent_priority, severity_weight
from ..functions.text import is_blank, lines, plain_line, stripped

CAP_PER_AGENT = 100
NOTABLE_SHOWN = 8
TABLE_ROWS = 100

LOCATED = "file_path <> '' and line_start is not null"


def distinct_findings(findings: DataFrame) -> DataFrame:
    """Repeated deliveries of a finding as one."""
    return findings.dropDuplicates(["review_id", "agent", "seq"])


def _best(findings: DataFrame, scope: list[str], pick) -> DataFrame:
    """The row that pick (an aggregate of the row) chooses for each scope, category, path and line; a row without a place is alone with its key.

    One aggregate for both, so findings are read and shuffled once.
    """
    located = F.coalesce(F.expr(LOCATED), F.lit(False))
    place = F.when(located, F.struct("category", path_key(F.col("file_path")).alias("path"), "line_start"))
    alone = F.when(~located, F.struct("agent", "seq"))
    row = F.struct(*[F.col(c) for c in findings.columns])
    picked = findings.groupBy(*[F.col(c).alias(f"_{c}") for c in scope], place.alias("_place"), alone.alias("_alone")).agg(pick(row).alias("_row"))
    return picked.select("_row.*")


def best_per_place(findings: DataFrame) -> DataFrame:
    """Of the findings of a report on one category, path and line the gravest, then surest, then latest; unlocated ones stay."""
    order = F.struct(severity_weight(F.col("severity")), F.col("confidence"), F.col("seq"))
    return _best(findings, ["review_id", "agent"], lambda row: F.max_by(row, order))


def first_by_agent(findings: DataFrame) -> DataFrame:
    """Of the findings of all agents on one category, path and line the first by agent priority, seq and name; unlocated ones stay."""
    order = F.struct(agent_priority(F.col("agent")), F.col("seq"), F.col("agent"))
    return _best(findings, ["review_id"], lambda row: F.min_by(row, order))


def throttled(findings: DataFrame, cap: int = CAP_PER_AGENT) -> DataFrame:
    """The gravest `cap` findings of each report. The rank filter is applied before the shuffle as well as after it."""
    order = Window.partitionBy("review_id", "agent").orderBy(
        severity_weight(F.col("severity")).desc(), F.col("confidence").desc_nulls_last(), F.col("seq")
    )
    return findings.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")


def suppressed(findings: DataFrame, cap: int = CAP_PER_AGENT) -> DataFrame:
    """(review_id, agent, n_suppressed, note) of the reports over the cap."""
    counts = findings.groupBy("review_id", "agent").agg(F.count("*").alias("n")).where(F.col("n") > cap)
    n = F.col("n") - cap
    note = F.concat(n.cast("string"), F.lit(f" low-priority finding(s) suppressed (cap {cap})."))
    return counts.select("review_id", "agent", n.alias("n_suppressed"), note.alias("note"))


def notable(findings: DataFrame) -> DataFrame:
    return findings.where("severity is null or severity <> 'info'")


def with_evidence_only(findings: DataFrame, where: Column | None = None) -> DataFrame:
    """Without the findings (of those meeting `where`) whose evidence is blank."""
    blank = is_blank(F.col("evidence"))
    return findings.where(~(blank & where) if where is not None else ~blank)


def notable_summary(findings: DataFrame, shown: int = NOTABLE_SHOWN) -> DataFrame:
    """(review_id, agent, summary): `title [severity] at path:line` of the gravest notable findings, and how many more there are."""
    keep = notable(findings)
    order = Window.partitionBy("review_id", "agent").orderBy(
        severity_weight(F.col("severity")).desc(), F.coalesce("file_path", F.lit("")), F.coalesce("line_start", F.lit(0)), F.col("seq")
    )
    top = keep.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= shown)
    # A place without a line reads `None`.
    place = F.concat(F.lit(" at "), F.col("file_path"), F.lit(":"), F.coalesce(F.col("line_start").cast("string"), F.lit("None")))
    told = F.concat(F.coalesce("title", F.lit("")), F.lit(" ["), F.coalesce("severity", F.lit("")), F.lit("]"), F.when(F.col("file_path") != "", place).otherwise(""))
    text = top.groupBy("review_id", "agent").agg(F.array_sort(F.collect_list(F.struct("_rank", told.alias("told")))).alias("rows"))
    counts = keep.groupBy("review_id", "agent").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("; +"), (F.col("n") - shown).cast("string"), F.lit(" more finding(s)"))).otherwise("")
    return text.join(counts, ["review_id", "agent"]).select(
        "review_id", "agent", F.concat(F.array_join(F.transform("rows", lambda r: r["told"]), "; "), more).alias("summary")
    )


def findings_table(findings: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """The rows a report shows of each review: notable ones, gravest first."""
    order = Window.partitionBy("review_id").orderBy(severity_weight(F.col("severity")).desc(), agent_priority(F.col("agent")), F.col("agent"), F.col("seq"))
    return notable(findings).withColumn("position", F.row_number().over(order)).where(F.col("position") <= rows)


def by_severity(findings: DataFrame) -> DataFrame:
    """(review_id, severity, n_findings)."""
    return findings.groupBy("review_id", "severity").agg(F.count("*").alias("n_findings"))


def without_titles(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings whose title no finding of `known` on the review has."""
    return findings.join(known.select("review_id", "title").distinct(), ["review_id", "title"], "left_anti").select(findings.columns)


def concatenated(*lists: DataFrame) -> DataFrame:
    """Finding lists one after the other: seq (a long) orders by list, then by the seq in it, without a shuffle."""
    out = None
    for n, findings in enumerate(lists):
        part = findings.withColumn("seq", F.col("seq").cast("long") + (n << 40))
        out = part if out is None else out.unionByName(part)
    return out


def _window(text: Column, line: Column, first: Column) -> Column:
    """Up to five lines on either side of a line, of a diff that begins at line `first`."""
    rows = lines(text)
    offset = F.greatest(F.lit(0), line - first)
    low = F.greatest(F.lit(0), offset - 5)
    high = F.least(F.size(rows), offset + 6)
    return F.array_join(F.slice(rows, low + 1, F.greatest(F.lit(0), high - low)), "\n")


def _numbered(text: Column, line: Column, last: Column) -> Column:
    """The lines three before `line` to three after `last`, numbered; null outside the text."""
    rows = lines(text)
    low = F.greatest(F.lit(0), line - 4)
    high = F.least(F.size(rows), F.coalesce(last, line) + 3)
    picked = F.slice(rows, low + 1, F.greatest(F.lit(0), high - low))
    numbered = F.transform(picked, lambda x, i: F.concat(F.lit("  "), F.lpad((i + low + 1).cast("string"), 4, " "), F.lit(" | "), x))
    mark = F.when(low > 0, F.concat(F.lit("  L"), (low + 1).cast("string"), F.lit("…"))).otherwise("")
    return F.when((line >= 1) & (line <= F.size(rows)), F.concat(mark, F.array_join(numbered, "\n")))


def with_evidence(findings: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Blank evidence filled from the diff, or else the source, of the place a finding names.

    chunks: review_id, chunk_id, file_path, diff_text, line_start, line_end; sources: review_id,
    file_path, source, one row a file. The first chunk by chunk_id counts. Places that do not
    exist leave the evidence blank. Only the findings that need it are joined.
    """
    blank = is_blank(F.col("evidence")) & (F.col("file_path") != "")
    needy = findings.where(blank).withColumn("_id", F.struct("review_id", "agent", "seq"))
    c = chunks.select(
        F.col("review_id").alias("c_review"), F.col("file_path").alias("c_path"), "chunk_id", "diff_text",
        F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end"),
    )
    covers = F.col("line_start").isNull() | F.col("line_start").between(F.col("c_start"), F.col("c_end"))
    on = (F.col("review_id") == F.col("c_review")) & (F.col("file_path") == F.col("c_path")) & covers
    snippet = F.when(F.col("line_start").isNull(), F.left("diff_text", F.lit(1000))).otherwise(_window(F.col("diff_text"), F.col("line_start"), F.col("c_start")))
    # The choice is made over narrow rows; only the chosen chunk's text is cut.
    chosen = needy.select("review_id", "file_path", "line_start", "_id").join(c.drop("diff_text"), on).groupBy("_id").agg(F.min("chunk_id").alias("chunk_id"))
    cut = (
        chosen.join(c.select("chunk_id", "diff_text", "c_start").dropDuplicates(["chunk_id"]), "chunk_id")
        .join(needy.select("_id", "line_start"), "_id")
        .select("_id", snippet.alias("from_chunk"))
    )
    s = sources.select("review_id", "file_path", "source")
    whole = F.when(F.col("line_start").isNull(), F.left("source", F.lit(600))).otherwise(_numbered(F.col("source"), F.col("line_start"), F.col("line_end")))
    filled = needy.join(cut, "_id", "left").join(s, ["review_id", "file_path"], "left")
    text = F.coalesce(F.when(F.col("from_chunk") != "", F.col("from_chunk")), whole)
    filled = filled.withColumn("evidence", F.coalesce(F.trim(text), F.col("evidence")))
    return findings.where(~F.coalesce(blank, F.lit(False))).unionByName(filled.select(findings.columns))


def grounded(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """(review_id, agent, seq, grounded): whether a line of the evidence stands verbatim in a text of the review.

    texts: review_id, text and file_path, which is null for texts that hold for the whole review.
    Where a line stands in a text, its longest word with a neighbour on both sides is a word of the
    text. So lines and texts meet on (review, word), over narrow rows, and only then is the text
    joined to look for the line; lines without such a word meet the texts of their review.
    """
    asked = findings.select("review_id", "agent", "seq", "file_path", F.explode(lines(F.col("evidence"))).alias("line"))
    asked = asked.where("file_path <> ''").withColumn("line", plain_line(stripped(F.col("line")))).where("line <> ''").distinct()
    inner = F.regexp_extract_all("line", F.lit(r"(?<=\W)\w+(?=\W)"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1)
    asked = asked.withColumn("word", F.when(F.size(inner) > 0, longest["w"]))
    held = texts.where("text <> ''").select("review_id", F.col("file_path").alias("t_path"), "text", F.xxhash64("review_id", "file_path", "text").alias("t_id"))
    words = held.select("review_id", "t_path", "t_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    there = F.col("t_path").isNull() | (F.col("t_path") == F.col("file_path"))
    keyed = asked.where("word is not null").join(words, ["review_id", "word"]).where(there)
    short = asked.where("word is null").join(held.drop("text"), "review_id").where(there)
    columns = ["review_id", "agent", "seq", "line", "t_id"]
    candidates = keyed.select(columns).unionByName(short.select(columns))
    met = candidates.join(held.select("review_id", "t_id", "text"), ["review_id", "t_id"]).where(F.contains("text", "line"))
    hits = met.select("review_id", "agent", "seq").distinct().withColumn("grounded", F.lit(True))
    every = findings.select("review_id", "agent", "seq").distinct()
    return every.join(hits, ["review_id", "agent", "seq"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
