"""Diffs: sections of files, hunks, added lines, chunks by symbol, chunks that adjoin.

A diff is one row, and sections and hunks are cut out of it by array expressions, so parsing a
history is a scan without a shuffle. Only numbering the added lines runs a window over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .symbols import enclosing_symbols

# Fixed value: the header of a hunk, with one old range, or two in a merge, and the start of the new one.
HUNK_HEADER = r"^@@@?(?: -[0-9]+(?:,[0-9]+)?)+ \+([0-9]+)(?:,[0-9]+)? @@"
#: Lines between two chunks of one symbol that still adjoin.
ADJOINING_LINES = 5
#: Characters above which a file's diff is large.
LARGE_DIFF = 24_000


def header_path(line: Column) -> Column:
    """New path of a `diff --git` line: what follows its first side of b, quoted or not, without the quotes; its last word without the side where there is none."""
    bare, quoted = F.instr(line, " b/"), F.instr(line, ' "b/')
    is_quoted = (quoted > 0) & ((bare == 0) | (quoted < bare))
    after = F.when(is_quoted, F.substr(line, quoted + F.lit(4))).when(bare > 0, F.substr(line, bare + F.lit(3)))
    # In quotes a backslash stands before quotes and backslashes.
    inner = F.when(is_quoted & F.endswith(after, F.lit('"')), F.substr(after, F.lit(1), F.length(after) - 1)).otherwise(after)
    plain = F.when(is_quoted, F.replace(F.replace(inner, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))).otherwise(inner)
    last = F.element_at(F.split(line, " "), -1)
    return F.coalesce(F.nullif(plain, F.lit("")), F.substring(last, 3, 1 << 30))


def _parts(lines: Column, is_head) -> Column:
    """The lines from each head to before the next, as an array of arrays; what precedes the first is dropped."""
    heads = F.filter(F.transform(lines, lambda x, i: F.when(is_head(x), i)), lambda i: i.isNotNull())
    return F.transform(heads, lambda h, j: F.slice(lines, h + 1, F.coalesce(F.get(heads, j + 1), F.size(lines)) - h))


def file_sections(diffs: DataFrame) -> DataFrame:
    """(review_id, seq, file_path, diff_text) of diffs (review_id, raw): one section a file, the last where a path comes twice.

    A `+++ ` line names the path only before the first hunk of its section. A diff is one row and
    is taken apart within it, so nothing is shuffled.
    """

    def section(lines: Column) -> Column:
        hunk = F.array_position(F.transform(lines, lambda x: x.startswith("@@")), True)
        before = F.when(hunk > 0, F.slice(lines, 1, hunk.cast("int") - 1)).otherwise(lines)
        named = F.transform(F.filter(before, lambda x: x.startswith("+++ ")), lambda x: F.regexp_extract(x, r'^\+\+\+ "?b/(.*?)"?$', 1))
        path = F.coalesce(F.nullif(F.get(F.filter(named, lambda x: x != ""), F.lit(0)), F.lit("")), header_path(F.get(lines, F.lit(0))))
        return F.struct(path.alias("file_path"), F.array_join(lines, "\n").alias("diff_text"))

    rows = diffs.where("trim(raw) <> ''").select("review_id", F.split("raw", "\n").alias("lines"))
    rows = rows.select("review_id", F.transform(_parts(F.col("lines"), lambda x: x.startswith("diff --git ")), section).alias("sections"))
    rows = rows.withColumn("paths", F.transform("sections", lambda s: s["file_path"]))
    each = rows.select("review_id", "paths", F.posexplode("sections").alias("pos", "s"))
    last = each.where(~F.array_contains(F.slice("paths", F.col("pos") + 2, F.size("paths")), F.col("s.file_path")))
    return last.select("review_id", (F.col("pos") + 1).alias("seq"), "s.file_path", "s.diff_text")


def new_lines(rows: Column) -> Column:
    """Number of lines of a hunk that stand in the new file."""
    return F.size(F.filter(rows, lambda x: ~(x.startswith("@@") | x.startswith("---") | x.startswith("+++") | x.startswith("-"))))


def hunks(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hunk, diff_text, line_start, line_end) of files (keys, diff_text); what precedes the first header is dropped."""
    lines = files.select(*keys, F.split("diff_text", "\n").alias("lines"))
    each = lines.select(*keys, F.posexplode(_parts(F.col("lines"), lambda x: F.regexp_like(x, F.lit(HUNK_HEADER)))).alias("pos", "lines"))
    start = F.regexp_extract(F.element_at("lines", 1), HUNK_HEADER, 1).cast("int")
    return each.select(
        *keys,
        (F.col("pos") + 1).alias("hunk"),
        F.array_join("lines", "\n").alias("diff_text"),
        start.alias("line_start"),
        (start + F.greatest(F.lit(0), new_lines(F.col("lines")) - 1)).cast("int").alias("line_end"),
    )


def added_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, text) of the lines that files (keys, diff_text) add; line_no counts in the new file."""
    rows = files.select(*keys, F.posexplode(F.split("diff_text", "\n")).alias("pos", "line"))
    along = Window.partitionBy(*keys).orderBy("pos")
    rows = rows.withColumn("hunk", F.sum(F.regexp_like("line", F.lit(HUNK_HEADER)).cast("int")).over(along)).where("hunk > 0")
    inside = Window.partitionBy(*keys, "hunk").orderBy("pos")
    start = F.first(F.regexp_extract("line", HUNK_HEADER, 1)).over(inside).try_cast("int")
    is_new = ~F.regexp_like("line", F.lit(HUNK_HEADER)) & ~F.col("line").startswith("-") & ~F.col("line").startswith("\\")
    numbered = rows.withColumn("line_no", (start + F.sum(is_new.cast("int")).over(inside) - 1).cast("int"))
    return numbered.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++ ")).select(
        *keys, "line_no", F.substring("line", 2, 1 << 30).alias("text")
    )


def merged_adjacent(chunks: DataFrame, gap: int = ADJOINING_LINES) -> DataFrame:
    """Successive chunks of one file and symbol with at most `gap` lines between them as one.

    chunks: review_id, chunk_id, file_path, symbol, symbol_kind, diff_text, line_start, line_end,
    full_source, in the order of (line_start, chunk_id). Islands of one file are found by window
    functions: a chunk begins an island unless the one before is of the same symbol and kind and
    the island's lines reach to within the gap.
    """
    along = Window.partitionBy("review_id", "file_path").orderBy("line_start", "chunk_id")
    same = F.lag("symbol").over(along).eqNullSafe(F.col("symbol")) & F.lag("symbol_kind").over(along).eqNullSafe(F.col("symbol_kind"))
    runs = chunks.withColumn("_run", F.sum((~F.coalesce(same & F.lag("chunk_id").over(along).isNotNull(), F.lit(False))).cast("int")).over(along))
    in_run = Window.partitionBy("review_id", "file_path", "_run").orderBy("line_start", "chunk_id")
    reach = F.max("line_end").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("line_start") > reach + gap, F.lit(True))
    islands = runs.withColumn("_island", F.sum(fresh.cast("int")).over(in_run))
    order = F.struct("line_start", "chunk_id")
    text = F.transform(F.array_sort(F.collect_list(F.struct("line_start", "chunk_id", "diff_text"))), lambda x: x["diff_text"])
    return islands.groupBy("review_id", "file_path", "_run", "_island").agg(
        F.min_by("chunk_id", order).alias("chunk_id"),
        F.first("symbol").alias("symbol"),
        F.first("symbol_kind").alias("symbol_kind"),
        F.array_join(text, "\n").alias("diff_text"),
        F.min("line_start").alias("line_start"),
        F.max("line_end").alias("line_end"),
        F.min_by(F.nullif("full_source", F.lit("")), F.when(F.col("full_source") != "", order)).alias("full_source"),
        F.count("*").alias("n_merged"),
    ).drop("_run", "_island")


def chunked(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks by symbol of files (review_id, file_path, diff_text): hunks, their innermost symbol, adjoining ones merged.

    symbols: review_id, rel_path, qualified_name, kind, line_start, line_end. A file without a
    hunk is one chunk of the module at lines 0 to 0.
    """
    found = hunks(files, ["review_id", "file_path"])
    placed = enclosing_symbols(found, symbols, ["review_id"], "file_path", ["review_id", "file_path", "hunk"])
    rows = placed.select(
        "review_id", "file_path", F.col("hunk").alias("chunk_id"), "symbol", "symbol_kind", "diff_text", "line_start", "line_end",
        F.lit("").alias("full_source"),
    )
    merged = merged_adjacent(rows)
    bare = files.join(found.select("review_id", "file_path").distinct(), ["review_id", "file_path"], "left_anti").where("trim(diff_text) <> ''")
    return merged.unionByName(
        bare.select(
            "review_id", "file_path", F.lit(0).alias("chunk_id"), F.lit("<module>").alias("symbol"), F.lit("module").alias("symbol_kind"), "diff_text",
            F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit(None).cast("string").alias("full_source"), F.lit(1).cast("long").alias("n_merged"),
        )
    )
