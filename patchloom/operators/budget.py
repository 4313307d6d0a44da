"""What fits a token or character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens, truncated
from ..session import materialise

MAX_TOKENS = 100_000
CONTEXT_CHARS, LEAST_TAIL = 16_000, 200
SOURCE_CHARS = 8_000
#: Characters of a context entry with no name, symbol or text.
LEAST_ENTRY = 28


def fitting_chunks(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(review_id, chunk_id, kept): which chunks of each review fit its limit.

    chunks: review_id, chunk_id, file_path, diff_text, repeats allowed; limits: review_id, max_tokens. A review
    within its limit keeps all. Otherwise the largest chunk of each file is seated in the order
    of files (by least chunk_id), if it fits, then the rest by size, skipping what does not fit.

    The second round needs no list of chunks: of the chunks of one cost the first n by chunk_id
    fit, so the fold runs over counts by cost. A chunk over the whole limit never fits and is left
    out of both rounds, so at most `max_tokens` distinct costs are folded for a review, however
    many chunks it has; the first round folds one cost a file.
    """
    sized = chunks.select("review_id", "chunk_id", "file_path", tokens(F.col("diff_text")).alias("cost"), F.length("diff_text").alias("size"))
    sized = sized.dropDuplicates(["review_id", "chunk_id"])
    sized = sized.join(limits.select("review_id", F.coalesce("max_tokens", F.lit(MAX_TOKENS)).cast("long").alias("budget")), "review_id", "left")
    # Narrow rows, read in several branches below; the texts are measured once.
    sized = materialise(sized.withColumn("budget", F.coalesce("budget", F.lit(MAX_TOKENS).cast("long"))), "sized")
    totals = sized.groupBy("review_id").agg(F.sum("cost").alias("total"))
    all_of = sized.join(totals, "review_id")
    within, over = all_of.where("total <= budget"), all_of.where("total > budget")
    # First round: the largest chunk a file, the first of equals, in the order of files.
    largest = over.groupBy("review_id", "file_path").agg(
        F.min("chunk_id").alias("file_order"), F.max("budget").alias("budget"),
        F.max_by(F.struct("chunk_id", "cost"), F.struct("size", -F.col("chunk_id"))).alias("x"),
    )
    seats = largest.where("x.cost <= budget").groupBy("review_id").agg(
        F.max("budget").alias("budget"),
        F.array_sort(F.collect_list(F.struct("file_order", F.col("x.chunk_id").alias("chunk_id"), F.col("x.cost").alias("cost")))).alias("seats"),
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def seat(acc: Column, s: Column) -> Column:
        fits = acc["used"] + s["cost"] <= F.col("budget")
        return F.when(fits, F.struct((acc["used"] + s["cost"]).alias("used"), F.concat(acc["kept"], F.array(s["chunk_id"])).alias("kept"))).otherwise(acc)

    first = seats.select("review_id", "budget", F.aggregate("seats", start, seat).alias("f"))
    seated = first.select("review_id", F.explode("f.kept").alias("chunk_id")).withColumn("kept", F.lit(True))
    # Second round: counts by size, largest first; equal sizes have equal cost.
    rest = over.join(seated, ["review_id", "chunk_id"], "left_anti").where("cost <= budget")
    counts = rest.groupBy("review_id", "cost").agg(F.count("*").alias("n"))
    by_cost = counts.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("cost")).alias("least"), "n"))).alias("costs"))
    left = over.select("review_id", "budget").distinct().join(first.select("review_id", F.col("f.used").alias("used")), "review_id", "left")
    plan = left.join(by_cost, "review_id").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    begin = F.struct(F.col("used").alias("used"), F.array().cast("array<struct<cost:bigint,fits:bigint>>").alias("fits"))

    def take(acc: Column, c: Column) -> Column:
        cost = -c["least"]
        fits = F.when(cost == 0, c["n"]).otherwise(F.least(c["n"], F.try_divide(F.col("budget") - acc["used"], cost).cast("bigint")))
        entry = F.struct(cost.cast("bigint").alias("cost"), fits.cast("bigint").alias("fits"))
        return F.struct((acc["used"] + cost * fits).cast("bigint").alias("used"), F.concat(acc["fits"], F.array(entry)).alias("fits"))

    taken = plan.select("review_id", F.explode(F.aggregate("costs", begin, take)["fits"]).alias("t")).select("review_id", "t.cost", "t.fits")
    order = Window.partitionBy("review_id", "cost").orderBy(F.col("size").desc(), "chunk_id")
    ranked = rest.withColumn("place", F.row_number().over(order)).join(taken, ["review_id", "cost"])
    filled = ranked.where("place <= fits").select("review_id", "chunk_id", F.lit(True).alias("kept"))
    chosen = seated.unionByName(filled).unionByName(within.select("review_id", "chunk_id", F.lit(True).alias("kept"))).distinct()
    every = chunks.select("review_id", "chunk_id").distinct()
    return every.join(chosen, ["review_id", "chunk_id"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def pruned_list(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """(review_id, chunk_id, pruned): the places of the chunks that did not fit."""
    place = F.concat("file_path", F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    places = chunks.select("review_id", "chunk_id", place.alias("pruned")).distinct()
    return places.join(kept.where("not kept").drop("kept"), ["review_id", "chunk_id"])


def context_prefix(chunks: DataFrame, most: int = CONTEXT_CHARS, least_tail: int = LEAST_TAIL) -> DataFrame:
    """(review_id, chunk_id, entry, whole): the entries of a prompt until the next one exceeds the budget, and then its head if enough is left.

    Lengths run first over narrow rows, and only over the first ones of a review: an entry has
    LEAST_ENTRY characters at least, so later ones cannot be within the budget. The rank filter
    works before the shuffle too. Only the entries that stay carry their text.
    """
    head = F.concat(
        F.lit("### "), F.col("file_path"), F.lit(" :: "), F.coalesce("symbol_kind", F.lit("")), F.lit(" "), F.coalesce("symbol", F.lit("")), F.lit(" (L"),
        F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(")\n```diff\n"),
    )
    entry = F.concat(head, F.coalesce("diff_text", F.lit("")), F.lit("\n```\n"))
    size = (F.length(head) + F.coalesce(F.length("diff_text"), F.lit(0)) + 5).cast("long")
    narrow = chunks.select("review_id", "chunk_id", size.alias("size"))
    along = Window.partitionBy("review_id").orderBy("chunk_id")
    narrow = narrow.withColumn("_rank", F.row_number().over(along)).where(F.col("_rank") <= most // LEAST_ENTRY + 2).drop("_rank")
    running = narrow.withColumn("until", F.sum("size").over(along)).withColumn("before", F.col("until") - F.col("size"))
    # Sizes are positive, so the entries that fit are a prefix, and the first that does not is the one that begins within the budget.
    kept = running.where((F.col("until") <= most) | ((F.col("before") <= most) & (most - F.col("before") > least_tail)))
    cut = F.when(F.col("until") <= most, F.col("entry")).otherwise(F.concat(F.left("entry", (most - F.col("before")).cast("int")), F.lit("\n... [truncated]\n")))
    whole = chunks.select("review_id", "chunk_id", entry.alias("entry"))
    return whole.join(kept.select("review_id", "chunk_id", "until", "before"), ["review_id", "chunk_id"]).select("review_id", "chunk_id", cut.alias("entry"), (F.col("until") <= most).alias("whole"))


#: Characters of dependents that must be left for any to be told, then for each further one; dependents, characters of each, and what counts for its frame.
LEAST_DEPENDENTS, LEAST_DEPENDENT = 1_000, 200
DEPENDENTS, DEPENDENT_CHARS, FRAME_CHARS = 10, 800, 200
DEPENDENTS_TITLE = "\n## Dependent files (affected but not changed):\n"


def review_contexts(chunks: DataFrame, dependents: DataFrame, sources: DataFrame, full_diffs: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """(review_id, context): the entries of a review's chunks, then heads of its dependents in what room is left; without either the head of its diff.

    dependents: review_id, position, file_path; sources: review_id, file_path, source; full_diffs: review_id, full_diff.
    A context is bounded, and so are the rows that one is made of.
    """
    entries = context_prefix(chunks, most)
    told = entries.groupBy("review_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "entry"))), lambda x: x["entry"]).alias("entries"),
        F.sum(F.when(F.col("whole"), F.length("entry")).otherwise(0)).alias("used"),
    )
    first = dependents.where(F.col("position") <= DEPENDENTS).select("review_id", "position", "file_path")
    reviews = full_diffs.select("review_id").unionByName(told.select("review_id")).unionByName(first.select("review_id")).distinct()
    room = reviews.join(told, "review_id", "left").select("review_id", "entries", (most - F.coalesce("used", F.lit(0))).alias("room"))
    titled = first.groupBy("review_id").agg(F.lit(True).alias("titled"))
    snippet = F.left("source", F.lit(DEPENDENT_CHARS))
    heads = first.join(sources.where("source <> ''").select("review_id", "file_path", snippet.alias("snippet")), ["review_id", "file_path"])
    along = Window.partitionBy("review_id").orderBy("position")
    cost = F.length("snippet") + FRAME_CHARS
    heads = heads.withColumn("before", F.sum(cost).over(along) - cost).join(room.select("review_id", "room"), "review_id")
    heads = heads.where((F.col("before") == 0) | (F.col("room") - F.col("before") >= LEAST_DEPENDENT))
    part = F.concat(F.lit("### "), F.col("file_path"), F.lit("\n```python\n"), F.col("snippet"), F.lit("\n```\n"))
    parts = heads.groupBy("review_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("part")))), lambda x: x["part"]).alias("parts"))
    none = F.array().cast("array<string>")
    more = F.when(F.col("titled") & (F.col("room") > LEAST_DEPENDENTS), F.concat(F.array(F.lit(DEPENDENTS_TITLE)), F.coalesce("parts", none))).otherwise(none)
    whole = F.concat(F.coalesce("entries", none), F.coalesce(more, none))
    joined = room.join(titled, "review_id", "left").join(parts, "review_id", "left").join(full_diffs.select("review_id", "full_diff"), "review_id", "left")
    text = F.when(F.size(whole) > 0, F.array_join(whole, "\n")).otherwise(F.coalesce(F.left("full_diff", F.lit(most)), F.lit("")))
    return joined.select("review_id", text.alias("context"))


def bounded_sources(sources: DataFrame, changed: DataFrame, most: int = SOURCE_CHARS) -> DataFrame:
    """sources (review_id, file_path, source) cut to size: of changed files plainly, of others with a note."""
    own = changed.select("review_id", "file_path").distinct().withColumn("_changed", F.lit(True))
    cut = F.when(F.col("_changed"), F.left("source", F.lit(most))).otherwise(truncated(F.col("source"), most))
    return sources.join(own, ["review_id", "file_path"], "left").select("review_id", "file_path", cut.alias("source"))


def token_totals(chunks: DataFrame) -> DataFrame:
    """(review_id, n_tokens, n_chunks), repeated chunks once; only their sizes are shuffled."""
    sized = chunks.select("review_id", "chunk_id", tokens(F.col("diff_text")).alias("cost")).dropDuplicates(["review_id", "chunk_id"])
    return sized.groupBy("review_id").agg(F.sum("cost").alias("n_tokens"), F.count("*").alias("n_chunks"))


def full_diff(files: DataFrame, order: str) -> DataFrame:
    """(review_id, full_diff): the diffs of a review's files, one after the other. One review's text is one value."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "diff_text")))
    return files.groupBy("review_id").agg(F.array_join(F.transform(rows, lambda r: r["diff_text"]), "\n").alias("full_diff"))
