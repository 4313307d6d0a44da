"""The N highest-ranking items of every group.

A mergeable aggregation: each task holds, for every group it meets, the N best items with different
identifiers (a bounded heap that tells repeats itself), so that at most N items a group and task are
shuffled. The partial heaps of a group are merged after the shuffle: once more the best delivery of
an identifier, then the first N. A heap is kept as sorted rows of Arrow columns: items are taken up
in runs of BUFFER rows, and a run is cut to N a group by one sort. A task that meets more groups than
it can hold hands its heaps on and begins new ones, so its memory is bounded.

Defined results: repeated deliveries of an item (same group and identifier) count once, the
highest-ranking delivery holds; nulls in the group form a group of their own; a null or NaN score
ranks below every other, a null identifier below every other of the same score; groups with fewer
than N items come out whole; an empty table gives none; other columns are not read. Groups, scores
and identifiers are of atomic types.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a task takes up before it cuts its heaps.
BUFFER = 1 << 17


def _codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows with equal values in columns have equal, dense codes; nulls are a value."""
    out = np.zeros(len(table), np.int64)
    for c in columns:
        own = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        _, out = np.unique(out * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    return out


def cut(table: pa.Table, groups: list[str], scores: list[str], n: int) -> pa.Table:
    """The first n different identifiers (_id) of each group."""
    if not len(table):
        return table
    table = table.append_column("_g", pa.array(_codes(table, groups)))
    keys = [("_g", "ascending"), *((s, "descending") for s in scores), ("_id", "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
    _, first = np.unique(_codes(table, ["_g", "_id"]), return_index=True)
    first.sort()
    group = table["_g"].to_numpy()[first]
    begins = np.r_[True, group[1:] != group[:-1]]
    place = np.arange(len(group)) - np.maximum.accumulate(np.where(begins, np.arange(len(group)), 0))
    return table.drop_columns(["_g"]).take(pa.array(first[place < n]))


def _heaps(groups: list[str], scores: list[str], n: int, buffer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= buffer:
                heaps = cut(pa.Table.from_batches(held), groups, scores, n)
                if len(heaps) > buffer // 2:
                    yield from heaps.to_batches()
                    heaps = heaps.slice(0, 0)
                held, rows = heaps.to_batches(), len(heaps)
        if rows:
            yield from cut(pa.Table.from_batches(held), groups, scores, n).to_batches()

    return run


def heaps(items: DataFrame, group: list[str], score: list[Column], identifier: str, n: int, buffer: int = BUFFER) -> DataFrame:
    """(group as _g0.., _id, _s0..) of the n best items that each task has of each group."""
    scored = items.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(identifier).alias("_id"), *[s.alias(f"_s{i}") for i, s in enumerate(score)])
    comparable = {}
    for name, kind in scored.dtypes:
        if name.startswith("_s") and kind in ("double", "float"):
            comparable[name] = F.when(~F.isnan(name), F.col(name) + F.lit(0.0).cast(kind))
        elif name.startswith("_s") and kind == "boolean":
            comparable[name] = F.col(name).cast("int")
    scored = scored.withColumns(comparable)
    names = [c for c in scored.columns if c.startswith("_g")], [c for c in scored.columns if c.startswith("_s")]
    return scored.mapInArrow(_heaps(*names, n, buffer), scored.schema)


def top_n(items: DataFrame, group: list[str], score: list[Column], identifier: str, n: int) -> DataFrame:
    """(group, identifier, position 1..n) by score descending, then identifier ascending."""
    if n < 1:
        raise ValueError("n must be at least 1")
    partial = heaps(items, group, score, identifier, n)
    keys, scores = ([c for c in partial.columns if c.startswith(p)] for p in ("_g", "_s"))
    # One shuffle by group serves both steps of the merge.
    once = partial.repartition(*keys).groupBy(*keys, "_id").agg(F.max(F.struct(*scores)).alias("_score"))
    order = [F.col(f"_score.{s}").desc_nulls_last() for s in scores]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.col("_id").asc_nulls_last()))
    best = once.withColumn("position", rank).where(F.col("position") <= n)
    return best.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.col("_id").alias(identifier), F.col("position").cast("long").alias("position"))
