"""References to records that do not exist.

Children and parents are put in one long table of (parent table, key, parent flag), grouped by
parent table and key, and the groups without a parent flag are the missing records. A key that
a third of all rows refer to collapses in the map-side combine, so it is one row in the shuffle.

The rows that refer to a missing key come from a semi join with those groups. The HOT_KEYS keys with
the most references, and no others, are sent to the tasks first: a child whose hot key has a parent
ends there without a shuffle, and one whose hot key is missing is spread over a number of salts that
grows with the key. Repeats are told among the orphans only, and the counts of groups are summed by
period.

Defined results: a key with a null part equals nothing, so a child with a null key part is an
orphan and a parent with one is ignored; repeated deliveries of a row count once; empty tables
give empty results (with no parents every child is an orphan); other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: References that make a key hot, and rows of a salt of it.
HOT_REFERENCES = 10_000
#: Hot keys that are sent to every task, those with the most references; any other has less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1_000


@dataclass
class Reference:
    """child rows (row_id, key parts, all else ignored) that must exist in parent; carry are further columns (of `child`) for orphans."""

    child_table: str
    child: DataFrame
    row_id: str
    child_key: list[Column]
    parent_table: str
    parent: DataFrame
    parent_key: list[Column]
    carry: list[Column] = field(default_factory=list)


def key_of(parts: list[Column]) -> Column:
    """Half of the SHA-256 of the length-prefixed parts (16 bytes instead of four strings in every shuffle); null if any part is."""
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.unhex(F.substring(F.sha2(F.concat(*sized), 256), 1, 32))


def _named(names: list[str], code: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(code).cast("int") + 1)


def _parent_codes(references: list[Reference]) -> dict[str, int]:
    return {name: i for i, name in enumerate(dict.fromkeys(r.parent_table for r in references))}


def _children(references: list[Reference]) -> DataFrame:
    """(child, row_id, parent, key, carried): tables as small numbers."""
    codes, out = _parent_codes(references), None
    for i, r in enumerate(references):
        rows = r.child.select(
            F.lit(i).cast("tinyint").alias("child"), F.col(r.row_id).cast("long").alias("row_id"),
            F.lit(codes[r.parent_table]).cast("tinyint").alias("parent"), key_of(r.child_key).alias("key"), *r.carry,
        )
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def _groups(references: list[Reference]) -> DataFrame:
    """(parent, key, has_parent, n_references) of every key."""
    codes = _parent_codes(references)
    long = _children(references).where("key is not null").select("parent", "key", F.lit(0).alias("is_parent"))
    for r in references:
        parents = r.parent.select(F.lit(codes[r.parent_table]).cast("tinyint").alias("parent"), key_of(r.parent_key).alias("key"), F.lit(1).alias("is_parent"))
        long = long.unionByName(parents.where("key is not null"))
    return long.groupBy("parent", "key").agg(F.max("is_parent").alias("has_parent"), F.sum(1 - F.col("is_parent")).alias("n_references"))


def missing_keys(references: list[Reference]) -> DataFrame:
    """(parent_table, key, n_references) of the keys that are referred to and have no parent row; repeats are counted."""
    missing = _groups(references).where("has_parent = 0")
    return missing.select(_named(list(_parent_codes(references)), "parent").alias("parent_table"), "key", "n_references")


def orphans(references: list[Reference]) -> DataFrame:
    """(table_name, row_id, parent_table, carried columns) of every row that refers to a missing record, once each."""
    groups, children = _groups(references), _children(references)
    carried = [c for c in children.columns if c not in ("child", "row_id", "parent", "key")]
    salts = F.greatest(F.lit(1), F.ceil(F.col("n_references") / HOT_REFERENCES)).cast("int")
    hot = groups.where(F.col("n_references") >= HOT_REFERENCES).orderBy(F.col("n_references").desc(), "parent", "key").limit(HOT_KEYS)
    hot = hot.select("parent", "key", (F.col("has_parent") == 1).alias("hot_held"), salts.alias("hot_salts"))
    # A key that is not hot looks for salt 0, which every missing key has.
    missing = groups.where("has_parent = 0").select("parent", "key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    told = children.join(F.broadcast(hot), ["parent", "key"], "left").where("key is not null and not coalesce(hot_held, false)")
    salted = told.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("hot_salts")).cast("int"), F.lit(0)))
    columns = ["child", "row_id", "parent", *carried]
    found = salted.join(missing, ["parent", "key", "salt"], "left_semi").select(columns)
    rows = found.unionByName(children.where("key is null").select(columns)).dropDuplicates(["child", "row_id"])
    tables = [r.child_table for r in references]
    return rows.select(_named(tables, "child").alias("table_name"), "row_id", _named(list(_parent_codes(references)), "parent").alias("parent_table"), *carried)


def orphans_per_period(references: list[Reference], periods: DataFrame) -> DataFrame:
    """(table_name, period, n_orphans): the counts of the groups that `carry` names (one column), summed by the period that
    periods (that column, period; one row each) gives them; null where it gives none."""
    [by] = [c for c in periods.columns if c != "period"]
    counts = orphans(references).groupBy("table_name", by).agg(F.count("*").alias("n"))
    return counts.join(periods, by, "left").groupBy("table_name", "period").agg(F.sum("n").alias("n_orphans"))
