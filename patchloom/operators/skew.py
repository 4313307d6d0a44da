"""Joins and pairs whose hottest key may hold a third of all rows, and joins of which few rows have a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that make a key hot, and rows of a salt of it.
HOT_ROWS = 10_000
#: Keys whose heat is made known to every task: those with the most rows; any other has less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1_000
#: Members of a group that meet all its members in one task.
BLOCK = 256
#: Parts of a bitmap of keys and 64-bit words of a part: 8 MB in all, however many keys there are.
PARTS, WORDS = 16_384, 64


def join_counted(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, spread: Column, how: str = "inner", counts: DataFrame | None = None, keep_salt: bool = False) -> DataFrame:
    """rows joined with keyed, whose column n tells how many rows (about) have the key; hot keys are salted.

    counts (on, n) has one row a key; it may be left out where keyed has. The rows that come out lie by
    (on, _salt), so a grouping that has both, with keep_salt, needs no further shuffle.

    The hottest HOT_KEYS keys and their salts are broadcast, a bounded number; a row of one takes a salt
    by `spread`, and its key is repeated once a salt. Rows of all other keys have salt 0, which every key has.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col(n) / HOT_ROWS)).cast("int")
    counts = keyed if counts is None else counts
    hot = counts.where(F.col(n) >= HOT_ROWS).orderBy(F.col(n).desc(), *on).limit(HOT_KEYS).select(*on, salts.alias("_salts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), F.lit(0)))
    repeated = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    joined = salted.drop("_salts").join(repeated, [*on, "_salt"], how)
    return joined if keep_salt else joined.drop("_salt")


def pairs_within(members: DataFrame, group: str, member: str, n: str) -> DataFrame:
    """(member_a, member_b), a < b, of every two members of a group; n is the group's size, whose blocks go to different tasks."""
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    left = members.select(group, F.col(member).alias(f"{member}_a"), F.pmod(F.xxhash64(member), blocks).cast("int").alias("_block"))
    right = members.select(group, F.col(member).alias(f"{member}_b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    return left.join(right, [group, "_block"]).where(F.col(f"{member}_a") < F.col(f"{member}_b")).select(f"{member}_a", f"{member}_b")


def prefiltered(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows without most of those whose key (on) is not among keys; no row of such a key is lost.

    A bitmap of fixed size holds the hashes of keys and is broadcast, so rows that a join with keys
    would drop are not shuffled for it. With more keys than bits it lets all rows through.
    """
    hashed = F.xxhash64(*on)
    part, word, bit = F.pmod(F.shiftright(hashed, 32), F.lit(PARTS)).cast("int"), F.pmod(F.shiftright(hashed, 6), F.lit(WORDS)).cast("int"), F.pmod(hashed, F.lit(64)).cast("int")
    words = keys.select(part.alias("_part"), word.alias("_word"), F.expr("1L").alias("one"), bit.alias("_bit")).groupBy("_part", "_word").agg(
        F.bit_or(F.expr("shiftleft(one, _bit)")).alias("bits")
    )
    held = words.groupBy("_part").agg(F.map_from_entries(F.collect_list(F.struct("_word", "bits"))).alias("held"))
    parts = held.select("_part", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("held", w), F.lit(0).cast("long"))).alias("_bits"))
    met = rows.withColumn("_part", part).join(F.broadcast(parts), "_part")
    return met.where(F.getbit(F.get("_bits", word), bit) == 1).drop("_part", "_bits")
