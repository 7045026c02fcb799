"""Stored summaries that merge: quantiles by KLL sketches, distinct counts and overlaps by theta sketches.

A summary is a few KB per key and hour whatever the traffic; it is written once, and any span of hours, hosts or types is
answered by merging summaries, without the rows behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# KLL: `K` items of the widest level; the rank of a quantile is off by less than RANK_ERROR in 99 of 100 sketches (0.0133 at 200,
# falling as K to the 0.96). Theta: 2 ** LG_ENTRIES hashes are kept, counts up to that are exact.
K = 1024
RANK_ERROR = 0.0133 * (200 / K) ** 0.96
LG_ENTRIES = 12


def quantile_sketches(rows: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, n, sketch) of the whole-number `value`; rows without a value take no part.

    Sketches are built map-side, so a key with a third of the rows is one sketch per task in the shuffle.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of the given keys over all rows of `sketches`; fewer keys or none merge further."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))


def quantiles(sketches: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """The sketch's columns without the sketch, and one column per named rank between 0 and 1."""
    return sketches.select(
        *[c for c in sketches.columns if c != "sketch"],
        *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias(name) for name, q in ranks.items()])


def within(estimate: str, rank: float, below: str, upto: str, n: str = "n", error: float = 2 * RANK_ERROR) -> Column:
    """Whether an estimated quantile stands where it should: `below` values are smaller than it, `upto` at most as large, of `n`.

    Tied values have a run of ranks; any of them within the error will do. One rank more is allowed, as ranks are whole.
    """
    slack = F.col(n) * F.lit(error) + 1
    target = F.lit(rank) * F.col(n)
    return F.col(estimate).isNotNull() & (F.col(below) <= target + slack) & (F.col(upto) >= target - slack)


def judged(rows: DataFrame, key: str, value: str, found: DataFrame, ranks: dict[str, float]) -> DataFrame:
    """(key, n, one boolean per rank): the quantiles `found` held against an exact count of all rows, in one pass.

    Rows are counted by value first, so the join carries distinct values; `found` has one row per key.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("of"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    joined = counts.join(found, F.col("of").eqNullSafe(F.col(key)))
    sums = [F.sum(F.when(F.col("v") < F.col(x), F.col("c")).otherwise(0)).alias(f"below_{x}") for x in ranks]
    sums += [F.sum(F.when(F.col("v") <= F.col(x), F.col("c")).otherwise(0)).alias(f"upto_{x}") for x in ranks]
    held = joined.groupBy(key).agg(F.sum("c").alias("n"), *[F.first(x).alias(x) for x in ranks], *sums)
    return held.select(key, "n", *[within(x, q, f"below_{x}", f"upto_{x}").alias(x) for x, q in ranks.items()])


def distinct_sketches(rows: DataFrame, keys: list[str], item: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """(keys, sketch): the distinct `item`s of each key; nulls are no items."""
    return rows.groupBy(*keys).agg(F.theta_sketch_agg(item, lg_entries).alias("sketch"))


def distinct(sketches: DataFrame, keys: list[str], name: str = "items", lg_entries: int = LG_ENTRIES) -> DataFrame:
    """Estimated distinct items per key, sketches of finer keys merged. The standard error is 1 / sqrt(2 ** LG_ENTRIES) beyond
    2 ** LG_ENTRIES items; below that the count is exact."""
    return sketches.groupBy(*keys).agg(F.theta_sketch_estimate(F.theta_union_agg("sketch", lg_entries)).alias(name))


def overlap(sketches: DataFrame, key: str, pairs: DataFrame, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """For the listed pairs (a, b) of keys: estimated items of each, of both and of either. Two lookups per pair; only pairs that
    are asked for are met."""
    left = sketches.select(F.col(key).alias("ka"), F.col("sketch").alias("sa"))
    right = sketches.select(F.col(key).alias("kb"), F.col("sketch").alias("sb"))
    met = pairs.join(left, F.col("a") == F.col("ka")).join(right, F.col("b") == F.col("kb"))
    size = F.theta_sketch_estimate
    return met.select(
        "a", "b", size("sa").alias("items_a"), size("sb").alias("items_b"),
        size(F.theta_intersection("sa", "sb")).alias("both"), size(F.theta_union("sa", "sb", lg_entries)).alias("either"))
