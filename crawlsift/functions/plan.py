"""Plan helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **exprs: str) -> DataFrame:
    """Add columns whose SQL expressions are evaluated once per row.

    Catalyst pushes filters, also the not-null filters it infers from joins, below a projection by copying the
    projected expression into them; for a parsed URL or a lexed page that repeats the costly part several times. A
    one-element generator is a boundary for such pushes and for merging projections. It moves no data.
    """
    for name, expr in exprs.items():
        df = df.select("*", F.explode_outer(F.array(F.expr(expr))).alias(name))
    return df


# Keys looked up by broadcast: any other key holds less than a thousandth of the rows.
HOT_KEYS = 1000


def lookup(df: DataFrame, table: DataFrame, keys: list[str], row_id: list[str], how: str = "left") -> DataFrame:
    """Join a table that has one row per key to rows whose keys may be badly skewed.

    The most frequent keys are looked up in a broadcast of at most `HOT_KEYS` rows, which also names those that the table
    lacks. Rows of hot and null keys then leave under keys of their own, made from `row_id`, so the shuffle for the remaining
    keys is even. Of table rows that repeat a key one counts. `df` is read twice: once for
    the key counts, which are combined before their shuffle, once for the join.
    """
    values = [c for c in table.columns if c not in keys]
    packed = table.select(*keys, F.struct(*values).alias("v")).groupBy(*keys).agg(F.first("v").alias("v"))
    hot = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), *keys).limit(HOT_KEYS).select(*keys)
    # Every hot key is known as such, whether the table has it or not.
    partners = packed.join(F.broadcast(hot), keys, "left_semi")
    hot_rows = hot.join(F.broadcast(partners), keys, "left").select(
        *[F.col(k).alias(f"hot_{k}") for k in keys], F.col("v").alias("hot_v"), F.lit(True).alias("is_hot"))
    found = df.join(F.broadcast(hot_rows), [F.col(k) == F.col(f"hot_{k}") for k in keys], "left")
    own = F.concat_ws("\u0001", F.lit(""), *[F.col(c).cast("string") for c in row_id])
    away = F.col("is_hot").isNotNull()
    for k in keys:
        away = away | F.col(k).isNull()
    for i, k in enumerate(keys):
        key = F.col(k)
        found = found.withColumn(f"cold_{k}", F.when(~away, key).otherwise(own) if i == 0 else F.coalesce(key.cast("string"), F.lit("")))
    cold = packed.select(*[F.col(k).cast("string").alias(f"table_{k}") for k in keys], F.col("v").alias("cold_v"))
    joined = found.join(cold, [F.col(f"cold_{k}") == F.col(f"table_{k}") for k in keys], "left").withColumn(
        "v", F.when(~away, F.col("cold_v")).otherwise(F.col("hot_v")))
    kept = joined if how == "left" else joined.where("v IS NOT NULL")
    return kept.select(*[F.col(c) for c in df.columns], *[F.col("v")[c].alias(c) for c in values])
