"""Document fingerprints by winnowing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A token is a run of at most so many code points without white space, so that text without blanks is cut as well.
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
FIRST = -(1 << 63)


def _winner(window: int) -> str:
    """Whether gram j is the rightmost minimum of some window: enough neighbours that are not smaller (left) or are larger (right)."""
    left = right = "0"
    for i in range(window - 1, 0, -1):
        left = f"if(j >= {i} AND g[j - {i}] >= g[j], 1 + {left}, 0)"
        right = f"if(j + {i} < size(g) AND g[j + {i}] > g[j], 1 + {right}, 0)"
    return f"{left} + {right} + 1 >= least({window}, size(g))"


def fingerprint(text: str, k: int = 5, window: int = 8) -> Column:
    """Winnowed k-gram hashes of the text in a column, with their token positions: array of (hash, pos) by position.

    Tokens are runs without white space, cut after 16 code points. Every k consecutive tokens are hashed; each window of
    `window` consecutive hashes gives its smallest, the rightmost of equal ones. Any passage of `k + window - 1` tokens that
    two texts share gives both a common hash. Fewer than k tokens are one gram, fewer grams than a window are one window; a
    text without tokens has an empty fingerprint, and null counts as empty. Work is linear in the text.
    """
    words = f"transform(regexp_extract_all(coalesce({text}, ''), r'({TOKEN})', 1), x -> xxhash64(x))"
    grams = f"""if(size(h) < {k}, if(size(h) = 0, filter(h, x -> false), array(xxhash64(h))),
        transform(sequence(0, greatest(size(h) - {k}, 0)), i -> xxhash64({', '.join(f'h[i + {i}]' for i in range(k))})))"""
    picks = f"""transform(filter(sequence(0, greatest(size(g) - 1, 0)), j -> size(g) > 0 AND {_winner(window)}),
        j -> named_struct('hash', g[j], 'pos', j))"""
    # One-element arrays bind the token hashes and the gram hashes, so that each is computed once for a text.
    return F.expr(f"transform(transform(array({words}), h -> {grams}), g -> {picks})[0]")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints' hashes; two empty ones are alike."""
    a, b = a["hash"], b["hash"]
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def as_text(prints: Column) -> Column:
    """Hash and position of each pick, as text."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.hex(x["hash"]), F.lit(":"), x["pos"].cast("string"))), " ")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `text`, `prints` of every row with `next_text` and `next_prints` of the row that follows by id, the first after the last.

    Rows go to blocks of consecutive ids, whose bounds are ids of the table (approximate quantiles; as many as four per shuffle
    partition). The row that starts a block is also sent to the block before, so one shuffle of the text by block is enough
    and no window spans the table. Null ids come first; rows with equal ids follow each other by the hash of their text.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(FIRST)).alias("key"))
    count = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("key", [i / count for i in range(1, count)] or [0.5], F.lit(max(10_000, 20 * count)))
    low, found = keyed.agg(F.min("key"), cuts).first()
    bounds = sorted({low or 0, *(found or [])})
    # Two levels of bounds, so that finding a block takes about twice the root of their number.
    step = math.isqrt(len(bounds)) + 1
    runs = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    upper = F.array(*[F.lit(run[0]).cast("bigint") for run in runs])
    nested = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in run]) for run in runs])
    placed = keyed.withColumn("run", F.greatest(F.size(F.filter(upper, lambda b: b <= F.col("key"))), F.lit(1)))
    at = F.element_at(nested, F.col("run"))
    block = (F.col("run") - 1) * step + F.greatest(F.size(F.filter(at, lambda b: b <= F.col("key"))), F.lit(1)) - 1
    placed = placed.select("id", "text", "key", block.alias("own"), F.array_contains(at, F.col("key")).alias("starts"))
    before = F.pmod(F.col("own") - 1, F.lit(len(bounds)))
    places = F.when(F.col("starts"), F.array(
        F.struct(F.col("own").alias("block"), F.lit(False).alias("guest")), F.struct(before.alias("block"), F.lit(True).alias("guest")))).otherwise(
        F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("guest"))))
    sent = placed.select("id", "text", "key", F.explode(places).alias("at")).select("id", "text", "key", "at.block", "at.guest")
    dealt = sent.repartition("block").withColumn("prints", fingerprint("text"))
    order = Window.partitionBy("block").orderBy("guest", "key", F.xxhash64("text"))
    return dealt.select(
        "id", "text", "prints", "guest", F.lead("text").over(order).alias("next_text"),
        F.lead("prints").over(order).alias("next_prints")).where(~F.col("guest")).drop("guest")


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is replaced by the start of the next document.

    Nulls count as empty texts, repeated rows as rows of their own; a table of one row follows itself; an empty one gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    edited = F.expr("concat(substring(text, 1, CAST(n_chars - n_chars div 4 AS int)), substring(next_text, 1, CAST(n_chars div 4 AS int)))")
    rows = rows.withColumn("edited", edited).withColumn("edited_prints", fingerprint("edited"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))
