"""Line dedup: range-partitioned line hashes and per-document keep bitmaps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm import common

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "struct<word:int,bits:bigint>"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digest(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("line"), text).alias("b"))


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Keys of at least `min_chars` code points: 128-bit hash, document, digest of its text, position."""
    lines = F.transform(_lines(F.col(text)), lambda x, i: F.struct(F.btrim(x, F.lit(BLANK)).alias("line"), i.alias("pos")))
    long = F.filter(lines, lambda x: F.length(x["line"]) >= min_chars)
    key = F.transform(long, lambda x: F.struct(F.translate(x["line"], UPPER, LOWER).alias("line"), x["pos"].alias("pos")))
    return docs.select(F.col(doc_id).alias("doc"), _digest(F.coalesce(text, F.lit(""))).alias("body"), F.explode(key).alias("k")).select(
        _digest(F.col("k.line")).alias("h"), "doc", "body", F.col("k.pos").alias("pos"))


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Which lines repeat: one row per document that loses lines, with `drops`, its sparse bitmap.

    A text is split at newlines. A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. A key of
    at least `min_chars` code points that at least `min_docs` documents hold loses all lines except those of the largest
    document id that holds it. `drops` lists 64-line words in ascending order, `bits` set where a line goes; a word that is
    missing keeps all its lines, so clean documents cost nothing. `body` is the digest of the text the bitmap is for: rows that
    repeat an id with another text get bitmaps of their own.

    Occurrences are range-partitioned by hash, document and position, so a line that a third of the corpus repeats spreads over
    many partitions, in runs that the partial aggregation streams to one row per run; the few repeated keys then meet the
    occurrences in a join that Spark may split. No text is shuffled.

    Nulls: a null or empty text is one empty line; rows with a null id count as one document, smaller than all others. Equal
    rows are one document. An empty table gives no rows. Other columns of `docs` are ignored.
    """
    found = occurrences(docs, doc_id, text, min_chars)
    ranged = found.repartitionByRange("h", "doc", "pos").sortWithinPartitions("h", F.desc("doc"), "pos")
    heads = ranged.groupBy("h").agg(
        F.max("doc").alias("keeper"),
        (F.countDistinct("doc") + F.max(F.col("doc").isNull().cast("int"))).alias("holders")).where(F.col("holders") >= min_docs)
    heads = heads.select(F.col("h").alias("hh"), "keeper")
    lost = ranged.join(heads, F.col("h") == F.col("hh")).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    word = lost.select("doc", "body", F.floor(F.col("pos") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit"))
    words = word.groupBy("doc", "body", "word").agg(F.bit_or("bit").alias("bits"))
    return words.groupBy("doc", "body").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def apply(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, the text without its dropped lines, and `__lines`, `__dropped`: counts before and of the drop.

    Kept lines come from the slices between dropped positions, so the work is linear in the text. Where `docs` has a column of
    the name of a count, that one stays and the count takes further underscores (`common.fresh`).
    """
    t_doc, t_body, t_drops, t_digest, t_all, t_gone, t_kept, lines, dropped = (
        common.fresh(f"__{x}", docs) for x in ("doc", "body", "drops", "digest", "all", "gone", "kept", "lines", "dropped"))
    marks = bitmaps.select(F.col("doc").alias(t_doc), F.col("body").alias(t_body), F.col("drops").alias(t_drops))
    whole = docs.withColumn(t_digest, _digest(F.coalesce(text, F.lit(""))))
    joined = whole.join(marks, F.col(doc_id).eqNullSafe(F.col(t_doc)) & (F.col(t_digest) == F.col(t_body)), "left")
    gone = F.expr(
        f"flatten(transform({t_drops}, w -> transform(filter(sequence(0, 63), b -> shiftrightunsigned(w.bits, b) & 1 = 1), b -> w.word * 64 + b)))")
    split = joined.withColumn(t_all, _lines(F.col(text))).withColumn(t_gone, F.when(F.col(t_drops).isNotNull(), gone))
    kept = F.expr(f"""
        array_join(flatten(transform(sequence(0, size({t_gone})), j ->
            slice({t_all}, if(j = 0, 0, {t_gone}[greatest(j - 1, 0)] + 1) + 1,
                  if(j = size({t_gone}), size({t_all}), {t_gone}[least(j, size({t_gone}) - 1)])
                  - if(j = 0, 0, {t_gone}[greatest(j - 1, 0)] + 1)))), '\n')""")
    done = split.withColumn(t_kept, F.when(F.col(t_gone).isNull(), F.coalesce(text, F.lit(""))).otherwise(kept))
    return done.select(
        *[F.col(t_kept).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.size(t_all).cast("bigint").alias(lines),
        F.when(F.col(t_gone).isNull(), F.lit(0)).otherwise(F.size(t_gone)).cast("bigint").alias(dropped))


def report(docs: DataFrame, **params: int) -> DataFrame:
    """Per document: lines, dropped lines and the digest of what stays."""
    done = apply(docs.select("doc_id", "text"), keep_bitmaps(docs, **params))
    return done.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))
