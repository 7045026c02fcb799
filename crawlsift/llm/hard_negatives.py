"""Hard-negative mining: Strassen products of anchor and candidate tiles, mergeable heaps of positives and of window negatives."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.sources import io

SCALE = 256
# Anchors that meet all candidates in one pass over the table: the broadcast holds this many rows of integers at most, whatever the table.
PASS_ANCHORS = 32_768
ANCHOR_TILE, CANDIDATE_TILE = 512, 2048
# Below this side a product is taken directly.
LEAF = 32
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of integer matrices by Strassen's seven products, sides padded to even with zeros.

    Additions are of int64 and exact. A direct product goes through doubles where every partial sum is an integer that a double
    holds, and through int64 otherwise.
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        if k * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 2.0 ** 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    (a11, a12), (a21, a22) = (np.hsplit(x, 2) for x in np.vsplit(a, 2))
    (b11, b12), (b21, b22) = (np.hsplit(x, 2) for x in np.vsplit(b, 2))
    p1, p2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    p3, p4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), np.int64)
    out[:m // 2, :n // 2] = p1 + p4 - p5 + p7
    out[:m // 2, n // 2:] = p3 + p5
    out[m // 2:, :n // 2] = p2 + p4
    out[m // 2:, n // 2:] = p1 - p2 + p3 + p6
    return out


class Heaps:
    """The best `size` (score, id) pairs of many keys; higher scores first, then smaller ids. Merging heaps gives the heap of all."""

    def __init__(self, keys: int, size: int) -> None:
        self.score, self.id = np.full((keys, size), NONE), np.zeros((keys, size), np.int64)
        self.held = np.zeros((keys, size), bool)

    @property
    def bar(self) -> np.ndarray:
        """What a score must reach to enter."""
        return np.where(self.held[:, -1], self.score[:, -1], NONE)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Offer pairs."""
        if not len(key):
            return
        touched = np.unique(key)
        row, col = np.nonzero(self.held[touched])
        key = np.concatenate([key, touched[row]])
        score = np.concatenate([score, self.score[touched][row, col]])
        ids = np.concatenate([ids, self.id[touched][row, col]])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        ok = place < self.score.shape[1]
        self.held[touched] = False
        self.score[key[ok], place[ok]], self.id[key[ok], place[ok]], self.held[key[ok], place[ok]] = score[ok], ids[ok], True

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, scores and ids of all pairs."""
        key, col = np.nonzero(self.held)
        return key, self.score[key, col], self.id[key, col]


class Anchors:
    """A block of anchors, their vectors as rows of integers."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.labels, self.rows = ids, labels, rows

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per tile: number of its first anchor, scores, ids and labels of candidates, and their vectors' scores with the anchors."""
        d = self.rows.shape[1]
        ids, labels, rows = whole(batch, d)
        for at in range(0, len(ids), CANDIDATE_TILE):
            part = rows[at:at + CANDIDATE_TILE]
            if d * float(np.abs(part).max(initial=0)) * float(np.abs(self.rows).max(initial=0)) >= 2.0 ** 56:
                raise ArithmeticError("vector entries are too large for 64-bit scores")
            for first in range(0, len(self.ids), ANCHOR_TILE):
                scores = strassen(self.rows[first:first + ANCHOR_TILE], part.T)
                yield first, scores, ids[at:at + CANDIDATE_TILE], labels[at:at + CANDIDATE_TILE]


def whole(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and integer vectors of a batch of (id, label, vector), all of one length."""
    flat = batch.column(2).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if np.abs(flat).max(initial=0) * SCALE >= 2.0 ** 62:
        raise ArithmeticError("vector entries are too large for 64-bit scores")
    rows = np.floor(SCALE * flat).astype(np.int64).reshape(batch.num_rows, length)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), rows


def usable(df: DataFrame, vec_id: str, label: str, vector: str) -> DataFrame:
    """(id, label, vec): rows that take part."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(ok).select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.col(vector).alias("vec"))


def best_positives(rows: DataFrame, anchors: Anchors, count: int) -> DataFrame:
    """(a, id, score): the `count` best other rows of the same label, of each task and anchor number."""
    held = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        heaps = Heaps(len(block.ids), count)
        for batch in batches:
            for first, scores, ids, labels in block.tiles(batch):
                few = slice(first, first + len(scores))
                able = (scores >= heaps.bar[few, None]) & (labels == block.labels[few, None]) & (ids != block.ids[few, None])
                a, c = np.nonzero(able)
                heaps.add(a + first, scores[a, c], ids[c])
        a, score, ids = heaps.pairs()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(ids), pa.array(score)], ["a", "id", "score"])

    return rows.mapInArrow(run, "a bigint, id bigint, score bigint")


def window_negatives(rows: DataFrame, anchors: Anchors, bounds: np.ndarray, count: int, low: int) -> DataFrame:
    """(slot, id, score): the `count` best rows of another label within each window, of each task.

    `bounds` holds, per anchor and positive, the positive's score (`NONE` without one); a window goes from `low` percent of it up to it.
    """
    held = rows.sparkSession.sparkContext.broadcast((anchors, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, high = held.value
        slots = high.shape[1]
        # 100 s >= low p, in integers
        least = np.where(high == NONE, -NONE - 1, -((-low * np.where(high == NONE, 0, high)) // 100))
        heaps = Heaps(high.size, count)
        for batch in batches:
            for first, scores, ids, labels in block.tiles(batch):
                few = slice(first, first + len(scores))
                bar = np.maximum(least[few], heaps.bar.reshape(-1, slots)[few])
                a, c = np.nonzero(
                    (scores >= bar.min(axis=1)[:, None]) & (scores <= high[few].max(axis=1)[:, None]) & (labels != block.labels[few, None]))
                found = scores[a, c]
                for slot in range(slots):
                    ok = (found >= bar[a, slot]) & (found <= high[few][a, slot])
                    heaps.add((a[ok] + first) * slots + slot, found[ok], ids[c[ok]])
        slot, score, ids = heaps.pairs()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(ids), pa.array(score)], ["slot", "id", "score"])

    return rows.mapInArrow(run, "slot bigint, id bigint, score bigint")


def merged(heaps: DataFrame, key: str, count: int) -> DataFrame:
    """Merge heaps of tasks: the best `count` pairs of each key, `rank` from 1. Each task sorts out its own before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "id")
    return heaps.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def mine(
        df: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 100, positives: int = 5,
        negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    Entries become floor(256 x); a score is the inner product. Anchors are the rows whose id is divisible by `every`; positives
    their `positives` best other rows of the same label; negatives the `negatives` best rows of another label that score
    from `low` percent of the positive's score up to it. Higher scores come first, ties by smaller id.

    Anchors go in blocks of `PASS_ANCHORS`. For each, all rows stay where they are read: tasks multiply tiles with the broadcast
    block and keep heaps, whose size depends on the block alone; heaps of tasks are merged in a shuffle. A second pass does the
    same for windows below the positives found.

    Rows with a null id, label or vector, or a null or non-finite entry, take no part, nor do vectors shorter than the longest
    that is left (they lack entries). Rows that repeat an id are candidates and anchors of their own, but never positives of an
    anchor of that id. A negative positive score has no window, so no rows. Entries too large for 64-bit scores raise
    ArithmeticError. An empty table gives no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = usable(df, vec_id, label, vector)
    length = rows.agg(F.max(F.size("vec"))).first()[0]
    rows = rows.where(F.size("vec") == F.lit(length))
    folder = io.shared_dir(spark) + "/negatives"
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(folder)
    for anchors in blocks(rows.where(F.col("id") % every == 0), length):
        best = merged(best_positives(rows, anchors, positives), "a", positives).toArrow()
        bounds, named = np.full((len(anchors.ids), positives), NONE), np.zeros((len(anchors.ids), positives), np.int64)
        at = best.column("a").to_numpy(), best.column("rank").to_numpy() - 1
        bounds[at], named[at] = best.column("score").to_numpy(), best.column("id").to_numpy()
        found = merged(window_negatives(rows, anchors, bounds, negatives, low), "slot", negatives)
        keys = spark.createDataFrame(pa.table({
            "at": np.arange(bounds.size), "anchor_id": np.repeat(anchors.ids, positives), "positive_id": named.ravel(),
            "positive_score": bounds.ravel()}))  # as many rows as a block has anchors and positives
        found.join(F.broadcast(keys), F.col("slot") == F.col("at")).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def blocks(asked: DataFrame, length: int | None) -> Iterator[Anchors]:
    """The anchors in blocks of `PASS_ANCHORS`: numbered inside their partitions, which are then laid end to end."""
    inside = Window.partitionBy("part").orderBy("id")
    numbered = io.store(asked.withColumn("part", F.spark_partition_id()).withColumn("no", F.row_number().over(inside) - 1))
    sizes = sorted(tuple(r) for r in numbered.groupBy("part").agg(F.count("*")).collect())
    before = np.cumsum([0, *(n for _, n in sizes)])
    for start in range(0, int(before[-1]), PASS_ANCHORS):
        of = [
            (F.col("part") == part) & F.col("no").between(start - int(b), start - int(b) + PASS_ANCHORS - 1)
            for (part, n), b in zip(sizes, before, strict=False) if b < start + PASS_ANCHORS and b + n > start]
        some = numbered.where(functools.reduce(operator.or_, of)).select("id", "label", "vec").orderBy("id").toArrow().combine_chunks()
        yield Anchors(*whole(some.to_batches()[0], length))


def relabelled(df: DataFrame, classes: int = 10, every: int = 7) -> DataFrame:
    """The rows with the labels that the query's contract asks for."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label").cast("bigint") + 1) % classes).otherwise(F.col("label"))
    return df.withColumn("label", label)


def report(df: DataFrame) -> DataFrame:
    """Hard negatives of the embeddings, every seventh id of which has the next label."""
    return mine(relabelled(df))
