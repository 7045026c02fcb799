"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm import common, words

# Words and their beginnings are hashed to so many features; a text has a feature once or not at all.
DIMENSIONS = 1 << 18
# Beginnings of so many bytes, for words that share a stem.
STEMS = (4, 5, 6, 7)


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text and their texts, in order of the texts: words, the runs of letters and digits, with
    A-Z lower-cased, and the first bytes of longer words."""
    data, start, end, value, offsets = words.located(docs, words.PUNCTUATION)
    doc = np.repeat(np.arange(len(docs)), np.diff(offsets))
    order = np.lexsort((value, doc))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(value[order]) != 0) | (np.diff(doc[order]) != 0)
    first = order[new]
    start, size, value, doc = start[first], (end - start)[first], value[first], doc[first]
    found, key = [(value, doc)], np.zeros(len(start), np.uint64)
    for i in range(max(STEMS)):
        key |= words.LOWER[data[np.minimum(start + i, len(data) - 1)]].astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in STEMS:
            longer = size > i + 1
            found.append((words.mix(key[longer] + np.uint64((i + 1) << 60)), doc[longer]))
    value, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    both = np.unique(doc * DIMENSIONS + (value % np.uint64(DIMENSIONS)).astype(np.int64))
    return both % DIMENSIONS, both // DIMENSIONS


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of confirmed toxic texts and of texts of any kind, and the share of toxic among labelled ones.

    At most `positives` and `unlabelled` documents of the training fold are taken, the first by the hash of their id, so
    the ids may be broadcast and the features collected, whatever the size of the tables.
    """
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 0
    marked = labels.where(train & F.col("toxic").isNotNull())
    share = marked.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    toxic = marked.where("toxic = 1").select("doc_id").distinct().orderBy(order, "doc_id").limit(positives).withColumn("kind", F.lit(1))
    other = docs.where(train).select("doc_id").distinct().orderBy(order, "doc_id").limit(unlabelled).withColumn("kind", F.lit(0))
    picked = toxic.union(other).select(F.col("doc_id").alias("picked"), "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.sliced(whole, 1):
                feature, doc = features(common.texts(batch.column(1)))
                cuts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                lists = [feature[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], ["kind", "features"])

    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("kind", "text").mapInArrow(run, "kind int, features array<int>")
    rows = found.toArrow()
    kinds, lists = rows.column("kind").to_pylist(), rows.column("features").to_pylist()
    pick = lambda kind: sorted((np.array(x, np.int64) for k, x in zip(kinds, lists, strict=True) if k == kind), key=lambda x: x.tobytes())
    return pick(1), pick(0), float(share)


class Sparse:
    """Binary rows with weighted sums over their features."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.columns = np.concatenate([np.zeros(0, np.int64), *rows])
        self.row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        self.n = len(rows)

    def keep(self, used: np.ndarray) -> None:
        """Leave out features."""
        held = used[self.columns]
        self.columns, self.row = self.columns[held], self.row[held]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Score of each row."""
        return np.bincount(self.row, weights[self.columns], self.n)

    def back(self, slopes: np.ndarray) -> np.ndarray:
        """Gradient of the weights."""
        return np.bincount(self.columns, slopes[self.row], DIMENSIONS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function."""
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(
        toxic: list[np.ndarray], other: list[np.ndarray], prior: float, steps: int = 200, rate: float = 1.0,
        sparsity: float = 5e-4, support: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk.

    The risk is prior * E_toxic[loss(f)] + max(0, E_other[loss(-f)] - prior * E_toxic[loss(-f)]) with the logistic loss: the
    unlabelled texts stand for non-toxic ones after the toxic share in them is taken off. Where that difference falls below
    zero, the model has begun to learn the sample by heart, and the step goes up its slope instead. Accelerated proximal steps
    with an absolute penalty leave features that tell little without weight; those in under a hundredth of the toxic texts are not
    used, nor those in over a fifth of all texts unless they are twice as common in toxic ones. Without toxic examples every text scores the prior.
    """
    prior = min(max(prior, 1e-3), 0.999)
    weights, bias = np.zeros(DIMENSIONS), float(np.log(prior / (1 - prior)))
    if not toxic or not other:
        return weights.astype(np.float32), bias
    p, u = Sparse(toxic), Sparse(other)
    in_p, in_u = np.bincount(p.columns, minlength=DIMENSIONS), np.bincount(u.columns, minlength=DIMENSIONS)
    used = (in_p >= max(3, support * p.n)) & ((in_u <= 0.2 * u.n) | (in_u / u.n <= 0.5 * in_p / p.n))
    p.keep(used)
    u.keep(used)
    ahead, bias_ahead, pace = weights, bias, 1.0
    for _ in range(steps):
        fp, fu = p.dot(ahead) + bias_ahead, u.dot(ahead) + bias_ahead
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, uu = prior * sigmoid(fp) / p.n, sigmoid(fu) / u.n
        sp, su = (-prior * sigmoid(-fp) / p.n - up, uu) if negative >= 0 else (up, -uu)
        step = ahead - rate * (p.back(sp) + u.back(su))
        step = np.sign(step) * np.maximum(np.abs(step) - rate * sparsity, 0)
        bias_step = bias_ahead - rate * (sp.sum() + su.sum())
        quicker = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = step + (pace - 1) / quicker * (step - weights)
        bias_ahead = bias_step + (pace - 1) / quicker * (bias_step - bias)
        weights, bias, pace = step, bias_step, quicker
    return weights.astype(np.float32), float(bias)


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """`doc_id` and `score` of every whole text; the weights are a fixed 1 MB."""
    weights = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.sliced(whole, 1):
                feature, doc = features(common.texts(batch.column(1)))
                total = np.bincount(doc, weights.value[feature], batch.num_rows) + bias
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(total))], ["doc_id", "score"])

    return common.small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def report(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> DataFrame:
    """Held-out flag, toxicity and decision of every document.

    Labels are read in the training fold only, crc32 of the id modulo 5 not 0, and nothing but the text is an input of a score.
    Null and empty texts score the bias, null ids are held out (crc32 of the empty text is 0), repeated rows score alike; a
    label of null is no label, and empty tables give no rows or scores of a prior near 0. Other columns are ignored.
    """
    weights, bias = train(*sample(docs, labels, positives, unlabelled))
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    return score(docs, weights, bias).select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
