"""Quality by hierarchical empirical Bayes: evidence from a document, its host and its path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlsift.llm import common, words
from crawlsift.sources import io

BINS = 12
_ASCII = np.arange(256)
CLASSES = {
    "upper": (_ASCII >= 65) & (_ASCII <= 90), "digit": (_ASCII >= 48) & (_ASCII <= 57), "line": _ASCII == 10, "bar": _ASCII == 124,
    "mark": np.isin(_ASCII, list(b"#$%&*!+=<>@^~|")), "stop": np.isin(_ASCII, list(b".,;:"))}


def measures(docs: list[bytes]) -> np.ndarray:
    """Numbers that describe the form of each text: lengths, shares of kinds of bytes, repetition of words and word groups."""
    data, start, end, value, offsets = words.located(docs)
    n = np.diff(offsets)
    begin = np.cumsum([0, *(len(x) + 1 for x in docs)])[:-1]
    size = np.maximum([len(x) for x in docs], 1)
    doc = np.repeat(np.arange(len(docs)), n)
    many = np.maximum(n, 1)
    shares = [np.add.reduceat(mask[data].astype(np.int64), begin) / size for mask in CLASSES.values()]
    twice = np.zeros(len(data), np.int64)
    twice[1:] = (data[1:] == data[:-1]) & CLASSES["mark"][data[1:]]
    next_same = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    grams, of = words.shingles(value, offsets, 3)
    return np.stack([
        np.log1p(n), np.bincount(doc, end - start, len(docs)) / many, *shares, np.add.reduceat(twice, begin) / size,
        np.bincount(doc[1:], next_same, len(docs)) / many, distinct(value, doc, len(docs)) / many,
        distinct(grams, of, len(docs)) / np.maximum(np.bincount(of, minlength=len(docs)), 1)], axis=1)


def distinct(value: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each document."""
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n)


class Model:
    """Additive logistic model over binned measures, in numpy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.1, decay: float = 1e-3) -> None:
        self.prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        self.bias = float(np.log(self.prior / (1 - self.prior)))
        if not len(y):
            self.cuts = self.weights = np.zeros((0, 0))
            return
        self.cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        self.weights = np.zeros((x.shape[1], BINS))
        bins = self.bins(x)
        m, v = np.zeros(self.weights.size + 1), np.zeros(self.weights.size + 1)
        for step in range(1, steps + 1):
            error = (1 / (1 + np.exp(-self.sum(bins))) - y) / len(y)
            slope = np.stack([np.bincount(b, error, BINS) for b in bins.T]) + decay * self.weights
            slope = np.append(slope.ravel(), error.sum())
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
            move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
            self.weights -= move[:-1].reshape(self.weights.shape)
            self.bias -= float(move[-1])

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin of each measure."""
        return np.stack([np.searchsorted(cut, column, "right") for cut, column in zip(self.cuts, x.T, strict=True)], axis=1)

    def sum(self, bins: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self.bias + sum(w[b] for w, b in zip(self.weights, bins.T, strict=True))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Chance that a text is good, by its form alone."""
        odds = self.sum(self.bins(x)) if len(self.weights) else np.full(len(x), self.bias)
        return np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 1e-6, 1 - 1e-6)


def _add(docs: DataFrame, text: str, name: str, kind: T.DataType, make: object) -> DataFrame:
    """All columns of `docs` and one that is computed from the text."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.sliced(whole, at):
                made = make(common.texts(batch.column(at)))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, name])

    return common.small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = 20_000) -> Model:
    """Fit the model of a document's form on at most `limit` labelled documents, the first by the hash of their id."""
    marked = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    picked = marked.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(limit).select(F.col("doc_id").alias("picked"), F.col("quality").alias("y"))
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("picked")).select("y", "text")
    kind = T.ArrayType(T.DoubleType())
    rows = _add(found, "text", "x", kind, lambda docs: pa.array(list(measures(docs)), pa.list_(pa.float64()))).select("y", "x").toArrow()
    if not rows.num_rows:
        return Model(np.zeros((0, 0)), np.zeros(0))
    x, y = np.array(rows.column("x").to_pylist(), np.float64), np.array(rows.column("y").to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))
    return Model(x[order], y[order])


def evidence(docs: DataFrame, model: Model, text: str = "text", name: str = "__p") -> DataFrame:
    """All columns and `name`, the chance that a document is good by its form."""
    return _add(docs, text, name, T.DoubleType(), lambda texts: pa.array(model.probability(measures(texts))))


def _logit(x: Column) -> Column:
    x = F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(x / (1 - x))


def posterior(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """All columns and `__quality`, the posterior chance that a document is good; where `docs` has a column of that name, the new
    one takes further underscores (`common.fresh`).

    The expected numbers of good documents of every host and path are sums over all documents (combined before the shuffle, so
    a host with a third of them is a few rows). A host's rate shrinks toward the global one and a path's toward its host's;
    the strength of each level comes from how far the groups of that level differ beyond chance (moments), so sparse sites
    lean on the level above. A document's own part is taken out of its groups. Its prior odds are then its path's, and the
    classifier's likelihood ratio is applied to them. Null hosts and paths are groups like others.
    """
    place = F.struct(host.alias("host"), path.alias("path"))
    own = evidence(docs.select(place.alias("place"), "text"), model)
    paths = io.store(own.groupBy("place").agg(F.sum("__p").alias("sp"), F.count("*").alias("np")))
    hosts = paths.groupBy(F.col("place.host").alias("host")).agg(F.sum("sp").alias("sh"), F.sum("np").alias("nh"))
    total = hosts.agg(F.sum("sh"), F.sum("nh")).first()
    mean = min(max((total[0] or 0) / (total[1] or 1), 1e-6), 1 - 1e-6)

    def strength(groups: DataFrame, rate: Column, n: Column, above: Column) -> float:
        # Var(rate) = between + chance / n, weighted by n: the part that chance does not explain sets the pull.
        spread, chance, rows = groups.agg(
            F.sum(n * (rate - above) ** 2), F.sum(above * (1 - above)), F.sum(n)).first()
        between = max((spread or 0) - (chance or 0), 0) / max(rows or 1, 1)
        return min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1e6)

    pull_host = strength(hosts, F.col("sh") / F.col("nh"), F.col("nh"), F.lit(mean))
    table = paths.join(hosts.withColumnRenamed("host", "of"), F.col("place.host").eqNullSafe(F.col("of"))).select("place", "sp", "np", "sh", "nh")
    rate_host = (F.lit(pull_host * mean) + F.col("sh")) / (pull_host + F.col("nh"))
    pull_path = strength(table, F.col("sp") / F.col("np"), F.col("np"), rate_host)
    names = [common.fresh(f"__{x}", docs) for x in ("place", "sp", "np", "sh", "nh", "at", "p")]
    table = io.store(table.select("place", "sp", "np", "sh", "nh").toDF(*names[:5]))
    at, sp, np_, sh, nh = (F.col(x) for x in names[:5])
    here, p = F.col(names[5]), F.col(names[6])
    joined = evidence(docs, model, name=names[6]).withColumn(names[5], place).join(table, here.eqNullSafe(at), "left")
    of_host = (F.lit(pull_host * mean) + sh - p) / (pull_host + nh - 1)
    of_path = (F.lit(pull_path) * of_host + sp - p) / (pull_path + np_ - 1)
    base = float(np.log(model.prior / (1 - model.prior)))
    odds = _logit(p) - F.lit(base) + _logit(of_path)
    return joined.select(*docs.columns, (1 / (1 + F.exp(-odds))).alias(common.fresh("__quality", docs)))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents whose posterior is at least `threshold`, with all columns and `__quality`.

    The host of a document is its source, the path its language below the source. Null and empty texts are judged by the
    measures of an empty text; rows without labels train nothing; without any labels every document has even odds and stays;
    an empty table gives no rows; repeated rows are judged alike.
    """
    return posterior(docs, fit(docs, labels), F.col("source"), F.col("lang")).where(F.col(common.fresh("__quality", docs)) >= threshold)
