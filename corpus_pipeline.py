"""From crawled documents to training ids: judge quality, drop repeated lines and near copies, keep benchmarks out, encode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.llm import common, decontamination, jaccard, line_dedup, pieces, quality
from crawlsift.llm.registry import PIECES
from crawlsift.sources import io

# Classifiers and tokenizer libraries are beyond SQL; tests/llm compares the whole run with plain Python.
ORACLE_SQL = None


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality posterior is even odds or better."""
    return quality.keep(docs, common.read(spark, sf_dir, "labels")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that five of them repeat, but for the last holder; `n_chars` follows the text."""
    done = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    return done.select(*[
        F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of every group of near copies."""
    return jaccard.first_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left."""
    return pieces.report(docs, PIECES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", judge), ("lines", drop_lines), ("near copies", drop_copies), ("benchmark", drop_leaks), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each on the table that the one before wrote."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = io.store(stage(spark, docs, sf_dir))
    return docs
