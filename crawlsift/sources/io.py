"""Readers and writers of recorded crawl tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PAGES = "page_id bigint, url string, html string"
RESPONSES = (
    "response_id bigint, page_id bigint, url string, host string, port int, status_code int, status_text string,"
    " http_version string, headers map<string, array<string>>, content_type string, declared_length bigint,"
    " content_length bigint, response_ms bigint, error_code string, error_message string")
HOPS = "from_url string, status_code int, status_text string, location string, response_ms bigint"
TARGETS = "raw_url string"


# At most this many input splits are spread again: with 64 MB splits a bound of 1 GB, whatever the cluster.
SPREAD_SPLITS = 16


def spread(df: DataFrame) -> DataFrame:
    """Spread a small scan over all cores.

    Lexing costs far more than reading, and a file with one row group is read by one task. Tables of any size have more
    splits than `SPREAD_SPLITS` and are left alone: HTML is never shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits <= SPREAD_SPLITS and splits < cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded pages; column pruning and filters reach the Parquet scan."""
    return spread(spark.read.schema(PAGES).parquet(path))


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recorded HTTP exchanges with nested headers, as JSON or Parquet."""
    return spark.read.schema(RESPONSES).format(fmt).load(path)


def read_hops(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Recorded responses per URL for chain reconstruction."""
    return spark.read.schema(HOPS).format(fmt).load(path)


def read_targets(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """Raw target URLs from text, CSV or Parquet."""
    if fmt == "text":
        return spark.read.text(path).withColumnRenamed("value", "raw_url")
    reader = spark.read.schema(TARGETS)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def write_reports(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Nested reports, one row per page."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    """Failed inspections."""
    df.write.mode("overwrite").json(path)


def write_trace_text(lines: DataFrame, path: str) -> None:
    """Trace lines as text, sorted inside each session; sessions are spread over the files by range."""
    lines.repartitionByRange("session_id", "id").sortWithinPartitions("session_id", "id").select("line").write.mode(
        "overwrite").text(path)


def store(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back: computed once, and safe when executors die."""
    path = shared_dir(df.sparkSession) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the folder named by `spark.checkpoint.dir`; a session on one machine may use its warehouse instead."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/crawlsift-{uuid.uuid4().hex}"
