"""Stored sketches against exact values: quantiles within their rank error, distinct counts, overlaps."""

import bisect

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import sketches
from crawlsift.sources import io

RANKS = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}


@pytest.fixture(scope="module")
def rows(spark):
    """200,000 rows: a third with one hot host and one value, the rest skewed, some without a value."""
    return spark.range(200_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'other' END AS host", "id DIV 3 % 24 AS hour",
        "CASE WHEN id % 7 = 0 THEN 40 WHEN id % 101 = 0 THEN NULL ELSE CAST(pow(pmod(xxhash64(id), 1000), 2) AS bigint) END AS ms")


def test_quantiles_of_merged_sketches(spark, rows):
    kept = io.store(sketches.quantile_sketches(rows, ["host", "hour"], "ms"))
    assert kept.count() == 72 and kept.agg(F.max(F.octet_length("sketch"))).first()[0] < 40_000
    found = sketches.quantiles(sketches.merged(kept, ["host"]), RANKS)
    values = {}
    for host, ms in rows.where("ms IS NOT NULL").select("host", "ms").collect():
        values.setdefault(host, []).append(ms)
    assert {r.host: r.n for r in found.collect()} == {h: len(v) for h, v in values.items()}
    for r in found.collect():
        v = sorted(values[r.host])
        for name, q in RANKS.items():
            low, high = bisect.bisect_left(v, r[name]) / len(v), bisect.bisect_right(v, r[name]) / len(v)
            assert low - 2 * sketches.RANK_ERROR <= q <= high + 2 * sketches.RANK_ERROR, (r, name)
    checked = sketches.judged(rows, "host", "ms", found, RANKS).collect()
    assert len(checked) == 3 and all(all(r[x] for x in RANKS) for r in checked)
    # any span: six hours only; and everything as one
    part = sketches.merged(kept.where("hour < 6"), [])
    assert part.first().n == rows.where("ms IS NOT NULL AND hour < 6").count()


def test_a_wrong_quantile_is_noticed(rows):
    found = sketches.quantiles(sketches.merged(sketches.quantile_sketches(rows, ["host"], "ms"), ["host"]), RANKS)
    off = found.withColumn("p50", F.col("p95"))
    assert [r.p50 for r in sketches.judged(rows, "host", "ms", off, RANKS).collect()] == [False] * 3


def test_no_rows_and_no_values(rows):
    assert sketches.quantile_sketches(rows.limit(0), ["host"], "ms").count() == 0
    assert sketches.quantile_sketches(rows.withColumn("ms", F.lit(None).cast("bigint")), ["host"], "ms").count() == 0


def test_distinct_and_overlap(spark, rows):
    seen = spark.range(60_000).selectExpr("array('a', 'b', 'c')[id % 3] AS asset", "id % 8 AS hour", "CAST(id % 20000 AS string) AS host")
    seen = seen.union(spark.range(3000).selectExpr("'small'", "id % 8", "CAST(id % 1000 AS string)")).union(spark.sql("SELECT 'none', 1L, CAST(NULL AS string)"))
    kept = io.store(sketches.distinct_sketches(seen, ["asset", "hour"], "host"))
    got = {r.asset: r.hosts for r in sketches.distinct(kept, ["asset"], "hosts").collect()}
    want = {r.asset: r.n for r in seen.groupBy("asset").agg(F.countDistinct("host").alias("n")).collect()}
    assert got["small"] == 1000 and got["none"] == 0  # exact below the number of entries
    assert all(abs(got[x] - want[x]) <= 4 / 2 ** 6 * want[x] for x in want)
    pairs = spark.createDataFrame([("a", "b"), ("small", "a"), ("none", "a"), ("small", "small"), ("gone", "a")], "a string, b string")
    found = {(r.a, r.b): (r.items_a, r.both, r.either) for r in sketches.overlap(sketches.distinct_sketches(seen, ["asset"], "host", 16), "asset", pairs, 16).collect()}
    hosts = {}
    for r in seen.where("host IS NOT NULL").collect():
        hosts.setdefault(r.asset, set()).add(r.host)
    hosts["none"] = set()
    assert found == {(a, b): (len(hosts[a]), len(hosts[a] & hosts[b]), len(hosts[a] | hosts[b])) for a, b in found} and len(found) == 4
