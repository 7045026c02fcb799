"""Plan helpers."""

import pytest
from pyspark.sql import functions as F

from crawlsift.functions import plan


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_keys", [1, 3, 1000])
def test_lookup_is_a_plain_join(spark, monkeypatch, how, hot_keys):
    monkeypatch.setattr(plan, "HOT_KEYS", hot_keys)
    # one key holds a third of the rows, some have no partner, some are NULL
    rows = spark.range(900).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('k', id % 40) END AS k", "CAST(id % 2 AS int) AS part")
    table = spark.range(30).selectExpr("concat('k', id) AS k", "CAST(id % 2 AS int) AS part", "id * 10 AS a", "CASE WHEN id > 5 THEN 'x' END AS b")
    table = table.unionByName(spark.sql("SELECT 'hot' AS k, 1 AS part, 7L AS a, 'h' AS b"))
    got = plan.lookup(rows, table, ["k", "part"], ["id"], how)
    want = rows.join(table, ["k", "part"], how).select(got.columns)
    assert got.orderBy("id").collect() == want.orderBy("id").collect()


@pytest.mark.parametrize(("key", "partner"), [("'hot'", "hot"), ("'hot'", "other"), ("NULL", "hot")])
def test_lookup_spreads_the_hot_key(spark, key, partner):
    rows = spark.range(20000).selectExpr("id", f"CASE WHEN id % 3 = 0 THEN {key} ELSE concat('k', id) END AS k")
    table = spark.sql(f"SELECT '{partner}' AS k, 1 AS a UNION ALL SELECT '{partner}', 1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = plan.lookup(rows, table, ["k"], ["id"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and max(sizes) < 20000 / 8 * 1.3
        assert out.where("a = 1").count() == (6667 if (key, partner) == ("'hot'", "hot") else 0)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_once_evaluates_before_filters(spark):
    df = plan.once(spark.range(10), v="md5(CAST(id AS string))").where("v > 'a' AND v < 'z'")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
