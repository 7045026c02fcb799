"""Recorded DNS answers and certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Quiet resolver codes, list length of alternative names, wording.
QUIET = ["ENODATA", "ENOTFOUND"]
SAN_CAP = 20
NO_RECORDS = "No DNS records found."


def assemble(answers: DataFrame) -> DataFrame:
    """One row per host with its records by type, success flag and error.

    `answers(host, type, ord, chunks, priority, error)`. Repeated observations collapse before anything is collected,
    so the lists hold what a host publishes, not how often it was seen.
    """
    seen = answers.groupBy(
        F.lower(F.trim("host")).alias("host"), "type", F.expr("CASE WHEN size(chunks) > 0 THEN array_join(chunks, '') END").alias("value"), "priority", "error"
    ).agg(F.min("ord").alias("ord"))

    def values(kind: str, fields: str):
        return F.expr(
            f"transform(array_sort(collect_list(named_struct('ord', ord, 'value', value))"
            f" FILTER (WHERE type = '{kind}' AND value IS NOT NULL)), r -> r.value) AS {fields}")

    loud = f"type IN ('A', 'AAAA') AND error IS NOT NULL AND error NOT IN ('{QUIET[0]}', '{QUIET[1]}')"
    records = seen.groupBy("host").agg(
        values("A", "a"), values("AAAA", "aaaa"), values("CNAME", "cname"),
        F.expr("transform(array_sort(collect_list(named_struct('priority', priority, 'ord', ord, 'exchange', value))"
               " FILTER (WHERE type = 'MX' AND value IS NOT NULL)), r -> named_struct('priority', r.priority, 'exchange', r.exchange)) AS mx"),
        values("TXT", "txt"),
        F.expr(f"array_join(array_sort(collect_set(concat(type, ': ', error)) FILTER (WHERE {loud})), '; ') AS errors"),
        F.count("value").alias("n"))
    return records.selectExpr(
        "host", "a", "aaaa", "cname", "mx", "txt", "n > 0 AS success",
        f"CASE WHEN n > 0 THEN NULL WHEN errors <> '' THEN errors ELSE '{NO_RECORDS}' END AS error")


def record_pivot(answers: DataFrame) -> DataFrame:
    """Answers per host, one column per record type."""
    return answers.where("size(chunks) > 0").groupBy(F.lower(F.trim("host")).alias("host")).pivot(
        "type", ["A", "AAAA", "CNAME", "MX", "TXT"]).agg(F.count(F.lit(1))).na.fill(0)


def validity(certs: DataFrame, as_of: str, listed: int = SAN_CAP) -> DataFrame:
    """Days remaining, status, names and the first `listed` alternative names of each certificate as of a
    given UTC time; `total_sans` counts all."""
    now = f"unix_micros(TIMESTAMP '{as_of} UTC')"
    sans = "filter(transform(split(san, ','), s -> regexp_replace(btrim(s, ' \\t\\r\\n'), '(?i)^DNS:', '')), s -> s <> '')"
    return (
        certs.withColumn("left_us", F.expr(f"unix_micros(valid_to) - {now}"))
        .withColumn("names", F.expr(f"coalesce({sans}, CAST(array() AS array<string>))"))
        .selectExpr(
            "host", "coalesce(nullif(subject.CN, ''), nullif(subject.O, ''), 'Unknown') AS subject",
            "coalesce(nullif(issuer.O, ''), nullif(issuer.CN, ''), 'Unknown') AS issuer",
            "coalesce(concat(cipher.name, ' (', cipher.version, ')'), 'Unknown') AS cipher", "protocol", "authorized",
            "valid_from", "valid_to", "CAST(floor(left_us / 86400000000D) AS bigint) AS days_remaining",
            "coalesce(left_us < 0, false) AS is_expired",
            "CASE WHEN authorized THEN 'Valid' WHEN left_us < 0 THEN 'Expired' ELSE 'Untrusted / Invalid' END AS status",
            f"slice(names, 1, {listed}) AS sans", "CAST(size(names) AS bigint) AS total_sans"))


def sans(valid: DataFrame) -> DataFrame:
    """One row per alternative name kept."""
    return valid.select("host", F.posexplode_outer("sans").alias("pos", "san")).where("san IS NOT NULL")


def expiring(valid: DataFrame, days: int = 30) -> DataFrame:
    """Certificates per issuer that end within `days`, with those already expired."""
    return valid.where(F.col("days_remaining") < days).groupBy("issuer").agg(
        F.count("*").alias("certificates"), F.count_if("is_expired").alias("expired"),
        F.min("days_remaining").alias("soonest_days"))
