"""Execution traces: numbering, redaction, levels, group counts, text export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.text import q

# Cap per session, list cap, redaction patterns, category groups.
MAX_EVENTS, MAX_LIST = 200, 10
BEARER = r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*"
SECRET = r"(?i)(session_id|sessionid|auth_token|token)=[^;,\s]+"
BEARER_MASK, SECRET_MASK = "Bearer [REDACTED]", "$1=[MASKED]"
GROUPS = {"network": ["DNS", "TLS", "HTTP", "NETWORK"], "browser": ["BROWSER", "DOM"], "api": ["API"]}
ERROR_LEVELS, ERROR_CATEGORIES = ["error", "warn"], ["WARN", "ERROR"]


def redact(e: str) -> str:
    """SQL text: bearer tokens and session secrets masked."""
    return f"regexp_replace(regexp_replace({e}, {q(BEARER)}, '{BEARER_MASK}'), {q(SECRET)}, '{SECRET_MASK}')"


def _described(numbered: DataFrame) -> DataFrame:
    """Offset from the session start, level and redacted message of numbered events."""
    level = F.coalesce("level", F.expr("CASE upper(category) WHEN 'WARN' THEN 'warn' WHEN 'ERROR' THEN 'error' ELSE 'info' END"))
    return numbered.select(
        "session_id", F.col("id").cast("bigint").alias("id"), "seq", F.expr("unix_millis(ts)").alias("time"), "delta_ms",
        F.expr("concat('+', delta_ms div 1000, '.', lpad(delta_ms % 1000, 3, '0'), 's')").alias("delta_str"),
        F.upper("category").alias("category"), level.alias("level"), F.expr(redact("message")).alias("message"), "meta")


def sequence(trace: DataFrame, cap: int = MAX_EVENTS) -> DataFrame:
    """First `cap` events of each session with running id, offset from the session start and level.

    The filter on the row number becomes a group limit before the shuffle, so a session that holds a third of all
    events sends at most `cap` rows per input partition.
    """
    rank = F.expr("row_number() OVER (PARTITION BY session_id ORDER BY ts, seq)")
    kept = trace.withColumn("id", rank).where(F.col("id") <= cap)
    return _described(kept.withColumn("delta_ms", F.expr("unix_millis(ts) - min(unix_millis(ts)) OVER (PARTITION BY session_id)")))


def whole_sequence(trace: DataFrame, slot_ms: int = 600_000) -> DataFrame:
    """All events of each session, numbered and described like the first ones.

    Events are numbered inside slots of a session's time, and the counts of the slots before are added: a session that holds a
    third of all events is as many groups as it has slots.
    """
    slotted = trace.withColumn("slot", F.expr(f"unix_millis(ts) div {slot_ms}"))
    slots = slotted.groupBy("session_id", "slot").agg(F.count("*").alias("n"), F.min(F.expr("unix_millis(ts)")).alias("first"))
    over = "OVER (PARTITION BY session_id ORDER BY slot NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = slots.selectExpr(
        "session_id AS of_session", "slot AS of_slot", f"coalesce(sum(n) {over}, 0) AS before", "min(first) OVER (PARTITION BY session_id) AS start")
    inside = slotted.withColumn("place", F.expr("row_number() OVER (PARTITION BY session_id, slot ORDER BY ts, seq)"))
    joined = inside.join(starts, F.col("session_id").eqNullSafe(F.col("of_session")) & F.col("slot").eqNullSafe(F.col("of_slot")))
    return _described(joined.withColumn("id", F.expr("before + place")).withColumn("delta_ms", F.expr("unix_millis(ts) - start")))


def redacted(df: DataFrame, col: str) -> DataFrame:
    """Add `redacted` and whether it differs from the text."""
    return df.withColumn("redacted", F.expr(redact(col))).withColumn("masked", F.col("redacted") != F.col(col))


def sanitize_meta(trace: DataFrame) -> DataFrame:
    """Metadata as rows: redacted strings, numbers, booleans and lists cut to ten; anything else is dropped, and so is
    metadata that is no JSON object."""
    entries = trace.withColumn("m", F.expr(
        "CASE WHEN schema_of_variant(try_parse_json(meta)) LIKE 'OBJECT%' THEN CAST(try_parse_json(meta) AS map<string, variant>) END")).select(
        "session_id", "seq", F.explode_outer("m").alias("key", "v")
    ).where("v IS NOT NULL").withColumn("kind", F.expr("schema_of_variant(v)"))
    value = (
        f"CASE WHEN kind = 'STRING' THEN {redact('CAST(v AS string)')}"
        f" WHEN kind LIKE 'ARRAY%' THEN to_json(slice(CAST(v AS array<variant>), 1, {MAX_LIST})) ELSE CAST(v AS string) END")
    scalar = "kind IN ('STRING', 'BIGINT', 'DOUBLE', 'FLOAT', 'BOOLEAN') OR kind LIKE 'DECIMAL%' OR kind LIKE 'ARRAY%'"
    return entries.where(scalar).select("session_id", "seq", "key", F.expr(value).alias("value"))


def in_group(group: str) -> str:
    """SQL text: whether an event belongs to a group; groups overlap."""
    if group == "error":
        levels, cats = (", ".join(q(v) for v in vs) for vs in (ERROR_LEVELS, ERROR_CATEGORIES))
        return f"(level IN ({levels}) OR upper(category) IN ({cats}))"
    return f"upper(category) IN ({', '.join(q(c) for c in GROUPS[group])})"


def group_counts(sequenced: DataFrame) -> DataFrame:
    """Events of each session, all and by group."""
    return sequenced.groupBy("session_id").agg(
        F.count("*").alias("all"), *[F.count_if(F.expr(in_group(g))).alias(g) for g in (*GROUPS, "error")])


def filter_group(sequenced: DataFrame, group: str) -> DataFrame:
    """Events of one group."""
    return sequenced.where(in_group(group))


def text_lines(sequenced: DataFrame) -> DataFrame:
    """Events as lines `+0.123s [CAT] message`."""
    return sequenced.select(
        "session_id", "id", F.concat("delta_str", F.lit(" ["), "category", F.lit("] "), "message").alias("line"))
