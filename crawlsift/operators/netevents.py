"""Browser network events: request lifecycle, statistics, pairing, console capture, inactivity sessions.

`events(session_id, request_id, seq, action, ts, url, method, resource_type, initiator, status, bytes, canceled)` with
actions start, response, complete and failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.functions.plan import lookup, once

# Caps, text lengths, tabs.
API_CAP, CONSOLE_CAP, CONSOLE_TEXT, QUERY_TEXT, NAME_TEXT = 50, 25, 200, 30, 40
API_TYPES = ["xhr", "fetch"]
CONSOLE_TYPES = ["error", "warning", "runtime_error"]
TABS = {
    "all": "true", "dynamic": "coalesce(is_dynamic, false)", "fetch": "resource_type IN ('xhr', 'fetch')",
    "js": "resource_type = 'script'", "css": "resource_type = 'stylesheet'", "img": "resource_type = 'image'",
    "error": "(status_code >= 400 OR status = 'Failed')"}

EVENT_TYPE = (
    "session_id string, request_id string, seq bigint, action string, ts timestamp, url string, method string,"
    " resource_type string, initiator struct<type:string,frames:array<struct<url:string,line:int>>>, status int,"
    " bytes bigint, canceled boolean")

LIFECYCLE = [
    "max_by(named_struct('ts', ts, 'url', url, 'method', method, 'type', lower(resource_type), 'initiator', initiator), seq)"
    " FILTER (WHERE action = 'start') AS started",
    "max_by(named_struct('status', status, 'type', lower(resource_type)), seq) FILTER (WHERE action = 'response') AS answered",
    "max_by(named_struct('ts', ts, 'action', action, 'bytes', bytes, 'canceled', canceled), seq)"
    " FILTER (WHERE action IN ('complete', 'failed')) AS finished"]


def shape(merged: DataFrame, *keys: str) -> DataFrame:
    """Turn merged start, response and end messages into one request row."""
    status = (
        "CASE WHEN finished.action = 'failed' THEN CASE WHEN finished.canceled THEN 'Canceled' ELSE 'Failed' END"
        " WHEN finished.action = 'complete' THEN CAST(coalesce(nullif(answered.status, 0), 200) AS string)"
        " WHEN answered IS NOT NULL THEN CAST(answered.status AS string) ELSE 'Pending' END")
    duration = (
        "CASE WHEN finished.action = 'complete' THEN CASE WHEN started.ts IS NULL THEN 0L ELSE"
        " greatest(1L, CAST(round((unix_micros(finished.ts) - unix_micros(started.ts)) / 1000D) AS bigint)) END END")
    size = "CASE finished.action WHEN 'failed' THEN 0L WHEN 'complete' THEN coalesce(finished.bytes, 0L) END"
    return merged.selectExpr(
        *keys, "started.ts AS start_ts", "started.url AS url", "started.method AS method",
        "CASE WHEN answered.type IS NOT NULL THEN answered.type WHEN started IS NOT NULL THEN coalesce(started.type, 'other') END AS resource_type",
        "started.initiator AS initiator", f"{status} AS status", f"try_cast({status} AS int) AS status_code",
        f"{size} AS bytes", f"{duration} AS duration_ms")


def lifecycle(events: DataFrame) -> DataFrame:
    """One row per request, merged from its messages in any order; the latest message of a kind wins."""
    merged = events.groupBy("session_id", "request_id").agg(*[F.expr(e) for e in LIFECYCLE])
    return shape(merged, "session_id", "request_id")


def request_name(url: str = "url", parsed: str = "parsed") -> str:
    """SQL text: last path segment or host with the start of the query; unparseable URLs are cut."""
    path = f"CASE WHEN {parsed}.host = '' THEN regexp_extract({parsed}.url, '^[^:]*:([^?#]*)', 1) ELSE {parsed}.path END"
    query = f"CASE WHEN {parsed}.query = '?' THEN '' ELSE substr({parsed}.query, 1, {QUERY_TEXT}) END"
    return (
        f"CASE WHEN {parsed}.url IS NULL THEN substr({url}, 1, {NAME_TEXT}) ELSE"
        f" coalesce(nullif(concat(coalesce(nullif(element_at(split({path}, '/'), -1), ''), {parsed}.host), {query}), ''), {url}) END")


def with_names(requests: DataFrame) -> DataFrame:
    """Add `name` and the initiator's label."""
    frame = "get(initiator.frames, 0)"
    script = (
        f"CASE WHEN coalesce({frame}.url, '') = '' THEN 'script' WHEN script_url.url IS NULL THEN element_at(split({frame}.url, '/'), -1)"
        f" ELSE coalesce(nullif(element_at(split(script_url.path, '/'), -1), ''), script_url.host) END")
    label = (
        f"CASE WHEN initiator IS NULL OR coalesce(initiator.type, '') = '' THEN 'Other' WHEN initiator.type = 'parser' THEN '(index)'"
        f" WHEN initiator.type = 'script' AND size(initiator.frames) > 0"
        f" THEN concat({script}, ':', coalesce(nullif({frame}.line, 0), 1)) WHEN initiator.type = 'script' THEN 'script'"
        f" ELSE concat(upper(substr(initiator.type, 1, 1)), substr(initiator.type, 2)) END")
    return (
        once(requests, parsed=U.parse_url("url"), script_url=U.parse_url("get(initiator.frames, 0).url"))
        .withColumn("name", F.expr(request_name())).withColumn("initiator_label", F.expr(label))
        .drop("parsed", "script_url"))


def by_initiator(requests: DataFrame) -> DataFrame:
    """Requests and bytes per initiator label."""
    return with_names(requests).groupBy("initiator_label").agg(
        F.count("*").alias("requests"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def mark_dynamic(requests: DataFrame, ready: DataFrame) -> DataFrame:
    """Add `is_dynamic`: started more than a second after the session's document was ready.

    `ready(session_id, ready_ts)` holds one row per session. The requests are read twice, so pass stored ones.
    """
    return lookup(requests, ready, ["session_id"], ["session_id", "request_id"]).withColumn(
        "is_dynamic", F.expr("coalesce(start_ts > ready_ts + INTERVAL 1 SECOND, false)")).drop("ready_ts")


def ready_times(events: DataFrame) -> DataFrame:
    """Ready time of each session: the end of its first document request."""
    docs = events.where("action = 'complete' AND lower(resource_type) = 'document'")
    return docs.groupBy("session_id").agg(F.min("ts").alias("ready_ts"))


def stats(requests: DataFrame) -> DataFrame:
    """Requests, dynamic requests, errors and bytes per session."""
    return requests.groupBy("session_id").agg(
        F.count("*").alias("total"), F.count_if("is_dynamic").alias("dynamic"),
        F.count_if(F.expr(TABS["error"])).alias("errors"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))


def tab(requests: DataFrame, name: str) -> DataFrame:
    """Requests of one tab."""
    return requests.where(TABS[name])


def tab_counts(requests: DataFrame) -> DataFrame:
    """Requests of every tab in one pass."""
    return requests.agg(*[F.count_if(F.expr(cond)).alias(name) for name, cond in TABS.items()])


def search(requests: DataFrame, needle: str) -> DataFrame:
    """Requests whose name or URL contains the needle in any case."""
    query = F.lit(needle.lower().strip())
    return with_names(requests).where(F.contains(F.lower("name"), query) | F.contains(F.lower("url"), query))


def newest(requests: DataFrame, n: int) -> DataFrame:
    """The `n` requests started last."""
    return requests.orderBy(F.col("start_ts").desc_nulls_last(), "session_id", "request_id").limit(n)


def status_band(status: str = "status", code: str = "status_code") -> str:
    """SQL text: band of a request's status."""
    return (
        f"CASE WHEN {code} BETWEEN 200 AND 299 THEN '2xx' WHEN {code} BETWEEN 300 AND 399 THEN '3xx'"
        f" WHEN {code} BETWEEN 400 AND 499 THEN '4xx' WHEN {code} >= 500 OR {status} = 'Failed' THEN '5xx' ELSE 'pending' END")


def bands_by_type(requests: DataFrame) -> DataFrame:
    """Requests by resource type, one column per status band."""
    return requests.withColumn("band", F.expr(status_band())).groupBy("resource_type").pivot(
        "band", ["2xx", "3xx", "4xx", "5xx", "pending"]).agg(F.count(F.lit(1))).na.fill(0)


def status_mix(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    """Requests per interval and status band."""
    return requests.where("start_ts IS NOT NULL").groupBy(
        F.window("start_ts", width).alias("w"), F.expr(status_band()).alias("band")
    ).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("window_start"), "band", "requests")


def durations(requests: DataFrame) -> DataFrame:
    """Completed requests per resource type with their time spread."""
    return requests.where("duration_ms IS NOT NULL").groupBy("resource_type").agg(
        F.count("*").alias("requests"), F.min("duration_ms").alias("fastest_ms"), F.max("duration_ms").alias("slowest_ms"),
        F.sum("duration_ms").alias("total_ms"))


def _first_per(df: DataFrame, keys: str, n: int, order: str = "seq") -> DataFrame:
    """First `n` rows per key; the filter becomes a group limit before the shuffle."""
    rank = F.expr(f"row_number() OVER (PARTITION BY {keys} ORDER BY {order})")
    return df.withColumn("n", rank).where(F.col("n") <= n)


def api_calls(events: DataFrame, cap: int = API_CAP) -> DataFrame:
    """First xhr and fetch calls of each session."""
    calls = events.where(F.col("action").eqNullSafe("start") & F.lower("resource_type").isin(API_TYPES))
    return _first_per(calls, "session_id", cap).select("session_id", "n", "seq", "request_id", "url", "method", "resource_type")


# The messages of all sessions are cut into so many spans of `seq`, so that no URL's messages are ordered in one task.
SPANS = 4096


def pair_fifo(events: DataFrame, cap: int | None = None) -> DataFrame:
    """Calls with the status of their response: a response answers the oldest open call of its URL in its session.

    All xhr and fetch calls take part, with `cap` the first of each session. Calls are +1 and responses -1: a response that
    met no open call pushes the running balance to a new minimum below zero, the others answer the calls in order. Balances
    are taken inside spans first and the spans of a URL are summed up, at most `SPANS` + 1 rows: a URL polled by a third of
    all events is as many groups as it has spans. Of messages with one `seq` calls come first. Calls without session or URL
    stay unanswered.
    """
    is_call = F.col("action").eqNullSafe("start") & F.lower("resource_type").isin(API_TYPES)
    calls = (events.where(is_call) if cap is None else api_calls(events, cap)).select("session_id", "url", "seq", "request_id", "method")
    answers = events.where(F.col("action").eqNullSafe("response") & F.lower("resource_type").isin(API_TYPES))
    both = calls.withColumns({"status": F.lit(None).cast("int"), "step": F.lit(1)}).unionByName(
        answers.selectExpr("session_id", "url", "seq", "request_id", "method", "status", "-1 AS step"))
    low, high = (events.agg(f("seq")).scalar() for f in (F.min, F.max))
    span = (F.col("seq") - low) / F.greatest(F.lit(1), (high - low) / SPANS)
    keys = ["session_id", "url", "span"]
    inside = "OVER (PARTITION BY session_id, url, span ORDER BY seq, step DESC, request_id)"
    sofar = inside[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = both.where("session_id IS NOT NULL AND url IS NOT NULL").withColumn("span", F.floor(span)).selectExpr(
        "*", f"sum(step) {sofar} AS balance", f"count_if(step = 1) {sofar} AS calls", f"count_if(step = -1) {sofar} AS answers"
    ).withColumn("least", F.expr(f"min(balance) {sofar}")).withColumn("least_before", F.expr(f"lag(least) {inside}"))
    earlier = "OVER (PARTITION BY session_id, url ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    spans = rows.groupBy(*keys).agg(
        F.sum("step").alias("net"), F.min("balance").alias("dip"), F.max("calls").alias("n_calls"), F.max("answers").alias("n_answers")
    ).selectExpr(
        *keys, "dip", f"coalesce(sum(net) {earlier}, 0) AS base", f"coalesce(sum(n_calls) {earlier}, 0) AS calls0",
        f"coalesce(sum(n_answers) {earlier}, 0) AS answers0"
    ).withColumn("floor0", F.expr(f"coalesce(min(base + dip) {earlier}, 0)"))
    placed = rows.join(spans.drop("dip"), keys).selectExpr(
        "*", "greatest(0, -least(floor0, base + least)) AS lost", "greatest(0, -least(floor0, coalesce(base + least_before, 0))) AS lost_before")
    matched = placed.where("step = -1 AND lost = lost_before").selectExpr(
        "session_id", "url", "answers0 + answers - lost AS k", "status", "seq AS answer_seq")
    numbered = placed.where("step = 1").selectExpr("session_id", "url", "seq", "request_id", "method", "calls0 + calls AS k")
    paired = numbered.join(matched, ["session_id", "url", "k"], "left")
    alone = calls.where("session_id IS NULL OR url IS NULL").selectExpr("*", "CAST(NULL AS int) AS status", "CAST(NULL AS bigint) AS answer_seq")
    return paired.drop("k").unionByName(alone).select("session_id", "seq", "request_id", "url", "method", "status", "answer_seq")


def console(messages: DataFrame, cap: int = CONSOLE_CAP) -> DataFrame:
    """First errors, warnings and runtime errors of each session, texts cut."""
    kept = messages.where(F.col("type").isin(CONSOLE_TYPES))
    return _first_per(kept, "session_id", cap).select(
        "session_id", "n", "type", F.substr("text", F.lit(1), F.lit(CONSOLE_TEXT)).alias("text"))


def sessions(events: DataFrame, key: str, gap_seconds: int = 300) -> DataFrame:
    """Activity sessions per key: a pause of `gap_seconds` or more closes a session.

    Events of one gap-wide time slot are always in the same session, so they are first aggregated per slot. Only slots
    are windowed: a key with a third of all events has as many rows as the covered time has slots.
    """
    us = gap_seconds * 1000000
    slots = events.groupBy(key, F.expr(f"unix_micros(ts) div {us}").alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    by_key = f"PARTITION BY {key} ORDER BY slot"
    fresh = f"coalesce(unix_micros(first_ts) - unix_micros(lag(last_ts) OVER ({by_key})) >= {us}, true)"
    numbered = slots.withColumn("fresh", F.expr(fresh)).withColumn(
        "no", F.expr(f"sum(CAST(fresh AS bigint)) OVER ({by_key} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    return numbered.groupBy(key, "no").agg(
        F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("events"))


