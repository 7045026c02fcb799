"""Recorded HTTP exchanges: redirect chains, status classes, guards, failures, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.functions.plan import lookup, once
from crawlsift.functions.text import q
from crawlsift.sources.io import store

# Limits and redirect codes.
MAX_REDIRECTS, MAX_BYTES, TIMEOUT_MS, GOOD_MS = 5, 5 * 1024 * 1024, 10000, 800
REDIRECT_CODES = [301, 302, 303, 307, 308]
# Wording of errors.
TOO_MANY_1, TOO_MANY_2 = "Maximum redirect limit of ", " exceeded."
BAD_LOCATION, LOOP_1, LOOP_2 = "Invalid redirect Location header: ", "Redirect loop detected at ", "."
NO_RECORD = "No recorded response."


def edges(hops: DataFrame) -> DataFrame:
    """Resolve each recorded response to its next hop, one row per normalised URL.

    Of several records of a URL the one with the highest status code counts, then the last by location, text and time.
    """
    redirect = f"status_code IN ({', '.join(map(str, REDIRECT_CODES))}) AND coalesce(location, '') <> ''"
    found = once(once(hops, base=U.parse_url("from_url")), target=U.resolve_url("location", "base") + ".url").selectExpr(
        "coalesce(base.url, from_url) AS from_url",
        "named_struct('status_code', status_code, 'location', location, 'status_text', status_text,"
        f" 'response_ms', CAST(response_ms AS bigint), 'is_redirect', {redirect}, 'next_url', CASE WHEN {redirect} THEN target END,"
        " 'host', base.host) AS hop")
    return found.groupBy("from_url").agg(F.max("hop").alias("hop")).selectExpr("from_url", "hop.*")


def segments(step: DataFrame, length: int) -> DataFrame:
    """(node, path): up to `length` hops from every URL that redirects, by pointer doubling.

    A segment of hops ends where another one may begin. Joining every open segment to the one that begins at its end doubles its
    length, so a path of n hops takes log2(n) rounds, whatever the number of paths. Segments that have ended, and rounds in which
    none is open, cost nothing more; cycles go round until the length is reached.
    """
    now = store(step.where("is_redirect AND next_url IS NOT NULL").selectExpr(
        "from_url AS node", "next_url AS end", "true AS open",
        "array(named_struct('from_url', from_url, 'to_url', next_url, 'status_code', status_code, 'status_text', status_text,"
        " 'location', location, 'response_ms', response_ms)) AS path"))
    reached = 1
    while reached < length and not now.where("open").isEmpty():
        # a closed segment has a key of its own, which matches nothing and spreads evenly
        left = now.withColumn("key", F.expr("CASE WHEN open THEN end ELSE concat(' ', node) END"))
        right = now.selectExpr("node AS key", "end AS end2", "open AS open2", "path AS path2")
        now = store(left.join(right, "key", "left").selectExpr(
            "node", "coalesce(end2, end) AS end", "coalesce(open2, false) AS open",
            f"CASE WHEN path2 IS NULL THEN path ELSE slice(concat(path, path2), 1, {length}) END AS path"))
        reached *= 2
    return now.select("node", "path")


def chains(starts: DataFrame, hops: DataFrame, max_redirects: int = MAX_REDIRECTS, refused: DataFrame | None = None) -> DataFrame:
    """Follow every start URL to its end: `start_url, final_url, status_code, error, total_ms, hops`.

    Paths come from `segments`; a path that comes back to a URL has as many different URLs as hops before its loop. Ends, where a
    third of all chains may meet, are looked up by a join that is even for hot keys. A looping hop is listed, the hop beyond the
    limit is not. Start URLs are reported as given and followed in their normalised form.

    `refused(host, error)` lists hosts that are not admitted: a chain that reaches one, at its start or by a hop, ends there
    unfetched with that error; the hop to it is listed.
    """
    step = edges(hops)
    if refused is not None:
        # one row per host; records of such a host are as if they were not there
        refused = store(refused.where("host IS NOT NULL AND error IS NOT NULL").groupBy("host").agg(F.min("error").alias("refusal")))
        step = lookup(store(step), refused, ["host"], ["from_url"]).where("refusal IS NULL").drop("refusal")
    step = store(step)
    begun = once(starts.select("start_url").distinct(), first=f"coalesce({U.parse_url('start_url')}.url, start_url)")
    joined = begun.join(segments(step, max_redirects + 1), F.col("first") == F.col("node"), "left")
    seen = once(joined, urls="concat(array(first), coalesce(transform(path, h -> h.to_url), array()))").withColumn(
        "before_loop", F.expr("size(array_distinct(urls))"))
    loops = f"before_loop < size(urls) AND before_loop <= {max_redirects}"
    placed = seen.withColumn("loops", F.expr(loops)).withColumn(
        "n", F.expr(f"CASE WHEN loops THEN before_loop ELSE least(size(urls) - 1, {max_redirects}) END"))
    listed = "CASE WHEN n > 0 THEN slice(path, 1, n) ELSE array() END"
    state = placed.selectExpr(
        "start_url", "get(urls, n) AS cur", "loops", "n", "get(path, n - 1).status_code AS last_code",
        f"transform({listed}, (h, i) -> named_struct('hop', i + 1, 'from_url', h.from_url, 'to_url', h.to_url, 'status_code', h.status_code,"
        " 'status_text', h.status_text, 'location', h.location, 'response_ms', h.response_ms)) AS hops")
    if refused is not None:
        state = once(state, host=U.parse_url("cur") + ".host")
        state = lookup(store(state), refused, ["host"], ["start_url"])
    else:
        state = state.withColumn("refusal", F.lit(None).cast("string"))
    ends = step.selectExpr("from_url AS cur", "status_code AS code", "location", "response_ms", "is_redirect")
    ended = lookup(store(state), ends, ["cur"], ["start_url"])
    error = (
        f"CASE WHEN loops THEN concat({q(LOOP_1)}, cur, {q(LOOP_2)}) WHEN refusal IS NOT NULL THEN refusal"
        f" WHEN code IS NULL THEN {q(NO_RECORD)} WHEN NOT is_redirect THEN NULL"
        f" WHEN n = {max_redirects} THEN concat({q(TOO_MANY_1)}, '{max_redirects}', {q(TOO_MANY_2)})"
        f" ELSE concat({q(BAD_LOCATION)}, location) END")
    return ended.selectExpr(
        "start_url", "cur AS final_url", "CASE WHEN loops THEN last_code WHEN refusal IS NULL THEN code END AS status_code", f"{error} AS error",
        "aggregate(hops, 0L, (t, h) -> t + coalesce(h.response_ms, 0L))"
        " + CASE WHEN loops OR refusal IS NOT NULL THEN 0L ELSE coalesce(response_ms, 0L) END AS total_ms", "hops")


def chain_hops(chain_rows: DataFrame) -> DataFrame:
    """One row per hop of every chain, with the change in latency from the hop before."""
    rows = chain_rows.selectExpr(
        "start_url",
        "inline_outer(transform(hops, (h, i) -> named_struct('hop', h.hop, 'from_url', h.from_url, 'to_url', h.to_url,"
        " 'status_code', h.status_code, 'location', h.location, 'response_ms', h.response_ms,"
        " 'slower_ms', h.response_ms - get(hops, i - 1).response_ms)))")
    return rows.where("hop IS NOT NULL")


def chain_timing(chain_rows: DataFrame) -> DataFrame:
    """Hop count, slowest hop and total time per chain."""
    return chain_rows.selectExpr(
        "start_url", "CAST(size(hops) AS bigint) AS hop_count",
        "aggregate(hops, 0L, (t, h) -> t + h.response_ms) AS redirect_ms",
        "array_max(transform(hops, h -> h.response_ms)) AS slowest_hop_ms", "total_ms")


def chain_errors(chain_rows: DataFrame) -> DataFrame:
    """Chains by outcome."""
    kind = (
        F.when(F.col("error").isNull(), F.lit("ok")).when(F.startswith("error", F.lit(LOOP_1)), F.lit("loop"))
        .when(F.startswith("error", F.lit(TOO_MANY_1)), F.lit("hop_limit"))
        .when(F.startswith("error", F.lit(BAD_LOCATION)), F.lit("bad_location")).otherwise(F.lit("no_record")))
    return chain_rows.groupBy(kind.alias("outcome")).agg(
        F.count("*").alias("chains"), F.sum(F.size("hops")).alias("hops"), F.max(F.size("hops")).cast("bigint").alias("longest"))


def status_category(code: str = "status_code") -> str:
    """SQL text: category of a status code."""
    return (
        f"CASE WHEN coalesce({code}, 0) = 0 THEN 'error' WHEN {code} BETWEEN 200 AND 299 THEN 'success'"
        f" WHEN {code} BETWEEN 300 AND 399 THEN 'redirect' WHEN {code} BETWEEN 400 AND 499 THEN 'client_error'"
        f" WHEN {code} BETWEEN 500 AND 599 THEN 'server_error' ELSE 'unknown' END")


def status_categories(responses: DataFrame) -> DataFrame:
    """Responses by status category."""
    return responses.groupBy(F.expr(status_category()).alias("category")).agg(F.count("*").alias("responses"))


def status_labels(responses: DataFrame) -> DataFrame:
    """Label and latency band of each response."""
    label = (
        "CASE WHEN status_code >= 500 THEN 'SERVER ERROR' WHEN status_code >= 400 THEN 'CLIENT ERROR'"
        " WHEN status_code >= 300 THEN 'REDIRECT' ELSE 'ONLINE' END")
    return responses.selectExpr(
        "response_id", "host", "status_code", f"{label} AS label",
        f"CASE WHEN response_ms < {GOOD_MS} THEN 'good' ELSE 'slow' END AS latency_band", "response_ms")


def latency_by_host(responses: DataFrame) -> DataFrame:
    """Latency spread per host from a mergeable sketch, exact counts of each band."""
    return responses.groupBy("host").agg(
        F.count("*").alias("responses"), F.count_if(F.col("response_ms") < GOOD_MS).alias("good"),
        F.min("response_ms").alias("fastest_ms"), F.max("response_ms").alias("slowest_ms"),
        F.percentile_approx("response_ms", 0.5, 10000).alias("median_ms"))


def guards(responses: DataFrame, max_bytes: int = MAX_BYTES, max_ms: int = TIMEOUT_MS) -> DataFrame:
    """Add `guard_error`: declared size, received size, then time over the limit."""
    error = (
        f"CASE WHEN declared_length > {max_bytes} THEN concat('Response size (', declared_length,"
        f" ' bytes) exceeds maximum allowed limit of {max_bytes} bytes.')"
        f" WHEN content_length > {max_bytes} THEN 'Response exceeded maximum size limit of {max_bytes} bytes while streaming.'"
        f" WHEN response_ms > {max_ms} THEN 'Request timed out after {max_ms}ms.' END")
    return responses.withColumn("guard_error", F.expr(error))


# Network error codes with their class.
TLS_CODES = ["CERT_HAS_EXPIRED", "UNABLE_TO_VERIFY_LEAF_SIGNATURE"]


def failures(responses: DataFrame) -> DataFrame:
    """Failed requests with class and message."""
    tls = f"error_code IN ('{TLS_CODES[0]}', '{TLS_CODES[1]}') OR contains(error_message, 'certificate')"
    kind = (
        "CASE error_code WHEN 'ENOTFOUND' THEN 'dns' WHEN 'ECONNREFUSED' THEN 'refused' WHEN 'ETIMEDOUT' THEN 'timeout'"
        f" ELSE CASE WHEN {tls} THEN 'tls' ELSE 'other' END END")
    message = (
        "CASE class WHEN 'dns' THEN concat('DNS resolution failed for ', host, '. Host does not exist.')"
        " WHEN 'refused' THEN concat('Connection refused by host at ', host, ':', port, '.')"
        " WHEN 'timeout' THEN concat('Connection timed out while connecting to ', host, '.')"
        " WHEN 'tls' THEN concat('TLS Certificate validation failed: ', error_message)"
        " ELSE concat('Network request error: ', error_message) END")
    return responses.where("error_code IS NOT NULL").withColumn("class", F.expr(kind)).withColumn("message", F.expr(message))


def failure_classes(responses: DataFrame) -> DataFrame:
    """Failed requests by class."""
    return failures(responses).groupBy("class").agg(F.count("*").alias("failures"))


def fingerprint(responses: DataFrame) -> DataFrame:
    """Scheme, HTTP version and server of each response."""
    server = "nullif(array_join(try_element_at(filter(map_entries(headers), e -> lower(e.key) = 'server'), -1).value, ', '), '')"
    return responses.selectExpr(
        "response_id", "host", "CASE WHEN startswith(url, 'https:') THEN 'HTTPS' ELSE 'HTTP' END AS protocol",
        "concat('HTTP/', coalesce(nullif(http_version, ''), '1.1')) AS http_version",
        f"coalesce({server}, 'Not disclosed') AS server")


def server_census(responses: DataFrame) -> DataFrame:
    """Responses by server, scheme and HTTP version."""
    return fingerprint(responses).groupBy("server", "protocol", "http_version").agg(F.count("*").alias("responses"))


def search_headers(responses: DataFrame, needle: str) -> DataFrame:
    """Headers whose name or value contains the needle in any case."""
    query = q(needle.lower().strip())
    rows = responses.selectExpr(
        "response_id", "inline_outer(transform(map_entries(headers), e -> named_struct('name', lower(e.key),"
        " 'value', array_join(e.value, ', '))))")
    return rows.where(f"contains(name, {query}) OR contains(lower(value), {query})")
