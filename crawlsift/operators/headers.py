"""Security headers and cookies of recorded responses, evaluated inside the response's row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions.plan import once
from crawlsift.functions.text import q, q_list, strip

# The checks with their wording.
MIN_HSTS_AGE = 15552000
SECURE_REFERRER_POLICIES = [
    "no-referrer", "no-referrer-when-downgrade", "origin", "origin-when-cross-origin", "same-origin", "strict-origin",
    "strict-origin-when-cross-origin"]
COOKIE_MASK = "••••••••"
CHECKS = [
    ("strict-transport-security", "Strict-Transport-Security (HSTS)",
     "Enforces secure HTTPS connections and prevents SSL stripping."),
    ("content-security-policy", "Content-Security-Policy (CSP)",
     "Restricts resource loading (scripts, styles, frames) to mitigate XSS and injection."),
    ("x-content-type-options", "X-Content-Type-Options", "Prevents MIME-sniffing away from the declared content-type."),
    ("x-frame-options", "X-Frame-Options", "Prevents framing/clickjacking attacks (DENY or SAMEORIGIN)."),
    ("referrer-policy", "Referrer-Policy", "Controls how much referrer information is included with requests."),
    ("permissions-policy", "Permissions-Policy", "Restricts browser features and APIs (camera, microphone, geolocation)."),
]
NOTES = {
    "hsts_missing": "HSTS is missing. Traffic could be vulnerable to downgrade attacks.",
    "hsts_no_age": "HSTS is present but lacks a valid max-age directive.",
    "hsts_low_1": "HSTS max-age is low (",
    "hsts_low_2": "s). Minimum 180 days (15552000s) recommended.",
    "hsts_ok": "Configured properly with adequate max-age.",
    "csp_missing": "No CSP header found. Page is more susceptible to Cross-Site Scripting (XSS).",
    "csp_unsafe": "CSP includes unsafe keywords (e.g. unsafe-inline or unsafe-eval).",
    "csp_ok": "Configured with restrictive policy directives.",
    "nosniff_missing": "Missing. Browsers may attempt to MIME-sniff response payloads.",
    "nosniff_ok": "Set to 'nosniff'.",
    "nosniff_odd_1": "Unusual value: '",
    "nosniff_odd_2": "'. Expected 'nosniff'.",
    "frame_csp": "Covered by CSP frame-ancestors directive.",
    "frame_missing": "Missing. Site may be vulnerable to clickjacking unless framed via CSP.",
    "frame_ok_1": "Protected against framing (",
    "frame_ok_2": ").",
    "frame_odd_1": "Value '",
    "frame_odd_2": "' may be deprecated or unsupported.",
    "referrer_missing": "Not specified. Browser defaults will be used.",
    "referrer_ok": "Policy: ",
    "referrer_odd": "Non-standard policy: ",
    "permissions_missing": "Not configured. Browser hardware APIs remain accessible by default.",
    "permissions_ok": "Browser features explicitly restricted.",
}


def header(name: str) -> str:
    """Value of a header in any spelling of its name: last spelling wins, repeats joined, empty counts as missing."""
    values = f"try_element_at(filter(map_entries(headers), e -> lower(e.key) = '{name}'), -1).value"
    return f"nullif(array_join({values}, ', '), '')"


def audit(responses: DataFrame) -> DataFrame:
    """Responses with `checks`, the six header checks with presence, value, status and note."""
    n = {k: q(v) for k, v in NOTES.items()}
    named = responses.selectExpr(
        "*", *[f"{header(key)} AS h_{key.replace('-', '_')}" for key, _, _ in CHECKS]
    ).withColumn("hsts_age", F.expr(r"regexp_extract(h_strict_transport_security, '(?i)max-age=([0-9]+)', 1)"))
    age = "CAST(hsts_age AS double)"
    low = f"{age} < {MIN_HSTS_AGE}"
    hsts, csp, sniff, frame, ref, perm = [f"h_{key.replace('-', '_')}" for key, _, _ in CHECKS]
    unsafe = f"(contains({csp}, {q(chr(39) + 'unsafe-inline' + chr(39))}) OR contains({csp}, {q(chr(39) + 'unsafe-eval' + chr(39))}))"
    sniff_ok = f"{strip(f'lower({sniff})')} = 'nosniff'"
    frame_up = strip(f"upper({frame})")
    frame_ok = f"{frame_up} IN ('DENY', 'SAMEORIGIN')"
    framed = f"coalesce({csp} RLIKE '(?i)frame-ancestors', false)"
    ref_ok = f"{strip(f'lower({ref})')} IN {q_list(SECURE_REFERRER_POLICIES)}"
    rules = [
        (f"CASE WHEN {hsts} IS NULL THEN 'fail' WHEN hsts_age = '' OR {low} THEN 'warning' ELSE 'pass' END",
         f"CASE WHEN {hsts} IS NULL THEN {n['hsts_missing']} WHEN hsts_age = '' THEN {n['hsts_no_age']}"
         f" WHEN {low} THEN concat({n['hsts_low_1']}, CAST(CAST({age} AS bigint) AS string), {n['hsts_low_2']}) ELSE {n['hsts_ok']} END"),
        (f"CASE WHEN {csp} IS NULL THEN 'fail' WHEN {unsafe} THEN 'warning' ELSE 'pass' END",
         f"CASE WHEN {csp} IS NULL THEN {n['csp_missing']} WHEN {unsafe} THEN {n['csp_unsafe']} ELSE {n['csp_ok']} END"),
        (f"CASE WHEN {sniff} IS NULL THEN 'fail' WHEN {sniff_ok} THEN 'pass' ELSE 'warning' END",
         f"CASE WHEN {sniff} IS NULL THEN {n['nosniff_missing']} WHEN {sniff_ok} THEN {n['nosniff_ok']}"
         f" ELSE concat({n['nosniff_odd_1']}, {sniff}, {n['nosniff_odd_2']}) END"),
        (f"CASE WHEN {frame} IS NULL AND {framed} THEN 'pass' WHEN {frame} IS NULL THEN 'fail' WHEN {frame_ok} THEN 'pass'"
         f" ELSE 'warning' END",
         f"CASE WHEN {frame} IS NULL AND {framed} THEN {n['frame_csp']} WHEN {frame} IS NULL THEN {n['frame_missing']}"
         f" WHEN {frame_ok} THEN concat({n['frame_ok_1']}, {frame_up}, {n['frame_ok_2']})"
         f" ELSE concat({n['frame_odd_1']}, {frame}, {n['frame_odd_2']}) END"),
        (f"CASE WHEN {ref} IS NULL THEN 'fail' WHEN {ref_ok} THEN 'pass' ELSE 'warning' END",
         f"CASE WHEN {ref} IS NULL THEN {n['referrer_missing']} WHEN {ref_ok} THEN concat({n['referrer_ok']}, {ref})"
         f" ELSE concat({n['referrer_odd']}, {ref}) END"),
        (f"CASE WHEN {perm} IS NULL THEN 'fail' ELSE 'pass' END",
         f"CASE WHEN {perm} IS NULL THEN {n['permissions_missing']} ELSE {n['permissions_ok']} END"),
    ]
    structs = ", ".join(
        f"named_struct('header', {q(label)}, 'key', '{key}', 'present', {value} IS NOT NULL, 'value', {value},"
        f" 'status', {status}, 'note', {note}, 'description', {q(text)})"
        for (key, label, text), value, (status, note) in zip(CHECKS, [hsts, csp, sniff, frame, ref, perm], rules, strict=True))
    return once(named, checks=f"array({structs})").select("response_id", "host", "checks")


def checks(audited: DataFrame) -> DataFrame:
    """One row per response and header check."""
    return audited.select("response_id", "host", F.inline_outer("checks"))


def score(audited: DataFrame) -> DataFrame:
    """Passed, warnings and missing per response, counted inside the row."""
    def n(status: str) -> str:
        return f"CAST(size(filter(checks, c -> c.status = '{status}')) AS bigint)"

    return audited.selectExpr(
        "response_id", f"{n('pass')} AS passed", f"{n('warning')} AS warnings", f"{n('fail')} AS missing",
        "CAST(size(checks) AS bigint) AS total")


def site_rollup(header_checks: DataFrame) -> DataFrame:
    """Responses by host, header and status, one column per status."""
    return header_checks.groupBy("host", "key").pivot("status", ["pass", "warning", "fail"]).agg(F.count(F.lit(1))).na.fill(0)


def cookies(responses: DataFrame) -> DataFrame:
    """One row per Set-Cookie with masked value and flags; the raw value is never emitted."""
    def last(name: str) -> str:
        found = f"try_element_at(filter(slice(parts, 2, size(parts)), p -> startswith(lower(p), '{name}=')), -1)"
        return strip(f"substr({found}, {len(name) + 2})")

    raw = "flatten(transform(filter(map_entries(headers), e -> lower(e.key) = 'set-cookie'), e -> e.value))"
    rows = (
        responses.selectExpr("response_id", "host", f"posexplode_outer({raw}) AS (cookie_no, raw)")
        .where("raw <> ''")
        .selectExpr("response_id", "host", "cookie_no", f"transform(split(raw, ';'), p -> {strip('p')}) AS parts"))
    has_value = "instr(parts[0], '=') > 0"
    flags = "transform(slice(parts, 2, size(parts)), p -> lower(p))"
    return rows.selectExpr(
        "response_id", "host", "cookie_no",
        f"CASE WHEN {has_value} THEN {strip('substring_index(parts[0], ' + q('=') + ', 1)')} ELSE parts[0] END AS name",
        f"CASE WHEN {has_value} AND {strip('substr(parts[0], instr(parts[0], ' + q('=') + ') + 1)')} <> ''"
        f" THEN '{COOKIE_MASK}' ELSE '' END AS masked_value",
        f"array_contains({flags}, 'secure') AS secure", f"array_contains({flags}, 'httponly') AS http_only",
        f"coalesce({last('samesite')}, 'Not set') AS same_site", f"coalesce({last('path')}, '/') AS path",
        f"{last('domain')} AS domain",
        f"coalesce(nullif({last('expires')}, ''), concat('Max-Age: ', nullif({last('max-age')}, ''), 's'), 'Session') AS expires")


def cookie_flags(cookie_rows: DataFrame) -> DataFrame:
    """Cookies per host with each protection flag."""
    return cookie_rows.groupBy("host").agg(
        F.count("*").alias("cookies"), F.count_if("http_only").alias("http_only"), F.count_if("secure").alias("secure"),
        F.count_if(F.col("same_site") != "Not set").alias("same_site_set"))


def cookie_cube(cookie_rows: DataFrame) -> DataFrame:
    """Cookies over every combination of the HttpOnly and Secure flags and their totals."""
    return cookie_rows.cube("http_only", "secure").agg(
        F.count("*").alias("cookies"), F.grouping_id().cast("bigint").alias("level"))
