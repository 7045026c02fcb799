"""Header checks, cookies, redirect chains, failures, DNS and certificates on inline records."""

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import dns_tls, headers, html, http, report
from crawlsift.sources import io


def responses(spark, *maps):
    return spark.createDataFrame([(i, "h", m) for i, m in enumerate(maps)], "response_id bigint, host string, headers map<string,array<string>>")


FULL = {
    "Strict-Transport-Security": ["max-age=31536000; includeSubDomains"], "content-security-policy": ["default-src 'self'"],
    "X-CONTENT-TYPE-OPTIONS": ["nosniff"], "X-Frame-Options": ["SAMEORIGIN"], "Referrer-Policy": ["strict-origin"], "permissions-policy": ["camera=()"]}


def test_header_score(spark):
    audited = headers.audit(responses(spark, FULL, {"server": ["nginx"]}, {"strict-transport-security": ["max-age=3600"]},
                                      {"content-security-policy": ["frame-ancestors 'none'"]}, {"x-frame-options": [""]}))
    scores = {r.response_id: r for r in headers.score(audited).collect()}
    assert (scores[0].passed, scores[0].missing) == (6, 0) and scores[1].missing == 6
    checks = {(r.response_id, r.key): r for r in headers.checks(audited).collect()}
    assert checks[2, "strict-transport-security"].status == "warning" and "low (3600s)" in checks[2, "strict-transport-security"].note
    assert checks[3, "x-frame-options"].status == "pass" and not checks[3, "x-frame-options"].present
    assert checks[4, "x-frame-options"].status == "fail"


@pytest.mark.parametrize("key,value,status", [
    ("strict-transport-security", "includeSubDomains", "warning"), ("strict-transport-security", "max-age=15552000", "pass"),
    ("strict-transport-security", "max-age=" + "9" * 30, "pass"), ("content-security-policy", "script-src 'unsafe-eval'", "warning"),
    ("x-content-type-options", " NoSniff", "pass"), ("x-content-type-options", "other", "warning"), ("x-frame-options", "deny ", "pass"),
    ("x-frame-options", "ALLOW-FROM x", "warning"), ("referrer-policy", "Origin", "pass"), ("referrer-policy", "unsafe-url", "warning"),
    ("permissions-policy", "x", "pass")])
def test_header_rules(spark, key, value, status):
    row = headers.checks(headers.audit(responses(spark, {key.upper(): [value]}))).where(f"key = '{key}'").first()
    assert row.status == status


def test_cookies_are_masked(spark):
    rows = headers.cookies(responses(spark, {"Set-Cookie": [
        "session_token=secret; Path=/; Secure; HttpOnly; SameSite=Strict", "user_pref=dark; Path=/app; SameSite=Lax", "id=999; Secure",
        "flag", "empty=; Max-Age=60; path=/a; PATH=/b", "x=1; Expires=Wed, 01 Jan 2025; Domain=.e.com", ""]}, {"server": ["x"]}, {"set-cookie": []}))
    got = [(r.name, r.masked_value, r.secure, r.http_only, r.same_site, r.path, r.domain, r.expires) for r in rows.orderBy("cookie_no").collect()]
    dots = headers.COOKIE_MASK
    assert got == [
        ("session_token", dots, True, True, "Strict", "/", None, "Session"), ("user_pref", dots, False, False, "Lax", "/app", None, "Session"),
        ("id", dots, True, False, "Not set", "/", None, "Session"), ("flag", "", False, False, "Not set", "/", None, "Session"),
        ("empty", "", False, False, "Not set", "/b", None, "Max-Age: 60s"), ("x", dots, False, False, "Not set", "/", ".e.com", "Wed, 01 Jan 2025")]
    assert "secret" not in str(rows.collect())


def test_redirect_chains(spark):
    base = "https://s.com"
    hops = [("/200", 200, None), ("/redirect-1", 302, "/200"), ("/loop", 301, "/loop"), ("/a", 301, "/b"), ("/b", 302, "/a"),
            ("/bad", 307, "http://"), ("/304", 304, "/200"), ("/none", 301, None), ("/out", 308, "https://gone.com/x")]
    hops += [(f"/n{i}", 301, f"/n{i + 1}") for i in range(7)] + [("/n7", 200, None)]
    table = spark.createDataFrame([(base + u, c, None, loc, 10) for u, c, loc in hops], io.HOPS)
    starts = spark.createDataFrame([(base + u,) for u in ("/200", "/redirect-1", "/loop", "/a", "/bad", "/304", "/none", "/out", "/n0", "/n2")], "start_url string")
    got = {r.start_url[len(base):]: r for r in http.chains(starts, table).collect()}

    def seen(u):
        r = got[u]
        return r.final_url.removeprefix(base), r.status_code, len(r.hops), r.total_ms, r.error

    assert seen("/200") == ("/200", 200, 0, 10, None)
    assert seen("/redirect-1") == ("/200", 200, 1, 20, None)
    assert seen("/loop") == ("/loop", 301, 1, 10, f"Redirect loop detected at {base}/loop.")
    assert seen("/a") == ("/a", 302, 2, 20, f"Redirect loop detected at {base}/a.")
    assert seen("/bad") == ("/bad", 307, 0, 10, "Invalid redirect Location header: http://")
    assert seen("/304") == ("/304", 304, 0, 10, None) and seen("/none") == ("/none", 301, 0, 10, None)
    assert seen("/out") == ("https://gone.com/x", None, 1, 10, http.NO_RECORD)
    assert seen("/n0") == ("/n5", 301, 5, 60, "Maximum redirect limit of 5 exceeded.")
    assert seen("/n2") == ("/n7", 200, 5, 60, None)
    assert {r.url for r in report.failed(http.chains(starts, table)).collect()} == {base + u for u in ("/loop", "/a", "/bad", "/out", "/n0")}


def test_chains_normalise_and_count_each_url_once(spark):
    hops = [("http://ex.com/b", 301, "/c"), ("HTTP://EX.com:80/c", 302, "/d"), ("http://ex.com/d", 200, None)] * 3
    table = spark.createDataFrame([(u, c, None, loc, 10) for u, c, loc in hops], io.HOPS)
    starts = spark.createDataFrame([("http://EX.com/b",), ("http://ex.com",), (None,)], "start_url string")
    got = {r.start_url: (r.final_url, len(r.hops), r.total_ms, r.error) for r in http.chains(starts, table).collect()}
    assert got == {
        "http://EX.com/b": ("http://ex.com/d", 2, 30, None), "http://ex.com": ("http://ex.com/", 0, 0, http.NO_RECORD),
        None: (None, 0, 0, http.NO_RECORD)}


def test_status_guards_and_failures(spark):
    df = spark.createDataFrame([(c,) for c in (None, 0, 200, 299, 302, 404, 503, 600, 101)], "status_code int")
    got = {r.status_code: r.c for r in df.selectExpr("status_code", f"{http.status_category()} AS c").collect()}
    assert got == {None: "error", 0: "error", 200: "success", 299: "success", 302: "redirect", 404: "client_error", 503: "server_error",
                   600: "unknown", 101: "unknown"}
    sizes = spark.createDataFrame([(2000000, 10, 5), (None, 600000, 5), (None, 10, 1000), (10, 10, 5)], "declared_length bigint, content_length bigint, response_ms bigint")
    errors = [r.guard_error for r in http.guards(sizes, 500000, 150).collect()]
    assert "(2000000 bytes)" in errors[0] and "while streaming" in errors[1] and errors[2] == "Request timed out after 150ms." and errors[3] is None
    failed = spark.createDataFrame(
        [(i, "h.com", 443, c, m) for i, (c, m) in enumerate([("ENOTFOUND", None), ("ECONNREFUSED", None), ("ETIMEDOUT", None), ("CERT_HAS_EXPIRED", "x"), ("E", "bad certificate"), ("E", "y"), (None, None)])],
        "response_id bigint, host string, port int, error_code string, error_message string")
    assert [r["class"] for r in http.failures(failed).orderBy("response_id").collect()] == ["dns", "refused", "timeout", "tls", "tls", "other"]


def test_fingerprint_search_and_eligibility(spark):
    df = spark.createDataFrame(
        [(1, "h", "https://h/", "2.0", {"Server": ["MockServer/1.0"], "X-A": ["b", "c"]}, "text/html; charset=x"), (2, "h", "http://h/", None, {}, None)],
        "response_id bigint, host string, url string, http_version string, headers map<string,array<string>>, content_type string")
    got = [(r.protocol, r.http_version, r.server) for r in http.fingerprint(df).orderBy("response_id").collect()]
    assert got == [("HTTPS", "HTTP/2.0", "MockServer/1.0"), ("HTTP", "HTTP/1.1", "Not disclosed")]
    assert [(r.name, r.value) for r in http.search_headers(df, " B, C").collect()] == [("x-a", "b, c")]
    rows = html.eligibility(df).orderBy("response_id").collect()
    assert [r.is_html for r in rows] == [True, False] and "'unknown'" in rows[1].notice


def test_dns_records(spark):
    schema = "host string, type string, ord int, chunks array<string>, priority int, error string"
    df = spark.createDataFrame([
        ("A.com", "A", 1, ["2.2.2.2"], None, None), ("a.com", "A", 0, ["1.1.1.1"], None, None), ("a.com", "A", 0, ["1.1.1.1"], None, None),
        ("a.com", "MX", 0, ["m1"], 20, None), ("a.com", "MX", 1, ["m2"], 10, None), ("a.com", "TXT", 0, ["v=spf1 ", "-all"], None, None),
        ("b.com", "A", 0, [], None, "ETIMEOUT"), ("b.com", "AAAA", 0, [], None, "ENODATA"), ("c.com", "A", 0, [], None, "ENOTFOUND")], schema)
    rows = {r.host: r for r in dns_tls.assemble(df).collect()}
    a = rows["a.com"]
    assert (a.a, [(m.priority, m.exchange) for m in a.mx], a.txt, a.success) == (["1.1.1.1", "2.2.2.2"], [(10, "m2"), (20, "m1")], ["v=spf1 -all"], True)
    assert rows["b.com"].error == "A: ETIMEOUT" and rows["c.com"].error == dns_tls.NO_RECORDS


def test_certificates(spark):
    df = spark.sql("""
        SELECT 'h' AS host, named_struct('CN', 'h.com', 'O', 'Org') AS subject, named_struct('CN', 'CA', 'O', CAST(NULL AS string)) AS issuer,
          TIMESTAMP '2024-01-01 00:00:00' AS valid_from, to AS valid_to, 'DNS:h.com, dns:*.h.com,, IP:1.1.1.1' AS san, ok AS authorized,
          'TLSv1.3' AS protocol, named_struct('name', 'AES', 'version', 'TLSv1.3') AS cipher
        FROM VALUES (TIMESTAMP '2024-06-11 12:00:00', true), (TIMESTAMP '2024-05-31 23:00:00', false), (TIMESTAMP '2024-07-01 00:00:00', false) AS t(to, ok)""")
    rows = dns_tls.validity(df, "2024-06-01 00:00:00").orderBy("valid_to").collect()
    assert [(r.days_remaining, r.is_expired, r.status) for r in rows] == [(-1, True, "Expired"), (10, False, "Valid"), (30, False, "Untrusted / Invalid")]
    assert rows[0].sans == ["h.com", "*.h.com", "IP:1.1.1.1"] and (rows[0].subject, rows[0].issuer, rows[0].cipher) == ("h.com", "CA", "AES (TLSv1.3)")
    many = df.withColumn("san", F.lit(", ".join(f"DNS:n{i}" for i in range(25))))
    first = dns_tls.validity(many, "2024-06-01 00:00:00").first()
    assert len(first.sans) == 20 and first.total_sans == 25
