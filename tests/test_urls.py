"""URL parsing, admission policy and address rules on inline cases."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.operators import urls


def column(spark, values, name="raw_url"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_normalize_accepts(spark):
    cases = {
        "example.com": ("https://example.com/", "https:", "example.com", 443),
        "http://example.com/path?foo=bar": ("http://example.com/path?foo=bar", "http:", "example.com", 80),
        "//example.com/page": ("https://example.com/page", "https:", "example.com", 443),
        "http://example.com:80": ("http://example.com/", "http:", "example.com", 80),
        "http://example.com:443": ("http://example.com:443/", "http:", "example.com", 443),
        "https://example.com:8080": ("https://example.com:8080/", "https:", "example.com", 8080),
        "https://example.com:8443": ("https://example.com:8443/", "https:", "example.com", 8443),
        "  HTTPS://EXAMPLE.com:443/a/../b/./c d  ": ("https://example.com/b/c%20d", "https:", "example.com", 443),
        "https://user:pw@example.com/?q='x'#f": ("https://user:pw@example.com/?q=%27x%27#f", "https:", "example.com", 443),
    }
    rows = urls.normalize(column(spark, cases)).collect()
    assert {r.raw_url: (r.url, r.protocol, r.hostname, r.port) for r in rows} == cases
    assert all(r.valid and r.error is None for r in rows)


def test_normalize_rejects_with_first_reason(spark):
    cases = {
        "ftp://ftp.example.com": "Unsupported protocol 'ftp:'", "file:///etc/passwd": "Unsupported protocol 'file:'",
        "javascript:alert(1)": "Unsupported protocol 'javascript:'", "": "URL is required", "   ": "URL cannot be empty",
        None: "URL is required", "http://example.com:22": "Port 22 is not permitted. Allowed ports: 80, 443, 8080, 8443.",
        "http://": "Invalid URL", "http://a b/": "Invalid URL", "https://a.com:99999/": "Invalid URL",
        "http://256.1.1.1/": "Invalid URL", "http://1.2.3.4.5/": "Invalid URL"}
    rows = urls.normalize(column(spark, cases)).collect()
    for r in rows:
        assert not r.valid and r.url is None
        assert cases[r.raw_url] in r.error
    by_reason = {r.error: r.targets for r in urls.rejections(urls.normalize(column(spark, cases))).collect()}
    assert sum(by_reason.values()) == len(cases) and by_reason[urls.REQUIRED] == 2


@pytest.mark.parametrize("host,quad", [
    ("2130706433", "127.0.0.1"), ("0x7f.1", "127.0.0.1"), ("0x7f.0x1", "127.0.0.1"), ("0xa.0xb", "10.0.0.11"),
    ("017700000001", "127.0.0.1"), ("127.1", "127.0.0.1"), ("10.0.0.1.", "10.0.0.1"), ("0xff", "0.0.0.255")])
def test_every_spelling_of_an_address_is_seen(spark, host, quad):
    row = urls.normalize(column(spark, [f"http://{host}/"])).first()
    assert row.hostname == quad


def test_resolution(spark):
    base = "https://h.com:8443/p/q/r.html?s=1#t"
    cases = {
        "/a": "https://h.com:8443/a", "b": "https://h.com:8443/p/q/b", "../c": "https://h.com:8443/p/c",
        "?q": "https://h.com:8443/p/q/r.html?q", "#f": "https://h.com:8443/p/q/r.html?s=1#f", "": "https://h.com:8443/p/q/r.html?s=1",
        "//cdn.x/y": "https://cdn.x/y", "https:z": "https://h.com:8443/p/q/z", "HTTP://Q.com": "http://q.com/", "./": "https://h.com:8443/p/q/",
        "..": "https://h.com:8443/p/", "../../../k": "https://h.com:8443/k", "mailto:a@b": "mailto:a@b", "\\w": "https://h.com:8443/w",
        "\\\\evil.com\\x": "https://evil.com/x", "a%2e%2e/b": "https://h.com:8443/p/q/a%2e%2e/b", "%2E%2e/b": "https://h.com:8443/p/b",
        "ü?ä#ö": "https://h.com:8443/p/q/%C3%BC?%C3%A4#%C3%B6", "http://": None, "https://x y/": None, " /t\tx\n": "https://h.com:8443/tx"}
    df = column(spark, cases, "href").withColumn("base", F.lit(base))
    got = {r.href: r.resolved_url for r in urls.resolve(df, "href", "base").collect()}
    assert got == cases


def test_file_urls_have_no_default_host(spark):
    got = column(spark, ["file:///etc/passwd", "file://host/x"]).selectExpr("i", U.parse_url("raw_url") + " AS p").select("p.host").collect()
    assert [r.host for r in got] == ["", "host"]


BLOCKED = [
    "127.0.0.1", "127.1.2.3", "10.0.0.1", "10.254.0.1", "172.16.0.1", "172.31.255.255", "192.168.1.1", "192.168.100.50",
    "169.254.169.254", "169.254.1.1", "0.0.0.0", "255.255.255.255", "::1", "0:0:0:0:0:0:0:1", "::ffff:127.0.0.1",
    "::ffff:192.168.1.1", "::ffff:169.254.169.254", "fc00::1", "fd12:3456::1", "fe80::1", "::", "::ffff:7f00:1", "not-an-ip",
    "", "256.1.1.1", ":::", "1::2::3", "100.64.0.1", "224.0.0.1", "198.51.100.1", None]
ALLOWED = ["172.32.0.1", "::ffff:8.8.8.8", "93.184.216.34", "8.8.8.8", "1.1.1.1", "2606:4700:4700::1111", "100.128.0.1", "fc::1"]


def test_address_rules(spark):
    df = column(spark, BLOCKED + ALLOWED, "ip")
    got = {r.ip: r.blocked for r in urls.classify_ips(df, urls.policy_cidrs(spark)).collect()}
    assert got == {**{ip: True for ip in BLOCKED}, **{ip: False for ip in ALLOWED}}


def test_address_ranges_against_brute_force(spark):
    nets = [ipaddress.ip_network(c) for c in urls.BLOCKED_CIDRS]
    ips = sorted({str(ipaddress.ip_address(int(n[edge]) + d)) for n in nets for edge in (0, -1) for d in (-1, 0, 1)
                  if 0 <= int(n[edge]) + d < 2**32})
    got = {r.ip: r.blocked for r in urls.classify_ips(column(spark, ips, "ip"), urls.policy_cidrs(spark)).collect()}
    assert got == {ip: any(ipaddress.ip_address(ip) in n for n in nets) for ip in ips}


def test_host_screening_and_admission(spark):
    hosts = ["localhost", "metadata.google.internal", "api.localhost", "printer.local", "a.b.local", "example.com", "local", "notlocal.com"]
    got = {r.hostname: r.blocked for r in urls.screen_hosts(column(spark, hosts, "hostname"), urls.policy_hosts(spark)).collect()}
    assert got == dict(zip(hosts, [True, True, True, True, True, False, False, False]))

    targets = column(spark, ["good.com", "good.com", "mixed.com", "gone.com", "10.0.0.1", "[::1]", "8.8.8.8", "x.local"], "host")
    answers = spark.createDataFrame(
        [("good.com", 0, "8.8.8.8"), ("mixed.com", 0, "8.8.8.8"), ("mixed.com", 1, "10.0.0.9"), ("mixed.com", 2, "127.0.0.1")],
        "host string, ord int, ip string")
    rows = {r.host: r for r in urls.admit_hosts(targets, answers, urls.policy_cidrs(spark), urls.policy_hosts(spark)).collect()}
    assert {h for h, r in rows.items() if r.admitted} == {"good.com", "8.8.8.8"}
    assert rows["mixed.com"].first_offender == "10.0.0.9" and "restricted IP 10.0.0.9" in rows["mixed.com"].error
    assert "no records" in rows["gone.com"].error and "private/internal" in rows["[::1]"].error
    assert "security reasons" in rows["x.local"].error


def test_leading_zeros_and_long_names(spark):
    hosts = spark.createDataFrame([("0x0000000000000007f.1",), ("000000000000000000177.0.0.1",), ("127.1",)], "h string")
    assert {r.v for r in hosts.selectExpr(f"{U.ipv4_value('h')} AS v").collect()} == {0x7F000001}
    got = spark.createDataFrame([("http://h.com:0000000008080/x",)], "u string").selectExpr(f"{U.parse_url('u')} AS p").first().p
    assert got.port == 8080 and got.url == "http://h.com:8080/x"
    deep = ".".join(["l"] * 150)
    names = spark.createDataFrame([(1, deep + ".bad.test"), (2, deep + ".good.test"), (3, "bad.test.other")], "page_id bigint, hostname string")
    policy = spark.createDataFrame([(".bad.test", "suffix"), (".l.bad", "suffix")], "pattern string, kind string")
    assert {r.page_id: r.blocked for r in urls.screen_hosts(names, policy).collect()} == {1: True, 2: False, 3: False}
