"""Recorded crawl tables derived from the given `pages` and `events`.

The given pages hold only HTML and a URL. What else a crawler records (headers, redirects, DNS answers, certificates,
traces, browser events) is derived from them row by row, so every table grows with its source. The expressions are
plain SQL that Spark and the checking engine read alike; the few places where the dialects differ are passed in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.sources.io import read_pages

HOST = "split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1)"
AS_OF = "2024-06-01 00:00:00"
AS_OF_S = 1717200000


def _when(k: int, rest: dict[int, str]) -> str:
    return f"CASE page_id % {k} " + " ".join(f"WHEN {r} THEN {text}" for r, text in rest.items()) + " ELSE '' END"


N = "CAST(page_id AS STRING)"
_HEAD = " || ".join([
    _when(3, {1: "'<link rel=\"canonical\" href=\"' || url || '\">'", 2: "'<link rel=\"CANONICAL\" href=\" /canonical/page \">'"}),
    _when(4, {1: "'<meta name=\"Description\" content=\"Short text\">'",
              2: "'<meta name=\"description\" content=\"' || repeat('A page about things. ', 4) || '\">'",
              3: "'<meta content=\"' || repeat('A page about things. ', 9) || '\" name=description>'"}),
    _when(8, {0: "'<meta property=\"og:description\" content=\"Described for sharing only, not for search engines\">'"}),
    _when(5, {0: "'<meta name=\"robots\" content=\"noindex, nofollow\">'", 1: "'<meta name=\"keywords\" content=\"a, b &amp; c\">'"}),
    _when(2, {0: "'<meta name=\"viewport\" content=\"width=device-width\">'"}),
    _when(2, {0: "'<link rel=\"stylesheet\" href=\"/css/site.css\"><LINK REL=''Stylesheet'' HREF=''theme.css?v=1''>'",
              1: "'<link rel=stylesheet href=https://cdn.example.net/all.css>'"}),
    _when(3, {0: "'<link rel=\"shortcut icon\" href=\"/favicon.ico\">'", 1: "'<link rel=icon href=//cdn.example.com/icon.png>'",
              2: "'<link rel=\"apple-touch-icon\" href=\"/touch\">'"}),
    _when(4, {0: "'<meta property=\"og:title\" content=\"Title ' || " + N + " || '\"><meta property=\"OG:Image\" content=\"https://img.example.com/' || " + N + " || '.jpg\">'",
              1: "'<meta property=\"og:title\" content=\"First\"><meta property=\"og:type\" content=\"\"><meta property=\"og:title\" content=\" Last \">'"}),
    _when(3, {0: "'<meta name=\"twitter:card\" content=\"summary\"><meta name=\"twitter:title\" content=\"Tweet ' || " + N + " || '\">'",
              1: "'<meta name=\"twitter:site\" content=\"@site\">'"}),
    _when(4, {0: "'<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@type\":\"Article\",\"name\":\"Page ' || " + N + " || '\"}</script>'",
              1: "'<script type=\"application/ld+json\">{\"@type\": \"Broken\",,}</script>'",
              2: "'<script type=\"Application/LD+JSON\"> {\"@type\":\"Product\",\"offers\":{\"price\":1.5}} </script><script type=\"application/ld+json\">{\"name\":\"untyped\"}</script>'"}),
    _when(7, {1: "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"a\":1}</script>'", 2: "'<script>window.__NUXT__={}</script>'",
              3: "'<script>window.__INITIAL_STATE__={}</script>'"}),
    "'<script src=\"/js/app.js\"></script>'",
    _when(2, {1: "'<script defer src=\"https://cdn.example.net/lib/v2/../lib.min.js\"></script>'"}),
    _when(6, {0: "'<script type=\"importmap\">{}</script>'"}),
])
_BODY = " || ".join([
    _when(2, {0: "'<header id=\"main-header\"><nav class=\"navbar primary-nav\"><span>Menu</span></nav></header>'"}),
    _when(10, {0: "'<h1>Second <i>title</i></h1>'"}),
    _when(3, {1: "'<h2>Section <em>' || " + N + " || '</em> &amp; more</h2><h3>  Sub   heading </h3>'", 2: "'<h2>Only section</h2><h2> </h2>'"}),
    "'<img src=\"/img/logo.png\" alt=\"Logo\">'",
    _when(2, {1: "'<img src=\"hero.webp\" loading=\"LAZY\" alt=\"\">'"}),
    _when(3, {0: "'<img data-src=\"/img/late-' || " + N + " || '.jpg\" data-lazy>'"}),
    _when(5, {0: "'<img alt=\"no source\">'"}),
    _when(4, {0: "'<img src=\"data:image/png;base64,AAAA\" alt=\"dot\">'"}),
    _when(6, {0: "'<img src=\"/img/logo.png\">'"}),
    _when(2, {0: "'<a href=\"https://partner.example.org/p/' || " + N + " || '?x=1&amp;y=2\" rel=\"NoFollow noopener\">Partner <b>site</b></a>'",
              1: "'<a href=\"//cdn.example.com\">CDN</a>'"}),
    _when(3, {0: "'<a href=\"mailto:team@example.com\">Mail</a>'", 1: "'<a href=\"#top\">Top</a><a href=\"javascript:void(0)\">JS</a><a>bare</a>'"}),
    _when(4, {0: "'<a href=\"../up/./x.html#frag\">Up</a>'", 1: "'<a href=\"?page=2\">Next</a>'",
              2: "'<a href=''HTTPS://Other.Example.COM:443/Path to/File''>Other</a>'", 3: "'<a href=deep/er/>Deep</a>'"}),
    _when(2, {1: "'<form action=\"/s\"><input name=q></form><video><source src=\"/media/clip.mp4\"></video>'"}),
    "'<!-- <a href=\"/hidden\">hidden</a> -->'",
])

PAGES_RICH = [
    "page_id", "url",
    f"replace(replace(html, '</head>', {_HEAD} || '</head>'), '<article>', {_BODY} || '<article>') AS html"]

_REST = "substr(url, position('://' IN url) + 3)"
TARGETS = [
    "page_id",
    "CASE page_id % 20 WHEN 0 THEN url WHEN 1 THEN " + _REST + " WHEN 2 THEN '//' || " + _REST
    + " WHEN 3 THEN 'ftp://' || " + _REST + " WHEN 4 THEN 'http://' || " + HOST + " || ':22/x' WHEN 5 THEN 'https://' || " + HOST + " || ':8443'"
    + " WHEN 6 THEN '   ' WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN '  HTTPS://' || upper(" + HOST + ") || ':443/A/../B/./c d '"
    + " WHEN 10 THEN 'javascript:alert(1)' WHEN 11 THEN 'http://' || " + HOST + " || ':80?q=1' WHEN 12 THEN 'http://'"
    + " WHEN 13 THEN 'file:///etc/passwd' WHEN 14 THEN 'http://bad host/' WHEN 15 THEN 'https://' || " + HOST + " || ':99999/'"
    + " WHEN 16 THEN 'http://2130706433/' WHEN 17 THEN 'localhost:8080/admin' WHEN 18 THEN 'https://box' || " + N + " || '.local/'"
    + " ELSE CASE page_id % 3 WHEN 0 THEN 'http://[0:0:0:0:0:0:0:1]:8080/' WHEN 1 THEN 'https://B\u00dccher.' || " + HOST + " || '/' ELSE 'http://[2001:DB8::0:0:1:0:0]:8080/' END END AS raw_url"]

RESPONSES = [
    "page_id AS response_id", "page_id", "url", f"{HOST} AS host",
    "CASE WHEN substr(url, 1, 6) = 'https:' THEN 443 ELSE 80 END AS port",
    "CASE page_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 301 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 204 WHEN 5 THEN 304 WHEN 6 THEN 0"
    " WHEN 7 THEN 600 ELSE 200 END AS status_code",
    "CASE page_id % 3 WHEN 0 THEN '1.1' WHEN 1 THEN '2.0' END AS http_version",
    "CASE page_id % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' Application/XHTML+xml ' WHEN 2 THEN 'application/json' WHEN 3 THEN NULL ELSE 'text/html' END AS content_type",
    "CASE WHEN page_id % 9 = 0 THEN 6000000 WHEN page_id % 9 = 1 THEN NULL ELSE CAST(length(html) AS BIGINT) END AS declared_length",
    "CASE WHEN page_id % 10 = 0 THEN 5300000 ELSE CAST(length(html) AS BIGINT) END AS content_length",
    "CAST(page_id * 37 % 12000 AS BIGINT) AS response_ms",
    "CASE page_id % 17 WHEN 0 THEN 'ENOTFOUND' WHEN 1 THEN 'ECONNREFUSED' WHEN 2 THEN 'ETIMEDOUT' WHEN 3 THEN 'CERT_HAS_EXPIRED' WHEN 4 THEN 'ECONNRESET' WHEN 5 THEN 'EPROTO' END AS error_code",
    "CASE page_id % 17 WHEN 3 THEN 'certificate has expired' WHEN 4 THEN 'socket hang up' WHEN 5 THEN 'self-signed certificate' END AS error_message",
    "CASE page_id % 5 WHEN 0 THEN 'max-age=31536000; includeSubDomains' WHEN 1 THEN 'Max-Age=3600' WHEN 2 THEN 'includeSubDomains' WHEN 3 THEN '' END AS hsts",
    "CASE page_id % 4 WHEN 0 THEN 'default-src ' || chr(39) || 'self' || chr(39) WHEN 1 THEN 'script-src ' || chr(39) || 'unsafe-inline' || chr(39)"
    " WHEN 2 THEN 'Frame-Ancestors ' || chr(39) || 'none' || chr(39) END AS csp",
    "CASE page_id % 3 WHEN 0 THEN ' NoSniff ' WHEN 1 THEN 'sniff' END AS sniff",
    "CASE page_id % 7 WHEN 0 THEN 'deny' WHEN 1 THEN ' SAMEORIGIN' WHEN 2 THEN 'ALLOW-FROM https://x.example' END AS frame",
    "CASE page_id % 6 WHEN 0 THEN 'no-referrer' WHEN 1 THEN 'Strict-Origin-When-Cross-Origin' WHEN 2 THEN 'unsafe-url' END AS referrer",
    "CASE page_id % 2 WHEN 0 THEN 'camera=()' END AS permissions",
    "CASE page_id % 4 WHEN 0 THEN 'nginx' WHEN 1 THEN 'Apache/2.4' WHEN 2 THEN '' END AS server",
    "CASE WHEN page_id % 3 <> 2 THEN 'session_token=abc' || " + N + " || '; Path=/; Secure; HttpOnly; SameSite=Strict' END AS cookie1",
    "CASE page_id % 4 WHEN 0 THEN 'user_pref = dark; path=/app; samesite=Lax; PATH=/app2; Max-Age=3600' WHEN 1 THEN 'id=; secure; Domain=.example.com; Expires=Wed, 01 Jan 2025 00:00:00 GMT' END AS cookie2",
    "CASE page_id % 5 WHEN 0 THEN 'flag' WHEN 1 THEN '' END AS cookie3",
]
_HEADER_NAMES = [
    ("Strict-Transport-Security", "hsts"), ("content-security-policy", "csp"), ("X-Content-Type-Options", "sniff"),
    ("x-frame-options", "frame"), ("Referrer-Policy", "referrer"), ("permissions-policy", "permissions"), ("Server", "server"),
    ("Content-Type", "content_type")]

# kind of chain: 0 none, 1 self loop, 2 one hop, 3 three hops, 4 two-cycle, 5 too long, 6 bad location or a private address, 7 to a shared page
_NODE = f"'https://' || {HOST} || '/r/' || {N} || '/'"
HOPS = [
    f"{_NODE} || CAST(i AS STRING) AS from_url",
    "CASE WHEN page_id % 8 = 0 OR (page_id % 8 = 2 AND i = 1) OR (page_id % 8 = 3 AND i = 3) OR (page_id % 8 = 5 AND i = 7) THEN 200"
    " WHEN page_id % 16 = 15 THEN 304 ELSE 301 + CAST(i % 2 AS INT) END AS status_code",
    "CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '/r/' || " + N + " || '/0'"
    " WHEN 2 THEN CASE WHEN i = 0 THEN '1' END WHEN 3 THEN CASE WHEN i < 3 THEN './' || CAST(i + 1 AS STRING) END"
    f" WHEN 4 THEN {_NODE} || CAST(1 - i AS STRING) WHEN 5 THEN CASE WHEN i < 7 THEN {_NODE} || CAST(i + 1 AS STRING) END"
    " WHEN 6 THEN CASE WHEN page_id % 16 = 6 THEN 'http://' ELSE 'https://169.254.169.254/latest' END ELSE CASE WHEN page_id % 16 = 7 THEN 'https://login.example.com' END END AS location",
    "CAST((page_id * 13 + i * 50) % 900 AS BIGINT) AS response_ms",
]
HOPS_WHERE = "i <= CASE page_id % 8 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 7 ELSE 0 END"
HOPS_EXTRA = "SELECT 'https://login.example.com/' AS from_url, 200 AS status_code, CAST(NULL AS STRING) AS location, CAST(70 AS BIGINT) AS response_ms"
STARTS = [f"{_NODE} || '0' AS start_url"]

_DNS = [
    "SELECT host, 'A' AS type, 0 AS ord, '93.184.216.' || CAST(hid % 250 AS STRING) AS c1, CAST(NULL AS STRING) AS c2, CAST(NULL AS INT) AS priority, CAST(NULL AS STRING) AS error FROM hosts WHERE hid % 7 <> 0",
    "SELECT host, 'A', 1, CASE hid % 3 WHEN 0 THEN '10.1.2.3' WHEN 1 THEN '8.8.8.8' ELSE '172.32.0.1' END, NULL, NULL, NULL FROM hosts WHERE hid % 2 = 0 AND hid % 7 <> 0",
    "SELECT host, 'A', 0, NULL, NULL, NULL, CASE hid % 2 WHEN 0 THEN 'ETIMEOUT' ELSE 'ENODATA' END FROM hosts WHERE hid % 7 = 0",
    "SELECT host, 'AAAA', 0, CASE hid % 2 WHEN 0 THEN '2606:4700:4700::1111' ELSE '::ffff:192.168.1.1' END, NULL, NULL, NULL FROM hosts WHERE hid % 5 = 1",
    "SELECT host, 'AAAA', 0, NULL, NULL, NULL, 'ESERVFAIL' FROM hosts WHERE hid % 14 = 0",
    "SELECT host, 'CNAME', 0, 'edge.' || host, NULL, NULL, NULL FROM hosts WHERE hid % 6 = 1",
    "SELECT host, 'MX', 0, 'mx1.' || host, NULL, 20, NULL FROM hosts WHERE hid % 3 = 1",
    "SELECT host, 'MX', 1, 'mx2.' || host, NULL, 10, NULL FROM hosts WHERE hid % 3 = 1",
    "SELECT host, 'TXT', 0, 'v=spf1 include:_spf.', 'example.com -all', NULL, NULL FROM hosts WHERE hid % 4 = 1",
]
DNS_SQL = "WITH hosts AS (SELECT {host} AS host, min(page_id) AS hid FROM {pages} GROUP BY 1) " + " UNION ALL ".join(_DNS)
CERTS_SQL = (
    "WITH hosts AS (SELECT {host} AS host, min(page_id) AS hid FROM {pages} GROUP BY 1) SELECT host,"
    " CASE WHEN hid % 3 <> 0 THEN host END AS s_cn, CASE WHEN hid % 2 = 0 THEN 'Org ' || CAST(hid % 9 AS STRING) END AS s_o,"
    " CASE WHEN hid % 2 = 1 THEN 'CA ' || CAST(hid % 4 AS STRING) END AS i_cn, CASE WHEN hid % 4 = 0 THEN 'Trust Inc' END AS i_o,"
    f" CAST({AS_OF_S} - 7000000 AS BIGINT) AS from_s, CAST({AS_OF_S} + (hid % 90 - 20) * 86400 + hid % 5 * 3600 AS BIGINT) AS to_s,"
    " CASE WHEN hid % 5 = 0 THEN NULL ELSE 'DNS:' || host || ', dns:www.' || host || ',, DNS:' || repeat('x.' || host || ', DNS:', CAST(hid % 30 AS INT)) || 'end.' || host END AS san,"
    " hid % 3 = 1 AS authorized, CASE hid % 2 WHEN 0 THEN 'TLSv1.3' ELSE 'TLSv1.2' END AS protocol,"
    " CASE WHEN hid % 8 <> 0 THEN 'AES128-GCM' END AS c_name, 'TLSv1.' || CAST(2 + hid % 2 AS STRING) AS c_version FROM hosts")

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
EVENTS_X = ["event_id", "{us} AS us", "user_id", "event_type", "value", f"{K} AS k"]
TRACE = [
    "'s' || CAST(user_id % 40 AS STRING) AS session_id", "event_id AS seq", "us",
    "CASE k % 10 WHEN 0 THEN 'dns' WHEN 1 THEN 'TLS' WHEN 2 THEN 'HTTP' WHEN 3 THEN 'BROWSER' WHEN 4 THEN 'NETWORK' WHEN 5 THEN 'API'"
    " WHEN 6 THEN 'DOM' WHEN 7 THEN 'WARN' WHEN 8 THEN 'ERROR' ELSE 'DONE' END AS category",
    "CASE WHEN event_id % 4 = 0 THEN 'info' WHEN event_id % 4 = 1 THEN 'warn' END AS level",
    "event_type || ' ' || CASE event_id % 5 WHEN 0 THEN 'Authorization: bearer abc.DEF-' || CAST(event_id AS STRING) || '== sent'"
    " WHEN 1 THEN 'Cookie SESSIONID=xyz' || CAST(k AS STRING) || '; auth_token=q,w' WHEN 2 THEN 'token = \"kept\" token=gone' ELSE 'step ' || CAST(k AS STRING) END AS message",
    "'{\"user\":' || CAST(user_id AS STRING) || ',\"auth\":\"Bearer t0k' || CAST(k AS STRING) || '\",\"ok\":true,\"nested\":{\"a\":1},\"none\":null,\"list\":[1,2,3,4,5,6,7,8,9,10,11,12]}' AS meta",
]

_NET = (
    "'s' || CAST(user_id % 40 AS STRING) AS session_id, 'r' || CAST(event_id AS STRING) AS request_id, {us} * 4 + {i} AS seq,"
    " '{action}' AS action, {us} AS us, 'https://api.example.com/v' || CAST(k % 3 AS STRING) || CASE k % 5 WHEN 0 THEN '/' WHEN 1 THEN '/list?page=' || CAST(k AS STRING)"
    " || '&filter=a-long-filter-expression' WHEN 2 THEN '/app.js' ELSE '' END AS url,"
    " CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS method,"
    " CASE event_type WHEN 'click' THEN 'XHR' WHEN 'view' THEN 'Fetch' WHEN 'purchase' THEN 'Script' WHEN 'signup' THEN 'Document' ELSE 'Image' END AS resource_type,"
    " CASE event_id % 6 WHEN 0 THEN 'parser' WHEN 1 THEN 'script' WHEN 2 THEN 'script' WHEN 3 THEN 'preload' WHEN 4 THEN 'script' END AS i_type,"
    " CASE event_id % 6 WHEN 1 THEN 'https://cdn.example.net/js/inject.js?v=2' WHEN 2 THEN 'https://cdn.example.net/' END AS i_url,"
    " CAST(CASE WHEN event_id % 6 = 1 THEN k ELSE 0 END AS INT) AS i_line,"
    " CAST(CASE k % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 302 WHEN 3 THEN 0 ELSE 200 END AS INT) AS status,"
    " CAST(floor(value * 1000) AS BIGINT) AS bytes, event_id % 2 = 0 AS canceled")
_LAG_US = "us + CAST(k AS BIGINT) * 3600000000"
NET_SQL = " UNION ALL ".join([
    "SELECT " + _NET.replace("{us}", "us").replace("{i}", "0").replace("{action}", "start") + " FROM {x} WHERE event_id % 13 <> 0",
    "SELECT " + _NET.replace("{us}", f"({_LAG_US})").replace("{i}", "1").replace("{action}", "response") + " FROM {x} WHERE event_id % 5 <> 0",
    "SELECT " + _NET.replace("{us}", f"({_LAG_US} + CAST(floor(value * 900) AS BIGINT))").replace("{i}", "2").replace("{action}", "complete")
    + " FROM {x} WHERE event_id % 7 > 1",
    "SELECT " + _NET.replace("{us}", f"({_LAG_US} + 5000000)").replace("{i}", "3").replace("{action}", "failed") + " FROM {x} WHERE event_id % 7 = 1",
])
CONSOLE = [
    "'s' || CAST(user_id % 40 AS STRING) AS session_id", "event_id AS seq",
    "CASE k % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'runtime_error' WHEN 3 THEN 'log' ELSE 'info' END AS type",
    "event_type || ' ' || repeat('stack frame ', CAST(k AS INT)) AS text"]
IPS = [
    "event_id",
    "CASE event_id % 12 WHEN 0 THEN '127.0.' || CAST(k AS STRING) || '.1' WHEN 1 THEN '10.' || CAST(k AS STRING) || '.0.1' WHEN 2 THEN '172.' || CAST(k % 40 AS STRING) || '.255.255'"
    " WHEN 3 THEN '192.168.1.' || CAST(k AS STRING) WHEN 4 THEN '169.254.' || CAST(k AS STRING) || '.254' WHEN 5 THEN '100.' || CAST(k + 30 AS STRING) || '.0.1'"
    " WHEN 6 THEN CAST(200 + k AS STRING) || '.0.0.1' WHEN 7 THEN '::FFFF:' || CAST(k * 3 AS STRING) || '.8.8.8' WHEN 8 THEN 'f' || CASE k % 4 WHEN 0 THEN 'c00' WHEN 1 THEN 'd12' WHEN 2 THEN 'e80' ELSE 'c' END || '::1'"
    " WHEN 9 THEN CASE k % 5 WHEN 0 THEN '::1' WHEN 1 THEN '::' WHEN 2 THEN '2606:4700:4700::1111' WHEN 3 THEN NULL ELSE CASE event_id % 5 WHEN 0 THEN '0::1'"
    " WHEN 1 THEN '0:0:0:0:0:FFFF:127.0.0.1' WHEN 2 THEN '0000::0000' WHEN 3 THEN 'FE80:0::1' ELSE 'not-an-ip' END END"
    " WHEN 10 THEN CASE k % 4 WHEN 0 THEN '192.0.0.9' WHEN 1 THEN '192.0.2.1' WHEN 2 THEN '198.51.100.7' ELSE '203.0.113.200' END"
    " ELSE CASE k % 3 WHEN 0 THEN '8.8.8.8' WHEN 1 THEN '255.255.255.255' ELSE '::ffff:7f00:1' END END AS ip"]


class Recorded:
    """The derived tables as DataFrames of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")

    @property
    def pages(self) -> DataFrame:
        return read_pages(self.spark, f"{self.dir}/pages.parquet")

    @property
    def rich(self) -> DataFrame:
        return self.pages.selectExpr(*PAGES_RICH)

    @property
    def documents(self) -> DataFrame:
        return self._read("documents")

    @property
    def targets(self) -> DataFrame:
        return self.pages.selectExpr(*TARGETS)

    @property
    def responses(self) -> DataFrame:
        flat = self.pages.selectExpr(*RESPONSES)
        pairs = ", ".join(f"struct('{name}' AS key, array({col}) AS value)" for name, col in _HEADER_NAMES)
        headers = (
            f"map_from_entries(filter(array({pairs}, struct('Set-Cookie' AS key, filter(array(cookie1, cookie2, cookie3), c -> c IS NOT NULL) AS value)),"
            " h -> size(h.value) > 0 AND h.value[0] IS NOT NULL))")
        return flat.withColumn("headers", F.expr(headers)).drop(
            *[c for _, c in _HEADER_NAMES if c != "content_type"], "cookie1", "cookie2", "cookie3")

    @property
    def rendered(self) -> DataFrame:
        return self.pages.where("page_id % 3 = 0").selectExpr(
            "page_id", "CASE WHEN page_id % 6 = 0 THEN '' ELSE replace(html, '<article>', '<article><p>hydrated</p>') END AS rendered_html")

    @property
    def rendered_rich(self) -> DataFrame:
        """What a browser made of some of the enriched pages; an empty document where it failed."""
        return self.rich.where("page_id % 3 = 0").selectExpr(
            "page_id", "CASE WHEN page_id % 6 = 0 THEN '' ELSE replace(html, '<article>', '<article><p>hydrated</p>') END AS rendered_html")

    @property
    def hops(self) -> DataFrame:
        nodes = self.pages.select("page_id", "url", F.explode(F.expr("sequence(0, 7)")).alias("i")).where(HOPS_WHERE)
        return nodes.selectExpr(*HOPS).unionByName(self.spark.sql(HOPS_EXTRA)).withColumn("status_text", F.lit(None).cast("string"))

    @property
    def starts(self) -> DataFrame:
        return self.pages.selectExpr(*STARTS)

    @property
    def dns(self) -> DataFrame:
        flat = self.spark.sql(DNS_SQL.replace("{host}", HOST), pages=self.pages)
        return flat.selectExpr("host", "type", "ord", "filter(array(c1, c2), c -> c IS NOT NULL) AS chunks", "priority", "error")

    @property
    def answers(self) -> DataFrame:
        return self.dns.where("type IN ('A', 'AAAA') AND size(chunks) > 0").selectExpr(
            "host", "CASE type WHEN 'A' THEN ord ELSE 10 + ord END AS ord", "get(chunks, 0) AS ip")

    @property
    def certs(self) -> DataFrame:
        return self.spark.sql(CERTS_SQL.replace("{host}", HOST), pages=self.pages).selectExpr(
            "host", "named_struct('CN', s_cn, 'O', s_o) AS subject", "named_struct('CN', i_cn, 'O', i_o) AS issuer",
            "timestamp_seconds(from_s) AS valid_from", "timestamp_seconds(to_s) AS valid_to", "san", "authorized", "protocol",
            "named_struct('name', c_name, 'version', c_version) AS cipher")

    @property
    def events(self) -> DataFrame:
        return self._read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def events_x(self) -> DataFrame:
        return self.events.selectExpr(*[e.replace("{us}", "unix_micros(ts)") for e in EVENTS_X])

    @property
    def trace(self) -> DataFrame:
        return self.events_x.selectExpr(*TRACE).withColumn("ts", F.expr("timestamp_micros(us)")).drop("us")

    @property
    def net_events(self) -> DataFrame:
        return self.spark.sql(NET_SQL, x=self.events_x).selectExpr(
            "session_id", "request_id", "seq", "action", "timestamp_micros(us) AS ts", "url", "method", "resource_type",
            "CASE WHEN i_type IS NOT NULL THEN named_struct('type', i_type, 'frames', CASE WHEN i_url IS NOT NULL"
            " THEN array(named_struct('url', i_url, 'line', i_line)) ELSE array() END) END AS initiator",
            "CASE WHEN action = 'response' THEN status END AS status", "bytes", "canceled")

    @property
    def console(self) -> DataFrame:
        return self.events_x.selectExpr(*CONSOLE)

    @property
    def ips(self) -> DataFrame:
        return self.events_x.selectExpr(*IPS)

    @property
    def requests_log(self) -> DataFrame:
        """Requests of API clients: a dozen busy clients share the log."""
        return self.events.selectExpr(
            "event_id", "concat('c', CAST(user_id % 12 AS STRING)) AS client", "ts")
