"""The nested inspection report and the quarantine of failed inspections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.functions.plan import lookup, once
from crawlsift.operators import headers, html, http, seo


# What a report says only of documents that are HTML, or that a browser rendered.
HTML_PARTS = [
    "items", "stats", "head", "headings", "n_links", "n_images", "links", "images", "scripts", "stylesheets", "open_graph", "twitter", "json_ld"]


def inspections(
        pages: DataFrame, responses: DataFrame, chains: DataFrame, dns: DataFrame, certs: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """One nested report per page: mode, status, redirects, security, cookies, HTML facts, SEO, DNS and certificate.

    `pages` may carry the `mode` that `html.choose_source` gives, else all are fast. `responses` has one row per page with `page_id`,
    `chains` one row per `start_url`, `dns` and `certs` one per host; `starts(page_id, start_url)` says where the inspection of a page
    began, its own URL by default. A page that is neither HTML nor rendered has a `notice` and NULL in `HTML_PARTS`.
    HTML is lexed once; everything joined to it is small per row. `n_links` and `n_images` count all, the lists are capped.
    """
    if "mode" not in pages.columns:
        pages = pages.withColumn("mode", F.lit("fast"))
    page_part = seo.audit(html.analyse(
        pages.select("page_id", "url", "html"), "stats", "head", "headings", "links", "images", "script_files", "inline_scripts",
        "stylesheet_files", "open_graph", "twitter", "json_ld")).select(
        "page_id", "url", "host", "items", "stats", "head", "headings", F.size("links").cast("bigint").alias("n_links"),
        F.size("images").cast("bigint").alias("n_images"), F.slice("links", 1, html.LINK_CAP).alias("links"),
        F.slice("images", 1, html.IMAGE_CAP).alias("images"),
        F.struct(F.size("script_files").alias("external"), F.col("inline_scripts").alias("inline"),
                 F.slice("script_files.url", 1, html.SCRIPT_CAP).alias("files")).alias("scripts"),
        F.struct(F.size("stylesheet_files").alias("external"), F.slice("stylesheet_files.url", 1, html.SCRIPT_CAP).alias("files")).alias("stylesheets"),
        "open_graph", "twitter", "json_ld")
    checks = headers.audit(responses).select("response_id", "checks")
    cookies = headers.cookies(responses).groupBy("response_id").agg(
        F.sort_array(F.collect_list(F.struct("cookie_no", "name", "masked_value", "secure", "http_only"))).alias("cookies"))
    text = "coalesce(nullif(status_text, ''), 'OK')" if "status_text" in responses.columns else "'OK'"
    status = html.eligibility(responses).selectExpr(
        "page_id", "response_id", "status_code", f"{text} AS status_text", f"{http.status_category()} AS category", "response_ms",
        "content_length", "media_type", "is_html", "notice")
    server = http.fingerprint(responses).select("response_id", "protocol", "http_version", "server")
    # a host may hold a third of all pages, so what belongs to hosts is gathered per host and looked up
    per_host = dns.selectExpr("host", "struct(a, aaaa, cname, mx, txt, success) AS dns").join(
        certs.selectExpr("host", "struct(subject, issuer, status, days_remaining) AS tls"), "host", "full")
    ids = once(pages.select("page_id", "url", "mode"), base=U.parse_url("url")).select("page_id", "url", "mode", F.col("base.host").alias("host"))
    began = ids.withColumn("start_url", F.col("url")) if starts is None else ids.join(starts.select("page_id", "start_url"), "page_id", "left")
    # everything else about a page is joined on slim rows, so the wide page rows are shuffled once
    slim = (
        lookup(began, per_host, ["host"], ["page_id"])
        .join(chains.selectExpr("start_url", "final_url", "error", "total_ms", "hops AS redirects"), "start_url", "left")
        .join(status, "page_id", "left").join(checks, "response_id", "left").join(cookies, "response_id", "left").join(server, "response_id", "left"))
    full = page_part.join(slim.drop("url", "host"), "page_id", "left")
    shown = F.coalesce("is_html", F.lit(False)) | (F.col("mode") == "dynamic")
    return full.withColumns({c: F.when(shown, F.col(c)) for c in HTML_PARTS} | {"notice": F.when(~shown, F.col("notice"))})


def failed(chains: DataFrame) -> DataFrame:
    """Inspections that did not end in a response."""
    return chains.where("error IS NOT NULL").selectExpr(
        "false AS success", "start_url AS url", "final_url", "error", "hops AS redirects", "total_ms AS response_time")
