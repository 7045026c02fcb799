"""Named queries over one data folder, each running the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlsift.operators import assets, dns_tls, headers, html, http, limits, netevents, report, seo, sketches, trace, urls
from crawlsift.plans import recorded as R
from crawlsift.plans.recorded import Recorded
from crawlsift.sources.io import read_responses, shared_dir, store
from crawlsift.streaming import streams

NEEDLE, HEADER_NEEDLE, REQUEST_NEEDLE = "Section", "max-age", "LIST?page=1"
JOIN = " | "
RANKS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparing: integers as bigint, times as microseconds, lists of text joined."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            c = F.unix_micros(c)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, JOIN)
        out.append(c.alias(field.name))
    return df.select(*out)


def facts(r: Recorded, *parts: str) -> DataFrame:
    return html.analyse(r.rich, *parts)


def audited(r: Recorded) -> DataFrame:
    return seo.audit(facts(r, "stats", "head", "headings", "links", "images", "open_graph", "twitter", "json_ld"))


def _admission(r: Recorded) -> DataFrame:
    literal = r.pages.selectExpr(
        "CASE page_id % 9 WHEN 0 THEN '10.0.0.7' WHEN 1 THEN '[::1]' WHEN 2 THEN 'api.localhost' WHEN 3 THEN '1.1.1.1'"
        " WHEN 4 THEN '[0::1]' WHEN 5 THEN '[0:0:0:0:0:ffff:7f00:1]' WHEN 6 THEN '[2606:4700:4700:0::1111]' END AS host"
    ).where("host IS NOT NULL")
    targets = r.pages.selectExpr(f"{R.HOST} AS host").unionByName(literal)
    return urls.admit_hosts(targets, r.answers, urls.policy_cidrs(r.spark), urls.policy_hosts(r.spark))


def _screened(r: Recorded) -> DataFrame:
    norm = urls.normalize(r.targets).where("valid").select("page_id", "hostname")
    return urls.screen_hosts(norm, urls.policy_hosts(r.spark), row_id=["page_id"])


def _port_policy(r: Recorded) -> DataFrame:
    parsed = urls.decompose(r.targets.where("raw_url IS NOT NULL"), "trim(raw_url)").where("hostname <> ''").select(
        "page_id", "protocol", "hostname", F.col("port"))
    ports = r.spark.createDataFrame([(p,) for p in urls.DEFAULT_PORTS], "port int")
    allowed, refused = urls.by_port_policy(parsed, ports)
    return allowed.withColumn("allowed", F.lit(True)).unionByName(refused.withColumn("allowed", F.lit(False))).groupBy(
        "protocol", "port", "allowed").agg(F.count("*").alias("targets"))


def _resolved(r: Recorded) -> DataFrame:
    refs = html.links(facts(r, "links")).select("page_id", "pos", F.col("raw_href").alias("href"), "page_url")
    return urls.resolve(refs, "href", "page_url").select("page_id", "pos", "href", "resolved_url")


def _numbered(r: Recorded) -> DataFrame:
    return assets.with_paths(assets.first(assets.lists(r.rich)))


def _sizes(rows: DataFrame) -> DataFrame:
    """Recorded sizes of all assets found."""
    return rows.select("resolved_url").distinct().selectExpr(
        "resolved_url",
        "CASE length(resolved_url) % 6 WHEN 0 THEN 6000000L WHEN 1 THEN NULL ELSE 5242880L - length(resolved_url) * 4000L END AS bytes",
        "CASE WHEN length(resolved_url) % 11 = 0 THEN 404 ELSE 200 END AS status_code")


def _selection(rows: DataFrame) -> DataFrame:
    """Ticked assets: every page whose id is even ticks its script by source text and its icon by resolved URL."""
    return rows.where("page_id % 2 = 0").where("type IN ('js', 'icon')").selectExpr(
        "page_id", "CASE type WHEN 'js' THEN concat(' ', original_src) ELSE resolved_url END AS selected_url")


def _budgeted(r: Recorded) -> DataFrame:
    rows = store(assets.manifest(_numbered(r)))
    return assets.budget(rows, _sizes(rows))


def _manifest_stats(r: Recorded) -> DataFrame:
    lists = store(assets.lists(r.rich))
    rows = assets.manifest(assets.with_paths(assets.first(lists)))
    return assets.manifest_stats(lists, assets.budget(rows, _sizes(rows)))


def _selected_manifest(r: Recorded) -> DataFrame:
    lists = store(assets.first(assets.lists(r.rich)))
    kept = assets.with_paths(assets.select(lists, _selection(assets.manifest(assets.with_paths(lists)))))
    return assets.manifest(kept).select(
        "page_id", "idx", "resolved_url", "original_src", "local_path", assets.bundle_name(F.col("host")).alias("bundle"))


def _algebra(r: Recorded) -> DataFrame:
    listing = store(assets.inventory(facts(r, "script_files", "stylesheet_files", "images")))
    ticked = assets.remove(assets.select_all(listing), assets.of_category(listing, "image"))
    ticked = assets.add(ticked, assets.of_category(listing, "image").where("page_id % 3 = 0"))
    return assets.selected_counts(listing, ticked)


def _requests(r: Recorded) -> DataFrame:
    events = r.net_events
    return netevents.mark_dynamic(store(netevents.lifecycle(events)), netevents.ready_times(events))


def _report(r: Recorded) -> DataFrame:
    starts = r.pages.selectExpr("page_id", *R.STARTS)
    full = report.inspections(
        html.choose_source(r.rich, r.rendered_rich), r.responses, http.chains(starts, r.hops), dns_tls.assemble(r.dns),
        dns_tls.validity(r.certs, R.AS_OF), starts)
    return full.selectExpr(
        "page_id", "url", "mode", "status_code", "status_text", "category", "protocol", "http_version", "server", "content_length", "response_ms",
        "is_html", "notice", "head.title AS title", "stats.dom_elements AS dom_elements", "n_links AS links", "n_images AS images",
        "CAST(size(filter(items, i -> i.status = 'pass')) AS bigint) AS seo_passes",
        "CAST(size(filter(checks, c -> c.status = 'pass')) AS bigint) AS headers_passed",
        "CAST(coalesce(size(cookies), 0) AS bigint) AS cookies", "dns.success AS dns_success", "tls.status AS tls_status",
        "CAST(size(redirects) AS bigint) AS redirects", "final_url", "error", "total_ms")


def _response_log(r: Recorded) -> DataFrame:
    """Exchanges written as JSON lines and scanned again with the fixed nested schema."""
    folder = shared_dir(r.spark) + "/responses"
    r.responses.write.json(folder)
    return read_responses(r.spark, folder).selectExpr(
        "response_id", "url", "status_code", "response_ms", "content_length", "CAST(size(headers) AS bigint) AS headers",
        "array_join(headers['Strict-Transport-Security'], ', ') AS hsts")


def _chains(r: Recorded) -> DataFrame:
    return http.chains(r.starts, r.hops)


def _admitted_chains(r: Recorded) -> DataFrame:
    """Chains whose every hop is screened: hosts of all records and targets are judged once."""
    step = http.edges(r.hops)
    hosts = urls.decompose(step.select(F.explode(F.array("from_url", "next_url")).alias("u")), "u").selectExpr("hostname AS host")
    judged = urls.admit_hosts(hosts, r.answers, urls.policy_cidrs(r.spark), urls.policy_hosts(r.spark))
    return http.chains(r.starts, r.hops, refused=judged.where("NOT admitted").select("host", "error"))


def _quantiles(rows: DataFrame, key: str, part: str, value: str) -> DataFrame:
    """Quantiles per key merged from stored sketches of its parts, each held against an exact count: whether it stands within the
    rank error."""
    rows = store(rows.selectExpr(key, f"{part} AS part", value))
    kept = store(sketches.quantile_sketches(rows, [key, "part"], value))
    found = sketches.quantiles(sketches.merged(kept, [key]), RANKS)
    return sketches.judged(rows, key, value, found, RANKS).select(key, "n", *[F.col(x).alias(f"{x}_near") for x in RANKS])


def _asset_overlap(r: Recorded) -> DataFrame:
    """Hosts that use assets of one type, of another, of both and of either, from one sketch of hosts per type."""
    rows = assets.manifest(assets.with_paths(assets.lists(r.rich))).select("type", "host")
    kept = store(sketches.distinct_sketches(rows, ["type"], "host", 16))
    kinds = ", ".join(f"'{x[3]}'" for x in assets.SOURCES)
    pairs = r.spark.sql(f"SELECT explode(array({kinds})) AS a").select("a", F.expr(f"explode(array({kinds})) AS b")).where("a < b")
    return sketches.overlap(kept, "type", pairs, 16)


QUERIES: dict[str, Callable[[Recorded], DataFrame]] = {
    # URLs and admission
    "url_normalized": lambda r: urls.normalize(r.targets),
    "url_decomposed": lambda r: urls.decompose(r.pages.select("page_id", "url"), "url"),
    "url_rejections": lambda r: urls.rejections(urls.normalize(r.targets)),
    "url_port_policy": _port_policy,
    "url_resolved": _resolved,
    "target_intake": lambda r: urls.rejected(urls.normalize(r.targets)).withColumn("accepted", F.lit(False)).unionByName(
        urls.accepted(urls.normalize(r.targets)).select("raw_url", "error").withColumn("accepted", F.lit(True))
    ).groupBy("accepted").agg(F.count("*").alias("targets"), F.countDistinct("raw_url").alias("distinct_targets")),
    "host_policy": _screened,
    "ip_blocked": lambda r: urls.classify_ips(r.ips, urls.policy_cidrs(r.spark)),
    "host_admission": _admission,
    # HTML
    "site_link_profile": lambda r: html.site_link_profile(html.analyse(r.pages, "stats", "links")),
    "tag_census": lambda r: html.tag_census(r.rich),
    "element_attributes": lambda r: html.element_attributes(html.elements(r.rich)),
    "page_stats": lambda r: html.page_stats(facts(r, "stats")),
    "head_meta": lambda r: html.head_meta(facts(r, "head")),
    "headings": lambda r: html.headings(facts(r, "headings")),
    "links_classified": lambda r: html.links(facts(r, "links")).drop("page_url"),
    "link_counts": lambda r: html.link_counts(facts(r, "stats", "links")),
    "top_links_per_page": lambda r: html.links(html.top_n(facts(r, "links"), "links", 5)).select("page_id", "pos", "url"),
    "image_audit": lambda r: html.image_audit(facts(r, "stats", "images")),
    "images_listed": lambda r: html.rows_of(html.top_n(facts(r, "images"), "images", html.IMAGE_CAP), "images").drop("page_url"),
    "script_breakdown": lambda r: html.script_breakdown(facts(r, "stats", "script_files", "inline_scripts")),
    "stylesheet_breakdown": lambda r: html.stylesheet_breakdown(facts(r, "stats", "stylesheet_files")),
    "og_map": lambda r: html.social_pairs(facts(r, "open_graph"), "open_graph"),
    "twitter_map": lambda r: html.social_pairs(facts(r, "twitter"), "twitter"),
    "jsonld_blocks": lambda r: html.json_ld(facts(r, "json_ld")).select(
        "page_id", "pos", "is_malformed", F.try_variant_get("item", "$.name", "string").alias("name")),
    "jsonld_census": lambda r: html.json_ld_census(html.json_ld(facts(r, "json_ld"))),
    "dom_outline": lambda r: html.outline(r.rich),
    "framework_census": lambda r: html.framework_census(r.rich),
    "html_eligibility": lambda r: html.eligibility(r.responses).select("response_id", "media_type", "is_html", "notice"),
    "source_choice": lambda r: html.choose_source(r.pages, r.rendered),
    "link_search": lambda r: html.search_links(facts(r, "links"), "PARTNER.example").select("page_id", "pos", "url"),
    "html_search": lambda r: html.search(r.rich, NEEDLE),
    # SEO
    "seo_items": lambda r: seo.items(audited(r)),
    "seo_summary": lambda r: seo.summary(audited(r)),
    "seo_site_rollup": lambda r: seo.rollup(seo.items(audited(r))),
    "seo_worst_pages": lambda r: seo.worst_pages(store(seo.summary(audited(r)))),
    # security headers and cookies
    "header_checks": lambda r: headers.checks(headers.audit(r.responses)),
    "header_score": lambda r: headers.score(headers.audit(r.responses)),
    "cookies_masked": lambda r: headers.cookies(r.responses),
    "cookie_flag_cube": lambda r: headers.cookie_cube(headers.cookies(r.responses)),
    "cookie_flag_census": lambda r: headers.cookie_flags(headers.cookies(r.responses)),
    "security_site_rollup": lambda r: headers.site_rollup(headers.checks(headers.audit(r.responses))),
    # responses and redirects
    "redirect_chains": lambda r: _chains(r).selectExpr(
        "start_url", "final_url", "status_code", "error", "total_ms", "transform(hops, h -> h.to_url) AS path"),
    "redirect_admission": lambda r: _admitted_chains(r).selectExpr(
        "start_url", "final_url", "status_code", "error", "total_ms", "transform(hops, h -> h.to_url) AS path"),
    "redirect_hops": lambda r: http.chain_hops(_chains(r)),
    "redirect_errors": lambda r: http.chain_errors(_chains(r)),
    "chain_timing": lambda r: http.chain_timing(_chains(r)),
    "failed_inspections": lambda r: report.failed(_chains(r)).selectExpr(
        "success", "url", "final_url", "error", "CAST(size(redirects) AS bigint) AS redirects", "response_time"),
    "status_categories": lambda r: http.status_categories(r.responses),
    "response_log": _response_log,
    "status_labels": lambda r: http.status_labels(r.responses),
    "latency_by_host": lambda r: http.latency_by_host(r.responses),
    "latency_quantiles": lambda r: _quantiles(r.responses, "host", http.status_category(), "response_ms"),
    "response_guards": lambda r: http.guards(r.responses).select("response_id", "guard_error"),
    "failure_classes": lambda r: http.failure_classes(r.responses),
    "failure_messages": lambda r: http.failures(r.responses).select("response_id", "class", "message"),
    "server_fingerprint": lambda r: http.server_census(r.responses),
    "header_search": lambda r: http.search_headers(r.responses, HEADER_NEEDLE),
    # DNS and certificates
    "dns_assembled": lambda r: dns_tls.assemble(r.dns).withColumn(
        "mx", F.expr("transform(mx, m -> concat(m.priority, ' ', m.exchange))")),
    "dns_record_pivot": lambda r: dns_tls.record_pivot(r.dns),
    "cert_validity": lambda r: dns_tls.validity(r.certs, R.AS_OF),
    "cert_sans": lambda r: dns_tls.sans(dns_tls.validity(r.certs, R.AS_OF)),
    "cert_expiry": lambda r: dns_tls.expiring(dns_tls.validity(r.certs, R.AS_OF)),
    # assets
    "asset_manifest": lambda r: assets.manifest(_numbered(r)).drop("attr", "host", "pos"),
    "asset_selection": _selected_manifest,
    "asset_budget": _budgeted,
    "manifest_stats": _manifest_stats,
    "page_rewrite": lambda r: assets.rewrite(assets.with_paths(assets.first(assets.lists(r.rich, "tokens", "marks"))), R.AS_OF),
    "asset_inventory": lambda r: assets.inventory(facts(r, "script_files", "stylesheet_files", "images")),
    "selection_algebra": _algebra,
    "shared_assets": lambda r: assets.shared(assets.manifest(assets.with_paths(assets.lists(r.rich)))),
    "asset_overlap": _asset_overlap,
    # traces
    "trace_sequence": lambda r: trace.sequence(r.trace).drop("meta"),
    "trace_redacted": lambda r: trace.redacted(r.documents, "text").groupBy("lang", "masked").agg(
        F.count("*").alias("documents"), F.sum(F.length("redacted")).alias("chars")),
    "trace_meta": lambda r: trace.sanitize_meta(r.trace),
    "trace_groups": lambda r: trace.group_counts(trace.whole_sequence(r.trace)),
    "trace_errors": lambda r: trace.filter_group(trace.whole_sequence(r.trace), "error").select("session_id", "id", "category", "level"),
    "trace_text": lambda r: trace.text_lines(trace.whole_sequence(r.trace)),
    # network events
    "net_lifecycle": lambda r: netevents.with_names(netevents.lifecycle(r.net_events)).drop("initiator"),
    "net_stats": lambda r: netevents.stats(_requests(r)),
    "net_dynamic_only": lambda r: _requests(r).select("session_id", "request_id", "is_dynamic"),
    "net_initiators": lambda r: netevents.by_initiator(netevents.lifecycle(r.net_events)),
    "net_tabs": lambda r: netevents.tab_counts(_requests(r)),
    "net_search": lambda r: netevents.search(netevents.lifecycle(r.net_events), REQUEST_NEEDLE).select(
        "session_id", "request_id", "name"),
    "net_newest": lambda r: netevents.newest(netevents.lifecycle(r.net_events), 100).select("session_id", "request_id", "start_ts"),
    "net_status_bands": lambda r: netevents.bands_by_type(netevents.lifecycle(r.net_events)),
    "net_status_mix": lambda r: netevents.status_mix(netevents.lifecycle(r.net_events)),
    "net_durations": lambda r: netevents.durations(netevents.lifecycle(r.net_events)),
    "net_duration_quantiles": lambda r: _quantiles(netevents.lifecycle(r.net_events), "resource_type", "date_trunc('hour', start_ts)", "duration_ms"),
    "net_api_capture": lambda r: netevents.api_calls(r.net_events).drop("seq"),
    "net_fifo_pairing": lambda r: netevents.pair_fifo(r.net_events),
    "net_console": lambda r: netevents.console(r.console),
    "inactivity_sessions": lambda r: netevents.sessions(r.events, "user_id").drop("no"),
    # rate limits
    "rate_limit_windows": lambda r: limits.windows(r.requests_log, 2, "1 hour"),
    "rate_limit_offenders": lambda r: limits.offenders(r.requests_log, 2, "1 hour"),
    # streams
    "rate_limit_stream": lambda r: streams.replay(
        r.requests_log.select("client", "ts", "event_id"), lambda s: streams.rate_limit(s, 2, "1 hour"), order="event_id"),
    "inactivity_stream": lambda r: streams.replay(
        r.events.select("user_id", "ts", "event_id"), lambda s: streams.sessions(s, "user_id"), order="event_id"),
    "net_status_mix_stream": lambda r: streams.replay(r.net_events, streams.status_mix),
    "net_lifecycle_stream": lambda r: streams.replay(r.net_events, streams.lifecycle).drop("initiator"),
    "net_fifo_stream": lambda r: streams.replay(r.net_events, streams.pair_fifo),
    "net_dynamic_stream": lambda r: streams.replay(r.net_events, lambda s: streams.dynamic_requests(s, s)),
    # everything together
    "inspection_report": _report,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Callables (spark, data folder) -> DataFrame by name."""
    def bind(fn):
        return lambda spark, sf_dir: flat(fn(Recorded(_utc(spark), sf_dir)))

    return {name: bind(fn) for name, fn in QUERIES.items()}


def _utc(spark: SparkSession) -> SparkSession:
    """Times are compared as UTC, whatever the session's own default is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


