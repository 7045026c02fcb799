"""SEO audit: eleven factors per page from one pass over the page's facts, then roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.functions.plan import lookup, once
from crawlsift.functions.text import q

# Thresholds and wording of the factors.
TITLE_MIN, TITLE_MAX, DESCRIPTION_MIN, DESCRIPTION_MAX = 10, 70, 40, 160
FACTORS = [
    "Page Title", "Meta Description", "Canonical URL", "Robots Meta", "H1 Heading", "Subheadings (H2 / H3)",
    "Image ALT Attributes", "Link Distribution", "Open Graph (Social)", "Twitter Card", "Structured Data (JSON-LD)"]
NOTES = {
    "length": "Length: {n} characters",
    "title_short": "Title is very short ({n} chars). 30–60 characters recommended.",
    "title_long": "Title may truncate in SERPs ({n} chars). Under 60 characters recommended.",
    "title_missing": "Missing <title> tag. Search engines cannot index page title.",
    "description_short": "Description is short ({n} chars). 50–160 characters recommended.",
    "description_long": "Description may truncate ({n} chars). Keep under 160 characters.",
    "description_missing": "Missing meta description. Search engines will generate snippets from page content.",
    "canonical_found": "Found",
    "canonical_match": "Matches current page URL",
    "canonical_points": "Points to: {s}",
    "canonical_specified": "Specified canonical: {s}",
    "canonical_missing": "No canonical URL declared. Helps prevent duplicate content issues.",
    "robots": "Directives: {s}",
    "robots_default": "Not specified (Defaults to index, follow)",
    "robots_default_note": "Default search engine crawling behavior applies.",
    "h1_one": "Exactly 1 H1 heading found (Optimal).",
    "h1_none_value": "0 found",
    "h1_none": "No H1 heading found. A single clear H1 is recommended for topic relevance.",
    "h1_many_value": "{n} found",
    "h1_many": "Found {n} H1 headings. Best practice is typically a single H1 per page.",
    "sub_value": "H2: {n}, H3: {m}",
    "sub_good": "Good sub-heading hierarchy structure.",
    "sub_none": "No H2 subheadings found.",
    "img_none_value": "0 images",
    "img_none": "No <img> elements detected.",
    "img_all_value": "All {n} images have ALT text",
    "img_all": "Optimal for accessibility and image search SEO.",
    "img_missing_value": "{m} of {n} missing ALT text",
    "img_missing": "{m} images lack descriptive ALT attributes.",
    "links_value": "{n} total ({m} internal, {k} external)",
    "links": "{n} link(s) use rel=\"nofollow\".",
    "configured": "Configured",
    "not_found": "Not found",
    "og": "Includes: {s}",
    "og_missing": "Social sharing previews on Facebook, LinkedIn, etc. may be incomplete.",
    "twitter": "Type: {s}",
    "twitter_default": "summary",
    "twitter_missing": "Twitter cards provide rich preview cards when shared on X/Twitter.",
    "ld_value": "{n} block(s) detected",
    "ld": "Enables rich search results (schema.org).",
    "ld_none_value": "None detected",
    "ld_none": "No application/ld+json schemas found in server response.",
}


def say(note: str, concat=q, **slots: str) -> str:
    """SQL text of a note with its slots filled by SQL expressions."""
    parts, rest = [], NOTES[note]
    while "{" in rest:
        before, rest = rest.split("{", 1)
        slot, rest = rest.split("}", 1)
        parts += [concat(before)] * bool(before) + [f"CAST({slots[slot]} AS string)"]
    parts += [concat(rest)] * bool(rest)
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _length_rule(text: str, low: int, high: int, kind: str, missing: str) -> tuple[str, str, str]:
    n = f"length({text})"
    status = f"CASE WHEN {text} IS NULL THEN '{missing}' WHEN {n} < {low} OR {n} > {high} THEN 'warning' ELSE 'pass' END"
    note = (
        f"CASE WHEN {text} IS NULL THEN {say(kind + '_missing')} WHEN {n} < {low} THEN {say(kind + '_short', n=n)}"
        f" WHEN {n} > {high} THEN {say(kind + '_long', n=n)} ELSE {say('length', n=n)} END")
    return status, text, note


def audit(facts: DataFrame) -> DataFrame:
    """Facts with `host` and `items`, the eleven factors with status, value and note."""
    scored = facts.selectExpr(
        "*", "get(headings.h1, 0) AS first_h1", "size(headings.h1) AS h1", "size(headings.h2) AS h2", "size(headings.h3) AS h3",
        "size(filter(images, i -> NOT i.has_alt)) AS no_alt",
        "size(filter(links, l -> l.type = 'Internal')) AS internal",
        "size(filter(links, l -> l.type = 'External')) AS external",
        "size(filter(links, l -> l.is_nofollow)) AS nofollow", "size(json_ld) AS ld",
        f"{U.resolve_url('head.canonical', 'base')}.url AS canonical_url")
    og = "(open_graph['title'] IS NOT NULL OR open_graph['image'] IS NOT NULL OR open_graph['description'] IS NOT NULL)"
    tw = "(twitter['card'] IS NOT NULL OR twitter['title'] IS NOT NULL OR twitter['image'] IS NOT NULL)"
    canonical_note = (
        f"CASE WHEN head.canonical IS NULL THEN {say('canonical_missing')}"
        f" WHEN coalesce(url, '') = '' THEN {say('canonical_found')}"
        f" WHEN base.url IS NULL OR canonical_url IS NULL THEN {say('canonical_specified', s='head.canonical')}"
        f" WHEN canonical_url = base.url THEN {say('canonical_match')} ELSE {say('canonical_points', s='head.canonical')} END")
    rules = [
        _length_rule("head.title", TITLE_MIN, TITLE_MAX, "title", "fail"),
        _length_rule("head.description", DESCRIPTION_MIN, DESCRIPTION_MAX, "description", "warning"),
        ("CASE WHEN head.canonical IS NULL THEN 'warning' ELSE 'pass' END", "head.canonical", canonical_note),
        ("'pass'", f"coalesce(head.robots, {say('robots_default')})",
         f"coalesce({say('robots', s='head.robots')}, {say('robots_default_note')})"),
        ("CASE h1 WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'warning' END",
         f"CASE h1 WHEN 1 THEN first_h1 WHEN 0 THEN {say('h1_none_value')} ELSE {say('h1_many_value', n='h1')} END",
         f"CASE h1 WHEN 1 THEN {say('h1_one')} WHEN 0 THEN {say('h1_none')} ELSE {say('h1_many', n='h1')} END"),
        ("CASE WHEN h2 > 0 THEN 'pass' ELSE 'info' END", say("sub_value", n="h2", m="h3"),
         f"CASE WHEN h2 > 0 THEN {say('sub_good')} ELSE {say('sub_none')} END"),
        ("CASE WHEN stats.images = 0 THEN 'info' WHEN no_alt = 0 THEN 'pass' ELSE 'warning' END",
         f"CASE WHEN stats.images = 0 THEN {say('img_none_value')} WHEN no_alt = 0 THEN {say('img_all_value', n='stats.images')}"
         f" ELSE {say('img_missing_value', n='stats.images', m='no_alt')} END",
         f"CASE WHEN stats.images = 0 THEN {say('img_none')} WHEN no_alt = 0 THEN {say('img_all')}"
         f" ELSE {say('img_missing', m='no_alt')} END"),
        ("CASE WHEN stats.links > 0 THEN 'pass' ELSE 'info' END",
         say("links_value", n="stats.links", m="internal", k="external"), say("links", n="nofollow")),
        (f"CASE WHEN {og} THEN 'pass' ELSE 'warning' END",
         f"CASE WHEN {og} THEN coalesce(open_graph['title'], {say('configured')}) ELSE {say('not_found')} END",
         f"CASE WHEN {og} THEN {say('og', s='array_join(map_keys(open_graph), ' + q(', ') + ')')} ELSE {say('og_missing')} END"),
        (f"CASE WHEN {tw} THEN 'pass' ELSE 'warning' END",
         f"CASE WHEN {tw} THEN coalesce(twitter['card'], {say('configured')}) ELSE {say('not_found')} END",
         f"CASE WHEN {tw} THEN {say('twitter', s='coalesce(twitter[' + q('card') + '], ' + say('twitter_default') + ')')}"
         f" ELSE {say('twitter_missing')} END"),
        ("CASE WHEN ld > 0 THEN 'pass' ELSE 'info' END",
         f"CASE WHEN ld > 0 THEN {say('ld_value', n='ld')} ELSE {say('ld_none_value')} END",
         f"CASE WHEN ld > 0 THEN {say('ld')} ELSE {say('ld_none')} END"),
    ]
    structs = ", ".join(
        f"named_struct('factor', {q(factor)}, 'status', {status}, 'value', {value}, 'note', {note})"
        for factor, (status, value, note) in zip(FACTORS, rules, strict=True))
    return once(scored, items=f"array({structs})").select(*facts.columns, F.col("base.host").alias("host"), "items")


def items(audited: DataFrame) -> DataFrame:
    """One row per page and factor."""
    return audited.select("page_id", "host", F.inline_outer("items"))


def _status_counts():
    return [
        F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passes"),
        F.count_if(F.col("status") == "warning").alias("warnings"), F.count_if(F.col("status") == "fail").alias("fails")]


def summary(audited: DataFrame) -> DataFrame:
    """Passes, warnings and fails per page, counted inside the row; info counts in none of them."""
    def n(status: str) -> str:
        return f"CAST(size(filter(items, i -> i.status = '{status}')) AS bigint)"

    return audited.selectExpr(
        "page_id", "host", "CAST(size(items) AS bigint) AS total", f"{n('pass')} AS passes",
        f"{n('warning')} AS warnings", f"{n('fail')} AS fails")


def rollup(seo_items: DataFrame) -> DataFrame:
    """Status counts by host and factor, with host and grand totals."""
    return seo_items.rollup("host", "factor").agg(*_status_counts(), F.grouping_id().cast("bigint").alias("level"))


def worst_pages(page_summary: DataFrame, n: int = 3) -> DataFrame:
    """Pages of the `n` worst (fails, warnings) scores of each host.

    Ranks are taken over the distinct scores of a host, a few dozen rows however many pages the host has. The summary is
    read twice, so pass a stored one (`sources.io.store`).
    """
    scores = page_summary.groupBy("host", "fails", "warnings").agg(F.count("*").alias("pages"))
    rank = F.expr("dense_rank() OVER (PARTITION BY host ORDER BY fails DESC, warnings DESC)").cast("bigint")
    ranked = scores.withColumn("rank", rank).where(F.col("rank") <= n).drop("pages")
    found = lookup(page_summary, ranked, ["host", "fails", "warnings"], ["page_id"], "inner")
    return found.select("host", "rank", "page_id", "fails", "warnings")
