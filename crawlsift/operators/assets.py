"""Asset manifests for offline bundles: extraction, selection, local names, byte budget, page rewrite.

A page's assets stay one array in its row until they are listed, so dedupe, cap, selection and numbering need no
window and no shuffle. Only sizes and cross-page counts are joined or grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import markup as M
from crawlsift.functions import urls as U
from crawlsift.functions.plan import lookup, once
from crawlsift.functions.text import q, strip
from crawlsift.operators import html as H

# Bundle limits, excluded prefixes, fallback extensions.
MAX_ASSETS, MAX_ASSET_BYTES, MAX_TOTAL_BYTES = 100, 5 * 1024 * 1024, 30 * 1024 * 1024
EXCLUDED = ["data:", "javascript:", "#", "mailto:"]
FALLBACK_EXT = {"css": ".css", "js": ".js", "images": ".png"}
OTHER_EXT = ".bin"
NAME_CAP = 40
# Where assets come from, in order: element, attribute, condition, type, folder.
SOURCES = [
    ("link", "href", f"{M.attr('e.attrs', 'rel')} = 'stylesheet'", "css", "css"),
    ("script", "src", "true", "js", "js"),
    ("img", "src", "true", "image", "images"),
    ("link", "href", f"contains({M.attr('e.attrs', 'rel')}, 'icon')", "icon", "images"),
    ("source", "src", "true", "media", "media"),
]


def lists(pages: DataFrame, *keep: str) -> DataFrame:
    """Pages with `assets`, all of them: distinct by resolved URL, first wins in source and document order.

    `keep` names lexed columns to carry along; `rewrite` needs `tokens` and `marks`.
    """
    found = ", ".join(
        f"transform(filter(els, e -> e.tag = '{tag}' AND {cond} AND coalesce({M.attr('e.attrs', attr)}, '') <> ''),"
        f" e -> named_struct('ord', {i}, 'pos', e.pos, 'src', {strip(M.attr('e.attrs', attr))}, 'type', '{kind}',"
        f" 'folder', '{folder}', 'attr', '{attr}'))"
        for i, (tag, attr, cond, kind, folder) in enumerate(SOURCES))
    excluded = " OR ".join(f"startswith(c.src, {q(p)})" for p in EXCLUDED)
    by_url = (
        "array_sort(filter(zip_with(candidates, resolved, (c, r) -> named_struct('url', r.url, 'ord', c.ord, 'pos', c.pos,"
        " 'src', c.src, 'type', c.type, 'folder', c.folder, 'attr', c.attr, 'path', r.path)), a -> a.url IS NOT NULL))")
    firsts = "filter(by_url, (a, i) -> i = 0 OR a.url <> get(by_url, i - 1).url)"
    ordered = (
        f"array_sort(transform({firsts}, a -> named_struct('ord', a.ord, 'pos', a.pos, 'original_src', a.src,"
        f" 'resolved_url', a.url, 'type', a.type, 'folder', a.folder, 'attr', a.attr, 'path', a.path)))")
    listed = once(H.lexed(pages), candidates=f"filter(concat({found}), c -> NOT ({excluded}))").select(
        "page_id", "url", "base", "candidates", *keep)
    resolved = once(listed, resolved=U.resolve_urls("transform(candidates, c -> c.src)", "base"))
    return once(once(resolved, by_url=by_url), assets=ordered).select(
        "page_id", "url", F.col("base.host").alias("host"), "assets", *keep)


def first(asset_lists: DataFrame, n: int = MAX_ASSETS) -> DataFrame:
    """Keep the first `n` assets of each page, as a bundle lists them."""
    return asset_lists.withColumn("assets", F.slice("assets", 1, n))


def select(asset_lists: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep the assets a page's selection names by resolved or original URL; a page without selection keeps all.

    `selection(page_id, selected_url)` is what one user ticked on one page, so it is gathered per page.
    """
    chosen = selection.groupBy("page_id").agg(F.collect_set(F.expr(strip("selected_url"))).alias("chosen"))
    kept = "filter(assets, a -> array_contains(chosen, a.resolved_url) OR array_contains(chosen, a.original_src))"
    return asset_lists.join(chosen, "page_id", "left").withColumn(
        "assets", F.expr(f"CASE WHEN chosen IS NULL THEN assets ELSE {kept} END")).drop("chosen")


def with_paths(asset_lists: DataFrame) -> DataFrame:
    """Number the assets of a page and give each its local path."""
    base = "regexp_extract(a.path, '([^/]*)/*$', 1)"
    clean = f"substr(regexp_replace({base}, '[^a-zA-Z0-9_.-]', '_'), 1, {NAME_CAP})"
    ext = "CASE a.folder " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FALLBACK_EXT.items()) + f" ELSE '{OTHER_EXT}' END"
    path = (
        f"concat('assets/', a.folder, CASE WHEN substr({base}, 2) LIKE '%.%' THEN concat('/', i + 1, '_', {clean})"
        f" ELSE concat('/asset_', i + 1, {ext}) END)")
    return asset_lists.withColumn("assets", F.expr(
        "transform(assets, (a, i) -> named_struct('idx', i + 1, 'pos', a.pos, 'original_src', a.original_src,"
        f" 'resolved_url', a.resolved_url, 'type', a.type, 'folder', a.folder, 'attr', a.attr, 'local_path', {path}))"))


def bundle_name(host: Column) -> Column:
    """File name of a page's bundle."""
    return F.concat(F.lit("bundle-"), F.regexp_replace(host, "[^a-zA-Z0-9_.-]", "_"))


def manifest(numbered: DataFrame) -> DataFrame:
    """One row per asset."""
    return numbered.select("page_id", "host", F.inline_outer("assets")).where("resolved_url IS NOT NULL")


def budget(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Decide which assets fit: each at most 5 MB, none once 30 MB are reached.

    `rows` are those of `first`, so the running sum is over a bounded group. `sizes(resolved_url, bytes,
    status_code)` holds one row per URL; URLs that very many pages share are looked up by broadcast.
    """
    fits = F.expr(f"coalesce(status_code BETWEEN 200 AND 299 AND bytes > 0 AND bytes <= {MAX_ASSET_BYTES}, false)")
    before = F.expr(
        "coalesce(sum(CASE WHEN fits THEN bytes ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    outcome = (
        F.when(F.col("before_bytes") >= MAX_TOTAL_BYTES, F.lit("total_limit"))
        .when(F.col("bytes").isNull(), F.lit("not_recorded"))
        .when(F.col("bytes") > MAX_ASSET_BYTES, F.lit("asset_limit"))
        .when(F.col("fits"), F.lit("included")).otherwise(F.lit("failed")))
    return (
        lookup(rows, sizes.select("resolved_url", "bytes", "status_code"), ["resolved_url"], ["page_id", "idx"])
        .withColumn("fits", fits).withColumn("before_bytes", before.cast("bigint"))
        .select("page_id", "idx", "resolved_url", "local_path", "bytes", "before_bytes", outcome.alias("outcome")))


def manifest_stats(asset_lists: DataFrame, budgeted: DataFrame) -> DataFrame:
    """Assets found (pass whole lists), included and their bytes per page."""
    included = budgeted.where("outcome = 'included'").groupBy("page_id").agg(
        F.count("*").alias("included"), F.sum("bytes").alias("bytes"))
    return asset_lists.select("page_id", "url", F.size("assets").cast("bigint").alias("found")).join(
        included, "page_id", "left").na.fill(0, ["included", "bytes"])


def rewrite(numbered: DataFrame, as_of: str) -> DataFrame:
    """Pages whose asset attributes point to local paths, with a provenance comment at the start of the head, else after
    `<html>`, else in front.

    The document is rebuilt from the tokens that the asset list was read from, in the same row: HTML is lexed once and
    never shuffled, and only the element that was listed changes.
    """
    before = (
        r"^(?i)(<[a-z][^\s/>]*+(?:[\s/]++(?!ATTR[\s=/>])[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+)*+"
        r"[\s/]++ATTR\s*+=\s*+)(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)").replace('\\"', '"')

    def swap(attr: str) -> str:
        return (f"regexp_replace(t, {q(before.replace('ATTR', attr))},"
                f" concat('$1\"./', get(targets, array_position(places, i) - 1).path, '\"'))")

    hit = "startswith(t, '<') AND array_contains(places, i)"
    href = "get(targets, array_position(places, i) - 1).attr = 'href'"
    comment = (
        f"concat('<!-- Offline bundle | Source URL: ', url, ' | Archive Timestamp: ', {q(as_of)}, ' -->')")
    body = (
        f"transform(tokens, (t, i) -> CASE WHEN {hit} AND {href} THEN {swap('href')} WHEN {hit} THEN {swap('src')}"
        f" WHEN i = head_pos THEN concat(t, {comment}) ELSE t END)")
    ready = numbered.selectExpr(
        "page_id", "url", "tokens", "coalesce(get(filter(marks, m -> m.tag = 'head'), 0).pos, get(filter(marks, m -> m.tag = 'html'), 0).pos) AS head_pos",
        "transform(assets, a -> a.pos) AS places", "transform(assets, a -> named_struct('attr', a.attr, 'path', a.local_path)) AS targets")
    return ready.select("page_id", "url", F.expr(
        f"concat(CASE WHEN head_pos IS NULL THEN {comment} ELSE '' END, array_join({body}, ''))").alias("html"))


def inventory(facts: DataFrame) -> DataFrame:
    """Selectable files of each page: scripts, stylesheets and image sources, distinct per category."""
    parts = [("script", "script_files.url"), ("stylesheet", "stylesheet_files.url"), ("image", "images.src")]
    rows = ", ".join(f"transform(array_distinct({files}), u -> named_struct('category', '{kind}', 'selected_url', u))" for kind, files in parts)
    return facts.select("page_id", F.inline_outer(F.expr(f"concat({rows})"))).where("selected_url IS NOT NULL")


def select_all(listing: DataFrame) -> DataFrame:
    """Selection with everything listed."""
    return listing.select("page_id", "selected_url").distinct()


def add(selection: DataFrame, more: DataFrame) -> DataFrame:
    """Selection with more rows ticked."""
    return selection.select("page_id", "selected_url").union(more.select("page_id", "selected_url")).distinct()


def remove(selection: DataFrame, less: DataFrame) -> DataFrame:
    """Selection with rows unticked."""
    return selection.select("page_id", "selected_url").subtract(less.select("page_id", "selected_url"))


def of_category(listing: DataFrame, category: str) -> DataFrame:
    """Rows of one category, to add or remove as a whole."""
    return listing.where(F.col("category") == category).select("page_id", "selected_url")


def selected_counts(listing: DataFrame, selection: DataFrame) -> DataFrame:
    """`n of m` per page: selected files and all distinct files."""
    everything = select_all(listing)
    ticked = selection.select("page_id", "selected_url").distinct().withColumn("ticked", F.lit(1))
    return everything.join(ticked, ["page_id", "selected_url"], "left").groupBy("page_id").agg(
        F.count("ticked").alias("selected"), F.count("*").alias("total"))


def shared(rows: DataFrame) -> DataFrame:
    """Assets by the pages and hosts that use them; assets are already distinct per page.

    Grouping by URL and host first keeps a URL that every page uses down to one row per host.
    """
    per_host = rows.groupBy("resolved_url", "type", "host").agg(F.count("*").alias("pages"))
    return per_host.groupBy("resolved_url", "type").agg(F.sum("pages").alias("pages"), F.count("*").alias("hosts"))
