"""HTML extraction: one lexing pass per page, every fact computed inside the page's row, no shuffle.

`analyse` lays out all facts of a page as nested columns. The other operators select from it, so Catalyst prunes what
a query does not ask for and the document is lexed once. A page is bounded by the crawler's body limit, so nothing
here grows with a host or a corpus.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.functions import markup as M
from crawlsift.functions import urls as U
from crawlsift.functions.plan import once
from crawlsift.functions.text import decode_entities, present, q, q_list, squish, strip

# List lengths of a page report and of its shorter parts.
LINK_CAP, IMAGE_CAP, SCRIPT_CAP, STYLESHEET_CAP, SUBHEADING_CAP, TEXT_CAP = 150, 150, 100, 100, 10, 100
NO_REL = "—"
MISSING_ALT = "Missing"
DATA_SCRIPT_TYPES = ["application/ld+json", "application/json", "importmap"]
HTML_TYPES = ["text/html", "application/xhtml+xml"]

_HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
_ATTR_TAGS = ["html", "meta", "link", "img", "script", "source"]


def scan(pages: DataFrame) -> DataFrame:
    """Pages that have a document at all."""
    return pages.where("html IS NOT NULL AND html <> ''")


def _mark_rows(pages: DataFrame) -> DataFrame:
    return once(scan(pages), base=U.parse_url("url"), tokens=M.tokens("html")).withColumn("marks", F.expr(M.marks("tokens")))


def lexed(pages: DataFrame) -> DataFrame:
    """Pages with `base`, `tokens`, `marks` and the attribute-bearing elements `els`."""
    els = (
        f"transform(filter(marks, lm -> lm.tag IN {q_list(_ATTR_TAGS)}), le -> named_struct('pos', le.pos, 'tag', le.tag,"
        f" 'attrs', {M.parse_attrs('le.raw')}, 'raw', le.raw))")
    return _mark_rows(pages).withColumn("els", F.expr(els))


def elements(pages: DataFrame) -> DataFrame:
    """Every element in document order with its attributes."""
    opened = _mark_rows(pages).select("page_id", "url", F.expr("inline_outer(filter(marks, em -> NOT startswith(em.tag, '/')))"))
    opened = opened.where("pos IS NOT NULL")
    sorted_pairs = once(opened, pairs=M.by_key(M.parse_attrs("raw")))
    return sorted_pairs.select("page_id", "url", "pos", "tag", F.expr(M.first_wins("pairs")).alias("attrs"))


def element_attributes(elems: DataFrame) -> DataFrame:
    """One row per attribute of every element."""
    return elems.select("page_id", "pos", "tag", F.explode_outer("attrs").alias("attr", "value")).where("attr IS NOT NULL")


def tag_census(pages: DataFrame) -> DataFrame:
    """Elements and pages per tag."""
    per_page = _mark_rows(pages).select(
        "page_id", F.explode_outer(F.expr("transform(filter(marks, em -> NOT startswith(em.tag, '/')), em -> em.tag)")).alias("tag")
    ).where("tag IS NOT NULL").groupBy("tag", "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("tag").agg(F.sum("n").alias("elements"), F.count("*").alias("pages"))


def _first(source: str, cond: str) -> str:
    return f"get(filter({source}, fe -> {cond}), 0)"


def _meta(key: str, value: str) -> str:
    return present(_first("metas", f"fe.{key} = '{value}'") + ".content")


def _link(rel: str) -> str:
    return present(_first("rels", f"fe.rel = '{rel}'") + ".href")


def _count(tag: str) -> str:
    return f"CAST(size(tags) - size(array_remove(tags, '{tag}')) AS bigint)"


def _pairs(key: str, prefix: str) -> str:
    """Key and content of each `prefix*` meta in document order."""
    return (
        f"filter(transform(filter(metas, oe -> startswith(oe.{key}, '{prefix}')),"
        f" oe -> named_struct('k', substr(oe.{key}, {len(prefix) + 1}), 'v', {present('oe.content')})),"
        f" op -> op.k <> '' AND op.v IS NOT NULL)")


def _texts(tag: str) -> str:
    """Non-empty texts of one heading level."""
    return f"transform(filter(titles, ht -> ht.tag = '{tag}' AND ht.text <> ''), ht -> ht.text)"


def _title() -> str:
    return present(decode_entities(M.raw_body(_first("marks", "fe.tag = 'title'") + ".raw")))


def analyse(pages: DataFrame, *parts: str) -> DataFrame:
    """One row per page with nested stats, head, headings, links, images, scripts, stylesheets, social and JSON-LD.

    Lists are whole here and their counters uncapped; the report's list lengths are applied where lists are shown.
    Naming the `parts` needed saves planning time; what is not selected later is not computed either way.
    """
    anchors = (
        f"filter(transform(transform({M.spans('a_marks')},"
        f" an -> named_struct('pos', an.pos, 'attrs', {M.parse_attrs('an.raw')},"
        f" 'text', substr({squish(M.inner_text('tokens', 'an'))}, 1, {TEXT_CAP}))),"
        f" aa -> named_struct('pos', aa.pos, 'href', {strip(M.attr('aa.attrs', 'href'))},"
        f" 'rel', {strip('coalesce(' + M.attr('aa.attrs', 'rel') + ', ' + q('') + ')')}, 'text', aa.text)),"
        f" ah -> ah.href <> '' AND NOT startswith(ah.href, '#') AND NOT startswith(ah.href, 'javascript:'))")
    scripts = (
        f"transform(filter(els, xs -> xs.tag = 'script'), xs -> named_struct('pos', xs.pos,"
        f" 'type', lower({strip('coalesce(' + M.attr('xs.attrs', 'type') + ', ' + q('') + ')')}),"
        f" 'written_type', lower({M.attr('xs.attrs', 'type')}), 'src', {present(M.attr('xs.attrs', 'src'))},"
        f" 'body', {M.raw_body('xs.raw')}))")
    sheets = (
        f"transform(filter(rels, xl -> contains(xl.rel, 'stylesheet')), xl -> named_struct('pos', xl.pos, 'href', {present('xl.href')}))")
    metas = (
        f"transform(filter(els, me -> me.tag = 'meta'), me -> named_struct('name', lower({M.attr('me.attrs', 'name')}),"
        f" 'property', lower({M.attr('me.attrs', 'property')}), 'equiv', lower({M.attr('me.attrs', 'http-equiv')}),"
        f" 'charset', {M.attr('me.attrs', 'charset')}, 'content', {M.attr('me.attrs', 'content')}))")
    rels = (
        f"transform(filter(els, re -> re.tag = 'link'), re -> named_struct('pos', re.pos, 'rel', lower({M.attr('re.attrs', 'rel')}),"
        f" 'href', {M.attr('re.attrs', 'href')}))")
    bounds = q_list(_HEADINGS + ["/" + h for h in _HEADINGS])
    steps = [
        {"metas": metas, "rels": rels, "tags": "transform(marks, cm -> cm.tag)",
         "a_marks": "filter(marks, cm -> cm.tag IN ('a', '/a'))", "h_marks": f"filter(marks, cm -> cm.tag IN {bounds})"},
        {"titles": f"transform({M.spans('h_marks')}, hs -> named_struct('tag', hs.tag, 'text', {squish(M.inner_text('tokens', 'hs'))}))"},
        {"anchors": anchors, "scripts": scripts, "sheets": sheets, "og_pairs": M.by_key(_pairs("property", "og:")),
         "tw_pairs": M.by_key(_pairs("name", "twitter:"))},
        {"code_files": f"filter(scripts, xs -> xs.src IS NOT NULL AND xs.type NOT IN {q_list(DATA_SCRIPT_TYPES)})",
         "sheet_files": "filter(sheets, xl -> xl.href IS NOT NULL)"},
        {"anchor_urls": U.resolve_urls("transform(anchors, xa -> xa.href)", "base"),
         "code_urls": U.resolve_urls("transform(code_files, xs -> xs.src)", "base"),
         "sheet_urls": U.resolve_urls("transform(sheet_files, xl -> xl.href)", "base")},
    ]

    internal = (
        "CASE WHEN base.url IS NULL THEN NOT zl.href RLIKE '^https?://' WHEN zr.url IS NULL THEN NOT startswith(zl.href, 'http')"
        " ELSE zr.host = base.host END")
    links = (
        f"zip_with(anchors, anchor_urls, (zl, zr) -> named_struct('pos', zl.pos, 'url', coalesce(zr.url, zl.href),"
        f" 'raw_href', zl.href, 'text', zl.text, 'type', CASE WHEN {internal} THEN 'Internal' ELSE 'External' END,"
        f" 'rel', CASE WHEN zl.rel = '' THEN '{NO_REL}' ELSE zl.rel END, 'is_nofollow', zl.rel RLIKE '(?i)nofollow'))")
    alt = f"coalesce({strip(M.attr('xi.attrs', 'alt'))}, '')"
    lazy = f"coalesce(lower({M.attr('xi.attrs', 'loading')}) = 'lazy', false) OR {M.attr('xi.attrs', 'data-lazy')} IS NOT NULL"
    images = (
        f"filter(transform(filter(els, xi -> xi.tag = 'img'), xi -> named_struct('pos', xi.pos,"
        f" 'src', coalesce({present(M.attr('xi.attrs', 'src'))}, {present(M.attr('xi.attrs', 'data-src'))}),"
        f" 'alt', CASE WHEN {alt} = '' THEN '{MISSING_ALT}' ELSE {alt} END, 'has_alt', {alt} <> '',"
        f" 'loading', CASE WHEN {lazy} THEN 'lazy' ELSE 'eager' END)), xi -> xi.src IS NOT NULL)")
    lang = M.attr(_first("els", "fe.tag = 'html'") + ".attrs", "lang")
    charset = _first("metas", "fe.charset IS NOT NULL") + ".charset"
    ld = (
        f"transform(filter(scripts, xs -> xs.written_type = 'application/ld+json' AND xs.body <> ''),"
        f" xs -> named_struct('pos', xs.pos, 'json', {strip('xs.body')}))")
    outputs = {
        "stats":
            "named_struct('total_size', CAST(octet_length(html) AS bigint),"
            " 'dom_elements', CAST(size(filter(tags, ct -> NOT startswith(ct, '/'))) AS bigint),"
            f" 'links', {_count('a')}, 'images', {_count('img')}, 'scripts', {_count('script')},"
            f" 'stylesheets', CAST(size(sheets) AS bigint), 'inline_styles', {_count('style')}, 'forms', {_count('form')})",
        "head":
            f"named_struct('title', {_title()},"
            f" 'description', coalesce({_meta('name', 'description')}, {_meta('property', 'og:description')}),"
            f" 'keywords', {_meta('name', 'keywords')}, 'robots', {_meta('name', 'robots')}, 'canonical', {_link('canonical')},"
            f" 'lang', {present(lang)}, 'charset', coalesce({present(charset)}, {_meta('equiv', 'content-type')}),"
            f" 'viewport', {_meta('name', 'viewport')},"
            f" 'favicon', coalesce({_link('icon')}, {_link('shortcut icon')}, {_link('apple-touch-icon')}))",
        "headings": f"named_struct('h1', {_texts('h1')}, 'h2', {_texts('h2')}, 'h3', {_texts('h3')})",
        "links": links,
        "images": images,
        "script_files": "zip_with(code_files, code_urls, (zs, zr) -> named_struct('pos', zs.pos, 'url', coalesce(zr.url, zs.src)))",
        "inline_scripts":
            f"CAST(size(filter(scripts, xs -> xs.src IS NULL AND xs.type NOT IN {q_list(DATA_SCRIPT_TYPES)})) AS bigint)",
        "stylesheet_files":
            "zip_with(sheet_files, sheet_urls, (zs, zr) -> named_struct('pos', zs.pos, 'url', coalesce(zr.url, zs.href)))",
        "open_graph": M.last_wins("og_pairs"),
        "twitter": M.last_wins("tw_pairs"),
        "json_ld": ld,
    }
    wanted = {name: sql for name, sql in outputs.items() if not parts or name in parts}
    used, kept = list(wanted.values()), []
    for step in reversed(steps):
        named = {name: sql for name, sql in step.items() if any(re.search(rf"\b{name}\b", text) for text in used)}
        used += named.values()
        kept.insert(0, named)
    found = lexed(pages)
    for named in kept:
        found = found.withColumns({name: F.expr(sql) for name, sql in named.items()}) if named else found
    return found.select("page_id", "url", "base", "html", *[F.expr(sql).alias(name) for name, sql in wanted.items()])


def page_stats(facts: DataFrame) -> DataFrame:
    """Document size and element counters per page."""
    return facts.select("page_id", "url", "stats.*")


def head_meta(facts: DataFrame) -> DataFrame:
    """Title, metas, canonical, language, charset and icon per page."""
    return facts.select("page_id", "url", "head.*")


def headings(facts: DataFrame) -> DataFrame:
    """Heading counts with all h1 and the first h2 and h3 texts."""
    return facts.select(
        "page_id",
        *[F.size(f"headings.{h}").cast("bigint").alias(f"{h}_count") for h in ("h1", "h2", "h3")],
        F.col("headings.h1").alias("h1"),
        F.slice("headings.h2", 1, SUBHEADING_CAP).alias("h2"), F.slice("headings.h3", 1, SUBHEADING_CAP).alias("h3"))


def top_n(facts: DataFrame, column: str, n: int) -> DataFrame:
    """Cut a page's list to its first `n` entries in document order."""
    return facts.withColumn(column, F.slice(column, 1, n))


def rows_of(facts: DataFrame, column: str) -> DataFrame:
    """One row per entry of a page's list.

    The outer form keeps the optimizer from inferring `size(list) > 0` below the projection, which would lex twice.
    """
    return facts.select("page_id", F.col("url").alias("page_url"), F.inline_outer(column)).where("pos IS NOT NULL")


def links(facts: DataFrame) -> DataFrame:
    """Classified links, one row each."""
    return rows_of(facts, "links")


def _n(array: str, cond: str) -> Column:
    return F.expr(f"CAST(size(filter({array}, x -> {cond})) AS bigint)")


def link_counts(facts: DataFrame) -> DataFrame:
    """Totals per page; total counts every anchor, the other counters only real targets."""
    return facts.select(
        "page_id", "url", F.col("base.host").alias("host"), F.col("stats.links").alias("total"),
        _n("links", "x.type = 'Internal'").alias("internal"), _n("links", "x.type = 'External'").alias("external"),
        _n("links", "x.is_nofollow").alias("nofollow"))


def site_link_profile(facts: DataFrame) -> DataFrame:
    """Pages, links and link mix per host."""
    return link_counts(facts).groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("total").alias("links"), F.sum("internal").alias("internal"),
        F.sum("external").alias("external"), F.sum("nofollow").alias("nofollow"), F.max("total").alias("max_links"))


def image_audit(facts: DataFrame) -> DataFrame:
    """Image counters per page; total counts every img, the others only those with a source."""
    return facts.select(
        "page_id", F.col("stats.images").alias("total"), _n("images", "x.has_alt").alias("with_alt"),
        _n("images", "NOT x.has_alt").alias("missing_alt"), _n("images", "x.loading = 'lazy'").alias("lazy"))


def script_breakdown(facts: DataFrame) -> DataFrame:
    """External and inline executable scripts per page, with the first files."""
    return facts.select(
        "page_id", F.col("stats.scripts").alias("total"), F.size("script_files").cast("bigint").alias("external_count"),
        F.col("inline_scripts").alias("inline_count"), F.slice("script_files.url", 1, SCRIPT_CAP).alias("files"))


def stylesheet_breakdown(facts: DataFrame) -> DataFrame:
    """External stylesheets and inline style elements per page, with the first files."""
    return facts.select(
        "page_id", F.col("stats.stylesheets").alias("total"),
        F.size("stylesheet_files").cast("bigint").alias("external_count"),
        F.col("stats.inline_styles").alias("inline_count"), F.slice("stylesheet_files.url", 1, STYLESHEET_CAP).alias("files"))


def social_pairs(facts: DataFrame, column: str) -> DataFrame:
    """`open_graph` or `twitter` maps as rows."""
    return facts.select("page_id", F.explode_outer(column).alias("key", "content")).where("key IS NOT NULL")


def json_ld(facts: DataFrame) -> DataFrame:
    """JSON-LD blocks as VARIANT; a block that does not parse stays, marked as malformed."""
    blocks = rows_of(facts, "json_ld").withColumn("item", F.try_parse_json("json"))
    return blocks.withColumn("is_malformed", F.col("item").isNull())


def json_ld_census(blocks: DataFrame) -> DataFrame:
    """Blocks and pages by `@type`."""
    kind = F.when(F.col("is_malformed"), F.lit("(malformed)")).otherwise(
        F.coalesce(F.try_variant_get("item", '$["@type"]', "string"), F.lit("(none)")))
    per_page = blocks.groupBy(kind.alias("type"), "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("type").agg(F.sum("n").alias("blocks"), F.count("*").alias("pages"))


# Markers of server-side state in a document, first match wins.
FRAMEWORKS = [
    ("Next.js", ['id="__NEXT_DATA__"']),
    ("Nuxt.js", ['id="__NUXT_DATA__"', "window.__NUXT__"]),
    ("Redux/SSR", ["__INITIAL_STATE__"]),
]


def framework(pages: DataFrame) -> DataFrame:
    """Framework marker of each page, NULL when there is none."""
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains(html, {q(n)})" for n in needles) + f" THEN {q(label)}" for label, needles in FRAMEWORKS)
    return scan(pages).select("page_id", "url", F.expr(f"CASE {cases} END").alias("framework"))


def framework_census(pages: DataFrame) -> DataFrame:
    """Pages per framework marker."""
    return framework(pages).groupBy(F.coalesce("framework", F.lit("(none)")).alias("framework")).agg(
        F.count("*").alias("pages"))


def eligibility(responses: DataFrame) -> DataFrame:
    """Media type of each response and whether it can be analysed as HTML."""
    kind = "lower(" + strip("substring_index(coalesce(content_type, ''), ';', 1)") + ")"
    is_html = F.col("media_type").isin(HTML_TYPES)
    notice = F.concat(
        F.lit("The server returned '"), F.coalesce(F.nullif(F.col("media_type"), F.lit("")), F.lit("unknown")),
        F.lit("'. HTML structure inspection is only available for HTML resources."))
    return responses.withColumn("media_type", F.expr(kind)).withColumns(
        {"is_html": is_html, "notice": F.when(~is_html, notice)})


def choose_source(server: DataFrame, rendered: DataFrame) -> DataFrame:
    """Prefer the rendered document of a page over the server's, and say which mode applies."""
    shown = F.nullif(F.col("rendered_html"), F.lit(""))
    return server.join(rendered.select("page_id", "rendered_html"), "page_id", "left").select(
        "page_id", "url", F.coalesce(shown, F.col("html")).alias("html"),
        F.when(shown.isNotNull(), F.lit("dynamic")).otherwise(F.lit("fast")).alias("mode"))


def search_links(facts: DataFrame, needle: str) -> DataFrame:
    """Links whose URL contains the needle in any case."""
    return links(facts).where(F.contains(F.lower("url"), F.lit(needle.lower().strip())))


def search(pages: DataFrame, needle: str) -> DataFrame:
    """Source lines that contain the needle in any case, with line number and hit count."""
    query = needle.strip()
    lines = scan(pages).where(F.contains(F.lower("html"), F.lit(query.lower()))).select(
        "page_id", F.posexplode_outer(F.split("html", r"\r?\n")).alias("line0", "line"))
    quoted = r"(?iu)\Q" + query.replace(r"\E", r"\E\\E\Q") + r"\E"
    return lines.where(F.contains(F.lower("line"), F.lit(query.lower()))).select(
        "page_id", (F.col("line0") + 1).cast("bigint").alias("line_no"), "line",
        F.regexp_count("line", F.lit(quoted)).cast("bigint").alias("hits"))


# Which open element a start tag closes by itself, and the elements that shield it.
_P_CLOSERS = [
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section",
    "table", "ul", "li", "dt", "dd"]
_IMPLIED_END = [
    (["body"], ["head"], []),
    (["li"], ["li"], ["ul", "ol"]),
    (["dt", "dd"], ["dt", "dd"], ["dl"]),
    (["option"], ["option"], ["select"]),
    (["tr"], ["tr"], ["table"]),
    (["td", "th"], ["td", "th"], ["tr", "table"]),
    (_P_CLOSERS, ["p"], ["button", "td", "th", "caption", "table"]),
]
_LEAF = ["noscript", "iframe", "svg"]
_HIDDEN = ["script", "style"]
# Steps of the outline's fold that share one list of results.
OUTLINE_BLOCK = 256


def outline(pages: DataFrame, max_depth: int = 4) -> DataFrame:
    """Element tree down to `max_depth` as flat rows `(page_id, pos, depth, parent_pos, tag, id, class)`.

    A fold over the page's tags keeps the stack of open elements, with the usual implied end tags, so unclosed `<p>`
    or `<li>` do not shift what follows. Tags are folded in blocks of `OUTLINE_BLOCK`: what a block finds is laid by before the
    next one, so no array grows with the page while tags are added to it, and the work is in proportion to the tags.
    """
    row = "struct<k:int,pos:int,depth:int,parent_pos:int>"
    state = f"struct<names:array<string>,places:array<int>,seen:array<{row}>>"
    whole = f"struct<names:array<string>,places:array<int>,blocks:array<array<{row}>>>"

    def last(names: list[str]) -> str:
        """1-based place of the last of these names on the stack, 0 when there is none."""
        places = ", ".join(
            f"if(array_contains(st.names, '{n}'), size(st.names) + 1 - array_position(reverse(st.names), '{n}'), 0)" for n in names)
        return f"greatest(0, {places})" if names else "0"

    # how much of the stack stays open when a tag arrives
    closers = sorted({t for starts, _, _ in _IMPLIED_END for t in starts})
    by_start = f"CASE WHEN sg.tag NOT IN {q_list(closers)} THEN size(st.names) ELSE least(size(st.names), " + ", ".join(
        f"CASE WHEN sg.tag IN {q_list(starts)} AND {last(targets)} > {last(shields)} THEN {last(targets)} - 1 ELSE size(st.names) END"
        for starts, targets, shields in _IMPLIED_END) + ") END"
    by_end = (
        "CASE WHEN sg.tag IN ('/html', '/body') OR NOT array_contains(st.names, substr(sg.tag, 2)) THEN size(st.names)"
        " ELSE size(st.names) - array_position(reverse(st.names), substr(sg.tag, 2)) END")
    keep = f"CAST(CASE WHEN startswith(sg.tag, '/') THEN {by_end} ELSE {by_start} END AS int)"
    cut = f"named_struct('names', slice(st.names, 1, {keep}), 'places', slice(st.places, 1, {keep}), 'seen', st.seen)"
    opens = (
        f"NOT startswith(sg.tag, '/') AND sg.tag NOT IN {q_list(_HIDDEN)}"
        f" AND NOT (sg.tag IN ('html', 'head', 'body') AND array_contains(st.names, sg.tag))")
    holds = f"{opens} AND sg.tag NOT IN {q_list(M.VOID + M.RAW_TEXT)}"
    shown = f"{opens} AND size(st.names) < {max_depth} AND NOT arrays_overlap(st.names, array{q_list(_LEAF)})"
    entry = "named_struct('k', sg.k, 'pos', sg.pos, 'depth', size(st.names) + 1, 'parent_pos', try_element_at(st.places, -1))"
    push = (
        f"named_struct('names', CASE WHEN {holds} THEN array_append(st.names, sg.tag) ELSE st.names END,"
        f" 'places', CASE WHEN {holds} THEN array_append(st.places, sg.pos) ELSE st.places END,"
        f" 'seen', CASE WHEN {shown} THEN array_append(st.seen, {entry}) ELSE st.seen END)")
    # a tag is visited twice: first to close what it ends, then to open
    steps = (
        "flatten(transform(marks, (om, ok) -> array("
        "named_struct('closing', true, 'pos', om.pos, 'tag', om.tag, 'k', ok),"
        " named_struct('closing', false, 'pos', om.pos, 'tag', om.tag, 'k', ok))))")
    blocks = (
        f"get(transform(array({steps}), os -> transform(sequence(0, greatest(size(os) - 1, 0) div {OUTLINE_BLOCK}),"
        f" ob -> slice(os, ob * {OUTLINE_BLOCK} + 1, {OUTLINE_BLOCK}))), 0)")
    block = (
        f"aggregate(sb, CAST(named_struct('names', so.names, 'places', so.places, 'seen', array()) AS {state}),"
        f" (st, sg) -> CASE WHEN sg.closing THEN CAST({cut} AS {state}) ELSE CAST({push} AS {state}) END,"
        f" st -> CAST(named_struct('names', st.names, 'places', st.places, 'blocks', array_append(so.blocks, st.seen)) AS {whole}))")
    tree = (
        f"aggregate({blocks}, CAST(named_struct('names', array(), 'places', array(), 'blocks', array()) AS {whole}),"
        f" (so, sb) -> {block}, so -> flatten(so.blocks))")
    rows = once(_mark_rows(pages).select("page_id", "marks"), tree=tree).selectExpr(
        "page_id", "inline_outer(transform(tree, t -> named_struct('pos', t.pos, 'depth', t.depth, 'parent_pos', t.parent_pos,"
        " 'm', get(marks, t.k))))").where("pos IS NOT NULL")
    return rows.withColumn("attrs", F.expr(M.parse_attrs("m.raw"))).selectExpr(
        "page_id", "pos", "depth", "parent_pos", "m.tag AS tag",
        f"nullif({M.attr('attrs', 'id')}, '') AS id", f"nullif({M.attr('attrs', 'class')}, '') AS class")
