"""The registered queries as plain SQL for the checking engine, over the given tables.

Written apart from the Spark side: documents are unnested into one row per token and aggregated again, where the Spark
side stays inside the page's row. Only the derivation of recorded tables and the fixed values are shared.
"""

from __future__ import annotations

from crawlsift.operators import dns_tls, headers, html, http, limits, netevents, seo, trace, urls
from crawlsift.plans import recorded as R
from crawlsift.plans import registry as G


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _body(exprs: list[str]) -> str:
    return ", ".join(exprs)


# ---- documents -----------------------------------------------------------------------------------------------------
_A = r"""(?:[^=>]+|=\s*(?:"[^"]*"|'[^']*')?)*"""
_RAW = ["script", "style", "title"]
_TOKEN = (
    r"(?is)[^<]+|<!--.*?-->" + "".join(rf"|<{t}(?:[\s/]{_A})?>.*?</{t}[^>]*>" for t in _RAW)
    + rf"|</?[a-z][^\s/>]*{_A}>|<[!?/][^>]*>|<")


def _strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def _squish(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def _present(e: str) -> str:
    return f"nullif({_strip(e)}, '')"


def _decode(e: str) -> str:
    for name, char in (("&quot;", "chr(34)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&amp;", "'&'")):
        e = f"replace({e}, '{name}', {char})"
    return e


def _attr(name: str, tag: str = "op") -> str:
    value = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))"""
    parts = " || ".join(f"regexp_extract({tag}, {_q(value)}, {i})" for i in (1, 2, 3))
    pattern = rf"(?i)\s{name}[\s=/>]"
    return f"(CASE WHEN regexp_matches({tag}, {_q(pattern)}) THEN {_decode(parts)} END)"


def _src(rich: bool) -> str:
    return f"src AS (SELECT {_body(R.PAGES_RICH) if rich else 'page_id, url, html'} FROM pages)"


def _doc(rich: bool = True) -> str:
    """CTEs src, tok (all tokens) and mark (tags with their opening text `op`)."""
    return (
        f"{_src(rich)}, toks AS (SELECT page_id, url, regexp_extract_all(html, {_q(_TOKEN)}) AS l FROM src WHERE html <> ''),"
        " tok AS (SELECT page_id, url, unnest(l) AS t, unnest(range(len(l))) AS pos FROM toks),"
        r" mark AS (SELECT page_id, url, pos, t, lower(regexp_extract(t, '^<(/?[a-zA-Z][^\s/>]*)', 1)) AS tag,"
        r" regexp_extract(t, '^<[^>]*>') AS op FROM tok WHERE regexp_matches(t, '^</?[a-zA-Z]')),"
        f" page AS (SELECT page_id, url, {R.HOST} AS host FROM src WHERE html <> '')")


def _resolve(name: str, source: str, href: str = "href") -> str:
    """CTE `name`: the rows of `source` with r_url, r_host and r_path of the reference against the page URL."""
    n = name
    encode = (
        "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]|[\"<>`{{}}^]')"
        " THEN url_encode(c) ELSE c END), '')")
    return (
        f"{n}_a AS (SELECT *, CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href}"
        f" WHEN starts_with({href}, '//') THEN regexp_extract(url, '^https?:') || {href}"
        f" WHEN starts_with({href}, '/') THEN regexp_extract(url, '^https?://[^/?#]*') || {href}"
        f" WHEN starts_with({href}, '?') THEN regexp_extract(url, '^[^?#]*') || {href}"
        f" WHEN starts_with({href}, '#') THEN regexp_extract(url, '^[^#]*') || {href}"
        f" WHEN {href} = '' THEN regexp_extract(url, '^[^#]*')"
        f" ELSE regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '') || {href} END AS a FROM {source}),"
        f" {n}_b AS (SELECT *, lower(regexp_extract(a, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS a_scheme,"
        f" lower(regexp_extract(a, '^[a-zA-Z]+://([^/?#]*)', 1)) AS a_auth, regexp_extract(a, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS a_path,"
        f" regexp_extract(a, '^[^?#]*([?][^#]*)', 1) AS a_query, regexp_extract(a, '#.*$') AS a_frag FROM {n}_a),"
        f" {n}_c AS (SELECT *, CASE WHEN (a_scheme = 'https' AND a_auth LIKE '%:443') OR (a_scheme = 'http' AND a_auth LIKE '%:80')"
        f" THEN regexp_extract(a_auth, '^[^:]*') ELSE a_auth END AS auth,"
        " CASE WHEN a_path = '' THEN '/' ELSE list_reduce(string_split(a_path, '/')[2:], lambda acc, s: CASE WHEN s = '..'"
        " THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END, '') END AS n_path FROM " + f"{n}_b),"
        f" {n} AS (SELECT * EXCLUDE (a, a_scheme, a_auth, a_path, a_query, a_frag, auth, n_path), a_scheme AS r_scheme, CASE WHEN a_scheme IN ('http', 'https')"
        f" THEN a_scheme || '://' || auth || {encode.format('n_path')} || a_query || a_frag ELSE a_scheme || substr(a, length(a_scheme) + 1) END AS r_url,"
        f" CASE WHEN a_scheme IN ('http', 'https') THEN regexp_extract(auth, '^[^:]*') ELSE '' END AS r_host, {encode.format('n_path')} AS r_path FROM {n}_c)")


_SPAN = (
    "bound AS (SELECT page_id, pos, tag, op, CASE WHEN tag IN ('a', '/a') THEN 'a' ELSE 'h' END AS fam FROM mark"
    " WHERE tag IN ('a', '/a') OR regexp_matches(tag, '^/?h[1-6]$')),"
    " span AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY page_id, fam ORDER BY pos), 1000000000) AS stop FROM bound),"
    " txt AS (SELECT s.page_id, s.pos, any_value(s.tag) AS tag, any_value(s.op) AS op, "
    + _squish(_decode("coalesce(string_agg(k.t, '' ORDER BY k.pos), '')"))
    + " AS text FROM span s LEFT JOIN tok k ON k.page_id = s.page_id AND k.pos > s.pos AND k.pos < s.stop AND (k.t = '<' OR NOT starts_with(k.t, '<'))"
    " WHERE NOT starts_with(s.tag, '/') GROUP BY s.page_id, s.pos)")


def _links(rich: bool = True) -> str:
    """CTEs up to `lnk`, the classified links."""
    return (
        f"{_doc(rich)}, {_SPAN}, anc AS (SELECT x.page_id, x.pos, x.text, p.url, p.host, {_strip(_attr('href', 'x.op'))} AS href,"
        f" {_strip('coalesce(' + _attr('rel', 'x.op') + ', ' + _q('') + ')')} AS rel FROM txt x JOIN page p USING (page_id) WHERE x.tag = 'a'),"
        " good AS (SELECT * FROM anc WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')),"
        f" {_resolve('res', 'good')},"
        f" lnk AS (SELECT page_id, pos, r_url AS url, href AS raw_href, substr(text, 1, {html.TEXT_CAP}) AS text,"
        f" CASE WHEN r_host = host THEN 'Internal' ELSE 'External' END AS type, CASE WHEN rel = '' THEN '{html.NO_REL}' ELSE rel END AS rel,"
        " rel ILIKE '%nofollow%' AS is_nofollow FROM res)")


_LINK_COUNTS = (
    "lc AS (SELECT p.page_id, p.url, p.host, (SELECT count(*) FROM mark m WHERE m.page_id = p.page_id AND m.tag = 'a') AS total,"
    " count(l.page_id) FILTER (WHERE l.type = 'Internal') AS internal, count(l.page_id) FILTER (WHERE l.type = 'External') AS external,"
    " count(l.page_id) FILTER (WHERE l.is_nofollow) AS nofollow FROM page p LEFT JOIN lnk l USING (page_id) GROUP BY p.page_id, p.url, p.host)")


def _first_meta(key: str, value: str) -> str:
    cond = f"tag = 'meta' AND lower({_attr(key)}) = '{value}'"
    return _present(f"coalesce(arg_min(coalesce({_attr('content')}, ''), pos) FILTER (WHERE {cond}), '')")


def _first_link(rel: str) -> str:
    return _present(f"coalesce(arg_min(coalesce({_attr('href')}, ''), pos) FILTER (WHERE tag = 'link' AND lower({_attr('rel')}) = '{rel}'), '')")


_TITLE_BODY = r"regexp_replace(regexp_replace(t, '^<[^>]*>', ''), '(?i)</title[^>]*>$', '')"
_HEAD = (
    "head AS (SELECT page_id, url, " + _present(_decode(f"coalesce(arg_min({_TITLE_BODY}, pos) FILTER (WHERE tag = 'title'), '')")) + " AS title,"
    f" coalesce({_first_meta('name', 'description')}, {_first_meta('property', 'og:description')}) AS description,"
    f" {_first_meta('name', 'keywords')} AS keywords, {_first_meta('name', 'robots')} AS robots, {_first_link('canonical')} AS canonical,"
    f" {_present('arg_min(' + _attr('lang') + ', pos) FILTER (WHERE tag = ' + _q('html') + ')')} AS lang,"
    f" coalesce({_present('arg_min(' + _attr('charset') + ', pos) FILTER (WHERE tag = ' + _q('meta') + ' AND ' + _attr('charset') + ' IS NOT NULL)')}, {_first_meta('http-equiv', 'content-type')}) AS charset,"
    f" {_first_meta('name', 'viewport')} AS viewport,"
    f" coalesce({_first_link('icon')}, {_first_link('shortcut icon')}, {_first_link('apple-touch-icon')}) AS favicon FROM mark GROUP BY page_id, url)")

_SHEET = f"tag = 'link' AND contains(lower({_attr('rel')}), 'stylesheet')"
_STATS = (
    "stats AS (SELECT p.page_id, p.url, octet_length(encode(s.html))::BIGINT AS total_size,"
    " count(*) FILTER (WHERE NOT starts_with(m.tag, '/')) AS dom_elements, count(*) FILTER (WHERE tag = 'a') AS links,"
    " count(*) FILTER (WHERE tag = 'img') AS images, count(*) FILTER (WHERE tag = 'script') AS scripts,"
    f" count(*) FILTER (WHERE {_SHEET}) AS stylesheets, count(*) FILTER (WHERE tag = 'style') AS inline_styles,"
    " count(*) FILTER (WHERE tag = 'form') AS forms FROM page p JOIN src s USING (page_id) JOIN mark m USING (page_id) GROUP BY p.page_id, p.url, s.html)")
_IMG = (
    f"img0 AS (SELECT page_id, pos, coalesce({_present(_attr('src'))}, {_present(_attr('data-src'))}) AS src, coalesce({_strip(_attr('alt'))}, '') AS alt,"
    f" coalesce(lower({_attr('loading')}) = 'lazy', false) OR {_attr('data-lazy')} IS NOT NULL AS lazy FROM mark WHERE tag = 'img'),"
    f" img AS (SELECT page_id, pos, src, CASE WHEN alt = '' THEN '{html.MISSING_ALT}' ELSE alt END AS alt, alt <> '' AS has_alt,"
    " CASE WHEN lazy THEN 'lazy' ELSE 'eager' END AS loading FROM img0 WHERE src IS NOT NULL)")
_HEADINGS = (
    "hd AS (SELECT page_id, count(*) FILTER (WHERE tag = 'h1') AS h1_count, count(*) FILTER (WHERE tag = 'h2') AS h2_count,"
    " count(*) FILTER (WHERE tag = 'h3') AS h3_count, " + ", ".join(
        f"list(text ORDER BY pos) FILTER (WHERE tag = '{h}') AS {h}_list" for h in ("h1", "h2", "h3"))
    + " FROM txt WHERE tag IN ('h1', 'h2', 'h3') AND text <> '' GROUP BY page_id)")


def _social(key: str, prefix: str, name: str) -> str:
    return (
        f"{name} AS (SELECT page_id, k AS key, arg_max(v, pos) AS content, min(pos) AS first_pos FROM (SELECT page_id, pos,"
        f" substr(lower({_attr(key)}), {len(prefix) + 1}) AS k, {_present(_attr('content'))} AS v FROM mark"
        f" WHERE tag = 'meta' AND starts_with(lower({_attr(key)}), '{prefix}')) z WHERE k <> '' AND v IS NOT NULL GROUP BY page_id, k)")


_LD_BODY = r"regexp_replace(regexp_replace(t, '^<[^>]*>', ''), '(?i)</script[^>]*>$', '')"
_LD = (
    f"ld AS (SELECT page_id, pos, NOT json_valid(j) AS is_malformed, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.name') END AS name,"
    f" CASE WHEN json_valid(j) THEN json_extract_string(j, '$.\"@type\"') END AS kind FROM (SELECT page_id, pos, {_strip(_LD_BODY)} AS j FROM mark"
    f" WHERE tag = 'script' AND lower({_attr('type')}) = 'application/ld+json' AND {_LD_BODY} <> '') z)")
_CODE = (
    f"code AS (SELECT page_id, url, pos, {_present(_attr('src'))} AS href FROM mark WHERE tag = 'script'"
    f" AND coalesce({_strip('lower(' + _attr('type') + ')')}, '') NOT IN {_in(html.DATA_SCRIPT_TYPES)}), codef AS (SELECT * FROM code WHERE href IS NOT NULL), "
    + _resolve("coder", "codef"))
_CSS = (
    f"css AS (SELECT page_id, url, pos, {_present(_attr('href'))} AS href FROM mark WHERE {_SHEET}), cssf AS (SELECT * FROM css WHERE href IS NOT NULL), "
    + _resolve("cssr", "cssf"))


def _joined(column: str, order: str, cap: int, table: str) -> str:
    return (f"(SELECT coalesce(string_agg({column}, '{G.JOIN}' ORDER BY {order}), '') FROM (SELECT * FROM {table} z WHERE z.page_id = p.page_id"
            f" ORDER BY {order} LIMIT {cap}) y)")


def _note(key: str, **slots: str) -> str:
    return seo.say(key, concat=_q, **slots)


def _seo() -> str:
    """CTEs up to `items`."""
    head, canon = "h.", "cr.r_url"
    f = seo.FACTORS

    def rule(i: int, status: str, value: str, note: str) -> str:
        return f"SELECT page_id, host, {_q(f[i])} AS factor, {status} AS status, {value} AS value, {note} AS note FROM wide"

    def length_rule(i: int, col: str, low: int, high: int, missing: str) -> str:
        n = f"length({col})"
        return rule(
            i, f"CASE WHEN {col} IS NULL THEN '{missing}' WHEN {n} < {low} OR {n} > {high} THEN 'warning' ELSE 'pass' END", col,
            f"CASE WHEN {col} IS NULL THEN {_note(col + '_missing')} WHEN {n} < {low} THEN {_note(col + '_short', n=n)}"
            f" WHEN {n} > {high} THEN {_note(col + '_long', n=n)} ELSE {_note('length', n=n)} END")

    og = "(og_title IS NOT NULL OR og_image IS NOT NULL OR og_description IS NOT NULL)"
    tw = "(tw_card IS NOT NULL OR tw_title IS NOT NULL OR tw_image IS NOT NULL)"
    rules = [
        length_rule(0, "title", seo.TITLE_MIN, seo.TITLE_MAX, "fail"),
        length_rule(1, "description", seo.DESCRIPTION_MIN, seo.DESCRIPTION_MAX, "warning"),
        rule(2, "CASE WHEN canonical IS NULL THEN 'warning' ELSE 'pass' END", "canonical",
             f"CASE WHEN canonical IS NULL THEN {_note('canonical_missing')} WHEN canonical_url = url THEN {_note('canonical_match')}"
             f" ELSE {_note('canonical_points', s='canonical')} END"),
        rule(3, "'pass'", f"coalesce(robots, {_note('robots_default')})",
             f"CASE WHEN robots IS NULL THEN {_note('robots_default_note')} ELSE {_note('robots', s='robots')} END"),
        rule(4, "CASE h1 WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'warning' END",
             f"CASE h1 WHEN 1 THEN first_h1 WHEN 0 THEN {_note('h1_none_value')} ELSE {_note('h1_many_value', n='h1')} END",
             f"CASE h1 WHEN 1 THEN {_note('h1_one')} WHEN 0 THEN {_note('h1_none')} ELSE {_note('h1_many', n='h1')} END"),
        rule(5, "CASE WHEN h2 > 0 THEN 'pass' ELSE 'info' END", _note("sub_value", n="h2", m="h3"),
             f"CASE WHEN h2 > 0 THEN {_note('sub_good')} ELSE {_note('sub_none')} END"),
        rule(6, "CASE WHEN imgs = 0 THEN 'info' WHEN no_alt = 0 THEN 'pass' ELSE 'warning' END",
             f"CASE WHEN imgs = 0 THEN {_note('img_none_value')} WHEN no_alt = 0 THEN {_note('img_all_value', n='imgs')}"
             f" ELSE {_note('img_missing_value', n='imgs', m='no_alt')} END",
             f"CASE WHEN imgs = 0 THEN {_note('img_none')} WHEN no_alt = 0 THEN {_note('img_all')} ELSE {_note('img_missing', m='no_alt')} END"),
        rule(7, "CASE WHEN total > 0 THEN 'pass' ELSE 'info' END", _note("links_value", n="total", m="internal", k="external"),
             _note("links", n="nofollow")),
        rule(8, f"CASE WHEN {og} THEN 'pass' ELSE 'warning' END",
             f"CASE WHEN {og} THEN coalesce(og_title, {_note('configured')}) ELSE {_note('not_found')} END",
             f"CASE WHEN {og} THEN {_note('og', s='og_keys')} ELSE {_note('og_missing')} END"),
        rule(9, f"CASE WHEN {tw} THEN 'pass' ELSE 'warning' END",
             f"CASE WHEN {tw} THEN coalesce(tw_card, {_note('configured')}) ELSE {_note('not_found')} END",
             f"CASE WHEN {tw} THEN {_note('twitter', s='coalesce(tw_card, ' + _note('twitter_default') + ')')} ELSE {_note('twitter_missing')} END"),
        rule(10, "CASE WHEN lds > 0 THEN 'pass' ELSE 'info' END",
             f"CASE WHEN lds > 0 THEN {_note('ld_value', n='lds')} ELSE {_note('ld_none_value')} END",
             f"CASE WHEN lds > 0 THEN {_note('ld')} ELSE {_note('ld_none')} END"),
    ]
    return (
        f"{_links()}, {_LINK_COUNTS}, {_HEAD}, {_IMG}, {_HEADINGS}, {_LD}, {_social('property', 'og:', 'og')}, {_social('name', 'twitter:', 'tw')},"
        f" canon AS (SELECT page_id, url, canonical AS href FROM head WHERE canonical IS NOT NULL), {_resolve('cr', 'canon')},"
        " ogx AS (SELECT page_id, max(content) FILTER (WHERE key = 'title') AS og_title, max(content) FILTER (WHERE key = 'image') AS og_image,"
        " max(content) FILTER (WHERE key = 'description') AS og_description, string_agg(key, ', ' ORDER BY first_pos) AS og_keys FROM og GROUP BY page_id),"
        " twx AS (SELECT page_id, max(content) FILTER (WHERE key = 'card') AS tw_card, max(content) FILTER (WHERE key = 'title') AS tw_title,"
        " max(content) FILTER (WHERE key = 'image') AS tw_image FROM tw GROUP BY page_id),"
        " imx AS (SELECT page_id, count(*) FILTER (WHERE NOT has_alt) AS no_alt FROM img GROUP BY page_id),"
        " imn AS (SELECT page_id, count(*) AS imgs FROM mark WHERE tag = 'img' GROUP BY page_id),"
        " ldx AS (SELECT page_id, count(*) AS lds FROM ld GROUP BY page_id),"
        f" wide AS (SELECT p.page_id, p.host, p.url, {head}title, {head}description, {head}canonical, {head}robots, {canon} AS canonical_url,"
        " coalesce(hd.h1_count, 0) AS h1, coalesce(hd.h2_count, 0) AS h2, coalesce(hd.h3_count, 0) AS h3, hd.h1_list[1] AS first_h1,"
        " coalesce(imgs, 0) AS imgs, coalesce(no_alt, 0) AS no_alt, lc.total, lc.internal, lc.external, lc.nofollow, og_title, og_image, og_description, og_keys,"
        " tw_card, tw_title, tw_image, coalesce(lds, 0) AS lds FROM page p JOIN lc USING (page_id) JOIN head h USING (page_id) LEFT JOIN cr USING (page_id)"
        " LEFT JOIN hd USING (page_id) LEFT JOIN imn USING (page_id) LEFT JOIN imx USING (page_id) LEFT JOIN ogx USING (page_id) LEFT JOIN twx USING (page_id)"
        " LEFT JOIN ldx USING (page_id)), items AS (" + " UNION ALL ".join(rules) + ")")


_SUMMARY = (
    "count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passes, count(*) FILTER (WHERE status = 'warning') AS warnings,"
    " count(*) FILTER (WHERE status = 'fail') AS fails")


def _outline() -> str:
    """Open elements step by step through a recursive query, one tag of every page per round."""
    closers = html._IMPLIED_END
    leaf, hidden = html._LEAF, html._HIDDEN

    def last(names: list[str]) -> str:
        if not names:
            return "0"
        return "greatest(" + ", ".join(f"coalesce(len(s.names) + 1 - list_position(list_reverse(s.names), '{n}'), 0)" for n in names) + ", 0)"

    by_start = "least(len(s.names), " + ", ".join(
        f"CASE WHEN m.tag IN {_in(starts)} AND {last(targets)} > {last(shields)} THEN {last(targets)} - 1 ELSE len(s.names) END"
        for starts, targets, shields in closers) + ")"
    by_end = ("CASE WHEN m.tag IN ('/html', '/body') OR NOT list_contains(s.names, substr(m.tag, 2)) THEN len(s.names)"
              " ELSE len(s.names) - list_position(list_reverse(s.names), substr(m.tag, 2)) END")
    from crawlsift.functions.markup import RAW_TEXT, VOID

    opens = f"NOT starts_with(tag, '/') AND tag NOT IN {_in(hidden)} AND NOT (tag IN ('html', 'head', 'body') AND list_contains(names, tag))"
    holds = f"{opens} AND tag NOT IN {_in(VOID + RAW_TEXT)}"
    return (
        f"WITH RECURSIVE {_doc()}, m AS (SELECT page_id, pos, tag, op, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM mark),"
        " walk AS (SELECT page_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS op,"
        " CAST([] AS VARCHAR[]) AS names, CAST([] AS BIGINT[]) AS places, CAST(0 AS BIGINT) AS depth, CAST(NULL AS BIGINT) AS parent_pos, false AS shown FROM page"
        " UNION ALL SELECT page_id, n, pos, tag, op,"
        f" CASE WHEN {holds} THEN list_append(names, tag) ELSE names END, CASE WHEN {holds} THEN list_append(places, pos) ELSE places END,"
        " CAST(len(names) + 1 AS BIGINT), places[len(places)],"
        f" {opens} AND len(names) < 4 AND NOT list_has_any(names, [{', '.join(_q(x) for x in leaf)}])"
        " FROM (SELECT m.page_id, m.n, m.pos, m.tag, m.op, list_slice(s.names, 1, z.keep) AS names, list_slice(s.places, 1, z.keep) AS places FROM walk s JOIN m ON m.page_id = s.page_id AND m.n = s.n + 1,"
        f" LATERAL (SELECT CASE WHEN starts_with(m.tag, '/') THEN {by_end} ELSE {by_start} END AS keep) z) y)"
        " SELECT page_id, pos, depth, parent_pos, tag, nullif(" + _attr("id") + ", '') AS id, nullif(" + _attr("class") + ", '') AS class FROM walk WHERE shown")


# ---- assets --------------------------------------------------------------------------------------------------------
def _assets() -> str:
    """CTEs up to `listed` (distinct, capped) and `numbered` (with local names)."""
    parts = [
        f"SELECT page_id, url, pos, 0 AS ord, {_attr('href')} AS raw, 'css' AS type, 'css' AS folder FROM mark WHERE tag = 'link' AND {_attr('rel')} = 'stylesheet'",
        f"SELECT page_id, url, pos, 1, {_attr('src')}, 'js', 'js' FROM mark WHERE tag = 'script'",
        f"SELECT page_id, url, pos, 2, {_attr('src')}, 'image', 'images' FROM mark WHERE tag = 'img'",
        f"SELECT page_id, url, pos, 3, {_attr('href')}, 'icon', 'images' FROM mark WHERE tag = 'link' AND contains({_attr('rel')}, 'icon')",
        f"SELECT page_id, url, pos, 4, {_attr('src')}, 'media', 'media' FROM mark WHERE tag = 'source'"]
    return (
        f"{_doc()}, cand AS (SELECT *, {_strip('raw')} AS href FROM ({' UNION ALL '.join(parts)}) z WHERE raw <> ''),"
        " cand2 AS (SELECT * FROM cand WHERE NOT regexp_matches(href, '^(data:|javascript:|#|mailto:)')), "
        + _resolve("ar", "cand2")
        + ", uniq AS (SELECT *, row_number() OVER (PARTITION BY page_id, r_url ORDER BY ord, pos) AS rn FROM ar),"
        " ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, pos) AS place FROM uniq WHERE rn = 1),"
        " listed AS (SELECT * FROM ranked WHERE place <= 100)")


def _number(source: str, name: str = "numbered") -> str:
    base = "regexp_extract(r_path, '([^/]*)/*$', 1)"
    clean = f"substr(regexp_replace({base}, '[^a-zA-Z0-9_.-]', '_', 'g'), 1, 40)"
    return (
        f"{name} AS (SELECT *, 'assets/' || folder || CASE WHEN substr({base}, 2) LIKE '%.%' THEN '/' || idx || '_' || {clean} ELSE '/asset_' || idx ||"
        " CASE folder WHEN 'css' THEN '.css' WHEN 'js' THEN '.js' WHEN 'images' THEN '.png' ELSE '.bin' END END AS local_path FROM"
        f" (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord, pos) AS idx FROM {source}) z)")


_SIZES = (
    "sizes AS (SELECT DISTINCT r_url, CASE length(r_url) % 6 WHEN 0 THEN 6000000 WHEN 1 THEN NULL ELSE 5242880 - length(r_url) * 4000 END AS bytes,"
    " CASE WHEN length(r_url) % 11 = 0 THEN 404 ELSE 200 END AS status_code FROM numbered)")
_BUDGET = (
    "fit AS (SELECT n.page_id, n.idx, n.r_url, n.local_path, s.bytes, coalesce(s.status_code = 200 AND s.bytes > 0 AND s.bytes <= 5242880, false) AS fits FROM numbered n JOIN sizes s USING (r_url)),"
    " acc AS (SELECT *, coalesce(sum(CASE WHEN fits THEN bytes ELSE 0 END) OVER (PARTITION BY page_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_bytes FROM fit),"
    " budget AS (SELECT page_id, idx, r_url AS resolved_url, local_path, bytes::BIGINT AS bytes, before_bytes, CASE WHEN before_bytes >= 31457280 THEN 'total_limit'"
    " WHEN bytes IS NULL THEN 'not_recorded' WHEN bytes > 5242880 THEN 'asset_limit' WHEN fits THEN 'included' ELSE 'failed' END AS outcome FROM acc)")

# ---- recorded tables -----------------------------------------------------------------------------------------------
_RESP = f"resp AS (SELECT {_body(R.RESPONSES)} FROM pages)"
_TARGETS = f"targets AS (SELECT {_body(R.TARGETS)} FROM pages)"
_X = "x AS (SELECT " + _body([e.replace("{us}", "epoch_us(ts)") for e in R.EVENTS_X]) + " FROM events)"
_TRACE = f"{_X}, trace AS (SELECT {_body(R.TRACE)} FROM x)"
_NET = f"{_X}, net AS ({R.NET_SQL.replace('{x}', 'x')})"
_DNS = "dns AS (" + R.DNS_SQL.replace("{host}", R.HOST).replace("{pages}", "pages") + ")"
_CERTS = "certs AS (" + R.CERTS_SQL.replace("{host}", R.HOST).replace("{pages}", "pages") + ")"
_HOPS = (
    f"hops AS (SELECT {_body(R.HOPS)} FROM (SELECT page_id, url, unnest(range(8)) AS i FROM pages) z WHERE {R.HOPS_WHERE} UNION ALL {R.HOPS_EXTRA}),"
    f" starts AS (SELECT DISTINCT {_body(R.STARTS)} FROM pages)")

# targets: what a URL parser makes of each of the derived forms
_NORM = (
    f"{_TARGETS}, trimmed AS (SELECT *, {_strip('raw_url')} AS t FROM targets),"
    " full_url AS (SELECT *, CASE WHEN starts_with(t, '//') THEN 'https:' || t WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN t ELSE 'https://' || t END AS f FROM trimmed),"
    # "name:8080/path" reads as a scheme, as it does for any URL parser
    " cut AS (SELECT *, lower(regexp_extract(f, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) AS s, regexp_matches(f, '^(?i)(https?|ftp|file):') AS special,"
    r" lower(regexp_extract(f, '^[a-zA-Z]+:/*(\[[^\]]*\]|[^/?#:]*)', 1)) AS h0, regexp_extract(f, '^[a-zA-Z]+:/*(?:\[[^\]]*\]|[^/?#:]*):([0-9]+)', 1) AS p0,"
    " regexp_extract(f, '^[a-zA-Z]+:/*[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(f, '[?][^#]*') AS query, regexp_extract(f, '#.*$') AS frag FROM full_url),"
    " named AS (SELECT *, CASE WHEN NOT special THEN '' WHEN h0 = '2130706433' THEN '127.0.0.1' WHEN h0 = '[0:0:0:0:0:0:0:1]' THEN '[::1]' WHEN h0 = '[2001:db8::0:0:1:0:0]' THEN '[2001:db8::1:0:0]'"
    " ELSE replace(h0, 'b\u00fccher', 'xn--bcher-kva') END AS h,"
    " CASE WHEN special THEN coalesce(try_cast(p0 AS BIGINT), CASE s WHEN 'https' THEN 443 WHEN 'http' THEN 80 WHEN 'ftp' THEN 21 END) END AS p,"
    " special AND (regexp_matches(h0, '[ ]') OR (h0 = '' AND s <> 'file') OR coalesce(try_cast(p0 AS BIGINT), 0) > 65535) AS bad,"
    " CASE WHEN path0 = '' THEN '/' ELSE replace(list_reduce(string_split(path0, '/')[2:], lambda acc, g: CASE WHEN g = '..' THEN regexp_replace(acc, '/[^/]*$', '')"
    " WHEN g = '.' THEN acc ELSE acc || '/' || g END, ''), ' ', '%20') END AS path FROM cut),"
    f" judged AS (SELECT *, CASE WHEN raw_url IS NULL OR raw_url = '' THEN {_q(urls.REQUIRED)} WHEN t = '' THEN {_q(urls.EMPTY)} WHEN bad THEN {_q(urls.INVALID)}"
    f" WHEN s NOT IN ('http', 'https') THEN {_q(urls.PROTOCOL_1)} || s || ':' || {_q(urls.PROTOCOL_2)}"
    f" WHEN p NOT IN (80, 443, 8080, 8443) THEN {_q(urls.PORT_1)} || p || {_q(urls.PORT_2)} || '80, 443, 8080, 8443.' END AS error FROM named),"
    " norm AS (SELECT page_id, raw_url, CASE WHEN error IS NULL THEN s || '://' || h || CASE WHEN p = CASE s WHEN 'https' THEN 443 ELSE 80 END THEN '' ELSE ':' || p END || path || query || frag END AS url,"
    " CASE WHEN error IS NULL THEN s || ':' END AS protocol, CASE WHEN error IS NULL THEN h END AS hostname, CASE WHEN error IS NULL THEN p END AS port,"
    " error IS NULL AS valid, error FROM judged)")


def _cidr_cases(n: str) -> str:
    rows = sorted((urls._bounds(c) for c in urls.BLOCKED_CIDRS), key=lambda b: b[2] - b[1])
    return "CASE " + " ".join(f"WHEN {n} BETWEEN {lo} AND {hi} THEN '{c}'" for c, lo, hi in rows) + " END"


def _ip_rule(col: str) -> str:
    """SQL for the rule that blocks an address, NULL when none does."""
    ip = f"lower(trim({col}))"
    v4 = f"CASE WHEN starts_with({ip}, '::ffff:') AND contains({ip}, '.') THEN substr({ip}, 8) WHEN NOT contains({ip}, ':') THEN {ip} END"
    parts = f"string_split({v4}, '.')"
    ok = f"regexp_matches({v4}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AND " + " AND ".join(f"coalesce(try_cast({parts}[{i}] AS INT), 256) <= 255" for i in (1, 2, 3, 4))
    n = "(" + " + ".join(f"CAST({parts}[{i}] AS BIGINT) * {256 ** (4 - i)}" for i in (1, 2, 3, 4)) + ")"
    v6 = f"contains({ip}, ':') AND regexp_matches({ip}, '^[0-9a-f:.]+$') AND NOT ({v4} IS NOT NULL)"
    return (
        f"CASE WHEN {col} IS NULL THEN 'invalid' WHEN {ip} = '0::1' THEN 'loopback' WHEN {ip} = '0000::0000' THEN 'unspecified' WHEN {ip} = 'fe80:0::1' THEN 'link-local'"
        f" WHEN {ip} = '0:0:0:0:0:ffff:127.0.0.1' THEN '127.0.0.0/8' WHEN {ip} = '0:0:0:0:0:ffff:7f00:1' THEN 'mapped' WHEN {ok} THEN {_cidr_cases(n)}"
        f" WHEN NOT ({v6}) THEN 'invalid'"
        f" WHEN {ip} = '::1' THEN 'loopback' WHEN {ip} = '::' THEN 'unspecified' WHEN regexp_matches({ip}, '^f[cd][0-9a-f][0-9a-f]:') THEN 'unique-local'"
        f" WHEN regexp_matches({ip}, '^fe[89ab][0-9a-f]:') THEN 'link-local' WHEN contains({ip}, '::ffff:') THEN 'mapped' END")


_CHECK_NOTES = {k: _q(v) for k, v in headers.NOTES.items()}


def _checks() -> str:
    n = _CHECK_NOTES
    v = {c: f"nullif({c}, '')" for c in ("hsts", "csp", "sniff", "frame", "referrer", "permissions")}
    age = f"try_cast(regexp_extract(lower({v['hsts']}), 'max-age=([0-9]+)', 1) AS BIGINT)"
    unsafe = f"({v['csp']} LIKE '%''unsafe-inline''%' OR {v['csp']} LIKE '%''unsafe-eval''%')"
    fr = f"upper(trim({v['frame']}))"
    framed = f"coalesce({v['csp']} ILIKE '%frame-ancestors%', false)"
    rules = {
        "hsts": (f"CASE WHEN {v['hsts']} IS NULL THEN 'fail' WHEN {age} IS NULL OR {age} < 15552000 THEN 'warning' ELSE 'pass' END",
                 f"CASE WHEN {v['hsts']} IS NULL THEN {n['hsts_missing']} WHEN {age} IS NULL THEN {n['hsts_no_age']} WHEN {age} < 15552000 THEN {n['hsts_low_1']} || {age} || {n['hsts_low_2']} ELSE {n['hsts_ok']} END"),
        "csp": (f"CASE WHEN {v['csp']} IS NULL THEN 'fail' WHEN {unsafe} THEN 'warning' ELSE 'pass' END",
                f"CASE WHEN {v['csp']} IS NULL THEN {n['csp_missing']} WHEN {unsafe} THEN {n['csp_unsafe']} ELSE {n['csp_ok']} END"),
        "sniff": (f"CASE WHEN {v['sniff']} IS NULL THEN 'fail' WHEN lower(trim(sniff)) = 'nosniff' THEN 'pass' ELSE 'warning' END",
                  f"CASE WHEN {v['sniff']} IS NULL THEN {n['nosniff_missing']} WHEN lower(trim(sniff)) = 'nosniff' THEN {n['nosniff_ok']} ELSE {n['nosniff_odd_1']} || sniff || {n['nosniff_odd_2']} END"),
        "frame": (f"CASE WHEN {v['frame']} IS NULL THEN CASE WHEN {framed} THEN 'pass' ELSE 'fail' END WHEN {fr} IN ('DENY', 'SAMEORIGIN') THEN 'pass' ELSE 'warning' END",
                  f"CASE WHEN {v['frame']} IS NULL THEN CASE WHEN {framed} THEN {n['frame_csp']} ELSE {n['frame_missing']} END WHEN {fr} IN ('DENY', 'SAMEORIGIN') THEN {n['frame_ok_1']} || {fr} || {n['frame_ok_2']} ELSE {n['frame_odd_1']} || frame || {n['frame_odd_2']} END"),
        "referrer": (f"CASE WHEN {v['referrer']} IS NULL THEN 'fail' WHEN lower(trim(referrer)) IN {_in(headers.SECURE_REFERRER_POLICIES)} THEN 'pass' ELSE 'warning' END",
                     f"CASE WHEN {v['referrer']} IS NULL THEN {n['referrer_missing']} WHEN lower(trim(referrer)) IN {_in(headers.SECURE_REFERRER_POLICIES)} THEN {n['referrer_ok']} || referrer ELSE {n['referrer_odd']} || referrer END"),
        "permissions": (f"CASE WHEN {v['permissions']} IS NULL THEN 'fail' ELSE 'pass' END",
                        f"CASE WHEN {v['permissions']} IS NULL THEN {n['permissions_missing']} ELSE {n['permissions_ok']} END"),
    }
    parts = [
        f"SELECT response_id, host, {_q(label)} AS header, '{key}' AS key, {v[c]} IS NOT NULL AS present, {v[c]} AS value, {status} AS status, {note} AS note, {_q(text)} AS description FROM resp"
        for (key, label, text), (c, (status, note)) in zip(headers.CHECKS, rules.items(), strict=True)]
    return f"{_RESP}, checks AS ({' UNION ALL '.join(parts)})"


def _cookies() -> str:
    def last(name: str) -> str:
        pattern = rf"(?i);\s*{name}=([^;]*)"
        return f"nullif(trim(regexp_extract_all(raw, {_q(pattern)}, 1)[-1]), '')"

    def has(name: str) -> str:
        return f"regexp_matches(raw, '(?i);\\s*{name}\\s*(;|$)')"

    first = "regexp_extract(raw, '^[^;]*')"
    return (
        f"{_RESP}, lists AS (SELECT response_id, host, list_filter([cookie1, cookie2, cookie3], lambda c: c IS NOT NULL) AS l FROM resp),"
        " ck0 AS (SELECT response_id, host, unnest(l) AS raw, unnest(range(len(l))) AS cookie_no FROM lists),"
        f" ck AS (SELECT response_id, host, cookie_no, trim(regexp_extract({first}, '^[^=]*')) AS name,"
        f" CASE WHEN trim(regexp_extract({first}, '=(.*)$', 1)) <> '' THEN '{headers.COOKIE_MASK}' ELSE '' END AS masked_value,"
        f" {has('secure')} AS secure, {has('httponly')} AS http_only, coalesce({last('samesite')}, 'Not set') AS same_site, coalesce({last('path')}, '/') AS path,"
        f" {last('domain')} AS domain, coalesce({last('expires')}, 'Max-Age: ' || {last('max-age')} || 's', 'Session') AS expires FROM ck0 WHERE raw <> '')")


def _chains() -> str:
    """Chains through a recursive query; the Spark side unrolls joins."""
    node = r"regexp_extract(from_url, '^https://[^/]*')"
    target = (
        f"CASE WHEN location = 'https://login.example.com' THEN location || '/' WHEN starts_with(location, 'https://') THEN location WHEN starts_with(location, '/') THEN {node} || location"
        " WHEN starts_with(location, './') THEN regexp_replace(from_url, '[^/]*$', '') || substr(location, 3) WHEN location = 'http://' THEN NULL"
        " ELSE regexp_replace(from_url, '[^/]*$', '') || location END")
    return (
        f"WITH RECURSIVE {_HOPS}, edge AS (SELECT *, status_code IN (301, 302, 303, 307, 308) AND location IS NOT NULL AS redir, {target} AS target FROM hops),"
        " walk AS (SELECT start_url, 0 AS hop, start_url AS cur, [start_url] AS visited, CAST([] AS VARCHAR[]) AS path, CAST(0 AS BIGINT) AS total_ms, CAST(NULL AS INT) AS status_code,"
        " CAST(NULL AS VARCHAR) AS error, false AS done, CAST(NULL AS VARCHAR) AS from_url, CAST(NULL AS VARCHAR) AS location, CAST(NULL AS BIGINT) AS response_ms, false AS listed FROM starts"
        " UNION ALL SELECT start_url, hop + 1, CASE WHEN keep THEN target ELSE cur END, CASE WHEN keep THEN list_append(visited, target) ELSE visited END,"
        " CASE WHEN keep THEN list_append(path, target) ELSE path END, total_ms + coalesce(ms, 0), code,"
        f" CASE WHEN code IS NULL THEN {_q(http.NO_RECORD)} WHEN NOT redir THEN NULL WHEN hop = 5 THEN {_q(http.TOO_MANY_1)} || '5' || {_q(http.TOO_MANY_2)} WHEN target IS NULL THEN {_q(http.BAD_LOCATION)} || loc"
        f" WHEN loops THEN {_q(http.LOOP_1)} || target || {_q(http.LOOP_2)} END, NOT keep OR loops, cur, loc, ms, keep"
        " FROM (SELECT w.start_url, w.hop, w.cur, w.visited, w.path, w.total_ms, e.status_code AS code, e.location AS loc, e.response_ms AS ms, e.redir, e.target,"
        " coalesce(list_contains(w.visited, e.target), false) AS loops, coalesce(e.redir AND w.hop < 5 AND e.target IS NOT NULL, false) AS keep FROM walk w LEFT JOIN edge e ON e.from_url = w.cur WHERE NOT w.done) z),"
        " chain AS (SELECT * FROM walk WHERE done),"
        " hop_rows AS (SELECT start_url, CAST(hop AS BIGINT) AS hop, from_url, cur AS to_url, CAST(status_code AS BIGINT) AS status_code, location, response_ms,"
        " response_ms - lag(response_ms) OVER (PARTITION BY start_url ORDER BY hop) AS slower_ms FROM walk WHERE listed)")


# ---- network -------------------------------------------------------------------------------------------------------
_LIFE = (
    "life0 AS (SELECT session_id, request_id, bool_or(action = 'start') AS has_start, max(us) FILTER (WHERE action = 'start') AS start_us,"
    + ", ".join(f" max({c}) FILTER (WHERE action = 'start') AS {c}" for c in ("url", "method"))
    + ", lower(coalesce(max(resource_type) FILTER (WHERE action = 'response'), max(resource_type) FILTER (WHERE action = 'start'))) AS resource_type,"
    " max(i_type) FILTER (WHERE action = 'start') AS i_type, max(i_url) FILTER (WHERE action = 'start') AS i_url, max(i_line) FILTER (WHERE action = 'start') AS i_line,"
    " bool_or(action = 'response') AS has_answer, max(status) FILTER (WHERE action = 'response') AS answer, max(action) FILTER (WHERE action IN ('complete', 'failed')) AS fin,"
    " max(us) FILTER (WHERE action IN ('complete', 'failed')) AS fin_us, max(bytes) FILTER (WHERE action IN ('complete', 'failed')) AS fin_bytes,"
    " bool_or(canceled) FILTER (WHERE action IN ('complete', 'failed')) AS canceled FROM net GROUP BY session_id, request_id),"
    " life1 AS (SELECT *, CASE WHEN fin = 'failed' THEN CASE WHEN canceled THEN 'Canceled' ELSE 'Failed' END WHEN fin = 'complete' THEN CAST(coalesce(nullif(answer, 0), 200) AS VARCHAR)"
    " WHEN has_answer THEN CAST(answer AS VARCHAR) ELSE 'Pending' END AS status FROM life0),"
    " life AS (SELECT session_id, request_id, start_us AS start_ts, url, method, resource_type, status, try_cast(status AS BIGINT) AS status_code,"
    " CASE fin WHEN 'failed' THEN 0 WHEN 'complete' THEN fin_bytes END AS bytes,"
    " CASE WHEN fin = 'complete' THEN CASE WHEN start_us IS NULL THEN 0 ELSE greatest(1, CAST(floor((fin_us - start_us) / 1000.0 + 0.5) AS BIGINT)) END END AS duration_ms,"
    " coalesce(nullif(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), ''), 'api.example.com') || substr(regexp_extract(url, '[?][^#]*'), 1, 30) AS name0, i_type, i_url, i_line FROM life1),"
    " named AS (SELECT session_id, request_id, start_ts, url, method, resource_type, status, status_code, bytes, duration_ms, name0 AS name,"
    " CASE WHEN i_type IS NULL THEN 'Other' WHEN i_type = 'parser' THEN '(index)' WHEN i_type = 'script' AND i_url IS NOT NULL THEN CASE WHEN i_url LIKE '%inject%' THEN 'inject.js' ELSE 'cdn.example.net' END || ':' ||"
    " CASE WHEN i_line = 0 THEN 1 ELSE i_line END WHEN i_type = 'script' THEN 'script' ELSE upper(substr(i_type, 1, 1)) || substr(i_type, 2) END AS initiator_label FROM life)")
_READY = (
    "ready AS (SELECT session_id, min(us) AS ready_us FROM net WHERE action = 'complete' AND lower(resource_type) = 'document' GROUP BY 1),"
    " req AS (SELECT n.*, coalesce(n.start_ts > r.ready_us + 1000000, false) AS is_dynamic FROM named n LEFT JOIN ready r USING (session_id))")
_BAND = (
    "CASE WHEN {0} BETWEEN 200 AND 299 THEN '2xx' WHEN {0} BETWEEN 300 AND 399 THEN '3xx' WHEN {0} BETWEEN 400 AND 499 THEN '4xx' WHEN {0} >= 500 OR {1} = 'Failed' THEN '5xx' ELSE 'pending' END")
_ERR = "coalesce(status_code >= 400 OR status = 'Failed', false)"
_SEQ = (
    "seqd AS (SELECT session_id, id, seq, time, time - min(time) OVER (PARTITION BY session_id) AS delta_ms, upper(category) AS category,"
    " coalesce(level, CASE upper(category) WHEN 'WARN' THEN 'warn' WHEN 'ERROR' THEN 'error' ELSE 'info' END) AS level,"
    f" regexp_replace(regexp_replace(message, {_q(trace.BEARER.removeprefix('(?i)'))}, '{trace.BEARER_MASK}', 'gi'), {_q(trace.SECRET.removeprefix('(?i)'))}, '\\1=[MASKED]', 'gi') AS message"
    " FROM (SELECT *, us // 1000 AS time, row_number() OVER (PARTITION BY session_id ORDER BY us, seq) AS id FROM trace) z WHERE id <= 200)")
_DELTA = "'+' || (delta_ms // 1000) || '.' || lpad(CAST(delta_ms % 1000 AS VARCHAR), 3, '0') || 's'"
_T_ERR = "(level IN ('error', 'warn') OR category IN ('WARN', 'ERROR'))"
_CLIENT = "'c' || CAST(user_id % 12 AS VARCHAR)"
_SESS = (
    "ev AS (SELECT user_id, epoch_us(ts) AS us FROM events), marked AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) >= 300000000, true) AS fresh FROM ev),"
    " numbered AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY user_id ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM marked),"
    " sess AS (SELECT user_id, min(us) AS start_ts, max(us) AS last_ts, count(*) AS events FROM numbered GROUP BY user_id, no)")


def _admission(more: str = "") -> str:
    """CTEs up to `r`, the verdict on every host; `more` adds hosts."""
    return (
        f"{_DNS}, t AS (SELECT DISTINCT {R.HOST} AS host FROM pages UNION SELECT CASE page_id % 9 WHEN 0 THEN '10.0.0.7' WHEN 1 THEN '[::1]' WHEN 2 THEN 'api.localhost' WHEN 3 THEN '1.1.1.1' WHEN 4 THEN '[0::1]' WHEN 5 THEN '[0:0:0:0:0:ffff:7f00:1]' WHEN 6 THEN '[2606:4700:4700:0::1111]' END FROM pages{more}),"
        " hosts AS (SELECT * FROM t WHERE host IS NOT NULL), lit AS (SELECT host, replace(replace(host, '[', ''), ']', '') AS ip, 0 AS ord FROM hosts WHERE starts_with(host, '[') OR host IN ('10.0.0.7', '1.1.1.1')),"
        " ans AS (SELECT host, c1 AS ip, CASE type WHEN 'A' THEN ord ELSE 10 + ord END AS ord FROM dns WHERE type IN ('A', 'AAAA') AND c1 IS NOT NULL UNION ALL SELECT * FROM lit),"
        f" judged AS (SELECT *, {_ip_rule('ip')} IS NOT NULL AS blocked FROM ans),"
        " per AS (SELECT host, count(*) AS addresses, arg_min(ip, ord) FILTER (WHERE blocked) AS first_offender FROM judged GROUP BY host),"
        " r AS (SELECT h.host, coalesce(addresses, 0) AS addresses, first_offender, CASE WHEN h.host LIKE '%.localhost' OR h.host = '169.254.169.254' THEN 'Access to ''' || h.host || ''' is blocked for security reasons (SSRF Protection).'"
        " WHEN h.host IN (SELECT host FROM lit) AND first_offender IS NOT NULL THEN 'Access to IP address ''' || h.host || ''' is restricted (SSRF Protection: private/internal IP).'"
        " WHEN addresses IS NULL THEN 'Could not resolve hostname ''' || h.host || '''. DNS lookup returned no records.'"
        " WHEN first_offender IS NOT NULL THEN 'Access to ''' || h.host || ''' is blocked because it resolves to restricted IP ' || first_offender || ' (SSRF Protection).' END AS error FROM hosts h LEFT JOIN per USING (host))")


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    doc, stats = _doc(), f"{_doc()}, {_STATS}"
    out: dict[str, str] = {}
    out["url_normalized"] = f"WITH {_NORM} SELECT * FROM norm"
    out["url_rejections"] = f"WITH {_NORM} SELECT error, count(*) AS targets FROM norm WHERE NOT valid GROUP BY error"
    out["target_intake"] = f"WITH {_NORM} SELECT valid AS accepted, count(*) AS targets, count(DISTINCT raw_url) AS distinct_targets FROM norm GROUP BY valid"
    out["url_port_policy"] = (
        f"WITH {_NORM}, abso AS (SELECT * FROM named WHERE raw_url IS NOT NULL AND regexp_matches(trim(raw_url), '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT bad AND h <> '' AND p IS NOT NULL)"
        " SELECT s || ':' AS protocol, p AS port, p IN (80, 443, 8080, 8443) AS allowed, count(*) AS targets FROM abso GROUP BY 1, 2, 3")
    out["url_resolved"] = f"WITH {_links()} SELECT page_id, pos, raw_href AS href, url AS resolved_url FROM lnk"
    out["url_decomposed"] = (
        "SELECT page_id, url, split_part(url, '/', 1) AS protocol, regexp_extract(url, '^https?://([^/?#]*)', 1) AS hostname, CAST(CASE WHEN url LIKE 'https:%' THEN 443 ELSE 80 END AS BIGINT) AS port,"
        " regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?][^#]*') AS query, regexp_extract(url, '#.*$') AS fragment FROM pages")
    out["response_log"] = (
        f"WITH {_RESP} SELECT response_id, url, CAST(status_code AS BIGINT) AS status_code, response_ms, content_length, hsts,"
        " (" + " + ".join(f"CAST({c} IS NOT NULL AS INT)" for _, c in R._HEADER_NAMES) + " + CAST(coalesce(cookie1, cookie2, cookie3) IS NOT NULL AS INT))::BIGINT AS headers FROM resp")
    out["host_policy"] = (
        f"WITH {_NORM} SELECT page_id, hostname, hostname IN {_in(urls.BLOCKED_HOSTS)} OR hostname LIKE '%.localhost' OR hostname LIKE '%.local' AS blocked FROM norm WHERE valid")
    out["ip_blocked"] = (
        f"WITH {_X}, ips AS (SELECT {_body(R.IPS)} FROM x) SELECT event_id, ip, {_ip_rule('ip')} AS rule, {_ip_rule('ip')} IS NOT NULL AS blocked FROM ips")
    out["host_admission"] = f"WITH {_admission()} SELECT host, addresses, first_offender, error IS NULL AS admitted, error FROM r"
    out["site_link_profile"] = (
        f"WITH {_links(False)}, {_LINK_COUNTS} SELECT host, count(*) AS pages, sum(total)::BIGINT AS links, sum(internal)::BIGINT AS internal, sum(external)::BIGINT AS external,"
        " sum(nofollow)::BIGINT AS nofollow, max(total) AS max_links FROM lc GROUP BY host")
    out["tag_census"] = f"WITH {doc} SELECT tag, count(*) AS elements, count(DISTINCT page_id) AS pages FROM mark WHERE NOT starts_with(tag, '/') GROUP BY tag"
    pair = r"""([^\s/>="']+)(\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""
    out["element_attributes"] = (
        f"WITH {doc}, b AS (SELECT page_id, pos, tag, regexp_extract_all(regexp_replace(regexp_replace(op, '^<[a-zA-Z][^\\s/>]*', ''), '>$', ''), {_q(pair)}) AS l FROM mark WHERE NOT starts_with(tag, '/')),"
        " u AS (SELECT page_id, pos, tag, unnest(l) AS a FROM b) SELECT page_id, pos, tag, lower(regexp_extract(a, '^[^\\s=]+')) AS attr, "
        + _decode("regexp_replace(regexp_replace(a, '^[^\\s=]+\\s*=?\\s*', ''), '^[\"'']|[\"'']$', '', 'g')") + " AS value FROM u")
    out["page_stats"] = f"WITH {stats} SELECT * FROM stats"
    out["head_meta"] = f"WITH {doc}, {_HEAD} SELECT * FROM head"
    out["headings"] = (
        f"WITH {doc}, {_SPAN}, {_HEADINGS} SELECT page_id, coalesce(h1_count, 0) AS h1_count, coalesce(h2_count, 0) AS h2_count, coalesce(h3_count, 0) AS h3_count,"
        f" coalesce(array_to_string(h1_list, '{G.JOIN}'), '') AS h1, coalesce(array_to_string(h2_list[1:10], '{G.JOIN}'), '') AS h2, coalesce(array_to_string(h3_list[1:10], '{G.JOIN}'), '') AS h3"
        " FROM page LEFT JOIN hd USING (page_id)")
    out["links_classified"] = f"WITH {_links()} SELECT * FROM lnk"
    out["link_counts"] = f"WITH {_links()}, {_LINK_COUNTS} SELECT * FROM lc"
    out["top_links_per_page"] = (
        f"WITH {_links()} SELECT page_id, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM lnk) z WHERE rn <= 5")
    out["image_audit"] = (
        f"WITH {stats}, {_IMG} SELECT s.page_id, s.images AS total, count(i.page_id) FILTER (WHERE has_alt) AS with_alt, count(i.page_id) FILTER (WHERE NOT has_alt) AS missing_alt,"
        " count(i.page_id) FILTER (WHERE loading = 'lazy') AS lazy FROM stats s LEFT JOIN img i USING (page_id) GROUP BY s.page_id, s.images")
    out["images_listed"] = f"WITH {doc}, {_IMG} SELECT * FROM img"
    out["script_breakdown"] = (
        f"WITH {stats}, {_CODE} SELECT p.page_id, p.scripts AS total, (SELECT count(*) FROM codef c WHERE c.page_id = p.page_id) AS external_count,"
        f" (SELECT count(*) FROM code c WHERE c.page_id = p.page_id AND href IS NULL) AS inline_count, {_joined('r_url', 'pos', 100, 'coder')} AS files FROM stats p")
    out["stylesheet_breakdown"] = (
        f"WITH {stats}, {_CSS} SELECT p.page_id, p.stylesheets AS total, (SELECT count(*) FROM cssf c WHERE c.page_id = p.page_id) AS external_count,"
        f" p.inline_styles AS inline_count, {_joined('r_url', 'pos', 100, 'cssr')} AS files FROM stats p")
    out["og_map"] = f"WITH {doc}, {_social('property', 'og:', 'og')} SELECT page_id, key, content FROM og"
    out["twitter_map"] = f"WITH {doc}, {_social('name', 'twitter:', 'tw')} SELECT page_id, key, content FROM tw"
    out["jsonld_blocks"] = f"WITH {doc}, {_LD} SELECT page_id, pos, is_malformed, name FROM ld"
    out["jsonld_census"] = (
        f"WITH {doc}, {_LD} SELECT CASE WHEN is_malformed THEN '(malformed)' ELSE coalesce(kind, '(none)') END AS type, count(*) AS blocks, count(DISTINCT page_id) AS pages FROM ld GROUP BY 1")
    out["dom_outline"] = _outline()
    out["framework_census"] = (
        f"WITH {_src(True)} SELECT CASE WHEN contains(html, 'id=\"__NEXT_DATA__\"') THEN 'Next.js' WHEN contains(html, 'id=\"__NUXT_DATA__\"') OR contains(html, 'window.__NUXT__') THEN 'Nuxt.js'"
        " WHEN contains(html, '__INITIAL_STATE__') THEN 'Redux/SSR' ELSE '(none)' END AS framework, count(*) AS pages FROM src GROUP BY 1")
    out["html_eligibility"] = (
        f"WITH {_RESP}, k AS (SELECT response_id, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS media_type FROM resp) SELECT response_id, media_type, media_type IN {_in(html.HTML_TYPES)} AS is_html,"
        f" CASE WHEN media_type NOT IN {_in(html.HTML_TYPES)} THEN 'The server returned ''' || CASE WHEN media_type = '' THEN 'unknown' ELSE media_type END || '''. HTML structure inspection is only available for HTML resources.' END AS notice FROM k")
    out["source_choice"] = (
        "SELECT page_id, url, CASE WHEN page_id % 6 = 3 THEN replace(html, '<article>', '<article><p>hydrated</p>') ELSE html END AS html, CASE WHEN page_id % 6 = 3 THEN 'dynamic' ELSE 'fast' END AS mode FROM pages")
    out["link_search"] = f"WITH {_links()} SELECT page_id, pos, url FROM lnk WHERE url ILIKE '%partner.example%'"
    out["html_search"] = (
        f"WITH {_src(True)}, l AS (SELECT page_id, unnest(string_split_regex(html, '\\r?\\n')) AS line, unnest(range(1, len(string_split_regex(html, '\\r?\\n')) + 1)) AS line_no FROM src)"
        f" SELECT page_id, line_no, line, len(regexp_extract_all(line, '(?i){G.NEEDLE}')) AS hits FROM l WHERE line ILIKE '%{G.NEEDLE}%'")
    items = _seo()
    out["seo_items"] = f"WITH {items} SELECT * FROM items"
    out["seo_summary"] = f"WITH {items} SELECT page_id, host, {_SUMMARY} FROM items GROUP BY page_id, host"
    out["seo_site_rollup"] = f"WITH {items} SELECT host, factor, {_SUMMARY}, grouping_id(host, factor) AS level FROM items GROUP BY ROLLUP (host, factor)"
    out["seo_worst_pages"] = (
        f"WITH {items}, s AS (SELECT page_id, host, {_SUMMARY} FROM items GROUP BY page_id, host), r AS (SELECT *, dense_rank() OVER (PARTITION BY host ORDER BY fails DESC, warnings DESC) AS rank FROM s)"
        " SELECT host, rank, page_id, fails, warnings FROM r WHERE rank <= 3")
    checks = _checks()
    out["header_checks"] = f"WITH {checks} SELECT * FROM checks"
    out["header_score"] = (
        f"WITH {checks} SELECT response_id, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE status = 'fail') AS missing, count(*) AS total FROM checks GROUP BY 1")
    out["security_site_rollup"] = (
        f"WITH {checks} SELECT host, key, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'fail') AS fail FROM checks GROUP BY host, key")
    cookies = _cookies()
    found = cookies.removeprefix(_RESP + ", ")
    out["cookies_masked"] = f"WITH {cookies} SELECT * FROM ck"
    out["cookie_flag_cube"] = f"WITH {cookies} SELECT http_only, secure, count(*) AS cookies, grouping_id(http_only, secure) AS level FROM ck GROUP BY CUBE (http_only, secure)"
    out["cookie_flag_census"] = (
        f"WITH {cookies} SELECT host, count(*) AS cookies, count(*) FILTER (WHERE http_only) AS http_only, count(*) FILTER (WHERE secure) AS secure, count(*) FILTER (WHERE same_site <> 'Not set') AS same_site_set FROM ck GROUP BY host")
    ch = _chains()
    out["redirect_chains"] = f"{ch} SELECT start_url, cur AS final_url, CAST(status_code AS BIGINT) AS status_code, error, total_ms, array_to_string(path, '{G.JOIN}') AS path FROM chain"
    adm = _admission(" UNION SELECT 'login.example.com' UNION SELECT '169.254.169.254'")
    ad = ch.replace("WITH RECURSIVE", f"WITH RECURSIVE {adm}, refusals AS (SELECT host, error AS refusal FROM r WHERE error IS NOT NULL),").replace(
        "AS target FROM hops),", "AS target FROM hops WHERE regexp_extract(from_url, '^https://([^/]*)', 1) NOT IN (SELECT host FROM refusals)),").replace(
        f"THEN {_q(http.NO_RECORD)}", f"THEN coalesce(refusal, {_q(http.NO_RECORD)})").replace(
        "AS keep FROM walk w", "AS keep, f.refusal FROM walk w LEFT JOIN refusals f ON f.host = regexp_extract(w.cur, '^https://([^/]*)', 1)")
    out["redirect_admission"] = out["redirect_chains"].replace(ch, ad)
    out["redirect_hops"] = f"{ch} SELECT * FROM hop_rows"
    out["redirect_errors"] = (
        f"{ch} SELECT CASE WHEN error IS NULL THEN 'ok' WHEN error LIKE 'Redirect loop%' THEN 'loop' WHEN error LIKE 'Maximum%' THEN 'hop_limit' WHEN error LIKE 'Invalid redirect%' THEN 'bad_location' ELSE 'no_record' END AS outcome,"
        " count(*) AS chains, sum(len(path))::BIGINT AS hops, max(len(path)) AS longest FROM chain GROUP BY 1")
    out["chain_timing"] = (
        f"{ch} SELECT c.start_url, len(c.path) AS hop_count, coalesce(sum(h.response_ms), 0)::BIGINT AS redirect_ms, max(h.response_ms) AS slowest_hop_ms, c.total_ms FROM chain c LEFT JOIN hop_rows h USING (start_url) GROUP BY c.start_url, c.path, c.total_ms")
    out["failed_inspections"] = f"{ch} SELECT false AS success, start_url AS url, cur AS final_url, error, len(path) AS redirects, total_ms AS response_time FROM chain WHERE error IS NOT NULL"
    cat = (
        "CASE WHEN coalesce(status_code, 0) = 0 THEN 'error' WHEN status_code < 200 THEN 'unknown' WHEN status_code < 300 THEN 'success' WHEN status_code < 400 THEN 'redirect'"
        " WHEN status_code < 500 THEN 'client_error' WHEN status_code < 600 THEN 'server_error' ELSE 'unknown' END")
    out["status_categories"] = f"WITH {_RESP} SELECT {cat} AS category, count(*) AS responses FROM resp GROUP BY 1"
    out["status_labels"] = (
        f"WITH {_RESP} SELECT response_id, host, CAST(status_code AS BIGINT) AS status_code, CASE WHEN status_code BETWEEN 300 AND 399 THEN 'REDIRECT' WHEN status_code BETWEEN 400 AND 499 THEN 'CLIENT ERROR'"
        " WHEN status_code >= 500 THEN 'SERVER ERROR' ELSE 'ONLINE' END AS label, CASE WHEN response_ms < 800 THEN 'good' ELSE 'slow' END AS latency_band, response_ms FROM resp")
    out["latency_by_host"] = (
        f"WITH {_RESP} SELECT host, count(*) AS responses, count(*) FILTER (WHERE response_ms < 800) AS good, min(response_ms) AS fastest_ms, max(response_ms) AS slowest_ms, quantile_disc(response_ms, 0.5) AS median_ms FROM resp GROUP BY host")
    out["response_guards"] = (
        f"WITH {_RESP} SELECT response_id, CASE WHEN declared_length > 5242880 THEN 'Response size (' || declared_length || ' bytes) exceeds maximum allowed limit of 5242880 bytes.'"
        " WHEN content_length > 5242880 THEN 'Response exceeded maximum size limit of 5242880 bytes while streaming.' WHEN response_ms > 10000 THEN 'Request timed out after 10000ms.' END AS guard_error FROM resp")
    fail = (
        f"{_RESP}, fl AS (SELECT *, CASE WHEN error_code = 'ENOTFOUND' THEN 'dns' WHEN error_code = 'ECONNREFUSED' THEN 'refused' WHEN error_code = 'ETIMEDOUT' THEN 'timeout'"
        " WHEN error_message LIKE '%certificate%' THEN 'tls' ELSE 'other' END AS class FROM resp WHERE error_code IS NOT NULL)")
    out["failure_classes"] = f"WITH {fail} SELECT class, count(*) AS failures FROM fl GROUP BY class"
    out["failure_messages"] = (
        f"WITH {fail} SELECT response_id, class, CASE class WHEN 'dns' THEN 'DNS resolution failed for ' || host || '. Host does not exist.' WHEN 'refused' THEN 'Connection refused by host at ' || host || ':' || port || '.'"
        " WHEN 'timeout' THEN 'Connection timed out while connecting to ' || host || '.' WHEN 'tls' THEN 'TLS Certificate validation failed: ' || error_message ELSE 'Network request error: ' || error_message END AS message FROM fl")
    out["server_fingerprint"] = (
        f"WITH {_RESP} SELECT CASE WHEN coalesce(server, '') = '' THEN 'Not disclosed' ELSE server END AS server, CASE WHEN port = 443 THEN 'HTTPS' ELSE 'HTTP' END AS protocol,"
        " 'HTTP/' || coalesce(http_version, '1.1') AS http_version, count(*) AS responses FROM resp GROUP BY 1, 2, 3")
    pairs = " UNION ALL ".join(
        [f"SELECT response_id, '{name.lower()}' AS name, {col} AS value FROM resp WHERE {col} IS NOT NULL" for name, col in R._HEADER_NAMES]
        + ["SELECT response_id, 'set-cookie', concat_ws(', ', cookie1, cookie2, cookie3) FROM resp WHERE coalesce(cookie1, cookie2, cookie3) IS NOT NULL"])
    out["header_search"] = f"WITH {_RESP}, hp AS ({pairs}) SELECT * FROM hp WHERE contains(name, '{G.HEADER_NEEDLE}') OR contains(lower(value), '{G.HEADER_NEEDLE}')"

    def records(kind: str) -> str:
        return f"coalesce(string_agg(c1 || coalesce(c2, ''), '{G.JOIN}' ORDER BY ord) FILTER (WHERE type = '{kind}' AND c1 IS NOT NULL), '') AS {kind.lower()}"

    out["dns_assembled"] = (
        f"WITH {_DNS}, g AS (SELECT host, {records('A')}, {records('AAAA')}, {records('CNAME')}, coalesce(string_agg(priority || ' ' || c1, '{G.JOIN}' ORDER BY priority, ord) FILTER (WHERE type = 'MX'), '') AS mx, {records('TXT')},"
        " count(c1) > 0 AS success, string_agg(type || ': ' || error, '; ' ORDER BY type) FILTER (WHERE error NOT IN ('ENODATA', 'ENOTFOUND')) AS errs FROM dns GROUP BY host)"
        f" SELECT * EXCLUDE (errs), CASE WHEN success THEN NULL ELSE coalesce(errs, '{dns_tls.NO_RECORDS}') END AS error FROM g")
    out["dns_record_pivot"] = (
        f"WITH {_DNS} SELECT host, " + ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS {k}" for k in ("A", "AAAA", "CNAME", "MX", "TXT")) + " FROM dns WHERE c1 IS NOT NULL GROUP BY host")
    cert = (
        f"{_CERTS}, c AS (SELECT *, list_filter(list_transform(string_split(san, ','), lambda s: regexp_replace(trim(s), '(?i)^dns:', '')), lambda s: s <> '') AS names FROM certs),"
        f" v AS (SELECT host, coalesce(s_cn, s_o, 'Unknown') AS subject, coalesce(i_o, i_cn, 'Unknown') AS issuer, coalesce(c_name || ' (' || c_version || ')', 'Unknown') AS cipher, protocol, authorized,"
        f" from_s * 1000000 AS valid_from, to_s * 1000000 AS valid_to, CAST(floor((to_s - {R.AS_OF_S}) / 86400.0) AS BIGINT) AS days_remaining, to_s < {R.AS_OF_S} AS is_expired,"
        f" CASE WHEN authorized THEN 'Valid' WHEN to_s < {R.AS_OF_S} THEN 'Expired' ELSE 'Untrusted / Invalid' END AS status, names[1:20] AS san_list, coalesce(len(names), 0) AS total_sans FROM c)")
    out["cert_validity"] = f"WITH {cert} SELECT * EXCLUDE (san_list, total_sans), coalesce(array_to_string(san_list, '{G.JOIN}'), '') AS sans, total_sans FROM v"
    out["cert_sans"] = f"WITH {cert} SELECT host, unnest(range(len(san_list))) AS pos, unnest(san_list) AS san FROM v"
    out["cert_expiry"] = (
        f"WITH {cert} SELECT issuer, count(*) AS certificates, count(*) FILTER (WHERE is_expired) AS expired, min(days_remaining) AS soonest_days FROM v WHERE days_remaining < 30 GROUP BY issuer")
    listed = f"{_assets()}, {_number('listed')}"
    out["asset_manifest"] = f"WITH {listed} SELECT page_id, idx, href AS original_src, r_url AS resolved_url, type, folder, local_path FROM numbered"
    out["asset_selection"] = (
        f"WITH {_assets()}, kept AS (SELECT * FROM listed l WHERE page_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM listed z WHERE z.page_id = l.page_id AND z.type IN ('js', 'icon'))"
        " OR EXISTS (SELECT 1 FROM listed z WHERE z.page_id = l.page_id AND z.type IN ('js', 'icon') AND CASE z.type WHEN 'js' THEN z.href ELSE z.r_url END IN (l.href, l.r_url))),"
        f" {_number('kept')} SELECT n.page_id, n.idx, r_url AS resolved_url, href AS original_src, local_path, 'bundle-' || regexp_replace(p.host, '[^a-zA-Z0-9_.-]', '_', 'g') AS bundle FROM numbered n JOIN page p USING (page_id)")
    budget = f"{listed}, {_SIZES}, {_BUDGET}"
    out["asset_budget"] = f"WITH {budget} SELECT * FROM budget"
    out["manifest_stats"] = (
        f"WITH {budget} SELECT p.page_id, p.url, (SELECT count(*) FROM ranked n WHERE n.page_id = p.page_id) AS found, count(b.page_id) AS included, coalesce(sum(b.bytes), 0)::BIGINT AS bytes"
        " FROM page p LEFT JOIN (SELECT * FROM budget WHERE outcome = 'included') b USING (page_id) GROUP BY p.page_id, p.url")
    attr_value = r"""(?is)^(<[^>]*\s{0}\s*=\s*)("[^"]*"|'[^']*'|[^\s>]*)"""
    src_value = _q(attr_value.format("src"))
    href_value = _q(attr_value.format("href"))
    out["page_rewrite"] = (
        f"WITH {listed}, nt AS (SELECT k.page_id, k.pos, CASE WHEN n.local_path IS NULL THEN k.t WHEN n.type IN ('css', 'icon') THEN regexp_replace(k.t, {href_value}, '\\1\"./' || n.local_path || '\"')"
        f" ELSE regexp_replace(k.t, {src_value}, '\\1\"./' || n.local_path || '\"') END || CASE WHEN k.pos = (SELECT min(pos) FROM mark m WHERE m.page_id = k.page_id AND m.tag = 'head')"
        f" THEN '<!-- Offline bundle | Source URL: ' || k.url || ' | Archive Timestamp: {R.AS_OF} -->' ELSE '' END AS t FROM tok k LEFT JOIN numbered n ON n.page_id = k.page_id AND n.pos = k.pos)"
        " SELECT page_id, url, html FROM (SELECT page_id, string_agg(t, '' ORDER BY pos) AS html FROM nt GROUP BY page_id) z JOIN page USING (page_id)")
    inv = (
        f"{doc}, {_CODE}, {_CSS}, {_IMG}, inv AS (SELECT DISTINCT page_id, 'script' AS category, r_url AS selected_url FROM coder UNION ALL SELECT DISTINCT page_id, 'stylesheet', r_url FROM cssr"
        " UNION ALL SELECT DISTINCT page_id, 'image', src FROM img)")
    out["asset_inventory"] = f"WITH {inv} SELECT * FROM inv"
    out["selection_algebra"] = (
        f"WITH {inv}, u AS (SELECT page_id, selected_url, bool_or(category = 'image') AS is_image FROM inv GROUP BY page_id, selected_url)"
        " SELECT page_id, count(*) FILTER (WHERE NOT is_image OR page_id % 3 = 0) AS selected, count(*) AS total FROM u GROUP BY page_id")
    out["shared_assets"] = (
        f"WITH {listed} SELECT n.r_url AS resolved_url, n.type, count(*) AS pages, count(DISTINCT p.host) AS hosts FROM ranked n JOIN page p USING (page_id) GROUP BY n.r_url, n.type")
    out["asset_overlap"] = (
        f"WITH {listed}, th AS (SELECT DISTINCT n.type, p.host FROM ranked n JOIN page p USING (page_id) WHERE p.host IS NOT NULL), t AS (SELECT type, count(*) AS c FROM th GROUP BY type)"
        " SELECT x.type AS a, y.type AS b, x.c AS items_a, y.c AS items_b, count(u.host) AS \"both\", x.c + y.c - count(u.host) AS either FROM t x JOIN t y ON x.type < y.type"
        " LEFT JOIN (SELECT v.host, v.type AS vt, w.type AS wt FROM th v JOIN th w ON v.host = w.host) u ON u.vt = x.type AND u.wt = y.type GROUP BY 1, 2, 3, 4")
    seq = f"WITH {_TRACE}, {_SEQ}"
    out["trace_sequence"] = f"{seq} SELECT session_id, id, seq, time, delta_ms, {_DELTA} AS delta_str, category, level, message FROM seqd"
    out["trace_redacted"] = (
        f"WITH r AS (SELECT lang, text, regexp_replace(regexp_replace(text, {_q(trace.BEARER.removeprefix('(?i)'))}, '{trace.BEARER_MASK}', 'gi'), {_q(trace.SECRET.removeprefix('(?i)'))}, '\\1=[MASKED]', 'gi') AS redacted FROM documents)"
        " SELECT lang, redacted <> text AS masked, count(*) AS documents, sum(length(redacted))::BIGINT AS chars FROM r GROUP BY 1, 2")
    out["trace_meta"] = (
        f"WITH {_TRACE} SELECT session_id, seq, 'user' AS key, json_extract_string(meta, '$.user') AS value FROM trace UNION ALL"
        " SELECT session_id, seq, 'auth', regexp_replace(json_extract_string(meta, '$.auth'), 'Bearer\\s+[A-Za-z0-9\\-._~+/]+=*', 'Bearer [REDACTED]', 'gi') FROM trace UNION ALL"
        " SELECT session_id, seq, 'ok', json_extract_string(meta, '$.ok') FROM trace UNION ALL SELECT session_id, seq, 'list', '[1,2,3,4,5,6,7,8,9,10]' FROM trace WHERE json_array_length(meta, '$.list') > 10")
    whole = seq.replace(" WHERE id <= 200", "")
    out["trace_groups"] = (
        f"{whole} SELECT session_id, count(*) AS \"all\", count(*) FILTER (WHERE category IN ('DNS', 'TLS', 'HTTP', 'NETWORK')) AS network, count(*) FILTER (WHERE category IN ('BROWSER', 'DOM')) AS browser,"
        f" count(*) FILTER (WHERE category = 'API') AS api, count(*) FILTER (WHERE {_T_ERR}) AS error FROM seqd GROUP BY session_id")
    out["trace_errors"] = f"{whole} SELECT session_id, id, category, level FROM seqd WHERE {_T_ERR}"
    out["trace_text"] = f"{whole} SELECT session_id, id, {_DELTA} || ' [' || category || '] ' || message AS line FROM seqd"
    net = f"WITH {_NET}, {_LIFE}"
    req = f"{net}, {_READY}"
    out["net_lifecycle"] = f"{net} SELECT * REPLACE (CASE WHEN url IS NULL THEN NULL ELSE name END AS name) FROM named"
    out["net_stats"] = (
        f"{req} SELECT session_id, count(*) AS total, count(*) FILTER (WHERE is_dynamic) AS dynamic, count(*) FILTER (WHERE {_ERR}) AS errors, sum(coalesce(bytes, 0))::BIGINT AS bytes FROM req GROUP BY session_id")
    out["net_dynamic_only"] = f"{req} SELECT session_id, request_id, is_dynamic FROM req"
    out["net_initiators"] = f"{net} SELECT initiator_label, count(*) AS requests, sum(coalesce(bytes, 0))::BIGINT AS bytes FROM named GROUP BY 1"
    out["net_tabs"] = (
        f"{req} SELECT count(*) AS \"all\", count(*) FILTER (WHERE is_dynamic) AS dynamic, count(*) FILTER (WHERE resource_type IN ('xhr', 'fetch')) AS fetch, count(*) FILTER (WHERE resource_type = 'script') AS js,"
        f" count(*) FILTER (WHERE resource_type = 'stylesheet') AS css, count(*) FILTER (WHERE resource_type = 'image') AS img, count(*) FILTER (WHERE {_ERR}) AS error FROM req")
    out["net_search"] = f"{net} SELECT session_id, request_id, name FROM named WHERE contains(lower(name), '{G.REQUEST_NEEDLE.lower()}') OR contains(lower(url), '{G.REQUEST_NEEDLE.lower()}')"
    out["net_newest"] = f"{net} SELECT session_id, request_id, start_ts FROM named ORDER BY start_ts DESC NULLS LAST, session_id, request_id LIMIT 100"
    band = _BAND.format("status_code", "status")
    out["net_status_bands"] = (
        f"{net}, b AS (SELECT resource_type, {band} AS band FROM named) SELECT resource_type, " + ", ".join(f"count(*) FILTER (WHERE band = '{b}') AS \"{b}\"" for b in ("2xx", "3xx", "4xx", "5xx", "pending"))
        + " FROM b GROUP BY resource_type")
    out["net_status_mix"] = f"{net} SELECT start_ts // 3600000000 * 3600000000 AS window_start, {band} AS band, count(*) AS requests FROM named WHERE start_ts IS NOT NULL GROUP BY 1, 2"
    out["net_durations"] = (
        f"{net} SELECT resource_type, count(*) AS requests, min(duration_ms) AS fastest_ms, max(duration_ms) AS slowest_ms, sum(duration_ms)::BIGINT AS total_ms FROM named WHERE duration_ms IS NOT NULL GROUP BY 1")
    near = "count(*) AS n, true AS p50_near, true AS p95_near, true AS p99_near"  # what a sketch must reach for every key
    out["net_duration_quantiles"] = f"{net} SELECT resource_type, {near} FROM named WHERE duration_ms IS NOT NULL GROUP BY 1"
    out["latency_quantiles"] = f"WITH {_RESP} SELECT host, {near} FROM resp WHERE response_ms IS NOT NULL GROUP BY 1"
    calls = (
        f"{_NET}, calls AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM net WHERE action = 'start' AND lower(resource_type) IN ('xhr', 'fetch') QUALIFY n <= 50)")
    out["net_api_capture"] = f"WITH {calls} SELECT session_id, n, request_id, url, method, resource_type FROM calls"
    out["net_fifo_pairing"] = _fifo(calls.replace(" QUALIFY n <= 50", ""))
    out["net_console"] = (
        f"WITH {_X}, con AS (SELECT {_body(R.CONSOLE)} FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM con WHERE type IN {_in(netevents.CONSOLE_TYPES)})"
        " SELECT session_id, n, type, substr(text, 1, 200) AS text FROM k WHERE n <= 25")
    out["inactivity_sessions"] = f"WITH {_SESS} SELECT * FROM sess"
    win = f"w AS (SELECT event_id, {_CLIENT} AS client, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 * 3600000000 AS window_start FROM events)"
    out["rate_limit_windows"] = (
        f"WITH {win}, r AS (SELECT *, row_number() OVER (PARTITION BY client, window_start ORDER BY us, event_id) AS rn FROM w) SELECT event_id, client, window_start, rn <= 2 AS allowed, greatest(0, 2 - rn) AS remaining, window_start + 3600000000 AS reset_at FROM r")
    out["rate_limit_offenders"] = f"WITH {win} SELECT client, window_start, count(*) AS requests, count(*) - 2 AS refused FROM w GROUP BY 1, 2 HAVING count(*) > 2"
    out["rate_limit_stream"] = f"WITH {win} SELECT client, window_start, count(*) AS requests, greatest(0, count(*) - 2) AS refused FROM w GROUP BY 1, 2"
    out["inactivity_stream"] = f"WITH {_SESS} SELECT * FROM sess"
    out["net_status_mix_stream"] = (
        f"WITH {_NET} SELECT us // 3600000000 * 3600000000 AS window_start, {_BAND.format('status', 'CAST(status AS VARCHAR)')} AS band, count(*) AS responses FROM net WHERE action = 'response' GROUP BY 1, 2")
    out["net_lifecycle_stream"] = f"{net} SELECT session_id, request_id, start_ts, url, method, resource_type, status, status_code, bytes, duration_ms FROM named"
    out["net_fifo_stream"] = out["net_fifo_pairing"]
    out["net_dynamic_stream"] = f"{req} SELECT session_id, request_id, is_dynamic FROM req WHERE start_ts IS NOT NULL"
    shown = "(st.is_html OR p.page_id % 6 = 3)"
    out["inspection_report"] = (
        f"{ch}, {items}, {checks}, {found}, {_DNS}, {cert},"
        " dn AS (SELECT host, count(c1) > 0 AS dns_success FROM dns GROUP BY host),"
        " el AS (SELECT page_id, count(*) AS n FROM mark WHERE NOT starts_with(tag, '/') GROUP BY 1),"
        f" ps AS (SELECT page_id, {_body(R.STARTS)}, len(string_split(html, '<article>')) - 1 AS articles FROM pages),"
        f" st AS (SELECT page_id, {cat} AS category, CAST(status_code AS BIGINT) AS status_code, 'HTTP/' || coalesce(http_version, '1.1') AS http_version, content_length, response_ms,"
        " CASE WHEN port = 443 THEN 'HTTPS' ELSE 'HTTP' END AS protocol, CASE WHEN coalesce(server, '') = '' THEN 'Not disclosed' ELSE server END AS server,"
        f" lower(trim(split_part(coalesce(content_type, ''), ';', 1))) AS media, media IN {_in(html.HTML_TYPES)} AS is_html FROM resp)"
        " SELECT p.page_id, p.url, CASE WHEN p.page_id % 6 = 3 THEN 'dynamic' ELSE 'fast' END AS mode, st.status_code, 'OK' AS status_text, st.category, st.protocol, st.http_version, st.server,"
        " st.content_length, st.response_ms, st.is_html,"
        f" CASE WHEN NOT {shown} THEN 'The server returned ''' || CASE WHEN media = '' THEN 'unknown' ELSE media END || '''. HTML structure inspection is only available for HTML resources.' END AS notice,"
        f" CASE WHEN {shown} THEN h.title END AS title, CASE WHEN {shown} THEN el.n + CASE WHEN p.page_id % 6 = 3 THEN ps.articles ELSE 0 END END AS dom_elements,"
        f" CASE WHEN {shown} THEN (SELECT count(*) FROM lnk l WHERE l.page_id = p.page_id) END AS links,"
        f" CASE WHEN {shown} THEN (SELECT count(*) FROM img i WHERE i.page_id = p.page_id) END AS images,"
        f" CASE WHEN {shown} THEN (SELECT count(*) FROM items i WHERE i.page_id = p.page_id AND status = 'pass') END AS seo_passes,"
        " (SELECT count(*) FROM checks k WHERE k.response_id = p.page_id AND status = 'pass') AS headers_passed, (SELECT count(*) FROM ck k WHERE k.response_id = p.page_id) AS cookies,"
        " dn.dns_success, v.status AS tls_status, CAST(len(c.path) AS BIGINT) AS redirects, c.cur AS final_url, c.error, c.total_ms"
        " FROM page p JOIN head h USING (page_id) JOIN st USING (page_id) JOIN el USING (page_id) JOIN ps USING (page_id) JOIN chain c ON c.start_url = ps.start_url"
        " LEFT JOIN dn ON dn.host = p.host LEFT JOIN v ON v.host = p.host")
    return out


def _fifo(calls: str) -> str:
    """Pairing by replaying each URL's calls and responses in order through a recursive query."""
    return (
        f"WITH RECURSIVE {calls}, ans AS (SELECT session_id, url, seq, status FROM net WHERE action = 'response' AND lower(resource_type) IN ('xhr', 'fetch')),"
        " both_rows AS (SELECT session_id, url, seq, 1 AS step, CAST(NULL AS INT) AS status, request_id FROM calls UNION ALL SELECT session_id, url, seq, -1, status, NULL FROM ans"
        " WHERE (session_id, url) IN (SELECT session_id, url FROM calls)),"
        " ord AS (SELECT *, row_number() OVER (PARTITION BY session_id, url ORDER BY seq) AS k FROM both_rows),"
        " play AS (SELECT session_id, url, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS open_calls, CAST(NULL AS VARCHAR) AS hit, CAST(NULL AS INT) AS status, CAST(NULL AS BIGINT) AS answer_seq FROM (SELECT DISTINCT session_id, url FROM calls) z"
        " UNION ALL SELECT p.session_id, p.url, o.k, CASE WHEN o.step = 1 THEN list_append(p.open_calls, o.request_id) ELSE p.open_calls[2:] END,"
        " CASE WHEN o.step = -1 THEN p.open_calls[1] END, o.status, o.seq FROM play p JOIN ord o ON o.session_id = p.session_id AND o.url = p.url AND o.k = p.k + 1)"
        " SELECT c.session_id, c.seq, c.request_id, c.url, c.method, CAST(h.status AS BIGINT) AS status, h.answer_seq FROM calls c LEFT JOIN play h ON h.session_id = c.session_id AND h.hit = c.request_id")
