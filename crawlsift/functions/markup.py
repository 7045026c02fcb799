"""HTML rules as Spark SQL expressions: lexing and reading elements, all inside the page's own row.

`TOKEN_RE` cuts a whole document into comments, raw-text elements with their bodies, tags and text runs; joined again
the tokens give the document back. Every repetition around a group is possessive: a backtracking one would overflow
the regex stack on one tag with thousands of attributes.
"""

from __future__ import annotations

from crawlsift.functions.text import decode_entities, q, q_list

# Elements whose content is text, not markup.
RAW_TEXT = ["script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"]
# Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]

_ATTRS = r"""(?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN_RE = (
    r"(?i)[^<]++"
    r"|<!--(?:-?>|(?s:.*?)(?:--!?>|\z))"
    rf"|<({'|'.join(RAW_TEXT)})(?=[\s/>]){_ATTRS}>(?:[^<]++|<(?!/\1[\s/>]))*+(?:</\1[^>]*+>)?+"
    # a tag that never ends takes the rest of the document, else every further "<" would scan it again
    rf"|<[a-z][^\s/>]*+{_ATTRS}(?:>|\z)"
    r"|</[a-z][^>]*+(?:>|\z)"
    r"|<[!?/][^>]*+(?:>|\z)|<"
)
_NAME_RE = r"^<(/?[a-zA-Z][^\s/>]*)"
_RAW_END = rf"(?i)</(?:{'|'.join(RAW_TEXT)})[^>]*>\z"
OPEN_RE = rf"(?i)^<[a-z][^\s/>]*+{_ATTRS}>"
_BODY_RE = rf"(?i)^<[a-z][^\s/>]*+({_ATTRS})>"
_ATTR_RE = r"""[\s/]*+(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+[\s/]*+"""


def tokens(html: str) -> str:
    """All tokens of a document in order."""
    return f"regexp_extract_all({html}, {q(TOKEN_RE)}, 0)"


def marks(toks: str) -> str:
    """Start and end tags as `{pos, tag, raw}`; an end tag's name starts with `/`, an unfinished tag does not count."""
    finished = f"(endswith(tm.raw, '>') OR (tm.tag IN {q_list(RAW_TEXT)} AND tm.raw RLIKE {q(OPEN_RE)}))"
    return (
        f"filter(transform({toks}, (tk, ti) -> named_struct('pos', ti, 'tag',"
        f" CASE WHEN startswith(tk, '<') THEN lower(regexp_extract(tk, {q(_NAME_RE)}, 1)) ELSE '' END, 'raw', tk)),"
        f" tm -> tm.tag <> '' AND {finished})")


def parse_attrs(raw: str) -> str:
    """Attributes of one start tag as `array<struct<k, v>>`, names lowercased, in written order."""
    marked = f"regexp_replace(regexp_extract({raw}, {q(_BODY_RE)}, 1), {q(_ATTR_RE)}, '\u0001$1\u0002$2$3$4')"
    kept = f"slice(split({marked}, '\u0001'), 2, length({raw}))"
    value = "substring_index(at, '\u0002', -1)"
    return (f"transform({kept}, at -> named_struct('k', lower(substring_index(at, '\u0002', 1)), 'v', {decode_entities(value)}))")


def attr(attrs: str, name: str) -> str:
    """Value of an attribute, first one wins; NULL when absent."""
    return f"get(filter({attrs}, av -> av.k = '{name}'), 0).v"


def by_key(pairs: str) -> str:
    """Pairs sorted by key, then by place; to be stored in a column, which `first_wins` and `last_wins` read."""
    return f"array_sort(transform({pairs}, (bp, bi) -> named_struct('k', bp.k, 'i', bi, 'v', bp.v)))"


def _entries(found: str) -> str:
    """Map of `{i, k, v}` in the order of `i`."""
    return f"map_from_entries(transform(array_sort({found}), fe -> named_struct('k', fe.k, 'v', fe.v)))"


def first_wins(column: str) -> str:
    """Map of sorted pairs in written order, first duplicate wins."""
    firsts = f"filter({column}, (fp, fi) -> fi = 0 OR fp.k <> get({column}, fi - 1).k)"
    return _entries(f"transform({firsts}, ft -> named_struct('i', ft.i, 'k', ft.k, 'v', ft.v))")


def last_wins(column: str) -> str:
    """Map of sorted pairs: last value wins, keys keep the order of their first appearance; NULL when empty."""
    firsts = f"filter({column}, (fp, fi) -> fi = 0 OR fp.k <> get({column}, fi - 1).k)"
    lasts = f"filter({column}, (lp, li) -> li = size({column}) - 1 OR lp.k <> get({column}, li + 1).k)"
    merged = f"zip_with({firsts}, {lasts}, (f1, l1) -> named_struct('i', f1.i, 'k', f1.k, 'v', l1.v))"
    return f"CASE WHEN size({column}) > 0 THEN {_entries(merged)} END"


def raw_body(raw: str) -> str:
    """Content of a raw-text element token."""
    return f"regexp_replace(regexp_replace({raw}, {q(OPEN_RE)}, ''), {q(_RAW_END)}, '')"


def spans(bounds: str) -> str:
    """`{pos, stop, tag, raw}` of each start tag among the marks `bounds`, running to the next of them."""
    return (
        f"filter(zip_with({bounds}, slice({bounds}, 2, size({bounds}) + 1),"
        f" (s1, s2) -> named_struct('pos', s1.pos, 'stop', s2.pos, 'tag', s1.tag, 'raw', s1.raw)),"
        f" sp -> sp.pos IS NOT NULL AND NOT startswith(sp.tag, '/'))")


def inner_text(toks: str, span: str) -> str:
    """Text runs between a span's start tag and its end, decoded."""
    runs = (
        f"filter(slice({toks}, {span}.pos + 2, coalesce({span}.stop, size({toks})) - {span}.pos - 1),"
        f" ir -> NOT startswith(ir, '<') OR ir = '<')")
    return decode_entities(f"array_join({runs}, '')")
