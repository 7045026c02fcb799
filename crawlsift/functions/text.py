"""Text rules as Spark SQL expressions: whitespace and character references.

The helpers of this package take and give SQL text. A page audit is a few thousand expression nodes; as SQL the plan
is parsed in one call, while building it node by node from Python took seconds per query.
"""

from __future__ import annotations

from html.entities import name2codepoint


def q(text: str) -> str:
    """Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def q_list(values) -> str:
    """Literals for an IN list."""
    return "(" + ", ".join(q(v) for v in values) + ")"


# Fixed value: the whitespace class that page text is trimmed and collapsed with.
SPACES = r"\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

# One string " amp=38 lt=60 ... ", because a map of 252 literals would dominate planning time.
_NAMED = " " + " ".join(f"{name}={code}" for name, code in sorted(name2codepoint.items())) + " "


def strip(e: str) -> str:
    """Trim all whitespace, not only blanks."""
    return f"regexp_replace({e}, {q(f'^[{SPACES}]+|[{SPACES}]+$')}, '')"


def squish(e: str) -> str:
    """Collapse whitespace runs to one blank and trim."""
    return f"trim(regexp_replace({e}, {q(f'[{SPACES}]+')}, ' '))"


def present(e: str) -> str:
    """Trimmed text, NULL when nothing is left."""
    return f"nullif({strip(e)}, '')"


def decode_entities(e: str) -> str:
    """Decode numeric and HTML 4 named character references; text without `&` is passed through."""
    names = q(_NAMED)
    ref_re = q(r"^(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);")
    refs = (
        f"transform(slice(split({e}, '&'), 2, length({e})),"
        f" dp -> named_struct('piece', dp, 'ref', regexp_extract(dp, {ref_re}, 1)))")
    codes = (
        f"transform({refs}, dr -> named_struct('piece', dr.piece, 'size', length(dr.ref), 'code', CASE"
        f" WHEN dr.ref = '' THEN NULL"
        f" WHEN lower(dr.ref) LIKE '#x%' THEN try_cast(conv(substr(dr.ref, 3), 16, 10) AS int)"
        f" WHEN dr.ref LIKE '#%' THEN try_cast(substr(dr.ref, 2) AS int)"
        f" WHEN contains({names}, concat(' ', dr.ref, '='))"
        f" THEN try_cast(substring_index(substr({names}, instr({names}, concat(' ', dr.ref, '=')) + length(dr.ref) + 2), ' ', 1) AS int)"
        f" END))")
    usable = "dc.code BETWEEN 1 AND 1114111 AND NOT dc.code BETWEEN 55296 AND 57343"
    pieces = (
        f"transform({codes}, dc -> CASE WHEN {usable}"
        f" THEN concat(decode(unhex(lpad(hex(dc.code), 8, '0')), 'UTF-32'), substr(dc.piece, dc.size + 2))"
        f" ELSE concat('&', dc.piece) END)")
    return f"CASE WHEN contains({e}, '&') THEN concat(split({e}, '&')[0], array_join({pieces}, '')) ELSE {e} END"
