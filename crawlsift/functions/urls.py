"""URL rules as Spark SQL expressions: parsing and resolving the WHATWG way, without UDFs.

Everything works on arrays of URL texts, so the links of a page are resolved inside its row. Each step is a
`transform` of its own: a lambda body has no common-subexpression elimination, so a parsed part that several later
fields need is kept in a struct first. `parse_url` and `resolve_url` are the one-value forms.
"""

from __future__ import annotations

from crawlsift.functions.text import q, q_list

# Schemes whose URLs always have an authority, with their default ports.
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
SPECIAL = [*DEFAULT_PORTS, "file"]

SCHEME_RE = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
# scheme, userinfo, host, port, path, query, fragment
URL_RE = (
    r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):/*(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([^/?#]*))?"
    r"([^?#]*)(\?[^#]*)?(#.*)?$"
)
# control characters and blanks at the edges, line breaks and tabs anywhere
EDGES_RE = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
# names that need no further look: no escapes, no address (also none in hexadecimal), nothing forbidden
PLAIN_HOST_RE = r"^(?:[a-z0-9_-]++[.])*+(?!0x)[a-z0-9_-]*[a-z_-]$"
NUMERIC_HOST_RE = r"(^|[.])(0x[0-9a-f]*|[0-9]+)[.]?$"
_FILE_RE = r"(?is)^(file):(?://)?()([^/?#:]*)()([^?#]*)(\?[^#]*)?(#.*)?$"
_SEP = "\u0001"
_GROUPS = _SEP.join(f"${i}" for i in range(1, 8))

URL_TYPE = "struct<url:string,scheme:string,host:string,port:int,path:string,query:string,fragment:string>"


def _clean(e: str) -> str:
    return f"regexp_replace({e}, {q(EDGES_RE)}, '')"


def _encode(e: str, unsafe: str) -> str:
    """Percent-encode the characters of the class `unsafe`, and all non-ASCII, as UTF-8."""
    cls = q(rf"[\x00-\x20\x7f-\x{{10ffff}}{unsafe}]")
    chars = f"transform(split({e}, ''), ch -> CASE WHEN ch RLIKE {cls} THEN replace(url_encode(ch), '+', '%20') ELSE ch END)"
    return f"CASE WHEN {e} = '' THEN '' WHEN {e} RLIKE {cls} THEN array_join({chars}, '') ELSE {e} END"


def _drop_dots(path: str) -> str:
    """Remove `.` and `..` segments."""
    fold = (
        f"aggregate(slice(split({path}, '/'), 2, length({path}) + 1), '', (kept, seg) -> CASE"
        f" WHEN seg RLIKE {q(r'^(?i)(?:[.]|%2e){2}$')} THEN regexp_replace(kept, '/[^/]*$', '')"
        f" WHEN seg RLIKE {q(r'^(?i)(?:[.]|%2e)$')} THEN kept ELSE concat(kept, '/', seg) END)")
    return (
        f"CASE WHEN (contains({path}, '/.') OR contains({path}, '%2')) AND {path} RLIKE {q(r'(?i)/(?:[.]|%2e){1,2}(?:/|$)')}"
        f" THEN concat({fold}, CASE WHEN {path} RLIKE {q(r'(?i)/(?:[.]|%2e){1,2}$')} THEN '/' ELSE '' END) ELSE {path} END")


def _ipv4_number(part: str) -> str:
    """One dotted part as a number: decimal, octal with a leading 0, or hexadecimal."""
    return (
        f"CASE WHEN {part} RLIKE '^0[xX]0*[0-9a-fA-F]{{0,10}}$' THEN try_cast(conv(concat('0', substr({part}, 3)), 16, 10) AS bigint)"
        f" WHEN {part} RLIKE '^00*[0-7]{{1,13}}$' THEN try_cast(conv({part}, 8, 10) AS bigint)"
        f" WHEN {part} RLIKE '^(0|[1-9][0-9]{{0,11}})$' THEN try_cast({part} AS bigint) END")


def ipv4_value(host: str) -> str:
    """Number of a host written as an IPv4 address in any of its forms; NULL when it is out of range.

    The leading parts are one octet each, the last part fills the rest.
    """
    nums = f"transform(split(regexp_replace({host}, '[.]$', ''), '[.]'), ip -> {_ipv4_number('ip')})"
    fold = (
        f"aggregate({nums}, CAST(named_struct('n', 0, 'head', 0, 'last', 0) AS struct<n:int,head:bigint,last:bigint>),"
        f" (acc, num) -> CAST(named_struct('n', acc.n + 1, 'head', CASE WHEN acc.n = 0 THEN 0"
        f" WHEN acc.last BETWEEN 0 AND 255 AND acc.n < 4 THEN acc.head * 256 + acc.last END, 'last', num) AS struct<n:int,head:bigint,last:bigint>),"
        f" acc -> CASE WHEN acc.n <= 4 AND acc.last >= 0 AND acc.last < CAST(pow(256, 5 - acc.n) AS bigint)"
        f" THEN acc.head * CAST(pow(256, 5 - acc.n) AS bigint) + acc.last END)")
    return fold


def _dotted_host(host: str) -> str:
    """Dotted quad of such a host."""
    octets = ", ".join(f"pmod(shiftright(dv, {s}), 256)" for s in (24, 16, 8, 0))
    return f"get(transform(array({ipv4_value(host)}), dv -> CASE WHEN dv IS NOT NULL THEN concat_ws('.', {octets}) END), 0)"


def ipv6_groups(text: str) -> str:
    """The eight numbers of a lowercase IPv6 address, with or without zone, `::` and dotted tail; NULL for anything else."""
    hextets = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = q(f"^(.*:){octet}[.]{octet}[.]{octet}[.]{octet}$")
    dotted = "split(regexp_extract(v6t, '[^:]*$', 0), '[.]')"
    plain = (
        f"CASE WHEN v6t RLIKE {tail} THEN concat(regexp_extract(v6t, '^(.*:)', 1), lower(hex(CAST(get({dotted}, 0) AS int) * 256 + CAST(get({dotted}, 1) AS int))),"
        f" ':', lower(hex(CAST(get({dotted}, 2) AS int) * 256 + CAST(get({dotted}, 3) AS int)))) ELSE v6t END")
    sides = "transform(split(v6p, '::', -1), v6s -> filter(split(v6s, ':'), v6g -> v6g <> ''))"
    filled = (
        "transform(concat(v6h[0], array_repeat('0', CASE WHEN size(v6h) = 2 THEN 8 - size(v6h[0]) - size(v6h[1]) ELSE 0 END),"
        " CASE WHEN size(v6h) = 2 THEN v6h[1] ELSE filter(v6h[0], v6g -> false) END), v6g -> CAST(conv(v6g, 16, 10) AS int))")
    whole = f"size(v6h) = 1 AND size(v6h[0]) = 8 OR size(v6h) = 2 AND size(v6h[0]) + size(v6h[1]) <= 7"
    shaped = f"v6p RLIKE {q(f'^(?:{hextets}|(?:{hextets})?::(?:{hextets})?)$')}"
    return (
        f"get(transform(filter(transform(transform(array(regexp_replace({text}, '%.+$', '')), v6t -> {plain}), v6p -> CASE WHEN {shaped} THEN {sides} END),"
        f" v6h -> {whole}), v6h -> {filled}), 0)")


def ipv6_text(groups: str) -> str:
    """The one spelling of an address given as eight numbers: lowercase, the first of the longest runs of zeros left out."""
    joined = f"array_join(transform({groups}, v6n -> lower(hex(v6n))), ':')"
    runs = " ".join(
        f"WHEN v6j RLIKE '(^|:)0(:0){{{n - 1}}}(:|$)' THEN regexp_replace(v6j, '^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$', '$1::$2')" for n in range(8, 1, -1))
    return f"get(transform(array({joined}), v6j -> CASE {runs} ELSE v6j END), 0)"


def _digit(value: str) -> str:
    return f"substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST({value} AS int) + 1, 1)"


def punycode(label: str) -> str:
    """A label as ASCII: its plain characters, then by Bootstring the gaps between its other ones in the order of code points."""
    state = "struct<n:bigint,delta:bigint,bias:bigint,done:bigint,plain:bigint,out:string>"
    # digits of a number in base 36 with thresholds that follow the bias
    limit = "greatest(1L, least(26L, 36L * pk - pa.bias))"
    digits = (
        f"aggregate(sequence(1, 8), CAST(named_struct('q', pa.delta, 'o', '', 'end', false) AS struct<q:bigint,o:string,end:boolean>), (pv, pk) -> CASE WHEN pv.end THEN pv"
        f" WHEN pv.q < {limit} THEN CAST(named_struct('q', pv.q, 'o', concat(pv.o, {_digit('pv.q')}), 'end', true) AS struct<q:bigint,o:string,end:boolean>)"
        f" ELSE CAST(named_struct('q', (pv.q - {limit}) div (36L - {limit}), 'o', concat(pv.o, {_digit(f'{limit} + (pv.q - {limit}) % (36L - {limit})')}), 'end', false)"
        f" AS struct<q:bigint,o:string,end:boolean>) END).o")
    start = "CASE WHEN pa.done = pa.plain THEN pa.delta div 700 ELSE pa.delta div 2 END"
    adapted = (
        f"aggregate(sequence(1, 6), CAST(named_struct('d', {start} + {start} div (pa.done + 1), 'k', 0L) AS struct<d:bigint,k:bigint>),"
        " (pb, pi) -> CASE WHEN pb.d > 455 THEN CAST(named_struct('d', pb.d div 35, 'k', pb.k + 36) AS struct<d:bigint,k:bigint>) ELSE pb END,"
        " pb -> pb.k + 36 * pb.d div (pb.d + 38))")
    each = (
        f"aggregate(pl.cps, CAST(named_struct('n', pm, 'delta', po.delta + (pm - po.n) * (po.done + 1), 'bias', po.bias, 'done', po.done, 'plain', po.plain, 'out', po.out) AS {state}),"
        f" (pa, pc) -> CASE WHEN pc < pm THEN CAST(named_struct('n', pa.n, 'delta', pa.delta + 1, 'bias', pa.bias, 'done', pa.done, 'plain', pa.plain, 'out', pa.out) AS {state})"
        f" WHEN pc = pm THEN CAST(named_struct('n', pa.n, 'delta', 0L, 'bias', {adapted}, 'done', pa.done + 1, 'plain', pa.plain, 'out', concat(pa.out, {digits})) AS {state}) ELSE pa END,"
        f" pa -> CAST(named_struct('n', pa.n + 1, 'delta', pa.delta + 1, 'bias', pa.bias, 'done', pa.done, 'plain', pa.plain, 'out', pa.out) AS {state}))")
    first = (
        f"CAST(named_struct('n', 128L, 'delta', 0L, 'bias', 72L, 'done', size(pl.basic), 'plain', size(pl.basic),"
        f" 'out', CASE WHEN size(pl.basic) > 0 THEN concat(array_join(pl.basic, ''), '-') ELSE '' END) AS {state})")
    split_up = (
        f"named_struct('cps', transform(filter(split(px, ''), pc -> pc <> ''), pc -> CAST(ascii(pc) AS bigint)),"
        f" 'basic', filter(split(px, ''), pc -> pc <> '' AND ascii(pc) < 128))")
    return (
        f"get(transform(transform(array({label}), px -> {split_up}), pl -> concat('xn--',"
        f" aggregate(array_sort(array_distinct(filter(pl.cps, pc -> pc >= 128))), {first}, (po, pm) -> {each}, po -> po.out))), 0)")


def ascii_host(host: str) -> str:
    """A lowercase host with every label that isn't ASCII in its ASCII form; ideographic full stops part labels as well."""
    label = q(r"[^\x00-\x7f]")
    return (
        f"CASE WHEN {host} RLIKE {label} THEN array_join(transform(split({host}, '[.\u3002\uff0e\uff61]'),"
        f" al -> CASE WHEN al RLIKE {label} THEN {punycode('al')} ELSE al END), '.') ELSE {host} END")


def _parts(cleaned: str) -> str:
    """`{t, scheme, special, p}` of each text, where `p` holds the seven groups of URL_RE."""
    schemed = (
        f"transform({cleaned}, ut -> named_struct('t', ut,"
        f" 'scheme', lower(regexp_extract(ut, {q('^([a-zA-Z][a-zA-Z0-9+.-]*):')}, 1))))")
    slashed = f"regexp_replace(us.t, {q(chr(92) + 'G([^?#' + chr(92) * 2 + ']*)' + chr(92) * 2)}, '$1/')"
    return (
        f"transform({schemed}, us -> named_struct('t', us.t, 'scheme', us.scheme, 'special', us.scheme IN {q_list(SPECIAL)},"
        f" 'p', split(regexp_replace(CASE WHEN us.scheme IN {q_list(SPECIAL)} AND contains(us.t, {q(chr(92))}) THEN {slashed} ELSE us.t END,"
        f" CASE us.scheme WHEN 'file' THEN {q(_FILE_RE)} ELSE {q(URL_RE)} END, '{_GROUPS}'), '{_SEP}')))")


def parse_urls(texts: str, clean: bool = True) -> str:
    """Parse an array of absolute URL texts; an element that is no valid URL becomes NULL."""
    cleaned = f"transform({texts}, uc -> {_clean('uc')})" if clean else texts
    named = (
        f"transform({_parts(cleaned)}, up -> named_struct('t', up.t, 'scheme', up.scheme, 'special', up.special, 'p', up.p,"
        f" 'host', lower(CASE WHEN contains(get(up.p, 2), '%') THEN try_url_decode(replace(get(up.p, 2), '+', '%2B')) ELSE get(up.p, 2) END)))")
    forbidden = q(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
    bare = "substr(uh.host, 2, length(uh.host) - 2)"
    six = f"get(transform(array({ipv6_groups(bare)}), v6 -> concat('[', {ipv6_text('v6')}, ']')), 0)"
    host = (
        f"CASE WHEN uh.host RLIKE {q(PLAIN_HOST_RE)} THEN CASE WHEN uh.special THEN uh.host ELSE get(uh.p, 2) END"
        f" WHEN NOT uh.special THEN get(uh.p, 2) WHEN uh.host RLIKE {q(r'^\[[0-9a-f:.]+\]$')} THEN {six}"
        f" WHEN uh.host RLIKE {forbidden} THEN NULL"
        f" WHEN uh.host RLIKE {q(NUMERIC_HOST_RE)} THEN {_dotted_host('uh.host')}"
        f" ELSE {ascii_host('uh.host')} END")
    raw_path = "concat(CASE WHEN get(uh.p, 4) = '' THEN '/' ELSE '' END, " + _encode("get(uh.p, 4)", '"<>`{}^') + ")"
    hosted = (
        f"transform({named}, uh -> named_struct('t', uh.t, 'scheme', uh.scheme, 'special', uh.special, 'p', uh.p,"
        f" 'authority', uh.special OR uh.t RLIKE {q(SCHEME_RE + '//')}, 'host', {host},"
        f" 'port', CASE WHEN get(uh.p, 3) RLIKE '^0*[0-9]{{1,9}}$' THEN CAST(get(uh.p, 3) AS int) END,"
        f" 'raw_path', CASE WHEN uh.special THEN {raw_path} ELSE get(uh.p, 4) END,"
        f" 'query', CASE WHEN uh.special THEN {_encode('get(uh.p, 5)', chr(34) + '<>' + chr(39))} ELSE get(uh.p, 5) END,"
        f" 'fragment', {_encode('get(uh.p, 6)', chr(34) + '<>`')}))")
    default = "CASE " + " ".join(f"WHEN ud.scheme = '{k}' THEN {v}" for k, v in DEFAULT_PORTS.items()) + " END"
    done = (
        f"transform({hosted}, ud -> named_struct('t', ud.t, 'scheme', ud.scheme, 'p', ud.p, 'authority', ud.authority,"
        f" 'host', ud.host,"
        f" 'ok', size(ud.p) = 7 AND ud.host IS NOT NULL AND (ud.host <> '' OR ud.scheme = 'file')"
        f" AND (get(ud.p, 3) = '' OR ud.port <= 65535),"
        f" 'written_port', nullif(ud.port, {default}), 'port', coalesce(ud.port, {default}),"
        f" 'path', CASE WHEN ud.special THEN {_drop_dots('ud.raw_path')} ELSE ud.raw_path END,"
        f" 'query', ud.query, 'fragment', ud.fragment))")
    href = (
        "concat(ur.scheme, '://', CASE WHEN get(ur.p, 1) = '' THEN '' ELSE concat(get(ur.p, 1), '@') END, ur.host,"
        " coalesce(concat(':', ur.written_port), ''), ur.path, ur.query, ur.fragment)")
    fields = "'url', {}, 'scheme', ur.scheme, 'host', {}, 'port', {}, 'path', {}, 'query', {}, 'fragment', {}"
    return (
        f"transform({done}, ur -> CASE WHEN ur.authority AND ur.ok"
        f" THEN CAST(named_struct({fields.format(href, 'ur.host', 'ur.port', 'ur.path', 'ur.query', 'ur.fragment')}) AS {URL_TYPE})"
        f" WHEN NOT ur.authority AND ur.scheme <> '' THEN CAST(named_struct("
        + fields.format("concat(ur.scheme, substr(ur.t, length(ur.scheme) + 1))", "''", "NULL", "''", "''", "''")
        + f") AS {URL_TYPE}) END)")


def parse_url(text: str) -> str:
    """Parse one absolute URL text."""
    return f"get({parse_urls(f'array({text})')}, 0)"


def absolute_text(href: str, base: str) -> str:
    """Absolute text of `href` seen from the parsed URL `base`, not yet normalised."""
    origin = f"regexp_extract({base}.url, '^[a-z][a-z0-9+.-]*://[^/?#]*', 0)"
    return (
        f"CASE WHEN {href} RLIKE {q(SCHEME_RE)} THEN {href}"
        f" WHEN substr(replace({href}, {q(chr(92))}, '/'), 1, 2) = '//' THEN concat({base}.scheme, ':', {href})"
        f" WHEN startswith({href}, '/') OR startswith({href}, {q(chr(92))}) THEN concat({origin}, {href})"
        f" WHEN startswith({href}, '?') THEN concat({origin}, {base}.path, {href})"
        f" WHEN {href} = '' OR startswith({href}, '#') THEN concat({origin}, {base}.path, {base}.query, {href})"
        f" ELSE concat({origin}, regexp_replace({base}.path, '[^/]*$', ''), {href}) END")


def resolve_urls(hrefs: str, base: str) -> str:
    """Resolve an array of references against one parsed base URL."""
    # "https:page" next to an https base is a relative reference
    short = (
        f"startswith(lower(rh), concat({base}.scheme, ':')) AND {base}.scheme IN {q_list(SPECIAL)}"
        f" AND NOT rh RLIKE {q(r'^[a-zA-Z]+:[/\\]')}")
    relative = (
        f"transform(transform({hrefs}, rh -> {_clean('rh')}),"
        f" rh -> CASE WHEN {short} THEN substr(rh, length({base}.scheme) + 2) ELSE rh END)")
    return parse_urls(f"transform({relative}, rr -> {absolute_text('rr', base)})", clean=False)


def resolve_url(href: str, base: str) -> str:
    """Resolve one reference against one parsed base URL."""
    return f"get({resolve_urls(f'array({href})', base)}, 0)"
