"""URL admission: normalise, reject, screen hosts, classify addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.functions.plan import lookup, once
from crawlsift.functions.text import q, strip

# Admission policy.
DEFAULT_PORTS = [80, 443, 8080, 8443]
BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "instance-data", "169.254.169.254"]
BLOCKED_SUFFIXES = [".localhost", ".local"]
BLOCKED_CIDRS = [
    "127.0.0.0/8", "0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10",
    "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "255.255.255.255/32"]
# Wording of a rejection, in the order the rules apply.
REQUIRED = "URL is required and must be a string."
EMPTY = "URL cannot be empty."
INVALID = "Invalid URL format: Invalid URL"
PROTOCOL_1, PROTOCOL_2 = "Unsupported protocol '", "'. Only 'http:' and 'https:' are allowed."
NO_HOST = "URL must include a valid hostname."
PORT_1, PORT_2 = "Port ", " is not permitted. Allowed ports: "

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = f"{_OCTET}(?:[.]{_OCTET}){{3}}"
_IPV4 = f"^{_QUAD}$"
_GROUPS6 = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"


def is_ipv6(ip: str) -> str:
    """SQL text: whether a lowercase text is an IPv6 address, with or without zone and dotted tail."""
    bare = f"regexp_replace(regexp_replace({ip}, '%.+$', ''), {q('(?<=:)' + _QUAD + '$')}, '0:0')"
    groups = f"size(filter(split({bare}, ':'), g -> g <> ''))"
    return (
        f"(({bare} RLIKE '^{_GROUPS6}$' AND {groups} = 8)"
        f" OR ({bare} RLIKE '^(?:{_GROUPS6})?::(?:{_GROUPS6})?$' AND {groups} <= 7))")



def ip_number(ip: str) -> str:
    """SQL text: a dotted quad as an unsigned number."""
    return f"aggregate(split({ip}, '[.]'), 0L, (v, part) -> v * 256 + CAST(part AS bigint))"


def _bounds(cidr: str) -> tuple[str, int, int]:
    net, bits = cidr.split("/")
    value = sum(int(part) << shift for part, shift in zip(net.split("."), (24, 16, 8, 0)))
    size = 1 << (32 - int(bits))
    return cidr, value - value % size, value - value % size + size - 1


def policy_cidrs(spark: SparkSession, cidrs: list[str] = BLOCKED_CIDRS) -> DataFrame:
    """Policy table of blocked networks: `cidr, net_lo, net_hi`."""
    return spark.createDataFrame([_bounds(c) for c in cidrs], "cidr string, net_lo bigint, net_hi bigint")


def policy_hosts(spark: SparkSession) -> DataFrame:
    """Policy table of blocked names: `pattern, kind`."""
    rows = [(h, "exact") for h in BLOCKED_HOSTS] + [(s, "suffix") for s in BLOCKED_SUFFIXES]
    return spark.createDataFrame(rows, "pattern string, kind string")


def normalize(df: DataFrame, col: str = "raw_url", ports: list[int] = DEFAULT_PORTS) -> DataFrame:
    """Add `url, protocol, hostname, port, valid, error`; the first failing rule gives the error."""
    full = (
        f"CASE WHEN startswith(trimmed, '//') THEN concat('https:', trimmed) WHEN trimmed RLIKE {q(U.SCHEME_RE)} THEN trimmed"
        f" ELSE concat('https://', trimmed) END")
    allowed = ", ".join(str(p) for p in ports)
    error = (
        f"CASE WHEN {col} IS NULL OR {col} = '' THEN {q(REQUIRED)} WHEN trimmed = '' THEN {q(EMPTY)}"
        f" WHEN parsed.url IS NULL THEN {q(INVALID)}"
        f" WHEN parsed.scheme NOT IN ('http', 'https') THEN concat({q(PROTOCOL_1)}, parsed.scheme, ':', {q(PROTOCOL_2)})"
        f" WHEN parsed.host = '' THEN {q(NO_HOST)}"
        f" WHEN parsed.port NOT IN ({allowed}) THEN concat({q(PORT_1)}, CAST(parsed.port AS string), {q(PORT_2 + allowed + '.')}) END")
    step = once(once(df.withColumn("trimmed", F.expr(strip(col))), parsed=U.parse_url(full)), error=error)
    ok = F.col("error").isNull()
    return step.select(
        *df.columns,
        F.when(ok, F.col("parsed.url")).alias("url"),
        F.when(ok, F.concat(F.col("parsed.scheme"), F.lit(":"))).alias("protocol"),
        F.when(ok, F.col("parsed.host")).alias("hostname"),
        F.when(ok, F.col("parsed.port")).alias("port"),
        ok.alias("valid"), "error")


def decompose(df: DataFrame, col: str) -> DataFrame:
    """Add the parts of an absolute URL: `protocol, hostname, port, path, query, fragment`."""
    return once(df, parsed=U.parse_url(col)).selectExpr(
        *df.columns, "concat(parsed.scheme, ':') AS protocol", "parsed.host AS hostname", "parsed.port AS port",
        "parsed.path AS path", "parsed.query AS query", "parsed.fragment AS fragment")


def resolve(df: DataFrame, href_col: str, base_col: str) -> DataFrame:
    """Add `resolved_url` of a reference column against a base URL column; NULL when it is no valid URL."""
    parsed = once(df, parsed_base=U.parse_url(base_col))
    return once(parsed, resolved_url=U.resolve_url(href_col, "parsed_base") + ".url").drop("parsed_base")


def rejections(normalized: DataFrame) -> DataFrame:
    """Rejected targets by reason."""
    return normalized.where(~F.col("valid")).groupBy("error").agg(F.count("*").alias("targets"))


def accepted(normalized: DataFrame) -> DataFrame:
    """Targets that passed every rule."""
    return normalized.where("valid")


def rejected(normalized: DataFrame, col: str = "raw_url") -> DataFrame:
    """Targets that failed a rule, with the reason."""
    return normalized.where(~F.col("valid")).select(col, "error")


def by_port_policy(parsed: DataFrame, allowed_ports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed URLs by a port policy table into allowed and refused (the table has one row per port)."""
    ports = F.broadcast(allowed_ports.select("port").distinct())
    return parsed.join(ports, "port", "left_semi"), parsed.join(ports, "port", "left_anti")


def screen_hosts(df: DataFrame, policy: DataFrame, col: str = "hostname", row_id: list[str] | None = None) -> DataFrame:
    """Add `blocked`: the host is on the exact list or under a blocked suffix.

    Exact names are an equi join. A suffix is an equi join too: a host is expanded into the few suffixes it has, so
    the policy table may grow without a nested-loop join. `row_id` names the columns that tell rows apart, all by default.
    """
    host = F.lower(F.trim(F.col(col)))
    hosts = df.select(host.alias("h")).where("h IS NOT NULL").distinct()
    keys = hosts.select("h", F.explode(F.expr(
        "concat(array(named_struct('kind', 'exact', 'pattern', h)), transform(sequence(1, size(split(h, '[.]'))),"
        " i -> named_struct('kind', 'suffix', 'pattern', concat('.', array_join(slice(split(h, '[.]'), i + 1, size(split(h, '[.]'))), '.')))))")
    ).alias("key")).select("h", "key.*")
    hits = keys.join(policy, ["kind", "pattern"], "left_semi").select("h").distinct().withColumn("hit", F.lit(True))
    return lookup(df.withColumn("h", host), hits, ["h"], row_id or df.columns).select(
        *df.columns, F.coalesce("hit", F.lit(False)).alias("blocked"))


def classify_ips(df: DataFrame, policy: DataFrame, col: str = "ip") -> DataFrame:
    """Add the `rule` that blocks an address, the most specific network or a textual rule, and `blocked`.

    The policy becomes one row per first two octets with its networks, the narrowest first, so the longest prefix is found
    by one equi join that matches each address at most once. That table has 65,536 rows at most however many networks there are;
    which side of the join moves is left to the optimizer. IPv6 addresses are judged by their numbers, so that every spelling of
    one has the same rule; mapped IPv4 addresses are judged as such if their tail is dotted, and refused otherwise.
    """
    nets = policy.select("cidr", "net_lo", "net_hi", F.explode(F.expr(
        "sequence(CAST(shiftright(net_lo, 16) AS int), CAST(shiftright(net_hi, 16) AS int))")).alias("prefix"))
    by_prefix = nets.groupBy("prefix").agg(F.expr(
        "array_sort(collect_list(named_struct('width', net_hi - net_lo, 'lo', net_lo, 'hi', net_hi, 'cidr', cidr))) AS nets"))
    addr = df.withColumn("addr", F.lower(F.trim(F.col(col))))
    grouped = once(addr, g=f"CASE WHEN NOT addr RLIKE {q(_IPV4)} THEN {U.ipv6_groups('addr')} END")
    mapped = "array_max(slice(g, 1, 5)) = 0 AND g[5] = 65535"
    shaped = grouped.withColumn("v4", F.expr(
        f"CASE WHEN addr RLIKE {q(_IPV4)} THEN addr WHEN {mapped} AND contains(addr, '.') THEN regexp_extract(addr, {q(f'({_QUAD})(?:%.*)?$')}, 1) END"))
    numbered = once(shaped, n=ip_number("v4")).withColumn("prefix", F.expr("CAST(shiftright(n, 16) AS int)"))
    textual = (
        f"CASE WHEN g IS NULL THEN 'invalid' WHEN array_max(slice(g, 1, 7)) = 0 AND g[7] = 1 THEN 'loopback' WHEN array_max(g) = 0 THEN 'unspecified'"
        f" WHEN g[0] BETWEEN 64512 AND 65023 THEN 'unique-local' WHEN g[0] BETWEEN 65152 AND 65215 THEN 'link-local' WHEN {mapped} THEN 'mapped' END")
    rule = f"CASE WHEN v4 IS NOT NULL THEN get(filter(nets, r -> n BETWEEN r.lo AND r.hi), 0).cidr ELSE {textual} END"
    return once(numbered.join(by_prefix, "prefix", "left"), rule=rule).select(*df.columns, "rule").withColumn(
        "blocked", F.col("rule").isNotNull())


def admit_hosts(targets: DataFrame, dns_answers: DataFrame, cidrs: DataFrame, names: DataFrame) -> DataFrame:
    """Hosts admitted only if they are not listed, resolve, and every address is public; else the first reason.

    `targets(host)`, `dns_answers(host, ord, ip)`. An address literal is its own answer, with or without brackets.
    Both sides shrink to distinct rows before the join, so a host that holds a third of all targets is one row.
    """
    hosts = targets.select(F.lower(F.trim("host")).alias("host")).where("host IS NOT NULL").distinct()
    screened = screen_hosts(hosts, names, "host").withColumnRenamed("blocked", "listed")
    bare = F.regexp_replace("host", r"^\[|\]$", "")
    literal = bare.rlike(_IPV4) | F.expr(is_ipv6(r"regexp_replace(host, '^[\\[]|[\\]]$', '')"))
    own = hosts.where(literal).select("host", bare.alias("ip"), F.lit(0).cast("int").alias("ord"))
    answers = dns_answers.groupBy(F.lower("host").alias("host"), "ip").agg(F.min("ord").alias("ord")).where(~literal)
    judged = classify_ips(answers.unionByName(own), cidrs)
    per_host = judged.groupBy("host").agg(
        F.count("*").alias("addresses"), F.count_if("blocked").alias("blocked_addresses"),
        F.expr("min_by(ip, ord) FILTER (WHERE blocked)").alias("first_offender"))
    access = F.concat(F.lit("Access to '"), "host")
    reason = (
        F.when(F.col("listed"), F.concat(access, F.lit("' is blocked for security reasons (SSRF Protection).")))
        .when(literal & (F.col("blocked_addresses") > 0),
              F.concat(F.lit("Access to IP address '"), "host",
                       F.lit("' is restricted (SSRF Protection: private/internal IP).")))
        .when(F.col("addresses").isNull(),
              F.concat(F.lit("Could not resolve hostname '"), "host", F.lit("'. DNS lookup returned no records.")))
        .when(F.col("blocked_addresses") > 0,
              F.concat(access, F.lit("' is blocked because it resolves to restricted IP "), "first_offender",
                       F.lit(" (SSRF Protection)."))))
    return screened.join(per_host, "host", "left").select(
        "host", F.coalesce("addresses", F.lit(0)).cast("bigint").alias("addresses"), "first_offender",
        reason.isNull().alias("admitted"), reason.alias("error"))
