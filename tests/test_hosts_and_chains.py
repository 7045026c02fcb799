"""Canonical hosts against Python's own, and long, looping and refused redirect chains."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from crawlsift.functions import urls as U
from crawlsift.operators import http, urls
from crawlsift.sources import io


def test_ipv6_spellings(spark):
    draw, texts = random.Random(1), ["::", "::1", "0::1", "0:0:0:0:0:0:0:1", "1::", "1:2:3:4:5:6:7:8", "::ffff:127.0.0.1", "0:0:0:0:0:ffff:7f00:1", "fe80::1%eth0", "1:0:0:2:0:0:0:3"]
    for _ in range(300):
        groups = [draw.choice([0, 0, 1, 0xFFFF, draw.randrange(65536)]) for _ in range(8)]
        text = ":".join(f"{g:x}".zfill(draw.randrange(1, 5)) for g in groups)
        at = draw.randrange(9)
        texts += [text, ":".join(text.split(":")[:at]) + "::" + ":".join(text.split(":")[at + draw.randrange(1, 4):]), text.rsplit(":", 2)[0] + ":10.0.0.255"]
    bad = ["", ":", ":::", "1:2:3", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", "12345::", "g::", "::1.2.3", "::256.1.1.1", "1.2.3.4", "::1.2.3.4:5", ":1::", "1:"]
    got = spark.createDataFrame([(t,) for t in texts + bad], "t string").selectExpr("t", f"{U.ipv6_groups('t')} AS g").selectExpr(
        "t", "g", f"{U.ipv6_text('g')} AS s").collect()
    for r in got:
        try:
            want = ipaddress.IPv6Address(r.t.split("%")[0])
        except ValueError:
            want = None
        if r.t == "1:2:3:4:5:6:7::8":  # a gap of no group
            want = None
        assert (r.g is None) == (want is None), r.t
        if want is not None:
            assert r.g == [int.from_bytes(want.packed[i:i + 2]) for i in range(0, 16, 2)]
            plain = ipaddress.IPv6Address(int(want)).compressed
            assert "." in plain or r.s == plain, r.t


def test_labels_in_punycode(spark):
    draw, words = random.Random(2), ["bücher", "münchen-ost", "例え", "пример", "a", "ü", "日本語。jp", "😀x", "ελληνικά", "abc", "ünïcödé-with-a-long-plain-part"]
    words += ["".join(draw.choice("abc-çéñабв日本語中文😀한글") for _ in range(draw.randrange(1, 24))) for _ in range(150)]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", f"{U.ascii_host('w')} AS a").collect()
    for r in got:
        assert r.a == ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in r.w.replace("。", ".").split("."))


@pytest.mark.parametrize("url,want", [
    ("http://Bücher.DE/x", "http://xn--bcher-kva.de/x"), ("http://[0:0:0:0:0:0:0:1]/", "http://[::1]/"), ("http://[::FFFF:127.0.0.1]:8080/", "http://[::ffff:7f00:1]:8080/"),
    ("http://[1:2]/", None), ("http://[::1/", None), ("https://[2001:0db8:0:0:8:800:200C:417A]/", "https://[2001:db8::8:800:200c:417a]/")])
def test_hosts_in_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").selectExpr(U.parse_url("u") + ".url AS u").first().u == want


def test_every_spelling_is_refused(spark):
    ips = ["::1", "0::1", "0:0::0:1", "::ffff:127.0.0.1", "0:0:0:0:0:ffff:7f00:1", "0::ffff:10.0.0.1", "fc00::", "FD00:0::1", "fe80:0:0:0::1", "febf::1", "::", "0:0::0"]
    fine = ["2606:4700:4700::1111", "::ffff:8.8.8.8", "0:0:0:0:0:ffff:8.8.8.8", "8.8.8.8", "fec0::1", "fb00::1"]
    got = {r.ip: r.blocked for r in urls.classify_ips(spark.createDataFrame([(x,) for x in ips + fine], "ip string"), urls.policy_cidrs(spark)).collect()}
    assert got == dict.fromkeys(ips, True) | dict.fromkeys(fine, False)
    targets = spark.createDataFrame([("[0::1]",), ("[0:0:0:0:0:ffff:7f00:1]",), ("[2606:4700::1]",)], "host string")
    answers = spark.createDataFrame([], "host string, ord int, ip string")
    judged = urls.admit_hosts(targets, answers, urls.policy_cidrs(spark), urls.policy_hosts(spark))
    assert {r.host: r.admitted for r in judged.collect()} == {"[0::1]": False, "[0:0:0:0:0:ffff:7f00:1]": False, "[2606:4700::1]": True}


def test_narrowest_of_many_networks(spark):
    draw = random.Random(3)
    nets = [ipaddress.ip_network((draw.randrange(1 << 32) >> (32 - n) << (32 - n), n)) for n in [0] + [draw.randrange(4, 33) for _ in range(2000)]]
    nets += [ipaddress.ip_network((int(nets[i].network_address), 32)) for i in range(200)]
    policy = spark.createDataFrame([urls._bounds(str(n)) for n in set(nets)], "cidr string, net_lo bigint, net_hi bigint")
    ips = [str(ipaddress.ip_address(draw.randrange(1 << 32))) for _ in range(300)] + [str(n.network_address) for n in nets[:300]]
    got = {r.ip: r.rule for r in urls.classify_ips(spark.createDataFrame([(x,) for x in ips], "ip string"), policy).collect()}
    for ip in ips:
        assert got[ip] == str(max((n for n in set(nets) if ipaddress.ip_address(ip) in n), key=lambda n: n.prefixlen))


def follow(start, hops, limit, refused):
    """One chain, hop by hop."""
    cur, seen, path, total = start, {start}, [], 0
    for hop in range(limit + 1):
        host = cur.split("/")[2]
        if host in refused:
            return cur, None, refused[host], total, path
        if cur not in hops:
            return cur, None, http.NO_RECORD, total, path
        code, target, ms = hops[cur]
        total += ms
        if target is None:
            return cur, code, None, total, path
        if hop == limit:
            return cur, code, f"{http.TOO_MANY_1}{limit}{http.TOO_MANY_2}", total, path
        path = path + [target]
        if target in seen:
            return target, code, f"{http.LOOP_1}{target}{http.LOOP_2}", total, path
        seen.add(target)
        cur = target
    raise AssertionError


@pytest.mark.parametrize("limit", [0, 1, 5, 1000])
def test_chains_equal_a_walk(spark, limit):
    draw = random.Random(4)
    node = lambda i: f"https://h{i % 7}.example/{i}"
    hops = {node(i): (301, node(draw.randrange(60)), i) if draw.random() < 0.8 else (200, None, i) for i in range(50)}  # trees, loops, open ends
    hops |= {node(i): (302, node(i + 1), 1) for i in range(1000, 2000)} | {node(2000): (200, None, 5)}  # 1,000 hops
    hops |= {node(i): (302, node(3000 + (i - 2999) % 130), 1) for i in range(3000, 3130)}  # a ring
    refused = {"h3.example": "no entry", "h6.example": "not here"}
    starts = [node(i) for i in [*range(60), 1000, 1001, 1998, 2000, 3000, 3005]]
    table = spark.createDataFrame([(u, c, None, t, ms) for u, (c, t, ms) in hops.items()], io.HOPS)
    begin = spark.createDataFrame([(u,) for u in starts], "start_url string")
    for banned in ({}, refused):
        found = http.chains(begin, table, limit, spark.createDataFrame(list(banned.items()), "host string, error string") if banned else None).collect()
        assert len(found) == len(starts)
        for r in found:
            want = follow(r.start_url, hops, limit, banned)
            assert (r.final_url, r.status_code, r.error, r.total_ms, [h.to_url for h in r.hops]) == want
            assert [h.hop for h in r.hops] == list(range(1, len(want[4]) + 1))


def test_chains_of_nothing(spark):
    empty = spark.createDataFrame([], io.HOPS)
    assert http.chains(spark.createDataFrame([], "start_url string"), empty).collect() == []
    got = http.chains(spark.createDataFrame([("https://a/",), (None,)], "start_url string").where(F.col("start_url").isNotNull()), empty).collect()
    assert [(r.error, r.hops) for r in got] == [(http.NO_RECORD, [])]
