"""Traces, network events, rate limits and streams, also against brute force in plain Python."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from crawlsift.operators import limits, netevents, trace
from crawlsift.sources import io
from crawlsift.streaming import streams

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


# ---- traces
def traces(spark, rows):
    return spark.createDataFrame(rows, "session_id string, seq bigint, ts timestamp, category string, level string, message string, meta string")


def test_sequence_cap_and_delta(spark):
    rows = [("s", i, at(i * 0.5), "dns", None, f"m{i}", None) for i in range(250)] + [("t", 1, at(9), "WARN", None, "x", None)]
    got = trace.sequence(traces(spark, rows)).orderBy("session_id", "id").collect()
    assert len(got) == 201 and [r.id for r in got[:200]] == list(range(1, 201))
    assert (got[0].delta_str, got[3].delta_str, got[199].delta_str) == ("+0.000s", "+1.500s", "+99.500s")
    assert got[200].level == "warn" and got[200].delta_ms == 0
    assert trace.text_lines(trace.sequence(traces(spark, rows))).where("id = 4").first().line == "+1.500s [DNS] m3"


@pytest.mark.parametrize("slot_ms", [700, 600_000])
def test_whole_sequence_numbers_every_event(spark, slot_ms):
    rows = [("s", i, at(i * 0.3 if i % 2 else 5), "dns", None, f"m{i}", None) for i in range(500)] + [("t", 1, at(9), "WARN", None, "x", None)]
    got = trace.whole_sequence(traces(spark, rows), slot_ms).orderBy("session_id", "id").collect()
    want = trace.sequence(traces(spark, rows), 10_000).orderBy("session_id", "id").collect()
    assert len(got) == 501 and got == want


@pytest.mark.parametrize("text,want", [
    ("Authorization: bearer abc.DEF-_~+/=== ok", "Authorization: Bearer [REDACTED] ok"),
    ("token=abc; SessionID=x,y session_id=q", "token=[MASKED]; SessionID=[MASKED],y session_id=[MASKED]"),
    ("auth_token=z my_token=1", "auth_token=[MASKED] my_token=[MASKED]"), ("token = kept", "token = kept"), ("plain", "plain")])
def test_redaction(spark, text, want):
    row = trace.redacted(spark.createDataFrame([(text,)], "m string"), "m").first()
    assert row.redacted == want and row.masked == (text != want)


def test_meta_keeps_plain_values(spark):
    meta = '{"s":"token=1","n":1.5,"b":true,"l":[1,2,3,4,5,6,7,8,9,10,11],"o":{"a":1},"z":null}'
    rows = trace.sanitize_meta(traces(spark, [("s", 1, at(0), "API", None, "m", meta), *(
        ("s", 2 + i, at(0), "API", None, "m", odd) for i, odd in enumerate(["not json", "[1,2]", "5", '"x"', "null", "", "{}", None]))])).collect()
    assert {r.key: r.value for r in rows} == {"s": "token=[MASKED]", "n": "1.5", "b": "true", "l": "[1,2,3,4,5,6,7,8,9,10]"}


def test_groups_overlap(spark):
    rows = [("s", i, at(i), c, lvl, "m", None) for i, (c, lvl) in enumerate([("DNS", None), ("HTTP", "warn"), ("DOM", None), ("API", "error"), ("WARN", "info"), ("DONE", None)])]
    seq = trace.sequence(traces(spark, rows))
    r = trace.group_counts(seq).first()
    assert (r["all"], r.network, r.browser, r.api, r.error) == (6, 2, 1, 1, 3)
    assert trace.filter_group(seq, "error").count() == 3 and trace.filter_group(seq, "network").count() == 2


# ---- network events
def events(spark, rows):
    full = [(s, r, q, a, at(t), u, "GET", k, None, st, b, c) for s, r, q, a, t, u, k, st, b, c in rows]
    return spark.createDataFrame(full, netevents.EVENT_TYPE)


def test_lifecycle_merges_in_any_order(spark):
    e = events(spark, [
        ("s", "a", 3, "complete", 1.2344, None, None, None, 512, None), ("s", "a", 1, "start", 1, "https://h/x/app.js?v=12345678901234567890123456789012345", "Script", None, None, None),
        ("s", "a", 2, "response", 1.1, None, "script", 404, None, None),
        ("s", "b", 4, "start", 2, "https://h/", "XHR", None, None, None), ("s", "b", 5, "failed", 3, None, None, None, 9, True),
        ("s", "c", 6, "start", 2, "data:text/plain,x", None, None, None, None), ("s", "c", 7, "failed", 3, None, None, None, None, False),
        ("s", "d", 8, "complete", 4, None, None, None, 7, None), ("s", "e", 9, "response", 4, None, "xhr", 200, None, None),
        ("s", "f", 10, "start", 5, "nonsense url", "Image", None, None, None), ("s", "f", 11, "complete", 5, None, None, None, 1, None)])
    rows = {r.request_id: r for r in netevents.with_names(netevents.lifecycle(e)).collect()}
    a = rows["a"]
    assert (a.status, a.status_code, a.bytes, a.duration_ms, a.resource_type) == ("404", 404, 512, 234, "script")
    assert a.name == "app.js?v=123456789012345678901234567" and a.initiator_label == "Other"
    assert (rows["b"].status, rows["b"].bytes, rows["b"].duration_ms, rows["b"].name) == ("Canceled", 0, None, "h")
    assert (rows["c"].status, rows["c"].resource_type, rows["c"].name) == ("Failed", "other", "plain,x")
    assert (rows["d"].status, rows["d"].duration_ms, rows["d"].url) == ("200", 0, None)
    assert rows["e"].status == "200" and rows["e"].start_ts is None
    assert rows["f"].duration_ms == 1 and rows["f"].name == "nonsense url"
    bands = {r.request_id: r.band for r in netevents.lifecycle(e).selectExpr("request_id", netevents.status_band() + " AS band").collect()}
    assert bands == {"a": "4xx", "b": "pending", "c": "5xx", "d": "2xx", "e": "2xx", "f": "2xx"}


def test_initiator_labels(spark):
    kinds = [None, ("parser", []), ("script", []), ("script", [("https://h/js/inject.js", 4)]), ("script", [("https://h/", 0)]), ("script", [("", 7)]),
             ("script", [("a/b.js", 2)]), ("preflight", [])]
    rows = [("s", str(i), i, "start", at(i), "https://h/", "GET", "image", k, None, None, None) for i, k in enumerate(kinds)]
    got = {int(r.request_id): r.initiator_label for r in netevents.with_names(netevents.lifecycle(spark.createDataFrame(rows, netevents.EVENT_TYPE))).collect()}
    assert [got[i] for i in range(8)] == ["Other", "(index)", "script", "inject.js:4", "h:1", "script:7", "b.js:2", "Preflight"]


def test_dynamic_stats_tabs(spark):
    e = events(spark, [
        ("s", "doc", 1, "start", 0, "https://h/", "Document", None, None, None), ("s", "doc", 2, "complete", 2, None, "Document", None, 100, None),
        ("s", "x", 3, "start", 3, "https://h/x", "xhr", None, None, None), ("s", "y", 4, "start", 3.001, "https://h/y", "fetch", None, None, None),
        ("s", "y", 5, "response", 4, None, "fetch", 500, None, None), ("s", "y", 6, "complete", 5, None, None, None, 50, None)])
    requests = netevents.mark_dynamic(netevents.lifecycle(e), netevents.ready_times(e))
    assert {r.request_id: r.is_dynamic for r in requests.collect()} == {"doc": False, "x": False, "y": True}
    s = netevents.stats(requests).first()
    assert (s.total, s.dynamic, s.errors, s.bytes) == (3, 1, 1, 150)
    t = netevents.tab_counts(requests).first()
    assert (t["all"], t.dynamic, t.fetch, t.error) == (3, 1, 2, 1)
    assert netevents.tab(requests, "fetch").count() == 2 and [r.request_id for r in netevents.newest(requests, 1).collect()] == ["y"]
    assert [r.request_id for r in netevents.search(requests, " H/X ").collect()] == ["x"]


def replay(rows, cap):
    """Calls and responses one by one: a response answers the first open call of its URL."""
    calls, counts, result = defaultdict(deque), defaultdict(int), {}
    for s, r, q, a, u, st in sorted(rows, key=lambda x: x[2]):
        if a == "start" and (cap is None or counts[s] < cap):
            counts[s] += 1
            calls[s, u].append(r)
            result[s, r] = None
        elif a == "response" and calls[s, u]:
            result[s, calls[s, u].popleft()] = st
    return result


@pytest.mark.parametrize("seed,cap", [(1, 50), (2, 5), (3, 3), (4, None)])
def test_fifo_pairing_against_replay(spark, seed, cap):
    rng = random.Random(seed)
    rows = []
    for q in range(600):
        session = "hot" if rng.random() < 0.6 else f"s{rng.randrange(4)}"
        rows.append((session, f"r{q}", q, rng.choice(["start", "response", "response"]), f"https://u/{rng.randrange(3)}", rng.randrange(200, 600)))
    df = spark.createDataFrame(
        [(s, r, q, a, at(q), u, "GET", rng.choice(["XHR", "fetch"]), None, st if a == "response" else None, None, None) for s, r, q, a, u, st in rows], netevents.EVENT_TYPE)
    got = {(r.session_id, r.request_id): r.status for r in netevents.pair_fifo(df, cap).collect()}
    assert got == replay(rows, cap)


def test_fifo_pairing_spans_and_missing_keys(spark, monkeypatch):
    rows = [("hot", f"r{q}", q, "start" if q < 300 else "response", "https://u/", 200 + q) for q in range(700)]
    df = spark.createDataFrame(
        [(s, r, q, a, at(q), u, "GET", "XHR", None, st if a == "response" else None, None, None) for s, r, q, a, u, st in rows]
        + [("hot", "x", 5, "start", at(5), None, "GET", "XHR", None, None, None, None), (None, "y", 6, "start", at(6), "https://u/", "GET", "XHR", None, None, None, None)],
        netevents.EVENT_TYPE)
    for spans in (4096, 3, 1):
        monkeypatch.setattr(netevents, "SPANS", spans)
        got = {(r.session_id, r.request_id): r.status for r in netevents.pair_fifo(df).collect()}
        assert got == replay(rows, None) | {("hot", "x"): None, (None, "y"): None}
    assert netevents.pair_fifo(df.limit(0)).count() == 0


def test_console_and_api_caps(spark):
    rows = [("s", i, ["error", "log", "warning", "runtime_error"][i % 4], "x" * 300) for i in range(60)]
    got = netevents.console(spark.createDataFrame(rows, "session_id string, seq bigint, type string, text string")).collect()
    assert len(got) == 25 and all(len(r.text) == 200 and r.type != "log" for r in got)
    e = events(spark, [("s", str(i), i, "start", i, "https://h/", ["XHR", "image"][i % 2], None, None, None) for i in range(120)])
    assert netevents.api_calls(e).count() == 50


def test_sessions_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randrange(0, 40000)) for _ in range(600)] + [("edge", 0), ("edge", 300), ("edge", 599)]
    want = set()
    by_key = defaultdict(list)
    for k, t in rows:
        by_key[k].append(t)
    for k, ts in by_key.items():
        ts.sort()
        run = [ts[0]]
        for t in ts[1:] + [10**9]:
            if t - run[-1] >= 300:
                want.add((k, at(run[0]), at(run[-1]), len(run)))
                run = []
            run.append(t)
    df = spark.createDataFrame([(k, at(t)) for k, t in rows], "k string, ts timestamp")
    got = {(r.k, r.start_ts.replace(tzinfo=timezone.utc), r.last_ts.replace(tzinfo=timezone.utc), r.events)
           for r in netevents.sessions(df, "k").withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz")).collect()}
    assert got == want and ("edge", at(0), at(0), 1) in want


# ---- rate limits
def test_rate_limit_window(spark):
    rows = [(i, "c", at(i)) for i in range(35)] + [(100, "c", at(600)), (101, "d", at(5))]
    df = spark.createDataFrame(rows, "event_id bigint, client string, ts timestamp")
    got = {r.event_id: r for r in limits.windows(df).collect()}
    assert len(got) == 37 and [got[i].allowed for i in range(35)] == [True] * 30 + [False] * 5
    assert (got[0].remaining, got[29].remaining, got[30].remaining, got[100].remaining) == (29, 0, 0, 29)
    over = limits.offenders(df).collect()
    assert [(r.client, r.requests, r.refused) for r in over] == [("c", 35, 5)]


def test_group_limits_reach_the_plan(spark):
    """First-n operators cut rows before the shuffle, so a hot session cannot flood one task."""
    df = spark.createDataFrame([(1, "c", at(0))], "event_id bigint, client string, ts timestamp")
    t = traces(spark, [("s", 1, at(0), "dns", None, "m", None)])
    for out in (limits.windows(df), trace.sequence(t)):
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


# ---- streams
def test_stream_drops_late_rows_and_matches_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "client string, ts timestamp"

    def feed(rows):
        spark.createDataFrame([(c, at(t)) for c, t in rows], schema).coalesce(1).write.option(
            "timestampFormat", streams.TIME_FORMAT).mode("append").json(folder)

    feed([("c", t) for t in range(0, 40)] + [("c", 3000)])
    source = streams.read(spark, folder, schema, "json", "*.json", per_trigger=1)
    first = streams.run_to_table(streams.rate_limit(source), out)
    assert [(r.client, r.requests, r.refused) for r in first.collect()] == [("c", 40, 10)]
    # the watermark stands at 2400 s: a row of the first window is late, one of the open window is kept
    feed([("c", 10), ("c", 3001), ("c", 9000)])
    second = streams.run_to_table(streams.rate_limit(source), out)
    assert sorted((r.requests, r.refused) for r in second.collect()) == [(2, 0), (40, 10)]


def test_lifecycle_stream_matches_batch(spark, tmp_path):
    rows = []
    for i in range(40):
        rows += [("s", f"r{i}", 3 * i, "start", i * 10, f"https://h/{i}", "xhr", None, None, None), ("s", f"r{i}", 3 * i + 1, "response", i * 10 + 1, None, "xhr", 200 + i, None, None),
                 ("s", f"r{i}", 3 * i + 2, "complete", i * 10 + 2, None, None, None, i, None)]
    rows += [("s", "end", 999, "start", 10000, "https://h/end", "xhr", None, None, None)]
    batch = events(spark, rows)
    folder = str(tmp_path / "in")
    batch.write.option("timestampFormat", streams.TIME_FORMAT).json(folder)
    out = streams.run_to_table(streams.lifecycle(streams.read(spark, folder, netevents.EVENT_TYPE, "json", "*.json")), str(tmp_path / "out"))
    want = netevents.lifecycle(batch).where("request_id <> 'end'").drop("initiator")
    key = ["request_id"]
    assert out.drop("initiator").orderBy(key).collect() == want.orderBy(key).collect()


def test_dynamic_tag_stream(spark, tmp_path):
    batch = events(spark, [("s", "a", 1, "start", 0, "https://h/", "xhr", None, None, None), ("s", "b", 2, "start", 5, "https://h/", "xhr", None, None, None)])
    folder = str(tmp_path / "in")
    batch.write.option("timestampFormat", streams.TIME_FORMAT).json(folder)
    ready = spark.createDataFrame([("s", at(1))], "session_id string, ready_ts timestamp")
    tagged = streams.mark_dynamic(streams.read(spark, folder, netevents.EVENT_TYPE, "json", "*.json"), ready)
    out = streams.run_to_table(tagged.select("request_id", "is_dynamic"), str(tmp_path / "out"))
    assert {r.request_id: r.is_dynamic for r in out.collect()} == {"a": False, "b": True}


# ---- sources and sinks
def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("example.com\nhttp://x\n")
    (tmp_path / "t.csv").write_text("raw_url\nexample.com\n")
    assert [r.raw_url for r in io.read_targets(spark, str(tmp_path / "t.txt")).collect()] == ["example.com", "http://x"]
    assert io.read_targets(spark, str(tmp_path / "t.csv"), "csv").first().raw_url == "example.com"
    hops = spark.createDataFrame([("u", 200, None, None, 5)], io.HOPS)
    io.write_quarantine(hops, str(tmp_path / "q"))
    assert io.read_hops(spark, str(tmp_path / "q")).first().status_code == 200
    io.write_reports(hops, str(tmp_path / "r"))
    assert io.read_hops(spark, str(tmp_path / "r"), "parquet").count() == 1
    rows = [("s", i, at(i), "dns", None, f"m{i}", None) for i in range(3)]
    io.write_trace_text(trace.text_lines(trace.sequence(traces(spark, rows))), str(tmp_path / "x"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "x")).collect()) == [f"+{i}.000s [DNS] m{i}" for i in range(3)]
    stored = io.store(hops)
    assert stored.collect() == hops.collect()
