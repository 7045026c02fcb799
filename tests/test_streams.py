"""Stateful streams fed in several runs, with late and out-of-order messages, against the batch operators."""

import random

import pytest

from crawlsift.operators import netevents
from crawlsift.streaming import streams
from tests.test_events import at, events


def feed(df, folder):
    df.write.mode("append").option("timestampFormat", streams.TIME_FORMAT).json(folder)


def source(spark, folder):
    return streams.read(spark, folder, netevents.EVENT_TYPE, "json", "*.json")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def messages(spark):
    draw, rows = random.Random(1), []
    for i in range(60):
        t, url, kind = draw.randrange(0, 7200), f"https://h/{draw.randrange(3)}", draw.choice(["xhr", "fetch", "Document", "script"])
        session, lag = f"s{i % 4}", draw.randrange(1, 3000)
        parts = [("start", t), ("response", t + lag), (draw.choice(["complete", "failed"]), t + lag + 5)]
        for step, (action, when) in enumerate(parts):
            if draw.random() < 0.85:
                rows.append((session, f"r{i}", when * 10 + step, action, when, url, kind, 200 + i if action == "response" else None, i, None))
    return events(spark, rows)


@pytest.mark.parametrize("slices", [1, 3])
def test_replayed_streams_equal_batch(messages, slices):
    assert rows_of(streams.replay(messages, streams.lifecycle, slices)) == rows_of(netevents.lifecycle(messages))
    assert rows_of(streams.replay(messages, streams.pair_fifo, slices)) == rows_of(netevents.pair_fifo(messages))
    requests = netevents.lifecycle(messages)
    want = netevents.mark_dynamic(requests, netevents.ready_times(messages)).where("start_ts IS NOT NULL").select("session_id", "request_id", "is_dynamic")
    assert rows_of(streams.replay(messages, lambda s: streams.dynamic_requests(s, s), slices)) == rows_of(want)


def test_request_closes_on_its_end_and_hears_late_messages(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*rows):
        feed(events(spark, list(rows)), folder)
        return {r.request_id: (r.status, r.duration_ms) for r in streams.run_to_table(streams.lifecycle(source(spark, folder), 1), out).collect()}

    # the end came before the response: not published yet, the watermark has not passed it
    assert run(("s", "a", 1, "start", 0, "https://h/", "xhr", None, None, None), ("s", "a", 3, "complete", 20, None, None, None, 7, None),
               ("s", "slow", 4, "start", 30, "https://h/", "xhr", None, None, None)) == {}
    assert run(("s", "a", 2, "response", 10, None, "xhr", 404, None, None)) == {}
    # ten minutes on, the request is over and published once; the other one is still open
    assert run(("s", "other", 9, "start", 700, "https://h/", "xhr", None, None, None)) == {"a": ("404", 20000)}
    # an hour without a message ends a request that never did
    found = run(("s", "last", 10, "start", 5000, "https://h/", "xhr", None, None, None))
    assert found == {"a": ("404", 20000), "slow": ("Pending", None), "other": ("Pending", None)}
    streams.close(spark, folder, netevents.EVENT_TYPE)
    assert streams.run_to_table(streams.lifecycle(source(spark, folder), 1), out).count() == 4


def test_fifo_stream_waits_matches_and_evicts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(*rows):
        feed(events(spark, list(rows)), folder)
        return sorted((r.request_id, r.status) for r in streams.run_to_table(streams.pair_fifo(source(spark, folder), 1), out).collect())

    call = lambda i, t, url="https://h/": ("s", f"c{i}", t, "start", t, url, "xhr", None, None, None)
    answer = lambda t, status: ("s", "x", t, "response", t, "https://h/", "xhr", status, None, None)
    # the second call and both responses come before the first call
    assert run(call(2, 20), answer(30, 201), answer(40, 202), answer(5, 200)) == []
    assert run(call(1, 10)) == []
    assert run(call(3, 1000)) == [("c1", 201), ("c2", 202)]  # the response at 5 met no open call
    assert run(call(4, 6000)) == [("c1", 201), ("c2", 202), ("c3", None)]  # c3 was evicted after an hour
    streams.close(spark, folder, netevents.EVENT_TYPE)
    assert len(streams.run_to_table(streams.pair_fifo(source(spark, folder), 1), out).collect()) == 4


def test_windows_open_at_the_end_are_published(spark):
    rows = spark.createDataFrame([("c", at(t), t) for t in (0, 10, 700, 4000, 4001)], "client string, ts timestamp, id bigint")
    got = streams.replay(rows, lambda s: streams.rate_limit(s, 1, "1 hour"), order="id")
    assert sorted((r.requests, r.refused) for r in got.collect()) == [(2, 1), (3, 2)]
    got = streams.replay(rows, lambda s: streams.sessions(s, "client"), order="id")
    assert sorted(r.events for r in got.collect()) == [1, 2, 2]
    empty = streams.replay(rows.limit(0), lambda s: streams.rate_limit(s, 1, "1 hour"), order="id")
    assert empty.collect() == []
