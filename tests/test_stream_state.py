"""How much the stateful operators say to the JVM: rows of state and calls per group, whatever the number of keys and messages."""

import json
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from crawlsift.streaming import streams


class Handle:
    """State and timers of one group in memory; counts the rows that are written."""

    def __init__(self):
        self.written, self.timers = 0, set()

    def getListState(self, name, schema):  # noqa: N802
        rows = []

        def put(new):
            rows[:] = []
            append(new)

        def append(new):
            self.written += len(new)
            rows.extend(new)

        return SimpleNamespace(exists=lambda: bool(rows), get=lambda: iter(list(rows)), put=put, appendList=append, clear=rows.clear)

    def getValueState(self, name, schema):  # noqa: N802
        held = [None]

        def update(new):
            self.written += 1
            held[0] = new

        return SimpleNamespace(exists=lambda: held[0] is not None, get=lambda: held[0], update=update, clear=lambda: held.__setitem__(0, None))

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


def fed(processor, batches):
    """Published rows of some micro-batches with their watermarks, and the rows of state written."""
    handle, out = Handle(), []
    processor.init(handle)
    for rows, watermark in batches:
        values = SimpleNamespace(getCurrentWatermarkInMs=lambda at=watermark: at)
        if rows is not None:
            for i in range(2):  # a group comes in several frames
                half = rows.iloc[i * len(rows) // 2:(i + 1) * len(rows) // 2]
                if len(half):
                    assert list(processor.handleInputRows((0,), iter([half]), values)) == []
        for ms in sorted(x for x in handle.timers if x <= watermark):
            if ms in handle.timers:
                out += processor.handleExpiredTimer((0,), values, SimpleNamespace(getExpiryTimeInMs=lambda at=ms: at))
                handle.timers.discard(ms)
    return [tuple(r) for x in out for r in x.itertuples(index=False)], handle


def text(*values):
    return json.dumps(values)


@pytest.mark.parametrize("table_rows", [1 << 15, 1000])
def test_requests_of_a_group_are_few_rows_of_state(monkeypatch, table_rows):
    monkeypatch.setattr(streams, "TABLE_ROWS", table_rows)
    kept, rows = 3000, []
    for i in range(kept):
        for seq in (1, 3, 2):  # the newest start wins
            rows.append((text(i), 0, seq, i * 1000, text(i, seq)))
        if i % 2:
            rows.append((text(i), 2, 9, i * 1000 + 500, text(i, "end")))
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame(rows, columns=["ids", "kind", "seq", "us", "body"])
    got, handle = fed(streams.Requests(10_000_000), [(frame, 0), (None, 1000), (None, 10_000 + kept), (None, 1 << 60)])
    assert handle.written < (20 if table_rows > 1000 else 60) and not handle.timers
    assert got[:500] and all(r[3] is not None for r in got[:500])  # at the first watermark only requests that ended
    assert sorted(got, key=repr) == sorted(((text(i), text(i, 3), None, text(i, "end") if i % 2 else None) for i in range(kept)), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_queues_of_a_group_are_few_rows_of_state(seed):
    draw, wait, messages = random.Random(seed), 900, []
    for t in range(4000):
        key, is_call = text(draw.randrange(200)), draw.random() < 0.6
        messages.append((key, t, t * 1000, is_call, f"r{t}", text(t, is_call)))
    columns = ["ids", "seq", "us", "is_call", "request", "body"]
    batches, marks = [[], [], [], []], (1000, 2000, 3000, 1 << 60)
    for m in messages:  # up to a thousand ms late, within what the watermark leaves
        batches[min(3, (m[1] + draw.randrange(990)) // 1000)].append(m)
    got, handle = fed(streams.FifoCalls(wait), [
        (pd.DataFrame(draw.sample(b, len(b)), columns=columns), mark - 1000 if mark < 5000 else mark) for b, mark in zip(batches, marks, strict=True)])
    want, queues = [], {}
    for key, t, _, is_call, _, body in messages:
        queue = queues.setdefault(key, [])
        while queue and queue[0][0] + wait < t:
            want.append((key, queue.pop(0)[1], None))
        if is_call:
            queue.append((t, body))
        elif queue:
            want.append((key, queue.pop(0)[1], body))
    want += [(key, body, None) for key, queue in queues.items() for _, body in queue]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert handle.written < 40 and not handle.timers


def test_first_times_of_a_group_are_few_rows_of_state():
    times = [(f"s{i % 900}", (5000 - i) * 1000 - 1) for i in range(2700)]
    frame = lambda rows: pd.DataFrame(rows, columns=["ids", "us"])
    later = [("s1", 9_000_000), ("new", 9_000_000)]
    got, handle = fed(streams.FirstReady(), [(frame(times), 2400), (None, 6000), (frame(later), 6000), (None, 10_000)])
    want = {}
    for session, us in times + later:
        want[session] = min(us, want.get(session, us))
    assert sorted((s, t.value // 1000) for s, t in got) == sorted(want.items())
    assert handle.written < 20 and not handle.timers
