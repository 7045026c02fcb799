"""Structured Streaming forms of the event operators. All of them append and drop state by watermark.

A stream that has come to its end is closed by an end mark (`close`): a row later than all others, which moves the watermark past
every window, session and timer that is still open and takes no part itself.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from crawlsift.operators import limits, netevents
from crawlsift.sources.io import shared_dir, store

# Rows from this time on are end marks.
END = "9000-01-01 00:00:00"

# Late events up to this delay are kept.
DELAY = "10 minutes"
# Recorded messages keep microseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """Stream of files with a fixed schema; JSON for recorded messages, Parquet for tables."""
    return (
        spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", per_trigger).option("timestampFormat", TIME_FORMAT).load(folder))


def only(cond: str, ts: str = "ts") -> str:
    """A condition on messages that lets end marks through to the watermark."""
    return f"({cond}) OR {ts} >= TIMESTAMP '{END}'"


def watched(events: DataFrame, delay: str = DELAY, ts: str = "ts") -> DataFrame:
    """Set the watermark, and keep end marks out of what follows. The filter reads the event time, so it stays behind the watermark."""
    return events.withWatermark(ts, delay).where(F.col(ts) < F.lit(END).cast("timestamp"))


# The stateful operators keep their keys in so many groups by a hash: state goes to Python and back once per group and micro-batch.
GROUPS = 256
# Rows of one table of a group's list.
TABLE_ROWS = 1 << 15
KINDS = {"start": 0, "response": 1, "complete": 2, "failed": 2}
STARTED = (
    "ts bigint, url string, method string, type string, initiator struct<type:string,frames:array<struct<url:string,line:int>>>")
ANSWERED = "status int, type string"
FINISHED = "ts bigint, action string, bytes bigint, canceled boolean"
CALL, ANSWER = "seq bigint, request_id string, method string", "seq bigint, status int"
IDS, QUEUE = "session_id string, request_id string", "session_id string, url string"


class Grouped(StatefulProcessor):
    """Rows of all keys of one hash group as Arrow tables in a list, and one timer for the first that is due.

    What arrives in a micro-batch is added to the list as one more table, and a timer that fires takes the list as a whole: per
    group and micro-batch a handful of calls between Python and the JVM, whatever the number of keys and rows. `due` says when a
    table wants to be looked at, `settle` what of it is published and what stays.
    """

    COLUMNS: dict[str, pa.DataType] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.timer = handle.getValueState("timer", "ms bigint")

    def arrived(self, rows: pd.DataFrame) -> pd.DataFrame:
        """New rows as they are kept."""
        raise NotImplementedError

    def due(self, rows: pd.DataFrame) -> pd.Series:
        """When each row is due, no later than with other tables beside it, in milliseconds."""
        raise NotImplementedError

    def settle(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What is published and what is kept at a watermark; older rows come first."""
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = self.arrived(pd.concat(list(rows), ignore_index=True))
        if len(new):
            self.held.appendList(self._packed(new))
            held, due = self.timer.get(), int(self.due(new).min())
            if held is None or due < held[0]:
                if held is not None:
                    self.handle.deleteTimer(held[0])
                self._wait(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        tables = [pa.ipc.open_stream(x[0]).read_all() for x in self.held.get()]
        out, kept = self.settle(pa.concat_tables(tables).to_pandas(), now)
        self.held.clear()
        self.timer.clear()
        if len(kept):
            self.held.put(self._packed(kept))
            if (due := int(self.due(kept).min())) < NEVER:
                self._wait(max(due, now + 1))
        if len(out):
            yield out

    def _wait(self, due: int) -> None:
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def _packed(self, rows: pd.DataFrame) -> list[tuple[bytes]]:
        table, out = pa.table({k: pa.array(rows[k], kind, from_pandas=True) for k, kind in self.COLUMNS.items()}), []
        for i in range(0, table.num_rows, TABLE_ROWS):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(table.slice(i, TABLE_ROWS))
            out.append((sink.getvalue().to_pybytes(),))
        return out


# A row that waits for nothing.
NEVER = (1 << 63) - 1


class Requests(Grouped):
    """Open requests with the newest start, response and end message of each; published when the request is over.

    A request is over when the watermark passes its end message, so that earlier messages that come late are still heard, or
    `idle_ms` after its last message if no end came. A row is a message: `kind` is its place in the output, -1 for none, `last` the
    time of the request's last message as far as it is known here.
    """

    COLUMNS = {"ids": pa.string(), "kind": pa.int8(), "seq": pa.int64(), "ms": pa.int64(), "last": pa.int64(), "body": pa.string()}

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def arrived(self, rows: pd.DataFrame) -> pd.DataFrame:
        ms = -(-rows["us"].to_numpy(np.int64) // 1000)
        return self.newest(rows[["ids", "kind", "seq", "body"]].assign(ms=ms, last=ms))

    @staticmethod
    def newest(rows: pd.DataFrame) -> pd.DataFrame:
        """One row per request and kind: the highest `seq`, of equal ones the first."""
        code = pd.factorize(rows["ids"])[0]
        last = np.full(code.max() + 1, np.iinfo(np.int64).min)
        np.maximum.at(last, code, rows["last"].to_numpy())
        kind, seq = rows["kind"].to_numpy(), rows["seq"].to_numpy()
        order = np.lexsort((np.arange(len(rows)), ~seq, kind, code))
        first = np.ones(len(rows), bool)
        first[1:] = (np.diff(code[order]) != 0) | (np.diff(kind[order]) != 0)
        order = order[first]
        return rows.iloc[order].assign(last=last[code[order]])

    def due(self, rows: pd.DataFrame) -> pd.Series:
        return rows["ms"].where(rows["kind"] == 2, rows["last"] + self.idle_ms)

    def settle(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        rows = self.newest(rows)
        # the end message is a request's last row and says when it is over
        code, kind = pd.factorize(rows["ids"])[0], rows["kind"].to_numpy()
        over = np.zeros(code.max() + 1, np.int64)
        over[code] = self.due(rows)
        done = over[code] <= now
        out = pd.DataFrame({"ids": rows["ids"].to_numpy()[done & np.append(True, np.diff(code) != 0)]})
        place = np.cumsum(np.append(True, np.diff(code[done]) != 0)) - 1 if done.any() else code[done]
        for i, name in enumerate(("started", "answered", "finished")):
            found, mine = np.full(len(out), None, object), kind[done] == i
            found[place[mine]] = rows["body"].to_numpy(object)[done][mine]
            out[name] = found
        return out, rows[~done]


class FifoCalls(Grouped):
    """One queue per session and URL: responses answer the oldest open call, in the order of `seq` whatever the order of arrival.

    Messages wait until the watermark has passed them. Calls then join the queue, responses take its head or are lost if it is
    empty; a call that nothing answers for `wait_ms` is evicted unanswered. `queued` rows are open calls in their order; `until` is
    when a row is looked at: with the last message of its key and micro-batch, or when a queue's head has waited long enough.
    """

    COLUMNS = {
        "ids": pa.string(), "queued": pa.bool_(), "seq": pa.int64(), "ms": pa.int64(), "until": pa.int64(), "is_call": pa.bool_(),
        "request": pa.string(), "body": pa.string()}

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def arrived(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(ms=-(-rows["us"].to_numpy(np.int64) // 1000), queued=False)
        return rows.assign(until=rows.groupby("ids")["ms"].transform("max"))

    def due(self, rows: pd.DataFrame) -> pd.Series:
        return rows["until"]

    def settle(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        code = pd.factorize(rows["ids"])[0]
        awake = np.zeros(code.max() + 1, bool)
        awake[code[rows["until"].to_numpy() <= now]] = True
        at = np.flatnonzero(awake[code] & (rows["queued"].to_numpy() | (rows["ms"].to_numpy() <= now)))
        ids, queued, seq, ms, is_call, request, body = (
            rows[x].iloc[at].to_list() for x in ("ids", "queued", "seq", "ms", "is_call", "request", "body"))
        code = code[at].tolist()
        order = sorted(range(len(at)), key=lambda i: (
            (code[i], 0, i, False, "") if queued[i] else (code[i], 1, seq[i], not is_call[i], request[i] or "")))
        out, left, heads = [], [], []
        for _, mine in groupby(order, code.__getitem__):
            queue: deque[int] = deque()
            for i in mine:
                if queued[i]:
                    queue.append(i)
                    continue
                while queue and ms[queue[0]] + self.wait_ms < ms[i]:
                    out.append((queue.popleft(), None))
                if is_call[i]:
                    queue.append(i)
                elif queue:
                    out.append((queue.popleft(), i))
            while queue and ms[queue[0]] + self.wait_ms <= now:
                out.append((queue.popleft(), None))
            left += queue
            heads += [n == 0 for n in range(len(queue))]
        open_calls = rows.iloc[at[left]] if left else rows.iloc[:0]
        until = np.where(heads, open_calls["ms"] + self.wait_ms, NEVER)
        waiting = np.ones(len(rows), bool)
        waiting[at] = False
        kept = pd.concat([open_calls.assign(queued=True, until=until.astype(np.int64)), rows[waiting]])
        return pd.DataFrame({
            "ids": [ids[i] for i, _ in out], "call": [body[i] for i, _ in out],
            "answer": [None if j is None else body[j] for _, j in out]}, dtype=object), kept


class FirstReady(Grouped):
    """The first of a session's times, published once the watermark rules out an earlier one; a session stays known from then on."""

    COLUMNS = {"ids": pa.string(), "us": pa.int64(), "done": pa.bool_()}

    def arrived(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.groupby("ids", as_index=False)["us"].min().assign(done=False)

    def due(self, rows: pd.DataFrame) -> pd.Series:
        return (-(-rows["us"] // 1000)).mask(rows["done"], NEVER)

    def settle(self, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        # published times come before all others of their session
        rows = rows.sort_values(["done", "us"], ascending=[False, True], kind="stable").drop_duplicates("ids")
        ready = ~rows["done"] & (-(-rows["us"] // 1000) <= now)
        times = pd.to_datetime(rows.loc[ready, "us"], unit="us", utc=True)
        return pd.DataFrame({"ready_session": rows.loc[ready, "ids"], "ready_ts": times}), rows.assign(done=rows["done"] | ready)


def stateful(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, event_time: str = "", groups: int = GROUPS) -> DataFrame:
    """Apply a processor of hash groups with event-time timers to rows with their `keys`; its state is kept in RocksDB."""
    rows.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")
    return rows.withColumn("group", group).groupBy("group").transformWithStateInPandas(
        processor, schema, "append", "eventTime", eventTimeColumnName=event_time)


def lifecycle(events: DataFrame, idle_hours: int = 100, delay: str = DELAY, groups: int = GROUPS) -> DataFrame:
    """Requests merged from their messages, each published when it is over (see `Requests`).

    The latest message of a kind wins, by `seq`. Messages of one request that come after it was published start a row of their own.
    Ids and contents pass through the state as JSON, which Spark writes and reads.
    """
    kind = "CASE WHEN seq IS NULL THEN -1 " + " ".join(f"WHEN action = '{x}' THEN {i}" for x, i in KINDS.items()) + " ELSE -1 END"
    rows = watched(events, delay).selectExpr(
        "ts", "unix_micros(ts) AS us", "to_json(named_struct('session_id', session_id, 'request_id', request_id)) AS ids",
        f"CAST({kind} AS tinyint) AS kind", "coalesce(seq, 0) AS seq",
        "CASE WHEN action = 'start' THEN to_json(named_struct('ts', unix_micros(ts), 'url', url, 'method', method, 'type',"
        " lower(resource_type), 'initiator', initiator))"
        " WHEN action = 'response' THEN to_json(named_struct('status', status, 'type', lower(resource_type)))"
        " WHEN action IN ('complete', 'failed') THEN"
        " to_json(named_struct('ts', unix_micros(ts), 'action', action, 'bytes', bytes, 'canceled', canceled)) END AS body")
    done = stateful(
        rows, ["ids"], Requests(idle_hours * 3_600_000), "ids string, started string, answered string, finished string", groups=groups)
    merged = done.selectExpr(
        f"from_json(ids, '{IDS}') AS ids", f"from_json(started, '{STARTED}') AS started", f"from_json(answered, '{ANSWERED}') AS answered",
        f"from_json(finished, '{FINISHED}') AS finished")
    times = {x: F.col(x).withField("ts", F.timestamp_micros(f"{x}.ts")) for x in ("started", "finished")}
    return netevents.shape(merged.withColumns(times).select("ids.*", "started", "answered", "finished"), "session_id", "request_id")


def pair_fifo(events: DataFrame, wait_hours: int = 1000, delay: str = DELAY, groups: int = GROUPS) -> DataFrame:
    """Calls with the status of their response as `netevents.pair_fifo` gives them; a call left alone for `wait_hours` is unanswered.

    Messages of one session and URL share a queue and are replayed in one task; a call that has neither forms a queue with others
    like it, whose responses are unknown, so it stays unanswered.
    """
    wanted = only(
        "lower(resource_type) IN ('xhr', 'fetch') AND (action = 'start' OR action = 'response' AND session_id IS NOT NULL AND url IS NOT NULL)")
    rows = watched(events.where(wanted), delay).selectExpr(
        "ts", "unix_micros(ts) AS us", "to_json(named_struct('session_id', session_id, 'url', url)) AS ids",
        "coalesce(seq, -9223372036854775807L) AS seq", "action = 'start' AS is_call", "request_id AS request",
        "CASE WHEN action = 'start' THEN to_json(named_struct('seq', seq, 'request_id', request_id, 'method', method))"
        " ELSE to_json(named_struct('seq', seq, 'status', status)) END AS body")
    done = stateful(rows, ["ids"], FifoCalls(wait_hours * 3_600_000), "ids string, call string, answer string", groups=groups)
    return done.selectExpr(
        f"from_json(ids, '{QUEUE}') AS ids", f"from_json(call, '{CALL}') AS call", f"from_json(answer, '{ANSWER}') AS answer").selectExpr(
        "ids.session_id", "call.seq", "call.request_id", "ids.url", "call.method", "answer.status", "answer.seq AS answer_seq")


def dynamic_requests(
        starts: DataFrame, messages: DataFrame, horizon: str = "60 days", delay: str = DELAY, groups: int = GROUPS) -> DataFrame:
    """Stream-stream form of the dynamic-only tag: start messages joined to when their session's document was ready.

    Both sides are watermarked. A start waits until no earlier ready time can come; without one in the `horizon` before it, it
    is not dynamic (the outer result).
    """
    docs = messages.where(only("action = 'complete' AND lower(resource_type) = 'document'"))
    seen = watched(docs, delay).where("session_id IS NOT NULL").selectExpr("ts", "unix_micros(ts) AS us", "session_id AS ids")
    ready = stateful(seen, ["ids"], FirstReady(), "ready_session string, ready_ts timestamp", "ready_ts", groups)
    begun = watched(starts.where(only("action = 'start'")), delay)
    return begun.join(ready, F.expr(
        f"session_id = ready_session AND ready_ts < ts - INTERVAL 1 SECOND AND ready_ts >= ts - INTERVAL {horizon}"), "left").selectExpr(
        "session_id", "request_id", "ready_ts IS NOT NULL AS is_dynamic")


def status_mix(responses: DataFrame, width: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Responses per interval and status band from response messages, which carry the status."""
    band = netevents.status_band("CAST(status AS string)", "status")
    return watched(responses.where(only("action = 'response'")), delay).groupBy(
        F.window("ts", width).alias("w"), F.expr(band).alias("band")).agg(F.count("*").alias("responses")).select(
        F.col("w.start").alias("window_start"), "band", "responses")


def sessions(events: DataFrame, key: str, gap: str = "5 minutes", delay: str = DELAY) -> DataFrame:
    """Inactivity sessions per key."""
    return watched(events, delay).groupBy(key, F.session_window("ts", gap).alias("s")).agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).select(
        key, "start_ts", "last_ts", "events")


def rate_limit(events: DataFrame, max_requests: int = limits.MAX_REQUESTS, width: str = limits.WINDOW, delay: str = DELAY) -> DataFrame:
    """Requests per client and window with the number over the limit; late rows beyond the watermark are dropped."""
    return watched(events, delay).groupBy("client", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("requests")).select(
        "client", F.col("w.start").alias("window_start"), "requests",
        F.greatest(F.lit(0), F.col("requests") - max_requests).alias("refused"))


def mark_dynamic(starts: DataFrame, ready: DataFrame, delay: str = DELAY) -> DataFrame:
    """Stream-static form of the dynamic-only tag over start messages."""
    return watched(starts.where(only("action = 'start'")), delay).join(ready, "session_id", "left").withColumn(
        "is_dynamic", F.expr("coalesce(ts > ready_ts + INTERVAL 1 SECOND, false)"))


def close(spark: SparkSession, folder: str, schema: str, ts: str = "ts") -> None:
    """Add an end mark to a folder of JSON messages: what is open is published by the next run. Later messages are late."""
    marks = spark.sql(f"SELECT TIMESTAMP '{END}' AS {ts}").select(*[
        F.col(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])
    marks.select(ts).write.mode("append").option("timestampFormat", TIME_FORMAT).json(folder)


def replay(messages: DataFrame, build: Callable[[DataFrame], DataFrame], slices: int = 2, jitter_s: int = 480, order: str = "seq") -> DataFrame:
    """Feed recorded messages to a stream as they came: slice after slice of time, each run from the checkpoint of the one before.

    `jitter_s` seconds at most, by a hash of the row, let messages arrive after later ones, within the watermark's delay. An end mark closes the stream.
    """
    spark, schema = messages.sparkSession, messages.schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    folder, out = shared_dir(spark) + "/messages", shared_dir(spark)
    low, high = messages.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    arrival = F.unix_micros("ts") + F.pmod(F.xxhash64(order, "ts"), F.lit(jitter_s * 1_000_000 + 1))
    width = ((high or 0) + jitter_s * 1_000_000 - (low or 0)) // slices + 1
    kept = store(messages.withColumn("slice", F.floor((arrival - F.lit(low or 0)) / width).cast("int")))
    for i in range(slices):
        kept.where(F.col("slice") == i).drop("slice").write.mode("append").option("timestampFormat", TIME_FORMAT).json(folder)
        if i + 1 == slices:
            close(spark, folder, ddl)
        found = run_to_table(build(read(spark, folder, ddl, "json", "*.json")), out)
    return found


def run_to_table(stream: DataFrame, out: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table in the shared folder and read it back."""
    spark = stream.sparkSession
    folder = out or shared_dir(spark)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start(f"{folder}/rows"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
