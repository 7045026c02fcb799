"""Language-model scores of documents: a unigram base and an attention model, both learnt from the corpus.

Both give the chance of the same texts: lower-cased words and an end. The attention model goes through every subword of every word,
of which there are as many as the vocabulary has, however many words the corpus has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm import attention, common, pieces, words
from crawlsift.sources import io

# Counts of so many frequent words are broadcast (1 MB); those of all others are joined.
FREQUENT = 1 << 16
# Words counted in a task before its counts go out.
HELD_WORDS = 1 << 19
# Words whose subwords a task keeps, and up to how many bytes; longer ones are cut into subwords anew, by runs of so many bytes.
HELD_LEADS, LEAD_BYTES, RUN_BYTES = 1 << 19, 64, 1 << 14
# All training documents train the attention weights, in groups of about so many subwords each.
GROUP_TOKENS = 1_000_000
# Weights that a group sends as one row to be averaged.
SENT_WEIGHTS = 1 << 10
COLUMNS = "kind int, doc_id {id}, body bigint, held_out boolean, n bigint, ids binary, keys binary, counts binary"
DOCUMENT, WORD, PIECE = 0, 1, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is no part of the training corpus; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([x for _, x in parts]), len(keys)).astype(np.int64)


class Leads:
    """Subwords of the distinct words that a task has met, by hash; anew beyond `HELD_LEADS` words, so that its memory is bounded.

    A word is cut whole, with A-Z lower-cased, one beyond `RUN_BYTES` by runs of about so many bytes: none of its bytes is left out.
    """

    def __init__(self, model: str) -> None:
        self.model = pieces.chunks(model).model
        self.mark = self.model.piece_to_id(pieces.MARK)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begin, self.size = np.zeros((2, 0), np.int64)

    def _cut(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of words, joined, and how many each has."""
        runs, owner = [], []
        for at, word in enumerate(words):
            i = 0
            while i < len(word):
                j = min(i + RUN_BYTES, len(word))
                while j < len(word) and word[j] & 0xC0 == 0x80:  # a character stays in one run
                    j -= 1
                runs.append(word[i:j].lower().decode())
                owner.append(at)
                i = j
        made = [x or [self.mark] for x in self.model.encode(runs, num_threads=1)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.int32, sizes.sum()), np.bincount(owner, sizes, len(words)).astype(np.int64)

    def spelled(self, value: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All subwords of sorted distinct words, given as hashes and as places in some bytes: joined, and how many each word has."""
        if len(self.keys) > HELD_LEADS:
            self._clear()
        text = lambda which: [data[i:j].tobytes() for i, j in zip(start[which].tolist(), stop[which].tolist(), strict=True)]
        kept = stop - start <= LEAD_BYTES
        new = kept.copy()
        if len(self.keys):
            new &= self.keys[np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)] != value
        if new.any():
            ids, size = self._cut(text(new))
            keys = np.concatenate([self.keys, value[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.size = keys[order], np.concatenate([self.size, size])[order]
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])[order]
            self.ids = np.concatenate([self.ids, ids])
        ids, begin, size = self.ids, *np.zeros((2, len(value)), np.int64)
        at = np.searchsorted(self.keys, value[kept])
        begin[kept], size[kept] = self.begin[at], self.size[at]
        if not kept.all():
            more, size[~kept] = self._cut(text(~kept))
            begin[~kept] = len(ids) + np.cumsum(size[~kept]) - size[~kept]
            ids = np.concatenate([ids, more])
        return gathered(ids, begin, size), size

    def of(self, value: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Leading subwords of sorted distinct words: the first behind the bare mark, or the mark where nothing follows."""
        flat, size = self.spelled(value, data, start, stop)
        begin = np.cumsum(size) - size
        return flat[begin + ((flat[begin] == self.mark) & (size > 1))]


def gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of an array, given by where each begins and how long it is, one behind the other."""
    return flat[np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)]


def prepare(docs: DataFrame, model: str) -> DataFrame:
    """Subwords of every document's words, and counts of words and subwords over the training documents, combined per task; written
    once."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("kind", pa.int32()), ("doc_id", pa.int64()), ("body", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()),
            ("ids", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
        leads, found, size = Leads(model), [], 0
        end, seen = leads.model.eos_id(), np.zeros(leads.model.get_piece_size(), np.int64)

        def counted(which: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                row = {"kind": which, "keys": keys[i:i + (1 << 16)].tobytes(), "counts": counts[i:i + (1 << 16)].tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema)

        for whole in batches:
            schema = schema.set(1, pa.field("doc_id", whole.schema.field(0).type))
            for batch in common.sliced(whole, 3):
                train = ~np.array(batch.column(2).to_pylist(), bool)
                data, start, stop, value, offsets = words.located(common.texts(batch.column(3)))
                distinct, first, back = np.unique(value, return_index=True, return_inverse=True)
                spelled, each = leads.spelled(distinct, data, start[first], stop[first])
                flat = gathered(spelled, (np.cumsum(each) - each)[back], each[back])
                flat, at = common.with_end(flat, np.diff(np.concatenate([[0], np.cumsum(each[back])])[offsets]), end)
                ids = np.split(flat.astype("<u2" if len(seen) <= 65536 else "<u4"), at[1:-1])
                times = np.bincount(back[np.repeat(train, np.diff(offsets))], minlength=len(distinct))
                mine = times > 0
                found.append((distinct[mine], times[mine]))
                size += len(found[-1][0])
                seen += np.bincount(flat[np.repeat(train, np.diff(at))], minlength=len(seen))
                if size > HELD_WORDS:
                    found = [_merge(found)]
                    if (size := len(found[0][0])) > HELD_WORDS // 2:
                        yield from counted(WORD, *found[0])
                        found, size = [], 0
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array([x.tobytes() for x in ids], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
        if found:
            yield from counted(WORD, *_merge(found))
        used = np.flatnonzero(seen)
        yield from counted(PIECE, used.astype(np.uint64), seen[used])

    rows = common.small_batches(docs).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), held_out().alias("held_out"), "text")
    return io.store(rows.mapInArrow(run, COLUMNS.format(id=kind)))


def counts(prepared: DataFrame, which: int) -> DataFrame:
    """`key` and `c`: how often each word (by hash) or subword stands in the training documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["key", "c"])

    rows = prepared.where(F.col("kind") == which).select("keys", "counts").mapInArrow(run, "key bigint, c bigint")
    return rows.groupBy("key").agg(F.sum("c").alias("c"))


def _ids(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if size <= 65536 else "<u4")


def _before(kind: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Class before each subword of some joined texts."""
    out = np.empty(len(flat), np.int64)
    out[1:] = kind[flat[:-1]]
    out[np.cumsum(sizes) - sizes] = attention.START
    return out


def pairs(prepared: DataFrame, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before, subword and how often they stand so in the training documents: at most classes x vocabulary rows."""
    held, size = prepared.sparkSession.sparkContext.broadcast(kind), len(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, seen = held.value, np.zeros((attention.CLASSES + 1) * size, np.int64)
        for whole in batches:
            for batch in common.sliced(whole, 0):
                ids = [_ids(x, size) for x in batch.column(0).to_pylist()]
                flat = np.concatenate(ids)
                np.add.at(seen, _before(kind, flat, np.array([len(x) for x in ids])) * size + flat, 1)
        used = np.flatnonzero(seen)
        for i in range(0, len(used), 1 << 16):
            key = used[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(seen[key])], ["key", "c"])

    rows = prepared.where((F.col("kind") == DOCUMENT) & ~F.col("held_out")).select("ids").mapInArrow(run, "key bigint, c bigint")
    found = rows.groupBy("key").agg(F.sum("c").alias("c")).toPandas()
    key = found["key"].to_numpy(np.int64)
    return key // size, key % size, found["c"].to_numpy(np.int64)


def dealt(prepared: DataFrame, kind: np.ndarray | None = None) -> DataFrame:
    """`group` and `ids` of every training document; given each subword's class, classes of a byte each instead of ids.

    Rows are dealt by a salted key of their own, not by their text: copies of a text spread over all groups, so that each has
    the text's share of the corpus and none holds much more than `GROUP_TOKENS` subwords, but for a longer text.
    """
    rows = prepared.where((F.col("kind") == DOCUMENT) & ~F.col("held_out"))
    total = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    groups = max(1, math.ceil(total / 2 / GROUP_TOKENS))
    group = F.pmod(F.xxhash64("doc_id", "body", F.monotonically_increasing_id()), F.lit(groups))
    rows = rows.select(group.alias("group"), "ids")
    if kind is not None:
        held, size = prepared.sparkSession.sparkContext.broadcast(kind.astype(np.uint8)), len(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in common.sliced(whole, 1):
                    short = [held.value[_ids(x, size)].tobytes() for x in batch.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["group", "ids"])

        rows = rows.mapInArrow(run, "group bigint, ids binary")
    return rows.repartition(groups, "group")


def fit(prepared: DataFrame, pieces_seen: np.ndarray, marked: np.ndarray, end: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Attention weights, each subword's class, and log share of each subword in its class after each class.

    Classes, shares and the bias that training starts from come from the counts of the whole training corpus. Every training
    document trains: they are dealt to groups whose number grows with the corpus, each group starts from the same weights and
    trains in one task, and the weights are averaged by Spark. Without training documents the counts alone are the model.
    """
    kind = attention.classes(pieces_seen, marked, end)
    chance, share = attention.shares(pieces_seen, kind, pairs(prepared, kind))
    model = attention.start(chance)

    def run(table: pa.Table) -> pa.Table:
        common.keep_freed()
        docs = [np.frombuffer(x, np.uint8).astype(np.int16) for x in table.column("ids").to_pylist()]
        docs.sort(key=lambda x: x.tobytes())
        vector = attention.pack(attention.train(model, docs))
        common.trim()
        cuts = range(0, len(vector), SENT_WEIGHTS)
        return pa.table({"at": pa.array(cuts, pa.int32()), "weights": pa.array([vector[i:i + SENT_WEIGHTS].tobytes() for i in cuts], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = {}, {}
        for batch in batches:
            for at, part in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n[at] = n.get(at, 0) + 1
                total[at] = total.get(at, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(n.keys(), pa.int32()), pa.array(n.values(), pa.int64()), pa.array(total.values(), pa.list_(pa.float64()))], ["at", "n", "total"])

    trained = dealt(prepared, kind).groupBy("group").applyInArrow(run, "at int, weights binary")
    n, total = 0, np.zeros(len(attention.pack(model)))
    for r in trained.repartition("at").mapInArrow(add, "at int, n bigint, total array<double>").collect():
        n += r["n"] * (r["at"] == 0)
        total[r["at"]:r["at"] + len(r["total"])] += r["total"]
    return attention.unpack(total / n, model) if n else model, kind, share


def attention_scores(prepared: DataFrame, model: dict[str, np.ndarray], kind: np.ndarray, share: np.ndarray) -> DataFrame:
    """`doc_id`, `body` and `score`, the log10 probability of all subwords of the text's words and of its end."""
    held = prepared.sparkSession.sparkContext.broadcast((model, kind, share))
    size = len(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kind, share = held.value
        common.keep_freed()
        for whole in batches:
            for batch in common.sliced(whole, 2):
                ids = [_ids(x, size) for x in batch.column(2).to_pylist()]
                sizes = np.array([len(x) for x in ids])
                flat = np.concatenate(ids)
                inside = np.add.reduceat(share[_before(kind, flat, sizes), flat], np.cumsum(sizes) - sizes, dtype=np.float64)
                got = attention.score(model, kind[flat], sizes) + inside
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["doc_id", "body", "score"])

    rows = prepared.where(F.col("kind") == DOCUMENT).select("doc_id", "body", "ids")
    return rows.mapInArrow(run, f"doc_id {prepared.schema['doc_id'].dataType.simpleString()}, body bigint, score double")


def base_scores(docs: DataFrame, seen: DataFrame, train_docs: int) -> DataFrame:
    """Per row: `uid`, `doc_id`, `body`, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`.

    Counts of frequent words are looked up in each task; a document's distinct other words are joined to their counts by
    hash. None of those is frequent, so no key of the join is hot.
    """
    spark = docs.sparkSession
    total, distinct = seen.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (total or 0) + train_docs, distinct + (train_docs > 0)
    below = float(np.log10(total + 0.1 * (distinct + 1)))
    top = seen.orderBy(F.desc("c"), "key").limit(FREQUENT).toPandas().sort_values("key")
    held = spark.sparkContext.broadcast((top["key"].to_numpy(np.int64), top["c"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, c = held.value
        task, row = TaskContext.get().partitionId() << 40, 0
        for whole in batches:
            for batch in common.sliced(whole, 3):
                value, offsets = words.hashed(common.texts(batch.column(3)))
                n = batch.num_rows
                value, doc = value.astype(np.int64), np.repeat(np.arange(n), np.diff(offsets))
                at = np.minimum(np.searchsorted(keys, value), max(len(keys) - 1, 0))
                known = keys[at] == value if len(keys) else np.zeros(len(value), bool)
                logs = np.bincount(doc[known], np.log10(c[at[known]] + 0.1), n) + np.log10(train_docs + 0.1)
                rare, of = value[~known], doc[~known]
                order = np.lexsort((rare, of))
                rare, of = rare[order], of[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (of[1:] != of[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rare))).astype(np.int32)
                cuts = np.searchsorted(of[first], np.arange(n + 1))
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([
                    pa.array(task + row + np.arange(n)), batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets) + 1),
                    pa.array(np.bincount(doc[known], minlength=n) + (train_docs > 0)), pa.array(logs), lists(rare[first], pa.int64()), lists(times, pa.int32())],
                    ["uid", "doc_id", "body", "held_out", "n_tokens", "known", "logs", "rare", "times"])
                row += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), held_out().alias("held_out"), "text")
    part = io.store(rows.mapInArrow(run, (
        f"uid bigint, doc_id {kind}, body bigint, held_out boolean, n_tokens bigint, known bigint, logs double, rare array<bigint>, times array<int>")))
    each = part.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("tf"))
    joined = each.join(seen, F.col("word") == F.col("key"), "left")
    sums = joined.groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more"),
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("rest")).withColumnRenamed("uid", "of")
    out = part.drop("rare", "times").join(sums, F.col("uid") == F.col("of"), "left")
    return out.select(
        "uid", "doc_id", "body", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(below)).alias("base_score"))


def report(docs: DataFrame, model: str) -> DataFrame:
    """Base and attention score of every whole text.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, known by 64-bit hash, and an end that counts as one. The score is the chance
    of every subword of every word and of the end, by attention and counts. It pays for the spelling of unseen words, which the base
    takes for one word more. Null texts are empty: only the end. Null ids are held out. Repeated rows are scored each and counted
    each. With no training documents the base is 0 for every text and the model knows shares alone; an empty table gives no rows;
    other columns are ignored.
    """
    table = pieces.chunks(model)
    prepared = prepare(docs, model)
    size = table.model.get_piece_size()
    marked = np.array([table.model.id_to_piece(i).startswith(pieces.MARK) for i in range(size)], np.int64)
    found = counts(prepared, PIECE).toPandas()
    seen = np.bincount(found["key"].to_numpy(np.int64), found["c"].to_numpy(np.int64), size)
    train_docs = prepared.where((F.col("kind") == DOCUMENT) & ~F.col("held_out")).count()
    base = base_scores(docs, io.store(counts(prepared, WORD)), train_docs)
    scored = attention_scores(prepared, *fit(prepared, seen, marked, table.model.eos_id()))
    scored = scored.groupBy("doc_id", "body").agg(F.first("score").alias("score")).toDF("__id", "__body", "score")
    return base.join(scored, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("body") == F.col("__body"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
