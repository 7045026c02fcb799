"""Token ids as ORC files in document order."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlsift.llm import common, words
from crawlsift.sources import io

# Settings of the files: small stripes for parallel reads, a row index every 1,000 documents, Bloom filters on ids. Integers are
# written in run-length encoding version 2.
ORC = {
    "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01", "orc.write.format": "0.12", "compression": "zstd"}
COLUMNS = "place bigint, n_tokens bigint, ids array<int>"


# Words of these letters are one token of the tokenizer's first split, so their last piece is the only one with the word's end.
PLAIN = re.compile("[a-zà-öø-ÿ]+")
GAP, LETTER, MARK, LATIN = np.zeros((4, 256), bool)
GAP[[0x20, 0x0A]] = True
LETTER[[x for x in range(128) if chr(x).isalpha()]] = True
# ASCII marks that the first split parts from a letter before them; not the apostrophe, which may stay with letters behind it.
MARK[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'"]] = True
# Second bytes of the letters À to ÿ, whose first is 0xC3.
LATIN[[x.encode()[1] for x in map(chr, range(0xC0, 0x100)) if x.isalpha()]] = True


# Texts are looked at in runs of about so many bytes, whose arrays stay in a core's cache; a longer text is a run of its own.
RUN_BYTES = 1 << 19


class Words:
    """The distinct words that a worker has met, each encoded once.

    The tokenizer lower-cases, drops white space and has no token that spans it, so a text's ids are those of its parts between
    blanks and newlines. Parts are found and hashed in the bytes of many texts at once, with A-Z lower-cased; a part whose hash is
    known takes the ids kept with it, after its bytes were compared with those kept. Only new ones become strings for the
    tokenizer: plain words many at a time, told apart by the pieces that end a word. Marks behind a letter are parts of their own.
    Texts in which lower-casing might make a special token go to the tokenizer whole. The table starts anew beyond `limit` bytes.
    """

    def __init__(self, path: str, limit: int = 24 << 20) -> None:
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        self.hash = np.zeros(0, np.uint64)  # sorted, and for each: its bytes and its ids as (first, number)
        self.place = np.zeros((4, 0), np.int64)
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.int32)

    def make(self, new: list[str]) -> tuple[list[int], list[int], np.ndarray]:
        """Words that are made together come together: their new order, all ids, how many each has."""
        plain = [i for i, x in enumerate(new) if PLAIN.fullmatch(x)]
        other = sorted(set(range(len(new))).difference(plain))
        ids: list[int] = []
        counts = []
        for i in range(0, len(plain), 500):
            part = plain[i:i + 500]
            some = self.tokenizer.encode_batch_fast([" ".join([new[j] for j in part])], add_special_tokens=False)[0].ids
            cuts = np.flatnonzero(self.ends[some])
            if len(cuts) != len(part):
                raise ValueError("this tokenizer doesn't end each word once")
            counts.append(np.diff(cuts, prepend=-1))
            ids += some
        for x in self.tokenizer.encode_batch_fast([new[j] for j in other], add_special_tokens=False):
            some = x.ids
            counts.append(np.array([len(some)]))
            ids += some
        return plain + other, ids, np.concatenate([np.zeros(0, np.int64), *counts])

    def learn(self, value: np.ndarray, found: list[bytes]) -> None:
        """Add words with these hashes, none of them known."""
        order, made, count = self.make([x.decode() for x in found])
        value, found = value[order], [found[i] for i in order]
        size = np.fromiter(map(len, found), np.int64, len(found))
        place = np.stack([len(self.bytes) + np.cumsum(size) - size, size, len(self.ids) + np.cumsum(count) - count, count])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(found), np.uint8)])
        self.ids = np.concatenate([self.ids, np.array(made, np.int32)])
        value, place = np.concatenate([self.hash, value]), np.concatenate([self.place, place], axis=1)
        order = np.argsort(value, kind="stable")
        self.hash, self.place = value[order], place[:, order]

    def encode(self, docs: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id behind each, and the offsets of the texts."""
        done, at = [], 0
        while at < len(docs):
            stop, size = at, 0
            while stop < len(docs) and (stop == at or size + len(docs[stop]) <= RUN_BYTES):
                size += len(docs[stop])
                stop += 1
            done.append(self.run(docs[at:stop]))
            at = stop
        ids, sizes = (np.concatenate([np.zeros(0, x), *(y[i] for y in done)]) for i, x in enumerate((np.int32, np.int64)))
        return common.with_end(ids, sizes, end)

    def run(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if self.hash.nbytes + self.place.nbytes + self.bytes.nbytes + self.ids.nbytes > self.limit:
            self.clear()
        odd = [i for i, x in enumerate(docs) if b"<|" in x]
        whole = {i: self.tokenizer.encode(docs[i].decode(), add_special_tokens=False).ids for i in odd}
        data, begin = words.joined([b"" if i in whole else x for i, x in enumerate(docs)])
        # marks behind a letter are tokens of their own: parted from it, words are known with and without
        close = np.flatnonzero(_mapped(data, MARK))
        close = close[close > 1]
        close = close[LETTER[data[close - 1]] | (data[close - 2] == 0xC3) & LATIN[data[close - 1]]]
        data, start, stop, value, offsets = words.located_in(np.insert(data, close, 0x20), begin + np.searchsorted(close, begin), GAP)
        unique, of = np.unique(value, return_inverse=True)
        lower = _mapped(data, words.LOWER)
        known = np.zeros(len(unique), bool)
        if len(self.hash):
            known = self.hash[np.minimum(np.searchsorted(self.hash, unique), len(self.hash) - 1)] == unique
        if not known.all():
            place = np.empty(len(unique), np.int64)
            place[of] = np.arange(len(of))  # one of the places where each stands
            place = place[~known]
            self.learn(unique[~known], [lower[a:b].tobytes() for a, b in zip(start[place], stop[place], strict=True)])
        begin, size, begun, count = self.place.take(np.searchsorted(self.hash, unique), 1).take(of, 1)
        same = size == stop - start
        same[same] = _equal(lower, start[same], self.bytes, begin[same], size[same])
        ids = self.ids[_spread(begun, count)]
        if not same.all():  # other words of the same hash
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(~same):
                parts[i] = np.array(self.make([lower[start[i]:stop[i]].tobytes().decode()])[1], np.int32)
                count[i] = len(parts[i])
            ids = np.concatenate(parts)
        sizes = np.diff(np.concatenate([[0], np.cumsum(count)])[offsets])
        if whole:
            rows = np.split(ids, np.cumsum(sizes)[:-1])
            for i, x in whole.items():
                rows[i], sizes[i] = np.array(x, np.int32), len(x)
            ids = np.concatenate(rows)
        return ids, sizes


@functools.lru_cache(maxsize=2)
def word_table(path: str) -> Words:
    """A worker's table for a tokenizer, kept from task to task: no larger than its limit."""
    return Words(path)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All places of runs that begin at `first`."""
    before = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(first - before, count)


def _mapped(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What a table of 256 entries of one byte has for each byte."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which runs of bytes are equal; none is empty. Eight bytes are compared at a time."""
    if not len(size):
        return np.zeros(0, bool)
    count = (size + 7) >> 3
    first = np.cumsum(count) - count
    step = (np.arange(count.sum()) - np.repeat(first, count)) << 3
    left = np.minimum(np.repeat(size, count) - step, 8).astype(np.uint64)
    differs = _eights(a)[np.repeat(at, count) + step] ^ _eights(b)[np.repeat(bt, count) + step]
    differs <<= np.uint64(64) - (left << np.uint64(3))  # bytes behind the run's end don't count
    return np.add.reduceat(differs != 0, first) == 0


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write `doc_id`, `place`, `n_tokens` and `ids` of every document as ORC, in ascending order of the id.

    Texts are range-partitioned by id (the one shuffle), then encoded and written by the same task: file names ascend with the
    ids, and `place` counts the ids before a document in its file. Stripes hold run-length encoded integers with row indexes and
    Bloom filters on the id, so readers take stripes in parallel and skip those that can't hold an id. A null text is only the
    end id; null ids come first; rows with equal ids are ordered by the hash of their text. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = word_table(tokenizer), 0
        for whole in batches:
            for batch in common.sliced(whole, 1):
                ids, offsets = table.encode(common.texts(batch.column(1)), end_id)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(total + offsets[:-1]), pa.array(np.diff(offsets)), lists], ["doc_id", "place", "n_tokens", "ids"])
                total += int(offsets[-1])

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, {COLUMNS}"
    order = ["doc_id", F.xxhash64("text")]
    ordered = common.small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, schema).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """`doc_id`, `start`, `n_tokens` and `ids` from the files; a filter on `doc_id` reaches the stripes' statistics and Bloom filters.

    `start`, the number of ids before a document, is its place in the file and the total of the files before, which is summed
    from one narrow column to one row per file.
    """
    rows = spark.read.schema(f"doc_id {id_type}, {COLUMNS}").orc(path).withColumn("file", F.col("_metadata.file_name"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    order = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("file").alias("of"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), F.col("file") == F.col("of")).select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def crc32(ids: pa.Array) -> list[int]:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    values, offsets = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
    return [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]


def checked(rows: DataFrame) -> DataFrame:
    """Read rows with the checksum of their ids instead of the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(3)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), sizes, pa.array(crc32(batch.column(3)), pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint")


def report(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder and read them back: start, length and checksum per document."""
    path = io.shared_dir(docs.sparkSession) + "/ids"
    write(docs, tokenizer, path)
    return checked(read(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString()))
