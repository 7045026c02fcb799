"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Texts are worked on in slices of about so many bytes, so that a task's memory doesn't follow the size of an Arrow batch.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that `df` does not have in any spelling: `name`, with underscores before it where that is taken."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small_batches(df: DataFrame) -> DataFrame:
    """Let Arrow batches hold a thousand rows where the session has Spark's default of ten thousand: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


@functools.cache
def _libc() -> ctypes.CDLL | None:
    try:
        found = ctypes.CDLL("libc.so.6")
        found.malloc_trim, found.mallopt  # noqa: B018
    except (OSError, AttributeError):
        return None
    return found


def trim() -> None:
    """Give freed memory back to the system: workers live on after their task, and what they keep adds up over an executor."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def keep_freed() -> None:
    """Let freed memory stay with the process until `trim`: a task that makes arrays of the same sizes again and again otherwise
    spends more time on page faults than on its work."""
    if libc := _libc():
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def sliced(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `SLICE_BYTES` of text; a longer text is a run of its own. Trims memory behind each batch."""
    sizes = [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()]
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)
    trim()


def sha256(data: bytes) -> str:
    """Lowercase hex digest."""
    return hashlib.sha256(data).hexdigest()


def fold(doc_id: object, folds: int) -> int:
    """crc32 of the id as text, modulo the number of folds; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


class _Numbers(dict):
    """Numbers for keys in order of their first use."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number


class IdTable:
    """The ids of the distinct strings that a task has met, each made once; anew beyond `limit` bytes, so that its memory is bounded."""

    # What an entry takes beside its characters: string, dictionary slot, three numbers.
    ENTRY = 180

    def __init__(self, make: Callable[[list[str]], list[list[int]]], limit: int = 24 << 20) -> None:
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        """Forget all strings."""
        self.number = _Numbers()
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.bytes = 0

    def rows(self, split: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings of all rows, in order, and how many each row has."""
        if self.bytes > self.limit:
            self.clear()
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, lengths.sum())
        if new := self.number.new:
            self.bytes += self.ENTRY * len(new) + sum(map(len, new))
            made = self.make(new)
            size = np.fromiter(map(len, made), np.int64, len(made))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(made), np.int32, size.sum())])
            self.number.new = []
        size = self.size[at]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.arange(before[-1]) + np.repeat(self.start[at] - before[:-1], size)]
        return ids, np.diff(before[np.concatenate([[0], np.cumsum(lengths)])])


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each with one more id, as ids and offsets."""
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(offsets[-1], end, np.int32)
    inner = np.ones(len(out), bool)
    inner[offsets[1:] - 1] = False
    out[inner] = ids
    return out, offsets
