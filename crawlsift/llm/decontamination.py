"""Benchmark decontamination over template windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlsift.llm import common, words

# Names of units, lower-cased, that count as a unit behind a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter"
    " liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros usd eur gbp percent k c f kelvin celsius fahrenheit hz khz mhz ghz w kw mw kwh v kv a ma j kj cal"
    " kcal pa kpa bar b kb mb gb tb bit bits byte bytes mph kmh kph degree degrees radian radians piece pieces item items").split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1F3D5B79A1C3E5F7, 0x2E4C6A88B0D2F416, 0x3D5B79A7BFE1031D))
UNIT_HASHES = np.unique(words.hashed([" ".join(UNITS).encode()])[0])
# A block of the benchmark holds about so much text; a larger benchmark is matched block by block.
BLOCK_BYTES = 8 << 20
LEAK = "array<struct<item:bigint,windows:int,first:int,last:int,changed:int>>"
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_END = np.isin(np.arange(256), list(b".!?:;\n|\"("))


def template(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts with numbers, names and units replaced by typed placeholders; the tokens as they were; offsets.

    Tokens are runs of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased. A token of digits is a number; a
    unit's name behind a number is a unit; a token with one leading capital is a name unless it opens a text or sentence.
    """
    data, start, end, plain, offsets = words.located(docs, words.PUNCTUATION)
    if not len(plain):
        return plain, plain, offsets
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    number = digits[end] - digits[start] == end - start
    stops = np.concatenate([[0], np.cumsum(_END[data])])
    previous = np.concatenate([[0], end[:-1]])
    opens = stops[start] > stops[previous]
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    second = data[np.minimum(start + 1, len(data) - 1)]
    accent = (data[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    name = ((_UPPER[data[start]] & ~_UPPER[second]) | accent) & ~opens & ~number
    behind = np.concatenate([[False], number[:-1]])
    unit = behind & np.isin(plain, UNIT_HASHES) & ~number & ~opens
    return np.select([number, unit, name], [NUMBER, UNIT, NAME], plain), plain, offsets


def windows(tokens: np.ndarray, offsets: np.ndarray, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per width, in rising order: hash and first token of every window of so many tokens within a text. A wider window's sum
    goes on from the narrower one's, so all widths cost little more than the widest."""
    weights = words.mix(np.arange(1, max(widths, default=0) + 1, dtype=np.uint64) * np.uint64(words.BASE)) | np.uint64(1)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(tokens))  # tokens from here to the text's end
    total, held = np.zeros(len(tokens), np.uint64), 0
    for width in sorted(widths):
        for i in range(held, width):
            total[:max(len(tokens) - i, 0)] += tokens[i:] * weights[i]
        held = width
        place = np.flatnonzero(left >= width)
        yield width, total[place], place


def slots(tokens: np.ndarray) -> np.ndarray:
    """How many placeholders stand before each token, and in all."""
    return np.concatenate([[0], np.cumsum(np.isin(tokens, [NUMBER, NAME, UNIT]))])


def _loose(before: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Whether windows hold a placeholder, but no more of them than other tokens."""
    held = before[place + width] - before[place]
    return (held > 0) & (2 * held <= width)


class Table:
    """First tokens of windows, sorted by the windows' hash."""

    def __init__(self, value: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(value, kind="stable")
        self.hash, self.place = value[order], place[order]

    def meet(self, value: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the given windows and of those here that have the same hash, for all pairs of such windows."""
        if not len(self.hash):
            return place[:0], place[:0]
        low = np.searchsorted(self.hash, value, "left")
        hit = np.flatnonzero(self.hash[np.minimum(low, len(self.hash) - 1)] == value)
        times = np.searchsorted(self.hash, value[hit], "right") - low[hit]
        at = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(place[hit], times), self.place[at]


class Block:
    """Windows of some benchmark items, by width: of an item of `width` tokens or more all windows of so many, of a shorter one
    the whole item.

    All are held by their plain tokens, so that equal runs of tokens meet whatever their capitals and line ends. Windows of four
    tokens or more with placeholders in some, but at most half of them are held by their template as well; the others have
    no slots, or say too little without what fills them.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], width: int) -> None:
        self.width, self.ids = width, [x for x, _ in items]
        self.tokens, self.plain, self.offsets = template([(x or "").encode() for _, x in items])
        sizes = np.diff(self.offsets)
        self.held = np.minimum(sizes, width)
        self.widths = [int(x) for x in np.unique(self.held[sizes > 0])]
        before = slots(self.tokens)
        item = np.repeat(np.arange(len(items)), sizes)
        self.loose, self.exact = {}, {}
        for (w, value, place), (_, plain, _) in zip(
                windows(self.tokens, self.offsets, self.widths), windows(self.plain, self.offsets, self.widths), strict=True):
            mine = self.held[item[place]] == w
            loose = mine & (w >= 4) & _loose(before, place, w)
            self.loose[w] = Table(value[loose], place[loose])
            self.exact[w] = Table(plain[mine], place[mine])

    def leaks(self, docs: list[bytes]) -> list[list[dict]]:
        """Items of which each text holds a window with the same plain tokens, or one whose slots are filled consistently.

        Windows that meet are joined by hash and checked one by one: where slots are filled otherwise, a value of the item must
        stand for one value of the text throughout the window. A re-parameterised question passes, also where two of its
        values become equal; a chance meeting of templates doesn't, and spoils no other window.
        """
        found: list[list[dict]] = [[] for _ in docs]
        tokens, plain, offsets = template(docs)
        before = slots(tokens)
        met = []
        for (w, value, place), (_, exact, _) in zip(
                windows(tokens, offsets, self.widths), windows(plain, offsets, self.widths), strict=True):
            loose = _loose(before, place, w)
            met += [(*self.loose[w].meet(value[loose], place[loose]), True), (*self.exact[w].meet(exact, place), False)]
        mine, theirs = (np.concatenate(x) for x in zip(*(x[:2] for x in met), strict=True)) if met else (offsets[:0], offsets[:0])
        by_slots = np.repeat([x[2] for x in met], [len(x[0]) for x in met])
        if not len(mine):
            return found
        doc, item = np.searchsorted(offsets, mine, "right") - 1, np.searchsorted(self.offsets, theirs, "right") - 1
        good, changed = self.consistent(tokens, plain, mine, theirs, self.held[item])
        good &= ~by_slots | changed.any(1)  # unchanged windows met by their plain tokens already
        mine, theirs, item, doc = mine[good], theirs[good], item[good], doc[good]
        if not len(mine):
            return found
        # tokens of the text that were filled otherwise, by alignment: each counts once, however many windows cover it
        at = np.stack([doc, item, mine - theirs])
        order = np.lexsort((mine, *at[::-1]))
        at, mine = at[:, order], mine[order]
        first = np.flatnonzero(np.concatenate([[True], np.any(at[:, 1:] != at[:, :-1], axis=0)]))
        pair = np.flatnonzero(np.concatenate([[True], np.any(at[:2, 1:] != at[:2, :-1], axis=0)]))
        new = np.zeros(len(mine), np.int64)
        before = np.concatenate([[0], mine[:-1]])
        before[first] = -1 << 40
        for j, differs in enumerate(changed[good][order].T):
            new += differs & (mine + j >= before + self.held[at[1]])
        new = np.minimum.reduceat(np.repeat(np.add.reduceat(new, first), np.diff(np.append(first, len(mine)))), pair)
        count, low, high = np.diff(np.append(pair, len(mine))), np.minimum.reduceat(mine, pair), np.maximum.reduceat(mine, pair)
        for d, i, n, a, b, c in zip(*(x.tolist() for x in (*at[:2, pair], count, low, high, new)), strict=True):
            found[d].append({
                "item": self.ids[i], "windows": n, "first": a - int(offsets[d]), "last": b - int(offsets[d]) + int(self.held[i]) - 1, "changed": c})
        return found

    def consistent(self, tokens: np.ndarray, plain: np.ndarray, mine: np.ndarray, theirs: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the windows that met are filled consistently, each by itself: a value of the item stands for one value of the
        text, while two may stand for the same. And per token of the window whether it is filled otherwise."""
        good, changed = np.ones(len(mine), bool), np.zeros((len(mine), self.width), bool)
        for a in range(0, len(mine), 1 << 16):
            part = slice(a, a + (1 << 16))
            step = np.arange(self.width)
            inside = step < held[part, None]
            ours = plain[np.minimum(mine[part, None] + step, len(plain) - 1)]
            other = self.plain[np.minimum(theirs[part, None] + step, len(self.plain) - 1)]
            differs = changed[part] = (ours != other) & inside
            some = np.flatnonzero(differs.any(1))
            ours, other, inside, bad = ours[some], other[some], inside[some], np.zeros(len(some), bool)
            inside &= np.isin(self.tokens[np.minimum(theirs[part][some, None] + step, len(self.plain) - 1)], [NUMBER, NAME, UNIT])
            for i in range(1, self.width):
                bad |= ((other[:, i:] == other[:, :-i]) & (ours[:, i:] != ours[:, :-i]) & inside[:, i:] & inside[:, :-i]).any(1)
            good[a + some] = ~bad
        return good, changed


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 13) -> DataFrame:
    """All columns and `__leaks`: per benchmark item that a text holds, the windows found, the tokens they span and how many
    slots were filled otherwise.

    The benchmark is read in blocks of bounded text, whose windows are broadcast; as many passes as there are blocks make the
    whole join. Documents are neither shuffled nor cut. Null and empty texts hold nothing; null ids and repeated items are
    reported as they are; an empty benchmark marks nothing. Where `docs` has a column `__leaks`, that one stays and the new one
    takes further underscores (`common.fresh`).
    """
    leaks = common.fresh("__leaks", docs)
    spark = common.small_batches(docs).sparkSession
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    at = docs.columns.index(text)
    marked = docs.withColumn(leaks, F.expr(f"CAST(array() AS {LEAK})"))
    kind = pa.list_(pa.struct([("item", pa.int64()), *((x, pa.int32()) for x in ("windows", "first", "last", "changed"))]))
    for i in range(blocks):
        share = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        items = sorted(((x[0], x[1]) for x in share.select(F.col("item_id").cast("bigint"), "text").collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        block = spark.sparkContext.broadcast(Block(items, width))

        def run(batches: Iterator[pa.RecordBatch], block: object = block) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in common.sliced(whole, at):
                    made = block.value.leaks(common.texts(batch.column(at)))
                    held = [a + b for a, b in zip(batch.column(len(batch.columns) - 1).to_pylist(), made, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, kind)], batch.schema.names)

        marked = marked.mapInArrow(run, T.StructType([*docs.schema.fields, marked.schema[leaks]]))
    return marked


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows that hold no benchmark item, with all columns."""
    return mark(docs, benchmark).where(F.size(common.fresh("__leaks", docs)) == 0).select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it."""
    found = mark(docs.select("doc_id", "text"), benchmark).select("doc_id", F.explode("__leaks").alias("x"))
    return found.groupBy("doc_id", F.col("x.item").alias("item_id")).agg(
        F.sum("x.windows").alias("n_windows"), F.min("x.first").alias("first_token"), F.max("x.last").alias("last_token"),
        F.min("x.changed").alias("n_changed"))
