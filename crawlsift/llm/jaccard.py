"""N-gram Jaccard join over a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm import common, words
from crawlsift.sources import io

# Cells of the sketch that orders shingles from rare to frequent (4 bytes each). Any order that all documents share gives the
# same links; a coarser one costs time.
CELLS = 1 << 21
SHIFT = np.uint64(43)
# Sets of a group meet the queries that open it in blocks of about so many shingles a side.
BLOCK_SHINGLES = 400_000
# Bits of the filter that keeps sets out of the shuffle that no candidate needs (16 MB at most). A full filter lets all sets pass.
FILTER_BITS = 1 << 27
BATCH_BYTES = 4 << 20


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    value, offsets = words.hashed(texts)
    gram, doc = words.shingles(value, offsets, k)
    order = np.lexsort((gram, doc))
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return np.split(gram, np.searchsorted(doc, np.arange(1, len(texts)))) if texts else []


def _identity(shingles: np.ndarray) -> int:
    """64-bit identity of a set; equal sets have equal ones."""
    total = words.mix(shingles + np.uint64(words.BASE)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(words.mix(np.array([total]))[0].astype(np.int64))


def _group(shingles: np.ndarray) -> int:
    """Similar sets mostly share the group, their smallest shingle under another order."""
    return int(words.mix(shingles ^ np.uint64(words.BASE)).min().astype(np.int64))


def prefix_length(n: np.ndarray | int, similarity: int) -> np.ndarray | int:
    """How many of a set's n shingles, the first in any shared order, must hold one in common with every similar set."""
    return n - (n * similarity + 99) // 100 + 1


def describe(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """Per row `kind` 0: id, set size, set identity, group; and per task `kind` 1: slices of the sketch of shingle counts. Written once."""
    kind = docs.schema[doc_id].dataType.simpleString()
    step = CELLS >> 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(CELLS, np.uint32)
        names = ["kind", "id", "n", "sid", "grp", "slice", "cells"]
        ids = pa.int64()
        for whole in batches:
            ids = whole.schema.field(0).type
            for batch in common.sliced(whole, 1):
                sets = _sets(common.texts(batch.column(1)), k)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets])
                sketch += np.bincount((flat >> SHIFT).astype(np.int64), minlength=CELLS).astype(np.uint32)
                n = len(sets)
                full = [len(x) > 0 for x in sets]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, np.int32)), batch.column(0), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([_identity(x) if f else None for x, f in zip(sets, full, strict=True)], pa.int64()),
                    pa.array([_group(x) if f else None for x, f in zip(sets, full, strict=True)], pa.int64()), pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary())], names)
        if sketch.any():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.ones(16, np.int32)), pa.nulls(16, ids), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()), pa.nulls(16, pa.int64()),
                pa.array(np.arange(16, dtype=np.int32)), pa.array([sketch[i * step:(i + 1) * step].tobytes() for i in range(16)], pa.binary())], names)

    return io.store(common.small_batches(docs).select(doc_id, text).mapInArrow(
        run, f"kind int, id {kind}, n bigint, sid bigint, grp bigint, slice int, cells binary"))


def sketch_of(described: DataFrame) -> np.ndarray:
    """The whole sketch: slices are added up in one pass per partition, so that no task holds more than 16 of them."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(cells, np.uint32)
                total[at] = total[at] + value if at in total else value
        for at, value in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([value.tobytes()], pa.binary())], ["slice", "cells"])

    slices = described.where("kind = 1").select("slice", "cells")
    rows = slices.mapInArrow(add, "slice int, cells binary").repartition(16, "slice").mapInArrow(add, "slice int, cells binary").collect()
    found = np.zeros(CELLS, np.uint32)
    step = CELLS >> 4
    for row in rows:
        found[row["slice"] * step:(row["slice"] + 1) * step] += np.frombuffer(row["cells"], np.uint32)
    return found


def prefixes(docs: DataFrame, text: str, sketch: np.ndarray, k: int, similarity: int) -> DataFrame:
    """(token, sid, grp, n, rest): the rarest shingles of every set, as many as one must be in common with a similar set; `rest`
    counts the set's shingles from this one on in the order of rarity."""
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = held.value
        for whole in batches:
            for batch in common.sliced(whole, 0):
                sets = [x for x in _sets(common.texts(batch.column(0)), k) if len(x)]
                sizes = np.array([len(x) for x in sets], np.int64)
                if not len(sizes):
                    continue
                flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.lexsort((flat, cells[flat >> SHIFT], doc))
                rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = rank < prefix_length(sizes, similarity)[doc]
                sid, grp = np.array([_identity(x) for x in sets]), np.array([_group(x) for x in sets])
                of = doc[keep]
                yield pa.RecordBatch.from_arrays([
                    pa.array(flat[order][keep].astype(np.int64)), pa.array(sid[of]), pa.array(grp[of]), pa.array(sizes[of].astype(np.int32)),
                    pa.array((sizes[of] - rank[keep]).astype(np.int32))], ["token", "sid", "grp", "n", "rest"])

    return docs.select(text).mapInArrow(run, "token bigint, sid bigint, grp bigint, n int, rest int")


def meetings(matrix: DataFrame) -> DataFrame:
    """Rows of the matrix whose shingle stands in the prefixes of two sets or more, each once."""
    shared = matrix.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select(F.col("token").alias("t"))
    return matrix.join(shared, F.col("token") == F.col("t")).groupBy("token", "sid").agg(*[F.first(x).alias(x) for x in ("grp", "n", "rest")])


def openings(met: DataFrame, similarity: int) -> DataFrame:
    """(sid, opened, n): the groups each query set opens.

    A set opens a group in which another set that is no larger has one of its rarest shingles, unless sizes and what is left
    behind that shingle bound the overlap below what `similarity` percent asks for. The first shingle that two similar sets
    have in common passes both tests, so the larger of them opens the other's group.
    """
    column = met.groupBy("token", "grp").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("left"), F.min("sid").alias("s1"), F.max("sid").alias("s2")).select(
        F.col("token").alias("t"), F.col("grp").alias("opened"), "lo", "hi", "left", "s1", "s2")
    least = F.greatest(100 * F.col("lo"), similarity * F.col("n"))
    able = (
        (F.col("lo") <= F.col("n")) & (100 * F.col("hi") >= similarity * F.col("n")) & ~((F.col("s1") == F.col("sid")) & (F.col("s2") == F.col("sid")))
        & (100 * (100 + similarity) * F.least("rest", "left").cast("bigint") >= similarity * (100 * F.col("n").cast("bigint") + least)))
    return met.join(column, F.col("token") == F.col("t")).where(able).groupBy("sid", "opened").agg(F.first("n").alias("n"))


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bloom filter of 64-bit ids, four bits each, as long as twelve bits an id and `FILTER_BITS` at most."""
    size = 1 << 12
    count = ids.count()
    while size < min(FILTER_BITS, 12 * count):
        size *= 2
    bits = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64("sid", F.lit(i)), F.lit(size)) for i in range(4)])).alias("bit"))
    rows = bits.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit % 64 AS int)))").alias("bits")).toArrow()
    found = np.zeros(size // 64, np.uint64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint64)
    return found


def needed_sets(docs: DataFrame, text: str, needed: DataFrame, k: int) -> DataFrame:
    """(sid, shingles) of the sets with an id in `needed`, one row each. Sets that the filter rules out don't leave their task."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(needed))
    spread = [F.pmod(F.xxhash64("sid", F.lit(i)), F.lit(64 * len(held.value))) for i in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.sliced(whole, 0):
                sets = [x for x in _sets(common.texts(batch.column(0)), k) if len(x)]
                seen = {_identity(x): x for x in sets}
                if seen:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seen, pa.int64()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], ["sid", "shingles"])

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i in range(4):
                at = batch.column(2 + i).to_numpy()
                ok &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select([0, 1]).filter(pa.array(ok))

    sets = docs.select(text).mapInArrow(run, "sid bigint, shingles binary")
    few = sets.select("sid", "shingles", *[x.alias(f"b{i}") for i, x in enumerate(spread)]).mapInArrow(passing, "sid bigint, shingles binary")
    wanted = few.join(needed.select(F.col("sid").alias("want")), F.col("sid") == F.col("want"), "left_semi")
    return wanted.groupBy("sid").agg(F.first("shingles").alias("shingles"))


def _forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what earlier ones did not."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def block_links(queries: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], similarity: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and members of a block of a group.

    The block's token union bounds a query's overlap with every member: a query that doesn't have `similarity` percent of its
    shingles in the union doesn't open the block. For the others, overlaps are counted over the union's postings.
    """
    sizes = np.array([len(x) for _, x in members])
    flat = np.concatenate([x for _, x in members])
    of = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    union, start = np.unique(flat[order], return_index=True)
    of, ends = of[order], np.append(start[1:], len(flat))
    found = []
    for sid, shingles in queries:
        at = np.minimum(np.searchsorted(union, shingles), len(union) - 1)
        at = at[union[at] == shingles]
        if 100 * len(at) < similarity * len(shingles):
            continue
        runs = ends[at] - start[at]
        place = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(start[at], runs)
        both = np.bincount(of[place], minlength=len(members))
        linked = np.flatnonzero(100 * both >= similarity * (sizes + len(shingles) - both))
        found += [(sid, members[i][0]) for i in linked if members[i][0] != sid]
    return _forest(found)


def links(opened: DataFrame, members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): links that connect the same sets as all links do.

    Queries and members of a group are cut into blocks by hash, so a group of any size is many tasks, none of which holds more
    than two blocks. Only a block's spanning links leave its task.
    """
    asks = opened.select(F.col("opened").alias("g"), "sid", "n")
    parts = lambda x: F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias(x)
    cuts = members.groupBy("g").agg(parts("mb")).join(asks.groupBy(F.col("g").alias("h")).agg(parts("qb")), F.col("g") == F.col("h")).select(
        F.col("g").alias("of"), "mb", "qb")
    spot = lambda salt, n: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
    row = lambda kind, q, m: F.struct(F.lit(kind).alias("kind"), q.alias("q"), m.alias("m"))
    held = members.join(cuts, F.col("g") == F.col("of")).select("g", "sid", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("qb") - 1), lambda q: row(0, q, spot("m", "mb")))).alias("at"))
    asked = asks.join(cuts, F.col("g") == F.col("of")).select("g", "sid", F.explode(F.transform(
        F.sequence(F.lit(0), F.col("mb") - 1), lambda m: row(1, spot("q", "qb"), m))).alias("at"))
    both = held.union(asked).select("g", "at.q", "at.m", "at.kind", F.col("sid").alias("s"))
    filled = both.join(sets, F.col("s") == F.col("sid")).select("g", "q", "m", "kind", "sid", "shingles")
    dealt = filled.repartition("g", "q", "m").sortWithinPartitions("g", "q", "m", "kind", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, block in groupby(rows, key=lambda x: x[:3]):
            sides: tuple[list, list] = ([], [])
            for _, _, _, kind, sid, shingles in block:
                sides[kind].append((sid, np.frombuffer(shingles, np.uint64)))
            if sides[0] and sides[1] and (found := block_links(sides[1], sides[0], similarity)):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(sid, root): the smallest id that each end of an edge reaches, by rounds of large and small stars.

    A round links every vertex's larger neighbours, then its smaller ones, to the smallest vertex around it; the number of
    rounds grows with the logarithm of a component's size. Minima are combined before their shuffle, and the joins may be split.
    """
    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(x: DataFrame, large: bool) -> DataFrame:
        around = x.select("a", "b").union(x.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else x
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        joined = around.join(least, F.col("a") == F.col("v"))
        moved = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    now = io.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(now)
    while True:
        now = io.store(star(star(now, True), False))
        after = state(now)
        if after == before:
            return now.select(F.col("a").alias("sid"), F.col("b").alias("root"))
        before = after


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: int = 80) -> DataFrame:
    """(id, n, component) of every row: set size and the smallest id of all documents that links reach.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct k-word shingles, with fewer words
    the whole sequence; two documents link when their sets' Jaccard similarity is `similarity` percent or more. Shingles and
    sets are known by 64-bit hashes.

    Equal sets are one. Sets are partitioned into groups of similar ones. The matrix holds, per group, the rarest shingles of
    its sets; a set opens the groups that hold one of its own rarest ones, which every similar set must (prefix principle), and
    inside them the blocks whose token union covers enough of it. Rarity comes from a sketch of fixed size over all documents,
    so passages that many documents share don't make candidates.

    Nulls and texts without words have an empty set and link with nothing: their component is their own id. Rows that repeat
    an id are documents of their own with that id; null ids take part and are passed over as smallest id. An empty table gives
    no rows. Other columns are ignored.
    """
    described = describe(docs, doc_id, text, k)
    met = io.store(meetings(prefixes(docs, text, sketch_of(described), k, similarity)))
    opened = io.store(openings(met, similarity))
    groups = opened.select(F.col("opened").alias("o")).distinct()
    members = io.store(met.join(groups, F.col("grp") == F.col("o"), "left_semi").groupBy(F.col("grp").alias("g"), "sid").agg(F.first("n").alias("n")))
    needed = io.store(opened.select("sid").union(members.select("sid")).distinct())
    edges = links(opened, members, needed_sets(docs, text, needed, k), similarity)
    roots = components(edges)
    rows = described.where("kind = 0").select("id", "n", "sid")
    rooted = rows.join(roots.withColumnRenamed("sid", "of"), F.col("sid") == F.col("of"), "left").select(
        "id", "n", F.coalesce("root", "sid").alias("root"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component")).withColumnRenamed("root", "r")
    return rooted.join(least, F.col("root") == F.col("r"), "left").select(
        "id", "n", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: set size and component."""
    return join(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Rows of the smallest id of each component, with all columns; rows that repeat that id all stay, and rows without an id."""
    found = join(docs)
    name = common.fresh("__first", docs)
    first = found.where("id = component").select(F.col("id").alias(name)).distinct()
    return docs.join(first, F.col("doc_id") == F.col(name), "left_semi").union(docs.where("doc_id IS NULL"))
