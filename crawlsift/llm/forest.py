"""MinHash near-dedup with an LSH forest: several sorted orders of signatures, prefixes as deep as a region is crowded."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm import common, words
from crawlsift.llm.jaccard import block_links, components, needed_sets
from crawlsift.llm.jaccard import links as grid_links
from crawlsift.sources import io

# Each tree sorts the sets by `HASHES` minimum hashes of its own. Two sets of similarity s share a tree's region of depth p with
# chance s^p: at 0.8 and depth 2 all twelve trees miss a pair once in 200,000.
TREES, HASHES = 12, 8
DEPTHS = (2, 3, 4, 6, 8)
# A region of at most so many shingles, or sets, is compared as a whole; a larger one in runs of its sorted order.
REGION_SHINGLES, REGION_SETS = 60_000, 16
# Sets close to the centre of a crowded region that all of its runs are compared with.
CENTRES = 8
SEED = np.random.default_rng(11).integers(0, 1 << 63, (2, TREES * HASHES), dtype=np.uint64)


def signatures(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of minimum hashes, big-endian, for each run of shingles: their bytes sort as the numbers do."""
    out = np.empty((len(starts), TREES * HASHES), ">u4")
    for i, (salt, odd) in enumerate(SEED.T):
        out[:, i] = np.minimum.reduceat((grams ^ salt) * (odd | np.uint64(1)), starts) >> np.uint64(32)
    return out


def describe(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """(id, n, sid, sig) of every row: set size, set identity and signature. Written once."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.sliced(whole, 1):
                gram, starts, sizes = words.sets(common.texts(batch.column(1)), k)
                full = np.flatnonzero(sizes)
                sid, sig = np.zeros(len(sizes), np.int64), np.full(len(sizes), None, object)
                if len(full):
                    sid[full] = words.identities(gram, starts[full], sizes[full])
                    sig[full] = [x.tobytes() for x in signatures(gram, starts[full])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(sizes), pa.array(sid, mask=sizes == 0), pa.array(sig, pa.binary())], ["id", "n", "sid", "sig"])

    return io.store(common.small_batches(docs).select(doc_id, text).mapInArrow(run, f"id {kind}, n bigint, sid bigint, sig binary"))


def leaves(described: DataFrame) -> DataFrame:
    """(tree, label, sid, n): every distinct set in every tree's order."""
    distinct = described.where("sid IS NOT NULL").groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    width = 4 * HASHES
    return distinct.select("sid", "n", F.posexplode(F.array(*[F.substring("sig", 1 + t * width, width) for t in range(TREES)])).alias(
        "tree", "label"))


def regions(rows: DataFrame, depth: int) -> DataFrame:
    """The rows that share their tree's prefix of `depth` hashes with others: the region `g`, whether it is `small`, and `members`,
    which equal regions of several trees share. A hot region's rows are counted before they meet their sums in a join."""
    keyed = rows.drop("g", "small", "members").withColumn("g", F.xxhash64("tree", F.lit(depth), F.substring("label", 1, 4 * depth)))
    sums = keyed.groupBy("g").agg(
        F.count("*").alias("sets"), F.sum("n").alias("mass"), F.expr("bit_xor(xxhash64(sid, 'member'))").alias("all")).where("sets > 1")
    flags = sums.select(
        F.col("g").alias("of"), ((F.col("mass") <= REGION_SHINGLES) | (F.col("sets") <= REGION_SETS)).alias("small"),
        F.xxhash64("sets", "all").alias("members"))
    return keyed.join(flags, F.col("g") == F.col("of")).drop("of")


def whole_regions(met: DataFrame) -> DataFrame:
    """(g, sid, n) of the small regions; of regions with the same members one stands for all."""
    small = met.where("small")
    kept = small.groupBy("members").agg(F.min("g").alias("one"))
    return small.join(kept.drop("members").withColumnRenamed("one", "o"), F.col("g") == F.col("o"), "left_semi").select("g", "sid", "n")


def sorted_runs(crowded: DataFrame) -> DataFrame:
    """(g, sid, n): crowded regions in runs of consecutive labels, so that sets with the longest common prefixes meet.

    Regions are sorted across partitions; a run ends at `REGION_SHINGLES`, at the region's end or with its partition, and starts
    with the set before it. The sets nearest to the region's centre, those that have the most frequent label of their region
    in the most trees, join every run.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mass, count, last = None, 0, 0, None
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])

            def put(*row: int) -> None:
                for column, value in zip(out, row, strict=True):
                    column.append(value)  # noqa: B023

            for g, first, sid, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != at or (mass > REGION_SHINGLES and count >= REGION_SETS):
                    run = int(words.mix(np.array([g ^ first], np.int64).view(np.uint64)).view(np.int64)[0])
                    mass = count = 0
                    if g == at and last:
                        put(run, g, *last)
                        mass, count = last[1], 1
                    at = g
                put(run, g, sid, n)
                mass, count, last = mass + n, count + 1, (sid, n)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["run", "g", "sid", "n"])

    ranged = crowded.repartitionByRange("g", "label", "sid").sortWithinPartitions("g", "label", "sid")
    runs = io.store(ranged.select("g", F.xxhash64("g", "sid", F.lit("run")).alias("first"), "sid", "n").mapInArrow(
        cut, "run bigint, g bigint, sid bigint, n bigint"))
    modes = crowded.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", "c").alias("mode"))
    named = modes.select(F.col("g").alias("of"), "mode")
    votes = crowded.join(named, F.col("g") == F.col("of")).groupBy("sid").agg(F.sum((F.col("label") == F.col("mode")).cast("int")).alias("votes"))
    central = crowded.select("g", "sid", "n").join(votes.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s"))
    best = central.groupBy("g", F.pmod("sid", F.lit(CENTRES)).alias("part")).agg(F.max_by(F.struct("sid", "n"), F.struct("votes", "sid")).alias("best"))
    heads = runs.select("run", F.col("g").alias("of")).distinct().join(best, F.col("g") == F.col("of")).select(
        F.col("run").alias("g"), "best.sid", "best.n")
    return runs.select(F.col("run").alias("g"), "sid", "n").union(heads).distinct()


def confirmed(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(a, b): a spanning forest of the links inside every region or run, by its sets' full overlaps."""
    filled = rows.select("g", F.col("sid").alias("s")).join(sets, F.col("s") == F.col("sid")).select("g", "sid", "shingles")
    dealt = filled.repartition("g").sortWithinPartitions("g", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, region in groupby(every, key=lambda x: x[0]):
            held = [(sid, np.frombuffer(shingles, np.uint64)) for _, sid, shingles in region]
            if found := block_links(held, held, similarity):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def left_over(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of crowded regions with their component `root` and the region's `main` one, where a region has several."""
    rooted = crowded.join(roots.withColumnRenamed("sid", "s"), F.col("sid") == F.col("s"), "left").withColumn(
        "root", F.coalesce("root", "sid")).drop("s")
    sizes = rooted.groupBy("g", "root").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    main = sizes.groupBy(F.col("g").alias("of")).agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), (F.sum("m") - F.max_by("m", F.struct("c", "root"))).alias("rest"),
        F.count("*").alias("roots")).where("roots > 1").drop("roots")
    return rooted.join(main, F.col("g") == F.col("of")).drop("of")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, similarity: int = 80) -> DataFrame:
    """(id, n, component) of every row: set size and the smallest id of all documents that links reach.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct k-word shingles, with fewer words
    the whole sequence; two documents link when their sets' Jaccard similarity is `similarity` percent or more, counted on
    the full sets (64-bit hashes).

    Equal sets are one. A forest of `TREES` orders sorts them by their minimum hashes; sets that share a tree's first hashes are
    candidates. A region too crowded to compare as a whole is compared in runs of its sorted order and with the sets at its
    centre. Where that leaves it in several components, the sets outside the main one meet all of the region's sets if they
    are few, and otherwise deeper prefixes split the region until they are, or until the last depth. So a pair is lost only if it shares
    no region in any tree, or if unrelated sets crowd all regions it shares.

    Nulls and texts without words have an empty set and link with nothing: their component is their own id. Rows that repeat
    an id are documents of their own with that id; null ids take part and are passed over as smallest id. An empty table gives
    no rows. Other columns are ignored.
    """
    described = describe(docs, doc_id, text, k)
    met = io.store(regions(leaves(described), DEPTHS[0]))
    crowded = met.where("NOT small")
    rows, tight = whole_regions(met), crowded.isEmpty()
    if not tight:
        rows = rows.union(sorted_runs(crowded))
    rows = io.store(rows)
    sets = needed_sets(docs, text, rows.select("sid").distinct(), k)
    if tight:
        roots = components(confirmed(rows, sets, similarity))
    else:
        sets = io.store(sets)
        edges = io.store(confirmed(rows, sets, similarity))
        roots = components(edges)
        if more := crowded_links(crowded, roots, sets, similarity):
            for found in more:
                edges = edges.union(found)
            roots = components(edges)
    placed = described.select("id", "n", "sid").join(roots.withColumnRenamed("sid", "of"), F.col("sid") == F.col("of"), "left").select(
        "id", "n", F.coalesce("root", "sid").alias("root"))
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component")).withColumnRenamed("root", "r")
    return placed.join(least, F.col("root") == F.col("r"), "left").select(
        "id", "n", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def crowded_links(crowded: DataFrame, roots: DataFrame, sets: DataFrame, similarity: int) -> list[DataFrame]:
    """Links of the sets that runs left outside the main component of their crowded regions, a table per depth that has any."""
    out = []
    for i, depth in enumerate(DEPTHS):
        several = io.store(left_over(crowded, roots))
        if several.isEmpty():
            break
        last = i + 1 == len(DEPTHS)
        few = F.lit(True) if last else F.col("rest") <= REGION_SHINGLES
        now = several.where(few)
        if not now.isEmpty():
            asks = now.where("root <> main").select(F.col("g").alias("opened"), "sid", "n")
            out.append(io.store(grid_links(asks, now.select("g", "sid", "n"), sets, similarity)))
        if last:
            break
        deeper = io.store(regions(several.where(~few).select("tree", "label", "sid", "n"), DEPTHS[i + 1]))
        small = whole_regions(deeper)
        if not small.isEmpty():
            out.append(io.store(confirmed(small, sets, similarity)))
        crowded = deeper.where("NOT small")
    return out


def report(docs: DataFrame) -> DataFrame:
    """Per document: set size, component, and whether it stays as the component's first."""
    return join(docs).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"))
