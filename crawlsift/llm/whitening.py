"""Embedding whitening: exact covariance sums on Spark, principal components by contour integration (FEAST)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.sources import io

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
# Quadrature nodes on the upper half of a contour, eigenvalues an interval holds at most (unless they cannot be told apart), and
# rounds of projection.
NODES, PER_INTERVAL, ROUNDS = 12, 8, 40
# Entries that a task works on at once.
SLICE_ENTRIES = 1 << 20
EPS = float(np.finfo(np.float64).eps)
HALF = np.uint64(2 ** 32 - 1)


def _checked(bound: float, limit: float = 2.0 ** 62) -> None:
    if bound >= limit:
        raise ArithmeticError("vector entries are too large for exact 64-bit sums")


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and quantised entries of the vectors that hold no null or non-finite entry, a matrix per vector length and slice."""
    starts = column.offsets.to_numpy()
    lengths = np.diff(starts)
    flat = column.values.cast(pa.float64())
    entries = flat.to_numpy(zero_copy_only=False)  # nulls come out as NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    whole = (bad[starts[1:]] == bad[starts[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths[whole]):
        rows = np.flatnonzero(whole & (lengths == length))
        step = max(1, SLICE_ENTRIES // max(1, int(length)))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            taken = entries[starts[some][:, None] + np.arange(length)]
            _checked(SCALE * np.abs(taken).max(initial=0) + SHIFT)
            yield some, np.floor(SCALE * taken).astype(np.int64) + SHIFT


def gram(rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Exact products of integer columns, and a bound of their size."""
    top = float(np.abs(rows).max(initial=0))
    bound = top * top * len(rows)
    _checked(bound)
    if bound < 2.0 ** 53:  # every partial sum is an integer that a double holds
        values = rows.astype(np.float64)
        return (values.T @ values).astype(np.int64), bound
    return rows.T @ rows, bound


def squares(off: np.ndarray, wide: bool) -> pa.Array:
    """Exact sum of squares of each row of entries below 2^62: longs, or decimals of 38 digits, summed in limbs of 32 bits."""
    if not wide:
        return pa.array((off * off).sum(axis=1))
    size = np.abs(off).astype(np.uint64)
    high, low = size >> np.uint64(32), size & HALF
    limbs = np.zeros((len(off), 4), np.uint64)
    for i, part in enumerate((low * low, (high * low) << np.uint64(1), high * high)):
        limbs[:, i] += (part & HALF).sum(axis=1)
        limbs[:, i + 1] += (part >> np.uint64(32)).sum(axis=1)
    for i in range(3):
        limbs[:, i + 1] += limbs[:, i] >> np.uint64(32)
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(off), [None, pa.py_buffer(limbs.astype("<u4").tobytes())])


def sums(df: DataFrame, vector: str) -> tuple[int, list[int], int]:
    """Number of the longest vectors, the exact sum of each of their entries, and a bound of a vector's squared deviation
    n^2 |x - mean|^2, from the least and the largest of each entry; shorter vectors lack entries and take no part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in vectors(batch.column(0)):
                _checked(float(np.abs(x).max(initial=0)) * len(x))
                d = x.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, len(x), np.int64)),
                    pa.array(x.sum(axis=0)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], ["d", "at", "n", "s", "low", "high"])

    parts = df.select(vector).mapInArrow(run, "d int, at int, n bigint, s bigint, low bigint, high bigint")
    found = io.store(parts.groupBy("d", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")))
    d = found.agg(F.max("d")).first()[0]
    rows = sorted((r["at"], r["n"], int(r["s"]), r["low"], r["high"]) for r in found.where(F.col("d") == d).collect()) if d else []
    bound = sum(max(n * high - s, s - n * low) ** 2 for _, n, s, low, high in rows)
    return (rows[0][1] if rows else 0), [r[2] for r in rows], bound


def covariance(df: DataFrame, vector: str, n: int, total: list[int]) -> np.ndarray:
    """Covariance of the quantised vectors: products of entries less their rounded means, summed exactly; what the rounding of the
    means left is taken off in exact integers before the one division."""
    mean = [(2 * s + n) // (2 * n) for s in total]
    d = len(mean)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, held, size = np.array(mean, np.int64), np.zeros((d, d), np.int64), 0.0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(held[upper])], ["i", "j", "v"])

        for batch in batches:
            for _, x in vectors(batch.column(0)):
                if x.shape[1] != d:
                    continue
                part, bound = gram(x - middle)
                if size + bound >= 2.0 ** 62:
                    yield out()
                    held, size = np.zeros((d, d), np.int64), 0.0
                held += part
                size += bound
        if size:
            yield out()

    cells = df.select(vector).mapInArrow(run, "i int, j int, v bigint").groupBy("i", "j").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    g = np.zeros((d, d), object)
    for r in cells:
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = int(r["v"])
    rest = np.array([s - n * m for s, m in zip(total, mean, strict=True)], object)
    return ((n * g - np.outer(rest, rest)) / (n * n)).astype(np.float64)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and squared off-diagonal of a tridiagonal matrix with the inertia of `a` under every shift (Householder)."""
    a = a.copy()
    for i in range(len(a) - 2):
        v = a[i + 1:, i].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[i + 1:] -= 2 * np.outer(v, v @ a[i + 1:])
        a[:, i + 1:] -= 2 * np.outer(a[:, i + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1) ** 2


def above(band: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """How many eigenvalues exceed the shift: positive pivots of the shifted matrix, by Sylvester's law of inertia."""
    diagonal, square = band
    count, pivot, tiny = 0, 1.0, np.finfo(np.float64).tiny
    for i, x in enumerate(diagonal):
        pivot = x - shift - (square[i - 1] / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def intervals(band: tuple[np.ndarray, np.ndarray], top: float, want: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside): intervals that hold the `want` largest eigenvalues at least.

    Cuts are found by bisection of the counts and moved down until no eigenvalue is within `gap` of them, so that no cluster is
    cut; one at the border comes as a whole, and one larger than `PER_INTERVAL` stays in one interval.
    """
    gap = 32 * len(band[0]) * EPS * top

    def clear(at: float) -> float:
        while above(band, at - gap) != above(band, at + gap):
            at -= 2 * gap
        return at

    low, high = 0.0, top
    while above(band, low) > want and high - low > gap:
        middle = (low + high) / 2
        low, high = (middle, high) if above(band, middle) >= want else (low, middle)
    out, todo = [], [(clear(low), top)]
    while todo:
        a, b = todo.pop()
        inside = above(band, a) - above(band, b)
        middle = clear((a + b) / 2)
        if inside > PER_INTERVAL and middle > a + gap and b - a > 4 * gap:
            todo += [(a, middle), (middle, b)]
        elif inside:
            out.append((a, b, inside))
    return out


def feast(a: np.ndarray, low: float, high: float, inside: int) -> np.ndarray:
    """Eigenvectors of `a` with eigenvalues in (low, high], as many as the inertia counts say.

    A block of vectors is projected onto the interval's eigenspace by a quadrature of (zI - a)^-1 around it, Rayleigh-Ritz takes
    the eigenvectors of what is left; both are repeated until residuals are at rounding level. A block that doesn't yield
    `inside` eigenvalues is doubled, up to the whole space.
    """
    d, scale = len(a), float(np.abs(a).sum(axis=1).max())
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 - nodes))
    radius, centre = (high - low) / 2, (high + low) / 2
    width = min(d, 2 * inside + 4)
    while True:
        block = np.linalg.qr(np.random.default_rng(0).standard_normal((d, width)))[0]
        best = np.inf
        for _ in range(ROUNDS):
            projected = np.zeros((d, width))
            for z, w in zip(turn, weights, strict=True):
                solved = np.linalg.solve((centre + radius * z) * np.eye(d) - a, block.astype(complex))
                projected += 0.5 * w * (radius * z * solved).real
            basis = np.linalg.qr(projected)[0]
            value, turned = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ turned
            held = (value > low) & (value <= high)
            residual = np.linalg.norm(a @ block[:, held] - block[:, held] * value[held], axis=0).max(initial=0)
            if held.sum() == inside and (residual <= 4 * EPS * scale or (residual <= 64 * d * EPS * scale and residual >= best / 2)):
                return block[:, held]
            best = min(best, residual) if held.sum() == inside else np.inf
        if width == d:
            raise ArithmeticError(f"{inside} eigenvalues between {low} and {high} by inertia, but not all were found")
        width = min(d, 2 * width)


def principal(v: np.ndarray, want: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns; `want` at most.

    Eigenvalues within rounding of zero have no direction to scale and are left out.
    """
    scale = float(np.trace(v))
    if not len(v) or scale <= 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a = v / scale
    band = tridiagonal(a)
    top = 1 + 8 * len(a) * EPS  # no eigenvalue exceeds the trace
    want = min(want, above(band, 8 * len(a) * EPS))
    found = [feast(a, *x) for x in intervals(band, top, want)]
    basis = np.linalg.qr(np.concatenate([np.zeros((len(a), 0)), *found], axis=1))[0]
    value, turned = np.linalg.eigh(basis.T @ a @ basis)
    order = np.argsort(-value, kind="stable")[:want]
    return value[order] * scale, (basis @ turned)[:, order]


@dataclass
class Whitened:
    """`rows` (id, deviation: bigint or decimal(38,0), whitened: array<double>), and what was measured on the fit list."""

    rows: DataFrame
    n: int
    explained: list[float]
    identity_error: float


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", want: int = COMPONENTS) -> Whitened:
    """Whiten the vectors of a table onto their `want` leading principal components.

    An entry c becomes x = floor(1024 c) + 100000. All vectors without a null or non-finite entry are the fit list: their sums, and
    products of centred entries, are added up in exact integers by Spark, a matrix per task and its cells combined in a shuffle.
    The driver sees the covariance only, whose size depends on the dimension alone, and finds components by contour integration.
    A last pass projects every row and sums the products of what came out, from which `identity_error` is measured.

    Rows with a null vector, a null or non-finite entry, or fewer entries than the longest vector are dropped. Null and repeated
    ids stay as rows of their own. Without variance (no rows, one row, equal rows, empty vectors) there are no components, and
    `rows` is empty. Entries too large for 64-bit sums raise ArithmeticError. Other columns are ignored.

    A deviation, the sum of (n x - S)^2 over a row's entries, grows with the square of the number of rows: the column is a long
    where one holds the deviation of any row (by the least and largest of each entry), and a decimal of 38 digits otherwise.
    """
    kind = df.schema[vec_id].dataType.simpleString()
    source = df.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    n, total, bound = sums(source, "v")
    _checked(bound, 10.0 ** 38)
    v = covariance(source, "v", n, total) if n else np.zeros((0, 0))
    spread, axes = principal(v, want)
    if not len(spread):
        return Whitened(df.sparkSession.createDataFrame([], f"id {kind}, deviation bigint, whitened array<double>"), n, [], 0.0)
    projected = io.store(project(source, kind, n, total, axes / np.sqrt(spread), bound >= 2 ** 63))
    k = len(spread)
    cells = projected.where("kind = 1").select(F.posexplode("whitened")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    flat = np.array([r["s"] for r in sorted(cells, key=lambda r: r["pos"])]) / n
    error = float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())
    return Whitened(
        projected.where("kind = 0").select("id", "deviation", "whitened"), n, [float(x) for x in spread / np.trace(v)], error)


def project(source: DataFrame, kind: str, n: int, total: list[int], axes: np.ndarray, wide: bool) -> DataFrame:
    """`kind` 0: id, squared deviation (a decimal if `wide`) and whitened entries of a row; `kind` 1, per task: sums of whitened entries,
    then of their products."""
    d, k = axes.shape
    number = pa.decimal128(38, 0) if wide else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = ["kind", "id", "deviation", "whitened"], pa.int64()
        first, second = np.zeros(k), np.zeros((k, k))
        mean = np.array([s // n for s in total], np.int64)
        rest = np.array([s - n * (s // n) for s in total], np.int64)
        for batch in batches:
            ids = batch.schema.field(0).type
            for rows, x in vectors(batch.column(1)):
                if x.shape[1] != d:
                    continue
                near = x - mean
                _checked(n * (float(np.abs(near).max(initial=0)) + 1))
                off = n * near - rest  # n x - S, exactly
                white = (off / n) @ axes
                first += white.sum(axis=0)
                second += white.T @ white
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(len(rows), np.int32)), batch.column(0).take(pa.array(rows)), squares(off, wide),
                    pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names)
        yield pa.RecordBatch.from_arrays([
            pa.array([1], pa.int32()), pa.nulls(1, ids), pa.nulls(1, number),
            pa.array([np.concatenate([first, second.ravel()])], pa.list_(pa.float64()))], names)

    return source.mapInArrow(run, f"kind int, id {kind}, deviation {'decimal(38,0)' if wide else 'bigint'}, whitened array<double>")


def report(df: DataFrame) -> DataFrame:
    """Per row and component: whitened entry, share of the variance explained, and the error of the whitened covariance."""
    done = whiten(df)
    shares = F.array(*[F.lit(x) for x in done.explained]) if done.explained else F.array(F.lit(0.0))
    return done.rows.select("id", "deviation", F.posexplode("whitened").alias("at", "white")).select(
        F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(done.n).cast("bigint").alias("n"), "deviation",
        F.col("white").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(done.identity_error).alias("identity_error"))
