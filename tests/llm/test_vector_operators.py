"""Whitening and hard negatives against plain numpy and plain Python."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from crawlsift.llm import common, hard_negatives, whitening
from crawlsift.llm.registry import queries

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def vectors(spark):
    """Embeddings of the given rows, with columns whose names clash with those the operators make."""
    def make(*rows, kind="float"):
        table = spark.createDataFrame(list(rows), f"vec_id bigint, embedding array<{kind}>, label int")
        return table.selectExpr("*", "'x' AS id", "1 AS n", "'y' AS at", "2 AS kind", "3 AS deviation", "4 AS rank", "5 AS score", "6 AS no", "7 AS part", "8 AS v")

    return make


def expected_whitening(rows, want=8):
    """Exact integer sums, numpy's eigenvectors."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for v in rows], object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    y = np.array([[float(Fraction(int(c), n)) for c in row] for row in off])
    value, axes = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-value)[:want]
    order = order[value[order] > 1e-12 * max(value.sum(), 1e-300)]
    return n, [int((row * row).sum()) for row in off], y @ axes[:, order] / np.sqrt(value[order]), value[order] / value.sum()


def check_whitening(df, rows, ids):
    n, deviation, white, explained = expected_whitening(rows)
    got = whitening.report(df).collect()
    assert len(got) == n * white.shape[1]
    found = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(sum(found[i, c + 1].whitened * white[at, c] for at, i in enumerate(ids))) for c in range(white.shape[1])]
    for at, i in enumerate(ids):
        for c in range(white.shape[1]):
            r = found[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[at])
            assert r.whitened == pytest.approx(signs[c] * white[at, c], abs=1e-9)
            assert r.explained == pytest.approx(explained[c], rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_whitening_of_given_embeddings(spark):
    table = common.read(spark, SF, "embeddings")
    rows = table.collect()
    check_whitening(table, [r.embedding for r in rows], [r.vec_id for r in rows])
    assert queries()["op12_whitening"](spark, SF).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_leaves_out_broken_rows(vectors):
    draw = random.Random(3)
    good = [(i, [draw.gauss(0, 1) * (3 - j) for j in range(3)], None) for i in range(40)]
    good += [(40, good[0][1], 1), (41, [500.0, -300.0, 2.0], 2)]
    bad = [(50, None, 1), (51, [], 1), (52, [1.0, None, 2.0], 1), (53, [1.0, NAN, 2.0], 1), (54, [INF, 1.0, 2.0], 1), (55, [1.0, -INF, 0.0], 1), (56, [1.0, 2.0], 1)]
    table = vectors(*good, *bad)
    stored = {r.vec_id: r.embedding for r in table.collect()}
    check_whitening(table, [stored[i] for i, _, _ in good], [i for i, _, _ in good])


def test_deviations_beyond_a_long_are_whole(vectors):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 5000), draw.gauss(0, 50), draw.gauss(0, 2)], None) for i in range(600)]
    table = vectors(*rows)
    stored = [r.embedding for r in table.collect()]
    assert max(expected_whitening(stored)[1]) > 2 ** 63
    check_whitening(table, stored, [i for i, _, _ in rows])
    assert dict(whitening.report(table).dtypes)["deviation"] == "decimal(38,0)"
    assert dict(whitening.report(vectors(*rows[:20])).dtypes)["deviation"] == "bigint"


def test_squares_in_limbs():
    off = np.random.default_rng(2).integers(-(1 << 61), 1 << 61, (50, 3)) >> np.arange(0, 60, 20)
    off = np.vstack([off, [[0, 0, 0], [1 - (1 << 62), (1 << 62) - 1, 0], [1 << 32, (1 << 32) - 1, -1]]])
    assert [int(x) for x in whitening.squares(off, True).to_pylist()] == [sum(int(x) ** 2 for x in row) for row in off]


def test_whitening_without_variance_has_no_components(vectors):
    for rows in ([(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)], [(1, [], 0), (2, [], 0)]):
        assert whitening.report(vectors(*rows)).count() == 0
    assert whitening.report(vectors((1, [1.0], 0)).limit(0)).collect() == []
    one = whitening.report(vectors((1, [0.0, 5.0], 0), (None, [2.0, 5.0], 0), (1, [0.0, 5.0], 0))).collect()  # a constant dimension, null and repeated ids
    assert sorted(round(abs(r.whitened), 6) for r in one) == [0.707107, 0.707107, 1.414214] and {r.component for r in one} == {1}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(vectors((1, [1e300], 0), kind="double")).rows.count()


@pytest.mark.parametrize("values", [
    np.linspace(1, 5, 20), [7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 7, 3, 2, 1], [5, 5, 5, 4, 4, 3, 2 + 1e-9, 2, 2 - 1e-9, 2 - 2e-9, 1, 1e-9], [1e9, 1, 1e-3, 0, 0],
    10.0 ** -np.arange(12), [1], [2, 0], np.ones(64)])
def test_contour_components(values):
    values = np.array(values, float)
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((len(values), len(values))))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, axes = whitening.principal(v)
    wanted = np.sort(values[values > 1e-13 * values.sum()])[::-1][:8]
    assert e == pytest.approx(wanted, rel=1e-6, abs=1e-13 * values.sum())
    assert np.abs(axes.T @ axes - np.eye(len(e))).max() < 1e-13
    assert np.abs(v @ axes - axes * e).max() < 1e-13 * values.max() * len(values)


def test_inertia_counts():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    band, value = whitening.tridiagonal(a), np.linalg.eigvalsh(a)
    for shift in np.linspace(-15, 15, 61):
        assert whitening.above(band, shift) == (value > shift).sum()
    found = whitening.intervals(whitening.tridiagonal(a @ a), float(np.abs(a @ a).sum(axis=1).max()), 17)
    assert sum(n for _, _, n in found) == 17 and max(n for _, _, n in found) <= whitening.PER_INTERVAL


@pytest.mark.parametrize("shape", [(1, 1, 1), (0, 5, 3), (5, 0, 3), (33, 33, 33), (40, 64, 100), (129, 65, 77), (200, 3, 200), (64, 64, 64)])
def test_strassen(shape):
    m, k, n = shape
    draw = np.random.default_rng(m)
    for top in (2, 300, 1 << 28):
        a, b = draw.integers(-top, top, (m, k)), draw.integers(-top, top, (k, n))
        assert (hard_negatives.strassen(a, b) == a @ b).all()


def test_heaps_merge():
    draw = random.Random(4)
    pairs = [(draw.randrange(5), draw.randrange(-3, 3), draw.randrange(9)) for _ in range(200)]
    heaps = hard_negatives.Heaps(6, 4)
    for at in range(0, 200, 17):
        key, score, ids = (np.array(x) for x in zip(*pairs[at:at + 17], strict=True))
        heaps.add(key, score, ids)
    heaps.add(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    got = sorted(zip(*(x.tolist() for x in heaps.pairs()), strict=True))
    assert got == sorted(p for k in range(5) for p in sorted((p for p in pairs if p[0] == k), key=lambda p: (-p[1], p[2]))[:4])


def expected_negatives(rows):
    """Brute force over plain integers; each anchor row on its own."""
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    longest = max((len(r[1]) for r in rows), default=0)
    rows = [(i, [math.floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if len(v) == longest]
    out = []
    for anchor, v, label in rows:
        if anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, w, other in rows))
        for p, positive in [(-s, i) for s, i, other in scored if other == label and i != anchor][:5]:
            window = [(i, -s) for s, i, other in scored if other != label and 80 * p <= -100 * s <= 100 * p]
            out += [(anchor, positive, rank, i, p, s) for rank, (i, s) in enumerate(window[:5], 1)]
    return sorted(out)


def test_negatives_equal_brute_force(vectors, monkeypatch):
    draw = random.Random(6)
    rows = [(i, [round(draw.gauss(0.4, 0.5), 1) for _ in range(5)], draw.randrange(3)) for i in range(0, 1500, 5)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(2001, 2040)]  # ties
    rows += [(2100, [1.0, 0.0, 0.0, 0.0, 0.0], 1), (2200, [-1.0] * 5, 9), (2300, [0.0] * 5, 0), (300, rows[3][1], 2), rows[9], rows[20]]  # repeated ids and rows
    rows += [(2400, None, 1), (2500, [1.0, None, 0.0, 0.0, 0.0], 1), (2600, [NAN] * 5, 1), (2700, [INF, 0.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 5, 1),
             (2800, [1.0] * 5, None), (2900, [1.0], 1), (3000, [], 1), (-100, [1.0, 0.5, 0.0, 0.0, 0.0], 1)]
    draw.shuffle(rows)
    table = vectors(*rows)
    expected = expected_negatives([(r.vec_id, r.embedding, r.label) for r in table.collect()])
    assert len(expected) > 100
    assert sorted(tuple(r) for r in hard_negatives.report(table).collect()) == expected
    for name, value in (("PASS_ANCHORS", 4), ("ANCHOR_TILE", 3), ("CANDIDATE_TILE", 7), ("LEAF", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    blocks = list(hard_negatives.blocks(hard_negatives.usable(table, "vec_id", "label", "embedding").where("id % 100 = 0 AND size(vec) = 5"), 5))
    assert max(len(b.ids) for b in blocks) <= 4 and len(blocks) > 3
    assert sorted(tuple(r) for r in hard_negatives.report(table.repartition(5)).collect()) == expected


def test_negatives_of_nothing(vectors):
    for table in (vectors((100, [1.0], 1)).limit(0), vectors((100, None, 1)), vectors((100, [1.0], 1)), vectors((101, [1.0], 1)), vectors((100, [], 1), (1, [], 2))):
        assert hard_negatives.report(table).collect() == []
