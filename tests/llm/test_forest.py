"""The LSH forest against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from crawlsift.llm import common, forest, jaccard, words
from crawlsift.llm.registry import queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, k=4):
    sets = []
    for _, text in rows:
        w = re.findall(WORD, (text or "").translate(LOW))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(table):
    rows = forest.report(table).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(8)
    base, passage = ["w%d" % draw.randrange(1000) for _ in range(80)], ["p%d" % i for i in range(30)]
    out = [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a\tB"), (1005, "one two three four"), (None, " ".join(base)), (None, "")]
    for i in range(150):  # near copies at every distance, and unrelated texts that share a passage
        text = list(base)
        for _ in range(draw.randrange(8)):
            text[draw.randrange(80)] = "x%d" % draw.randrange(10**6)
        out.append((i, " ".join(text)))
        out.append((200 + i, " ".join([*("y%d" % draw.randrange(10**6) for _ in range(draw.randrange(3, 40))), *passage])))
    out += [(7, out[8][1]), (500, out[9][1]), (500, out[9][1])]
    for i in range(30):  # isolated pairs close to the limit
        text = ["q%d" % draw.randrange(10**6) for _ in range(100)]
        other = list(text)
        for j in draw.sample(range(0, 100, 10), 2):
            other[j] = "z%d" % draw.randrange(10**6)
        out += [(2000 + 2 * i, " ".join(text)), (2001 + 2 * i, " ".join(other))]
    draw.shuffle(out)
    return out


def test_forest_equals_brute_force(docs, rows):
    assert got(docs(*rows)) == expected(rows)
    assert got(docs((1, "x")).limit(0)) == []
    assert got(docs((1, None), (None, ""))) == expected([(1, None), (None, "")])


@pytest.mark.parametrize("shingles,sets", [(400, 4), (4000, 16)])
def test_crowded_regions(docs, rows, monkeypatch, shingles, sets):
    monkeypatch.setattr(forest, "REGION_SHINGLES", shingles)
    monkeypatch.setattr(forest, "REGION_SETS", sets)
    assert got(docs(*rows)) == expected(rows)


def test_star_shaped_group(docs, monkeypatch):
    """Every text is like the one at the centre, few are like each other."""
    draw = random.Random(9)
    base = ["w%d" % i for i in range(200)]
    table = [(900, " ".join(base))]
    for i in range(200):
        text = list(base)
        for j in draw.sample(range(0, 200, 4), 5):
            text[j] = "x%d" % draw.randrange(10**6)
        table.append((i, " ".join(text)))
    monkeypatch.setattr(forest, "REGION_SHINGLES", 2000)
    assert got(docs(*table)) == expected(table)


def test_very_long_text(docs):
    draw = random.Random(10)
    long = ["v%d" % draw.randrange(10**5) for _ in range(150_000)]
    near = [w if draw.random() > 0.02 else "u" for w in long]
    table = [(1, " ".join(long)), (2, " ".join(near)), (3, "short text of five words")]
    assert [(r[0], r[2]) for r in got(docs(*table))] == [(1, 1), (2, 1), (3, 3)]


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(2)
    a = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], draw.integers(0, 1 << 63, 1000, dtype=np.uint64)])  # similarity 0.6
    sig = forest.signatures(np.concatenate([a, b]), np.array([0, 4000]))
    assert 0.4 < (sig[0] == sig[1]).mean() < 0.8


def test_set_helpers_agree():
    texts = [b"", b"a b c d e f", b"x y", b"a b c d e f", b"a b c d a b c d a b c d"]
    gram, starts, sizes = words.sets(texts, 4)
    for i, one in enumerate(jaccard._sets(texts, 4)):
        assert (gram[starts[i]:starts[i] + sizes[i]] == one).all() and sizes[i] == len(one)
    full = np.flatnonzero(sizes)
    ids = words.identities(gram, starts[full], sizes[full])
    assert ids[0] == ids[2] == jaccard._identity(jaccard._sets(texts, 4)[1]) and len(set(ids.tolist())) == 3


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    found = queries()["op11_minhash"](spark, SF)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str) == expected(rows)
