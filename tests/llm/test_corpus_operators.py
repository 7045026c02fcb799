"""Operators over a whole corpus: join, decontamination, classifiers, language model, pipeline."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from crawlsift.llm import attention, common, decontamination, jaccard, quality, scoring, toxicity
from crawlsift.llm.registry import PIECES, queries

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def expected_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(WORD, low(text))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def test_join_equals_brute_force(docs, monkeypatch):
    draw = random.Random(2)
    base, passage = ["w%d" % draw.randrange(1000) for _ in range(80)], ["p%d" % i for i in range(30)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a\tB"), (1005, "one two three four five"), (None, " ".join(base)), (None, "")]
    for i in range(120):  # near copies at every distance, and texts that share a passage
        words = list(base)
        for _ in range(draw.randrange(9)):
            words[draw.randrange(80)] = "x%d" % draw.randrange(10**6)
        rows.append((i, " ".join(words)))
        rows.append((200 + i, " ".join([*("y%d" % draw.randrange(10**6) for _ in range(draw.randrange(3, 40))), *passage])))
    rows += [(7, rows[8][1]), (500, rows[9][1]), (500, rows[9][1])]
    draw.shuffle(rows)
    got = jaccard.report(docs(*rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(rows)
    assert jaccard.report(docs((1, "x")).limit(0)).count() == 0
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 500)  # groups of many blocks
    got = jaccard.report(docs(*rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_components(rows)


def test_join_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in common.read(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in queries()["op8_jaccard"](spark, SF).collect()), key=str) == expected_components(rows)


def test_decontamination(docs, spark):
    item = "Maria walked 12 km to the old market before noon and bought 3 kg of apples for 9 dollars from Peter"
    bench = spark.createDataFrame([(5, item), (6, None), (7, ""), (8, "too short"), (9, "this is short text"), (5, item)], "item_id bigint, text string")
    changed = item.replace("12", "40").replace("Maria", "Helen").replace("Peter", "Oskar").replace(" 3 ", " 8 ")
    odd = item.replace("9 dollars", "9 apples").replace("market", "house").replace("noon", "dawn")
    repeated = "On day 4 the ship with 4 sails met 4 boats and lost 4 men near the coast of the old land"
    bench = bench.union(spark.createDataFrame([(10, repeated)], bench.schema))
    rows = [
        (1, "before. " + item + " after"), (2, "Then " + changed), (3, odd), (4, None), (5, ""), (6, "clean text of no interest at all " * 20), (None, item),
        (7, "this is short text"), (8, repeated.replace("4", "9")), (9, "On day 1 the ship with 2 sails met 3 boats and lost 5 men near the coast of the old land"),
        (10, "z " * 100_000 + item)]
    got = collections.defaultdict(set)
    for r in decontamination.report(docs(*rows), bench).collect():
        got[r.doc_id].add((r.item_id, r.n_changed > 0))
    assert got == {1: {(5, False)}, 2: {(5, True)}, None: {(5, False)}, 7: {(9, False)}, 8: {(10, True)}, 10: {(5, False)}}
    assert decontamination.report(docs(*rows), bench.limit(0)).count() == 0
    assert decontamination.report(docs(*rows).limit(0), bench).count() == 0


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    items = [(i, " ".join("b%d_%d" % (i, j) for j in range(20)).replace("_", "x")) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(i, "start " + t + " end") for i, t in items]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 700)
    got = {(r.doc_id, r.item_id) for r in decontamination.report(docs(*rows), bench).collect()}
    assert got == {(i, i) for i, _ in items}


def leaks(docs, spark, items, *texts):
    """Items found in each text, with whether slots were changed."""
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = decontamination.report(docs(*enumerate(texts)), bench).collect()
    return [sorted((r.item_id, r.n_changed > 0) for r in found if r.doc_id == i) for i in range(len(texts))]


def test_decontamination_finds_short_items_and_dense_ones(docs, spark):
    items = ["which river runs through the capital city", "blue whale", "yes", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "Add 5"]
    rest = "so much for a start of the page and then some more words that nobody asked for at all"
    got = leaks(
        docs, spark, items, rest + ": " + items[0] + "? " + rest, rest + ", a blue whale " + rest, rest + " Yes " + rest,
        rest + " " + items[3] + " " + rest, rest + " 2 3 4 5 6 7 8 9 10 11 12 13 14 16 " + rest, rest + " whale blue, add 7 " + rest, "", "which river runs")
    assert got == [[(0, False)], [(1, False)], [(2, False)], [(3, False)], [(3, False)], [], [], []]


def test_decontamination_checks_each_window(docs, spark):
    tail = " and then the crew went on a long and slow trip home over the dark and quiet sea until the very end"
    items = ["The ship with 4 sails met 4 boats" + tail, "A farmer had 3 cows and 5 sheep in the field behind the old red barn"]
    got = leaks(docs, spark, items, items[0].replace("4 boats", "5 boats"), items[1].replace("3", "4").replace("5", "4"), "a 4 b " * 30)
    assert got == [[(0, True)], [(1, True)], []]


def test_decontamination_finds_equal_tokens_in_other_spellings(docs, spark):
    items = ["Maria and Peter took the old road to Vienna with Oskar and Helen", "Long ago in Rome the sculptor Paolo met his friend Carla near Milan"]
    got = leaks(
        docs, spark, items, "they say that " + items[0] + " today", items[1].lower(), items[1].upper(), items[1].replace(" Carla", "\nCarla"),
        "once, long ago in Rome the sculptor Paolo met his friend Carla near Milan")
    assert got == [[(0, False)], *[[(1, False)]] * 4]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries()["op3_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in common.read(spark, sf, "labels").collect()}
    assert len(got) == common.read(spark, sf, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].score, y) for i, y in labels.items() if got[i].held_out]
    pairs = [a > b for a, y in held for b, z in held if y == 1 and z == 0]
    assert np.mean(pairs) > 0.9


def test_toxicity_learns_from_the_training_fold_alone(docs, spark):
    bad, good = "you vile wretch number ", "a calm and kind sentence "
    rows = [(i, (bad if i % 3 == 0 else good) + "u%d" % i) for i in range(300)] + [(900, None), (901, ""), (None, bad)]
    labels = [(i, 1 if i % 3 == 0 else 0) for i in range(300)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    run = lambda x: {r.doc_id: (r.score, r.predicted) for r in toxicity.report(docs(*rows), spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()}
    one = run(labels)
    assert one == run(flipped)
    assert all(one[i][1] == y for i, y in labels) and one[900] == one[901]
    assert toxicity.report(docs(*rows), spark.createDataFrame([], "doc_id bigint, toxic int")).where("predicted = 1").count() == 0
    assert toxicity.report(docs(*rows).limit(0), spark.createDataFrame(labels, "doc_id bigint, toxic int")).count() == 0


def test_risk_is_non_negative():
    draw = np.random.default_rng(1)
    toxic = [draw.integers(0, 5000, 40) for _ in range(30)]
    weights, bias = toxicity.train(toxic, toxic, 0.5)
    assert np.isfinite(weights).all() and np.isfinite(bias) and np.abs(weights).max() < 50


def test_quality_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id for r in queries()["op7_quality"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in common.read(spark, sf, "labels").collect()}
    assert np.mean([i in kept for i, y in labels.items() if y == 1]) > 0.97
    assert np.mean([i in kept for i, y in labels.items() if y == 0]) < 0.1


def test_quality_shrinks_sparse_sites(spark):
    model = quality.Model(np.zeros((0, 1)), np.zeros(0))
    model.probability = lambda x: np.where(x[:, 0] > np.log(4), 0.9, 0.2)  # longer than three words: good
    rows = [(i, "a b c d e" if i % 10 else "x", "big" if i < 400 else "bad" if i < 500 else None, "p") for i in range(500)]
    rows = [(i, "x" if s == "bad" else t, s, p) for i, t, s, p in rows] + [(900, "x", "new", None), (901, "a b c d e", "bad", "p"), (902, None, "big", "q")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").selectExpr("*", "1 AS place", "2 AS host")
    got = {r.doc_id: r["__quality"] for r in quality.posterior(table, model, F.col("source"), F.col("lang")).collect()}
    assert len(got) == len(rows)
    assert got[1] > 0.8 and got[401] < 0.1  # evidence and site agree
    assert got[1] > got[901] and got[0] > got[401]  # the same text counts for more at a good site
    assert got[401] < got[900] < got[1]  # a site of one page leans on the whole


def test_quality_edge_cases(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.keep(docs((1, None), (2, ""), (None, "x")), none).count() == 3
    assert quality.keep(docs((1, "x")).limit(0), none).count() == 0


def test_scores(docs):
    rows = [(i, "The cat%d sat " % (i % 7) * (i % 5)) for i in range(200)] + [(900, None), (901, ""), (None, "The cat1"), (5, "again"), (902, "z" * 3000)]
    got = scoring.report(docs(*rows), PIECES).collect()
    assert len(got) == len(rows)
    train = [re.findall(WORD, low(t)) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for x in train for w in x)
    total, kinds = sum(c.values()) + len(train), len(c) + 1
    want = collections.Counter()
    for i, t in rows:
        w = re.findall(WORD, low(t))
        base = sum(math.log10((n + 0.1) / (total + 0.1 * (kinds + 1))) for n in [*(c[x] for x in w), len(train)])
        want[i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(w) + 1, 1 + sum(x in c for x in w), total, round(base, 6)] += 1
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert all(r.score < 0 for r in got)
    assert scoring.report(docs((1, "x")).limit(0), PIECES).count() == 0


def fitted(prepared):
    table = scoring.pieces.chunks(PIECES)
    size = table.model.get_piece_size()
    found = scoring.counts(prepared, scoring.PIECE).toPandas()
    seen = np.bincount(found["key"].to_numpy(np.int64), found["c"].to_numpy(np.int64), size)
    return scoring.fit(prepared, seen, np.zeros(size, np.int64), table.model.eos_id())[0]


def test_every_training_document_trains(docs):
    texts = ["the cat sat on the mat and slept", "a red bird flew over the old house", "nobody asked what the river knew"]
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 10][:3]
    for i, text in zip(ids, texts, strict=True):  # the weights of the class before last start at zero
        assert fitted(scoring.prepare(docs((i, text)), PIECES))["second"].any()
    assert attention.CLASSES == 256


def test_copies_spread_over_groups(docs, monkeypatch):
    copy = "one and the same text on many pages " * 4
    prepared = scoring.prepare(docs(*((i, "page %d has a text of its own about the number %d" % (i, i * i) * 3 if i % 3 else copy) for i in range(1500)), *[(1, copy)] * 300), PIECES)
    monkeypatch.setattr(scoring, "GROUP_TOKENS", 5000)
    got = scoring.dealt(prepared).groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("ids") / 2).alias("size")).collect()
    train = prepared.where((F.col("kind") == scoring.DOCUMENT) & ~F.col("held_out")).count()
    assert len(got) > 5 and sum(r.n for r in got) == train and max(r["size"] for r in got) < 7500


def test_rare_words_are_joined(docs, monkeypatch):
    rows = [(i, "a%d b%d" % (i, i % 9)) for i in range(60)]
    plain = sorted(tuple(r)[:6] for r in scoring.report(docs(*rows), PIECES).collect())
    monkeypatch.setattr(scoring, "FREQUENT", 3)
    few = sorted(tuple(r)[:6] for r in scoring.report(docs(*rows), PIECES).collect())
    assert all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 for a, b in zip(plain, few, strict=True))


def test_counted_shares_sum_to_one():
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 50, 900)
    kind = attention.classes(counts, np.arange(900) % 2, 2)
    key, n = np.unique(draw.integers(0, (attention.CLASSES + 1) * 900, 5000), return_counts=True)
    chance, inside = attention.shares(counts, kind, (key // 900, key % 900, n))
    assert np.allclose(chance.sum(1), 1) and (chance > 0).all()
    for row in inside:
        assert np.allclose(np.bincount(kind, 10.0 ** row, attention.CLASSES)[np.unique(kind)], 1, atol=1e-4)


def test_scores_follow_the_order_of_words(docs):
    rows = [(i, "red cat sat on blue mat . " * 20) for i in range(400)] + [(1000, "red cat sat on blue mat ."), (1001, "mat on . red blue sat cat")]
    got = {x.doc_id: x for x in scoring.report(docs(*rows), PIECES).collect()}
    assert got[1000].score > got[1001].score + 5 and abs(got[1000].base_score - got[1001].base_score) < 1e-9


def test_attention_sums_to_one_and_is_causal():
    model = attention.start(np.ones((attention.CLASSES + 1, attention.CLASSES)) / attention.CLASSES)
    draw = np.random.default_rng(2)
    flat = draw.integers(0, attention.CLASSES, 150).astype(np.int16)
    inputs, target, _ = attention.windows(flat, np.array([100, 50]))
    assert sorted(target[target >= 0].tolist()) == list(range(150))  # each target once
    logits = attention.forward(model, inputs)[-1]
    changed = flat.copy()
    changed[60:100] = 0
    again = attention.forward(model, attention.windows(changed, np.array([100, 50]))[0])[-1]
    before = (target >= 0) & (target <= 60)
    assert np.allclose(logits[before], again[before], atol=1e-5) and not np.allclose(logits, again, atol=1e-3)
    shares = sum(np.exp(attention.log_shares(logits.copy(), np.full(target.shape, i))) for i in range(attention.CLASSES))
    assert np.allclose(shares, 1, atol=1e-4)


def test_attention_gradient_and_training():
    model = {k: v.astype(np.float64) for k, v in attention.start(np.ones((attention.CLASSES + 1, attention.CLASSES)) / attention.CLASSES).items()}
    flat = np.random.default_rng(3).integers(0, 20, 90).astype(np.int16)
    inputs, target, _ = attention.windows(flat, np.array([90]))
    goal, held = flat[np.maximum(target, 0)].astype(np.int64), target >= 0
    loss = lambda m: -(attention.log_shares(attention.forward(m, inputs)[-1], goal) * held).sum() / held.sum()
    slopes = attention.gradient(model, inputs, goal, held)
    for name, at in [("q", (1, 2)), ("k", (3, 4)), ("v", (5, 6)), ("o", (7, 8)), ("out", (9, 3)), ("embed", (int(flat[5]), 3)), ("place", (30, 2)), ("bias", (int(flat[5]), 4)), ("second", (int(flat[5]), 4))]:
        up, down = ({k: v.copy() for k, v in model.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - slopes[name][at]) < 2e-4 + 0.05 * abs(slopes[name][at]), name
    small = attention.start(np.ones((attention.CLASSES + 1, attention.CLASSES)) / attention.CLASSES)
    text = [np.array([1, 2, 3, 4, 5] * 40, np.int16)]
    score = lambda m: attention.score(m, text[0], np.array([200]))[0]
    assert score(attention.train(small, text)) > score(small) / 4


def test_pipeline_stages(spark, docs):
    documents = common.read(spark, SF, "documents")
    columns, before = documents.columns, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.io.store(stage(spark, before, SF))
        assert after.columns == columns and 0 < after.count() <= before.count(), name
        if name == "near copies":
            assert {r.doc_id for r in after.collect()} == {d for d, _, c in expected_components([(r.doc_id, r.text) for r in before.collect()]) if d == c}
        if name == "lines":
            assert after.where("n_chars <> length(text)").count() == 0 and after.count() == before.count()
        before = after
    assert corpus_pipeline.encode(spark, before, SF).count() == before.count() == corpus_pipeline.run(spark, SF).count()
    odd = docs((1, None), (2, ""), (None, "x"), (3, "a" * 100_000))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, odd, SF).columns == odd.columns and stage(spark, odd, SF).count() >= 3, name
        assert stage(spark, odd.limit(0), SF).count() == 0
