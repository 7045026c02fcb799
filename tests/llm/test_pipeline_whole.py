"""The whole pipeline, and its classifier, against plain Python; columns named like those that the stages make on their way."""

from __future__ import annotations

import collections
import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from crawlsift.llm import common, decontamination, jaccard, line_dedup, quality
from tests.llm.test_corpus_operators import SF, expected_components
from tests.llm.test_text_operators import expected_lines

CLASHES = (
    "__p", "__at", "__place", "__sp", "__np", "__sh", "__nh", "__quality", "__leaks", "__first", "___first", "__doc", "__body", "__drops",
    "__digest", "__all", "__gone", "__kept", "__lines", "__DROPPED")


def posteriors(rows, model):
    """(id, source, lang, text) rows: the posterior of each by loops over hosts and paths."""
    p = [float(model.probability(quality.measures([(t or "").encode()]))[0]) for *_, t in rows]
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for (_, host, path, _), x in zip(rows, p, strict=True):
        hosts[host].append(x)
        paths[host, path].append(x)
    mean = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)

    def pull(groups):
        spread = sum(len(g) * (np.mean(g) - above) ** 2 for g, above in groups)
        chance = sum(above * (1 - above) for _, above in groups)
        between = max(spread - chance, 0) / sum(len(g) for g, _ in groups)
        return min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1e6)

    def logit(x):
        x = min(max(x, 1e-6), 1 - 1e-6)
        return np.log(x / (1 - x))

    by_host = pull([(g, mean) for g in hosts.values()])
    rate = {h: (by_host * mean + sum(g)) / (by_host + len(g)) for h, g in hosts.items()}
    by_path = pull([(g, rate[h]) for (h, _), g in paths.items()])
    out = []
    for (_, host, path, _), x in zip(rows, p, strict=True):
        own_host = (by_host * mean + sum(hosts[host]) - x) / (by_host + len(hosts[host]) - 1)
        own_path = (by_path * own_host + sum(paths[host, path]) - x) / (by_path + len(paths[host, path]) - 1)
        out.append(1 / (1 + np.exp(-(logit(x) - logit(model.prior) + logit(own_path)))))
    return out


def test_quality_equals_loops(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    model = quality.fit(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "text").collect()]
    want = dict(zip((r[0] for r in rows), posteriors(rows, model), strict=True))
    got = {r.doc_id: r["__quality"] for r in quality.posterior(docs, model, F.col("source"), F.col("lang")).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_pipeline_equals_plain_python(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "text").collect()]
    good = [(i, t or "") for (i, _, _, t), p in zip(rows, posteriors(rows, quality.fit(docs, labels)), strict=True) if p >= 0.5]
    # lines: keys that five documents hold stay in the largest id only
    held = collections.defaultdict(set)
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\f\r"))
    for i, t in good:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    lines = [(i, "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i)) for i, t in good]
    assert sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in lines) == sorted((r[0], r[3]) for r in expected_lines(good))
    firsts = {i for i, _, c in expected_components(lines) if i == c}
    # benchmark: every pair of text and item by itself, without joins over the corpus
    items = [r.text for r in common.read(spark, SF, "benchmark").collect()]
    blocks = [decontamination.Block([(0, x)], 13) for x in items]
    left = [(i, t) for i, t in lines if i in firsts and not any(b.leaks([t.encode()])[0] for b in blocks)]
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = {}
    for i, t in left:
        ids = library.encode(t, add_eos=True)
        want[i] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_columns_of_clashing_names_come_back_as_they_were(spark, docs):
    line = "a line that many documents repeat, and of at least forty characters"
    item = "which of the seven old ships in the harbour of the small town sank first that winter"
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)) + f"\n{line}") for i in range(6)] + [(10, "near copy " * 9), (11, "near copy " * 9), (12, item), (None, None), (13, "")]
    table = docs(*rows)
    for i, name in enumerate(CLASHES):
        table = table.withColumn(name, F.concat(F.lit(f"{i} of "), F.coalesce("doc_id", F.lit(-1))))
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1)], "doc_id bigint, quality int")

    def same(found, ids):
        made = [r.asDict() for r in found.collect()]
        assert sorted(str(r["doc_id"]) for r in made) == sorted(map(str, ids))
        for r in made:
            assert [r[x] for x in CLASHES] == [f"{i} of {-1 if r['doc_id'] is None else r['doc_id']}" for i in range(len(CLASHES))]
        return made

    ids = [i for i, _ in rows]
    assert all(0 <= r["___quality"] <= 1 for r in same(quality.keep(table, labels, 0.0), ids))
    assert {r["doc_id"]: r["___dropped"] for r in same(line_dedup.apply(table, line_dedup.keep_bitmaps(table)), ids)} == {
        i: int(i in range(5)) for i in ids}
    assert {r["doc_id"] for r in same(decontamination.mark(table, bench), ids) if r["___leaks"]} == {12}
    clean = same(decontamination.clean(table, bench), [i for i in ids if i != 12])
    assert list(clean[0]) == table.columns
    same(jaccard.first_of_each(table), [i for i in ids if i != 11])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, SF).columns == table.columns, name
