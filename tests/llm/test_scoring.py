"""Scores of whole texts against their word-count base."""

import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from crawlsift.llm import attention, scoring
from crawlsift.llm.registry import PIECES


def made_up(rows, words, seed=5):
    """Texts in two tongues of made-up words, a good part of them found once."""
    draw = np.random.default_rng(seed)
    tongues = [["ka", "ro", "mi", "tu", "sen"], ["ble", "sh", "nd", "tion", "the"]]
    return [(i, " ".join("".join(draw.choice(tongues[i % 2], draw.integers(1, 6))) for _ in range(words))) for i in range(rows)]


def test_unseen_texts_score_above_their_base(docs):
    got = scoring.report(docs(*made_up(300, 60)), PIECES).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert got[2] > 10 and got[0] > got[1]


def test_words_are_known_by_their_leading_subword():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["House " + "HOUSES" * 3 + " über ÜBER 123", "house  x" + "y" * 500]
    data, start, stop, value, _ = scoring.words.located([x.encode() for x in texts])
    distinct, first = np.unique(value, return_index=True)
    leads = scoring.Leads(PIECES)
    for _ in range(2):  # met, and known
        got = leads.of(distinct, data, start[first], stop[first])
        for i, lead in zip(first, got, strict=True):
            word = data[start[i]:stop[i]].tobytes()[:scoring.LEAD_BYTES].lower().decode(errors="ignore")
            assert lead == [x for x in model.encode(word) if model.id_to_piece(x) != "▁"][0]


def test_every_subword_of_every_word_is_scored(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, "Incomprehensibilities %d  NOTWITHSTANDING\tüberÜber counterrevolutionary" % i) for i in range(40)]
    rows += [(100, None), (101, "x" * 70 + "é" * 300 + " end"), (None, "notwithstanding ▁ a▁b")]
    prepared = scoring.prepare(docs(*rows), PIECES)
    got = {r.doc_id: np.frombuffer(r.ids, "<u2") for r in prepared.where(F.col("kind") == scoring.DOCUMENT).collect()}
    for i, text in rows:
        found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        assert got[i].tolist() == [x for w in found for x in model.encode(w.lower().decode()) or [model.piece_to_id("▁")]] + [model.eos_id()]
    seen = np.bincount(np.concatenate([got[r.doc_id] for r in prepared.where("kind = 0 AND NOT held_out").select("doc_id").collect()]), minlength=model.get_piece_size())
    marked = np.array([model.id_to_piece(i).startswith("▁") for i in range(model.get_piece_size())], np.int64)
    weights, kind, share = scoring.fit(prepared, seen, marked, model.eos_id())
    for r in scoring.report(docs(*rows), PIECES).collect():
        ids = got[r.doc_id]
        want = attention.score(weights, kind[ids], np.array([len(ids)]))[0]
        before = attention.START
        for x in ids.tolist():
            want, before = want + share[before, x], kind[x]
        assert r.score == pytest.approx(want, rel=1e-4)


def test_long_words_are_spelled_whole(monkeypatch):
    monkeypatch.setattr(scoring, "RUN_BYTES", 7)
    monkeypatch.setattr(scoring, "LEAD_BYTES", 5)
    texts = ["short " + "Länge€" * 30 + " mid " + "a" * 20, "short " + "b" * 7]
    data, start, stop, value, _ = scoring.words.located([x.encode() for x in texts])
    distinct, first = np.unique(value, return_index=True)
    leads = scoring.Leads(PIECES)
    for _ in range(2):
        flat, size = leads.spelled(distinct, data, start[first], stop[first])
        for i, ids in zip(first, np.split(flat, np.cumsum(size)[:-1]), strict=True):
            assert leads.model.decode(ids.tolist()).replace(" ", "") == data[start[i]:stop[i]].tobytes().lower().decode()
    assert len(leads.keys) == 2  # the two of five bytes and less


def test_scores_of_classes_equal_the_whole_output():
    draw = np.random.default_rng(6)
    chance = draw.random((attention.CLASSES + 1, attention.CLASSES))
    model = attention.start(chance / chance.sum(1, keepdims=True))
    model["second"] += draw.standard_normal(model["second"].shape).astype(np.float32) / 3
    flat, sizes = draw.integers(0, attention.CLASSES, 4000), np.array([1, 48, 49, 1900, 2002])
    inputs, target, doc = attention.windows(flat, sizes)
    whole = attention.log_shares(attention.forward(model, inputs)[-1], flat[np.maximum(target, 0)]) * (target >= 0)
    assert np.allclose(attention.score(model, flat, sizes) * np.log(10), np.bincount(doc, whole.sum(1), 5), rtol=1e-4)


def test_a_text_seen_once_among_many_stays_rare():
    usual, odd = np.array([1, 2, 3, 4, 5, 6, 7] * 6 + [0], np.int16), np.array([6, 4, 7, 1, 5, 3, 2, 0], np.int16)
    chance = np.full((attention.CLASSES + 1, attention.CLASSES), 1e-4)
    for a, b in [*zip([attention.START, *usual[:-1]], usual, strict=True)]:
        chance[a, b] += 1
    model = attention.train(attention.start(chance / chance.sum(1, keepdims=True)), [usual] * 200 + [odd])
    assert attention.score(model, odd, np.array([8]))[0] < -10 < attention.score(model, usual, np.array([43]))[0]
