"""Tables of distinct words against the tokenizer libraries, and their bounds."""

from __future__ import annotations

import random

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from crawlsift.llm import pieces, token_files, words
from crawlsift.llm.registry import PIECES, WORDS

PARTS = [
    "a", "B", "é", "É", "İ", "ß", " ", "  ", "\n", "\r\n", "\t", " ", "　", "'s", "'S", "'ll", "1", "23", "%", "...", ",", ".", "<|", "<|endoftext|>",
    "<|ENDOFTEXT|>", "|>", "中", "文", "ก", "́", "😀", "don't", "Σ", "ς", "\x0b", " ", " word", "word.", "The", "-", "_", "ﬁ", "K", "\x00"]


def odd_texts(n):
    draw = random.Random(7)
    return ["", " ", "\n", ".", "a.", "a. b", "x" * 5000 + ".", *("".join(draw.choice(PARTS) for _ in range(draw.randrange(14))) for _ in range(n))]


def check(table, texts, want, *end):
    for i in range(0, len(texts), 300):
        part = texts[i:i + 300]
        ids, offsets = table(part, *end)
        for x, a, b in zip(part, offsets, offsets[1:], strict=False):
            assert ids[a:b].tolist() == want(x), repr(x)


def test_word_ids_equal_the_library():
    tokenizer, texts, table = Tokenizer.from_file(WORDS), odd_texts(6000), token_files.Words(WORDS)
    want = lambda x: [*tokenizer.encode(x, add_special_tokens=False).ids, 2]
    check(lambda part: table.encode([x.encode() for x in part], 2), texts, want)
    small = token_files.Words(WORDS, limit=2000)  # starts anew all the time
    check(lambda part: small.encode([x.encode() for x in part], 2), texts, want)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(words, "mix", lambda x: x & np.uint64(7))  # every table of this test is full of collisions
    tokenizer, table = Tokenizer.from_file(WORDS), token_files.Words(WORDS)
    texts = ["the quick brown fox", "jumps over. the lazy dog", "", "quick quick the"]
    ids, offsets = table.encode([x.encode() for x in texts], 2)
    for x, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == [*tokenizer.encode(x, add_special_tokens=False).ids, 2]


def test_piece_table_is_bounded_and_equal():
    model, table, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.Chunks(PIECES), odd_texts(3000)
    table.table.limit = 20_000
    check(table.encode, texts, lambda x: model.encode(x, add_eos=True))
    assert table.table.bytes < 400_000


def test_powers_of_long_words_are_not_kept():
    long = b"x" * (words.SEGMENT * 3)
    value = words.hashed([long, b"a b", long])[0]
    assert value[0] == value[3] and len(words._usual_powers()[0]) == words.SEGMENT * 2


def test_words_with_marks_behind_them_are_not_learnt_anew():
    tokenizer, table = Tokenizer.from_file(WORDS), token_files.Words(WORDS)
    marks = ["", "%%%", ".###", "...", "(a", "-Bé!", "'s", ".'s", "'.s", "!'re"]
    texts = [f"{word}{mark} {word}" for word in ("plain", "MÉXICOñ", "×", "naïve÷", "é", "“", "日本") for mark in marks]
    ids, offsets = table.encode([x.encode() for x in texts], 2)
    want = [tokenizer.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    before = len(table.hash)
    for mark in marks[1:4]:
        table.encode([f"plain{mark} mÉxicoñ{mark}".replace("É", "é").encode()], 2)
    known = {table.bytes[a:a + n].tobytes() for a, n in table.place[:2].T.tolist()}
    assert b"plain" in known and not {b"plain%%%", b"plain.###", b"plain..."} & known and len(table.hash) - before <= 4
