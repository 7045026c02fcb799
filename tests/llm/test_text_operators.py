"""Operators on single texts: WARC, pieces, token files, line dedup, winnowing."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crawlsift.llm import line_dedup, pieces, token_files, warc, winnowing
from crawlsift.llm.registry import PIECES, WORDS
from crawlsift.sources import io

ODD = [
    "", None, " ", "\n", "a", " a", "a ", "  two  runs   here ", "tab\tand\x0bfeed\x0c", "Ends. With, stops.\nNext!. line...", "▁mark ▁▁ marks",
    "line\n\n\nmany \n lines\n", "é ÉCOLE naïve Straße ΣΑΣ İ ﬁ", "<s> </s> <unk> <|endoftext|> <|ENDOFTEXT|>", "日本語 テキスト", "it's I'll 've 12 345.6,7", "á b c d",
    "\u0000 zero", "x" * 5000, "word " * 3000, "same text", "same text"]


def test_pieces_equal_the_library(docs):
    rows = list(enumerate(ODD))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r for r in pieces.report(docs(*rows, (None, "no id")), PIECES).collect()}
    assert len(got) == len(rows) + 1
    for i, text in rows:
        ids = model.encode(text or "", add_eos=True)
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest(), text
    assert pieces.report(docs((1, "x")).limit(0), PIECES).count() == 0


def test_pieces_of_random_texts():
    draw, model, table = random.Random(3), sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.chunks(PIECES)
    texts = ["".join(draw.choice(["a", "the", " ", "  ", "\n", "▁", "ü", "ing", ".", "\t"]) for _ in range(draw.randrange(12))) for _ in range(3000)]
    ids, offsets = table.encode(texts)
    for text, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == model.encode(text, add_eos=True), text


def test_token_files_equal_the_library(docs, spark):
    rows = list(enumerate(ODD))
    random.Random(1).shuffle(rows)
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    got = {r.doc_id: r for r in token_files.report(docs(*rows), WORDS).collect()}
    for i, text in enumerate(ODD):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc), text
        start += len(ids)
    assert token_files.report(docs((1, "x")).limit(0), WORDS).count() == 0
    path = io.shared_dir(spark) + "/ids"
    token_files.write(docs((None, "b"), (2, "b"), (2, "a"), (2, "a")), WORDS, path)
    assert [r.doc_id for r in token_files.read(spark, path).orderBy("start").collect()] == [None, 2, 2, 2]
    plan = token_files.read(spark, path).where("doc_id = 2")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(doc_id,2\)", plan)


def expected_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders: dict[str, set] = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out)


def test_lines_equal_brute_force(docs):
    a, b = "this very line stands in many documents of all", "É" * 40
    rows = [(i, "\n".join([a, "own %d" % i, "  " + a.upper() + "\t", *([b] * (i % 3)), *["short"] * (i * 40), a])) for i in range(9)]
    rows += [(20, None), (21, ""), (22, "\n\n"), (23, a[:39]), (24, a), (25, a + "\r"), (25, a + "\r")]
    got = line_dedup.report(docs(*rows)).collect()
    assert sorted(tuple(r) for r in got) == expected_lines(rows)
    assert line_dedup.report(docs((1, a)).limit(0)).count() == 0
    assert line_dedup.report(docs(*[(None, a)] * 9)).where("n_dropped > 0").count() == 0


def test_line_bitmaps_are_sparse_and_plan_is_native(docs):
    a = "this very line stands in many documents of all"
    rows = [(i, "\n".join(["x"] * 200 + [a])) for i in range(5)]
    found = line_dedup.keep_bitmaps(docs(*rows)).orderBy("doc").collect()
    assert [(r.doc, [tuple(x) for x in r.drops]) for r in found] == [(i, [(3, 1 << 8)]) for i in range(4)]
    assert not re.search("Python|Arrow|Pandas", line_dedup.report(docs(*rows))._jdf.queryExecution().toString())


def winnow(text, k=5, window=8):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    grams = [tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 0))] if len(words) >= k else [tuple(words)] if words else []
    return grams


def test_fingerprints(docs, spark):
    draw = random.Random(5)
    words = ["w%d" % draw.randrange(300) for _ in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words[60:120])), (3, " ".join(words)), (4, None), (5, ""), (6, "one two"), (7, "a" * 2000), (8, "x " * 500), (9, "x " * 500)]
    table = docs(*rows).select("doc_id", "text", winnowing.fingerprint("text").alias("f"))
    prints = {r.doc_id: [(x.hash, x.pos) for x in r.f] for r in table.collect()}
    assert prints[1] == prints[3] and prints[8] == prints[9] and prints[4] == prints[5] == [] and len(prints[6]) == 1
    grams = {i: spark.createDataFrame([(n, list(g)) for n, g in enumerate(winnow(text))], "n int, g array<string>").select(
        "n", F.expr("xxhash64(xxhash64(g[0]), xxhash64(g[1]), xxhash64(g[2]), xxhash64(g[3]), xxhash64(g[4]))").alias("h")).orderBy("n").collect()
        for i, text in rows[:2]}
    for i, found in grams.items():
        h = [r.h for r in found]
        picks = {max(range(a, a + 8), key=lambda j: (-h[j], j)) for a in range(len(h) - 7)}
        assert prints[i] == [(h[j], j) for j in sorted(picks)]
    assert {x for x, _ in prints[1]} & {x for x, _ in prints[2]}


def test_next_documents_and_edits(docs):
    rows = [(i * 7 % 50, ("é%d " % i) * (i % 9)) for i in range(50)]
    got = {r.doc_id: r for r in winnowing.report(docs(*rows)).collect()}
    by = sorted(rows)
    for (i, text), (_, after) in zip(by, by[1:] + by[:1], strict=True):
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert winnowing.report(docs((4, "only one"))).first().near_next == 1.0
    assert winnowing.report(docs((None, "a"), (None, None), (3, "b"), (3, "b"))).count() == 4
    assert winnowing.report(docs((1, "x")).limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", winnowing.report(docs(*rows))._jdf.queryExecution().toString())


@pytest.fixture(scope="module")
def pages(spark):
    odd = "WARC/1.0\r\nContent-Length: 5\r\n\r\nfiledesc://x\n\nhttp://a 0 0 0 3\nabc"
    rows = [
        (3, "http://a/", "<p>same</p>"), (1, "http://b/", "<p>same</p>"), (2, None, None), (4, "http://c/ d\n", ""), (5, "http://é/", "ünï\r\n\r\n\n"),
        (6, "u", odd), (7, "u", odd + "\n"), (None, "http://n/", "<p>same</p>"), (8, "", "\n"), (9, "x", "y" * 300_000), (1, "http://b/", "<p>same</p>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS value", "2 AS file", "3 AS digest").repartition(3)


def test_arc_becomes_warc(pages, spark):
    got = warc.report(pages).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        data = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min((x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None), default=None)
        found = next(x for x in got if x.page_id == r.page_id)
        assert (found.payload_bytes, found.payload_digest) == (len(data), digest)
        assert (found.record_type, found.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
        assert found.record_date == "1997-01-01T00:00:00Z"
    assert warc.report(pages.limit(0)).count() == 0


def test_arc_of_old_crawlers(spark, tmp_path):
    body = "1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n"
    head = f"filedesc://old.arc 0.0.0.0 19960101 text/plain {len(body)}\n{body}"
    bare = "HTTP/1.0 200 OK\nServer: x\nX-Page-Id: 4\n\n<p>a</p>\r\n\r\nb"
    mixed = "HTTP/1.0 200 OK\r\nX-Page-Id: 5\n\r\nsame"
    same = "HTTP/1.0 200 OK\nX-Page-Id: 6\n\nsame"
    none = "HTTP/1.0 304 Not Modified\nX-Page-Id: 7\n"
    records = [
        ("http://h/a b  c", "1.2.3.4", "19960102030405", "text/html", bare), ("http://h/", "5.6.7.8", "19960102", "text/html; charset=x y", mixed),
        ("http://i/", "0.0.0.0", "19960103", "text/html", same), ("http://j/", "-", "19960103", "no-type", none)]
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.txt").write_bytes((head + "".join(
        f"\n{u} {ip} {d} {m} {len(b)}\n{b}\n" for u, ip, d, m, b in records)).encode())
    got = {r.page: r for r in warc.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert {k: (r.uri, r.ip, r.mime, r.kind) for k, r in got.items()} == {
        str(4 + i): (u, ip, m, "response") for i, (u, ip, _, m, _) in enumerate(records)}
    payloads = {"4": b"<p>a</p>\r\n\r\nb", "5": b"same", "6": b"same", "7": b""}
    assert {k: (r.payload_bytes, r.digest) for k, r in got.items()} == {k: (len(x), warc.base32_sha1(x)) for k, x in payloads.items()}
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    found = {r.page: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert found == {"4": ("response", len(payloads["4"]), None), "5": ("response", 4, None), "6": ("revisit", 4, "5"), "7": ("response", 0, None)}
    lines = {r.value.strip() for r in spark.read.text(str(tmp_path / "warc")).collect()}
    assert {x for x in lines if x.startswith("WARC-IP")} == {"WARC-IP-Address: 1.2.3.4", "WARC-IP-Address: 5.6.7.8"}


def test_arc_versions_and_broken_archives(spark, tmp_path):
    assert [warc.iso_date(x) for x in ("19960923142103", "199609231421", "19960923", "junk", "")] == [
        "1996-09-23T14:21:03Z", "1996-09-23T14:21:00Z", "1996-09-23T00:00:00Z", "0000-01-01T00:00:00Z", "0000-01-01T00:00:00Z"]
    body = "1 0 Old\nURL IP-address Archive-date Content-type Archive-length\n"
    head = f"filedesc://old.arc 0.0.0.0 19960101 text/plain {len(body)}\n{body}"
    (tmp_path / "good.txt").write_text(head + "\ndns:host 1.2.3.4 199601020304 text/dns 4\nabc\n\nftp://x/ 1.2.3.4 19960102 text/plain 3\nxyz\n")
    got = warc.read_arc(spark, str(tmp_path / "good.txt")).orderBy("uri").collect()
    assert [(r.uri, r.kind, r.date, bytes(r.block)) for r in got] == [
        ("dns:host", "response", "1996-01-02T03:04:00Z", b"abc\n"), ("ftp://x/", "resource", "1996-01-02T00:00:00Z", b"xyz")]
    (tmp_path / "bad.txt").write_text(head + "\nftp://x/ 1.2.3.4 19960102 text/plain 300\nxyz\n")
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_arc(spark, str(tmp_path / "bad.txt")).collect()
