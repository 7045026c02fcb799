"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from crawlsift.llm import common

MARK = "▁"
# A chunk is a run of marks with what follows, or a newline with what follows, up to the next mark or newline.
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")


def split(text: str) -> list[str]:
    """Chunks of a text: words without their mark, or beginning with a newline where no mark stands before them."""
    if "  " in text or MARK in text or text[:1] == " ":  # runs of marks stay together
        return [x if x[0] == "\n" else x[1:] for x in CHUNK.findall(MARK + text.replace(" ", MARK))]
    return text.replace("\n", " \n").split(" ") if text else []


class Chunks:
    """The distinct chunks that a worker has met, each segmented once.

    No piece of the model holds a mark behind another character, nor a newline, so byte-pair merges never cross a chunk's
    ends: the ids of a text are the ids of its chunks in order. `check` proves that for the vocabulary at hand.
    """

    def __init__(self, model: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        self.check()
        self.table = common.IdTable(self.segment)

    def check(self) -> None:
        """Refuse a model whose pieces may cross chunks or whose normaliser changes text."""
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", piece) for piece in pieces):
            raise ValueError("pieces of this model cross white space")
        if self.model.normalize("a  Ａ ") != f"{MARK}a{MARK}{MARK}Ａ{MARK}":
            raise ValueError("this model's normaliser isn't the identity")

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks. The model puts a mark before what it encodes; before a newline that is a piece of its own and is cut off."""
        return [x[1:] if chunk[:1] == "\n" else x for chunk, x in zip(chunks, self._encode(chunks), strict=True)]

    def _encode(self, chunks: list[str]) -> list[list[int]]:
        alone = self.model.piece_to_id(MARK)
        return [x or [alone] for x in self.model.encode(chunks, num_threads=1)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with the end id behind each, and the offsets of the texts."""
        return common.with_end(*self.table.rows([split(x) for x in texts]), self.model.eos_id())


@functools.lru_cache(maxsize=2)
def chunks(model: str) -> Chunks:
    """A table for a model that a worker keeps from task to task."""
    return Chunks(model)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `ids` (pieces and the end id) and `decoded` of every row.

    Each task keeps a table of the distinct marked words it has met, segments a word once and joins the ids back by position;
    the table is bounded, and nothing is shuffled. Ids equal `SentencePieceProcessor.encode(text, add_eos=True)`, `decoded` its
    `decode(ids)`. A null text counts as empty: only the end id. Repeated rows stay rows of their own, null ids stay null, an
    empty table gives no rows, other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Chunks(model)  # dropped with the task
        for whole in batches:
            for batch in common.sliced(whole, 1):
                ids, offsets = table.encode([x or "" for x in batch.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists, pa.array(table.model.decode(lists.to_pylist()), pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return common.small_batches(docs).select(doc_id, text).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def report(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number of ids, digest of the ids and of the decoded text."""
    return encode(docs, model).selectExpr(
        "id AS doc_id", "CAST(size(ids) AS bigint) AS n_tokens", "sha2(array_join(ids, ' '), 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256")
