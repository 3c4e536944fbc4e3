"""Token counts: whole-token shortcut over a byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import bpe, common

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Most chunks whose counts a worker remembers.
MEMO = 400_000


class _Odd(Exception):
    """A chunk whose white space reaches over its edge."""


class Counter:
    """Counts the tokens of texts. Every chunk between single spaces is split into pre-tokens on its own; a pre-token that
    is proven whole counts one, the rest are merged. Texts with runs of spaces are split as a whole."""

    def __init__(self, merger: bpe.Merger):
        import regex

        self.merger, self.find = merger, regex.compile(bpe.BYTE_LEVEL).findall
        self.whole = {t for s in merger.whole if (t := _text(s)) is not None and self.find(t) == [t]}
        self.memo = bpe.Recent(self._chunk, MEMO)

    def _pretokens(self, text: str) -> int:
        if bpe.unsettled(text):
            return len(bpe.library(self.merger.path).encode(text, add_special_tokens=False).ids)
        n = 0
        for t in self.find(text):
            n += 1 if t in self.whole else len(self.merger.pieces(t.encode()))
        return n

    def _chunk(self, word: str) -> int:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        return self._pretokens(" " + word)

    def count(self, text: str) -> int:
        parts, n = bpe.split_special(text, self.merger.special)
        for part in parts:
            first, *rest = part.split(" ")
            try:
                if first[-1:].isspace() or (not first and rest):
                    raise _Odd
                n += self._pretokens(first) + sum(map(self.memo.__getitem__, rest))
            except _Odd:
                n += self._pretokens(part)
        return n


def _text(s: bytes) -> str | None:
    try:
        return s.decode()
    except UnicodeDecodeError:
        return None


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs`.

    Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows give repeated rows; an empty table
    gives an empty one; other columns are ignored. Texts are never cut. One pass, no shuffle.
    """
    spark = common.tune(docs.sparkSession)
    proven = spark.sparkContext.broadcast(bpe.merger(tokenizer))  # as large as the vocabulary, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = bpe.local(Counter, proven.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return common.doc_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"))
