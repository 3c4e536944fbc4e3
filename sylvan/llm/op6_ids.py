"""Token-ID output: ORC files of token ids, ordered by document id."""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm import bpe, common

#: Most chunks whose ids a worker remembers.
MEMO = 300_000
#: Rows of a row-index entry, and bytes of a stripe.
ROW_INDEX, STRIPE = 1000, 16 << 20
#: About so many bytes of Parquet go to one ORC file; there are as many files as shuffle partitions at least.
FILE_BYTES = 32 << 20


class Encoder:
    """Ids of whole texts as the file's normalizer, splitter and merges give them, packed as little-endian 32-bit integers.

    Chunks between white space don't influence each other, so each is encoded once and remembered.
    """

    def __init__(self, merger: bpe.Merger):
        import regex

        self.merger, self.find = merger, regex.compile(bpe.WORD_LEVEL).findall
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(merger.special, key=len, reverse=True)) + ")")
        self.memo = bpe.Recent(self._chunk, MEMO)

    def _chunk(self, word: str) -> bytes:
        if bpe.unsettled(word):
            return array("I", bpe.library(self.merger.path).encode(word, add_special_tokens=False).ids).tobytes()
        ids: list[int] = []
        for part in self.special.split(word) if "<|" in word else [word]:
            if part in self.merger.special:
                ids.append(self.merger.special[part])
                continue
            # one character at a time: no final sigma
            plain = part.lower() if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            if plain.isalpha() and "'" not in plain:  # the usual case needs no splitter
                ids += self.merger.pieces(plain.encode())
            elif plain[:-1].isalpha() and plain[-1] in ".,!":
                ids += self.merger.pieces(plain[:-1].encode()) + self.merger.pieces(plain[-1].encode())
            else:
                for t in self.find(plain):
                    ids += self.merger.pieces(t.encode())
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        # str.split() also parts at the separators 0x1C to 0x1F, which are no white space here
        words = re.split(r"[^\S\x1c-\x1f]+", text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.memo.__getitem__, words))


_SEPARATORS = re.compile("[\x1c-\x1f]")


def _encoded(encoder: Encoder, batch: pa.RecordBatch, end: bytes) -> pa.RecordBatch:
    packed = [encoder.encode(t) + end for t in batch.column(1).to_pylist()]
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    ids = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["doc_id", "ids"])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Writes (doc_id, ids) as ORC: file after file, and row after row in a file, in ascending doc_id order.

    Ids are int columns in ORC's integer run-length encoding; every stripe has a row index, and a Bloom filter on doc_id,
    so that readers prune stripes by metadata and take the others in parallel. Null texts are empty documents (just the
    end id); null doc_ids come first; equal doc_ids stand together, by a hash of their text and the text, and may fill
    several files; an empty table gives a table without rows. The range shuffle moves texts, which are smaller than their
    ids. `files` follows the bytes of `docs` unless it is given.
    """
    spark = common.tune(docs.sparkSession)
    merger = spark.sparkContext.broadcast(bpe.merger(tokenizer))  # as large as the vocabulary
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.local(Encoder, merger.value)
        for b in batches:
            yield _encoded(encoder, b, end)

    rows = common.doc_text(docs, id_col, text_col)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.input_bytes(rows) // FILE_BYTES)
    # a doc_id, or null, of a great many rows is split by the hash of their texts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    out = rows.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, ids array<int>")
    out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(ROW_INDEX)).option("orc.stripe.size", str(STRIPE)).option("orc.create.index", "true").option("compression", "snappy").orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; a list of doc_ids is pushed down to the files' indexes and Bloom filters."""
    rows = spark.read.schema("doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: place in the whole stream, length and checksum of each document.

    Files are in order by name, and rows in a file by their place, so starts are running sums in a file plus the sums of
    earlier files; only one number a file is summed in one place.
    """
    common.tune(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            flat, at = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False)).astype("<i4", copy=False)).cast("B"), np.asarray(ids.offsets)
            at = (at - at[0]).astype(np.int64) * 4
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at) // 4, pa.int64()), pa.array(crc, pa.int64()), b.column(2), b.column(3)], names=["doc_id", "n_tokens", "ids_crc32", "file", "block"])

    place = read_ids(spark, path).select("doc_id", "ids", F.element_at(F.split("_metadata.file_name", "-"), 2).cast("int").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("block"))
    rows = common.written(place.mapInArrow(common.lean(run), "doc_id long, n_tokens long, ids_crc32 long, file int, block struct<at:long,row:long>"), "op6-digest")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("base"))
    inside = Window.partitionBy("file").orderBy("doc_id", "block").rowsBetween(Window.unboundedPreceding, -1)
    # `rows` is small beside the texts, and read when the result is
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(before, "file").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "op6-ids")
    write_ids(common.table(spark, sf_dir, "documents"), path, common.tokenizer_path("word_bpe_49k.json"))
    return digest(spark, path)
