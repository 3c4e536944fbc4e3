"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted verification.

A document's windows have as many words as an item. Their fingerprints are looked up in blocks: two fingerprints within the
radius have a block in which they differ in a few bits at most, so the blocks' lists hold every item within it. What they give
is verified by the weighted similarity of whole shingle sets. Windows that hold less of the benchmark's shingles than any item
of their size asks for can't reach the similarity and are not fingerprinted; which items a window meets, the blocks tell.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import common
from sylvan.llm import shingles as sh

#: Least weighted similarity of shingles (sums of weights are compared to within a billionth).
SIMILARITY = 0.75
#: Bits of a fingerprint, and the radius in which all are found. A similarity of 0.75 is a cosine of 0.857 at least, which is 22
#: bits on average with a deviation of 4.3. An item's best window has neighbours that are nearly as good, and one is enough:
#: measured, 99.3 % of items between 0.751 and 0.765 are found, 99.7 % up to 0.78, and all of those above.
BITS, RADIUS, BLOCK = 128, 26, 16
BLOCKS = BITS // BLOCK
#: Two fingerprints within the radius differ in 3 bits at most in one of the first three blocks or in 2 in one of the others (else
#: they differ in 3 * 4 + 5 * 3 bits). Items are listed under values that differ in up to 1 bit from theirs, and windows ask
#: for values that differ in up to 2 or 1. Of unlike items 4 % pass.
LISTED, ASKED = 1, (2, 2, 2, 1, 1, 1, 1, 1)
#: Bytes of item texts that one scan of the documents takes along (about 15 times as much in memory); more items, more scans.
CHUNK_BYTES = 8 << 20
#: Windows that are fingerprinted at a time.
WINDOWS = 2048
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"

#: Letters of ASCII in lower case, digits and all bytes over 0x7F stay; the rest are gaps between words.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def width_of(n_words: int) -> int:
    """Words of a shingle for an item of so many words: five, or all of them."""
    return min(sh.WIDTH, n_words)


def shingled(text: bytes) -> tuple[np.ndarray, int]:
    """An item's shingles in order, and its number of words."""
    w = words_of(text)
    return sh.shingle_hashes(sh.word_hashes(w)), len(w)


@functools.lru_cache
def masks(bits: int, width: int = BLOCK) -> np.ndarray:
    """All numbers of `width` bits of which up to `bits` are set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in itertools.combinations(range(width), k)], np.uint16)


def fingerprints(h: np.ndarray, weight: np.ndarray, run: int) -> np.ndarray:
    """SimHash of each run of `run` shingles, as two 64-bit numbers. Votes have the square root of the weights, for then the
    cosine of two windows is the weight that they share over the mean of their weights. A shingle votes on each bit with an
    odd number from -255 to 255, not just with a sign: small windows would else be at a draw on many bits. Votes are whole
    numbers, so sums are the same wherever a window stands."""
    votes = np.rint(256 * np.sqrt(weight)).astype(np.int64)
    with np.errstate(over="ignore"):
        both = np.stack([sh.mix(h), sh.mix(h + np.uint64(0x9E3779B97F4A7C15))], axis=1)
    views = np.unpackbits(both.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.int64) * 2 - 1
    sums = np.vstack([np.zeros((1, BITS), np.int64), np.cumsum(views * votes[:, None], axis=0)])
    return np.packbits(sums[run:] - sums[:-run] > 0, axis=1).view(np.uint64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1).astype(np.int64)


class Items:
    """Benchmark items in packed arrays: weights of known shingles, each item's shingles by number, fingerprints, and by block
    and value the items whose block is nearly that value. Rare shingles weigh more: 1 + ln(items / items with it)."""

    def __init__(self, items: list[tuple[int | None, bytes, np.ndarray, np.ndarray]], total: int):
        """`items`: id, text, distinct shingles and in how many of the `total` items each of these is."""
        self.strange = 1 + math.log(total + 1)  # the weight of shingles in no item
        hs, counts = (np.concatenate([np.zeros(0, np.uint64), *(x[i].astype(np.uint64) for x in items)]) for i in (2, 3))
        self.known, first = np.unique(hs, return_index=True)
        self.weight = 1 + np.log(total / counts[first].astype(float))
        bits = 16
        while 1 << bits < 16 * len(self.known) and bits < 24:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.known >> self.shift] = True
        self.ids, words, prints, members = [], [], [], []
        for item_id, text, h, _ in items:
            order, n = shingled(text)
            if n:
                self.ids.append(item_id)
                words.append(n)
                members.append(np.searchsorted(self.known, np.sort(h.astype(np.uint64))).astype(np.int32))
                prints.append(fingerprints(order, self.weights(order)[0], len(order))[0])
        self.words = np.array(words, np.int32)
        self.prints = np.array(prints, np.uint64).reshape(-1, 2)
        self.members = np.concatenate([np.zeros(0, np.int32), *members])
        self.edge = np.cumsum([0] + [len(m) for m in members])
        self.total = np.array([self.weight[m].sum() for m in members])
        self.sizes = [(int(n), float(self.total[self.words == n].min())) for n in np.unique(self.words)]
        self._list()

    def _list(self) -> None:
        """For each block the items by value, and by a part of their size where lists would else be long."""
        groups = 1
        while groups < 16 and len(self.ids) * len(masks(LISTED)) > groups << BLOCK:
            groups *= 2
        self.groups, self.first, self.listed = groups, [], []
        for values in self.prints.view(np.uint16).reshape(-1, BLOCKS).T:
            slot = (values[:, None] ^ masks(LISTED)[None, :]).astype(np.int64) * groups + (self.words % groups)[:, None]
            self.listed.append((np.argsort(slot.ravel(), kind="stable") // len(masks(LISTED))).astype(np.int32))
            self.first.append(np.r_[0, np.cumsum(np.bincount(slot.ravel(), minlength=groups << BLOCK))].astype(np.int32))

    def weights(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight of each shingle, and where the known ones stand."""
        out = np.full(len(h), self.strange)
        maybe = np.flatnonzero(self.table[h >> self.shift])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
            hit = self.known[at] == h[maybe]
            maybe = maybe[hit]
            out[maybe] = self.weight[at[hit]]
        return out, maybe

    def candidates(self, n: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that the blocks give for windows of n words each; each pair once."""
        pairs = [np.zeros(0, np.int64)]
        for first, listed, bits, values in zip(self.first, self.listed, ASKED, prints.view(np.uint16).reshape(-1, BLOCKS).T, strict=True):
            slot = (values[:, None] ^ masks(bits)[None, :]).astype(np.int64) * self.groups + (n % self.groups)[:, None]
            start, count = first[slot], first[slot + 1] - first[slot]
            window = np.nonzero(count)[0]
            start, count = start[count > 0], count[count > 0]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            item = listed[np.repeat(start, count) + within].astype(np.int64)
            window = np.repeat(window, count)
            same = self.words[item] == n[window]
            pairs.append(window[same] * len(self.ids) + item[same])
        return np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.ids)))

    def within(self, n: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) for every item of a window's size within the radius of its fingerprint."""
        window, item = self.candidates(n, prints)
        d = distances(prints[window], self.prints[item])
        near = d <= RADIUS
        return window[near], item[near], d[near]

    def similarity(self, window: np.ndarray, k: int) -> float:
        """Weighted similarity of the shingles of a window, without repeats, and item k."""
        own = self.members[self.edge[k] : self.edge[k + 1]]
        both = self.weight[own[np.isin(self.known[own], window, assume_unique=True)]].sum()
        return float(both / (self.weights(window)[0].sum() + self.total[k] - both)) if both else 0.0

    def matches(self, text: bytes) -> list[tuple[int | None, int, int, int, float]]:
        """(item id, first word, words, distance, similarity): the best window for each item that a text holds.

        A text shorter than the item is one window. Windows are fingerprinted WINDOWS at a time.
        """
        words = words_of(text)
        if not words or not self.sizes:
            return []
        best: dict[int, tuple[float, int, int, int]] = {}
        for h, n, run, starts, prints in _batches(self._windows(words)):
            for w, k, d in zip(*(x.tolist() for x in self.within(n, prints)), strict=True):
                sim = self.similarity(np.unique(h[starts[w] : starts[w] + run[w]]), k)
                if sim >= SIMILARITY - 1e-9 and (k not in best or sim > best[k][0]):
                    best[k] = (sim, int(starts[w]), min(int(n[w]), len(words)), d)
        return [(self.ids[k], s, n, d, sim) for k, (sim, s, n, d) in sorted(best.items())]

    def _windows(self, words: list[bytes]) -> Iterator[tuple]:
        """(shingles, words of a window, its shingles, starts, fingerprints, width) for runs of windows, WINDOWS at most, that
        hold enough known shingles for some item of their size."""
        hashed = sh.word_hashes(words)
        for width, sizes in itertools.groupby(self.sizes, lambda x: width_of(x[0])):
            if len(words) < width:
                continue
            h = sh.shingle_hashes(hashed, width)
            weight, places = self.weights(h)
            if not len(places):
                continue
            all_known = float(weight[places].sum())
            until = None
            for n, least in sizes:
                least = SIMILARITY * least - 1e-9
                if all_known < least:
                    continue
                if until is None:
                    known = np.zeros(len(h))
                    known[places] = weight[places]
                    until = np.r_[0.0, np.cumsum(known)]
                run = min(n - width + 1, len(h))
                starts = np.flatnonzero(until[run:] - until[:-run] >= least)
                for lo, hi in _runs(starts):
                    for a in range(lo, hi + 1, WINDOWS):
                        b = min(hi + 1, a + WINDOWS)
                        yield h, n, run, np.arange(a, b), fingerprints(h[a : b - 1 + run], weight[a : b - 1 + run], run), width


def _batches(windows: Iterator[tuple]) -> Iterator[tuple]:
    """Runs of windows over the same shingles put together, up to WINDOWS and one run more."""
    for _, same in itertools.groupby(windows, lambda x: x[5]):
        held, size = [], 0
        for x in itertools.chain(same, [None]):
            if held and (x is None or size >= WINDOWS):
                count = [len(y[3]) for y in held]
                yield held[0][0], np.repeat([y[1] for y in held], count), np.repeat([y[2] for y in held], count), np.concatenate([y[3] for y in held]), np.concatenate([y[4] for y in held])
                held, size = [], 0
            if x is not None:
                held.append(x)
                size += len(x[3])


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1)
        yield from zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist(), strict=True)


def weighed(benchmark: DataFrame) -> DataFrame:
    """(id, text, h, n): each item with its distinct shingles and the number of items that hold them."""
    spark = common.tune(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = common.written(rows.withColumn("row", F.monotonically_increasing_id()), "op5-items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs = [np.unique(shingled(t)[0]) for t in b.column(1).to_pylist()]
            row = np.repeat(b.column(0).to_numpy(), [len(x) for x in hs])
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint64), *hs]).view(np.int64))], names=["row", "h"])

    each = common.written(rows.select("row", "text").mapInArrow(run, "row long, h long"), "op5-shingles")
    counted = common.spread_join(each, each.groupBy("h").agg(F.count("*").alias("n")), "h")
    lists = counted.groupBy("row").agg(F.collect_list(F.struct("h", "n")).alias("x"))  # as long as an item
    out = common.written(rows.join(lists, "row").select("id", "text", "x.h", "x.n"), "op5-weighed")
    common.discard(rows, each)
    return spark.read.schema(out.schema).parquet(out._stored_at)


def chunks(benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Items]:
    """The items, as many at a time as a scan may take along. Weights are those of the whole benchmark."""
    total = benchmark.count()
    held, size = [], 0
    for r in weighed(benchmark).orderBy("id", "text").toLocalIterator():
        held.append((r.id, bytes(r.text), np.array(r.h, np.int64).view(np.uint64), np.array(r.n, np.int64)))
        size += len(r.text)
        if size >= chunk_bytes:
            yield Items(held, total)
            held, size = [], 0
    if held:
        yield Items(held, total)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance, similarity): the best window of each item that a document holds.

    Words are runs of ASCII letters, digits and other non-ASCII characters, in lower case; shingles are five words, or all
    words of an item that has fewer: such an item matches where its words stand. Documents and items without words match
    nothing, null ids are carried, repeated rows match alike, the first of equally good windows counts, other columns don't
    matter, and without documents or items there are no rows. One pass over the documents for every CHUNK_BYTES of items.
    """
    spark = common.tune(docs.sparkSession)
    texts = common.doc_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    out = spark.createDataFrame([], SCHEMA)
    for chunk in chunks(benchmark):
        out = out.union(texts.mapInArrow(_search(spark.sparkContext.broadcast(chunk)), SCHEMA))
    return out


def _search(chunk):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in chunk.value.matches(t)]
            cols = list(zip(*found, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns whatever their names, that hold no item. Rows with null or empty texts stay;
    ids don't matter; repeated rows stay or go alike; without items all rows stay."""
    spark = common.tune(docs.sparkSession)
    at = docs.columns.index(text_col)
    for chunk in chunks(benchmark):
        items = spark.sparkContext.broadcast(chunk)

        def clean(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not items.value.matches((t or "").encode()) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = common.map_rows(docs, clean)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
