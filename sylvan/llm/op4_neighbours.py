"""Approximate nearest neighbours: a forest of sorted hash strings over the whole table, searched by longest common prefixes.

Each tree sorts all vectors by a string of BITS hash bits (signs of random projections) and is cut into slices of about
SLICE_ROWS rows, one a task. Rows that share a prefix with a query stand together, so the query is sent only to the slices of
that range. Two rounds: a row's own slice tells how many rows share each of its prefixes (the descent); all trees then go up
together, from the longest prefix on, to the level at which they gather enough entries, and the rows of those ranges are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm import common

#: Trees, bits of a hash string, and how many entries all trees together must gather for a query, as a share of the table's rows.
#: The vectors at hand have no clusters: each of 8 trees must give a quarter of its rows for a recall of 0.95 and more, so they
#: gather twice as many entries as there are rows. Clustered vectors need a hundredth of that (README has the curve).
TREES, BITS, SHARE, SEED = 8, 64, 1.25, 20_240_601
#: Rows of a slice, and queries that one task scores against it: what a task holds.
SLICE_ROWS, BLOCK_QUERIES = 8192, 8192
#: Hash strings that the cuts between slices are taken from; there are 16 for each slice until the table has 500 million rows.
SAMPLE = 1_000_000
K = 20
_TOP = np.uint64(1 << 63)


def planes(dim: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dim)).normal(size=(dim, trees * BITS))


def hash_strings(vectors: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, trees): strings as unsigned numbers."""
    return np.packbits(vectors @ p > 0, axis=1).reshape(len(vectors), -1, BITS // 8).copy().view(">u8")[:, :, 0].astype(np.uint64)


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned numbers as signed ones of the same order."""
    return (h ^ _TOP).view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return h.view(np.uint64) ^ _TOP


def prefix_range(h: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First and last string with the first `depth` bits of h."""
    depth = np.broadcast_to(np.asarray(depth, np.uint64), h.shape)
    rest = np.where(depth >= 64, np.uint64(0), np.uint64(2**64 - 1) >> np.minimum(depth, np.uint64(63)))
    return h & ~rest, h | rest


class Cuts:
    """Where the trees over vectors of one length are cut: slice i holds strings from cut i - 1 up to below cut i. A string that
    is a cut several times over has a group of rows that fills several slices; they are dealt to those by id."""

    def __init__(self, samples: np.ndarray, rows: int, slice_rows: int):
        self.slices = max(1, math.ceil(rows / slice_rows))
        self.rows = rows
        self.cuts = [np.sort(s)[(np.arange(1, self.slices) * len(s)) // self.slices] for s in samples.T]
        marks = min(len(samples), max(1024, 16 * self.slices))
        self.marks = [np.sort(s)[(np.arange(marks) * len(s)) // marks] for s in samples.T]

    def share_of(self, tree: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """About which part of all rows has strings from low to high."""
        m = self.marks[tree]
        return (np.searchsorted(m, high, "right") - np.searchsorted(m, low, "left")) / len(m)

    def slice_of(self, tree: int, h: np.ndarray, salt: np.ndarray) -> np.ndarray:
        first, last = (np.searchsorted(self.cuts[tree], h, side) for side in ("left", "right"))
        # of n equal cuts the n - 1 slices between them and the one after them hold just or also that string
        return last - salt % np.maximum(1, last - first)

    def touched(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last slice that can hold strings from low to high."""
        first, last = np.searchsorted(self.cuts[tree], low, "right"), np.searchsorted(self.cuts[tree], high, "right")
        exact = np.searchsorted(self.cuts[tree], low, "left")  # rows of a repeated cut stand before its last slice too
        return np.where(first > exact, exact + 1, first), last


_ENTRY = "tree int, slice int, dim int, hash long, cid long, asked boolean"


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column, all rows of one length, as a matrix in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(at).to_numpy()
    for d in np.unique(sizes):
        yield int(d), batch.filter(pa.array(sizes == d))


def classes(vectors: DataFrame, every: int, k: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes, queries). Equal vectors have equal neighbours, so they are one class (cid: its smallest id) with its k + 1
    smallest ids, more than which no answer can hold; queries are (vec_id, cid). Counts off ids before the shuffle, so that a
    class may have any part of all rows."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col).cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    x = v.cast("array<double>")
    good = v.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    clean = vectors.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    plain = F.transform("v", lambda c: F.when(c == 0, F.lit(0.0)).otherwise(c))  # -0.0 and 0.0 are equal
    rows = common.written(clean.withColumn("key", F.md5(F.concat_ws(",", plain.cast("array<string>")).cast("binary"))), "op4-rows")
    least = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    marks = rows.groupBy("key").agg(F.min("vec_id").alias("cid"), F.max(F.col("vec_id") % every == 0).alias("asked"))
    found = least.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")).join(marks, "key")
    found = common.written(found.select("cid", "ids", "v", F.size("v").alias("dim"), "asked", "key"), "op4-classes")
    queries = common.spread_join(rows.where(F.col("vec_id") % every == 0).select("vec_id", "key"), found.select("key", "cid"), "key").select("vec_id", "cid")
    queries = common.written(queries, "op4-queries")
    common.discard(rows)
    return found, queries


def cuts_of(found: DataFrame, trees: int, slice_rows: int, seed: int) -> dict[int, Cuts]:
    """For each length of vectors the cuts of its trees: from all hash strings, or from SAMPLE of them that ids choose."""
    sizes = {r.dim: r.n for r in found.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    some = found if total <= SAMPLE else found.where(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1_000_000_000)) < int(1e9 * SAMPLE / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_dim(b, 1):
                h = hash_strings(_vectors(part.column(0)), planes(d, trees, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d, np.int32)), *(pa.array(signed(np.ascontiguousarray(c))) for c in h.T)], names=["dim", *map(str, range(trees))])

    t = some.select("v", "dim").mapInArrow(run, "dim int, " + ", ".join(f"`{i}` long" for i in range(trees))).toArrow() if total else None
    out = {}
    for d, n in sizes.items():
        part = t.filter(pa.compute.equal(t["dim"], d))
        h = np.stack([unsigned(part[str(i)].to_numpy()) for i in range(trees)], axis=1)
        out[d] = Cuts(h if len(h) else np.zeros((1, trees), np.uint64), n, slice_rows)
    return out


def entries(found: DataFrame, cuts, trees: int, seed: int, vectors: bool) -> DataFrame:
    """An entry for each class and tree: where it stands, with the vector and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_dim(b, 3):
                h = hash_strings(_vectors(part.column(2)), planes(d, trees, seed))
                cid = part.column(0).to_numpy()
                salt = (cid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for tree in range(trees):
                    own = np.ascontiguousarray(h[:, tree])
                    at = cuts.value[d].slice_of(tree, own, salt)
                    cols = [pa.array(np.full(len(own), tree, np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(own), d, np.int32)), pa.array(signed(own)), part.column(0), part.column(4)]
                    yield pa.RecordBatch.from_arrays(cols + ([part.column(1), part.column(2)] if vectors else []), names=[*(c.split()[0] for c in _ENTRY.split(", ")), *(["ids", "v"] if vectors else [])])

    v = found.schema["v"].dataType.simpleString()
    return found.select("cid", "ids", "v", "dim", "asked").mapInArrow(run, _ENTRY + (f", ids array<long>, v {v}" if vectors else ""))


def descent(found: DataFrame, cuts, trees: int, seed: int) -> DataFrame:
    """(cid, tree, counts): for each query class how many entries of a tree share its first d bits, for every d. Ranges within
    its own slice are counted; those that reach other slices are at least a good part of one, and marks, of which a slice has
    16, tell their size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, d = int(pdf["tree"].iloc[0]), int(pdf["dim"].iloc[0])
        h = np.sort(unsigned(pdf["hash"].to_numpy()))
        asked = pdf[pdf["asked"]]
        own, c = unsigned(asked["hash"].to_numpy()), cuts.value[d]
        counts = np.zeros((len(own), BITS + 1))
        for depth in range(BITS + 1):
            low, high = prefix_range(own, depth)
            counts[:, depth] = np.searchsorted(h, high, "right") - np.searchsorted(h, low, "left")
            first, last = c.touched(tree, low, high)
            if not (first != last).any():
                if depth and (counts[:, depth] == 1).all():
                    counts[:, depth:] = 1
                    break
                continue
            about = np.where(first != last, c.rows * c.share_of(tree, low, high), 0)
            counts[:, depth] = np.maximum(counts[:, depth], about)
        return pd.DataFrame({"cid": asked["cid"].to_numpy(), "tree": tree, "dim": d, "hash": asked["hash"].to_numpy(), "counts": pd.Series(list(counts), dtype=object)})

    return entries(found, cuts, trees, seed, False).groupBy("tree", "slice", "dim").applyInPandas(run, "cid long, tree int, dim int, hash long, counts array<double>")


def ascent(seen: DataFrame, sizes: dict[int, int], share: float, k: int) -> DataFrame:
    """(cid, depth, gathered): the deepest level at which all trees together have enough entries for a query."""
    least = F.lit(0.0)
    for d, n in sizes.items():
        least = F.when(F.col("dim") == d, F.lit(float(max(2 * k, share * n)))).otherwise(least)
    sums = seen.groupBy("cid", "dim").agg(F.array(*[F.sum(F.element_at("counts", i + 1)) for i in range(BITS + 1)]).alias("s"))
    level = F.greatest(F.lit(0), *[F.when(F.element_at("s", i + 1) >= least, F.lit(i)) for i in range(BITS + 1)])
    return sums.withColumn("depth", level).select("cid", "depth", F.element_at("s", F.col("depth") + 1).alias("gathered"))


def _scored(k: int, trees: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            h = unsigned(left["hash"].to_numpy())
            order = np.argsort(h, kind="stable")
            h, cid = h[order], left["cid"].to_numpy()[order]
            rows = np.stack(left["v"].to_numpy()[order]).astype(np.float64)
            ids = left["ids"].to_numpy()[order]
            low, high = prefix_range(unsigned(right["hash"].to_numpy()), right["depth"].to_numpy())
            lo, hi = np.searchsorted(h, low, "left"), np.searchsorted(h, high, "right")
            vectors, q = np.stack(right["v"].to_numpy()).astype(np.float64), right["cid"].to_numpy()
            together = np.lexsort((hi, lo))
            edge = np.flatnonzero(np.r_[True, (np.diff(lo[together]) != 0) | (np.diff(hi[together]) != 0)])
            for group in np.split(together, edge[1:]):  # queries of one range
                a, b = lo[group[0]], hi[group[0]]
                for part in np.array_split(group, max(1, len(group) // 512)) if b > a else ():
                    near = vectors[part] @ rows[a:b].T
                    for j, s in zip(part, near, strict=True):
                        at = np.arange(a, b)
                        if len(at) > k + 1:  # ties at the edge stay, to be told apart by id
                            at = at[s >= np.partition(s, -k - 1)[-k - 1] - 1e-9 * (1 + abs(s).max())]
                        score = (rows[at] * vectors[j]).sum(axis=1)  # the same order of additions for each row
                        top = np.lexsort((cid[at], -score))[: k + 1]
                        out.append((np.full(len(top), q[j]), cid[at[top]], score[top], ids[at[top]]))
        a, b, c, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
        return pd.DataFrame({"query": a.astype(np.int64), "cid": b.astype(np.int64), "score": c.astype(float), "ids": d.astype(object)})

    return run


def routed(found: DataFrame, seen: DataFrame, levels: DataFrame, cuts) -> DataFrame:
    """(tree, slice, dim, cid, hash, depth, v): each query once for every slice that its range touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid, tree, dim, h, depth = (b.column(i).to_numpy() for i in range(5))
            first, last = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64)
            low, high = prefix_range(unsigned(h), depth)
            for t, d in {*zip(tree.tolist(), dim.tolist(), strict=True)}:
                m = (tree == t) & (dim == d)
                first[m], last[m] = cuts.value[d].touched(t, low[m], high[m])
            many = last - first + 1
            row = np.repeat(np.arange(len(cid)), many)
            at = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            yield pa.RecordBatch.from_arrays([pa.array(tree[row]), pa.array(at.astype(np.int32)), pa.array(dim[row]), pa.array(cid[row]), pa.array(h[row]), pa.array(depth[row])], names=["tree", "slice", "dim", "cid", "hash", "depth"])

    ways = seen.select("cid", "tree", "dim", "hash").join(levels.select("cid", F.col("depth").cast("int").alias("depth")), "cid")
    return ways.mapInArrow(run, "tree int, slice int, dim int, cid long, hash long, depth int").join(found.select("cid", "v"), "cid")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, share: float = SHARE, slice_rows: int = SLICE_ROWS, block_queries: int = BLOCK_QUERIES, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, the `k` rows of largest inner product found.

    Rows without id, and vectors that are null, empty, zero or hold a null or non-finite component take no part. An id is
    one row: of rows that repeat an id the smallest vector counts, and none of them is a neighbour of that id. Vectors of
    different lengths don't meet. Ties in score go to the smaller id. Other columns don't matter. An empty table gives an empty
    result.

    Every row is indexed, once a tree; a query goes to the slices of its ranges alone, and where more queries than
    `block_queries` meet a slice they do so in blocks.
    """
    return _search(vectors, every, k, id_col, vector_col, trees, share, slice_rows, block_queries, seed)[0]


def _search(vectors, every=20, k=K, id_col="vec_id", vector_col="embedding", trees=TREES, share=SHARE, slice_rows=SLICE_ROWS, block_queries=BLOCK_QUERIES, seed=SEED) -> tuple[DataFrame, DataFrame]:
    """The answer, and what `ascent` chose for each query."""
    spark = common.tune(vectors.sparkSession)
    found, queries = classes(vectors, every, k, id_col, vector_col)
    by_dim = cuts_of(found, trees, slice_rows, seed)
    cuts = spark.sparkContext.broadcast(by_dim)  # 17 numbers a tree for each slice
    seen = common.written(descent(found, cuts, trees, seed), "op4-descent")
    levels = common.written(ascent(seen, {d: c.rows for d, c in by_dim.items()}, share, k), "op4-levels")
    asked = routes = common.written(routed(found, seen, levels, cuts), "op4-asked")
    common.discard(seen)
    key = ["tree", "slice", "dim"]
    blocks = asked.groupBy(*key).agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks"))
    blocks = common.written(blocks, "op4-blocks")
    rows = entries(found, cuts, trees, seed, True).join(F.broadcast(blocks), key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    own_block = F.pmod(F.xxhash64("cid"), F.col("n")).cast("int")
    asked = asked.join(F.broadcast(blocks.select(*key, F.col("blocks").alias("n"))), key).select(*[F.col(c).alias(c) for c in (*key, "cid", "hash", "depth", "v")], own_block.alias("block"))
    hits = rows.groupBy(*key, "block").cogroup(asked.groupBy(*key, "block")).applyInPandas(_scored(k, trees), "query long, cid long, score double, ids array<long>")
    # trees find the same rows again; what each gives is cut to k + 1 before it is shuffled
    best = hits.groupBy("query", "cid").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    top = best.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("nth", rank).where(F.col("nth") <= k + 1)
    lists = common.written(top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near")), "op4-near")
    common.discard(found, blocks, routes)
    own = common.spread_join(queries.select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")), lists, "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"), levels


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(common.table(spark, sf_dir, "embeddings"))
