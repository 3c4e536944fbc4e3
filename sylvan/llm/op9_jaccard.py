"""N-gram Jaccard join by universe-partition pigeonhole.

Distinct shingles of a document are dealt by hash into segments, as many as its size band asks for. Two sets of sizes r and s
link only if they differ in at most (r + s) / 7 shingles, and each difference spoils one segment, so a document with more
non-empty segments than that has one in common with every partner. All segments are indexed as signatures:

1. Signatures meet in buckets. Documents with equal sets count once. Groups of up to SMALL documents give all their pairs;
   larger ("hot") groups give pairs with two hubs only, and are recorded.
2. Pairs must have as many signatures in common as the pigeonhole demands, less those that hot groups may hide; what is
   left is verified on whole sets.
3. A hot group is settled if its members are in one component by now. A document is deficient if its settled signatures
   are no more than its possible differences: only pairs of two deficient documents in an unsettled group can be missing.
4. Deficient documents are indexed again, by all their segments and by each segment less any one shingle. What a signature
   costs is the number of deficient documents that have it, and each document takes the cheapest thresholds: a segment left
   out finds nothing, one taken whole finds partners that are equal there, one taken with its one-deletion neighbourhood
   finds those that differ there by one. These count 0, 1 and 2; more than its possible differences in all, and it finds
   every partner among the deficient. Of two that both can, one looks for the other.
   As in the first index, no signature of more than SMALL others gives pairs.
5. Documents whose cheapest thresholds cost over BUDGET, or do not suffice, are compared in blocks, by an inverted index,
   wherever their components differ.

In the first index, one-deletion neighbourhoods serve documents whose segments are too few (short ones), as whole sets: their
signatures are joined by those of the set less one shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from sylvan.llm import common, graph
from sylvan.llm import shingles as sh

#: Segments as a share of a band's largest size; a band ends at twice its least size.
SEGMENTS = 0.45
#: Largest group that gives all its pairs, and documents of a block in the last comparison.
SMALL, BLOCK = 24, 2000
#: Most candidates that thresholds may cost a deficient document; one that needs more is compared in blocks.
BUDGET = 2000
#: Offers that a Python worker gathers before it gives them back.
OFFERS = 100_000
#: Sets of up to so many shingles differ in one at most from partners as large or larger; those have one shingle more at most.
SHORT = 5
#: Stands for a null id among nodes: larger than other ids, so no component is named by it that has another id.
NO_ID = 2**63 - 1
#: Most rows of a batch, whose numbers have 16 bits with a role's.
ROWS = 16_384
#: Most ids (of eight bytes) that are broadcast to fetch texts.
BROADCAST_IDS = 2_000_000
#: Input bytes for a bucket of signatures.
BUCKET_BYTES = 16 << 20
#: Rows of a file, and so of a task, where these hold or compare whole sets.
SET_ROWS = 2000

PAIR, HOT, DOC = 1, 2, 0
_FOUND = "kind int, a long, b long, n int, k0 int, k1 int, digest binary"
_U = np.uint64


def band_of(n: int) -> int:
    return n.bit_length() - 1


def most_differences(n: int, largest: int) -> int:
    """Differences that a set of n shingles can have with a partner of at most `largest`."""
    return (n + min(largest, 4 * n // 3)) // 7


def roles(n: int) -> list[tuple[int, int]]:
    """(role, band) in which a set of n shingles is indexed: its own band, and the one below if a partner can be there."""
    b = band_of(n)
    return [(0, b), (1, b - 1)] if b and -(-3 * n // 4) < 1 << b else [(0, b)]


def _segments(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-empty segments of the sorted set `s` in the partition of `band`: their numbers, where they start, and the
    sums that their signatures mix."""
    m = max(2, math.ceil(SEGMENTS * (2 << band)))
    with np.errstate(over="ignore"):
        segment = (s >> _U(40)) * _U(m) >> _U(24)
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        return segment[first], first, np.add.reduceat(sh.mix(s), first) + _U(band + 1) * _U(0x9E3779B97F4A7C15) + segment[first]


def signatures(s: np.ndarray, band: int) -> np.ndarray:
    """A signature for each non-empty segment of the sorted set `s` in the partition of `band`."""
    return sh.mix(_segments(s, band)[2])


def offers(s: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, kind, signature): of each non-empty segment as a whole (kind 0), and less any one shingle (kind 1) where that
    leaves some."""
    number, first, total = _segments(s, band)
    size = np.diff(np.r_[first, len(s)])
    at = np.repeat(np.arange(len(first)), size)
    with np.errstate(over="ignore"):
        less = sh.mix(total[at] - sh.mix(s))[size[at] > 1]
    at = at[size[at] > 1]
    kind = np.repeat(np.array([0, 1], np.int8), [len(first), len(at)])
    return np.r_[number, number[at]], kind, np.r_[sh.mix(total), less]


def neighbourhood(s: np.ndarray) -> np.ndarray:
    """Signatures of the set itself and, from three shingles on, of it less any one: sets that differ in one have one in common."""
    with np.errstate(over="ignore"):
        h = sh.mix(s)
        total = np.add.reduce(h, keepdims=True)
        return sh.mix(np.unique(np.r_[total, total - h] if len(s) > 2 else total) + _U(0xC0FFEE))


class Indexed:
    """The signatures of one document by role, and how many segments stand for each role."""

    def __init__(self, s: np.ndarray):
        self.by_role = {0: np.zeros(0, _U), 1: np.zeros(0, _U)}
        self.segments = [0, 0]
        n = len(s)
        for role, band in roles(n):
            sig = signatures(s, band)
            self.segments[role] = len(sig)
            self.by_role[role] = np.r_[sig, neighbourhood(s)] if role == 0 and n <= SHORT + 1 else sig


def needs(n: int, role: int) -> int:
    """Settled signatures that make a document complete in a role: one more than its possible differences there."""
    return most_differences(n, 4 * n // 3 if role == 0 else (1 << band_of(n)) - 1) + 1


def _digest(s: np.ndarray) -> tuple[bytes, int]:
    """What stands for a set, and the 64 bits of it that are the set's key."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return digest, int.from_bytes(digest[:8], "big", signed=True)


def _names(spark: SparkSession, partitions: int, buckets: int) -> np.ndarray:
    """Names for buckets, which a shuffle deals to partitions by their hash, such that every partition gets as many. Where
    there are many buckets a partition, chance sees to that."""
    each = -(-buckets // partitions)
    if each >= 16:
        return np.arange(buckets, dtype=np.int64)
    found: dict[int, list[int]] = {p: [] for p in range(partitions)}
    start, step = 0, 4 * partitions * each + 100
    while any(len(x) < each for x in found.values()):
        names = spark.range(start, start + step).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("p"))
        for r in names.collect():
            found[r.p].append(r.id)
        start += step
    return np.array([x[k] for k in range(each) for x in found.values()][:buckets], np.int64)


def _map(names: np.ndarray):
    buckets = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int, int]] = {}  # of equal sets in a task one is indexed
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = batch.column(0).to_pylist()
            docs, sigs, owner = [], [], []
            keys, sizes = [], []
            for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                s = sh.shingle_set(text)
                if not len(s):
                    docs.append((doc_id, 0, 0, 0, 0, None))
                    continue
                digest, key = _digest(s)
                if digest not in seen:
                    x = Indexed(s)
                    seen[digest] = (len(s), *x.segments)
                    for role, g in x.by_role.items():
                        sigs.append(g)
                        owner.append(np.full(len(g), 2 * len(keys) + role, np.uint16))
                    keys.append(key)
                    sizes.append(len(s))
                n, k0, k1 = seen[digest]
                docs.append((doc_id, key, n, k0, k1, digest))
            out = [(-1, None, None, None, None, d) for d in docs]
            if sigs:
                sig, own = np.concatenate(sigs), np.concatenate(owner)
                bucket = ((sig >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, own, bucket = sig[order], own[order], bucket[order]
                nodes, counts = np.array(keys, np.int64), np.array(sizes, np.uint32)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for i, j in zip(edge, np.r_[edge[1:], len(bucket)], strict=True):
                    used, local = np.unique(own[i:j] >> 1, return_inverse=True)
                    low = np.ascontiguousarray(sig[i:j].view(np.uint16).reshape(-1, 4)[:, :3])  # 48 bits; the bucket tells more
                    out.append((int(names[bucket[i]]), low.tobytes(), (local.astype(np.uint16) * 2 + (own[i:j] & 1)).astype(np.uint16).tobytes(), nodes[used].tobytes(), counts[used].tobytes(), None))
            yield _rows(out)

    return run


_PACKED = "bucket int, sigs binary, owners binary, nodes binary, sizes binary, doc struct<a:long,b:long,n:int,k0:int,k1:int,digest:binary>"
_DOC = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("k0", pa.int32()), ("k1", pa.int32()), ("digest", pa.binary())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 6
    docs = [None if d is None else dict(zip(("a", "b", "n", "k0", "k1", "digest"), d, strict=True)) for d in cols[5]]
    arrays = [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:5]), pa.array(docs, _DOC)]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "sigs", "owners", "nodes", "sizes", "doc"])


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Groups of equal signatures in one bucket: pairs with counts, and members of hot groups."""
    at, sig, node, size, role = 0, [], [], [], []
    for s, o, nodes, sizes in zip(pdf["sigs"], pdf["owners"], pdf["nodes"], pdf["sizes"], strict=True):
        own = np.frombuffer(o, np.uint16)
        part = np.zeros((len(own), 4), np.uint16)
        part[:, :3] = np.frombuffer(s, np.uint16).reshape(-1, 3)
        sig.append(part.view(_U)[:, 0])
        node.append(np.frombuffer(nodes, np.int64)[own >> 1])
        size.append(np.frombuffer(sizes, np.uint32)[own >> 1])
        role.append((own & 1).astype(np.int8))
    sig, node, size, role = map(np.concatenate, (sig, node, size, role))
    order = np.lexsort((node, sig))
    sig, node, size, role = sig[order], node[order], size[order].astype(np.int64), role[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]  # copies from other batches
    sig, node, size, role = sig[fresh], node[fresh], size[fresh], role[fresh]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    count = np.diff(np.r_[first, len(sig)])
    a, b = [], []

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        near = 4 * np.minimum(size[i], size[j]) >= 3 * np.maximum(size[i], size[j])
        a.append(node[i[near]])
        b.append(node[j[near]])

    for n in range(2, SMALL + 1):  # all groups of one size together
        start = first[count == n]
        for x in range(n):
            for y in range(x + 1, n):
                if len(start):
                    pairs(start + x, start + y)
    hot = np.flatnonzero(count > SMALL)
    hot_sig, hot_node, hot_role = [], [], []
    for f, n in zip(first[hot], count[hot], strict=True):
        members = np.arange(f, f + n)
        pairs(np.full(n - 1, f), members[1:])
        pairs(members[1:-1], np.full(n - 2, f + n - 1))
        hot_sig.append(np.full(n, sig[f]))
        hot_node.append(node[f : f + n])
        hot_role.append(role[f : f + n])
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    p = pd.DataFrame({"a": cat(a, np.int64), "b": cat(b, np.int64)})
    p = p.groupby(["a", "b"], sort=False).size().reset_index(name="n") if len(p) else p.assign(n=0)
    # a signature is named by its number within its bucket, and that
    h = pd.DataFrame({"a": cat(hot_sig, _U).view(np.int64), "b": cat(hot_node, np.int64), "n": cat(hot_role, np.int8)})
    out = pd.concat([p.assign(kind=PAIR, k0=0), h.assign(kind=HOT, k0=int(pdf["bucket"].iloc[0]))], ignore_index=True)
    return out.assign(k1=0, digest=None)[["kind", "a", "b", "n", "k0", "k1", "digest"]].astype({"kind": "int32", "a": "int64", "b": "int64", "n": "int32", "k0": "int32", "k1": "int32"})


def _sets(docs: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """(key, set) for the ids in `wanted`, `rows` at most: their texts are fetched by a join and shingled again. Every text of an id counts, and
    with NO_ID every text without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sh.shingle_set(t).view(np.int64) for t in b.column(1).to_pylist()]
            keys = [_digest(s)[1] for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "set"])

    ids = common.written(wanted.select(F.col("id").alias("doc_id")), "op9-wanted", rows)
    # a list of bounded size goes to the texts; a longer one meets them in a shuffle
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    if ids.where(F.col("doc_id") == NO_ID).limit(1).count():
        texts = texts.unionByName(docs.where(F.col("doc_id").isNull()))
    return texts.mapInArrow(common.lean(run), "key long, set array<long>").dropDuplicates(["key"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets link, as nodes."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("sb")), "b")
    common_size = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - common_size
    return both.where((100 * common_size >= 75 * union) & (common_size > 0)).select(_node("a_id", "a").alias("a"), _node("b_id", "b").alias("b"))


def _node(doc_id: str, key: str):
    """A class of equal sets as a node: by the smallest of its ids first, so that a component's root holds its smallest id."""
    return F.struct(F.col(doc_id).alias("id"), F.col(key).alias("key"))


_OFFER = "key long, comp long, n int, role byte, seg int, kind byte, sig long"
_OFFER_KINDS = [np.int64, np.int64, np.int32, np.int8, np.int32, np.int8, np.int64]


def _offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offers of the sets in rows (key, comp, set), in the roles of their sizes."""
    names = [c.split()[0] for c in _OFFER.split(", ")]
    held, rows = [], 0

    def given() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    for b in batches:
        for i in range(b.num_rows):
            key, comp = b.column(0)[i].as_py(), b.column(1)[i].as_py()
            s = b.column(2)[i].values.to_numpy(zero_copy_only=False).view(_U)
            for role, band in roles(len(s)):
                seg, kind, sig = offers(s, band)
                same = [np.full(len(sig), v, k) for v, k in zip((key, comp, len(s), role), _OFFER_KINDS, strict=False)]
                held.append((*same, seg.astype(np.int32), kind, sig.view(np.int64)))
                rows += len(sig)
            if rows > OFFERS:
                yield given()
                held, rows = [], 0
    if held:
        yield given()


def _allocated(deficient: DataFrame, sets: DataFrame, dearest: int = 2**62) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links that the cheapest thresholds find between `deficient` documents of different components, the documents that
    found no thresholds within BUDGET, and tables to discard later. No threshold is taken that costs over `dearest`.

    A whole segment costs the documents that have it whole; one-deletion costs, besides, those that have it less a shingle
    and those whose whole segment is this one less a shingle. A document takes as many of the cheapest as it needs; a segment's
    second threshold comes after its first.
    """
    made = common.written(deficient.select("key", "comp").join(sets, "key").mapInArrow(_offered, _OFFER), "op9-offers")
    n = made.count()
    whole, less = F.col("kind") == 0, F.col("kind") == 1
    weights = common.written(made.groupBy("sig").agg(F.count(F.when(whole, 1)).alias("wholes"), F.count(F.when(less, 1)).alias("lesses")), "op9-weights", n)
    priced = common.written(common.spread_join(made, weights, "sig"), "op9-priced", n)
    first, more = F.max(F.when(whole, F.col("wholes") - 1)), F.sum(F.when(whole, F.col("lesses")).otherwise(F.col("wholes")))
    segments = priced.groupBy("key", "n", "role", "seg").agg(first.alias("c0"), more.alias("c1"), F.max("kind").alias("most"))
    step = lambda level, cost, after: F.struct(F.lit(level).alias("level"), F.col(cost).alias("cost"), after.alias("price"))
    one, two = step(0, "c0", F.col("c0")), step(1, "c1", F.greatest("c0", "c1"))
    steps = segments.select("key", "role", "n", "seg", F.inline(F.when(F.col("most") == 1, F.array(one, two)).otherwise(F.array(one)))).where(F.col("price") <= dearest)
    cheapest = Window.partitionBy("key", "role").orderBy("price", "level", "seg")
    needed = F.when(F.col("role") == 0, _needs(0)).otherwise(_needs(1))
    taken = common.written(steps.withColumn("needed", needed).withColumn("at", F.row_number().over(cheapest)).where("at <= needed"), "op9-taken", n)
    by_role = taken.groupBy("key", "role").agg((F.count("*") == F.max("needed")).alias("enough"), F.sum("cost").alias("cost"))
    found = by_role.groupBy("key").agg(F.min("enough").alias("enough"), F.sum("cost").alias("cost")).where(F.col("enough") & (F.col("cost") <= BUDGET)).select("key")
    found = common.written(found, "op9-allocated", n)

    plan = taken.join(found, "key", "left_semi").groupBy("key", "role", "seg").agg(F.max("level").alias("level"))
    asked = priced.join(plan, ["key", "role", "seg"]).where("kind <= level")
    kinds = F.when((F.col("level") == 1) & whole, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    probes = asked.select("sig", F.explode(kinds.cast("array<tinyint>")).alias("kind"), F.col("key").alias("a"), F.col("comp").alias("a_comp"), F.col("n").alias("a_n"))
    # what costs more than that is never asked for
    most = min(BUDGET, dearest)
    index = priced.where(F.when(whole, F.col("wholes") - 1).otherwise(F.col("lesses")) <= most).join(found.withColumn("asks", F.lit(True)), "key", "left")
    index = index.select("sig", "kind", F.col("key").alias("b"), F.col("comp").alias("b_comp"), F.col("n").alias("b_n"), F.coalesce("asks", F.lit(False)).alias("asks"))
    near = 4 * F.least("a_n", "b_n") >= 3 * F.greatest("a_n", "b_n")
    # of two documents that both ask, one finds the other: its thresholds suffice by themselves
    once = ~F.col("asks") | (F.col("a") < F.col("b"))
    met = probes.join(index, ["sig", "kind"]).where((F.col("a_comp") != F.col("b_comp")) & near & once)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    named = lambda x: deficient.select(F.col("key").alias(x), F.col("id").alias(f"{x}_id"))
    pairs = common.written(pairs.join(named("a"), "a").join(named("b"), "b"), "op9-met", n)
    links = common.written(_verified(pairs, sets), "op9-links")
    common.discard(made, weights, priced, taken, pairs)
    return links, deficient.join(found, "key", "left_anti"), [found, links]


def _cross(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between documents of two blocks that are in different components."""
    out = []
    if len(left) and len(right):
        x = [np.asarray(s, np.int64) for s in left["set"]]
        flat, owner = np.concatenate(x), np.repeat(np.arange(len(x)), [len(s) for s in x])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        sizes, comp, ids, keys = np.array([len(s) for s in x]), left["comp"].to_numpy(), left["id"].to_numpy(), left["key"].to_numpy()
        for y, c, i, k in zip(right["set"], right["comp"], right["id"], right["key"], strict=True):
            y = np.asarray(y, np.int64)
            lo, hi = np.searchsorted(flat, y, "left"), np.searchsorted(flat, y, "right")
            if 4 * np.count_nonzero(hi > lo) < 3 * len(y):  # most of a set must occur in a partner
                continue
            hits = np.bincount(np.concatenate([owner[p:q] for p, q in zip(lo, hi, strict=True) if q > p]), minlength=len(x))
            good = (100 * hits >= 75 * (sizes + len(y) - hits)) & (comp != c)
            out += [(int(j), int(h), int(i), int(k)) for j, h in zip(ids[good], keys[good], strict=True)]
    return pd.DataFrame(out, columns=["a_id", "a", "b_id", "b"]).astype("int64")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`; links are 100 * intersection >= 75 * union of shingle sets.

    Words are lower-cased (A-Z) runs between ASCII white space; shingles are five words, or all words of a shorter text.
    Texts without words, and null texts, have no shingles, link with nothing and are their own component. Rows with a null id
    link like others; component_id is null only where no id is reachable. Rows that repeat an id are linked where their texts
    are, and each gets a row with the component of its own text; an empty table gives an empty one. Shingles are compared by
    64-bit hashes.
    """
    return labelled(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`join` with the key of each row's set and its component's root key, both null where a row links with nothing by rule:
    where ids are null or repeat with other texts, these tell rows and components apart. The root key is that of a set of the
    component's smallest id."""
    spark = common.tune(docs.sparkSession)
    texts = common.doc_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, common.input_bytes(texts) // BUCKET_BYTES)
    packed = texts.mapInArrow(common.lean(_map(_names(spark, partitions, buckets))), _PACKED)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["bucket"].iloc[0] >= 0:
            return _bucket(pdf)
        d = pd.DataFrame(list(pdf["doc"]))
        return d.assign(kind=DOC)[["kind", "a", "b", "n", "k0", "k1", "digest"]]

    # documents' own rows pass through the shuffle too, dealt over the buckets' tasks
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("doc.a"), F.lit(buckets)).cast("int"))
    found = common.written(packed.withColumn("bucket", spread).groupBy("bucket").applyInPandas(reduce, _FOUND), "op9-found")
    counts = {DOC: 0, PAIR: 0, HOT: 0} | {r.kind: r.rows for r in found.groupBy("kind").agg(F.count("*").alias("rows")).collect()}
    rows = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("key"), "n", "k0", "k1", "digest")
    rows = common.written(rows, "op9-rows", counts[DOC])
    classes = common.written(rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), F.min("key").alias("key"), F.min("n").alias("n"), F.min("k0").alias("k0"), F.min("k1").alias("k1")), "op9-classes", counts[DOC])

    hot = found.where(F.col("kind") == HOT).select(F.struct("k0", "a").alias("sig"), F.col("b").alias("key"), F.col("n").alias("role"))
    hot = common.written(hot, "op9-hot", counts[HOT])
    heat = hot.groupBy("key").agg(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("h0"), F.sum(F.when(F.col("role") == 1, 1).otherwise(0)).alias("h1"))
    nodes = common.written(classes.join(heat, "key", "left").na.fill(0, ["h0", "h1"]), "op9-nodes", counts[DOC])

    side = lambda x: nodes.select(F.col("key").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("id", "n", "k0", "k1", "h0", "h1")])
    pairs = found.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    band = lambda n: F.floor(F.log2(n.cast("double") + 0.5))  # noqa: E731  exact: sizes are integers
    low = band(F.least("a_n", "b_n"))
    of = lambda x, what: F.when(band(F.col(f"{x}_n")) == low, F.col(f"{x}_{what}0")).otherwise(F.col(f"{x}_{what}1"))
    demand = F.greatest(of("a", "k"), of("b", "k")) - F.floor((F.col("a_n") + F.col("b_n")) / 7) - F.least(of("a", "h"), of("b", "h"))
    likely = common.written(j.where(F.col("shared") >= demand).select("a", "b", "a_id", "b_id"), "op9-pairs", counts[PAIR])
    common.discard(found)

    doubtful = nodes.where(~_complete("h0", "h1"))
    wanted = likely.select(F.col("a_id").alias("id")).union(likely.select("b_id")).union(doubtful.select("id")).distinct()
    sets = common.written(_sets(texts, wanted, counts[DOC]), "op9-sets", counts[DOC], SET_ROWS)
    edges = verified = common.written(_verified(likely, sets), "op9-edges", likely.count(), SET_ROWS)
    labels = graph.components(edges)

    roots = labels.select(F.col("node.key").alias("key"), F.col("root.key").alias("root"))
    placed = doubtful.join(roots, "key", "left").select("key", "id", "n", "k0", "k1", "h0", "h1", F.coalesce("root", "key").alias("comp"))
    every = nodes.select("key").join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("comp"))
    open_sigs = hot.join(every, "key").groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    unsettled = hot.join(open_sigs, "sig").groupBy("key").agg(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)).alias("u0"), F.sum(F.when(F.col("role") == 1, 1).otherwise(0)).alias("u1"))
    d = placed.join(unsettled, "key", "left").na.fill(0, ["u0", "u1"])
    deficient = common.written(d.where(~_complete("u0", "u1")).select("id", "key", "comp"), "op9-deficient", counts[DOC])
    open_comps = lambda d: d.select("comp").distinct().limit(2).count() > 1
    if open_comps(deficient):
        links, left_over, drop = _allocated(deficient, sets, SMALL)
        rest = common.written(left_over, "op9-rest", counts[DOC])
        more = [links]
        n = rest.count()
        if n > 1 and open_comps(rest):
            blocks = math.ceil(n / BLOCK)
            own = rest.join(sets, "key").withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
            to = lambda lo, hi, x, y: own.withColumn("other", F.explode(F.sequence(lo, hi))).select(*[F.col(c).alias(c) for c in ("id", "key", "comp", "set")], F.col(x).alias("i"), F.col(y).alias("j"))
            left, right = to(F.col("own"), F.lit(blocks - 1), "own", "other"), to(F.lit(0), F.col("own"), "other", "own")
            met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_cross, "a_id long, a long, b_id long, b long")
            met = common.written(met, "op9-more")
            more.append(met.select(_node("a_id", "a").alias("a"), _node("b_id", "b").alias("b")))
            drop.append(met)
        fresh = [m for m in more if m.limit(1).count()]
        if fresh:
            for m in fresh:
                edges = edges.union(m)
            labels = graph.components(edges)
        common.discard(rest, *drop)
    common.discard(nodes, hot, likely, sets, verified, deficient)

    ends = labels.select(F.col("node.key").alias("key"), F.col("root.id").alias("low"), F.col("root.key").alias("root"))
    low = F.coalesce("low", "id")
    named = classes.join(ends, "key", "left").select("digest", F.when(low != NO_ID, low).alias("component_id"), F.coalesce("root", "key").alias("root"), F.col("key").alias("own"))
    out = common.spread_join(rows, named, "digest", "left")
    component = F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("own").alias("key"), "root")


def keyed(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """`docs` with the key of each text's set as column `name`, null where a text has no words."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [sh.shingle_set((t or "").encode()) for t in b.column(at).to_pylist()]
            keys = [_digest(s)[1] if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, name])

    return common.map_rows(docs, run, (StructField(name, LongType()),))


def _needs(role: int):
    """`needs` as a column over n."""
    n = F.col("n").cast("long")
    top = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double") + 0.5))).cast("long") - 1
    largest = F.floor(4 * n / 3) if role == 0 else F.least(F.floor(4 * n / 3), top)
    return F.floor((n + largest) / 7) + 1


def _complete(bad0: str, bad1: str):
    """True for documents that find all partners even if so many of their signatures, by role, tell nothing."""
    own = (F.col("k0") - F.col(bad0) >= _needs(0)) | ((F.col("n") <= SHORT) & (F.col(bad0) == 0))
    return own & ((F.col("k1") == 0) | (F.col("k1") - F.col(bad1) >= _needs(1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
