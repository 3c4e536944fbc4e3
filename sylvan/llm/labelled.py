"""Labelled samples for the classifiers: folds, a bounded sample of texts, and scoring over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm import common

SCORED = "doc_id long, held_out boolean, score double, predicted int"


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], most: int) -> DataFrame:
    """(doc_id, text, y) for labelled rows outside the held-out fold, about `most` of them if there are more.

    fold (k, r): ids whose crc32 as text leaves r modulo k are held out. Which rows stay depends on their ids alone. Rows
    without id or label don't count; of several labels for an id the smallest holds. The labels that stay, whose number
    `most` bounds, are broadcast: texts aren't shuffled. Written to the shared folder, since it is read more than once.
    """
    common.tune(docs.sparkSession)
    k, r = fold
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(common.remainder(F.col("doc_id"), k) != r).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    return common.written(common.doc_text(docs).join(F.broadcast(known), "doc_id"), "labelled")


def features(rows: DataFrame, names: tuple[str, ...], of: Callable[[list[str]], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, features, labels) of a bounded sample, on the driver, in order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = of(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x[:, i]) for i in range(len(names)))], names=["doc_id", "y", *names])

    t = rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, " + ", ".join(f"{c} double" for c in names)).toArrow()
    x = np.column_stack([t[c].to_numpy() for c in names]) if t.num_rows else np.zeros((0, len(names)))
    ids, y = t["doc_id"].to_numpy(), t["y"].to_numpy().astype(int)
    order = np.lexsort((*x.T, ids))
    return ids[order], x[order], y[order]


def score(docs: DataFrame, fold: tuple[int, int], of: Callable[[list[str]], np.ndarray], threshold: float, carry: str = "") -> DataFrame:
    """Scores every row in one pass; `of` maps texts to scores from 0 to 1. Null ids are in no fold."""
    common.tune(docs.sparkSession)
    k, r = fold
    rows = common.doc_text(docs).select("doc_id", "text", F.coalesce(common.remainder(F.col("doc_id"), k) == r, F.lit(False)).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(of(b.column(1).to_pylist()), 0.0, 1.0) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, SCORED)
