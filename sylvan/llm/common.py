"""What the operators of this subpackage share: sessions, shared storage and column hygiene."""

from __future__ import annotations

import ctypes
import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from sylvan.session import importable

#: Rows and bytes of one Arrow batch of texts. Both bound a Python worker's memory; neither drops rows.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20

#: `[^\x20\x09-\x0D]+`: words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small enough for very long texts."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def columns(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def release() -> None:
    """Gives back what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run):
    """`run`, for mapInArrow, that releases memory at the end of a task: workers wait for the next one beside the executor."""

    def tidy(batches):
        yield from run(batches)
        release()

    return tidy


def map_rows(df: DataFrame, run, more: tuple[StructField, ...] = ()) -> DataFrame:
    """df.mapInArrow for functions that give back the columns of `df`, whatever their names, with `more` after them. In the
    function's batches the columns are named by number."""
    plain = df.toDF(*[str(i) for i in range(len(df.columns))])
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain.columns, df.schema.fields, strict=True)] + list(more))
    return plain.mapInArrow(lean(run), schema).toDF(*df.columns, *[f.name for f in more])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Where it is unset, only a local master, whose
    executors are this machine, may take /tmp."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "/tmp/checkpoints/sylvan"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(top)
    return top.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sylvan/{name}-{uuid.uuid4().hex}"


#: Rows of a file, where they are a few numbers and hashes.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str, rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors.

    Where it is known to have about `rows` rows at most, there are no more files than one for every `file_rows`, or two for
    every core if that is more, however many partitions the last shuffle had: on a local disk without Hadoop's native
    library each file makes its executor start three processes (chmod).
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // file_rows)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    _LEFT.add(path)
    return out


#: Paths of tables that `written` made and nobody has discarded.
_LEFT: set[str] = set()


def sweep(spark: SparkSession) -> int:
    """Removes all tables that `written` has left in the shared folder; for when results that read from them are stored. How
    many there were."""
    paths = sorted(_LEFT)
    for p in paths:
        delete(spark, p)
    return len(paths)


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` made, once all that was read from them is itself written."""
    for t in tables:
        delete(t.sparkSession, t._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    _LEFT.discard(path)


#: A key is hot if it has more than one in HOT_SHARE of a table's rows, so there are fewer hot keys than that; and no key of
#: fewer than HOT_LEAST rows is.
HOT_SHARE, HOT_LEAST = 1000, 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, where `key` is unique in `right` and any one of its values may hold a large part of `left`.

    The rows of hot keys stay where they are and meet their few partners by broadcast (fewer than HOT_SHARE rows of `right`);
    all others meet theirs in a shuffle. `how` is inner or left; null keys have no partner. Reads `left` twice. Only the hot
    keys themselves pass through the driver.
    """
    total = left.count()
    if total <= HOT_LEAST:
        return left.join(right, key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    keys = counts.where(F.col("__n") > max(HOT_LEAST, total // HOT_SHARE)).select(key)
    rows = keys.collect()
    if not rows:
        return left.join(right, key, how)
    kind = keys.schema[0].dataType
    hot = F.coalesce(F.col(key).isin([_literal(r[0], kind) for r in rows]), F.lit(False))
    few = F.broadcast(right.where(hot))
    return left.where(~hot).join(right, key, how).unionByName(left.where(hot).join(few, key, how))


def _literal(value, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)])
    return F.lit(value).cast(kind)


def input_bytes(texts: DataFrame) -> int:
    """About how many bytes the rows (doc_id, text) hold: Spark's estimate, which follows file sizes, or a sum over all texts
    where Spark knows nothing of the input and says it is over a hundred petabytes."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 10**17 else texts.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]


def doc_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id long, text string); null texts count as empty. Other columns, whatever their names, stay out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def remainder(id_col, k: int):
    """crc32 of the id as text, modulo k: the fold of a row; null ids have none."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(k)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; SYLVAN_TOKENIZERS overrides the installed folder."""
    if top := os.environ.get("SYLVAN_TOKENIZERS"):
        return f"{top}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
