"""Mixing sources to target weights: hash-threshold histograms.

A source's share is filled by whole passes over its documents and then by those whose hash lies under a threshold. The
threshold comes from sums of words by hash bucket: only the bucket in which the budget ends is looked at more finely, so
nothing is sorted, a larger budget keeps all that a smaller one takes, and reruns agree. The last bucket is a single hash; if
several rows have it, they are equal in id and text, and a count tells how many of them are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.llm import common

#: Hashes have 60 bits, taken from 15 digits of MD5, and are refined by 12 bits at a time.
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(id_col: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id and the text; only rows equal in both have one hash."""
    both = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(both.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(common.SPACED_WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], cap: int, share: float) -> DataFrame:
    """(source, z) with a target for each source: its weight's share of all words, at most `cap` times its size z; what is
    over goes to the others by weight. Sources in order of z by weight reach their caps one after another, so running sums
    tell where that ends. One row a source goes through one task; documents don't."""
    rank = Window.orderBy(F.col("source").isNull(), "source")
    w = totals.withColumn("rank", F.row_number().over(rank)).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    order = Window.orderBy((F.col("z") * F.lit(cap)).cast("double") / F.col("w").cast("double"), "rank")
    after, every = order.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(F.col("z") * F.lit(cap)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = w.withColumn("all", F.sum("z").over(every)).withColumn("rate", (F.col("all").cast("double") * F.lit(share) - capped.cast("double")) / F.sum("w").over(after).cast("double"))
    fits = F.col("rate") * F.col("w").cast("double") <= (F.col("z") * F.lit(cap)).cast("double")
    level = left.withColumn("level", F.first(F.when(fits, F.col("rate")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("source", "z", F.least((F.col("z") * F.lit(cap)).cast("double"), F.col("level") * F.col("w").cast("double")).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds to (source, z, target, full, rest) `under`: hashes below it are taken once more; and `edge` with `take`: of the
    rows of that hash so many are. edge is null where all rows of a hash are taken or left.

    Each round sums words by source and bucket in the one open bucket of each source, whose rows become fewer by 4096
    from round to round; the last one sees single hashes, and takes of the one at the edge what comes nearest to the budget.
    """
    levels: list[DataFrame] = []
    at = plan.select("source", "z", "target", "full", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("sum_below"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        span = 1 << (shift + LEVEL_BITS)
        open_rows = rows.alias("r").join(at.select(F.col("source").alias("s"), "low").alias("p"), F.col("r.source").eqNullSafe(F.col("p.s")) & (F.col("r.h") >= F.col("p.low")) & (F.col("r.h") < F.col("p.low") + F.lit(span)))
        sums = open_rows.groupBy("source", "low", F.shiftright(F.col("h") - F.col("low"), shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        cum = sums.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        inside = cum.alias("c").join(at.select(F.col("source").alias("s"), "rest", "sum_below").alias("p"), F.col("c.source").eqNullSafe(F.col("p.s")))
        past = (F.col("sum_below") + F.col("until")).cast("double") > F.col("rest")
        edge = inside.groupBy("source").agg(F.min(F.when(past, F.struct("bucket", "until", "words", "n"))).alias("e"), F.max("until").alias("held"))
        edge = edge.select(F.col("source").alias("s"), "e", "held")
        joined = at.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        below = F.col("sum_below") + F.col("e.until") - F.col("e.words")
        if shift:  # without an edge, all of the open bucket is taken
            at = joined.select("source", "z", "target", "full", "rest", F.when(F.col("e").isNotNull(), F.col("low") + F.shiftleft(F.col("e.bucket"), shift)).otherwise(F.col("low") + F.lit(span - (1 << shift))).alias("low"), F.when(F.col("e").isNotNull(), below).otherwise(F.col("sum_below") + F.coalesce("held", F.lit(0))).alias("sum_below"))
            at = common.written(at, "op10-level")
            levels.append(at)
        else:
            share = (F.col("rest") - below.cast("double")) * F.col("e.n").cast("double") / F.col("e.words").cast("double")
            take = F.least(F.col("e.n"), F.greatest(F.lit(0), F.ceil(share - F.lit(0.5))))
            at = joined.select("source", "z", "target", "full", "rest", (F.col("low") + F.col("e.bucket")).alias("hash"), take.alias("take"), F.col("e.n").alias("n"), (F.col("low") + F.lit(span)).alias("past"))
    split = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    under = F.coalesce(F.col("hash") + (F.col("take") == F.col("n")).cast("long"), F.col("past"))
    at = common.written(at.select("source", "z", "target", "full", under.alias("under"), F.when(split, F.col("hash")).alias("edge"), "take"), "op10-thresholds")
    common.discard(*levels)
    return at


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Adds `nth`, from 1, to rows of a written table in which `spot` is their place (monotonically_increasing_id when they were
    written). Rows of one task's part are counted off by themselves and the parts' sizes added up, so a hash may have any
    number of rows."""
    part = F.shiftright("spot", 33)
    rows = rows.withColumn("part", part).withColumn("own", F.row_number().over(Window.partitionBy(by, "part").orderBy("spot")))
    sizes = rows.groupBy(by, "part").agg(F.count("*").alias("size_of_part"))
    before = sizes.select(F.col(by).alias("b"), F.col("part").alias("p"), (F.sum("size_of_part").over(Window.partitionBy(by).orderBy("part")) - F.col("size_of_part")).alias("before"))
    return rows.join(before, F.col(by).eqNullSafe(F.col("b")) & (F.col("part") == F.col("p"))).withColumn("nth", F.col("before") + F.col("own")).drop("b", "p", "before", "own", "part")


def _split(cut: DataFrame) -> bool:
    return bool(cut.where("edge is not null").limit(1).count())


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, thresholds): (doc_id, source, size, h, spot) of each document, and what is taken of each source."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col).cast("long"), F.col(text_col)).alias("h"))
    rows = common.written(slim.withColumn("spot", F.monotonically_increasing_id()), "op10-rows")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("z")), weights, cap, share)
    full = F.when(F.col("z") > 0, F.floor(F.col("target") / F.col("z").cast("double"))).otherwise(F.lit(0)).cast("long")
    plan = common.written(plan.withColumn("full", full).withColumn("rest", F.col("target") - (F.col("full") * F.col("z")).cast("double")), "op10-plan")
    cut = thresholds(rows, plan)
    common.discard(plan)
    return rows, cut


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row of `docs`.

    size counts words between ASCII white space (null text: 0). Null sources are one source, last in order; an empty table
    gives an empty result. Null ids and ids that repeat are no special case: rows go by id and text together, and of rows
    equal in both as many are taken as the budget asks, so a source misses its target by half a document at most. No
    document is taken more than `cap` times. Of columns, only those named in `options` matter.
    """
    rows, cut = plan_mix(docs, **options)
    j = rows.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    more = F.col("h") < F.col("under")
    if _split(cut):
        tied = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
        tied_rows = _numbered(j.where(tied), "source").withColumn("more", F.col("nth") <= F.col("take")).drop("nth")
        j = j.where(~tied).withColumn("more", more).unionByName(tied_rows)
        more = F.col("more")
    return j.select("doc_id", "size", F.col("z").alias("source_size"), "target", (F.col("size") * (F.col("full") + more.cast("long"))).alias("taken"), "source")


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with all columns of `docs` whatever their names: each row as often as the mix takes it.
    Null, repeated and empty rows are treated as in `mix`; of rows equal in id and text the first by place are taken."""
    rows, cut = plan_mix(docs, **options)
    common.discard(rows)
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    packed = docs.select(F.struct(*common.columns(docs)).alias("row"), hash_of(F.col(id_col).cast("long"), F.col(text_col)).alias("h"), F.col(source_col).cast("string").alias("source"))
    j = packed.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    more = F.col("h") < F.col("under")
    if _split(cut):
        tied = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
        tied_rows = common.written(j.where(tied).withColumn("spot", F.monotonically_increasing_id()), "op10-tied")
        tied_rows = _numbered(tied_rows, "source").withColumn("more", F.col("nth") <= F.col("take")).drop("nth", "spot")
        j = j.where(~tied).withColumn("more", more).unionByName(tied_rows)
        more = F.col("more")
    copies = (F.col("full") + more.cast("long")).cast("int")
    return j.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM t),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM r),
k AS (SELECT *, (SELECT sum(z) FROM t) AS a,
        coalesce(sum(3 * z) OVER (ORDER BY CAST(3 * z AS DOUBLE) / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
        sum(w) OVER (ORDER BY CAST(3 * z AS DOUBLE) / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM w),
l AS (SELECT *, (CAST(a AS DOUBLE) - CAST(c AS DOUBLE)) / CAST(v AS DOUBLE) AS rate FROM k),
f AS (SELECT rate FROM l WHERE rate * CAST(w AS DOUBLE) <= CAST(3 * z AS DOUBLE) ORDER BY CAST(3 * z AS DOUBLE) / w, rank LIMIT 1),
g AS (SELECT source, z, least(CAST(3 * z AS DOUBLE), (SELECT rate FROM f) * CAST(w AS DOUBLE)) AS target FROM l),
p AS (SELECT *, CASE WHEN z > 0 THEN CAST(floor(target / CAST(z AS DOUBLE)) AS BIGINT) ELSE 0 END AS n FROM g),
q AS (SELECT *, target - CAST(n * z AS DOUBLE) AS rest FROM p),
b AS (SELECT source, h, sum(size) AS s, count(*) AS m FROM d GROUP BY source, h),
e AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY h) AS u FROM b),
x AS (SELECT e.source, e.h, CASE WHEN CAST(e.u AS DOUBLE) <= q.rest THEN e.m WHEN CAST(e.u - e.s AS DOUBLE) > q.rest THEN 0
        ELSE least(e.m, greatest(0, ceil((q.rest - CAST(e.u - e.s AS DOUBLE)) * CAST(e.m AS DOUBLE) / CAST(e.s AS DOUBLE) - 0.5))) END AS k
      FROM e JOIN q ON e.source IS NOT DISTINCT FROM q.source),
y AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS nth FROM d)
SELECT y.doc_id, y.size, q.z AS source_size, q.target, CAST(y.size * (q.n + CASE WHEN y.nth <= x.k THEN 1 ELSE 0 END) AS BIGINT) AS taken, y.source
FROM y JOIN q ON y.source IS NOT DISTINCT FROM q.source JOIN x ON y.source IS NOT DISTINCT FROM x.source AND y.h = x.h
"""
