"""Prints one JSON line: seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], and parse throughput."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.dom.frame import STRUCTURE
from sylvan.operators.corpus import Corpus
from sylvan.selector.parser import parse
from sylvan.sources import html

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(run, times: int = 3) -> float:
    took = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return min(took)


def done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    pages = html.pages(spark, SF).repartition(int(CPUS)).persist()
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    queries = {"parse": timed(lambda: done(Corpus.parse(pages, "page_id").nodes))}
    # the tree alone, over the pages ten times: what a parser's node records hold, and enough input to outweigh a job's start
    many = pages.crossJoin(spark.range(10).withColumnRenamed("id", "copy")).select("page_id", "html").persist()
    many.count()
    structure = timed(lambda: done(Corpus.parse(many, "page_id", columns=STRUCTURE).nodes))
    many.unpersist()
    c = Corpus.parse(pages, "page_id").keep()
    c.nodes.count()
    hits = c.query_all("nav > ul > li > a")
    for name, df in {
        "select_tag": c.query_all("p"),
        "select_attribute": c.query_all('a[href^="/t"]:not([href*=th])'),
        "select_child_chain": hits,
        "select_descendant": c.query_all("b p"),
        "select_sibling": c.query_all("li ~ li"),
        "query_one": c.query_one("article > p, b > p"),
        "query_scoped": c.query_all("p", c.scopes("article")),
        "inner_text": c.inner_text(c.query_all("article")),
        "outer_html": c.outer_html(c.query_all("nav")),
        "explain": c.explain("b > p, footer"),
        "near_misses": c.near_misses('a[href^="https"]'),
        "tags_json": c.tags_json(),
    }.items():
        queries[name] = timed(lambda df=df: done(df))
    start = time.perf_counter()
    for _ in range(2000):
        parse("ul > li.item[data-prefix^=pre]:not(.skip) span.name")
    queries["selector_compile_each"] = (time.perf_counter() - start) / 2000
    total = sum(queries.values())
    print(json.dumps({"metric": "headline queries, total", "value": round(total, 3), "unit": "sec", "queries": {k: round(v, 6) for k, v in queries.items()}, "parse_mb_per_s": round(size / 1e6 / queries["parse"], 2), "parse_structure_mb_per_s": round(10 * size / 1e6 / structure, 2), "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
