"""The engine's front: a parsed corpus and what can be asked of it. All answers are lazy DataFrames."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sylvan.dom.frame import parse_nodes
from sylvan.functions import text as fn
from sylvan.plans import explain, select
from sylvan.selector.parser import InvalidSelector, Selector, ascii_lower


def required_tags(selector: str | Selector) -> set[str]:
    """Tags without which no group of the selector can match."""
    per_group = [{c.tag for c in g if c.tag} for g in select.as_selector(selector).groups]
    return set.intersection(*per_group)


def skip_documents(df: DataFrame, selector: str | Selector, html_col: str = "html") -> DataFrame:
    """Leaves out documents that can't match before they are parsed: a required tag must be opened somewhere."""
    for tag in sorted(required_tags(selector)):
        df = df.where(F.col(html_col).rlike(rf"(?i)<[ \n\r\t\f]*{tag}"))
    return df


#: The kinds of queries that hooks tell apart.
KINDS = ("one_runtime", "one_cached", "all_runtime", "all_cached")


class Corpus:
    """A node table (`sylvan.dom.frame.SCHEMA`), one row a node, keyed by (doc_id, node_idx).

    A doc_id is taken to be one document: rows that share one are mixed up in every join, and rows without one are in no join,
    so that they answer selectors of single compounds only. Give such tables an id of their own first.
    """

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes

    @classmethod
    def parse(cls, df: DataFrame, id_col: str = "doc_id", html_col: str = "html", drop_ws: bool = True, columns: Sequence[str] | None = None) -> Corpus:
        """Parses every document, into all columns of the node table or those that the queries to come ask for."""
        return cls(parse_nodes(df, id_col, html_col, drop_ws, columns))

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """The node table at rest. Rows of a file stand by tag, so that row groups of other tags are skipped by their
        statistics, and ids have Bloom filters: `#id` and tag queries over `read` open little of it."""
        rows = self.nodes.sortWithinPartitions("tag", "doc_id", "node_idx")
        rows.write.mode(mode).option("parquet.bloom.filter.enabled#id", "true").option("parquet.block.size", str(32 << 20)).parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(spark.read.parquet(path))

    def keep(self) -> Corpus:
        """Holds the nodes for several queries, hash-partitioned by document so that joins on it need no shuffle."""
        self.nodes.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.nodes = self.nodes.repartition("doc_id").persist()
        return self

    def clear(self) -> None:
        self.nodes.unpersist()

    @property
    def documents(self) -> DataFrame:
        return self.nodes.where("node_idx = 0").select("doc_id", "doc_text", "doc_html", "input_len", "node_count")

    @property
    def elements(self) -> DataFrame:
        return self.nodes.where("kind = 'element'")

    def node_at(self, index: int) -> DataFrame:
        return self.nodes.where(F.col("node_idx") == index)

    # selection

    def query_all(self, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
        """(doc_id[, scope_idx], node_idx) of all matches; order them at the sink if it matters."""
        return select.match(self.nodes, selector) if scopes is None else select.match_scoped(self.nodes, scopes, selector)

    def query_one(self, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
        """The first match in preorder of each document or scope that has one."""
        hits = self.query_all(selector, scopes)
        keys = [c for c in hits.columns if c != "node_idx"]
        return hits.groupBy(*keys).agg(F.min("node_idx").alias("node_idx"))

    def scopes(self, selector: str | Selector) -> DataFrame:
        """All matches, as scopes for further queries."""
        return self.query_all(selector).select("doc_id", F.col("node_idx").alias("scope_idx"))

    def count(self, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
        """(doc_id, n) for every document, zeros included."""
        n = self.query_all(selector, scopes).groupBy("doc_id").agg(F.count("*").alias("n"))
        return self.nodes.where("node_idx = 0").select("doc_id").join(n, "doc_id", "left").na.fill(0, ["n"])

    def count_in_first(self, tag: str, selector: str | Selector) -> DataFrame:
        """Matches inside the first element of a tag; 0 without such an element."""
        first = self.find_first_tag(tag).select("doc_id", F.col("node_idx").alias("scope_idx"))
        return self.count(selector, first)

    def explain(self, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
        return explain.report(self.nodes, selector, scopes)

    def near_misses(self, selector: str | Selector, scopes: DataFrame | None = None) -> DataFrame:
        return explain.near_misses(self.nodes, selector, scopes)

    # navigation: (doc_id, node_idx, <answer>) for every element, null without one

    def nav(self, relation: str) -> DataFrame:
        """relation: parent, first_child, last_child, next_sibling or prev_sibling; elements only."""
        e = self.elements
        if relation == "parent":
            return e.select("doc_id", "node_idx", F.when(F.col("parent") != 0, F.col("parent")).alias(relation))
        if relation == "last_child":
            return e.select("doc_id", "node_idx", F.col("last_child").alias(relation))
        if relation == "prev_sibling":
            return e.select("doc_id", "node_idx", F.col("prev_sibling").alias(relation))
        base = e.select("doc_id", "node_idx")
        link, test = {"first_child": ("parent", F.col("sib_pos") == 1), "next_sibling": ("prev_sibling", F.col("prev_sibling").isNotNull())}[relation]
        other = e.where(test).select("doc_id", F.col(link).alias("node_idx"), F.col("node_idx").alias(relation))
        return base.join(other, ["doc_id", "node_idx"], "left")

    def children(self) -> DataFrame:
        """(doc_id, node_idx, children): element children of every element, in order, as an array."""
        kids = self.elements.groupBy("doc_id", F.col("parent").alias("node_idx")).agg(F.sort_array(F.collect_list("node_idx")).alias("children"))
        return self.elements.select("doc_id", "node_idx").join(kids, ["doc_id", "node_idx"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<int>")))

    def find_first_tag(self, tag: str) -> DataFrame:
        return self.elements.where(F.col("tag") == ascii_lower(tag)).groupBy("doc_id").agg(F.min("node_idx").alias("node_idx"))

    def landmarks(self) -> DataFrame:
        """(doc_id, html, head, body): the first element of each tag, null without one."""
        first = self.elements.where(F.col("tag").isin("html", "head", "body")).groupBy("doc_id").agg(*[F.min(F.when(F.col("tag") == t, F.col("node_idx"))).alias(t) for t in ("html", "head", "body")])
        return self.nodes.where("node_idx = 0").select("doc_id").join(first, "doc_id", "left")

    def descendants(self) -> DataFrame:
        """(doc_id, node_idx, n): how many nodes are below each element."""
        return self.elements.select("doc_id", "node_idx", (F.col("subtree_end") - F.col("node_idx")).cast("long").alias("n"))

    # extraction for given nodes (doc_id, node_idx)

    def _of(self, hits: DataFrame, *cols) -> DataFrame:
        return self.nodes.join(hits.select("doc_id", "node_idx"), ["doc_id", "node_idx"], "left_semi").select("doc_id", "node_idx", *cols)

    def attribute(self, hits: DataFrame, name: str) -> DataFrame:
        return self._of(hits, F.try_element_at(F.col("attr_map"), F.lit(ascii_lower(name))).alias("value"))

    def _slices(self, hits: DataFrame, whole: str, start: str, end: str) -> DataFrame:
        docs = self.nodes.where("node_idx = 0").select("doc_id", F.col(whole).alias("__whole"))
        cut = F.substring("__whole", F.col(start) + 1, F.col(end) - F.col(start))
        return self._of(hits, start, end).join(docs, "doc_id").select("doc_id", "node_idx", cut.alias("value"))

    def inner_text(self, hits: DataFrame, normalize: bool = True) -> DataFrame:
        """The decoded text below each node, in order, without separators; white space collapsed unless told otherwise."""
        rows = self._slices(hits, "doc_text", "text_start", "text_end")
        return rows.withColumn("value", fn.normalize_space(F.col("value"))) if normalize else rows

    def outer_html(self, hits: DataFrame) -> DataFrame:
        return self._slices(hits, "doc_html", "html_start", "html_end")

    def html_self(self, hits: DataFrame) -> DataFrame:
        """Start tags; texts as they stand; of the document all it holds."""
        return self._slices(hits, "doc_html", "html_start", "html_open_end")

    def canonical_self(self, hits: DataFrame) -> DataFrame:
        """Start tags with every value in double quotes and escaped, as after all attributes were read."""
        return self._of(hits, F.col("canonical_open").alias("value"))

    # sinks

    def tags_json(self) -> DataFrame:
        """(doc_id, json): names of all elements in preorder."""
        return self._json(self.elements.select("doc_id", "node_idx", F.col("tag_raw").alias("x")))

    def ids_json(self, selector: str | Selector) -> DataFrame:
        """(doc_id, json): ids of the matches in preorder; elements without id are left out."""
        return self._json(self._of(self.query_all(selector), F.col("id").alias("x")).where(F.col("x").isNotNull()))

    def _json(self, rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("doc_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("node_idx", "x"))), lambda s: s["x"])).alias("json"))
        return self.nodes.where("node_idx = 0").select("doc_id").join(lists, "doc_id", "left").na.fill("[]", ["json"])

    # instrumentation

    def parse_stats(self) -> DataFrame:
        return self.documents.select("doc_id", "input_len", "node_count")

    def observed(self, selector: str | Selector, one: bool = False) -> tuple[DataFrame, Observation]:
        """A query whose run also fills an Observation with its number of matches."""
        seen = Observation("query")
        rows = self.query_one(selector) if one else self.query_all(selector)
        return rows.observe(seen, F.count(F.lit(1)).alias("matches")), seen

    def query_stats(self, selector: str | Selector, kind: str | None = None) -> DataFrame:
        """(doc_id, selector_len, kind, matched) of a query. Whether it matched is told of first-match kinds only; a Selector
        that was compiled before is a cached query, a string a runtime one."""
        kind = kind or ("one_cached" if isinstance(selector, Selector) else "one_runtime")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        s = select.as_selector(selector)
        docs = self.nodes.where("node_idx = 0").select("doc_id")
        if kind.startswith("all"):
            out = docs.withColumn("matched", F.lit(None).cast("boolean"))
        else:
            out = docs.join(self.query_one(s).select("doc_id", F.lit(True).alias("matched")), "doc_id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
        return out.select("doc_id", F.lit(len(s.source.encode())).cast("long").alias("selector_len"), F.lit(kind).alias("kind"), "matched")

    def with_hooks(self, selector: str | Selector, kind: str = "one_runtime", on_start: Callable[[dict], None] | None = None, on_end: Callable[[dict], None] | None = None) -> int:
        """Runs a query over the whole corpus and gives its number of matches (for first-match kinds, of documents with one).
        on_start gets selector_len and kind, on_end those and elapsed_ns and matched (null for kinds that find all)."""
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        told = {"selector_len": len((selector.source if isinstance(selector, Selector) else selector).encode()), "kind": kind}
        if on_start:
            on_start(told)
        start = time.perf_counter_ns()
        n = (self.query_one(selector) if kind.startswith("one") else self.query_all(selector)).count()
        if on_end:
            on_end(told | {"elapsed_ns": time.perf_counter_ns() - start, "matched": n > 0 if kind.startswith("one") else None})
        return n

    @classmethod
    def parse_with_hooks(cls, df: DataFrame, id_col: str = "doc_id", html_col: str = "html", on_start: Callable[[dict], None] | None = None, on_end: Callable[[dict], None] | None = None) -> Corpus:
        """Parses and keeps a corpus. on_start gets input_len, on_end that and node_count (documents included) and elapsed_ns."""
        size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(html_col))), F.lit(0))).first()[0]
        if on_start:
            on_start({"input_len": size})
        start = time.perf_counter_ns()
        corpus = cls.parse(df, id_col, html_col).keep()
        n = corpus.nodes.count()
        if on_end:
            on_end({"elapsed_ns": time.perf_counter_ns() - start, "input_len": size, "node_count": n})
        return corpus


__all__ = ["Corpus", "InvalidSelector", "required_tags", "skip_documents"]
