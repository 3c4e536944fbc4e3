"""The engine's queries by name, each beside the SQL that checks it.

Queries over `pages` have SQL that parses pages again; queries over small documents given here have their results as VALUES.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import text as fn
from sylvan.operators.corpus import KINDS, Corpus, InvalidSelector, skip_documents
from sylvan.plans.oracle import NODES, NORMAL, STRICT
from sylvan.selector.parser import compiled, parse
from sylvan.sources import html as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_held: dict[tuple, Corpus] = {}

#: The two small documents of the selector conformance cases.
DOC = '<root><div id="hsoob"><div class="a b"><div class="d e sib" test="fg" id="booshTest"><p><span id="spanny"></span></p></div><em nopass="copyrighters" rel="copyright booshrs" test="f g" class="sib"></em><span class="h i a sib"></span></div><p class="odd"></p></div><div id="lonelyHsoob"></div></root>'
FRAG = '<root><div class="d i v"><p id="oooo"><em></em><em id="emem"></em></p></div><p id="sep"><div class="a"><span></span></div></p></root>'


def corpus(spark: SparkSession, sf_dir: str, drop_ws: bool = True) -> Corpus:
    """The parsed pages, held for the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir, drop_ws)
    if key not in _held:
        _held[key] = Corpus.parse(source.pages(spark, sf_dir), "page_id", "html", drop_ws).keep()
    return _held[key]


def small(spark: SparkSession, *docs: str, drop_ws: bool = True) -> Corpus:
    return Corpus.parse(source.inline(spark, dict(enumerate(docs, 1))), drop_ws=drop_ws)


def pages(name: str, sql: str, strict: bool = False):
    """Registers a query over the parsed pages: Corpus to DataFrame."""

    def add(f: Callable[[Corpus], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(corpus(spark, sf_dir, not strict))
        SQL[name] = (STRICT if strict else NODES) + sql
        return f

    return add


def given(name: str, columns: str, rows: list[tuple]):
    """Registers a query over small documents with its expected rows; columns as "name type, ..." in DuckDB's types."""

    def add(f: Callable[[SparkSession], DataFrame]):
        QUERIES[name] = lambda spark, _: f(spark)
        names = [c.split()[0] for c in columns.split(", ")]
        kinds = [c.split()[1] for c in columns.split(", ")]
        quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        values = ", ".join("(" + ", ".join(f"CAST({quote(v)} AS {k})" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
        SQL[name] = f"SELECT * FROM (VALUES {values}) AS t({', '.join(names)})"
        return f

    return add


def longs(df: DataFrame, *names: str) -> DataFrame:
    for n in names or [c for c, t in df.dtypes if t == "int"]:
        df = df.withColumn(n, F.col(n).cast("long"))
    return df


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ids(c: Corpus, selector: str, **extra: object) -> DataFrame:
    """One row: the selector and the ids of its matches in order, joined."""
    hits = c._of(c.query_all(selector), F.col("id").alias("x")).where("x is not null")
    agg = hits.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "node_idx", "x"))), lambda s: s["x"]), " ").alias("ids"))
    return agg.select(F.lit(selector).alias("selector"), "ids", *[F.lit(v).alias(k) for k, v in extra.items()])


def counts(c: Corpus, cases: list[str], scope: str | None = None) -> DataFrame:
    def one(selector: str) -> DataFrame:
        hits = c.query_all(selector, c.scopes(scope) if scope else None)
        return hits.agg(F.count("*").alias("n")).select(F.lit(selector).alias("selector"), "n")

    return union([one(s) for s in cases])


# --- sources, lifecycle and parsing ---

QUERIES["scan_pages"] = lambda spark, sf_dir: source.pages(spark, sf_dir).select("page_id", F.octet_length("html").cast("long").alias("bytes"))
SQL["scan_pages"] = "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages"

pages("parse_nodes", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, kind, coalesce(tag, '') AS tag, CAST(parent AS BIGINT) AS parent FROM nodes")(lambda c: longs(c.nodes.select("doc_id", "node_idx", "kind", F.coalesce("tag", F.lit("")).alias("tag"), "parent")))
pages("node_at", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, kind, tag FROM nodes WHERE idx = 5")(lambda c: longs(c.node_at(5).select("doc_id", "node_idx", "kind", "tag")))
pages("text_nodes_fast", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, txt AS value FROM nodes WHERE kind = 'text'")(lambda c: longs(c.nodes.where("kind = 'text'").select("doc_id", "node_idx", F.col("text").alias("value"))))
pages("text_nodes_strict", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, txt AS value FROM nodes WHERE kind = 'text'", strict=True)(lambda c: longs(c.nodes.where("kind = 'text'").select("doc_id", "node_idx", F.col("text").alias("value"))))
pages("void_tags", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, tag, fin = idx AS leaf FROM el WHERE tag IN ('br', 'meta')")(lambda c: longs(c.elements.where("tag in ('br', 'meta')").select("doc_id", "node_idx", "tag", (F.col("subtree_end") == F.col("node_idx")).alias("leaf"))))
pages("raw_text", "SELECT e.page_id AS doc_id, CAST(e.idx AS BIGINT) AS node_idx, n.txt AS value FROM el e JOIN nodes n ON n.page_id = e.page_id AND n.idx = e.idx + 1 WHERE e.tag IN ('script', 'style', 'title')")(lambda c: longs(c.inner_text(c.query_all("script, style, title"), normalize=False)))
pages("implicit_close", "SELECT c.page_id AS doc_id, c.tag, p.tag AS parent_tag, count(*) AS n FROM el c JOIN nodes p ON p.page_id = c.page_id AND p.idx = c.parent WHERE c.tag IN ('p', 'li', 'body') GROUP BY ALL")(
    lambda c: c.elements.where("tag in ('p', 'li', 'body')").join(c.nodes.select("doc_id", F.col("node_idx").alias("parent"), F.coalesce("tag", F.lit("")).alias("parent_tag")), ["doc_id", "parent"]).groupBy("doc_id", "tag", "parent_tag").agg(F.count("*").alias("n"))
)
pages("close_tag_recovery", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, tag, CAST(depth AS BIGINT) AS depth FROM el WHERE tag IN ('b', 'footer', 'article')")(lambda c: longs(c.elements.where("tag in ('b', 'footer', 'article')").select("doc_id", "node_idx", "tag", "depth")))
pages("comments", "SELECT page_id AS doc_id, count(*) FILTER (WHERE txt LIKE '%<!--%') AS n FROM nodes GROUP BY page_id")(lambda c: c.nodes.groupBy("doc_id").agg(F.coalesce(F.sum(F.col("text").contains("<!--").cast("long")), F.lit(0)).alias("n")))
pages("tree_links", "SELECT n.page_id AS doc_id, CAST(n.idx AS BIGINT) AS node_idx, CAST(n.parent AS BIGINT) AS parent, e.prev AS prev_sibling, (SELECT max(x.idx) FROM el x WHERE x.page_id = n.page_id AND x.parent = n.idx) AS last_child FROM nodes n LEFT JOIN el e USING (page_id, idx)")(lambda c: longs(c.nodes.select("doc_id", "node_idx", "parent", "prev_sibling", "last_child")))
pages("subtree_end", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, CAST(fin AS BIGINT) AS subtree_end FROM nodes")(lambda c: longs(c.nodes.select("doc_id", "node_idx", "subtree_end")))
pages("parse_tags", "SELECT page_id AS doc_id, to_json(list(tag ORDER BY idx)) AS json FROM el GROUP BY page_id")(lambda c: c.tags_json())
pages("parse_stats", "SELECT n.page_id AS doc_id, any_value(octet_length(encode(p.html))) AS input_len, count(*) AS node_count FROM nodes n JOIN pages p ON p.page_id = n.page_id GROUP BY n.page_id")(lambda c: c.parse_stats())


def _nodes_of(spark: SparkSession, *docs: str, drop_ws: bool = True) -> DataFrame:
    c = small(spark, *docs, drop_ws=drop_ws)
    return longs(c.nodes.where("node_idx > 0").select("doc_id", "node_idx", "kind", F.coalesce("tag_raw", "raw_text").alias("value"), "parent", "subtree_end"))


_NODE = "doc_id BIGINT, node_idx BIGINT, kind VARCHAR, value VARCHAR, parent BIGINT, subtree_end BIGINT"
given("open_tag_edge", _NODE, [(1, 1, "element", "div<div", 0, 1), (2, 1, "text", "1 ", 0, 1), (2, 2, "element", "2", 0, 2), (3, 1, "element", "div", 0, 1), (4, 1, "text", "a", 0, 1), (4, 2, "text", "b", 0, 2), (5, 1, "text", "x", 0, 1)])(
    lambda spark: _nodes_of(spark, "<div<div>", "1 < 2", "< div>", "a<>b", "x<")
)
given("quoted_gt", "doc_id BIGINT, q VARCHAR, n VARCHAR", [(1, "x>y", "abc"), (2, None, None)])(lambda spark: small(spark, "<div id='a' data-q='x>y' data-n=abc></div>", "<i title=don't>x</i>").elements.select("doc_id", F.col("attr_map")["data-q"].alias("q"), F.col("attr_map")["data-n"].alias("n")))
given("plaintext", _NODE, [(1, 1, "element", "p", 0, 3), (1, 2, "element", "plaintext", 1, 3), (1, 3, "text", "a</plaintext><b>", 2, 3)])(lambda spark: _nodes_of(spark, "<p><plaintext>a</plaintext><b>"))
given("svg_skip", _NODE, [(1, 1, "element", "svg", 0, 2), (1, 2, "text", "<g><svg a='>'></svg></g>", 1, 2), (1, 3, "element", "i", 0, 3), (2, 1, "element", "svg", 0, 1), (2, 2, "element", "i", 0, 2), (3, 1, "element", "svg", 0, 2), (3, 2, "text", "", 1, 2), (4, 1, "element", "svg", 0, 2), (4, 2, "text", "<!-- </svg> --><a", 1, 2)])(
    lambda spark: _nodes_of(spark, "<svg><g><svg a='>'></svg></g></svg><i>", "<svg x='1' /><i>", "<svg></svg>", "<svg><!-- </svg> --><a")
)
given("pi_skip", _NODE, [(1, 1, "element", "i", 0, 2), (1, 2, "text", "t", 1, 2), (2, 1, "text", "a", 0, 1)])(lambda spark: _nodes_of(spark, "<?xml <b> ?><i>t", "a<?x <b>"))
given("comment_edges", _NODE, [(1, 1, "text", "a", 0, 1), (2, 1, "text", "c", 0, 1), (3, 1, "text", "x", 0, 1), (3, 2, "text", "y", 0, 2)])(lambda spark: _nodes_of(spark, "<!-->a", "<!---> b --!> -->c", "x<!-- -->y<!-- z"))
given("whitespace_text", _NODE, [(1, 1, "element", "b", 0, 2), (1, 2, "text", "a", 1, 2), (1, 3, "element", "b", 0, 4), (1, 4, "text", " c ", 3, 4)])(lambda spark: _nodes_of(spark, "<b>a</b> \n<b> c </b>\t"))
given("tag_name", "doc_id BIGINT, node_idx BIGINT, tag_raw VARCHAR, tag VARCHAR", [(1, 1, "blockquoTE", "blockquote"), (1, 2, "div", "div")])(lambda spark: longs(small(spark, "<BLOCKQUOTE><DiV></BlockQuote>").elements.select("doc_id", "node_idx", "tag_raw", "tag")))
given("implicit_close_rules", "selector VARCHAR, ids VARCHAR", [("p + div", "d1"), ("li + li", "l2"), ("dt + dd", "dd1"), ("dd + dt", "dt2"), ("td + th", "th1"), ("tr + tr", "r2 r4"), ("head + body", "bo"), ("option + option", "o2"), ("p p", ""), ("td tr", "r3")])(
    lambda spark: union([ids(small(spark, "<head><body id=bo><p id=p1>x<div id=d1></div><ul><li id=l1>a<li id=l2>b</ul><dl><dt id=dt1>a<dd id=dd1>b<dt id=dt2>c</dl><table><tr id=r1><td id=td1>a<th id=th1>b</tr><tr id=r2></tr><tr id=r4><td id=td2>x<tr id=r3></table><select><option id=o1>a<option id=o2>b</select>"), s) for s in ("p + div", "li + li", "dt + dd", "dd + dt", "td + th", "tr + tr", "head + body", "option + option", "p p", "td tr")])
)

# --- navigation ---

for _name, _sql in {"parent": "nullif(parent, 0)", "first_child": "(SELECT min(x.idx) FROM el x WHERE x.page_id = el.page_id AND x.parent = el.idx)", "last_child": "(SELECT max(x.idx) FROM el x WHERE x.page_id = el.page_id AND x.parent = el.idx)", "next_sibling": "nxt", "prev_sibling": "prev"}.items():
    pages(f"nav_{_name}", f"SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, CAST({_sql} AS BIGINT) AS {_name} FROM el")(lambda c, r=_name: longs(c.nav(r)))
pages("nav_children", "SELECT e.page_id AS doc_id, CAST(e.idx AS BIGINT) AS node_idx, coalesce(string_agg(CAST(x.idx AS VARCHAR), ' ' ORDER BY x.idx), '') AS children FROM el e LEFT JOIN el x ON x.page_id = e.page_id AND x.parent = e.idx GROUP BY ALL")(lambda c: longs(c.children().withColumn("children", F.array_join("children", " ")), "node_idx"))
pages("find_first_tag", "SELECT page_id AS doc_id, CAST(min(idx) AS BIGINT) AS node_idx FROM el WHERE tag = 'p' GROUP BY page_id")(lambda c: longs(c.find_first_tag("P")))
pages("doc_landmarks", "SELECT page_id AS doc_id, CAST(min(idx) FILTER (WHERE tag = 'html') AS BIGINT) AS html, CAST(min(idx) FILTER (WHERE tag = 'head') AS BIGINT) AS head, CAST(min(idx) FILTER (WHERE tag = 'body') AS BIGINT) AS body FROM nodes GROUP BY page_id")(lambda c: longs(c.landmarks()))
pages("descendant_count", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, CAST(fin - idx AS BIGINT) AS n FROM el")(lambda c: longs(c.descendants(), "node_idx"))
given("landmarks_fragment", "doc_id BIGINT, html BIGINT, head BIGINT, body BIGINT", [(1, 1, 2, 3), (2, None, None, None)])(lambda spark: longs(small(spark, "<html><head></head><body></body></html>", "<i></i>").landmarks()))

# --- attributes ---

pages("attr_href", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, href AS value FROM att WHERE tag = 'a'")(lambda c: longs(c.attribute(c.query_all("a"), "HREF")))
pages("attr_lang", "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx, lang AS value FROM att WHERE tag = 'html'")(lambda c: longs(c.attribute(c.query_all("html"), "lang")))


def _map_of(spark: SparkSession, *docs: str) -> DataFrame:
    e = small(spark, *docs).elements.where("node_idx = 1")
    return e.select("doc_id", F.array_join(F.transform("attrs", lambda a: F.concat(a["name_lc"], F.lit("="), a["value"])), "|").alias("attrs"))


_A = "doc_id BIGINT, attrs VARCHAR"
given("attr_lexing", _A, [(1, "click=x"), (2, "b="), (3, "a=|b="), (4, "a=1|a=2"), (5, "x-1_y:z.w=v")])(lambda spark: _map_of(spark, "<i @click='x'>", "<i b / href=x>", "<i a = b>", "<i A=1 a=2>", "<i X-1_y:Z.w=v>"))
given("attr_quoted", _A, [(1, 'a=x"y|b=z'), (2, "a= s |b="), (3, "a=q b")])(lambda spark: _map_of(spark, "<i a='x\"y' b=\"z\">", "<i a= ' s ' b=''>", "<i a='q b"))
given("attr_unquoted", _A, [(1, "href=http:"), (2, "a=b=2"), (3, "b=1"), (4, "a=v'w|c=")])(lambda spark: _map_of(spark, "<i href=http://a/b x=1>", "<i a= b=2>", "<i b=1/ c>", "<i a=v'w c'>"))
given("attr_empty", "doc_id BIGINT, a VARCHAR, b VARCHAR, c VARCHAR", [(1, "", "", None)])(lambda spark: small(spark, "<div b a=   ></div>").elements.select("doc_id", *[F.try_element_at("attr_map", F.lit(k)).alias(k) for k in "abc"]))
given("attr_decode", _A, [(1, "q=&z|n=a&b|m=&nbsp;|x=é<")])(lambda spark: _map_of(spark, "<i q='&amp;z' n=a&amp;b m=&nbsp; x='&#233;&#x3C;'>"))
given("attr_long_entities", "doc_id BIGINT, n BIGINT, b VARCHAR", [(1, 320, "ok")])(lambda spark: small(spark, "<i a='" + "&amp;" * 320 + "' b='ok'>").elements.select("doc_id", F.length(F.col("attr_map")["a"]).cast("long").alias("n"), F.col("attr_map")["b"].alias("b")))

# --- text ---

_TEXT = "SELECT e.page_id AS doc_id, CAST(e.idx AS BIGINT) AS node_idx, {} AS value FROM el e LEFT JOIN nodes n ON n.page_id = e.page_id AND n.kind = 'text' AND n.idx > e.idx AND n.idx <= e.fin WHERE e.tag IN ('article', 'p', 'footer', 'title') GROUP BY ALL"
_RAW = "coalesce(string_agg(n.txt, '' ORDER BY n.idx), '')"
pages("inner_text", _TEXT.format(NORMAL.format(_RAW)))(lambda c: longs(c.inner_text(c.query_all("article, p, footer, title"))))
pages("inner_text_raw", _TEXT.format(_RAW))(lambda c: longs(c.inner_text(c.query_all("article, p, footer, title"), normalize=False)))
QUERIES["normalize_ws"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", fn.normalize_space(F.col("text")).alias("value"))
SQL["normalize_ws"] = f"SELECT doc_id, {NORMAL.format('text')} AS value FROM documents"
QUERIES["lower_ascii"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", fn.ascii_lower(fn.trim_space(F.col("text"))).alias("value"))
SQL["lower_ascii"] = r"SELECT doc_id, translate(regexp_replace(text, '^[ \n\r\t\f]+|[ \n\r\t\f]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS value FROM documents"
QUERIES["entity_decode_documents"] = lambda spark, sf_dir: longs(Corpus.parse(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", False).documents.select("doc_id", "doc_text"))
SQL["entity_decode_documents"] = "SELECT doc_id, replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS doc_text FROM documents"
given("entity_decode", "doc_id BIGINT, value VARCHAR", [(1, "a&b "), (2, "<>\"'&lt;"), (3, "&nbsp;&AMP;&amp&#;&#x;&#xD800;&#1114112;"), (4, "é😀AA")])(
    lambda spark: small(spark, "a&amp;b&#x20;", "&lt;&gt;&quot;&apos;&amp;lt;", "&nbsp;&AMP;&amp&#;&#x;&#xD800;&#1114112;", "&#233;&#x1F600;&#65;&#X41;").documents.select("doc_id", F.col("doc_text").alias("value"))
)
given("inner_text_options", "doc_id BIGINT, value VARCHAR, raw VARCHAR", [(1, "alpha beta gamma", "  alpha \n\t beta   gamma  "), (2, "A B", "A    B"), (3, "x y & z", " x\n y &\tz ")])(
    lambda spark: (lambda c: c.inner_text(c.query_all("div")).join(c.inner_text(c.query_all("div"), normalize=False).withColumnRenamed("value", "raw"), ["doc_id", "node_idx"]).select("doc_id", "value", "raw"))(small(spark, "<div>  alpha \n\t beta   gamma  </div>", "<div>A <b></b>   B</div>", "<div> x\n <span>y</span> &amp;\tz </div>"))
)

# --- serialisation ---

pages("doc_html", "SELECT page_id AS doc_id, string_agg(piece, '' ORDER BY a, b, c) AS value FROM (SELECT page_id, idx AS a, 0 AS b, 0 AS c, t AS piece FROM nodes UNION ALL SELECT page_id, fin, 1, -depth, '</' || tag || '>' FROM el WHERE tag NOT IN ('br', 'meta')) GROUP BY page_id")(lambda c: c.documents.select("doc_id", F.col("doc_html").alias("value")))


def _tags_html(spark: SparkSession, how: str, *docs: str) -> DataFrame:
    c = small(spark, *docs)
    return getattr(c, how)(c.nodes.where("node_idx = 1").select("doc_id", "node_idx")).select("doc_id", "value")


_V = "doc_id BIGINT, value VARCHAR"
given("outer_html", _V, [(1, "<div id='a'><span>v</span></div>"), (2, "<p>&amp; <b>x</b></p>"), (3, "<br a>"), (4, "<i x=1 y>t</i>")])(lambda spark: _tags_html(spark, "outer_html", "<div id='a'><span>v</span></div>", "<P>&amp; <b>x<!-- c -->", "<br a/>", "<i  x=1 @ y >t</i >"))
given("html_self", _V, [(1, "<div id='a'>"), (2, "t")])(lambda spark: _tags_html(spark, "html_self", "<div id='a'><span>v</span></div>", "t<b>"))
given("html_canonical", _V, [(1, '<img id="i" class="x" data-q="1>2">'), (2, '<a t="&amp;&lt;&quot;" b c>')])(lambda spark: _tags_html(spark, "canonical_self", "<img id='i' class='x' data-q='1>2'/>", "<a t='&amp;<\"' b c=>"))
given("serialise_fixpoint", "doc_id BIGINT, same BOOLEAN", [(1, True), (2, True)])(
    lambda spark: (lambda c: Corpus.parse(c.documents.select("doc_id", "doc_html"), "doc_id", "doc_html", False).documents.select("doc_id", F.col("doc_html").alias("again")).join(c.documents, "doc_id").select("doc_id", (F.col("again") == F.col("doc_html")).alias("same")))(small(spark, DOC, "<ul><li a=1>x<li>y<p>z<div>", drop_ws=False))
)

# --- selectors over pages ---

_S = "SELECT page_id AS doc_id, CAST(idx AS BIGINT) AS node_idx FROM att WHERE {}"
_NTH = "parent <> 0 AND {}"
PAGE_SELECTORS = {
    "sel_tag": ("p", "tag = 'p'"),
    "sel_universal": ("*", "true"),
    "sel_class": (".ad", "list_contains(string_split(class, ' '), 'ad')"),
    "sel_attr_exists": ("[href]", "href IS NOT NULL"),
    "sel_attr_eq": ("[lang=en]", "lang = 'en'"),
    "sel_attr_prefix": ('a[href^="/a"]', "tag = 'a' AND starts_with(href, '/a')"),
    "sel_attr_suffix": ("a[href$=n]", "tag = 'a' AND ends_with(href, 'n')"),
    "sel_attr_contains": ("a[href*=th]", "tag = 'a' AND contains(href, 'th')"),
    "sel_attr_includes": ("[class~=ad]", "list_contains(string_split(class, ' '), 'ad')"),
    "sel_attr_dash": ("[lang|=de]", "lang = 'de' OR starts_with(lang, 'de-')"),
    "sel_first_child": ("li:first-child", "tag = 'li' AND prev IS NULL"),
    "sel_last_child": ("li:last-child", "tag = 'li' AND nxt IS NULL"),
    "sel_nth_child": ("li:nth-child(2)", _NTH.format("tag = 'li' AND sib = 2")),
    "sel_nth_child_odd": ("li:nth-child(odd)", _NTH.format("tag = 'li' AND sib % 2 = 1")),
    "sel_nth_child_step": ("li:nth-child(3n+1)", _NTH.format("tag = 'li' AND sib % 3 = 1")),
    "sel_nth_child_first": ("li:nth-child(-n+2)", _NTH.format("tag = 'li' AND sib <= 2")),
    "sel_not_tag": ("*:not(p)", "tag <> 'p'"),
    "sel_not_class": ("body > *:not(.ad)", "NOT coalesce(list_contains(string_split(class, ' '), 'ad'), false) AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'body' AND x.idx = att.parent)"),
    "sel_not_attr": ("a:not([href^='/t'])", "tag = 'a' AND NOT coalesce(starts_with(href, '/t'), false)"),
    "sel_descendant": ("b p", "tag = 'p' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'b' AND x.idx < att.idx AND att.idx <= x.fin)"),
    "sel_child": ("b > p", "tag = 'p' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'b' AND x.idx = att.parent)"),
    "sel_adjacent": ("head + body", "tag = 'body' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'head' AND x.idx = att.prev)"),
    "sel_sibling": ("li ~ li", "tag = 'li' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'li' AND x.parent = att.parent AND x.idx < att.idx)"),
    "sel_group": ("title, b > p, title", "tag = 'title' OR (tag = 'p' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'b' AND x.idx = att.parent))"),
    "query_all": ("nav > ul > li > a", "tag = 'a' AND EXISTS (SELECT 1 FROM el l JOIN el u ON u.page_id = l.page_id AND u.idx = l.parent JOIN el n ON n.page_id = u.page_id AND n.idx = u.parent WHERE l.page_id = att.page_id AND l.idx = att.parent AND l.tag = 'li' AND u.tag = 'ul' AND n.tag = 'nav')"),
}
for _name, (_selector, _test) in PAGE_SELECTORS.items():
    pages(_name, _S.format(_test))(lambda c, s=_selector: longs(c.query_all(s)))
pages("query_one", "SELECT page_id AS doc_id, CAST(min(idx) AS BIGINT) AS node_idx FROM att WHERE tag = 'p' AND parent IN (SELECT idx FROM el x WHERE x.page_id = att.page_id AND x.tag = 'b') GROUP BY page_id")(lambda c: longs(c.query_one("b > p")))
pages("query_all_scoped", "SELECT s.page_id AS doc_id, CAST(s.idx AS BIGINT) AS scope_idx, CAST(e.idx AS BIGINT) AS node_idx FROM el s JOIN el e ON e.page_id = s.page_id AND e.idx > s.idx AND e.idx <= s.fin WHERE s.tag IN ('article', 'ul') AND e.tag IN ('p', 'a')")(lambda c: longs(c.query_all("body p, body a", c.scopes("article, ul"))))
pages("query_one_scoped", "SELECT s.page_id AS doc_id, CAST(s.idx AS BIGINT) AS scope_idx, CAST(min(e.idx) AS BIGINT) AS node_idx FROM el s JOIN el e ON e.page_id = s.page_id AND e.idx > s.idx AND e.idx <= s.fin WHERE s.tag = 'article' AND e.tag = 'p' GROUP BY ALL")(lambda c: longs(c.query_one("p", c.scopes("article"))))
pages("query_scoped_child", "SELECT s.page_id AS doc_id, CAST(s.idx AS BIGINT) AS scope_idx, CAST(e.idx AS BIGINT) AS node_idx FROM el s JOIN el e ON e.page_id = s.page_id AND e.parent = s.idx WHERE s.tag = 'b' AND e.tag = 'p'")(lambda c: longs(c.query_all("> p", c.scopes("b"))))
pages("selector_count", "SELECT p.page_id AS doc_id, count(e.idx) AS n FROM pages p LEFT JOIN el e ON e.page_id = p.page_id AND e.tag = 'br' GROUP BY p.page_id")(lambda c: c.count("br"))
pages("count_first_scope", "SELECT p.page_id AS doc_id, count(e.idx) AS n FROM pages p LEFT JOIN (SELECT page_id, min(idx) AS idx FROM el WHERE tag = 'b' GROUP BY page_id) f ON f.page_id = p.page_id LEFT JOIN el s ON s.page_id = f.page_id AND s.idx = f.idx LEFT JOIN el e ON e.page_id = s.page_id AND e.tag = 'p' AND e.idx > s.idx AND e.idx <= s.fin GROUP BY p.page_id")(lambda c: c.count_in_first("b", "p"))
QUERIES["extract_links"] = lambda spark, sf_dir: longs((lambda c: (lambda hits: c.attribute(hits, "href").withColumnRenamed("value", "href").join(c.inner_text(hits).withColumnRenamed("value", "text"), ["doc_id", "node_idx"]))(c.query_all("nav > ul > li > a")))(corpus(spark, sf_dir)))
SQL["extract_links"] = NODES + f"SELECT a.page_id AS doc_id, CAST(a.idx AS BIGINT) AS node_idx, a.href, {NORMAL.format('n.txt')} AS text FROM att a JOIN nodes n ON n.page_id = a.page_id AND n.idx = a.idx + 1 WHERE a.tag = 'a'"
QUERIES["skip_documents"] = lambda spark, sf_dir: longs(Corpus.parse(skip_documents(source.pages(spark, sf_dir), "body b > p:nth-child(2)"), "page_id").query_all("body b > p:nth-child(2)"))
SQL["skip_documents"] = NODES + _S.format("tag = 'p' AND sib = 2 AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'b' AND x.idx = att.parent)")

# --- selectors over small documents ---

CASES = "<main><ol id=l><li id=i1 class='x y' k=v w='a b' p=prefix lang=en-US><b id=b1></b></li><li id=i2 class='x' k=w w='b' p=present lang=en><b id=b2></b></li><li id=i3 class='x z' k=u p=other lang=fr></li></ol><div id=s><a id=a1 class=q></a><a id=a2 class='q h'></a><i id=m></i><a id=a3 class=q></a></div></main>"
MATRIX = {
    "li": "i1 i2 i3", "#i2": "i2", ".x": "i1 i2 i3", ".x.y": "i1", ".x.x": "", "li, .x": "i1 i2 i3", "[k]": "i1 i2 i3", "[k=v]": "i1", "[p^=pre]": "i1 i2", "[p$=x]": "i1", "[p*=the]": "i3",
    "[w~=b]": "i1 i2", "[w~='']": "", "[p^='']": "i1 i2 i3", "[lang|=en]": "i1 i2", "ol > li": "i1 i2 i3", "ol li > b": "b1 b2", "li + li": "i2 i3", "li ~ li": "i2 i3", "a.q + i": "m", "a.h ~ a": "a3",
    "li:first-child": "i1", "li:last-child": "i3", "li:nth-child(2)": "i2", "li:nth-child(2n+1)": "i1 i3", "li:nth-child(even)": "i2", "li:not(.z)": "i1 i2", "li:not([k=u])": "i1 i2", "li:not(#i1):not(.z)": "i2", "li#i1, li#i3": "i1 i3", ".none": "", "MAIN > DIV#s > A": "a1 a2 a3", "> ol": "", "+ ol": "",
}
given("sel_matrix", "selector VARCHAR, ids VARCHAR", list(MATRIX.items()))(lambda spark: (lambda c: union([ids(c, s) for s in MATRIX]))(small(spark, CASES)))
given("sel_id", "selector VARCHAR, ids VARCHAR", [("#d", "d d"), ("#d.y", "d"), ("#D", "")])(lambda spark: union([ids(small(spark, "<i id=d></i><b id=d class=y></b>"), s) for s in ("#d", "#d.y", "#D")]))
given("sel_multi_class", "selector VARCHAR, ids VARCHAR", [(".a.b.c.d.e", "x"), (".a.a", "y"), (".A", "")])(lambda spark: union([ids(small(spark, "<i id=x class='a\tb\nc\rd\fe'></i><i id=y class='a a'></i>"), s) for s in (".a.b.c.d.e", ".a.a", ".A")]))
given("sel_case", "selector VARCHAR, ids VARCHAR", [("div#x[data-k=v]", "x"), ("div > span#y", "y")])(lambda spark: union([ids(small(spark, "<DiV ID='x' ClAsS='A b' DaTa-K='v'><SpAn id='y'>"), s) for s in ("div#x[data-k=v]", "div > span#y")]))
_NTHS = {"#p :nth-child(odd)": 4, "#p :nth-child(3n+1)": 3, "#p :nth-child(+3n-2)": 3, "#p :nth-child(-n+6)": 6, "#p :nth-child(-n+5)": 5, ":nth-child(1)": 1, "div:first-child": 2}
given("sel_nth_forms", "selector VARCHAR, n BIGINT", list(_NTHS.items()))(lambda spark: counts(small(spark, "<div id=p>" + "<div></div>" * 4 + "<a></a>" + "<div></div>" * 2 + "</div>"), list(_NTHS)))
_IN_DOC = {"#hsoob .a": 2, "#hsoob div": 2, "p.odd": 1, ".d ~ .sib": 2, ".a .d + .sib": 1, "#hsoob > div > .h": 1, "#hsoob #spanny": 1, ".a #spanny": 1, ".a #booshTest #spanny": 1, "> #hsoob": 1}
_IN_FRAG = {".a span": 1, "> div p em": 2, "#emem": 1, ".d.i #emem": 1, ".d #oooo #emem": 1, "> div #oooo": 1}
given("sel_context_doc", "selector VARCHAR, n BIGINT", list(_IN_DOC.items()))(lambda spark: counts(small(spark, DOC), list(_IN_DOC), "root"))
given("sel_context_frag", "selector VARCHAR, n BIGINT", list(_IN_FRAG.items()))(lambda spark: counts(small(spark, FRAG), list(_IN_FRAG), "root"))
given("sel_leading_child", "selector VARCHAR, n BIGINT", [("> root", 1), ("> div", 0), ("+ div", 0), ("~ div", 0), ("> root > div", 2)])(lambda spark: counts(small(spark, DOC), ["> root", "> div", "+ div", "~ div", "> root > div"]))
given("selector_count_scope_tag", "doc_id BIGINT, n BIGINT", [(1, 2), (2, 0)])(lambda spark: small(spark, DOC, "<p><em></em></p>").count_in_first("root", "div .sib:not(div)"))
given("selector_ids", "doc_id BIGINT, json VARCHAR", [(1, '["hsoob","booshTest","lonelyHsoob"]'), (2, "[]")])(lambda spark: small(spark, DOC, FRAG).ids_json("div"))
INVALID = ["", ",", "div >", "div +", "div ~", "div,", "#a#b", "div:not()", "div:not(.a,.b)", "div:nth-child()", "div:nth-child(2n+)", "div:unknown", "[attr", "div[attr^]", "div[", "#1", "a[b= ]", "li:nth-child(2n + 1)", "a::before", "a:not(*)"]


def _rejected(s: str, read=parse) -> bool:
    try:
        read(s)
    except InvalidSelector as e:
        return e.report["runtime_parse_error"]
    return False


given("sel_invalid", "selector VARCHAR, rejected BOOLEAN", [(s, True) for s in INVALID] + [("*|a", True), ("a:NOT(b)", False)])(lambda spark: spark.createDataFrame([(s, _rejected(s)) for s in [*INVALID, "*|a", "a:NOT(b)"]], "selector string, rejected boolean"))
given("debug_parse_error", "selector VARCHAR, rejected BOOLEAN", [("div[", True)])(lambda spark: spark.createDataFrame([("div[", _rejected("div[", compiled))], "selector string, rejected boolean"))
given("sel_cached_equiv", "selector VARCHAR, same BOOLEAN", [(s, True) for s in MATRIX])(lambda spark: spark.createDataFrame([(s, parse(s) == compiled(s) and compiled(s) is compiled(s)) for s in MATRIX], "selector string, same boolean"))

# --- diagnostics ---


def _debug(c: Corpus) -> DataFrame:
    return c.explain("b > p, footer").select("doc_id", "visited_elements", "matched_index", "matched_group", *[F.array_join(F.transform(f"group_{a}_counts", lambda x: x.cast("string")), " ").alias(b) for a, b in (("eval", "evals"), ("match", "matches"))])


pages("debug_report", """, hit AS (SELECT page_id, idx, CASE WHEN tag = 'p' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = att.page_id AND x.tag = 'b' AND x.idx = att.parent) THEN 0 WHEN tag = 'footer' THEN 1 END AS g FROM att),
one AS (SELECT page_id, min(idx) AS idx, arg_min(g, idx) AS g FROM hit WHERE g IS NOT NULL GROUP BY page_id),
vis AS (SELECT e.page_id, count(*) AS n, any_value(o.idx) AS idx, any_value(o.g) AS g FROM el e LEFT JOIN one o ON o.page_id = e.page_id WHERE o.idx IS NULL OR e.idx <= o.idx GROUP BY e.page_id)
SELECT page_id AS doc_id, n AS visited_elements, CAST(idx AS BIGINT) AS matched_index, CAST(g AS BIGINT) AS matched_group, n || ' ' || (n - CASE WHEN g = 0 THEN 1 ELSE 0 END) AS evals, CASE g WHEN 0 THEN '1 0' WHEN 1 THEN '0 1' ELSE '0 0' END AS matches FROM vis""")(_debug)
_SCOPED = """, sc AS (SELECT s.page_id, s.idx AS scope_idx, e.idx, e.tag, min(CASE WHEN e.tag = 'br' THEN e.idx END) OVER (PARTITION BY s.page_id, s.idx) AS hit
  FROM el s LEFT JOIN el e ON e.page_id = s.page_id AND e.idx > s.idx AND e.idx <= s.fin WHERE s.tag IN ('article', 'nav'))
"""
pages("debug_scoped_report", _SCOPED + "SELECT page_id AS doc_id, CAST(scope_idx AS BIGINT) AS scope_idx, count(idx) FILTER (WHERE hit IS NULL OR idx <= hit) AS visited_elements, CAST(any_value(hit) AS BIGINT) AS matched_index, CAST(CASE WHEN any_value(hit) IS NOT NULL THEN 0 END AS BIGINT) AS matched_group FROM sc GROUP BY page_id, scope_idx")(
    lambda c: longs(c.explain("br", c.scopes("article, nav")).select("doc_id", "scope_idx", "visited_elements", "matched_index", "matched_group"))
)
pages("debug_scoped_near_miss", _SCOPED + "SELECT page_id AS doc_id, CAST(scope_idx AS BIGINT) AS scope_idx, rank, CAST(idx AS BIGINT) AS node_idx, 'tag' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY page_id, scope_idx ORDER BY idx) AS rank FROM sc WHERE idx IS NOT NULL AND (hit IS NULL OR idx < hit)) WHERE rank <= 8")(
    lambda c: longs(c.near_misses("br", c.scopes("article, nav")).select("doc_id", "scope_idx", "rank", "node_idx", "kind"))
)
pages("debug_near_miss", "SELECT page_id AS doc_id, rank, CAST(idx AS BIGINT) AS node_idx, CASE WHEN tag <> 'a' THEN 'tag' ELSE 'attr' END AS kind, CAST(0 AS BIGINT) AS group_index, CAST(0 AS BIGINT) AS compound_index, CAST(CASE WHEN tag <> 'a' THEN 0 ELSE 1 END AS BIGINT) AS predicate_index FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY idx) AS rank FROM att) WHERE rank <= 8")(lambda c: c.near_misses('a[href^="https"]'))
pages("query_stats", "SELECT p.page_id AS doc_id, CAST(5 AS BIGINT) AS selector_len, 'one_runtime' AS kind, EXISTS (SELECT 1 FROM el e JOIN el x ON x.page_id = e.page_id AND x.idx = e.parent WHERE e.page_id = p.page_id AND e.tag = 'p' AND x.tag = 'b') AS matched FROM pages p")(lambda c: c.query_stats("b > p"))
_KINDS = [("i", "tag", 0), ("a#z", "id", 1), ("a.k.m", "class", 2), ("a[href^=https]", "attr", 1), ("a:last-child", "pseudo", 1), ("a:not(.k)", "not_simple", 1), ("> a", "scope", None), ("b a", "combinator", None)]
given("debug_failure_kind", "selector VARCHAR, node_idx BIGINT, kind VARCHAR, compound_index BIGINT, predicate_index BIGINT", [(s, 2, k, 1 if k == "combinator" else 0, p) for s, k, p in _KINDS])(
    lambda spark: (lambda c: union([c.near_misses(s).where("node_idx = 2").select(F.lit(s).alias("selector"), "node_idx", "kind", "compound_index", "predicate_index") for s, *_ in _KINDS]))(small(spark, "<div><a id=x class='k l'></a><a id=y></a></div>"))
)
_HOOKED = "SELECT p.page_id AS doc_id, CAST(5 AS BIGINT) AS selector_len, k.kind, CASE WHEN k.kind LIKE 'one%' THEN EXISTS (SELECT 1 FROM el e JOIN el x ON x.page_id = e.page_id AND x.idx = e.parent WHERE e.page_id = p.page_id AND e.tag = 'p' AND x.tag = 'b') END AS matched FROM pages p, (VALUES ('one_runtime'), ('one_cached'), ('all_runtime'), ('all_cached')) AS k(kind)"
pages("query_stats_kinds", _HOOKED)(lambda c: union([c.query_stats("b > p", kind) for kind in KINDS]))

# --- at rest ---


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that spark.checkpoint.dir names; /tmp where that is unset."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or '/tmp/checkpoints'}/sylvan/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "nodes")
    corpus(spark, sf_dir).write(path)
    return longs(Corpus.read(spark, path).query_all("p, li:first-child"))


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a file of its own, read back as files and parsed."""
    path = _folder(spark, "files")
    source.pages(spark, sf_dir).select(F.col("html").alias("value"), F.col("page_id").alias("page")).write.partitionBy("page").text(path)
    docs = source.files(spark, path)
    ids = docs.select("doc_id", F.regexp_extract("path", r"page=(\d+)", 1).cast("long").alias("page_id"))
    return longs(Corpus.parse(docs).query_all("article p").join(ids, "doc_id").groupBy("page_id").agg(F.count("*").alias("n")))


QUERIES["stored_nodes"] = _stored
SQL["stored_nodes"] = NODES + _S.format("tag = 'p' OR (tag = 'li' AND prev IS NULL)")
QUERIES["file_source"] = _filed
SQL["file_source"] = NODES + "SELECT e.page_id, count(*) AS n FROM el e WHERE e.tag = 'p' AND EXISTS (SELECT 1 FROM el x WHERE x.page_id = e.page_id AND x.tag = 'article' AND x.idx < e.idx AND e.idx <= x.fin) GROUP BY e.page_id"

# --- conformance cases over documents of our own that their counts describe ---

#: Selectors of the conformance cases with the counts that they ask for.
_WHOLE = {
    ".a": 3, "#boosh,#boosh": 1, "#boosh,.apples,#boosh": 1, "#boosh #booshTest": 1, ".a.b #booshTest": 1, "#boosh>.a>#booshTest": 1, ".a>#booshTest": 1, "#boosh .a": 2, "#boosh div": 2,
    "a.odd": 1, "#boosh div,#boosh span": 3, ".class-with-dashes": 1, "#boosh *": 4, "div#fixtures > div a": 5, "div#fixtures div ~ a div": 0,
    ".parent .oldest ~ .sibling": 4, ".parent .middle ~ .sibling": 2, ".parent .middle ~ h4": 1, ".parent .middle ~ h4.younger": 1, ".parent .middle ~ h3": 0, ".parent .middle ~ h2": 0,
    ".parent .youngest ~ .sibling": 0, ".parent .oldest + .sibling": 1, ".parent .middle + .sibling": 1, ".parent .middle + h4": 1, ".parent .middle + h3": 0, ".parent .middle + h2": 0,
    ".parent .youngest + .sibling": 0, ".odd:not(div)": 1, "#pseudos div:first-child": 1, "#pseudos div:last-child": 1, "#pseudos :nth-child(odd)": 4, "#pseudos div:nth-child(odd)": 3,
    "#pseudos div:nth-child(even)": 3, "#pseudos :nth-child(3n+1)": 3, "#pseudos :nth-child(+3n-2)": 3, "#pseudos :nth-child(-n+6)": 6, "#pseudos :nth-child(-n+5)": 5,
}
_NOWHERE = [
    "nonexistent", ".second", "p#strong", "#link_2.internal.nonexistent", "li#item_1.nonexistent", "li#item_1.first.nonexistent", "#level1>div:first-child", "#level1:first-child", "#level1>span:last-child",
    "div.brothers:not(.brothers)", "#level2_2 + span", "#level3_2 + *", "#level3_1 + em", "div > #nonexistent", "#level2_2 ~ span", "#level3_2 ~ *", "#level3_1 ~ em", "div ~ #level3_2", "div ~ #level2_3",
]
#: Nearly the same selectors, which the document answers.
_SOMEWHERE = {"strong#strong": 1, "#link_2.internal": 1, "li#item_1.first": 1, "#level1>span:first-child": 1, "#level1>div:last-child": 1, "div.brothers:not(.sisters)": 1, "#level2_2 + div": 1, "#level3_1 + strong": 1, "#level2_1 ~ span": 1, "span ~ #level2_3": 1}
_HOUSE = "<div id=boosh><div class='a b'><div id=booshTest></div></div><em></em><span class='h a'></span></div><p class='a class-with-dashes'></p><div id=fixtures><div><a></a><a class=odd></a><a></a></div><div class=odd><p><a></a></p><a></a></div></div><div class=parent><h1 class='oldest sibling'></h1><h2 class='older sibling'></h2><h3 class='middle sibling'></h3><h4 class='younger sibling'></h4><h5 class='youngest sibling'></h5></div><div id=pseudos><div></div><div></div><i></i><div></div><div></div><div></div><div></div></div>"
_LEVELS = "<body><p id=first><strong id=strong></strong></p><a id=link_2 class=internal></a><ul><li id=item_1 class=first></li></ul><div class=brothers></div><div id=level1><span id=level2_1><span id=level3_1></span><strong></strong></span><span id=level2_2><em id=level3_2></em></span><div id=level2_3></div></div></body>"
given("sel_conformance_document", "selector VARCHAR, n BIGINT", list(_WHOLE.items()))(lambda spark: counts(small(spark, _HOUSE), list(_WHOLE)))
given("sel_conformance_none", "selector VARCHAR, n BIGINT", [(s, 0) for s in _NOWHERE] + list(_SOMEWHERE.items()))(lambda spark: counts(small(spark, _LEVELS), [*_NOWHERE, *_SOMEWHERE]))
