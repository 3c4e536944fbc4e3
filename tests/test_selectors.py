"""Selector plans against a plain matcher that follows each rule node by node."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.dom import frame
from sylvan.operators.corpus import Corpus, required_tags
from sylvan.selector.parser import InvalidSelector, compiled, nth, parse

COL = {f.name: i for i, f in enumerate(frame.ARROW)}
SELECTORS = ["a", "*", ".x", "#i", "[k]", "a b", "a > b", "a + b", "a ~ b", "a b > c", "a ~ b c", "c + c > a", ".x .y", "a:not(.x) b", "b:nth-child(2n+1)", "a:first-child ~ c", "a, b > c, a", "> a", "> a b", "c:last-child", "a a a", "[k=v] ~ [k]", "p b"]


def soup(r: random.Random) -> str:
    out = []
    for _ in range(r.randint(0, 40)):
        tag = r.choice("abcp")
        extra = r.choice(["", "", " class=x", " class='x y'", " id=i", " k=v", " k"])
        out.append(r.choice([f"<{tag}{extra}>", f"<{tag}{extra}>", f"</{tag}>", "t"]))
    return "".join(out)


class Plain:
    """Right to left over one document's rows."""

    def __init__(self, rows):
        self.rows = {r[1]: dict(zip(COL, r, strict=True)) for r in rows}

    def compound(self, c, i):
        n = self.rows[i]
        if n["kind"] != "element" or (c.tag and n["tag"] != c.tag) or (c.id and n["id"] != c.id):
            return False
        attrs, classes = dict(n["attr_map"]), n["classes"] or []
        for a in c.attrs:
            if a.name not in attrs or (a.op == "eq" and attrs[a.name] != a.value):
                return False
        for p in c.pseudos:
            sibs = [k for k, x in self.rows.items() if x["parent"] == n["parent"] and x["kind"] == "element"]
            at = sibs.index(i) + 1
            if p.kind == "first-child" and at != 1 or p.kind == "last-child" and at != len(sibs):
                return False
            if p.kind == "nth-child" and (n["parent"] == 0 or not any(p.a * k + p.b == at for k in range(100))):
                return False
        return all(classes.count(x) >= c.classes.count(x) for x in c.classes) and not any(k == "class" and v in classes for k, v in c.nots)

    def chain(self, group, k, i, scope):
        c = group[k]
        if not self.compound(c, i):
            return False
        n = self.rows[i]
        if k == 0:
            return c.combinator is None or c.combinator == "child" and n["parent"] == scope
        if c.combinator == "child":
            return self.chain(group, k - 1, n["parent"], scope)
        if c.combinator == "adjacent":
            return n["prev_sibling"] is not None and self.chain(group, k - 1, n["prev_sibling"], scope)
        if c.combinator == "sibling":
            return any(x["parent"] == n["parent"] and j < i and self.chain(group, k - 1, j, scope) for j, x in self.rows.items())
        return any(j < i <= x["subtree_end"] and self.chain(group, k - 1, j, scope) for j, x in self.rows.items())

    def match(self, selector, scope=0):
        end = self.rows[scope]["subtree_end"]
        return [i for i in self.rows if scope < i <= end and any(self.chain(g, len(g) - 1, i, scope) for g in compiled(selector).groups)]


@pytest.fixture(scope="module")
def docs():
    r = random.Random(11)
    return {k: soup(r) for k in range(60)}


@pytest.fixture(scope="module")
def corpus(spark, docs):
    c = Corpus.parse(spark.createDataFrame(list(docs.items()), "doc_id long, html string")).keep()
    yield c
    c.clear()


@pytest.fixture(scope="module")
def plain(docs):
    return {k: Plain(frame.rows_of(k, h.encode())) for k, h in docs.items()}


@pytest.mark.parametrize("selector", SELECTORS)
def test_plan_finds_what_the_rules_say(corpus, plain, selector):
    found = sorted((r.doc_id, r.node_idx) for r in corpus.query_all(selector).collect())
    assert found == sorted((k, i) for k, p in plain.items() for i in p.match(selector))


@pytest.mark.parametrize("selector", ["a b", "> b", "> a b", "> a + b", "b ~ c", "> b ~ c", "+ a", "b, > c"])
def test_scoped_plans(corpus, plain, selector):
    found = sorted((r.doc_id, r.scope_idx, r.node_idx) for r in corpus.query_all(selector, corpus.scopes("a")).collect())
    assert found == sorted((k, s, i) for k, p in plain.items() for s in p.match("a") for i in p.match(selector, s))


def test_reports_agree_with_matches(corpus, plain):
    seen = {r.doc_id: r for r in corpus.explain("a > b, c").collect()}
    for k, p in plain.items():
        hits = p.match("a > b, c")
        elements = [i for i, n in p.rows.items() if n["kind"] == "element"]
        assert seen[k].matched_index == (hits[0] if hits else None)
        assert seen[k].visited_elements == len([i for i in elements if not hits or i <= hits[0]])


def test_streams_parse_like_tables(spark, tmp_path, docs):
    from sylvan.streaming.pages import select_stream

    table = spark.createDataFrame(list(docs.items()), "page_id long, html string")
    table.write.parquet(str(tmp_path / "in"))
    stream = select_stream(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "a.x, b")
    q = stream.select("doc_id", "node_idx").writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, Corpus.parse(table, "page_id").query_all("a.x, b").select("doc_id", "node_idx").collect()))


def test_no_shuffle_in_combinators_over_kept_nodes(spark, corpus):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for selector in ("a > b c ~ a", "a + b", "a b"):
            plan = corpus.query_all(selector)._jdf.queryExecution().executedPlan().toString()
            # the only exchanges are those by which the nodes were kept
            assert plan.count("Exchange") == plan.count("REPARTITION_BY_COL") > 0
            assert "InMemoryTableScan" in plan and "ENSURE_REQUIREMENTS" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_stored_nodes_are_pruned_by_tag_and_id(spark, corpus, tmp_path):
    corpus.write(str(tmp_path / "nodes"))
    stored = Corpus.read(spark, str(tmp_path / "nodes"))
    for selector in ("a > b", "#x", "b"):
        assert sorted(map(tuple, stored.query_all(selector).collect())) == sorted(map(tuple, corpus.query_all(selector).collect()))
    assert "EqualTo(tag,b)" in stored.query_all("b")._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(id,x)" in stored.query_all("#x")._jdf.queryExecution().executedPlan().toString()


def test_only_wanted_columns_are_built(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, html string")
    whole = Corpus.parse(df).nodes
    for columns in (frame.STRUCTURE, ("doc_id", "node_idx", "text"), ("doc_id", "html_end", "doc_html"), ("doc_id", "attrs", "id"), ("doc_id", "node_count")):
        part = Corpus.parse(df, columns=columns).nodes
        assert part.columns == [c for c in whole.columns if c in columns]
        assert sorted(map(str, part.collect())) == sorted(map(str, whole.select(part.columns).collect()))


def test_hooks(spark, corpus, docs):
    told = []
    n = corpus.with_hooks("a > b", "all_cached", told.append, told.append)
    assert n == corpus.query_all("a > b").count() and told[0] == {"selector_len": 5, "kind": "all_cached"} and told[1]["matched"] is None and told[1]["elapsed_ns"] > 0
    assert corpus.with_hooks("nothing", on_end=told.append) == 0 and told[-1]["matched"] is False
    with pytest.raises(ValueError, match="kind"):
        corpus.with_hooks("a", "some")
    Corpus.parse_with_hooks(spark.createDataFrame([(1, "<p>é")], "doc_id long, html string"), on_start=told.append, on_end=told.append).clear()
    assert told[-2] == {"input_len": 5} and told[-1]["node_count"] == 3
    rows, seen = corpus.observed("a > b")
    assert rows.count() == n and seen.get["matches"] == n


@pytest.mark.parametrize("text", ["", ",", "div >", "#a#b", "a:not()", "[x", "a[b^]", "li:nth-child(2n + 1)", "a b,", "a::b"])
def test_invalid(text):
    with pytest.raises(InvalidSelector):
        parse(text)


@given(st.text(alphabet="ab.#[]=:()>+~, *n1'\"", max_size=20))
@settings(max_examples=500, deadline=None)
def test_parse_or_reject(text):
    try:
        assert parse(text).groups
    except InvalidSelector:
        pass


def test_nth_and_required_tags():
    assert [nth(x) for x in ("odd", "even", "3", "n", "-n+2", "+3n-2", "2n +1", "2n+ 1", "")] == [(2, 1), (2, 0), (0, 3), (1, 0), (-1, 2), (3, -2), (2, 1), None, None]
    assert required_tags("a b, a c") == {"a"}
