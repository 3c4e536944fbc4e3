"""The parser by itself: single rules and properties that hold for any input."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.dom import frame, parser
from sylvan.dom.entities import decode

PIECES = ["<div>", "</div>", "<p>", "</p>", "<li a=1>", "<b class='x y' id=q>", "</b>", "<br/>", "text", " ", "\n", "<!-- c -->", "<!", "<?x?>", "<script>", "</script>", "<svg>", "</svg>", "<", ">", "&amp;", "&#65;", "é", "<td>", "<tr>", "'", '"', "<i x='>'", "<plaintext>", "<title>", "</title >"]


def html():
    return st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


@given(html(), st.booleans())
@settings(max_examples=300, deadline=None)
def test_links_and_intervals_hold_for_any_input(text, drop):
    nodes = parser.parse(text.encode(), drop)
    assert nodes[0].subtree_end == len(nodes) - 1
    for i, n in enumerate(nodes[1:], 1):
        p = nodes[n.parent]
        assert n.parent < i <= n.subtree_end <= p.subtree_end
        assert n.depth == p.depth + 1
        if n.prev_sibling >= 0:
            assert nodes[n.prev_sibling].parent == n.parent and nodes[n.prev_sibling].subtree_end < i
        if n.kind == parser.ELEMENT:
            kids = [k for k, x in enumerate(nodes) if x.parent == i and x.kind == parser.ELEMENT]
            assert n.last_child == (kids[-1] if kids else -1)
            assert [nodes[k].sib_pos for k in kids] == list(range(1, len(kids) + 1))


@given(html())
@settings(max_examples=200, deadline=None)
def test_offsets_cut_out_each_subtree(text):
    rows = frame.rows_of(1, text.encode(), False)
    col = {f.name: i for i, f in enumerate(frame.ARROW)}
    whole_text, whole_html = rows[0][col["doc_text"]], rows[0][col["doc_html"]]
    for r in rows:
        inside = [x for x in rows if r[1] <= x[1] <= r[col["subtree_end"]]]
        assert whole_text[r[col["text_start"]] : r[col["text_end"]]] == "".join(x[col["text"]] or "" for x in inside)
        if r[col["kind"]] == "element":
            piece = whole_html[r[col["html_start"]] : r[col["html_end"]]]
            assert piece.startswith("<" + r[col["tag_raw"]])
            assert r[col["tag"]].encode() in parser.VOID or piece.endswith(f"</{r[col['tag_raw']]}>")


@given(st.binary(max_size=300))
@settings(max_examples=300, deadline=None)
def test_never_fails(data):
    parser.parse(data)
    frame.rows_of(1, data)
    for n in parser.parse(data):
        parser.attributes(n.attrs)


def test_long_and_deep_inputs():
    assert len(parser.parse(b"<div>" * 50_000)) == 50_001
    assert len(parser.attributes(b" a='" + b"&amp;" * 100_000 + b"' b")) == 2
    assert parser.parse(b"<i x='" + b"y" * 1_000_000)[1].kind == parser.ELEMENT


@pytest.mark.parametrize(
    ("raw", "plain"),
    [("a&amp;b&#x20;", "a&b "), ("&amp;lt;", "&lt;"), ("&nbsp;&copy;", "&nbsp;&copy;"), ("&#xD800;", "&#xD800;"), ("&#1114112;", "&#1114112;"), ("&#0;", "\0"), ("&#;&#x;&amp", "&#;&#x;&amp"), ("&#00000000000000065;", "A"), ("&AMP;", "&AMP;")],
)
def test_references(raw, plain):
    assert decode(raw.encode()).decode() == plain


def test_random_soup_is_stable():
    r = random.Random(3)
    soup = "".join(r.choice(PIECES) for _ in range(3000)).encode()
    assert parser.parse(soup) == parser.parse(soup)
