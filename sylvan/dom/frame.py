"""Documents to node tables: one Arrow-vectorised pass, after which everything is native Spark."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.dom import parser
from sylvan.dom.entities import decode
from sylvan.session import importable

#: Rows of an Arrow batch: a page makes a hundred nodes and more.
BATCH_ROWS = 256

KINDS = ("document", "element", "text")
_ATTRS = pa.list_(pa.struct([(c, pa.string()) for c in ("name", "name_lc", "raw", "value")]))
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("node_idx", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("tag_raw", pa.string()),
        ("parent", pa.int32()), ("prev_sibling", pa.int32()), ("last_child", pa.int32()), ("subtree_end", pa.int32()), ("depth", pa.int32()),
        ("sib_pos", pa.int32()), ("is_last", pa.bool_()), ("id", pa.string()), ("classes", pa.list_(pa.string())),
        ("attrs", _ATTRS), ("attr_map", pa.map_(pa.string(), pa.string())), ("raw_text", pa.string()), ("text", pa.string()),
        ("text_start", pa.int32()), ("text_end", pa.int32()), ("html_start", pa.int32()), ("html_open_end", pa.int32()), ("html_end", pa.int32()),
        ("canonical_open", pa.string()), ("doc_text", pa.string()), ("doc_html", pa.string()), ("input_len", pa.int64()), ("node_count", pa.int64()),
    ]
)
_TYPES = {"int64": "long", "int32": "int", "string": "string", "bool": "boolean"}
_SQL_TYPES = {f.name: "array<struct<name:string,name_lc:string,raw:string,value:string>>" if f.name == "attrs" else "map<string,string>" if f.name == "attr_map" else "array<string>" if f.name == "classes" else _TYPES[str(f.type)] for f in ARROW}
SCHEMA = ", ".join(f"{k} {v}" for k, v in _SQL_TYPES.items())
#: The columns of the tree alone: what a parser's node records hold, attributes and texts left where they are.
STRUCTURE = ("doc_id", "node_idx", "kind", "tag", "parent", "prev_sibling", "last_child", "subtree_end", "depth", "sib_pos", "is_last")

_ESCAPES = ((b"&", b"&amp;"), (b"<", b"&lt;"), (b'"', b"&quot;"))
_HTML = {"html_start", "html_open_end", "html_end", "doc_html"}
_ATTRIBUTES = {"id", "classes", "attrs", "attr_map", "canonical_open"}


def _s(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class _Names(dict):
    """For a tag's raw name: the name, the name in lower case, and its start and end tag without attributes."""

    def __missing__(self, raw: bytes) -> tuple[str, str, str, str]:
        name = _s(raw)
        out = name, _s(raw.lower()), f"<{name}>", "" if raw.lower() in parser.VOID else f"</{name}>"
        if len(self) < 10_000:
            self[raw] = out
        return out


def _escape(value: bytes) -> bytes:
    for c, e in _ESCAPES:
        value = value.replace(c, e)
    return value


def _tokens(value: str) -> list[str]:
    for c in "\n\r\t\f":
        value = value.replace(c, " ")
    return [x for x in value.split(" ") if x]


def _masked(values: np.ndarray, null: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind, mask=null)


def _offsets(counts: list[int | None]) -> pa.Array:
    """Offsets of lists by their lengths; None makes a null list."""
    ends = np.cumsum([0] + [c or 0 for c in counts])
    return pa.array(ends.astype(np.int32), mask=np.array([c is None for c in counts] + [False]))


class _Attributes:
    """Columns of attributes for the nodes of a batch, filled node by node."""

    def __init__(self, wanted: set[str]):
        self.wanted = wanted
        self.id, self.classes, self.canonical, self.n_attrs, self.n_map, self.keys, self.values = [], [], [], [], [], [], []
        self.flat = [[], [], [], []]

    def none(self, element: str | None) -> None:
        """A node without attributes; `element` is its start tag, if it is one."""
        self.id.append(None)
        self.classes.append(None)
        self.canonical.append(element)
        for n in (self.n_attrs, self.n_map):
            n.append(None if element is None else 0)

    def some(self, name: str, found: list[parser.Attr]) -> None:
        values: dict[str, str] = {}
        names = [(_s(a.name), _s(a.name.lower()), _s(a.value)) for a in found]
        for _, low, value in names:
            values.setdefault(low, value)
        self.id.append(values.get("id"))
        self.classes.append(_tokens(values["class"]) if "class" in values else None)
        self.n_map.append(len(values))
        self.keys += values.keys()
        self.values += values.values()
        if "attrs" in self.wanted:
            self.n_attrs.append(len(found))
            for column, x in zip(self.flat, (*zip(*names, strict=True),), strict=False):
                column += x
            self.flat[3] += [_s(a.raw) for a in found]
        if "canonical_open" in self.wanted:
            escaped = b"".join(b" " + a.name if a.bare else b" " + a.name + b'="' + _escape(a.value) + b'"' for a in found)
            self.canonical.append(f"<{name}{_s(escaped)}>")

    def columns(self) -> dict[str, pa.Array]:
        text = lambda x: pa.array(x, pa.string())
        out = {"id": text(self.id), "classes": pa.array(self.classes, pa.list_(pa.string())), "attr_map": pa.MapArray.from_arrays(_offsets(self.n_map), text(self.keys), text(self.values))}
        if "attrs" in self.wanted:
            name, low, value, raw = map(text, self.flat)
            out["attrs"] = pa.ListArray.from_arrays(_offsets(self.n_attrs), pa.StructArray.from_arrays([name, low, raw, value], fields=list(_ATTRS.value_type)))
        if "canonical_open" in self.wanted:
            out["canonical_open"] = text(self.canonical)
        return out


_NAMES = _Names()
_LINKS = attrgetter("kind", "parent", "prev_sibling", "last_child", "subtree_end", "depth", "sib_pos")


def batch_of(ids: Sequence[int | None], pages: Sequence[bytes], drop_ws: bool = True, wanted: Sequence[str] = tuple(ARROW.names)) -> pa.RecordBatch:
    """A row of ARROW, or of the columns `wanted`, for each node of some documents. Offsets count characters in doc_text and
    doc_html, which are the decoded texts and the serialised nodes put together in order, so that any subtree's text or HTML is
    one substring. They are running sums over the nodes: what is wanted alone is built."""
    want = set(wanted)
    parsed = [parser.parse(p, drop_ws) for p in pages]
    nodes = list(chain.from_iterable(parsed))
    sizes = np.array([len(x) for x in parsed], np.int64)
    base = np.cumsum(sizes) - sizes
    start = np.repeat(base, sizes)  # of each node its document's first
    place = np.arange(len(nodes))
    numbers = np.fromiter(chain.from_iterable(map(_LINKS, nodes)), np.int64, 7 * len(nodes)).reshape(-1, 7)
    kinds, parent, before, last, end, depth, sib = np.ascontiguousarray(numbers.T)
    element = kinds == parser.ELEMENT
    out: dict[str, pa.Array] = {
        "doc_id": pa.array(np.repeat(np.array([i if i is not None else 0 for i in ids], np.int64), sizes), mask=np.repeat(np.array([i is None for i in ids], bool), sizes)),
        "node_idx": pa.array(place - start, pa.int32()),
        "kind": pa.array(KINDS).take(pa.array(kinds)),
        "parent": _masked(parent, parent < 0, pa.int32()),
        "prev_sibling": _masked(before, before < 0, pa.int32()),
        "last_child": _masked(last, last < 0, pa.int32()),
        "subtree_end": pa.array(end, pa.int32()),
        "depth": pa.array(depth, pa.int32()),
        "sib_pos": _masked(sib, ~element, pa.int32()),
        "is_last": _masked(last[np.maximum(start + parent, 0)] == place - start, ~element, pa.bool_()),
    }
    if "tag" in want:
        out["tag"] = pa.array([_NAMES[n.name][1] if n.kind == parser.ELEMENT else None for n in nodes], pa.string())
    if want & {"input_len", "node_count"}:
        first = place == start
        of_doc = lambda x: _masked(np.repeat(x, sizes), ~first, pa.int64())
        out["input_len"], out["node_count"] = of_doc(np.array([len(p) for p in pages], np.int64)), of_doc(sizes)
    if want - set(out):
        out |= _contents(parsed, nodes, want, base, start, place, end)
    return pa.RecordBatch.from_arrays([out[c] for c in wanted], schema=pa.schema([ARROW.field(c) for c in wanted]))


def rows_of(doc_id: int | None, html: bytes, drop_ws: bool = True) -> list[tuple]:
    """The rows of one document, in the order of ARROW."""
    return list(zip(*(c.to_pylist() for c in batch_of([doc_id], [html], drop_ws).columns), strict=True))


def _contents(parsed, nodes, want: set[str], base: np.ndarray, start: np.ndarray, place: np.ndarray, end: np.ndarray) -> dict[str, pa.Array]:
    """Columns of names, attributes, texts and serialised HTML."""
    html, attributes = bool(want & _HTML), _Attributes(want) if want & _ATTRIBUTES else None
    raw: list[str | None] = []  # names and raw texts
    plain: list[str | None] = []  # decoded texts
    opens: list[str] = []
    closes: list[str] = []
    for n in nodes:
        if n.kind == parser.TEXT:
            r = _s(n.name)
            raw.append(r)
            plain.append(_s(decode(n.name)) if b"&" in n.name else r)
            opens.append(r)
            closes.append("")
        elif n.kind == parser.ELEMENT:
            name, _, opening, closing = _NAMES[n.name]
            raw.append(name)
            plain.append(None)
            closes.append(closing)
            if n.attrs and (html or attributes) and (found := parser.attributes(n.attrs)):
                if html:
                    opening = f"<{name} {' '.join([_s(a.raw) for a in found])}>"
                if attributes:
                    attributes.some(name, found)
                opens.append(opening)
                continue
            opens.append(opening)
            if attributes:
                attributes.none(opening)
            continue
        else:
            raw.append("")
            plain.append(None)
            opens.append("")
            closes.append("")
        if attributes:
            attributes.none(None)
    text = np.array([p is not None for p in plain], bool)
    out = attributes.columns() if attributes else {}
    out["tag_raw"] = pa.array(raw, pa.string())
    if "raw_text" in want:
        out["raw_text"] = pa.array(raw, pa.string(), mask=~text)
    out["text"] = pa.array(plain, pa.string())
    upto = np.r_[0, np.cumsum([len(p) if p else 0 for p in plain])]
    out["text_start"], out["text_end"] = (pa.array(upto[x] - upto[start], pa.int32()) for x in (place, start + end + 1))
    first = place == start
    sizes = np.array([len(x) for x in parsed], np.int64)
    if "doc_text" in want:
        whole = np.full(len(nodes), None, object)
        whole[first] = ["".join([p for p in plain[a : a + n] if p]) for a, n in zip(base.tolist(), sizes.tolist(), strict=True)]
        out["doc_text"] = pa.array(whole, pa.string())
    if html:
        last = start + end
        open_len, close_len = np.array([len(x) for x in opens], np.int64), np.array([len(x) for x in closes], np.int64)
        opened = np.r_[0, np.cumsum(open_len)]
        closed = np.r_[0, np.cumsum(np.bincount(last, close_len, len(nodes)).astype(np.int64))]  # by the nodes before a place
        at = opened[:-1] + closed[:-1]
        begin = at - at[start]
        # of elements that end together the inner ones are closed first
        order = np.lexsort((-place, last))
        run = np.cumsum(close_len[order])
        fresh = np.r_[True, np.diff(last[order]) != 0]
        run -= np.repeat((run - close_len[order])[fresh], np.diff(np.r_[np.flatnonzero(fresh), len(order)]))
        own = np.empty(len(nodes), np.int64)
        own[order] = run
        finish = opened[last + 1] + closed[last] + own - at[start]
        out["html_start"], out["html_end"] = pa.array(begin, pa.int32()), pa.array(finish, pa.int32())
        out["html_open_end"] = pa.array(np.where(first, finish, begin + open_len), pa.int32())
        if "doc_html" in want:
            after = [""] * len(nodes)
            for k in np.flatnonzero(close_len)[::-1].tolist():
                after[last[k]] += closes[k]
            whole = np.full(len(nodes), None, object)
            whole[first] = ["".join(chain.from_iterable(zip(opens[a : a + n], after[a : a + n], strict=True))) for a, n in zip(base.tolist(), sizes.tolist(), strict=True)]
            out["doc_html"] = pa.array(whole, pa.string())
    return out


def parse_nodes(df: DataFrame, id_col: str = "doc_id", html_col: str = "html", drop_ws: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """The node table of all documents in `df`, a row for each node. Null HTML makes a document without children.

    Parsing is local to a row and keeps no state, so it runs over a stream as well. The Python step stops column pruning: name
    the `columns` that are needed (STRUCTURE is the cheapest useful choice), and keep the result if several queries read it.
    """
    importable(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    wanted = [c for c in ARROW.names if columns is None or c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            collects = gc.isenabled()
            gc.disable()  # a batch makes many objects and no cycles
            try:
                out = batch_of(b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()], drop_ws, wanted)
            finally:
                if collects:
                    gc.enable()
            yield out

    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").cast("binary").alias("html"))
    return slim.mapInArrow(run, ", ".join(f"{c} {_SQL_TYPES[c]}" for c in wanted))
