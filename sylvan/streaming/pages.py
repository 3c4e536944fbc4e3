"""Parsing a stream of pages: the parser keeps no state, so a streaming DataFrame goes through it like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.dom.frame import parse_nodes
from sylvan.selector import predicates
from sylvan.selector.parser import compiled


def select_stream(pages: DataFrame, selector: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Matching nodes of a stream for selectors of single compounds (filters need no state; combinators would)."""
    groups = compiled(selector).groups
    if any(len(g) > 1 or g[0].combinator for g in groups):
        raise ValueError("a stream is filtered node by node: combinators ask for a parsed corpus")
    test = F.lit(False)
    for g in groups:
        test = test | predicates.compound(g[0])
    return parse_nodes(pages, id_col, html_col).where(test)
