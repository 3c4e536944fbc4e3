"""License scans: named phrases at their places, and an exact containment join of text blocks with license templates."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import common

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The wording by which licenses are commonly named or begin.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: The phrases, in words of the template, that tell a license from others of nearly the same wording. A run of
#: words holds a template only with all of them.
TELLING = {
    "apache-2.0": ("apache license", "2 0"),
    "cc-by-nc-4.0": ("cc by nc 4 0",),
    "cc-by-sa-4.0": ("cc by sa 4 0",),
    "gpl-3.0": ("gnu general public license", "3"),
    "mit-notice": ("mit",),
    "mpl-2.0": ("mozilla public license", "2 0"),
}
#: A block, which is a run of words as long as the template or (see `scan`) a line, holds a template if at least this share of the
#: template's distinct words is in it.
CONTAINMENT = 0.8
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower case, on UTF-8 bytes.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def words_of(text: bytes) -> list[bytes]:
    return _WORDS(text.lower())  # bytes.lower() is for ASCII alone


def _binary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return common.doc_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))


def block_frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each template word occurs. Counts cover all documents; only the templates' words are kept."""
    wanted = frozenset(w for t in templates.values() for w in words_of(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(1).to_pylist():
                seen.update(wanted.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = _binary(docs, id_col, text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(wanted, 0) | {bytes(r.word): r.n for r in counts.collect()}  # one row a template word


class Matcher:
    """Finds every block whose overlap with a template reaches the threshold.

    All words have one order: first those of no template, which no template's frequency counts, then template words from rare to
    frequent. An overlap of `need` words must touch the first size - need + 1 words of a template (prefix filter); a block needs
    that many distinct words (length filter); and of the block only the words from the first one that it shares on can be
    shared, so that many must be left of it in the order (positional filter; on the template's side the prefix has seen to
    that). What passes is verified on the whole sets. `rejected` counts what each filter turned away.
    """

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], threshold: float, telling: dict[str, tuple[str, ...]] | None = None):
        self.templates, self.by_word, self.runs = [], {}, []
        self.telling = {label: [p.encode().split() for p in phrases] for label, phrases in (telling or {}).items()}
        self.rejected = Counter()
        for label, text in sorted(templates.items()):
            words = sorted(set(words_of(text.encode())), key=lambda w: (frequency.get(w, 0), w))
            if not words:
                continue  # a template without words is held by nothing
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            k = len(self.templates)
            self.templates.append((label, frozenset(words), need))
            self.runs.append(len(words_of(text.encode())))
            for w in words[: len(words) - need + 1]:
                self.by_word.setdefault(w, []).append(k)
        self.prefix = frozenset(self.by_word)
        order = sorted({w for _, t, _ in self.templates for w in t}, key=lambda w: (frequency.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(order)}

    def _touched(self, words: set[bytes] | frozenset[bytes]) -> dict[int, list[bytes]]:
        """Templates of which a prefix word is in `words`, with those words."""
        out: dict[int, list[bytes]] = {}
        for w in words & self.prefix:
            for k in self.by_word[w]:
                out.setdefault(k, []).append(w)
        return out

    def _passes(self, k: int, words: set[bytes], hits: list[bytes]) -> bool:
        """Length and positional filters of a block for template k, whose prefix words in the block are `hits`."""
        need = self.templates[k][2]
        if len(words) < need:
            self.rejected["length"] += 1
            return False
        first = min(self.place[w] for w in hits)
        if sum(self.place.get(w, -1) >= first for w in words) < need:
            self.rejected["position"] += 1
            return False
        return True

    def block(self, words: set[bytes]) -> list[tuple[str, float]]:
        found = []
        for k, hits in self._touched(words).items():
            label, template, need = self.templates[k]
            if self._passes(k, words, hits) and (n := len(words & template)) >= need:
                found.append((label, n / len(template)))
        return found

    def text(self, low: bytes, words: list[bytes], held: set[bytes], lines: bool) -> list[tuple[str, float]]:
        """Templates in the runs of words of a text in lower case, which pass over line ends, and in its `lines`, where any
        words count. Runs with a word of a template's prefix lie in short stretches around such words; no block holds more
        than its stretch does, nor than the whole text, so the filters are tried on those first."""
        touched = {k: hits for k, hits in self._touched(held).items() if self._passes(k, held, hits)}
        if not touched:
            return []
        found = [x for line in low.split(b"\n") for x in self.block(set(_WORDS(line)))] if lines else []
        wanted = {w for hits in touched.values() for w in hits}
        spots: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                spots.setdefault(w, []).append(i)
        for k, hits in touched.items():
            label, template, need = self.templates[k]
            best = 0
            for a, b in stretches(sorted(i for w in hits for i in spots[w]), self.runs[k], len(words)):
                part = words[a:b]
                kinds = set(part)
                if self._passes(k, kinds, [w for w in hits if w in kinds]):
                    best = max(best, most_in_run(part, template, self.runs[k], self.telling.get(label, ())))
            if best >= need:
                found.append((label, best / len(template)))
        return found


def stretches(at: list[int], size: int, n: int) -> Iterator[tuple[int, int]]:
    """From and to of the stretches of n words that hold all runs of `size` words with one of the places `at`."""
    lo = hi = None
    for i in at:
        a, b = max(0, i - size + 1), min(n, i + size)
        if lo is not None and a <= hi:
            hi = b
            continue
        if lo is not None:
            yield lo, hi
        lo, hi = a, b
    if lo is not None:
        yield lo, hi


def template_table(templates: DataFrame, most_bytes: int = 4 << 20) -> dict[str, str]:
    """Templates from a table (label, text), such as whole license texts. Every worker holds them, so a table of over
    `most_bytes` is refused. Rows without label or text are none; of equal labels the smallest text counts."""
    rows = templates.select(F.col("label").cast("string").alias("label"), F.col("text").cast("string").alias("text")).where("label is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("label")), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"templates of {size} bytes; at most {most_bytes} go to every worker")
    return {r.label: r.text for r in rows.groupBy("label").agg(F.min("text").alias("text")).collect()}


def most_in_run(words: list[bytes], template: frozenset[bytes], size: int, telling: Sequence[list[bytes]] = ()) -> int:
    """The most distinct words of `template` in any `size` consecutive words that hold all phrases of `telling`, whose words
    are the template's. Runs that end with a word of the template are enough."""
    spots = [(places(words, p), len(p)) for p in telling]
    if not all(starts for starts, _ in spots):
        return 0
    at = [i for i, w in enumerate(words) if w in template]
    inside: Counter = Counter()
    best = lo = 0
    for i in at:
        inside[words[i]] += 1
        while at[lo] <= i - size:
            w = words[at[lo]]
            inside[w] -= 1
            if not inside[w]:
                del inside[w]
            lo += 1
        if len(inside) > best and all((k := bisect_right(starts, i + 1 - n)) and starts[k - 1] > i - size for starts, n in spots):
            best = len(inside)
    return best


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where `phrase` stands consecutively."""
    at, i, n = [], -1, len(phrase)
    while True:
        try:
            i = words.index(phrase[0], i + 1)
        except ValueError:
            return at
        if words[i : i + n] == phrase:
            at.append(i)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = CONTAINMENT, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text", telling: dict[str, tuple[str, ...]] = TELLING, any_in_lines: bool = False) -> DataFrame:
    """A row for each row of `docs`: words, places of base phrases, labels of phrases and of templates, and a score, which is
    the largest containment of a template that reaches the threshold, or 1 with a base phrase, else 0.

    A block is a run of as many words as the template has, wherever lines end: wrapped notices count. It must hold the phrases
    of `telling` too. With `any_in_lines` lines of any length are blocks as well, without those phrases, as in the oracle SQL:
    there NC is also labelled SA. Null texts count as empty: no words,
    no places, null first and last words, empty labels, score 0. Null ids stay; repeated rows give repeated rows; an empty
    table gives an empty one. Two passes over the texts, no shuffle of rows.
    """
    common.tune(docs.sparkSession)
    frequency = block_frequencies(docs, templates, id_col, text_col)
    split = [(p.encode().split(), label) for p, label in phrases.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, frequency, threshold, telling)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                low = text.lower()
                words = _WORDS(low)
                held = set(words)
                at, base, more, score = [], set(), set(), 0.0
                for phrase, label in split:
                    if held.issuperset(phrase) and (found := places(words, phrase)):
                        at += found
                        base.add(label)
                        score = 1.0
                for label, share in matcher.text(low, words, held, any_in_lines):
                    more.add(label)
                    score = max(score, share)
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return _binary(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), any_in_lines=True)


def _sql() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    low = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    at = " || ".join(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {quoted(p.split())}), lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in PHRASES.items())
    t = ", ".join(f"('{label}', {quoted(sorted({w.decode() for w in words_of(x.encode())}))})" for label, x in TEMPLATES.items())
    return f"""
WITH d AS (SELECT doc_id, {low("coalesce(text, '')")} AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, {word}) AS w FROM d),
p AS (SELECT doc_id, x, len(w) AS n_words, {at} AS spots FROM w),
t(label, words) AS (VALUES {t}),
b AS (SELECT DISTINCT doc_id, unnest(string_split(x, chr(10))) AS line FROM d),
m AS (SELECT doc_id, label, CAST(len(list_intersect(list_distinct(regexp_extract_all(line, {word})), words)) AS DOUBLE) / len(words) AS share FROM b, t),
s AS (SELECT doc_id, list(DISTINCT label) AS more, max(share) AS share FROM m WHERE share >= {CONTAINMENT} - 1e-9 GROUP BY doc_id)
SELECT p.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(spots) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(spots, lambda a: a.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(spots, lambda a: a.at)) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(spots, lambda a: a.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(spots, lambda a: a.label) || coalesce(more, []))), ',') AS labels,
  greatest(CASE WHEN len(spots) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE, coalesce(share, 0.0)) AS score
FROM p LEFT JOIN s USING (doc_id)
"""


SQL = _sql()
