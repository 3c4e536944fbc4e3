"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm import common, labelled

#: Ids with this remainder are held out; a score of REJECT or more predicts toxicity.
FOLD, REJECT = (3, 1), 0.7
#: Most labelled rows that the trees are fitted on, and most words of the learned lexicon.
ROWS, LEXICON = 15_000, 1_000
#: A lexicon word is in so many toxic rows and such a share of them at least, and so many times as often in them as in others.
LEAST, SHARE, RATIO = 3, 0.01, 8.0

#: Second-person words of a few languages, and characters that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton vous votre usted tú ti vosotros".split())
DISGUISE = str.maketrans("013457@$!|", "oieastasil")

NAMES = ("lexicon", "lexicon_count", "lexicon_kinds", "strong", "near_you", "you", "capitals", "capital_words", "bangs", "marks", "disguised", "symbols", "log_words")

_WORD = re.compile(r"[^\W_]+(?:[@$!|*0-9]+[^\W_]+)*").findall


def words_of(text: str) -> list[str]:
    return _WORD(text.lower())


def features(texts: list[str], lexicon: dict[str, float]) -> np.ndarray:
    """A row of NAMES for each whole text; `lexicon` has a weight for each word."""
    out = np.zeros((len(texts), len(NAMES)))
    for k, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        n, size = len(words), len(text)
        counts = Counter(words)
        hits = {w: c for w, c in counts.items() if w in lexicon}
        disguised = 0
        for w, c in counts.items():
            if not w.isalpha() and not w.isdigit():
                plain = w.translate(DISGUISE).replace("*", "")
                disguised += c
                if w not in lexicon and plain in lexicon:
                    hits[plain] = hits.get(plain, 0) + c
        near = you = 0
        spots = [i for i, w in enumerate(words) if w in SECOND_PERSON] if not SECOND_PERSON.isdisjoint(counts) else []
        if spots:
            you = len(spots)
            if hits:
                near = sum(any(w in lexicon for w in words[max(0, i - 5) : i + 6]) for i in spots)
        raw = text.encode("utf-8", "surrogatepass")
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        upper = h[65:91].sum()
        total = sum(hits.values())
        out[k] = (
            total / n, np.log1p(total), len(hits), sum(lexicon[w] * c for w, c in hits.items()) / np.sqrt(n), near, you / n, upper / max(1, upper + h[97:123].sum()),
            sum(1 for x in text.split() if len(x) > 1 and x.isupper()) / n, h[33] / size, (h[33] + h[63] + h[46] + h[44]) / size, disguised / n, h[[35, 36, 37, 38, 42, 64]].sum() / size, np.log1p(n),
        )
    return out


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Words that are much more frequent, by documents, in toxic rows than in others, with their log ratio; at most LEXICON
    of them. Words come from toxic rows; only those seen in LEAST of them are looked up in the others."""

    def count(wanted: frozenset | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for b in batches:
                for t in b.column(0).to_pylist():
                    kinds = set(words_of(t))
                    seen.update(kinds if wanted is None else kinds & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

        return run

    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    toxic = rows.where("y = 1").select("text").mapInArrow(count(None), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= max(LEAST, SHARE * n1))
    # each toxic row of the bounded sample can bring at most 1 / SHARE words this far, on average
    seen = {r.w: r.n for r in toxic.collect()}
    others = rows.where("y = 0").select("text").mapInArrow(count(frozenset(seen)), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    clean = {r.w: r.n for r in others.collect()}
    ratio = {w: (n / n1) / ((clean.get(w, 0) + 0.5) / n0) for w, n in seen.items()}
    best = sorted((w for w in ratio if ratio[w] >= RATIO), key=lambda w: (-ratio[w], w))[:LEXICON]
    return {w: float(np.log(ratio[w])) for w in best}


class Trees:
    """Boosted regression trees for logistic loss, on histograms of binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0):
        self.cut = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        b = self._bins(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees, self.depth, self.rate = float(np.log(p / (1 - p))), [], depth, rate
        raw = np.full(len(y), self.base)
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, y - prob, prob * (1 - prob), bins, l2, least)
            self.trees.append(tree)
            raw += rate * self._apply(tree, b)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cut)])

    def _grow(self, b, g, h, bins, l2, least):
        """Complete trees: arrays of a feature and a bin for each inner node, a value for each leaf."""
        node = np.zeros(len(g), np.int64)
        feature, limit = [], []
        for level in range(self.depth):
            k = 1 << level
            best = [(0.0, 0, bins)] * k
            for f in range(b.shape[1]):
                at = node * bins + b[:, f]
                gs, hs = (np.bincount(at, v, k * bins).reshape(k, bins).cumsum(1) for v in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                top = gain.argmax(1)
                for i in range(k):
                    if gain[i, top[i]] > best[i][0] + 1e-9:
                        best[i] = (gain[i, top[i]], f, int(top[i]))
            fs, ls = np.array([x[1] for x in best]), np.array([x[2] for x in best])
            feature.append(fs)
            limit.append(ls)
            node = node * 2 + (b[np.arange(len(b)), fs[node]] > ls[node])
        k = 1 << self.depth
        return feature, limit, np.bincount(node, g, k) / (np.bincount(node, h, k) + l2)

    @staticmethod
    def _apply(tree, b):
        feature, limit, value = tree
        node = np.zeros(len(b), np.int64)
        for fs, ls in zip(feature, limit, strict=True):
            node = node * 2 + (b[np.arange(len(b)), fs[node]] > ls[node])
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(x)
        return self.base + self.rate * sum(self._apply(t, b) for t in self.trees)


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing fit of y on raw (pool adjacent violators); between knots it is interpolated."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, s = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + s
    return np.array([s / w for _, w, s in blocks]), np.array([m for m, _, _ in blocks])


class Model:
    """A lexicon, trees fitted on four fifths of the sample and calibration on the last."""

    def __init__(self, lexicon: dict[str, float], ids: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.lexicon, self.trees = lexicon, None
        self.prior = float(y.mean()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return
        held = (ids * 2654435761 % 2**32) % 5 == 0
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            held = np.zeros(len(y), bool)
        self.trees = Trees(x[~held], y[~held])
        use = held if held.any() else ~held
        self.knots, self.levels = isotonic(self.trees.raw(x[use]), y[use])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(features(texts, self.lexicon))
        # a slope of a thousandth keeps the order of the trees where calibration is level
        return 0.999 * np.interp(raw, self.knots, self.levels) + 0.001 / (1 + np.exp(-raw))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most about ROWS labelled rows outside the held-out fold; their features, not texts, go to the driver."""
    rows = labelled.sample(docs, labels, "toxic", FOLD, ROWS)
    lexicon = learn_lexicon(rows)
    model = Model(lexicon, *labelled.features(rows, NAMES, lambda texts: features(texts, lexicon)))
    common.discard(rows)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`; texts alone decide the score.

    Null texts score as empty ones; null ids are kept and not held out; repeated rows give repeated rows; an empty table gives
    an empty one. Where labels are of one kind every score is that kind's share, without any label 0.
    """
    model = train(docs, labels)
    return labelled.score(docs, FOLD, model.score, REJECT)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that aren't predicted toxic. One pass: texts are scored beside the rows.

    Null and empty texts score alike; null ids, repeated rows and rows of one id are judged each by its text; without labels
    all rows stay; an empty table gives an empty one.
    """
    common.tune(docs.sparkSession)
    model, at = train(docs, labels), docs.columns.index("text")

    def toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            keep = model.score(texts) < REJECT if texts else np.zeros(0, bool)
            yield b.filter(pa.array(keep))

    return common.map_rows(docs, toxic)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
