"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import common, labelled

#: Ids with this remainder are held out; a score of KEEP or more predicts good quality.
FOLD, KEEP = (4, 2), 0.7
#: Most labelled rows and most preference pairs that the ranking is fitted on; bins of each feature.
ROWS, PAIRS, BINS = 12_000, 30_000, 10

NAMES = ("log_words", "word_len", "upper", "digits", "symbols", "bangs", "bars", "commas_dots", "distinct", "top_word", "repeats", "line_dups", "line_words", "short_words", "symbol_words", "upper_words")

_SYMBOLS = np.frombuffer(b"#$%&*@<>{}[]\\^_~=+/", np.uint8)


def features(texts: list[str]) -> np.ndarray:
    """A row of NAMES for each whole text; an empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for k, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        raw = text.encode("utf-8", "surrogatepass")
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n, w = len(raw), len(words)
        counts = Counter(words)
        lines = [x for x in text.split("\n") if x]
        kinds = len(counts)
        letters = max(1, h[65:91].sum() + h[97:123].sum())
        rare = sum(c for x, c in counts.items() if x[-1] in "#$%&*@!|" or x[0] in "#$%&*@|")
        loud = sum(c for x, c in counts.items() if len(x) > 1 and x.isupper())
        out[k] = (
            np.log1p(w), (n - w) / w, h[65:91].sum() / letters, h[48:58].sum() / n, h[_SYMBOLS].sum() / n, h[33] / n, h[124] / n,
            (h[44] + h[46]) / w, kinds / w ** 0.8, max(counts.values()) / w, sum(map(eq, words, words[1:])) / w,
            1 - len(set(lines)) / max(1, len(lines)), w / max(1, len(lines)), sum(c for x, c in counts.items() if len(x) < 4) / w, rare / w, loud / w,
        )
    return out


class Ranker:
    """Additive scores over binned features. Of a good and a bad document the good one should win: minimizes the logistic
    loss of score differences, which are sums of weights over the differences of their bins' indicators."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, steps: int = 250, l2: float = 1e-4):
        self.cut, self.weights, self.at = None, None, 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):  # without pairs nothing can be ranked
            self.constant = 1.0 if len(good) >= len(bad) else 0.0
            return
        self.constant = None
        # bins follow the rarer label as much as the common one
        pool = np.vstack([x[good], np.repeat(x[bad], max(1, len(good) // len(bad)), axis=0)])
        self.cut = np.quantile(pool, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
        z = self._bins(x)
        rng = np.random.default_rng(seed)
        i, j = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
        d = z[i] - z[j]
        w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
        for t in range(1, steps + 1):
            g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))) / len(d) + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weights = w
        raw = z @ w
        # the cut is the score quantile at the bad rows' share of all labelled rows
        share = len(bad) / len(y)
        self.at = float((np.quantile(raw, share, method="lower") + np.quantile(raw, share, method="higher")) / 2)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        parts = []
        for f in range(x.shape[1]):
            onehot = np.zeros((len(x), BINS), np.float32)
            onehot[np.arange(len(x)), np.searchsorted(self.cut[:, f], x[:, f], side="left")] = 1
            parts.append(onehot)
        return np.hstack(parts)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        margin = self._bins(x) @ self.weights - self.at
        return 1 / (1 + np.exp(-np.clip(margin + np.log(KEEP / (1 - KEEP)), -40, 40)))


def train(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Fits on at most about ROWS labelled rows outside the held-out fold; their features, not texts, go to the driver."""
    rows = labelled.sample(docs, labels, "quality", FOLD, ROWS)
    _, x, y = labelled.features(rows, NAMES, features)
    common.discard(rows)
    return Ranker(x, y)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs`; texts alone decide the score.

    Null texts score as empty ones; null ids are kept and not held out; repeated rows give repeated rows; an empty table gives
    an empty one. Labels of one kind only score everything 1 (all good) or 0; without any label, 1.
    """
    model = train(docs, labels)
    return labelled.score(docs, FOLD, lambda texts: model.score(features(texts)), KEEP)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
