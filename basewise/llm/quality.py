"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so has each of the chosen
pairs of features. Tables are learned by cyclic boosting: shallow trees on one feature
(or one pair) at a time, added with a small rate. A score is the logistic of the sum of
the tables' entries.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as slot

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewise.llm.common import text_of

#: Labelled rows that a model is fitted on at most: those least in a fixed hash order.
FIT_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 32, 8, 150, 50, 6, 0.1, 1.0

FEATURES = (
    "log_length", "log_words", "word_length", "upper", "digits", "stops", "marks", "bars", "bangs", "breaks",
    "distinct_words", "top_word", "distinct_lines", "odd_ends", "short_words", "non_ascii", "echoes",
)
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_STOPS, _MARKS = b".,;:?'\"()-", b"#$%&*@^~_+=<>{}[]\\/"
_PLAIN_END = frozenset(_LETTERS + _DIGITS + _STOPS)


def _share(data: bytes, of: bytes) -> float:
    return (len(data) - len(data.translate(None, of))) / len(data)


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; an empty or null one is all zeros."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = data.translate(None, bytes(set(range(256)) - set(_LETTERS)))
    return [
        np.log1p(len(data)), np.log1p(len(words)), sum(map(len, words)) / len(words),
        _share(letters, _UPPER) if letters else 0.0, _share(data, _DIGITS), _share(data, _STOPS), _share(data, _MARKS),
        _share(data, b"|"), _share(data, b"!"), data.count(b"\n") / len(data),
        len(counts) / len(words), counts.most_common(1)[0][1] / len(words), len(set(lines)) / len(lines),
        sum(w[-1] not in _PLAIN_END for w in words) / len(words), sum(len(w) <= 3 for w in words) / len(words),
        _share(data, bytes(range(128, 256))), sum(map(bytes.__eq__, words, words[1:])) / len(words),
    ]


@dataclass
class Model:
    """``cuts`` and ``tables`` by feature; ``pairs`` of features with coarse cuts and a table each."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = slot(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = slot(default_factory=dict)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[f], rows[:, f], side="right")]
        for (f, g), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[f], rows[:, f], side="right"), np.searchsorted(self.coarse[g], rows[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of up to three leaves, from the bins' gradients and hessians."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, 0)
        for a, b in parts:
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            if len(gains) and gains.max() > best[0]:
                best = (gains.max(), (a, b), a + int(gains.argmax()) + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature, then each side by the second."""
    n, m = g.shape
    cg, ch = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    whole, best = _gain(g.sum(), h.sum()), (0.0, np.zeros((n, m)))
    for i in range(n - 1):
        out, gain = np.zeros((n, m)), -whole
        for rows, sg, sh in ((slice(0, i + 1), cg[i], ch[i]), (slice(i + 1, n), cg[-1] - cg[i], ch[-1] - ch[i])):
            a, b = np.cumsum(sg), np.cumsum(sh)
            gains = _gain(a[:-1], b[:-1]) + _gain(a[-1] - a[:-1], b[-1] - b[:-1])
            j = int(gains.argmax()) if m > 1 else m - 1
            gain += gains[j] if m > 1 else _gain(a[-1], b[-1])
            out[rows, :j + 1] = a[j] / (b[j] + RIDGE)
            if j + 1 < m:
                out[rows, j + 1:] = (a[-1] - a[j]) / (b[-1] - b[j] + RIDGE)
        if gain > best[0]:
            best = (gain, out)
    return best


def fit_rows(rows: np.ndarray, labels: np.ndarray) -> Model:
    """A model of rows of features and labels 0 or 1. No rows give a score of one half, one class that class."""
    width = len(FEATURES)
    if not len(rows):
        return Model(0.0, [np.array([])] * width, [np.zeros(1)] * width, [np.array([])] * width)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [_edges(rows[:, f], BINS) for f in range(width)]
    coarse = [_edges(rows[:, f], COARSE) for f in range(width)]
    bins = [np.searchsorted(cuts[f], rows[:, f], side="right") for f in range(width)]
    wide = [np.searchsorted(coarse[f], rows[:, f], side="right") for f in range(width)]
    model = Model(base, cuts, [np.zeros(len(c) + 1) for c in cuts], coarse)
    logit = np.full(len(rows), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            n = len(cuts[f]) + 1
            step = RATE * _tree(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n))
            model.tables[f] += step
            logit += step[bins[f]]

    def grids(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        n, m = len(coarse[f]) + 1, len(coarse[k]) + 1
        at = wide[f] * m + wide[k]
        return np.bincount(at, g, n * m).reshape(n, m), np.bincount(at, h, n * m).reshape(n, m)

    ranked = sorted(((_pair_tree(*grids(f, k))[0], (f, k)) for f, k in itertools.combinations(range(width), 2)), reverse=True)
    chosen = [pair for gain, pair in ranked[:PAIRS] if gain > 0]
    for f, k in chosen:
        model.pairs[f, k] = np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))
    for _ in range(PAIR_ROUNDS):
        for f, k in chosen:
            step = RATE * _pair_tree(*grids(f, k))[1]
            model.pairs[f, k] += step
            logit += step[wide[f], wide[k]]
    return model


def held_out(id_col: str) -> Column:
    """Whether a row's label is never learned: crc32 of the id as text leaves 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def feature_column(column: Column) -> Column:
    @F.pandas_udf("array<double>")
    def numbers(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(features)

    return numbers(column)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = FIT_ROWS) -> Model:
    """A model from the rows of ``df`` that are labelled and not held out, ``max_rows`` of them at most.

    Null labels and ids are left out; repeated labels and rows count as often as they stand.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{label_col}`").cast("double").alias("label"))
        .filter(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out("key"))
        .orderBy(F.xxhash64("key"), "key", "label").limit(max_rows)
    )
    texts = df.select(F.col(f"`{id_col}`").alias("key"), text_of(text_col).alias("text"))
    # At most max_rows short rows are broadcast, and as many are learned from where ids repeat.
    joined = texts.join(F.broadcast(known), "key").orderBy(F.xxhash64("key"), "key", F.xxhash64("text")).limit(max_rows)
    rows = joined.select(feature_column(F.col("text")).alias("numbers"), "label").toPandas()
    return fit_rows(np.array(rows["numbers"].tolist(), dtype=float).reshape(-1, len(FEATURES)), rows["label"].to_numpy(dtype=float))


def score_column(model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its scores, a batch at a time; null counts as empty."""

    @F.pandas_udf("double")
    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(model.scores(np.array([features(t) for t in part], dtype=float).reshape(-1, len(FEATURES))))

    return scores


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` of each row, repeated rows included; an empty table gives no rows."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    scored = rows.select("id", held_out("id").alias("held_out"), score_column(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
