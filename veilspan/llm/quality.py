"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text are computed in one pass over it.  Trees are grown level by
level from histograms of binned statistics, on a bounded sample of labelled rows
(``SAMPLE``), and flattened into arrays; a batch of documents walks all of them
with numpy indexing, one step a level.

Defined results: null and empty texts have the statistics of an empty text and
get a score; without labels of both kinds every score is the share of label 1
(0.5 without labels); doc_id may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan.llm.common import in_slices
from veilspan.llm.learning import held_out, labelled_sample

#: Labelled rows that trees are grown on.
SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, LEAST_WEIGHT, RIDGE = 64, 4, 60, 0.2, 5.0, 1.0
THRESHOLD = 0.5

_SIGNS = re.compile(r"[^\w\s]")
STATISTICS = ("words", "mean_word", "distinct", "top_word", "repeats", "upper_words", "title_words", "digits", "signs", "kinds_of_signs",
              "top_sign", "lines", "line_words", "same_lines", "short_words", "long_words", "sign_ends", "lone_signs", "stops", "beyond_ascii", "commas",
              "distinct_short", "white")


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    count = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    signs = Counter(_SIGNS.findall(text))
    lengths = list(map(len, words))
    short = [w for w, k in zip(words, lengths) if k <= 3]
    return [
        float(len(words)), sum(lengths) / n, len(count) / n, max(count.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n,
        sum(map(text.count, "0123456789")) / chars, signs.total() / n, float(len(signs)), max(signs.values(), default=0) / n,
        float(len(lines)), len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(short) / n, sum(k > 9 for k in lengths) / n,
        sum(not w[-1].isalnum() for w in words) / n, sum(k == 1 and not w.isalnum() for w, k in zip(words, lengths)) / n,
        text.count(".") / n, 1 - len(text) / max(1, len(text.encode())), text.count(",") / n, len(set(short)) / max(1, len(short)),
        (len(text) - sum(lengths)) / chars,
    ]


def matrix(texts: Iterable[str | None]) -> np.ndarray:
    rows = [statistics(t) for t in texts]
    return np.array(rows, np.float64).reshape(len(rows), len(STATISTICS))


@dataclass
class Forest:
    """Trees side by side: node k of tree t goes left if x[feature[t, k]] <= cut[t, k]; children are 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the logistic loss."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    empty = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y) or y.min() == y.max():
        empty.base = 0.0 if not len(y) else float(np.where(y[0] == 1, 30, -30))
        return empty
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
    width, m = BINS, x.shape[1]
    flat = binned + np.arange(m) * width
    share = y.mean()
    total = np.full(len(y), np.log(share / (1 - share)))
    forest = Forest(float(total[0]), *(np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, float), (leaves, float))))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        slope, bend = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        forest.cut[tree] = np.inf
        for level in range(DEPTH):
            first, many = 2 ** level - 1, 2 ** level
            where = ((at - first)[:, None] * (m * width) + flat).ravel()
            sums = [np.bincount(where, np.repeat(w, m), many * m * width).reshape(many, m, width).cumsum(axis=2) for w in (slope, bend)]
            (g, h), (all_g, all_h) = sums, (s[:, :, -1:] for s in sums)
            gain = g ** 2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g ** 2 / (all_h + RIDGE)
            gain[(h < LEAST_WEIGHT) | (all_h - h < LEAST_WEIGHT)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                feature, b = divmod(int(best[k]), width)
                if gain[k, feature, b] > 1e-9 and b < len(edges[feature]):
                    forest.feature[tree, first + k], forest.cut[tree, first + k] = feature, edges[feature][b]
            feature = forest.feature[tree, at]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature] > forest.cut[tree, at])
        leaf = at - inner
        g, h = (np.bincount(leaf, w, leaves) for w in (slope, bend))
        forest.leaf[tree] = RATE * g / (h + RIDGE)
        total += forest.leaf[tree][leaf]
    return forest


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", n: int = 3, rest: int = 1, rows: int = SAMPLE) -> Forest:
    """Trees from a sample of at most ``rows`` labelled documents; only their statistics reach the driver."""
    sample = labelled_sample(docs, labels, column, n, rest, rows)
    names = [f"x{i}" for i in range(len(STATISTICS))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, x.T.copy()), batch.column(2)], names=["doc_id", *names, "label"])

    found = sample.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", label int").toPandas()
    found = found.sort_values("doc_id")  # the same trees whatever the order of rows
    return grow(found[names].to_numpy(), found["label"].to_numpy())


def scored(docs: DataFrame, forest: Forest, n: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            scores = forest.scores(matrix(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(n, rest).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
