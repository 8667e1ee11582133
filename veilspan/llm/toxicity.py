"""Toxicity: a linear-chain conditional random field over the words of a text.

Two states, clean and toxic.  A word's emission is the sum of hashed weights of
the word, its beginnings and its endings; transitions make toxic words near each
other likelier.  Forward-backward gives every word's probability of being toxic;
the largest ones and their sum make the document's score, and words above one
half are the offending spans.

Token labels.  The tables label documents, not words.  Words of clean documents
are clean; words of toxic documents are first labelled by how much likelier their
features are in toxic documents than in clean ones, then relabelled by the field
itself (``ROUNDS``).  The score's last step, a logistic function of four numbers
a document, is fitted on sampled documents that the field has not seen.

Two states make the recursions scalar: the log-odds of the state is passed on.
Documents of like length run side by side in numpy.

The sample is bounded by ``SAMPLE`` documents and ``TRAIN_WORDS`` words.

Defined results: null and empty texts have no words and get the score of a
document without toxic words; without labels of both kinds every score is the
share of label 1 (0 without labels); doc_id may be null or repeated; other
columns are kept by ``without_toxic`` and ignored by ``scored``.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilspan.llm.common import in_slices
from veilspan.llm.learning import held_out, labelled_sample

#: Labelled documents in the sample, words the field is trained on, words of a training sequence.
SAMPLE, TRAIN_WORDS, SPAN = 8_000, 500_000, 32
#: Hashed weights, steps of a fit, relabelling rounds, ridge.
WEIGHTS, STEPS, ROUNDS, RIDGE = 1 << 18, 60, 2, 2e-6
#: Log-odds from which a word of a toxic document is first labelled toxic, and toxic documents that must hold the feature.
SEED_ODDS, SEED_DOCS = 2.5, 3
#: Hashed features that are counted by document.
SEED_FEATURES = 1 << 22
THRESHOLD = 0.3
#: Words a task remembers the emission of, and words that run side by side.
REMEMBERED, WORDS_AT_ONCE = 300_000, 500_000

_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    word = word.lower()
    n = len(word)
    return ["=" + word, *["^" + word[:k] for k in range(3, min(n, 8))], *[word[-k:] + "$" for k in range(3, min(n, 6))]]


def hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "replace")) & WEIGHTS - 1 for f in features(word)]


def _forward(r, a):
    """Log-odds after one transition: a[i, j] scores going from i to j."""
    return np.logaddexp(a[0, 1], r + a[1, 1]) - np.logaddexp(a[0, 0], r + a[1, 0])


def _backward(s, a):
    return np.logaddexp(a[1, 0], a[1, 1] + s) - np.logaddexp(a[0, 0], a[0, 1] + s)


def marginals(emission: np.ndarray, lengths: np.ndarray, start: float, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of toxic at (time, sequence), and what came from before and from behind; rows of ``emission`` past a length are ignored."""
    times, many = emission.shape
    before, behind = np.zeros_like(emission), np.zeros_like(emission)
    r = start + emission[0]
    before[0] = start
    for t in range(1, times):
        before[t] = _forward(r, a)
        r = before[t] + emission[t]
    ends = lengths - 1
    s = np.zeros(many)
    for t in range(times - 2, -1, -1):
        s = np.where(t < ends, _backward(emission[t + 1] + s, a), 0.0)
        behind[t] = s
    return before + emission + behind, before, behind


@dataclass
class Field:
    """Weights of the field and of the document score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(WEIGHTS))
    bias: float = -4.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score: np.ndarray | None = None
    share: float = 0.0

    def emission(self, words: Iterable[str]) -> np.ndarray:
        return np.array([self.bias + self.weights[hashed(w)].sum() for w in words], np.float64)

    def document_scores(self, numbers: np.ndarray) -> np.ndarray:
        if self.score is None:
            return np.full(len(numbers), self.share)
        z = numbers @ self.score[1:] + self.score[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Tagger:
    """Applies a field to texts; remembers the emissions of words."""

    def __init__(self, model: Field):
        self.model, self.known = model, {}

    def words(self, texts: list[str | None]) -> list[list[str]]:
        cut = [_WORD.findall(t or "") for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*cut) - self.known.keys())
        self.known.update(zip(new, self.model.emission(new).tolist()))
        return cut

    def odds(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Log-odds of toxic for the words of each text, in the order of the texts."""
        at = 0
        while at < len(texts):
            some, chars = at, 0
            while at < len(texts) and (at == some or chars < WORDS_AT_ONCE * 6):
                chars += len(texts[at] or "")
                at += 1
            yield from self._odds(self.words(texts[some:at]))

    def _odds(self, cut: list[list[str]]) -> list[np.ndarray]:
        out: list = [np.zeros(0)] * len(cut)
        order = sorted((i for i in range(len(cut)) if cut[i]), key=lambda i: len(cut[i]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(cut[order[to]]) <= 1.4 * len(cut[order[at]]) + 8:
                to += 1
            group = order[at:to]
            at = to
            lengths = np.array([len(cut[i]) for i in group])
            emission = np.zeros((len(group), lengths.max()))
            emission[np.arange(lengths.max()) < lengths[:, None]] = np.fromiter(
                (e for i in group for e in map(self.known.__getitem__, cut[i])), np.float64, lengths.sum())
            found, _, _ = marginals(np.ascontiguousarray(emission.T), lengths, self.model.start, self.model.moves)
            for k, i in enumerate(group):
                out[i] = found[:lengths[k], k]
        return out


def numbers_of(odds: Iterable[np.ndarray]) -> np.ndarray:
    """Four numbers a document: its two largest log-odds, the log of the expected toxic words, and their share."""
    rows = []
    for z in odds:
        top = np.sort(z)[::-1][:2] if len(z) < 64 else np.sort(np.partition(z, len(z) - 2)[-2:])[::-1]
        first, second = (*np.clip(top, -8, 8), -8.0, -8.0)[:2]
        sure = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        expected = float(sure[sure > 0.1].sum())
        rows.append((first, second, np.log1p(expected), expected / max(1, len(z)) * 20))
    return np.array(rows, np.float64).reshape(len(rows), 4)


def spans(text: str, odds: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the words more likely toxic than not."""
    if not len(odds) or odds.max() <= 0:
        return []
    return [m.span() for m, z in zip(_WORD.finditer(text), odds) if z > 0]


# --- training -----------------------------------------------------------------------------------------

class Words:
    """Numbered words and the hashes of their features, as flat arrays."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        self.docs = [np.array([number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())], np.int32) for t in texts]
        sizes = np.zeros(len(number) + 1, np.int64)
        flat = array("L" if array("L").itemsize == 4 else "I")
        for i, word in enumerate(number):
            found = [zlib.crc32(f.encode("utf-8", "replace")) for f in features(word)]
            flat.extend(found)
            sizes[i + 1] = len(found)
        self.flat, self.starts = np.frombuffer(flat, np.uint32).astype(np.int64), np.cumsum(sizes)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words, and the hash, of every feature of the words."""
        sizes = self.starts[words + 1] - self.starts[words]
        owner = np.repeat(np.arange(len(words)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[words], sizes)
        return owner, self.flat[at]


def _fit(model: Field, rows: list[np.ndarray], owner: np.ndarray, weight_at: np.ndarray, tags: list[np.ndarray]) -> None:
    """Adam on the log-likelihood of the tags; rows hold word types, whose features are (owner, weight) pairs."""
    times, many, kinds = SPAN, len(rows), int(owner[-1]) + 1
    lengths = np.array([len(r) for r in rows])
    inside = np.arange(times)[:, None] < lengths
    word = np.zeros((times, many), np.int64)
    tag = np.zeros((times, many))
    for k, (r, y) in enumerate(zip(rows, tags)):
        word[:len(r), k], tag[:len(r), k] = r, y
    used, place = np.unique(weight_at, return_inverse=True)
    x = np.concatenate([model.weights[used], [model.bias, model.start], model.moves.ravel()])
    m, v = np.zeros_like(x), np.zeros_like(x)
    n = len(used)
    total = inside.sum()
    pairs = inside[1:]
    y_from, y_to = tag[:-1], tag[1:]
    observed = np.array([[((y_from == i) & (y_to == j) & pairs).sum() for j in (0, 1)] for i in (0, 1)], float)
    for step in range(1, STEPS + 1):
        a = x[n + 2:].reshape(2, 2)
        emission = (np.bincount(owner, x[place], kinds) + x[n])[word]
        z, before, behind = marginals(emission, lengths, x[n + 1], a)
        p = np.where(inside, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        wrong = np.where(inside, tag - p, 0.0)
        by_type = np.bincount(word.ravel(), wrong.ravel(), kinds)
        r, s = before[:-1] + emission[:-1], emission[1:] + behind[1:]
        joint = np.stack([[a[i, j] + i * r + j * s for j in (0, 1)] for i in (0, 1)])
        joint = np.exp(joint - joint.max(axis=(0, 1)))
        joint = np.where(pairs, joint / joint.sum(axis=(0, 1)), 0.0)
        slope = np.concatenate([np.bincount(place, by_type[owner], n), [wrong.sum(), wrong[0].sum()], (observed - joint.sum(axis=(2, 3))).ravel()])
        slope = slope / total - RIDGE * np.r_[x[:n], np.zeros(6)]
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope ** 2
        x = x + 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    model.weights[used], model.bias, model.start, model.moves = x[:n], x[n], x[n + 1], x[n + 2:].reshape(2, 2)


def _seeds(words: Words, chosen: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each word the largest log-odds of a feature that toxic documents hold and clean ones hold less; 0 below ``SEED_ODDS``."""
    held = np.zeros((2, SEED_FEATURES), np.int32)
    for i in chosen:
        _, found = words.of(np.unique(words.docs[i]))
        held[int(labels[i]), np.unique(found % SEED_FEATURES)] += 1
    many = np.array([(labels[chosen] == k).sum() + 1 for k in (0, 1)])
    odds = np.log((held[1] + 0.2) / many[1]) - np.log((held[0] + 0.2) / many[0])
    odds[(held[1] < SEED_DOCS) | (odds < SEED_ODDS)] = 0
    return np.maximum.reduceat(odds[words.flat % SEED_FEATURES], words.starts[:-1]) if len(words.flat) else np.zeros(0)


def learn(texts: list[str], labels: np.ndarray) -> Field:
    """A field from document labels."""
    model = Field(share=float(labels.mean()) if len(labels) else 0.0)
    if not len(labels) or labels.min() == labels.max():
        return model
    fit = np.array([zlib.crc32(str(i).encode()) % 4 != 0 for i in range(len(texts))])
    if len(set(labels[fit])) < 2 or len(set(labels[~fit])) < 2:
        fit[:] = True
    words = Words([t if f else "" for t, f in zip(texts, fit)])
    chosen = np.flatnonzero(fit)
    seeded = _seeds(words, chosen, labels)
    pieces = []
    for i in chosen:
        doc = words.docs[i]
        # a toxic document's strongest words are seeds; weak ones next to strong ones are left to the field
        top = max(SEED_ODDS, 0.8 * seeded[doc].max()) if labels[i] and len(doc) else np.inf
        for k in range(0, len(doc), SPAN):
            tags = seeded[doc[k:k + SPAN]] >= top
            pieces.append((not tags.any(), zlib.crc32(f"{i}:{k}".encode()), i, doc[k:k + SPAN], tags.astype(float)))
    pieces.sort(key=lambda p: p[:2])
    pieces = pieces[:TRAIN_WORDS // SPAN]
    if pieces:
        kinds, flat = np.unique(np.concatenate([p[3] for p in pieces]), return_inverse=True)
        rows = np.split(flat, np.cumsum([len(p[3]) for p in pieces])[:-1])
        owner, hashes = words.of(kinds)
        weight_at = hashes % WEIGHTS
        tags = [p[4] for p in pieces]
        for turn in range(ROUNDS):
            _fit(model, rows, owner, weight_at, tags)
            if turn + 1 < ROUNDS:
                known = np.bincount(owner, model.weights[weight_at], len(kinds)) + model.bias
                for k, (piece, r) in enumerate(zip(pieces, rows)):
                    if labels[piece[2]]:
                        z, _, _ = marginals(known[r][:, None], np.array([len(r)]), model.start, model.moves)
                        tags[k] = (z[:, 0] > 0).astype(float)
    del words, pieces
    rest = ~fit if not fit.all() else fit
    numbers = numbers_of(Tagger(model).odds([texts[i] for i in np.flatnonzero(rest)]))
    model.score = logistic(numbers, labels[rest].astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Intercept and weights by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, x.T @ (y - p) - ridge * w)
    return w


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", n: int = 4, rest: int = 2, rows: int = SAMPLE) -> Field:
    """A field from a sample of at most ``rows`` labelled documents, which the driver reads."""
    found = labelled_sample(docs, labels, column, n, rest, rows).toPandas()
    found = found.sort_values("doc_id")
    texts, tags = found["text"].tolist(), found["label"].to_numpy()
    del found
    return learn(texts, tags)


# --- application --------------------------------------------------------------------------------------

def scored(docs: DataFrame, model: Field, n: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans (start, end in code points) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in in_slices(batches, 4000):
            texts = batch.column(2).to_pylist()
            numbers, found = [], []
            for text, odds in zip(texts, tagger.odds(texts)):
                numbers.append(numbers_of([odds]))
                found.append([{"start": a, "end": b} for a, b in spans(text or "", odds)])
            scores = shared.value.document_scores(np.concatenate(numbers)) if numbers else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(found, kind)],
                names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select("doc_id", held_out(n, rest).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint>>")


def without_toxic(docs: DataFrame, model: Field) -> DataFrame:
    """The rows whose text scores below the threshold, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in in_slices(batches, 4000):
            numbers = [numbers_of([odds]) for odds in tagger.odds(batch.column(place).to_pylist())]
            keep = shared.value.document_scores(np.concatenate(numbers)) < THRESHOLD if numbers else np.zeros(0, bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
