"""Toxicity by a classifier chain.

There is one human label, `toxic`. Two kinds of toxic texts are told apart by the features that tell: the toxic rows of the sample fall into two
clusters by their telling features, and a row is of kind 1 or 2 if it is labelled toxic and falls into that cluster. No word is known
beforehand. The categories are predicted one after the other, `kind1`, `kind2`, `toxic`, each by a logistic model over the presence of features
that is also fed the probabilities of the earlier categories. In training these are out-of-fold: a row's probability comes from a model that hasn't
seen the row, as it will be in use. The flag's threshold is the one that parts the sample best by the out-of-fold probabilities of `toxic`.

Features are words and their first four, five and six characters, so that forms of one stem in any language are learned together. A model looks at
those that tell the classes apart best. They must stand in some number of rows, whatever part of the rows that is.

The models are fitted on a bounded sample of labelled rows, `train_rows` (default 12,000) by a hash of the id. All rows are
scored, each by its whole text.

Edge cases: null and empty texts get the rate that the models give to a text without words, and aren't flagged. Where a row has several
labels, one toxic label counts. Rows without a label aren't learned from. With no label of some kind, or no feature that
tells, the probability is constant and nothing is flagged on it. Rows may repeat; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, thrifty

WORD = re.compile(r"\w+")
CATEGORIES = ("kind1", "kind2", "toxic")
#: First characters of a word that are features of their own.
STEMS = (4, 5, 6)
BUCKETS = 1 << 20
FOLDS = 5
#: Features that one model looks at, those that tell the classes apart best; in how many rows each must stand at least. Rows are distinct
#: texts, so a word of one text and its copies isn't seen often. Toxic words may be rare: no part of the rows is asked for.
FEATURES, SEEN = 1024, 4
#: Standard deviations by which a feature's rows must differ from chance; of a million buckets few reach it by accident.
TELLING = 5.0
#: Words that are remembered, and their most characters.
MEMO, LONGEST = 100_000, 64


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def features_of(word: str) -> list[int]:
    """The word, and its beginnings, each marked so that it is not taken for a word."""
    return [bucket(word), *(bucket("^" + word[:n]) for n in STEMS if len(word) > n)]


def buckets_of(text: str | None) -> np.ndarray:
    return np.unique(np.array([x for w in set(WORD.findall((text or "").lower())) for x in features_of(w)], np.int64))


@dataclass
class Linear:
    """A logistic model: words' weights, those of earlier categories' log odds, and the intercept."""

    words: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def margin(self, docs: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        dense = np.zeros(BUCKETS, np.float32)
        dense[self.words] = self.weights
        return np.array([dense[d].sum() for d in docs]) + earlier @ self.earlier + self.intercept


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(flat: np.ndarray, y: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The features whose rows differ most from chance, sorted. flat: features of all rows; owner: which row each is of."""
    rate = y.mean()
    seen = np.bincount(flat, minlength=BUCKETS)
    hits = np.bincount(flat, weights=y[owner], minlength=BUCKETS)
    expect = seen * rate
    z = np.where(seen >= SEEN, np.abs(hits - expect) / np.sqrt(expect * (1 - rate) + 1), 0)
    words = np.flatnonzero(z >= TELLING)
    return np.sort(words[np.argsort(-z[words], kind="stable")][:FEATURES])


def kinds(docs: list[np.ndarray], toxic: np.ndarray, steps: int = 20) -> np.ndarray:
    """A column for each of two clusters of the toxic rows: the row is toxic and lies in it. Rows are compared by the cosine of their telling
    features; the clusters begin with the two features that most rows hold without the other."""
    out = np.zeros((len(docs), 2), bool)
    if not toxic.any() or toxic.all():
        return out
    flat = np.concatenate([*docs, np.zeros(0, np.int64)])
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    words = telling(flat, toxic.astype(np.float64), owner)
    rows = np.flatnonzero(toxic)
    x = np.array([np.isin(words, docs[i], assume_unique=True) for i in rows], np.float32).reshape(len(rows), len(words))
    # Features that stand in the other rows rather than in these tell nothing about kinds.
    x = x[:, x.sum(axis=0) * len(docs) > np.bincount(flat, minlength=BUCKETS)[words] * len(rows)]
    if not x.shape[1]:
        return out
    apart = (x.T @ (1 - x)) * ((1 - x).T @ x)
    centres = x[:, list(np.unravel_index(int(np.argmax(apart)), apart.shape))].T @ x
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    for _ in range(steps):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        own = (x @ centres.T).argmax(axis=1)
        centres = np.stack([x[own == k].sum(axis=0) for k in range(2)])
    out[rows, own] = True
    return out


def fit(docs: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 200) -> Linear:
    rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
    none = Linear(np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    if not len(y) or y.min() == y.max():
        return none
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    words = telling(flat, y, owner)
    place = np.full(BUCKETS, -1)
    place[words] = np.arange(len(words))
    x = np.zeros((len(docs), len(words) + earlier.shape[1]), np.float32)
    own = place[flat] >= 0
    x[owner[own], place[flat[own]]] = 1
    x[:, len(words) :] = earlier
    w, b = np.zeros(x.shape[1], np.float32), none.intercept
    # Accelerated gradient steps; the step comes from a bound of the curvature.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(15):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) + 1e-12
    curve = float(np.linalg.norm(x @ v) ** 2) / 4 + l2 + len(y) / 4
    w0, b0 = w, b
    for k in range(steps):
        m = k / (k + 3)
        wy, by = (w + m * (w - w0)).astype(np.float32), b + m * (b - b0)
        g = (sigmoid(x @ wy + np.float32(by)) - y).astype(np.float32)  # x isn't widened
        w0, b0 = w, b
        w, b = (wy - (x.T @ g + l2 * wy) / curve).astype(np.float32), by - float(g.sum()) / curve
    return Linear(words, w[: len(words)], w[len(words) :].astype(np.float64), float(b))


@dataclass
class Chain:
    models: list[Linear] = field(default_factory=list)
    #: The last category is flagged from here on.
    threshold: float = 0.5

    def probabilities(self, docs: list[np.ndarray]) -> np.ndarray:
        earlier = np.zeros((len(docs), 0))
        for model in self.models:
            earlier = np.column_stack([earlier, model.margin(docs, earlier[:, : len(model.earlier)])])
            earlier[:, -1] = logit(sigmoid(earlier[:, -1]))
        return sigmoid(earlier)


def fit_chain(docs: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> Chain:
    """labels: a column for each category, in the chain's order; fold: of each row."""
    chain, earlier, told = Chain(), np.zeros((len(docs), 0)), np.zeros(len(docs), bool)
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float64)
        unseen = np.zeros(len(docs))
        for f in range(FOLDS):
            own = np.flatnonzero(fold != f)
            model = fit([docs[i] for i in own], earlier[own], y[own])
            rest = np.flatnonzero(fold == f)
            unseen[rest] = model.margin([docs[i] for i in rest], earlier[rest])
            told[rest] |= len(model.words) > 0
        chain.models.append(fit(docs, earlier, y))
        earlier = np.column_stack([earlier, logit(sigmoid(unseen))])
    # Models without words give constants, of which none parts anything.
    if not any(len(m.words) for m in chain.models):
        chain.threshold = np.inf
    elif 0 < y[told].sum() < told.sum():
        chain.threshold = best_cut(sigmoid(earlier[told, -1]), y[told])
    return chain


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts rows best, by F1, half way to the next lower one; of equals the highest."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal probabilities aren't parted
    at = int(np.argmax(f1))
    return float((p[at] + p[min(at + 1, len(p) - 1)]) / 2)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).to_pylist()
        words = [buckets_of(t).astype("<i4").tobytes() for t in texts]
        digests = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), b.column(2), pa.array(digests, pa.binary())], ["id", "words", "toxic", "digest"])


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = 12_000) -> Chain:
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull())
    known = known.groupBy(known[id_col].alias("id")).agg(F.max(known[label_col].cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    d = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(chosen), "id")  # train_rows rows
    found = d.select("id", "text", "toxic").mapInArrow(_sample, "id long, words binary, toxic int, digest binary").collect()
    # Copies of a text would count its words again and again: of equal texts the smallest id is learned from.
    first: dict[bytes, int] = {}
    rows = []
    for r in sorted(found, key=lambda r: r.id):
        if first.setdefault(bytes(r.digest), r.id) == r.id:
            rows.append((r.id, r.toxic, bytes(r.words)))
    docs = [np.frombuffer(w, "<i4").astype(np.int64) for _, _, w in rows]
    toxic = np.array([t > 0 for _, t, _ in rows], bool)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i, _, _ in rows], np.int64)
    return fit_chain(docs, np.column_stack([kinds(docs, toxic), toxic]), fold)


class Scorer:
    """The chain over words: a row of weights, one for each model, for each feature that some model looks at."""

    def __init__(self, chain: Chain):
        self.chain = chain
        words = np.unique(np.concatenate([m.words for m in chain.models])) if chain.models else np.zeros(0, np.int64)
        self.table = np.zeros((len(words), len(chain.models)))
        for k, m in enumerate(chain.models):
            self.table[np.searchsorted(words, m.words), k] = m.weights
        self.row = {int(w): i for i, w in enumerate(words)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def sums(self, text: str | None) -> np.ndarray:
        memo, row = self.memo, self.row
        rows: set[int] = set()
        for w in set(WORD.findall((text or "").lower())):
            r = memo.get(w)
            if r is None:
                r = tuple(row[x] for x in features_of(w) if x in row)
                if len(w) <= LONGEST:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = r
            if r:
                rows.update(r)
        return self.table[sorted(rows)].sum(axis=0)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        sums = np.array([self.sums(t) for t in texts]).reshape(len(texts), len(self.chain.models))
        earlier = np.zeros((len(texts), 0))
        for k, m in enumerate(self.chain.models):
            margin = sums[:, k] + earlier @ m.earlier + m.intercept
            earlier = np.column_stack([earlier, logit(sigmoid(margin))])
        return sigmoid(earlier)


def score(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """doc_id, p_kind1, p_kind2, p_toxic, toxic: one row for each row of df."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(chain)  # FEATURES a category
    cut = chain.threshold if threshold is None else threshold
    names = ["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(held.value)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                p = s.probabilities(texts)
                flag = np.array([bool(t) for t in texts], bool) & (p[:, -1] >= cut)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(flag)], names)

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + ", toxic boolean"
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(thrifty(run), schema)


def learn_and_score(df: DataFrame, labels: DataFrame) -> DataFrame:
    return score(df, learn(df, labels))
