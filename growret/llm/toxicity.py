"""Operator 8, toxicity by a classifier chain.

The categories are predicted one after another.  Each has a logistic model on
word features, and every later model also gets the logits of all earlier ones.
While the chain is trained, those come from out-of-fold predictions: a row's
earlier probability is given by models that never saw the row, so later models
learn from inputs as uncertain as they will be in use.  The final models are
fitted on all rows of the sample, and each category's cut-off is the one with
the best F1 on its out-of-fold probabilities.

Features of a text are the presence of lower-cased words and of their first 4,
5 and 6 bytes (endings vary more than stems).  A feature enters a model if it
is in ``MIN_ROWS`` sample rows and its log-odds differ from zero by ``Z``
standard errors; that keeps a long text from adding up noise.

The models are fitted on a bounded sample: the ``sample`` labelled rows (8000)
with the smallest hash of doc_id.  Scoring covers every whole text.

Defined results: a null or empty text has no features and gets the base rate;
rows without doc_id are scored like others but cannot be labelled; labels that
are null count as unlabelled, repeated labels of a document as one (its
largest), and of rows that share an id one is learned from (the largest text); with no labelled rows, or one class only, the probability is the
base rate (0 without rows) and nothing is rejected; a column of the input that
has the name of a result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growret.llm.arrays import U64, Words, slices

SAMPLE = 8000
FOLDS = 4
MIN_ROWS = 5
Z = 3.5
PREFIXES = (4, 5, 6)


@dataclass
class Linear:
    features: np.ndarray  # sorted 32-bit hashes
    weights: np.ndarray
    bias: float
    chained: np.ndarray  # a weight for the logit of each earlier category
    cut: float = 0.5


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 32-bit feature of each word and word prefix (rows may repeat a feature)."""
    words = Words(texts, fold_case=True, punctuation=False)
    row = np.repeat(np.arange(len(texts)), words.count())
    rows, found = [row], [words.hash]
    for n in PREFIXES:
        longer = words.end - words.start > n
        at = words.start[longer]
        rows.append(row[longer])
        found.append(words.spans(at, at + n) ^ U64(n << 32))
    return np.concatenate(rows), (np.concatenate(found) >> U64(32)).astype(np.uint32)


def _distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(rows.astype(U64) << U64(32) | features)
    return (key >> U64(32)).astype(np.int64), key.astype(np.uint32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Sample:
    """Labelled rows as (row, feature) pairs, features numbered within ``names``."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int) -> None:
        self.names, self.feature = np.unique(feature, return_inverse=True)
        self.row, self.n = row, n

    def fit(self, y: np.ndarray, earlier: np.ndarray, use: np.ndarray, steps: int = 300, ridge: float = 1.0) -> Linear:
        """Logistic regression on the rows ``use``; Nesterov steps with a diagonal scale."""
        base = float(y[use].mean()) if use.any() else 0.0
        constant = Linear(self.names[:0], np.zeros(0), float(_logit(base)), np.zeros(earlier.shape[1]))
        if base in (0.0, 1.0):
            return constant
        keep = use[self.row]
        row, feature = self.row[keep], self.feature[keep]
        pos = np.bincount(feature, weights=y[row], minlength=len(self.names))
        neg = np.bincount(feature, minlength=len(self.names)) - pos
        n1, n0 = y[use].sum(), use.sum() - y[use].sum()
        a, b, c, d = pos + 0.5, neg + 0.5, n1 - pos + 0.5, n0 - neg + 0.5
        z = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        chosen = np.flatnonzero((np.abs(z) >= Z) & (pos + neg >= MIN_ROWS))
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        inside = place[feature] >= 0
        row, col = row[inside], place[feature[inside]]
        m, k = len(chosen), earlier.shape[1]
        used = use.astype(float)
        scale = 1 / (0.25 * np.bincount(col, minlength=m) + ridge) if m else np.zeros(0)
        scale_e = 1 / (0.25 * (used[:, None] * earlier**2).sum(axis=0) + ridge)
        w, e, bias = np.zeros(m), np.zeros(k), float(_logit(base))
        vw, ve, vb, rate = w, e, bias, 0.3
        for step in range(1, steps + 1):
            margin = np.bincount(row, weights=vw[col], minlength=self.n) + earlier @ ve + vb
            error = (_sigmoid(margin) - y) * used
            gw = np.bincount(col, weights=error[row], minlength=m) + ridge * vw
            nw = vw - rate * np.clip(scale * gw, -1, 1)
            ne = ve - rate * np.clip(scale_e * (earlier.T @ error + ridge * ve), -1, 1)
            nb = vb - rate * np.clip(4 * error.sum() / used.sum(), -1, 1)
            t = 0.8 * (step - 1) / (step + 2)
            vw, ve, vb = nw + t * (nw - w), ne + t * (ne - e), nb + t * (nb - bias)
            w, e, bias = nw, ne, nb
        return Linear(self.names[chosen], w, float(bias), e)

    def margins(self, model: Linear, earlier: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, model.features)
        weight = np.zeros(len(self.names))
        weight[at] = model.weights
        return np.bincount(self.row, weights=weight[self.feature], minlength=self.n) + earlier @ model.chained + model.bias


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability with the best F1: half way, in logits, between the last taken and the first left out."""
    if not len(y) or y.min() == y.max():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1
    k = int(np.argmax(f1))
    return float(_sigmoid((_logit(p[order[k]]) + _logit(p[order[k + 1]] if k + 1 < len(y) else 0.0)) / 2))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> dict[str, Linear]:
    """A model per category, in order.  ``categories`` names 0/1 columns over ``labels(doc_id, ...)``."""
    names = list(categories)
    rows = labels.select("doc_id", *[categories[c].cast("int").alias(f"y_{c}") for c in names]).dropna()
    rows = rows.groupBy("doc_id").agg(*[F.max(f"y_{c}").alias(f"y_{c}") for c in names])
    drawn = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most `sample` ids
    picked = picked.groupBy("doc_id", *[f"y_{c}" for c in names]).agg(F.max("text").alias("text"))  # and a row an id

    def features(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo, hi in slices(texts):
                row, found = _distinct(*text_features(texts.slice(lo, hi - lo)))
                edge = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [found[a:b].astype("<u4").tobytes() for a, b in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ["doc_id", *(f"y_{c}" for c in names)]), pa.array(packed, pa.binary())],
                    ["doc_id", *(f"y_{c}" for c in names), "f"],
                )

    schema = ", ".join(["doc_id long", *(f"y_{c} int" for c in names), "f binary"])
    got = picked.select("doc_id", "text", *[f"y_{c}" for c in names]).mapInArrow(features, schema).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("f", "ascending")])
    n = len(got)
    blobs = got["f"].to_pylist()
    sizes = np.array([len(b) // 4 for b in blobs], np.int64)
    data = Sample(np.repeat(np.arange(n), sizes), np.frombuffer(b"".join(blobs), "<u4").astype(np.uint32), n)
    fold = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in got["doc_id"].to_pylist()], np.int64)
    earlier, chain = np.zeros((n, 0)), {}
    for c in names:
        y = got[f"y_{c}"].to_numpy().astype(float)
        out = np.zeros(n)
        for f in range(FOLDS):
            held = fold == f
            if held.any():
                out[held] = data.margins(data.fit(y, earlier, ~held), earlier)[held]
        chain[c] = data.fit(y, earlier, np.ones(n, bool))
        chain[c].cut = best_cut(_sigmoid(out), y)
        earlier = np.column_stack([earlier, _logit(_sigmoid(out))])
    return chain


def score(docs: DataFrame, chain: dict[str, Linear]) -> DataFrame:
    """``docs`` with ``p_<category>`` and ``is_<category>`` for each category of the chain."""
    new = [f"{kind}_{c}" for c in chain for kind in ("p", "is")]
    docs = docs.drop(*new)
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.DoubleType() if n[:2] == "p_" else T.BooleanType()) for n in new])
    near = np.zeros(1 << 20, bool)  # low bits of the features that any model uses, to pass over all others
    for m in chain.values():
        near[m.features & np.uint32(0xFFFFF)] = True
    bits = np.packbits(near).tobytes()

    def probabilities(texts: pa.Array) -> np.ndarray:
        maybe = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        parts = []
        for lo, hi in slices(texts):
            row, found = text_features(texts.slice(lo, hi - lo))
            known = maybe[found & np.uint32(0xFFFFF)]
            row, found = _distinct(row[known], found[known])
            logits, probs = np.zeros((hi - lo, 0)), []
            for m in chain.values():
                margin = logits @ m.chained + m.bias
                if len(m.features):
                    at = np.minimum(np.searchsorted(m.features, found), len(m.features) - 1)
                    weight = np.where(m.features[at] == found, m.weights[at], 0.0)
                    margin = margin + np.bincount(row, weights=weight, minlength=hi - lo)
                p = _sigmoid(margin) if m.cut <= 1 or len(m.features) else _sigmoid(margin) * (m.bias > _logit(0.0))
                probs.append(p)
                logits = np.column_stack([logits, _logit(p)])
            parts.append(np.column_stack(probs))
        return np.concatenate(parts) if parts else np.zeros((0, len(chain)))

    def append(batches):
        for batch in batches:
            p = probabilities(batch.column("text"))
            extra = []
            for k, m in enumerate(chain.values()):
                extra += [pa.array(p[:, k]), pa.array(p[:, k] >= m.cut)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *new])

    return docs.mapInArrow(append, schema)


def corpus_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, Linear]:
    """The chain of the ``labels`` table: low quality first, toxicity after it."""
    return fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}, sample)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = corpus_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
