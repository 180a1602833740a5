"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Every text becomes a vector of transformed statistics (lengths, character classes, repetition, word shapes).
Each class gets a mean and a covariance, shrunk towards the pooled covariance and its diagonal; a text's
score is the difference of the two Mahalanobis log-densities, taken with Cholesky factors that are computed
once and kept with the model, passed through a logistic curve fitted on a histogram of those differences.

Moments, histogram and scores cover all rows; what reaches the driver has a fixed number of rows whatever
the input. Labels, ids, languages and sources are never inputs of a score.

Edge cases: a null text counts as empty; an empty text is scored like any other (its statistics are zero);
repeated rows get equal scores; an empty table gives an empty result; unlabelled rows are only scored; with
no label, or labels of one class, every score is the smoothed share of good labels. Other columns of the
input are ignored.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, texts

STATISTICS = [
    "log_bytes", "log_words", "word_mean", "word_sd", "upper", "digit", "punct", "bang", "symbol", "pipe", "space", "newline",
    "variety", "top_word", "line_repeat", "line_words", "sentence_words", "short_words", "symbol_words", "caps_words", "high_bytes", "entropy", "odd_space", "line_sd",
]
#: Mixture of class covariance, pooled covariance and diagonal.
POOLED, DIAGONAL = 0.1, 0.02
_BINS, _EDGE = 4000, 200.0


def statistics(data: bytes) -> list[float]:
    """Transformed statistics of one text's UTF-8 bytes, in the order of STATISTICS."""
    n = len(data)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    words = data.split()
    m = len(words)
    length = np.fromiter(map(len, words), float, m)
    letters = c[65:91].sum() + c[97:123].sum() + c[128:].sum()
    share = lambda x, of: math.sqrt(x / of) if of else 0.0
    punct = c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    per = np.array([x.count(b" ") + 1 for x in lines], float)
    p = c[c > 0] / n if n else c[:0]
    return [
        math.log1p(n), math.log1p(m), math.log1p(length.mean()) if m else 0.0, math.log1p(length.std()) if m else 0.0,
        share(c[65:91].sum(), letters), share(c[48:58].sum(), n), share(punct, n), share(c[33], n), share(c[35:39].sum() + c[42], n), share(c[124], n), share(c[32], n), share(c[10], n),
        math.log1p(len(seen)) / math.log1p(m) if m else 0.0, share(max(seen.values(), default=0), m), share(len(lines) - len(set(lines)), len(lines)), math.log1p(per.mean()) if len(lines) else 0.0,
        math.log1p(m / (1 + c[46])), share((length <= 3).sum(), m), share(sum(1 for x in words if x[-1] in b"#$%&*!|"), m), share(sum(map(bytes.isupper, words)), m), share(c[128:].sum(), n),
        float(-(p * np.log2(p)).sum()), share(data.count(b"  ") + c[9] + c[13], n), math.log1p(per.std()) if len(lines) else 0.0,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclasses.dataclass
class Model:
    """Means, inverse Cholesky factors and log-determinants by class, and the logistic curve."""

    mean: np.ndarray
    inverse_factor: np.ndarray
    log_det: np.ndarray
    slope: float
    offset: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        out = np.zeros(len(x))
        if len(x) and len(self.mean):
            for c, sign in ((0, -1), (1, 1)):
                z = (x - self.mean[c]) @ self.inverse_factor[c].T
                out += sign * -0.5 * ((z * z).sum(axis=1) + self.log_det[c])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -_EDGE, _EDGE) + self.offset, -30, 30)))


def labelled(feats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(y, x) of the rows whose label may be learnt from: labelled 0 or 1 and not held out."""
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    return feats.join(use, "doc_id").select("y", "x")


def fit_logistic(d: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1) by Newton steps on weighted points; slope at least 0, slightly smoothed."""
    s, o = 0.1, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(s * d + o, -30, 30)))
        g = (w1 * (1 - p) - w0 * p)
        h = (w0 + w1) * p * (1 - p)
        grad = np.array([(g * d).sum() - 1e-3 * s, g.sum() - 1e-3 * o])
        hess = np.array([[(h * d * d).sum() + 1e-3, (h * d).sum()], [(h * d).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        s, o = s + step[0], o + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(float(s), 1e-6), float(o)


def fit(train: DataFrame) -> Model:
    """The model of a table (y, x). Class sums are made on the executors; the driver gets a fixed number of rows."""
    k = len(STATISTICS)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {0: np.zeros(1 + k + k * k), 1: np.zeros(1 + k + k * k)}
        for b in batches:
            for y, rows in b.groupby("y"):
                x = np.stack(rows["x"].to_numpy())
                total[int(y)] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        for y, v in total.items():
            if v[0]:
                yield pd.DataFrame({"y": y, "i": np.arange(len(v)), "v": v})

    got = train.mapInPandas(moments, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((2, 1 + k + k * k))
    for r in got:
        m[r["y"], r["i"]] = r["v"]
    n = m[:, 0]
    prior = (n[1] + 1) / (n.sum() + 2)
    flat = Model(np.zeros((0, k)), np.zeros((0, k, k)), np.zeros(0), 0.0, float(np.log(prior / (1 - prior))))
    if n.min() < 2:
        return flat
    mean = m[:, 1 : 1 + k] / n[:, None]
    scatter = [m[c, 1 + k :].reshape(k, k) - n[c] * np.outer(mean[c], mean[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    factor, det = [], []
    for c in (0, 1):
        own = POOLED + k / (k + n[c])  # small classes lean on the pooled covariance
        own = min(own, 1.0)
        cov = (1 - own) * scatter[c] / n[c] + own * pooled
        cov = (1 - DIAGONAL) * cov + DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(k)
        chol = np.linalg.cholesky(cov)
        factor.append(np.linalg.inv(chol))
        det.append(2 * np.log(np.diag(chol)).sum())
    model = Model(mean, np.array(factor), np.array(det), 1.0, 0.0)

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = np.clip(model.difference(np.stack(b["x"].to_numpy())), -_EDGE, _EDGE)
                yield pd.DataFrame({"y": b["y"].to_numpy(), "i": ((d + _EDGE) / (2 * _EDGE) * _BINS).astype(int)})

    bins = train.mapInPandas(histogram, "y int, i int").groupBy("y", "i").count().collect()
    w = np.zeros((2, _BINS + 1))
    for r in bins:
        w[r["y"], r["i"]] = r["count"]
    model.slope, model.offset = fit_logistic((np.arange(_BINS + 1) + 0.5) / _BINS * 2 * _EDGE - _EDGE, w[0], w[1])
    return model


def score(feats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of a table of statistics."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(np.stack(b["x"].to_numpy()))})

    return feats.mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    feats = materialize(features(docs), "statistics")
    model = fit(labelled(feats, labels))
    return score(feats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    feats = materialize(features(docs.where(~held_out(F.col("doc_id")))), "statistics")
    model = fit(labelled(feats, labels))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        x = np.array([statistics((t or "").encode()) for t in text], float).reshape(len(text), len(STATISTICS))
        return pd.Series(model.score(x))

    return docs.where(scored(F.col("text")) >= threshold)
