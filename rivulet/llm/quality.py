"""Quality classification by a regularised quadratic discriminant (operator 2).

Document statistics are transformed (logarithms, logits) and modelled per class by a Gaussian whose covariance is shrunk
toward the pooled one and toward a sphere. A score is the calibrated difference of log densities; Mahalanobis
distances come from Cholesky factors that are computed once and shipped with the model.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import held_out, keep_rows, text_or_empty

#: Labelled rows (in hash order of the id) that a fit reads at most; the figures of a row are a few numbers.
FIT_ROWS = 40_000
#: Shrinkage toward the pooled covariance, toward a sphere.
POOLED, SPHERE = 0.1, 0.02
#: Scores from which a text counts as good.
THRESHOLD = 0.3

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
FEATURES = ("letters", "upper", "digits", "spaces", "enders", "odd", "word_bytes", "distinct", "top_word", "same_next", "line_words", "same_lines", "ended_lines", "spread")


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, with half an observation on both sides."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text; an empty text has those of no observations."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, high = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[128:].sum())
    letters, digits = upper + lower + high, int(counts[48:58].sum())
    spaces, enders = int(counts[32] + counts[9:14].sum()), int(counts[[33, 44, 46, 58, 59, 63]].sum())
    odd = len(data) - letters - digits - spaces - int(counts[[44, 46]].sum())
    words = data.split()
    n, seen = len(words), Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    # distinct words of a text grow as a power of its length
    return [
        _logit(letters, len(data)), _logit(upper, letters), _logit(digits, len(data)), _logit(spaces, len(data)), _logit(enders, n), _logit(odd, len(data)),
        float(np.log1p(lengths.mean())), float(np.log((len(seen) + 1) / (n + 1) ** 0.8)), _logit(max(seen.values(), default=0), n), _logit(repeats, n),
        float(np.log1p(n / max(len(lines), 1))), _logit(len(lines) - len(set(lines)), len(lines)), _logit(ended, len(lines)), float(np.log1p(lengths.std())),
    ]


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants, and the calibration of the log density difference."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _damped(self.difference(x)) + self.shift, -30, 30)))


def _damped(difference: np.ndarray) -> np.ndarray:
    """Far from both classes the densities' tails say little; the logarithm keeps the order."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant | None:
    """None if a class has no row: then nothing can be told."""
    if not (y == 1).any() or not (y == 0).any():
        return None
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    means = [g.mean(0) for g in groups]
    covs = [(g - m).T @ (g - m) / max(len(g), 1) for g, m in zip(groups, means, strict=True)]
    shared = sum(len(g) * c for g, c in zip(groups, covs, strict=True)) / len(z)
    factors, dets = [], []
    for c in covs:
        c = (1 - pooled) * c + pooled * shared
        c = (1 - sphere) * c + sphere * (np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(float(np.log(np.diag(low)).sum()))
    model = Discriminant(centre, scale, means, factors, dets)
    model.slope, model.shift = _calibrate(_damped(model.difference(x)), y)
    return model


def _calibrate(d: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on the damped difference, with a small ridge, by damped Newton steps."""
    w = np.array([1.0, 0.0])
    a = np.stack([d, np.ones_like(d)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + 1e-3 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = FIT_ROWS) -> Discriminant | None:
    """Fits on labelled documents outside the held-out fifth, at most ``max_rows`` ids in the order of their hash and, where ids repeat, 2 * ``max_rows`` rows in that of id and text.

    Rows without an id or a 0/1 label are not labelled; several labels of an id count as their rounded mean. The chosen
    labels have that bound, so they are broadcast; the statistics of their documents are all that reaches the driver.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("y"))
    chosen = chosen.where(~held_out("doc_id", 5, 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"key": rows.key, "y": rows.y, "stats": [statistics(t) for t in rows.text]})

    keyed = rows.select(F.xxhash64("doc_id", "text").alias("key"), "text", "y")
    fitted = keyed.mapInPandas(run, "key long, y int, stats array<double>").orderBy("key", "y").limit(2 * max_rows).toPandas()
    return fit(np.array(fitted.stats.tolist()), fitted.y.to_numpy()) if len(fitted) else None


def score_texts(model: Discriminant | None, texts: list[str]) -> np.ndarray:
    """Probabilities of label 1; 0.5 without a model."""
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    return model.score(np.array([statistics(t) for t in texts]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (probability of label 1) and predicted (1 if score >= THRESHOLD), of every whole text.

    Labels, languages, sources and ids are no inputs of a score, so equal texts score alike. Null ids stay null, a null
    text counts as empty, repeated rows stay, an empty table gives no rows; other columns are not read, nothing is shuffled.
    """
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows.doc_id, "score": score_texts(model, rows.text.tolist())})

    scored = rows.mapInPandas(run, "doc_id string, score double")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is predicted to be good."""
    model = train(docs, labels, id_col, text_col)
    return keep_rows(docs, text_col, lambda: lambda texts: score_texts(model, texts) >= THRESHOLD)
