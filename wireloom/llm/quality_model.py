"""Operator 6, a quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; the unlabelled class is web text as it comes, all of it. With the class prior p,
the non-negative unbiased risk is p E+[l(f, 1)] + max(0, E_u[l(f, 0)] - p E+[l(f, 0)]), with logistic loss l and f linear in
statistics of the text. p is estimated from positives and unlabelled text alone: no set of texts can hold a smaller
share of the unlabelled than p times its share of the positives, so the least ratio of the two, over the sets that a
first model scores highest, bounds p.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fold_of, read, written
from .learning import bounded_sample, sigmoid, summed

#: Labelled positives that the model is fitted on, at most (about).
MAX_ROWS = 12_000
#: Passes over the unlabelled statistics of one fit, at most.
PASSES = 12
#: Parts of the trusted positives' scores at which the prior is read off.
STEPS = 50
THRESHOLD = 0.7
N_FEATURES = 14
BYTE_CLASSES = np.zeros((256, 6))
for _c in range(256):
    _ch = chr(_c)
    BYTE_CLASSES[_c] = [97 <= _c <= 122, 65 <= _c <= 90, 48 <= _c <= 57, _ch in "#*$%&|<>@^~=+\\{}[]_", _ch in "!?", 128 <= _c]


def statistics(text: bytes | None) -> list[float]:
    """Shares of kinds of bytes, of repeated words and lines, and lengths, of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (N_FEATURES - 1) + [1.0]
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ BYTE_CLASSES
    letters = max(kinds[0] + kinds[1] + kinds[5], 1.0)
    marked = sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    signs = sum(1 for w in words if len(w) == 1 and not w.isalnum()) / n
    shouted = sum(1 for w in words if len(w) > 1 and w.isupper()) / n
    return [
        kinds[0] / marked, kinds[1] / letters, kinds[2] / marked, min(kinds[3] / marked, 0.5), min(kinds[4] / marked, 0.5), kinds[5] / marked,
        len(set(words)) / n, again, shouted, 1 - len(set(lines)) / len(lines), min(np.log1p(n), 12.0), min(marked / n, 30.0), np.log1p(n / len(lines)), signs,
    ]


class QualityModel:
    """Weights over standardised statistics and their squares."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> None:
        self.mean, self.sd, self.w = mean, sd, w

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.column_stack((z, z * z, np.ones(len(z))))

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.expand(x) @ self.w) if len(x) else np.zeros(0)


def matrix(column: pa.Array) -> np.ndarray:
    """The statistics of a batch, a row each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the statistics x over all rows."""

    def kernel(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0))
        return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0)))

    n, *sums = summed(rows.select("x"), kernel, 1 + 2 * N_FEATURES)
    first, second = np.array(sums).reshape(2, -1) / max(n, 1)
    return first, np.sqrt(np.maximum(second - first * first, 1e-6))


def fit_nnpu(positive: np.ndarray, unlabelled: DataFrame, model: QualityModel, prior: float, l2: float = 1e-4, passes: int = PASSES) -> QualityModel:
    """The minimum of the non-negative risk over positives and all unlabelled rows (x), by Newton steps; each is one pass over the rows.

    The loss of a positive less that of it as a negative is -f, so that the risk is E_u[l(f, 0)] - p E+[f] and convex while the
    estimated negative risk is not below 0; where a step makes it so, or the risk rises, half of the step is taken back.
    """
    width = 2 * N_FEATURES + 1
    if not len(positive):
        return QualityModel(model.mean, model.sd, np.zeros(width))
    xp, ridge = model.expand(positive), l2 * np.append(np.ones(width - 1), 0)
    now = before = np.zeros(width)
    least = np.inf

    for _ in range(passes):

        def kernel(b: pa.RecordBatch, w: np.ndarray = now) -> np.ndarray:
            x = model.expand(matrix(b.column(0)))
            p = sigmoid(x @ w)
            return np.concatenate(([len(x), np.logaddexp(0, x @ w).sum()], x.T @ p, (x.T @ (x * (p * (1 - p))[:, None])).ravel()))

        n, loss, *rest = summed(unlabelled.select("x"), kernel, 2 + width + width * width)
        if not n:
            break
        slope, bend = np.array(rest[:width]) / n, np.array(rest[width:]).reshape(width, width) / n
        risk = loss / n - prior * (xp @ now).mean() + 0.5 * (ridge * now) @ now
        if loss / n < prior * np.logaddexp(0, xp @ now).mean() or risk > least + 1e-9:
            now = (now + before) / 2
            continue
        step = np.linalg.solve(bend + np.diag(ridge + 1e-6), slope - prior * xp.mean(axis=0) + ridge * now)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        before, least, now = now, risk, now - step
        if np.abs(step).max() < 1e-4:
            break
    return QualityModel(model.mean, model.sd, now)


def estimated_prior(positive: np.ndarray, unlabelled: DataFrame, model: QualityModel) -> float:
    """The class prior from positives that the model has not seen and all unlabelled rows: the least ratio of their shares above a score, with room for chance in both."""
    if not len(positive):
        return 0.5
    at = np.unique(np.quantile(model.score(positive), np.linspace(0, 0.95, STEPS)))

    def kernel(b: pa.RecordBatch) -> np.ndarray:
        score = np.sort(model.score(matrix(b.column(0))))
        return np.append(len(score) - np.searchsorted(score, at, side="left"), len(score)).astype(float)

    *above, n = summed(unlabelled.select("x"), kernel, len(at) + 1)
    if not n:
        return 0.5
    own = np.sort(model.score(positive))
    share = 1 - np.searchsorted(own, at, side="left") / len(own)
    ratio = (np.array(above) / n + 1 / np.sqrt(n)) / np.maximum(share - 0.5 / np.sqrt(len(own)), 1e-6)
    return float(np.clip(ratio[share > 1 / np.sqrt(len(own))].min(initial=1.0), 0.01, 0.99))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and x, the statistics of each whole text."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))]

    return append_columns(docs, ["text"], [T.StructField("x", T.ArrayType(T.DoubleType()))], kernel, keep)


def learn_quality(rows: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Fits on at most about max_rows trusted positives and all rows (doc_id, x: statistics); labels: doc_id, quality.

    Of the labels only those of 1 are used, each id once. Half of the positives fit the first model, the other half reads the
    prior off it. Without positives or rows the model scores 1/2.
    """
    per_id = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    trusted = bounded_sample(per_id.where("quality = 1"), max_rows).select("doc_id")
    # the sample's size is bounded, so it may go to all executors; rows that repeat an id give one positive
    got = rows.join(F.broadcast(trusted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id")).collect()
    xp = np.array([r.x for r in got], np.float64).reshape(-1, N_FEATURES)
    model = QualityModel(*moments(rows), np.zeros(2 * N_FEATURES + 1))
    first = fit_nnpu(xp[::2], rows, model, 0.5)
    return fit_nnpu(xp, rows, model, estimated_prior(xp[1::2], rows, first))


def with_quality(rows: DataFrame, model: QualityModel, keep: list[str], out: str = "score") -> DataFrame:
    """The columns `keep` of rows (with x: statistics) and the model's score; null and empty texts are scored as empty."""

    def kernel(x: pa.Array) -> list[pa.Array]:
        return [pa.array(model.score(matrix(x)))]

    return append_columns(rows, ["x"], [T.StructField(out, T.DoubleType())], kernel, keep)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. Texts are read once, for their statistics."""
    rows = written(with_statistics(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]), "quality")
    fold = fold_of(F.col("doc_id"), 4)
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(fold != 2)
    model = learn_quality(rows.where(fold != 2), labels)
    held = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    return with_quality(rows, model, ["doc_id"]).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
