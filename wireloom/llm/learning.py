"""Small linear models, fitted on bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def adam(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Minimises by Adam with full gradients: the same result every time."""
    w, m, v = start.astype(float), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def bounded_sample(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About `most` rows of rows, or all if there are no more: those whose hashed key is low enough. A rerun gives the same."""
    n = rows.count()
    return rows if n <= most else rows.where(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("sample")), 11) < int(most / n * (1 << 53)))


def summed(rows: DataFrame, kernel: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of the vectors of `width` that kernel makes of batches: each task adds up its own, Spark those of the tasks, the driver gets one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += kernel(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["k", "v"])

    out = np.zeros(width)
    for r in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out


class SparseRows:
    """Rows of feature places with value 1, and dense columns beside them."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, width: int) -> None:
        self.n, self.width, self.dense = len(rows), width, dense
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def with_column(self, values: np.ndarray) -> SparseRows:
        more = SparseRows([], np.column_stack((self.dense, values)), self.width)
        more.n, more.col, more.row = self.n, self.col, self.row
        return more

    def only(self, allowed: np.ndarray) -> SparseRows:
        """The rows without the features that are not allowed, in the same places."""
        less = SparseRows([], self.dense, self.width)
        keep = allowed[self.col]
        less.n, less.col, less.row = self.n, self.col[keep], self.row[keep]
        return less

    def scores(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.row, w[self.col], self.n) if len(self.col) else np.zeros(self.n)
        return z + self.dense @ w[self.width : -1] + w[-1]

    def fit(self, y: np.ndarray, use: np.ndarray, l2: float = 1e-3, steps: int = 200, rate: float = 0.1) -> np.ndarray:
        """Weights of a logistic model of y on the rows where use > 0, weighted by it."""
        share = use / max(use.sum(), 1e-9)

        def gradient(w: np.ndarray) -> np.ndarray:
            e = share * (sigmoid(self.scores(w)) - y)
            g = np.concatenate((np.bincount(self.col, e[self.row], self.width) if len(self.col) else np.zeros(self.width), e @ self.dense, [e.sum()]))
            g[:-1] += l2 * w[:-1]
            return g

        return adam(gradient, np.zeros(self.width + self.dense.shape[1] + 1), steps, rate)
