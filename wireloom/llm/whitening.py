"""Operator 11, embedding whitening by a residue-number scatter.

Vectors become integer points. The scatter of the different points about their mean is an integer matrix once points
are scaled by their number: d = n * x - S. Each partition multiplies d's residues modulo several primes, in blocks
small enough that every product sum is exact in doubles; Spark sums the residues, and Chinese remaindering gives the
scatter without any rounding. Only then come doubles: one eigendecomposition, and a projection of every row.

Null vectors and vectors with null or non-finite entries are dropped. Points have the dimension that most different
vectors have (the larger of two as frequent); vectors of another length, empty ones included, are no such points and go
too. Scaled entries beyond 2^61 in size count as that. A component without variance (below rounding) has explained 0 and a null
whitened. A deviation beyond a long is null. Repeated rows and null ids stay; a table without points gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, read, short_batches, written

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
LARGEST = float(1 << 61)
#: Rows of a modular product: residues stay within 2^20 of zero, so 2^12 products sum to 2^52 at most.
BLOCK_ROWS = 1 << 12
#: Entries of a batch of projected rows.
BATCH_ENTRIES = 1 << 19


def primes(least_product: int) -> list[int]:
    """The largest primes below 2^21 whose product is over least_product."""
    found, product, p = [], 1, (1 << 21) - 1
    while product <= least_product:
        if all(p % q for q in range(3, 1449, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def packed(vectors: pa.Array) -> list[bytes | None]:
    """floor(64 * c) of each vector's entries in the fewest bytes that hold them all (their number first); None for a vector to be dropped."""
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out: list[bytes | None] = []
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(SCALE * flat)
    for given, at, end in zip(vectors.is_valid().to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        if not given or not np.isfinite(flat[at:end]).all():
            out.append(None)
            continue
        v = np.clip(whole[at:end], -LARGEST, LARGEST).astype(np.int64)
        size = next((s for s in (1, 2, 4) if not len(v) or (v.min() >= -(1 << (8 * s - 1)) and v.max() < 1 << (8 * s - 1))), 8)
        out.append(bytes([size]) + v.astype(f"<i{size}").tobytes())
    return out


def unpacked(points: list[bytes]) -> np.ndarray:
    """Points of one dimension as rows of 64-bit integers."""
    if len({p[0] for p in points}) == 1:
        return np.frombuffer(b"".join([p[1:] for p in points]), f"<i{points[0][0]}").reshape(len(points), -1).astype(np.int64)
    return np.stack([np.frombuffer(p, f"<i{p[0]}", offset=1) for p in points]).astype(np.int64)


def points_of(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """rows' columns `keep` and `point`, packed, without the rows that are dropped. No shuffle."""
    short_batches(rows.sparkSession)
    kept = [col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    schema = T.StructType([T.StructField(f"k{i}", rows.schema[c].dataType) for i, c in enumerate(keep)] + [T.StructField("point", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pa.array(packed(b.column(b.num_columns - 1)), pa.binary())
            made = pa.RecordBatch.from_arrays([*b.columns[:-1], p], names=schema.names)
            yield made.filter(p.is_valid())

    return rows.select(*kept, col(vector).alias("vector")).mapInArrow(run, schema)


def sums_of(fit: DataFrame) -> tuple[int, list[int], list[int]]:
    """(n, S, largest distance of a point from the mean in each dimension) of the fit list's most frequent dimension; 32-bit halves are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, list[bytes]] = {}
            for p in b.column(0).to_pylist():
                by.setdefault((len(p) - 1) // p[0], []).append(p)
            for dims, own in by.items():
                if dims:
                    x = unpacked(own)
                    made = [np.full(dims, dims), np.arange(dims), np.full(dims, len(own)), (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), x.min(axis=0), x.max(axis=0)]
                    yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int64)) for m in made], names=["dims", "j", "n", "high", "low", "least", "most"])

    parts = fit.mapInArrow(run, "dims long, j long, n long, high long, low long, least long, most long")
    total = parts.groupBy("dims", "j").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")], F.min("least").alias("least"), F.max("most").alias("most"))
    best = total.where("j = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return 0, [], []
    rows = total.where(F.col("dims") == best.dims).orderBy("j").collect()
    sums = [(r.high << 32) + r.low for r in rows]
    return best.n, sums, [max(best.n * r.most - s, s - best.n * r.least) for r, s in zip(rows, sums)]


def scatter_of(fit: DataFrame, n: int, sums: list[int], reach: list[int]) -> list[list[int]]:
    """The exact sum over the fit list of d d', d = n * x - S, from its residues modulo as many primes as it takes."""
    dims, moduli = len(sums), primes(2 * n * max(max(reach), 1) ** 2)
    upper = np.triu_indices(dims)
    mean = [s // n for s in sums]
    rest = [s % n for s in sums]

    def residues(x: np.ndarray, p: int) -> np.ndarray:
        """n * (x - mean) - rest modulo p, within p / 2 of zero."""
        d = ((x - np.array(mean, np.int64)) % p * (n % p) - np.array([r % p for r in rest], np.int64)) % p
        return np.where(d > p // 2, d - p, d).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((dims, dims), np.int64) for _ in moduli]
        seen = False
        for b in batches:
            own = [p for p in b.column(0).to_pylist() if len(p) == 1 + dims * p[0]]
            for at in range(0, len(own), BLOCK_ROWS):
                seen, x = True, unpacked(own[at : at + BLOCK_ROWS])
                for k, p in enumerate(moduli):
                    d = residues(x, p)
                    total[k] = (total[k] + (d.T @ d).astype(np.int64)) % p
        if seen:
            places = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*places, *[pa.array(t[upper]) for t in total]], names=["i", "j", *[f"r{k}" for k in range(len(moduli))]])

    names = [f"r{k}" for k in range(len(moduli))]
    parts = fit.mapInArrow(run, "i int, j int, " + ", ".join(f"{c} long" for c in names))
    product = 1
    for p in moduli:
        product *= p
    weights = [product // p * pow(product // p, -1, p) for p in moduli]
    out = [[0] * dims for _ in range(dims)]
    for row in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]).collect():
        value = sum(w * (row[2 + k] % p) for k, (w, p) in enumerate(zip(weights, moduli))) % product
        out[row.i][row.j] = out[row.j][row.i] = value - product if value > product // 2 else value
    return out


class Whitening:
    """What turns points into whitened ones: n, the sums, the components and their eigenvalues. Its size is the square of the dimension."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]], components: int) -> None:
        self.n, self.dims = n, len(sums)
        self.mean, self.rest = [s // n for s in sums], [s % n for s in sums]
        cube = n**3  # d is n times a deviation, and the divisor is n
        v = np.array([[float(Fraction(x, cube)) for x in row] for row in scatter])
        values, vectors = np.linalg.eigh(v)
        top = np.argsort(-values, kind="stable")[:components]
        trace = float(Fraction(sum(scatter[i][i] for i in range(self.dims)), cube))
        self.has = values[top] > np.finfo(float).eps * self.dims * max(values.max(), 0)
        self.values = np.where(self.has, values[top], 1.0)
        self.vectors = vectors[:, top]
        self.explained = np.where(self.has, values[top] / (trace or 1.0), 0.0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        at = x - np.array(self.mean, np.int64)
        bound = self.n * (int(np.abs(at).max(initial=0)) + 1)
        if self.dims * bound**2 < 1 << 63:
            d = self.n * at - np.array(self.rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest)) for row in at.tolist()]
        return [e if e < 1 << 63 else None for e in exact]

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.mean, np.int64)).astype(np.float64) - np.array([r / self.n for r in self.rest])
        return centred @ self.vectors / np.sqrt(self.values)


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity: each task centres about its own mean, and the means' scatter is added."""
    k, dims = len(w.values), w.dims
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [p for p in b.column(0).to_pylist() if len(p) == 1 + dims * p[0]]
            if own:
                y = w.project(unpacked(own))
                m = y.mean(axis=0)
                about = (y - m).T @ (y - m) + len(own) * np.outer(m, m)
                made = [upper[0], upper[1], about[upper], len(own) * m[upper[0]], len(own) * m[upper[1]]]
                kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds)], names=["i", "j", "about", "si", "sj"])

    parts = fit.mapInArrow(run, "i int, j int, about double, si double, sj double")
    worst = 0.0
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("about", "si", "sj")]).collect():
        if w.has[r.i] and w.has[r.j]:
            worst = max(worst, abs(r.about / w.n - r.si / w.n * (r.sj / w.n) - (r.i == r.j)))
    return worst


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each remaining row and component; other columns are not read.

    The only shuffle of vectors is that of the different ones, packed, after each task has left out its repeats; they are
    written, as three passes read them. The driver gets sums whose number is the square of the dimension.
    """
    fit = written(points_of(rows, vector, []).distinct(), "points")
    n, sums, reach = sums_of(fit)
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType)] + [T.StructField(*x) for x in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType()))])
    if not n:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    w = Whitening(n, sums, scatter_of(fit, n, sums, reach), components)
    error, k, dims = identity_error(fit, w), len(w.values), w.dims
    step = max(1, BATCH_ENTRIES // max(dims, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array([len(p) == 1 + dims * p[0] for p in b.column(1).to_pylist()], pa.bool_()))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x, m = unpacked(part.column(1).to_pylist()), part.num_rows
                each = np.repeat(np.arange(m), k)
                y = pa.array(w.project(x).ravel(), mask=np.tile(~w.has, m))
                made = [part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(w.deviations(x), pa.int64()).take(pa.array(each)), y, pa.array(np.tile(w.explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return points_of(rows, vector, [key]).mapInArrow(run, schema).withColumnRenamed("key", key)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the sixteen components of most variance."""
    return whitened(read(spark, sf_dir, "embeddings"))
