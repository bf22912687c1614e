"""Whitening against exact rational sums and its edges."""

from fractions import Fraction

import numpy as np
import pytest

from wireloom.llm.queries import QUERIES
from wireloom.llm.whitening import primes, whitened

from ..conftest import SMALL


def check(rows, got):
    """rows: (vec_id, vector); got: Row list of the operator."""
    left = [(i, [int(np.floor(64.0 * c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in left})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    d = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(v)
    top = np.argsort(-values)[:16]
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == len(left) * min(16, dims)
    sign = {}
    for i, x in left:
        e = [n * a - s for a, s in zip(x, sums)]
        for c, t in enumerate(top, 1):
            want = float(np.dot(np.array(e, float) / n, vectors[:, t]) / np.sqrt(values[t]))
            for r in by[i, c]:
                assert r.n == n and r.deviation == sum(a * a for a in e)
                assert r.explained == pytest.approx(values[t] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
                assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-6)
                if abs(want) > 1e-3:
                    assert sign.setdefault(c, np.sign(want * r.whitened)) == np.sign(want * r.whitened)


def test_query_against_exact_sums(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check(rows, QUERIES["op11_whitening"](spark, SMALL).collect())


def test_nulls_repeats_and_large_entries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=5) * [1, 2, 3, 4, 1e3]).tolist()) for i in range(40)]
    rows += [(40 + i, rows[0][1]) for i in range(200)] + [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0]), (902, [1.0, float("nan"), 1.0, 1.0, 1.0]), (903, [float("inf")] * 5)]
    table = spark.createDataFrame([(i, v, "mine", 1) for i, v in rows], "vec_id long, embedding array<double>, whitened string, n int")
    got = whitened(table.repartition(7)).collect()
    check(rows, got)
    assert {r.vec_id for r in got} == set(range(240))


def test_points_of_another_length_none_and_no_variance(spark):
    kind = "vec_id long, embedding array<float>"
    got = whitened(spark.createDataFrame([(1, []), (2, [1.0, 2.0]), (None, [1.0, 3.0]), (4, [1.0]), (4, [1.0, 2.0])], kind)).collect()
    assert sorted((str(r.vec_id), r.component, r.whitened is None, r.explained) for r in got) == sorted((i, c, c == 2, 2.0 - c) for i in ("2", "None", "4") for c in (1, 2))
    assert whitened(spark.createDataFrame([], kind)).count() == 0 and whitened(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    alone = whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, None, 0.0, 0.0)] * 2
    huge = whitened(spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 2 and all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in huge)
    assert len(primes(1 << 100)) == 5
