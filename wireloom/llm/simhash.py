"""Operator 2, SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has 64 bits. Two fingerprints at `radius` or fewer differing bits are linked. The bits
are dealt into m groups of correlated bits; group i gets a threshold t_i >= -1 with sum(t_i) = radius - m + 1.
If two fingerprints differed in more than t_i bits in every group they would differ in radius + 1 bits
altogether, so probing each group within its own threshold finds every link. The groups come from the
bits' correlations over all fingerprints, m and the thresholds from a dynamic programme over estimated numbers
of probes and candidates: as the corpus grows, fewer and wider groups win.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, lgamma, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, components, fresh, read, row_key, whole_row_key, written

BITS = 64
#: Fingerprints of a bucket that one group of the verification may hold; larger buckets are dealt into pairs of blocks.
BLOCK = 2048


def simhash(text: bytes | None, words_per_shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text as an unsigned integer: a bit is set if it is in over half the shingles' XXH64."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    w = min(n, words_per_shingle)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - w + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[w - 1 :].tolist())], dtype=">u8")
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        votes += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "fp") -> DataFrame:
    """docs with the fingerprint of `text` as a signed long column `out`; null and empty texts have 0."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([simhash(t) for t in texts.to_pylist()], np.uint64).view(np.int64))]

    return append_columns(docs, [text], [T.StructField(out, T.LongType())], kernel, keep)


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of both bits set) over all rows of the long column fp.

    Each task adds up its own matrix, Spark adds up those; 4,096 sums reach the driver, whatever the size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            x = bits_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n).astype(np.int64))], names=["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r.k] = r.n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def bits_of(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, least significant first."""
    return ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def correlated_groups(joint: np.ndarray, n: int, m: int) -> list[list[int]]:
    """64 bits in m groups of nearly equal size; each grows from the most correlated free pair by the bit most correlated with it."""
    p = np.diag(joint) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for i in range(m):
        want = (BITS - sum(map(len, groups))) // (m - i)
        pool = sorted(free)
        sub = corr[np.ix_(pool, pool)]
        a, b = divmod(int(np.argmax(sub)), len(pool))
        own = [pool[a], pool[b]] if a != b else pool[:2]
        while len(own) < want:
            rest = [x for x in pool if x not in own]
            own.append(rest[int(np.argmax(corr[np.ix_(rest, own)].mean(axis=1)))])
        groups.append(sorted(own))
        free -= set(own)
    return groups


def near_share(joint: np.ndarray, n: int, bits: list[int]) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, 2, ... of these bits: a beta-binomial with the mean and variance that the joint counts give."""
    k, n = len(bits), max(n, 1)
    p11 = joint[np.ix_(bits, bits)] / n
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    both = 2 * (p11 * p00 + p10 * p01)
    d = 2 * p * (1 - p)
    np.fill_diagonal(both, d)
    mean, var = float(d.sum()), float((both - np.outer(d, d)).sum())
    q = min(max(mean / k, 1e-6), 1 - 1e-6)
    floor = k * q * (1 - q)
    rho = min(max((var / floor - 1) / max(k - 1, 1), 1e-6), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)

    def lbeta(x: float, y: float) -> float:
        return lgamma(x) + lgamma(y) - lgamma(x + y)

    pmf = [comb(k, j) * exp(lbeta(j + a, k - j + b) - lbeta(a, b)) for j in range(min(k, 3) + 1)]
    return np.minimum(np.cumsum(pmf), 1.0)


def allocate(costs: list[dict[int, float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds, one per group, of the given sum and least total cost: a dynamic programme over groups and sums so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (so_far, chosen) in best.items():
            for t, c in cost.items():
                if have + t not in step or so_far + c < step[have + t][0]:
                    step[have + t] = (so_far + c, [*chosen, t])
        best = step
    return best[budget]


def plan_probes(n: int, joint: np.ndarray, radius: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group to probe; the cheapest over 2 to radius + 1 groups."""
    found: tuple[float, list[tuple[list[int], int]]] | None = None
    for m in range(2, radius + 2):
        groups = correlated_groups(joint, n, m)
        costs = []
        for g in groups:
            share = near_share(joint, n, g)
            cost = {-1: 0.0}
            for t in range(min(radius - 1, 2) + 1):
                probes = 1 + sum(comb(len(g), j) for j in range(1, t + 1))
                cost[t] = 20.0 * n * probes + 0.5 * n * n * share[t]
            costs.append(cost)
        total, ts = allocate(costs, radius - m + 1)
        if found is None or total < found[0]:
            found = total, [(g, t) for g, t in zip(groups, ts) if t >= 0]
    return found[1]


def probe_rows(fps: DataFrame, probes: list[tuple[list[int], int]]) -> DataFrame:
    """(key, fp, own): each fingerprint under its own value of every probed group, and, not `own`, under all values within the group's threshold."""
    masks = []
    for bits, t in probes:
        near = [sum(1 << j for j in c) for w in range(1, t + 1) for c in combinations(range(len(bits)), w)]
        masks.append(np.array([0, *near], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            x = fp.view(np.uint64)
            for i, (bits, _) in enumerate(probes):
                value = np.zeros(len(x), np.uint64)
                for j, at in enumerate(bits):
                    value |= ((x >> np.uint64(at)) & np.uint64(1)) << np.uint64(j)
                keys = (value[:, None] ^ masks[i][None, :]) | (np.uint64(i) << np.uint64(56))
                own = np.zeros(keys.shape, bool)
                own[:, 0] = True
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1])), pa.array(own.ravel())], names=["key", "fp", "own"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, own boolean")


def bucket_links(gid: np.ndarray, fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up each bucket (rows of one gid, adjacent): all pairs are verified, but pairs already joined give no further link.

    Row i is compared with row i + s for s = 1, 2, ... as long as any bucket is that long.
    """
    lab = np.arange(len(gid))
    at, us, vs, s = np.arange(len(gid)), [], [], 1
    while True:
        at = at[at + s < len(gid)]
        at = at[gid[at] == gid[at + s]]
        if not len(at):
            break
        to = at + s
        hit = (lab[at] != lab[to]) & (own[at] | own[to]) & (np.bitwise_count(fp[at] ^ fp[to]) <= radius)
        if hit.any():
            i, j = at[hit], to[hit]
            us.append(fp[i])
            vs.append(fp[j])
            a, b = lab[i], lab[j]
            while len(a):
                up = np.arange(len(lab))
                np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
                while (up[up] != up).any():
                    up = up[up]
                lab = up[lab]
                a, b = up[a], up[b]
                a, b = a[a != b], b[a != b]
        s += 1
    none = np.zeros(0, np.uint64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (none, none)


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join exactly what links of `radius` or fewer bits join.

    fps: distinct longs in column fp. A bucket of over BLOCK rows is dealt into blocks, and each pair of blocks
    goes to its own group, so a group never holds more than about 2 * BLOCK rows, and a bucket gives about as
    many edges as it has rows per block pair, never all its pairs.
    """
    n, joint = bit_statistics(fps)
    rows = probe_rows(fps, plan_probes(n, joint, radius))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("own"), 1)).alias("n_own")).where("n > 1 and n_own > 0").select("key", "n")
    rows = rows.join(sizes, "key")
    nb = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.select("key", "fp", "own", nb.alias("nb"), F.pmod(F.xxhash64("fp"), nb.cast("long")).cast("int").alias("b"))
    rows = rows.select("key", "fp", "own", "b", F.explode(F.when(F.col("nb") > 1, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array(F.lit(0)))).alias("c"))
    rows = rows.select("key", F.least("b", "c").alias("b1"), F.greatest("b", "c").alias("b2"), "fp", "own")
    rows = rows.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            new = np.any([np.diff(c) != 0 for c in cols[:3]], axis=0)
            u, v = bucket_links(np.concatenate(([0], np.cumsum(new))), cols[3].view(np.uint64), cols[4], radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            last = np.flatnonzero(np.any([c != c[-1] for c in cols[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from out([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield from out(held)

    return rows.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, radius: int = 3, key: Column | None = None) -> DataFrame:
    """Fingerprints and groups of near-duplicate documents.

    docs needs doc_id (integer) and text. Returns, per row of docs: doc_id, row_key (`key`, by default of id and text), fp
    (long), root (long: smallest linked fingerprint, as signed), component_id (smallest doc_id of the group; null only if all its
    ids are null). Null texts and texts without words have fingerprint 0 and are linked like any other. Equal
    fingerprints are one node, so exact copies, however many, cost one row after a combined aggregate. Rows that
    repeat keep one output row each. An empty table gives an empty result.
    """
    slim = docs.select("doc_id", "text", (row_key(F.col("doc_id"), F.col("text")) if key is None else key).alias("row_key"))
    rows = written(with_fingerprint(slim, keep=["doc_id", "row_key"]), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), radius), "simhash-links")
    member = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = written(member, "members")
    groups = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = member.join(groups, "root").select("fp", "root", "component_id")
    return rows.join(member, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def first_of_each_group(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs, whole rows, with one row of each near-duplicate group: that of the smallest doc_id, of rows with the same id the one with the smallest hash of all columns.

    Columns of docs stay as they are, whatever their names.
    """
    groups = near_groups(docs, radius, whole_row_key(docs))
    key, = fresh(docs.columns, "row_key")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row_key").alias(key))
    keyed = docs.withColumn(key, whole_row_key(docs))
    # what repeats a key repeats the whole row
    return keyed.join(kept.select(key), key, "left_semi").dropDuplicates([key]).drop(key)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    rows = near_groups(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
