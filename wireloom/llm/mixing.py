"""Operator 4, mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources share the total size by weight, each up to a multiple of its own size, the excess shared again.
A source's target is a number of complete epochs and a rest. For the rest its documents are taken in the order
of exponential keys, -ln(u) / w with w the document's quality weight and u a hash, up to the budget by prefix
sums: bucket sums first, then places within a bucket, so no task holds a source. Buckets are even steps of the
key's logarithm: whatever the weights, an exponential key falls into a given step with a chance of at most
ln(2) / (e * STEPS), so no bucket is expected to hold more than that share of its source's rows. Rows that repeat are
one row with a count throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, col, fresh, read, row_key, whole_row_key, written

#: Buckets a doubling of the key; a bucket holds at most 0.025 % of a source's different rows, by expectation.
STEPS = 1024
#: Least key that is told apart, below the least that a hash of 53 bits gives.
LEAST_KEY = 2.0**-60
MAX_EPOCHS = 3
#: Rows of the plan that may be sent to all executors.
MAX_BROADCAST = 100_000
#: Copies of one row that one task makes.
COPIES = 10_000
IS_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])


def quality_weight(words: list[bytes]) -> float:
    """0.1 to 1: the share of letters among the bytes of the words times the share of different words."""
    if not words:
        return 0.1
    data = np.frombuffer(b"".join(words), np.uint8)
    return 0.1 + 0.9 * float(np.count_nonzero(IS_LETTER[data])) / len(data) * len(set(words)) / len(words)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row_key, size, weight): words of each text and its quality weight; a null text has 0 words."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        words = [(t or b"").split() for t in texts.to_pylist()]
        return [pa.array([len(w) for w in words], pa.int64()), pa.array([quality_weight(w) for w in words], pa.float64())]

    slim = docs.select("doc_id", "source", "text").withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    return append_columns(slim, ["text"], [T.StructField("size", T.LongType()), T.StructField("weight", T.DoubleType())], kernel, keep=["doc_id", "source", "row_key"])


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, of the source by code point, null last. Sources are sorted by ranges and numbered within each; only the ranges' counts are summed up in one place."""
    rows = written(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return rows.withColumn("at", within).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("at")).drop("part", "at", "start")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... Filling by weight with caps: sources that the common level takes
    above their cap get their cap, and the level rises for the others, until none is above; each round is one sum over
    the sources.
    """
    rows = ranked(sizes).select("source", "source_size", (F.col("rank") % 3 + 1).alias("share"), (max_epochs * F.col("source_size")).alias("cap"))
    rows = written(rows, "source-shares")
    got = rows.agg(F.sum("source_size").alias("size"), F.sum("share").alias("share")).first()
    total, level, n_full = got["size"] or 0, (got["size"] or 0) / (got["share"] or 1), -1
    while True:
        full = F.col("cap") / F.col("share") <= F.lit(float(level))
        got = rows.agg(F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("share"))).alias("share")).first()
        if got["n"] == n_full or not got["share"]:
            break
        n_full, level = got["n"], (total - (got["cap"] or 0)) / got["share"]
    target = F.when(full, F.col("cap")).otherwise(F.lit(float(level)) * F.col("share")).cast("double")
    return rows.select("source", "source_size", target.alias("target"))


def bucket_of(order_key: Column) -> Column:
    """The step of the key's logarithm, rising with the key."""
    return F.floor(F.log2(F.greatest(order_key, F.lit(LEAST_KEY))) * STEPS).cast("int")


def mix_plan(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per different (doc_id, text, source): doc_id, source, row_key, size, rows (that repeat), source_size, target, epochs, extra.

    Each of the rows is taken `epochs` times, and `extra` of them once more. A rerun gives the same. Null sources are
    a source of their own; documents without words have size 0; an empty table gives no row.
    """
    tag = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tag")
    rows = sized(docs).select("doc_id", "source", "row_key", "size", "weight", tag).groupBy("doc_id", "source", "row_key", "tag", "size", "weight").agg(F.count(F.lit(1)).alias("rows"))
    u = (F.shiftrightunsigned(F.xxhash64("row_key", "tag"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = rows.withColumn("order_key", -F.log(u) / F.col("weight")).withColumn("bucket", bucket_of(F.col("order_key")))
    rows = written(rows, "mix")
    mass = F.sum(F.col("size") * F.col("rows"))
    buckets = rows.groupBy("tag", "source", "bucket").agg(mass.alias("mass"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("mass").alias("source_size")), max_epochs)
    targets = targets.withColumn("tag", tag).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0)))
    targets = targets.withColumn("rest", F.greatest(F.col("target") - F.col("epochs") * F.col("source_size"), F.lit(0.0))).drop("source")
    ahead = Window.partitionBy("tag").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("mass").over(ahead), F.lit(0))).join(targets, "tag").drop("source", "mass")
    within = Window.partitionBy("tag", "bucket").orderBy("order_key", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(buckets, ["tag", "bucket"])
    gone = F.col("ahead") + F.coalesce(F.sum(F.col("size") * F.col("rows")).over(within), F.lit(0))
    extra = F.when(F.col("size") > 0, F.floor((2 * (F.col("rest") - gone) + F.col("size")) / (2 * F.col("size")))).otherwise(F.lit(0))
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(extra, F.col("rows"))).cast("long"))
    return rows.select("doc_id", "source", "row_key", "size", "rows", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), "extra")


def mixed(docs: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """docs, whole rows, each as often as the mix takes it. Columns stay as they are, whatever their names.

    Rows alike in doc_id, text and source are taken equally often. Where the budget ends among them, those with the
    smaller hash of all columns come first; rows alike in everything need no order, they are counted.
    """
    key, tag, times, rows_of, extra, epochs, place, n = fresh(docs.columns, "row_key", "tag", "times", "rows", "extra", "epochs", "place", "n")
    tagged = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    plan = mix_plan(docs, max_epochs).select(F.col("row_key").alias(key), tagged(F.col("source")).alias(tag), F.col("rows").alias(rows_of), F.col("epochs").alias(epochs), F.col("extra").alias(extra)).where(F.col(epochs) + F.col(extra) > 0)
    plan = written(plan, "mix-plan")
    keyed = docs.withColumns({key: row_key(F.col("doc_id"), F.col("text")), tag: tagged(F.col("source"))})
    own = [col(c) for c in docs.columns]
    even = plan.where((F.col(extra) == 0) | (F.col(extra) == F.col(rows_of))).select(key, tag, (F.col(epochs) + F.when(F.col(extra) > 0, 1).otherwise(0)).alias(times))
    out = keyed.join(even, [key, tag]).where(F.col(times) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*own)
    # at most one place a source, where its budget ends
    ends = plan.where((F.col(extra) > 0) & (F.col(extra) < F.col(rows_of)))
    n_ends = ends.count()
    if not n_ends:
        return out
    uneven = keyed.join(F.broadcast(ends) if n_ends <= MAX_BROADCAST else ends, [key, tag])
    row, = fresh(docs.columns, "row")
    alike = uneven.withColumn(place, whole_row_key(docs)).groupBy(key, tag, place, epochs, extra).agg(F.first(F.struct(*own)).alias(row), F.count(F.lit(1)).alias(n))
    ahead = Window.partitionBy(key, tag).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    more = F.greatest(F.lit(0), F.least(F.col(extra) - F.coalesce(F.sum(n).over(ahead), F.lit(0)), F.col(n)))
    alike = alike.withColumn(times, F.col(n) * F.col(epochs) + more).where(F.col(times) > 0)
    # many copies of one row are made by many tasks
    parts = alike.withColumn(n, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES)))).repartition(key, tag, place, n)
    parts = parts.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col(times) - COPIES * F.col(n)))))
    return out.unionByName(parts.select(F.col(f"{row}.*")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    plan = mix_plan(read(spark, sf_dir, "documents"))
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("copy") <= F.col("extra"), 1).otherwise(0))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))
