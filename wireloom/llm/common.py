"""What the training-data operators share: scratch tables, Arrow maps, stable hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import drop, short_batches, written
from ..functions.tables import shared_path as scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores at its end as it takes to be none of `columns`, case ignored."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    kernel: Callable[..., list[pa.Array]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """df's columns `keep` (default all) and the new fields that kernel makes of the input columns, batch by batch.

    A kept column with the name of a new field gives way to it. Strings among the inputs reach the kernel as UTF-8 bytes. The
    kernel gets one Arrow array per input and returns one array per field. No shuffle.
    """
    short_batches(df.sparkSession)
    made = {f.name.lower() for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made]
    types = dict(df.dtypes)
    asked = [col(c).cast("binary") if types[c] == "string" else col(c) for c in inputs]
    given = df.select(*[col(c) for c in keep], *[c.alias(n) for c, n in zip(asked, fresh(keep, *[f"in{i}" for i in range(len(asked))]))])
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))
    n_keep, names = len(keep), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.columns
            yield pa.RecordBatch.from_arrays([*cols[:n_keep], *kernel(*cols[n_keep:])], names=names)

    return given.mapInArrow(run, schema)


def fold_of(doc_id, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def row_key(doc_id, text):
    """A 128-bit key of a row's id and text that survives recomputation, nulls told apart from empty texts."""
    return F.md5(F.concat_ws("\x1f", F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(text, F.lit(""))))


def whole_row_key(docs: DataFrame) -> Column:
    """A 128-bit key of a row's id, text and all its other columns: rows of the same key are alike in everything."""
    rest = [col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return F.md5(F.concat(row_key(F.col("doc_id"), F.col("text")), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: well-spread bits from sums and products."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node in `edges` (long columns u, v): root is the smallest node reachable.

    Contraction: in each round every node takes the smallest of itself and its neighbours as parent, parents
    are followed one step further, and edges and roots are rewritten by parent; edges within one root go. Each round is
    equi-joins and one combinable minimum, its tables are written to the shared folder and removed when the next has its own, and the rounds end
    when no edge is left (logarithmic in the longest chain). Self-loops and repeats are allowed; null ends are not.
    """
    edges = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    roots = above = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = written(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")), name)
        further = near.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = written(near.join(further, "p", "left").select("u", F.least("p", F.coalesce("q", "p")).alias("p")), name)
        pu, pv = up.select("u", F.col("p").alias("pu")), up.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        on = edges.join(pu, "u").join(pv, "v").where("pu <> pv")
        left = written(on.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), name)
        if roots is None:
            roots = above = up
            roots = roots.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = up.select(F.col("u").alias("root"), "p")
            now = written(roots.join(moved, "root", "left").select("node", F.coalesce("p", "root").alias("root")), name)
            drop(above, up)
            roots = above = now
        drop(near, edges)
        edges = left
    if roots is None:
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
