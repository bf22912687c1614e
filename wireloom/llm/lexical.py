"""Operator 12, ranked lexical search: TPUT over term-partitioned postings.

A posting is a term, a document and the term's impact there; postings lie in a table dealt by ranges of (term, falling
impact, document), so that a long list is many tasks' work and a list's head is where its range begins. Three phases:

1. The first k postings of every list are fetched. A document's sum over the heads that it is in is a lower bound of its
   score, and the k-th largest of an item, tau, bounds what can still be among its k best.
2. Every list of an item of m terms is cut at the same threshold, tau / m: a document in no list above it scores below
   tau. What is above goes to its documents' tasks, where partial scores and upper bounds (an unseen term adds less than
   the threshold, and no more than its list's head) leave candidates.
3. The terms of the candidates are looked up in the postings for exact scores, of which the k best stay.

Every bound is exact in integers, so no result is lost at any size. The lists are those of the items' terms; items are
searched in blocks of bounded text, whose terms and weights every task knows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, read, short_batches, written

TOP = 20
#: Bytes of item texts in one block.
BLOCK_BYTES = 4_000_000
#: Documents whose partial scores a task holds at once, by entries of (document, item).
HELD_ENTRIES = 1 << 21
#: Upper-case ASCII falls to lower case, what is no term's byte becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, doc_id, n, terms, tfs) of every row: a number of its own, all its terms' count, and those of the vocabulary with their occurrences."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            n, ends, terms, tfs = [], [0], [], []
            for text in b.column(2).to_pylist():
                words = terms_of(text)
                own = Counter(filter(known.__contains__, words))
                n.append(len(words))
                terms += map(known.__getitem__, own)
                tfs += own.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *lists], names=schema.names)

    return docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


class Block:
    """One block of items: each one's terms with their weights times their repeats, as flat arrays by item and by term."""

    def __init__(self, items: list[tuple[object, bytes | None]]) -> None:
        counted = [(k, Counter(terms_of(t))) for k, t in items]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, c in counted for w in c))}
        self.keys = [k for k, _ in counted]
        self.item = np.array([i for i, (_, c) in enumerate(counted) for _ in c], np.int64)
        self.term = np.array([self.vocabulary[w] for _, c in counted for w in c], np.int64)
        self.repeats = np.array([r for _, c in counted for r in c.values()], np.int64)
        self.lengths = np.bincount(self.item, minlength=len(self.keys))

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        self.weight = self.repeats * np.array([floor(1000 * log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in self.term.tolist()], np.int64)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(item, term, weight): as long as the block's terms."""
        made = list(zip(self.item.tolist(), self.term.tolist(), self.weight.tolist()))
        return F.broadcast(spark.createDataFrame(made, "item int, term int, weight long"))


def best(scored: DataFrame, k: int, key: str, *order: str) -> DataFrame:
    """The k rows of largest score of each key, with rank; each task sends k at most."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), *[F.asc_nulls_last(c) for c in order])
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(postings: DataFrame, block: Block, tau: np.ndarray, heads: np.ndarray, k: int) -> DataFrame:
    """Phase 2: (item, doc, low, high) of the documents above the threshold in some list that can be among an item's k best.

    A posting goes to its document's task if some item's threshold lets it. There a few documents at a time are summed per
    item, and those whose upper bound is below tau, or below the k-th best lower bound of the task so far, go no further.
    """
    order = np.argsort(block.term, kind="stable")
    term, item, weight = block.term[order], block.item[order], block.weight[order]
    starts = np.searchsorted(term, np.arange(len(block.vocabulary) + 1))
    # an entry counts if m * weight * impact >= tau; without any tau (too few documents known) every entry does
    least = np.where(weight > 0, -(-tau[item] // np.maximum(block.lengths[item] * weight, 1)), np.iinfo(np.int64).max)
    lowest = np.minimum.reduceat(least, starts[:-1]) if len(term) else least
    unseen = np.minimum(weight * heads[term], np.maximum(-(-tau[item] // np.maximum(block.lengths[item], 1)) - 1, 0))
    unseen = np.where(tau[item] > 0, unseen, 0)  # then nothing above zero is unseen
    all_unseen = np.bincount(item, unseen, len(block.keys)).astype(np.int64)
    n_items = len(block.keys)
    sent = postings.sparkSession.sparkContext.broadcast((starts, item, weight, least, unseen, all_unseen, tau))
    cut = postings.sparkSession.createDataFrame([(i, x) for i, x in enumerate(lowest.tolist())], "term int, lowest long")
    reached = postings.join(F.broadcast(cut), "term").where("impact >= lowest").select("doc", "term", "impact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, item, weight, least, unseen, all_unseen, tau = sent.value
        bar = tau.copy()
        leading = [np.zeros(0, np.int64) for _ in range(n_items)]

        def summed(doc: np.ndarray, t: np.ndarray, impact: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Rows of whole documents, sorted by document."""
            first = np.concatenate(([True], doc[1:] != doc[:-1]))
            own, local = doc[first], np.cumsum(first) - 1
            for at in range(0, len(own), step):
                a, b = np.searchsorted(local, [at, at + step])
                sizes = starts[t[a:b] + 1] - starts[t[a:b]]
                entry = np.repeat(starts[t[a:b]] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                value, where = np.repeat(impact[a:b], sizes), np.repeat(local[a:b] - at, sizes)
                fits = value >= least[entry]
                entry, value, where = entry[fits], value[fits], where[fits]
                place = where * n_items + item[entry]
                n = min(step, len(own) - at)
                low, rest = np.zeros(n * n_items, np.int64), np.zeros(n * n_items, np.int64)
                np.add.at(low, place, weight[entry] * value)
                np.add.at(rest, place, unseen[entry])
                low = low.reshape(n, n_items)
                high = low + all_unseen - rest.reshape(n, n_items)
                d, i = np.nonzero((low > 0) & (high >= bar))
                yield_low = low[d, i]
                for x in np.unique(i).tolist():  # raise this task's bar
                    leading[x] = np.sort(np.concatenate((leading[x], yield_low[i == x])))[-k:]
                    if len(leading[x]) == k:
                        bar[x] = max(bar[x], leading[x][0])
                stay = high[d, i] >= bar[i]
                d, i = d[stay], i[stay]
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(own[at + d]), pa.array(low[d, i]), pa.array(high[d, i])], names=["item", "doc", "low", "high"])

        step = max(1, HELD_ENTRIES // max(n_items, 1))
        left: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for b in batches:
            now = [np.concatenate((x, b.column(c).to_numpy().astype(np.int64))) for c, x in enumerate(left)]
            whole = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            if whole:
                yield from summed(*[x[:whole] for x in now])
            left = [x[whole:] for x in now]
        if len(left[0]):
            yield from summed(*left)

    return reached.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, "item int, doc long, low long, high long")


def search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    block = Block([(r[0], r[1]) for r in items.select("item_id", F.col("text").cast("binary")).collect()])
    if not block.vocabulary:
        return spark.createDataFrame([], result_schema(docs, items))
    rows = written(forward(docs, block.vocabulary), "forward")
    total = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    tf = rows.where(F.size("terms") > 0).select("doc", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("doc", "n", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    norm = f"(75L + ((25L * n * {total.docs}L) div {max(total.terms, 1)}L))"
    impacts = tf.select("term", F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * {norm})").alias("impact"), "doc")
    postings = written(impacts.repartitionByRange("term", F.desc("impact"), "doc").sortWithinPartitions("term", F.desc("impact"), "doc"), "postings")

    per_term = {r.term: (r.df, r.top) for r in postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("impact").alias("top")).collect()}
    block.weigh(total.docs, {t: df for t, (df, _) in per_term.items()})
    heads_max = np.array([per_term.get(t, (0, 0))[1] for t in range(len(block.vocabulary))], np.int64)
    weights = block.rows(spark)
    value = F.sum(F.col("weight") * F.col("impact")).alias("score")

    # phase 1: heads of lists
    heads = best(postings.withColumn("score", F.col("impact")), k, "term", "doc").select("term", "doc", "impact")
    known = heads.join(weights, "term").groupBy("item", "doc").agg(value)
    tau = np.zeros(len(block.keys), np.int64)
    for r in best(known, k, "item", "doc").where(F.col("rank") == k).collect():
        tau[r.item] = r.score

    # phase 2: one threshold for all lists of an item
    found = written(candidates(postings, block, tau, heads_max, k), "candidates")
    bar = best(found.withColumn("score", F.col("low")), k, "item", "doc").where(F.col("rank") == k).select("item", F.col("score").alias("bar"))
    live = found.join(F.broadcast(bar), "item", "left").where("high >= coalesce(bar, 0)").select("item", "doc")

    # phase 3: exact scores
    asked = live.join(weights, "item").select("item", "doc", "term", "weight")
    exact = asked.join(postings, ["doc", "term"]).groupBy("item", "doc").agg(value).where("score > 0")
    named = exact.join(rows.select("doc", "doc_id"), "doc")
    ranked = best(named, k, "item", "doc_id", "doc")
    names = spark.createDataFrame(list(enumerate(block.keys)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", items.schema["item_id"].dataType)]))
    out = written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    drop(rows, postings, found)
    return out


def result_schema(docs: DataFrame, items: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k best documents of each item (item_id, text) among docs (doc_id, text); other columns are not read.

    Null and empty texts have no terms: such documents are never found, such items find nothing. Every row is a document
    and every item row is searched, repeats too; equal scores rank by doc_id, null last. Empty tables give no rows.
    """
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first().bytes
    n = 1 + size // BLOCK_BYTES
    parts = [search_block(docs, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items, k) for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    return search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
with words as (select doc_id, row_number() over () as doc, regexp_extract_all({LOWER}, '{CLASS}') as ws from documents),
sized as (select doc_id, doc, ws, len(ws)::bigint as n from words where len(ws) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as terms from sized),
wanted as (select item_id, unnest(regexp_extract_all({LOWER}, '{CLASS}')) as term from benchmark),
asked as (select item_id, term, count(*)::bigint as repeats from wanted group by all),
tf as (select doc_id, doc, n, term, count(*)::bigint as tf from (select doc_id, doc, n, unnest(ws) as term from sized) group by all),
used as (select * from tf where term in (select term from asked)),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select term, count(*)::bigint as df from used group by term), total),
scored as (select item_id, doc_id, doc, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + ((25 * n * docs) // terms)))))::bigint as score
  from asked join used using (term) join weights using (term), total group by item_id, doc_id, doc),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id, doc)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= {TOP}
"""
