"""Operator 7, toxicity by a classifier chain.

Categories are predicted one after the other by linear models; each model also gets the probabilities of the
categories before it. For training these come from models that have not seen the row, nor have the features that
they use been chosen with it (out of fold), so later models learn how far earlier ones can be trusted. Features
are words and word beginnings that labelled documents tell apart best.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fold_of, read, short_batches, written
from .learning import SparseRows, bounded_sample, sigmoid

#: Labelled rows of either kind that the chain is fitted on, at most (about).
MAX_ROWS = 6_000
MAX_FEATURES = 4096
MIN_DOCS = 5
FOLDS = 5
PREFIXES = (5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
#: Words whose places a worker keeps.
CACHE_WORDS = 1 << 19
#: Steps of a fit, and of one for probabilities out of fold.
STEPS, FOLD_STEPS = 200, 80
#: Strong features from which on a toxic document counts as severe.
SEVERE_HITS = 5


def feature_names(word: str) -> list[str]:
    """A lower-case word and the beginnings of a longer one (with a hyphen)."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def words_of(text: bytes | None) -> set[str]:
    return set(WORD.findall((text or b"").decode("utf-8", "replace").lower()))


class WordHashes(dict):
    """The feature hashes of words, kept for words seen lately."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > CACHE_WORDS:
            self.clear()
        hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in feature_names(word)], np.uint64).view(np.int64).tolist()
        self[word] = hashes
        return hashes


class ToxicityChain:
    """The categories' models over the chosen features (hashes), in chain order.

    All but the first, whose labels are made of strong features, also get the number of a text's strong features.
    """

    def __init__(self, categories: Sequence[str], chosen: np.ndarray, strong: np.ndarray) -> None:
        self.categories, self.chosen = list(categories), np.sort(chosen)
        self.strong = np.isin(self.chosen, strong)
        self.weights = [np.zeros(len(self.chosen) + 1 + k + (k > 0)) for k in range(len(self.categories))]
        self._place: dict[int, int] | None = None
        self._words: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_place": None, "_words": {}}

    def places(self, text: bytes | None) -> np.ndarray:
        """Places, in `chosen`, of the text's features. Most words have none; each is looked up once."""
        if self._place is None:
            self._place = {h: i for i, h in enumerate(self.chosen.tolist())}
        if len(self._words) > CACHE_WORDS:
            self._words.clear()
        place, known, out = self._place, self._words, set()
        for w in words_of(text):
            own = known.get(w)
            if own is None:
                hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in feature_names(w)], np.uint64).view(np.int64).tolist()
                own = known[w] = tuple(place[h] for h in hashes if h in place)
            if own:
                out.update(own)
        return np.array(sorted(out), np.int64)

    def hits(self, places: list[np.ndarray]) -> np.ndarray:
        return np.log1p(np.array([self.strong[p].sum() for p in places], np.float64))

    def rows(self, places: list[np.ndarray]) -> SparseRows:
        return SparseRows(places, np.zeros((len(places), 0)), len(self.chosen))

    def fit(self, places: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, allowed: np.ndarray) -> None:
        """labels: rows x categories, 0 or 1. allowed: FOLDS x features, those chosen without the fold. Each category's earlier probabilities are out of fold."""
        x = self.rows(places)
        for k in range(len(self.categories)):
            y = labels[:, k]
            use = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
            self.weights[k] = x.fit(y, use, steps=STEPS)
            if k + 1 < len(self.categories):
                ahead = np.zeros(len(y))
                for f in range(FOLDS):
                    out = folds == f
                    if out.any():
                        seen = x.only(allowed[f])
                        ahead[out] = sigmoid(seen.scores(seen.fit(y, np.where(out, 0, use), steps=FOLD_STEPS)))[out]
                x = (x if k else x.with_column(self.hits(places))).with_column(ahead)

    def probabilities(self, places: list[np.ndarray]) -> np.ndarray:
        """Rows x categories."""
        x, found = self.rows(places), np.zeros((len(places), len(self.categories)))
        for k, w in enumerate(self.weights):
            found[:, k] = sigmoid(x.scores(w))
            x = (x if k else x.with_column(self.hits(places))).with_column(found[:, k])
        return found


def feature_counts(rows: DataFrame) -> DataFrame:
    """(h, yes0, no0, yes1, ..): documents of either label with each feature, by fold, over rows (text, label, fold); h null: all documents. Counted by task, then by feature."""
    short_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], Counter] = defaultdict(Counter)
        known = WordHashes()

        def out() -> pa.RecordBatch:
            flat = [(h, fold, label, n) for (fold, label), c in sums.items() for h, n in c.items()]
            sums.clear()
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*flat) if flat else [[]] * 4, kinds)], names=["h", "fold", "label", "n"])

        for b in batches:
            for text, label, fold in zip(*(c.to_pylist() for c in b.columns)):
                sums[fold, label].update({h for w in words_of(text) for h in known[w]})
                sums[fold, label][None] += 1
            if sum(map(len, sums.values())) > 1_000_000:
                yield out()
        yield out()

    slim = rows.select(F.col("text").cast("binary").alias("text"), F.col("label").cast("int").alias("label"), F.col("fold").cast("int").alias("fold"))
    counts = slim.mapInArrow(run, "h long, fold int, label int, n long")
    of = lambda f, label: F.sum(F.when((F.col("fold") == f) & (F.col("label") == label), F.col("n")).otherwise(0))
    return counts.groupBy("h").agg(*[of(f, label).alias(f"{name}{f}") for f in range(FOLDS) for name, label in (("yes", 1), ("no", 0))])


def telling_features(counts: DataFrame, most: int = MAX_FEATURES) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, whether strong) of the features that tell label 1 from 0 best: over all rows, then without each fold. counts: feature_counts, written."""
    total = counts.where("h is null").first()
    found = []
    for left_out in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != left_out]
        n1, n0 = (sum(total[f"{name}{f}"] for f in folds) if total else 0 for name in ("yes", "no"))
        if not n1 or not n0:
            found.append((np.zeros(0, np.int64), np.zeros(0, bool)))
            continue
        yes, no = (sum((F.col(f"{name}{f}") for f in folds), F.lit(0)) for name in ("yes", "no"))
        p1, p0 = (yes + 0.5) / (n1 + 1), (no + 0.5) / (n0 + 1)
        odds = F.log(p1 / (1 - p1)) - F.log(p0 / (1 - p0))
        z = odds / F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
        best = counts.where(F.col("h").isNotNull() & (yes + no >= MIN_DOCS)).select("h", z.alias("z"), ((z > 3) & (p1 > 20 * p0)).alias("strong"))
        best = best.orderBy(F.abs("z").desc(), "h").limit(most).collect()
        found.append((np.array([r.h for r in best], np.int64), np.array([r.strong for r in best], bool)))
    return found


def learn_chain(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityChain:
    """A chain (severe, toxic) from docs (doc_id, text) and labels (doc_id, toxic).

    The labels know one category; `severe` is made from it: toxic documents with SEVERE_HITS or more different features that
    are strong among the documents of the other folds. At most about max_rows ids of either label are used, and of rows that repeat an id one.
    """
    per_id = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    sample = bounded_sample(per_id.where("label = 1"), max_rows).unionByName(bounded_sample(per_id.where("label = 0"), max_rows))
    # the sample's size is bounded, so it may go to all executors, and the texts it picks may be kept
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = written(rows.withColumn("fold", fold_of(F.col("doc_id"), FOLDS).cast("int")), "toxicity-sample")
    (chosen, strong_all), *without = telling_features(written(feature_counts(rows), "toxicity-features"))
    chain = ToxicityChain(["severe", "toxic"], np.unique(np.concatenate([chosen, *(h for h, _ in without)])), chosen[strong_all])

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([chain.places(t).tolist() for t in texts.to_pylist()], pa.list_(pa.int64()))]

    placed = append_columns(rows, ["text"], [T.StructField("places", T.ArrayType(T.LongType()))], kernel, keep=["doc_id", "label", "fold"])
    got = placed.orderBy("doc_id").collect()
    if got:
        places, folds = [np.array(r.places, np.int64) for r in got], np.array([r.fold for r in got])
        toxic = np.array([r.label for r in got], np.float64)
        strong = np.array([np.isin(chain.chosen, h[s]) for h, s in without])
        severe = toxic * np.array([strong[f, p].sum() >= SEVERE_HITS for f, p in zip(folds, places)], np.float64)
        chain.fit(places, np.column_stack((severe, toxic)), folds, np.array([np.isin(chain.chosen, h) for h, _ in without]))
    return chain


def with_toxicity(docs: DataFrame, chain: ToxicityChain, keep: list[str] | None = None) -> DataFrame:
    """docs with p_severe and p_toxic of each whole text; a null or empty text has no feature and is scored as such."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def kernel(texts: pa.Array) -> list[pa.Array]:
        p = sent.value.probabilities([sent.value.places(t) for t in texts.to_pylist()])
        return [pa.array(p[:, k]) for k in range(p.shape[1])]

    return append_columns(docs, ["text"], [T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories], kernel, keep)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_severe, p_toxic and toxic (1 if p_toxic is 1/2 or more) of every document. Every fifth id is not learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    fold = fold_of(F.col("doc_id"), 5)
    chain = learn_chain(docs, read(spark, sf_dir, "labels").where(fold != 4).select("doc_id", "toxic"))
    held = F.coalesce(fold == 4, F.lit(False)).alias("held_out")
    return with_toxicity(docs, chain, keep=["doc_id"]).select("doc_id", held, "p_severe", "p_toxic", (F.col("p_toxic") >= 0.5).cast("int").alias("toxic"))
