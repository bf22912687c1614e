"""Operator 8, benchmark decontamination: size-partitioned MinHash containment search.

The items' word shingles are the vocabulary. A document's domain is its shingles in that vocabulary: what
it loses could match no item, so containments stay exact while a document of any length shrinks to about
the sizes of the items in it. Domains are partitioned by size; within a partition the containment threshold
becomes a least Jaccard similarity, and so bands and rows of a banded MinHash index that miss a true match with
probability MISS or less. Partitions where no banding is that safe are searched by an inverted list, exactly.
Every candidate is verified by exact containment of shingle strings. Large benchmarks are searched in blocks of
bounded size, each a scan of the documents without shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import append_columns, col, fresh, mix64, read, row_key, short_batches, written

HASHES = 256
MISS = 1e-6
#: Bytes of item texts in one block, whose index, some 20 times that with its tables, is sent to all executors.
BLOCK_CHARS = 4_000_000
#: Upper-case ASCII letters fall to lower case, ASCII punctuation and control characters become blanks.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def folded_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


class WordHash(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 19:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` word hashes."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            total += hashes[i : i + n] * WEIGHTS[i]
    return mix64(total)


class ContainmentIndex:
    """Items (id, text), searched for those whose shingles lie in a document to `threshold` or more: sorted arrays of hashes, and the folded texts for the exact check."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = 5, threshold: float = 0.8) -> None:
        self.threshold, cache = threshold, WordHash()
        self.ids: list[object] = []
        self.texts: list[bytes] = []
        self.width_of: list[int] = []
        own: list[np.ndarray] = []
        for item, text in items:
            words = folded_words(text)
            if words:
                w = min(width, len(words))
                self.ids.append(item)
                self.texts.append(b" ".join(words))
                self.width_of.append(w)
                own.append(np.unique(shingle_hashes(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), w)))
        self.vocabulary, places = np.unique(np.concatenate([*own, np.zeros(0, np.uint64)]), return_inverse=True)
        self.shingles, self.sizes = places.astype(np.int32), np.array([len(h) for h in own], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.widths = sorted(set(self.width_of))
        self.need = np.ceil(threshold * self.sizes - 1e-9).astype(np.int64)
        self.least = int(self.need.min(initial=np.iinfo(np.int64).max)) if len(self.need) else 0
        bits = max(16, (8 * len(self.vocabulary)).bit_length() + 1)
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.vocabulary & self.mask] = True
        self.seeds = mix64(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) | np.uint64(1)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, k: int) -> np.ndarray:
        return self.shingles[self.starts[k] : self.starts[k + 1]]

    def signature(self, ids: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(ids), 4096):
                part = mix64(ids[at : at + 4096].astype(np.uint64) + np.uint64(1))
                np.minimum(least, mix64(part[None, :] * self.seeds[:, None]).min(axis=1), out=least)
        return least

    def bands(self, signature: np.ndarray, rows: int) -> np.ndarray:
        parts = signature.reshape(-1, rows)
        with np.errstate(over="ignore"):
            keys = (parts * WEIGHTS[:rows]).sum(axis=1, dtype=np.uint64) + np.arange(len(parts), dtype=np.uint64) * WEIGHTS[rows]
        return mix64(keys)

    def rows_for(self, upper: int) -> int:
        """Rows a band for domains of `upper` or fewer shingles; 0: no banding finds enough."""
        q = int(self.sizes[self.need <= upper].min(initial=upper)) or 1
        jaccard = self.threshold * q / (q + upper - self.threshold * q)
        return next((r for r in (4, 2, 1) if (1 - jaccard**r) ** (HASHES // r) <= MISS), 0)

    def table(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys in order, items): the bands of all items; for 0 rows the shingles themselves."""
        if rows not in self.tables:
            if rows:
                keys, per = np.concatenate([self.bands(self.signature(self.of(k)), rows) for k in range(len(self.ids))]), np.full(len(self.ids), HASHES // rows)
            else:
                keys, per = self.shingles.astype(np.uint64), self.sizes
            items, order = np.repeat(np.arange(len(self.ids), dtype=np.int32), per), np.argsort(keys, kind="stable")
            self.tables[rows] = keys[order], items[order]
        return self.tables[rows]

    def domain(self, hashes: np.ndarray) -> np.ndarray:
        """The shingles of a text, by its words' hashes, that some item has."""
        found = [np.zeros(0, np.int64)]
        for w in self.widths:
            h = shingle_hashes(hashes, w)
            h = h[self.maybe[h & self.mask]]
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            found.append(at[self.vocabulary[at] == h])
        return np.unique(np.concatenate(found))

    def search(self, text: bytes | None, cache: WordHash) -> list[tuple[int, int]]:
        """(item's position, shingles shared) of every item found in the text."""
        words = folded_words(text)
        if not words or not self.ids:
            return []
        domain = self.domain(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        if not len(domain) or len(domain) < self.least:
            return []
        rows = self.rows_for(1 << (len(domain) - 1).bit_length())
        keys, items = self.table(rows)
        asked = self.bands(self.signature(domain), rows) if rows else domain.astype(np.uint64)
        low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
        candidates = np.unique(np.concatenate([items[l:h] for l, h in zip(low.tolist(), high.tolist()) if h > l] or [np.zeros(0, np.int32)]))
        out: list[tuple[int, int]] = []
        strings: dict[int, set[bytes]] = {}
        for k in candidates.tolist():
            own = self.of(k)
            at = np.minimum(np.searchsorted(domain, own), len(domain) - 1)
            if np.count_nonzero(domain[at] == own) < self.need[k]:
                continue
            w = self.width_of[k]
            if w not in strings:
                strings[w] = {b" ".join(words[i : i + w]) for i in range(len(words) - w + 1)}
            mine = self.texts[k].split(b" ")
            shared = len({b" ".join(mine[i : i + w]) for i in range(len(mine) - w + 1)} & strings[w])
            if shared >= self.need[k]:
                out.append((k, shared))
        return out


class ItemIndexes:
    """The indexes of a table of items (item_id, text), block by block: each is made when asked for, so that the driver holds one.

    Items are dealt into blocks by Spark, in a written table, about block_chars bytes of text each; items that repeat count
    once, null texts not at all.
    """

    def __init__(self, items: DataFrame, width: int, threshold: float, block_chars: int = BLOCK_CHARS) -> None:
        self.width, self.threshold = width, threshold
        slim = items.where("text is not null").select("item_id", F.col("text").cast("binary").alias("text")).distinct()
        slim = written(slim, "items")
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.n = max(1, ceil(size / block_chars))
        self.items = slim if self.n == 1 else written(slim.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(self.n)).cast("int")).repartition("block"), "item-blocks")

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[ContainmentIndex]:
        for k in range(self.n):
            rows = self.items if self.n == 1 else self.items.where(F.col("block") == k)
            yield ContainmentIndex([(r.item_id, bytes(r.text)) for r in rows.orderBy("item_id", "text").toLocalIterator()], self.width, self.threshold)


def item_indexes(items: DataFrame, width: int, threshold: float, block_chars: int = BLOCK_CHARS) -> ItemIndexes:
    return ItemIndexes(items, width, threshold, block_chars)


def each_block(docs: DataFrame, indexes: ItemIndexes, scan: Callable[[DataFrame, Broadcast], DataFrame], name: str) -> DataFrame:
    """scan(docs, index) over all blocks of items: one block needs no more than that; more are scanned one after the other, each one's few rows written before the next index is made."""
    sc, found = docs.sparkSession.sparkContext, None
    for index in indexes:
        sent = sc.broadcast(index)
        part = scan(docs, sent)
        if len(indexes) > 1:
            part = written(part, name)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def contaminated(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every item found in a document.

    docs: doc_id, text. items: item_id, text. Shingles are runs of `width` folded words (lower case, no
    ASCII punctuation); a shorter item is one shingle, its whole sequence. Null or wordless texts match nothing; a
    document that repeats gives its pairs again, an item that repeats does not; an empty table on either side gives no pair.
    Other columns are not read. Items of over block_chars bytes are searched in blocks, each a scan of the documents.
    """
    short_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType),
        T.StructField("item_shingles", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("containment", T.DoubleType()),
    ])
    kind = to_arrow_type(schema["item_id"].dataType)

    def scan(docs: DataFrame, sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, cache = sent.value, WordHash()
            for b in batches:
                at, hits = [], []
                for i, text in enumerate(b.column(1)):
                    own = index.search(text.as_py(), cache)
                    at += [i] * len(own)
                    hits += own
                size = np.array([index.sizes[k] for k, _ in hits], np.int64)
                shared = np.array([n for _, n in hits], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at, pa.int64())), pa.array([index.ids[k] for k, _ in hits], kind), pa.array(size), pa.array(shared), pa.array(shared / np.maximum(size, 1))],
                    names=schema.names,
                )

        return docs.mapInArrow(run, schema)

    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return each_block(slim, item_indexes(items, width, threshold, block_chars), scan, "contaminated")


def clean_documents(docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs, whole rows, without those in which an item is found.

    With one block of items that is one narrow pass; with more, each block's scan gives the keys of the rows to drop, and the rows go by an anti-join.
    """
    indexes = item_indexes(items, width, threshold, block_chars)
    clean, key = fresh(docs.columns, "clean", "row_key")

    def marked(docs: DataFrame, sent: Broadcast) -> DataFrame:
        cache = WordHash()

        def kernel(texts: pa.Array) -> list[pa.Array]:
            return [pa.array([not sent.value.search(t.as_py(), cache) for t in texts], pa.bool_())]

        return append_columns(docs, ["text"], [T.StructField(clean, T.BooleanType())], kernel, [c for c in docs.columns if c != "text" or len(indexes) == 1])

    if len(indexes) == 1:
        return each_block(docs, indexes, marked, "clean").where(F.col(clean)).select(*[col(c) for c in docs.columns])
    of = row_key(F.col("doc_id"), F.col("text")).alias(key)
    dropped = each_block(docs.select("text", of), indexes, lambda d, sent: marked(d, sent).where(~F.col(clean)).select(key), "contaminated").distinct()
    return docs.withColumn(key, of).join(dropped, key, "left_anti").select(*[col(c) for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item whose five-word shingles it holds to 0.8 or more."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select("item_id", "text"))
