"""Operator 1, language identification by a bit-sliced Bloom filter of letter trigrams.

Every slot of the filter is a mask with a bit per language; a trigram's languages are the AND of the masks at
its hashed slots, so one probe asks all languages at once. A document's popcount of language l is corrected for l's
false positives (its share of set slots to the power of the number of hashes); the largest corrected count decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fold_of, mix64, read, short_batches

HASHES = 3
#: Share of a language's trigrams that a trigram needs, which bounds a language to 1 / MIN_SHARE of them.
MIN_SHARE = 5e-5
#: A trigram whose share is under this part of its largest share in any language is left out: most likely noise.
MIN_RELATIVE = 0.2
#: Characters worked on at once.
BLOCK_CHARS = 1 << 19
NO_LETTER = re.compile(r"[\W\d_]")
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigram_blocks(texts: list[bytes | None], owners: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigrams, owner of each) block by block: lower-case letters with runs of anything else as one blank, the middle one a letter.

    A longer text is cut after BLOCK_CHARS where no letter stands, so the pieces have its trigrams and no others.
    """
    pieces: list[str] = []
    whose: list[int] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer((" " + " ".join(pieces) + " ").encode("utf-32-le", "replace"), np.uint32)
        codes = np.where(letters()[codes], codes, np.uint32(32))
        firsts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
        mark = np.zeros(len(codes), np.int32)
        mark[firsts] = 1
        keep = np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))
        owner = (np.cumsum(mark) - 1)[keep]
        c = codes[keep].astype(np.uint64)
        good = np.flatnonzero(c[1:-1] != 32)
        # a blank that two pieces share stands for the one before; the letter after it knows its own piece
        return c[good] | c[good + 1] << np.uint64(21) | c[good + 2] << np.uint64(42), np.asarray(whose)[owner[good + 1]]

    for text, owner in zip(texts, owners):
        s = (text or b"").decode("utf-8", "replace").lower()
        at = 0
        while at < len(s) or not at:
            cut = NO_LETTER.search(s, at + BLOCK_CHARS)
            piece = s[at : cut.start() if cut else len(s)]
            at += len(piece) or 1
            pieces.append(piece)
            whose.append(owner)
            size += len(piece) + 1
            if size >= BLOCK_CHARS:
                yield packed()
                pieces, whose, size = [], [], 0
    if pieces:
        yield packed()


def trigram_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all rows with a language; each task adds up its own counts first."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, (g, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            sums.clear()

        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in dict.fromkeys(langs):
                own = [t for x, t in zip(langs, texts) if x == name]
                for grams, _ in trigram_blocks(own, [0] * len(own)):
                    g, n = np.unique(grams, return_counts=True)
                    if name in sums:
                        both, at = np.unique(np.concatenate((sums[name][0], g)), return_inverse=True)
                        g, n = both, np.bincount(at, np.concatenate((sums[name][1], n))).astype(np.int64)
                    sums[name] = g, n
            if sum(len(g) for g, _ in sums.values()) > 1_000_000:
                yield from rows()
        yield from rows()

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The bit-sliced filter; planes[w][slot] has bits of languages 64 w to 64 w + 63."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray]) -> None:
        self.langs = langs
        most = max((len(g) for g in grams.values()), default=1)
        self.slots = 1 << max(10, (12 * most - 1).bit_length())
        self.planes = np.zeros((max(1, -(-len(langs) // 64)), self.slots), np.uint64)
        for i, name in enumerate(langs):
            for at in self.places(grams[name]):
                self.planes[i // 64, at] |= np.uint64(1 << (i % 64))
        full = [np.count_nonzero(self.planes[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / self.slots for i in range(len(langs))]
        self.false_rate = np.array(full) ** HASHES

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        x = mix64(grams)
        m = np.uint64(self.slots - 1)
        return [(x >> np.uint64(20 * i)) & m for i in range(HASHES)]

    def popcounts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(trigrams of each text, texts x languages counts of those that the filter has)."""
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for grams, owner in trigram_blocks(texts, list(range(len(texts)))):
            n += np.bincount(owner, minlength=len(texts))
            places = self.places(grams)
            for w, plane in enumerate(self.planes):
                mask = plane[places[0]]
                for p in places[1:]:
                    mask &= plane[p]
                for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                    hits[:, i] += np.bincount(owner[(mask >> np.uint64(i % 64) & np.uint64(1)).view(np.int64).astype(bool)], minlength=len(texts))
        return n, hits

    def decide(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """(language, corrected share of trigrams) of each text; ties go to the first language by code point."""
        n, hits = self.popcounts(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        right = (hits - n[:, None] * self.false_rate) / (1 - self.false_rate)
        best = right.argmax(axis=1)
        score = np.clip(right[np.arange(len(texts)), best] / np.maximum(n, 1), 0, 1)
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], score


def learn_filter(docs: DataFrame, min_share: float = MIN_SHARE) -> LanguageFilter:
    """The filter of all languages of docs (lang, text). At most 1 / min_share trigrams a language reach the driver."""
    counts = trigram_counts(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share")).where(F.col("share") >= min_share)
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("most", most).where(F.col("share") >= MIN_RELATIVE * F.col("most")).select("lang", "gram").toPandas()
    grams = {name: g["gram"].to_numpy().view(np.uint64) for name, g in kept.groupby("lang")}
    return LanguageFilter(sorted(grams), grams)


def with_language(docs: DataFrame, learned: LanguageFilter, keep: list[str] | None = None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score; a null text or one without letters is `und`, with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def kernel(texts: pa.Array) -> list[pa.Array]:
        names, scores = sent.value.decide(texts.to_pylist())
        return [pa.array(names, pa.string()), pa.array(scores)]

    return append_columns(docs, ["text"], [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], kernel, keep)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: not of fold 0 of 5, and with a language. A null id is in no fold and not learned from."""
    return docs.where((fold_of(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull()).select("lang", "text")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = read(spark, sf_dir, "documents")
    learned = learn_filter(training_rows(docs))
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return with_language(docs.select("doc_id", "text"), learned, keep=["doc_id"]).select("doc_id", held, "lang_pred", "score")
