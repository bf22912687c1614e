"""Operator 9, token ids as wavelet matrices: one compressed file per shard of documents in ascending doc_id order.

A shard file holds its documents' ids (as 64-bit integers), their token offsets, and the tokens as a wavelet
matrix: one bit-plane per bit of an id, most significant first, each stably dealt by the plane before it, with the
plane's zeros counted and its ones summed every BLOCK_BITS bits. From these a reader gets any token, the count of
an id in any prefix and the place of its k-th occurrence without decoding the rest.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, read, scratch_path, short_batches

MAGIC = b"WLWM\x01"
BLOCK_BITS = 512
#: Tokens after which a shard is closed; a document is never split.
SHARD_TOKENS = 1 << 19
#: Words whose ids a worker keeps.
CACHE_WORDS = 1_600_000
#: Words, a line each: ASCII signs, letters (ASCII in lower case or any others), ASCII signs; or else anything. An apostrophe in front may start a contraction.
PARTS = re.compile(rb"(?m)^([!-&(-/:-@\[-`{-~]*)([a-z\x80-\xff]+)([!-/:-@\[-`{-~]*)$|^(.+)$")
#: Lower-case letters of Latin-1, in UTF-8.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
END_ID = 1


class WordEncoder:
    """Texts to ids, blank by blank: the pre-tokenizer drops white space, so words between ASCII blanks encode alone.

    Right for lower-casing tokenizers that drop white space, never merge across the border of letters and signs, and mark the ends of words.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower-case letters of Latin-1 between blanks need no normalizer and no other split
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {b"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def learn_letters(self, words: list[bytes], tokenizer) -> list[bytes]:
        """Makes words of letters known, many at a time: each ends with the one id that ends a word. Returns those for which that fails."""
        failed, groups = [], [words[at : at + 256] for at in range(0, len(words), 256)]
        for group, own in zip(groups, tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(own.ids, np.uint32)
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(group):
                self.known.update(zip(group, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends))))
            else:
                failed += group
        return failed

    def learn(self, words: list[bytes]) -> None:
        """Makes all of words known, older ones give way: a word of signs, letters and signs from its parts, any other as it is."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known = {b"": b""} | dict(islice(self.known.items(), len(self.known) // 2 + len(words), None))
        known, rest, made = self.known, set(), []
        plain = {w for w in words if w.isalpha() and w.islower()}
        wide, mixed = set(), [w for w in words if w not in plain]
        for w, (before, core, after, other) in zip(mixed, PARTS.findall(b"\n".join(mixed))):
            if other or b"<|" in before or not (core.isascii() or core.decode().isalpha()):
                rest.add(w)
                continue
            if core not in known:
                (plain if core.isalpha() or LATIN.fullmatch(core) else wide).add(core)
            if before or after:
                made.append((w, before, core, after))
                if before not in known:
                    rest.add(before)
                if after not in known:
                    rest.add(after)
        rest.update(self.learn_letters(list(plain), self.bare), self.learn_letters(list(wide), self.tokenizer))
        rest = list(rest)
        for w, own in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            known[w] = np.array(own.ids, np.uint32).tobytes()
        for w, before, core, after in made:
            known[w] = known[before] + known[core] + known[after]

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (UTF-8; null: none) as little-endian unsigned 32-bit integers.

        Arrow splits the texts and numbers their different words, each of which is looked up once; what a text's words take
        from the looked-up ids lies one behind the other.
        """
        texts = pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset).fill_null("")
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(lower)
        numbered = lists.flatten().dictionary_encode()
        gc.disable()  # many words are no garbage
        try:
            words = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.known.get, words))
            new = [i for i, ids in enumerate(found) if ids is None]
            self.learn([words[i] for i in new])
            for i in new:
                found[i] = self.known[words[i]]
        finally:
            gc.enable()
        ids = pa.array(found, pa.large_binary()).take(numbered.indices)
        words_before = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[words_before].tolist() if len(ids) else [0] * len(words_before)
        data = memoryview(ids.buffers()[2] or b"") if len(ids) else memoryview(b"")
        return [bytes(data[start:end]) for start, end in zip(ends, ends[1:])]

    def encode(self, text: bytes | None) -> bytes:
        return self.encode_many(pa.array([text], pa.binary()))[0]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder: it keeps what it has learned from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Unpacked(Sequence):
    """Compressed arrays, each unpacked when it is first asked for."""

    def __init__(self, parts: list[bytes], kind: str) -> None:
        self.parts, self.kind = parts, kind
        self.made: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.parts)

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self.made:
            self.made[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.parts[k]), self.kind)
        return self.made[k]


class WaveletMatrix:
    """Bit-planes of a sequence of ids with rank and select."""

    def __init__(self, n: int, planes: Sequence[np.ndarray], zeros: list[int], ranks: Sequence[np.ndarray] | None = None) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ranks: Sequence[np.ndarray | None] = [None] * len(planes) if ranks is None else ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        now, planes, zeros = ids.astype(np.uint32), [], []
        if len(ids) and int(ids.max()) < 1 << 16:
            now = now.astype(np.uint16)
        for b in range((int(ids.max()) if len(ids) else 0).bit_length() - 1, -1, -1):
            bit = (now & (1 << b)) != 0
            planes.append(np.packbits(bit))
            rest = now[~bit]
            zeros.append(len(rest))
            now = np.concatenate((rest, now[bit]))
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids, in order: from the last plane up, each undoes its own dealing."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            above[bit] = now[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            above[~bit] = now[: self.zeros[k]]
            now = above
        return now.astype(np.uint32)

    def ranks(self, k: int) -> np.ndarray:
        if self._ranks[k] is None:
            step = BLOCK_BITS // 8
            padded = np.zeros(-(-len(self.planes[k]) // step) * step, np.uint8)
            padded[: len(self.planes[k])] = self.planes[k]
            self._ranks[k] = np.concatenate(([0], np.cumsum(np.bitwise_count(padded).reshape(-1, step).sum(axis=1, dtype=np.int64))))
        return self._ranks[k]

    def rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        block = i // BLOCK_BITS
        bits = np.unpackbits(self.planes[k][block * (BLOCK_BITS // 8) : -(-i // 8)])
        return int(self.ranks(k)[block]) + int(bits[: i - block * BLOCK_BITS].sum())

    def access(self, i: int) -> int:
        value = 0
        for k, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (7 - (i & 7)) & 1
            ones = self.rank1(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, symbol: int, i: int) -> tuple[int, int]:
        low = 0
        if symbol >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            if symbol >> (len(self.planes) - 1 - k) & 1:
                low, i = self.zeros[k] + self.rank1(k, low), self.zeros[k] + self.rank1(k, i)
            else:
                low, i = low - self.rank1(k, low), i - self.rank1(k, i)
        return low, i

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol among the first i ids."""
        low, high = self._span(symbol, i)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of symbol; -1 if there are not so many."""
        low, high = self._span(symbol, self.n)
        if k >= high - low:
            return -1
        at = low + k
        for lev in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - lev) & 1
            want = at - self.zeros[lev] if one else at
            total = self.ranks(lev)
            if not one:
                total = np.arange(len(total)) * BLOCK_BITS - total
            block = max(int(np.searchsorted(total, want, side="right")) - 1, 0)
            step = BLOCK_BITS // 8
            bits = np.unpackbits(self.planes[lev][block * step : (block + 1) * step])
            at = block * BLOCK_BITS + int(np.flatnonzero(bits == one)[want - int(total[block])])
        return at


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, start: int) -> bytes:
    """A shard file. start: tokens before it in its range of documents."""
    wm, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    valid = np.array([x is not None for x in doc_ids], bool)
    parts = [pack(np.packbits(valid).tobytes()), pack(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), pack(lengths.astype("<i8").tobytes())]
    for k, plane in enumerate(wm.planes):
        parts += [pack(plane.tobytes()), pack(wm.ranks(k).astype("<i8").tobytes())]
    head = MAGIC + struct.pack("<qqqi", start, len(doc_ids), wm.n, len(wm.planes)) + struct.pack(f"<{len(wm.planes)}q", *wm.zeros)
    return head + struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def open_shard(data: bytes) -> tuple[int, list[int | None], np.ndarray, WaveletMatrix]:
    """(start, doc ids, token counts, wavelet matrix) of a shard file; a bit-plane is unpacked when it is first needed."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = len(MAGIC)
    start, n_docs, n, levels = struct.unpack_from("<qqqi", data, at)
    at += 28
    zeros = list(struct.unpack_from(f"<{levels}q", data, at))
    at += 8 * levels
    sizes = struct.unpack_from(f"<{3 + 2 * levels}q", data, at)
    at += 8 * len(sizes)
    parts = []
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    own = Unpacked(parts[:3], "u1")
    valid = np.unpackbits(own[0], count=n_docs)
    doc_ids = [x if v else None for x, v in zip(own[1].view("<i8").tolist(), valid.tolist())]
    return start, doc_ids, own[2].view("<i8"), WaveletMatrix(n, Unpacked(parts[3::2], "u1"), zeros, Unpacked(parts[4::2], "<i8"))


def write_shards(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shard files of docs (integer doc_id, text) under `path`, through Spark's writer: rows (range, shard, n_tokens, data), one shard a file's row group.

    Ranges of doc_id come from quantiles of that column alone; texts are encoded where they are read and only ids are
    shuffled. A range is streamed in order through one task, shard by shard, so memory holds one shard. A doc_id that
    several quantiles fall on, and many null ones, have several ranges, dealt by a checksum of the ids. Rows of one doc_id
    are ordered by range and ids, null doc_ids come last, a null text has the end id alone.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n_ranges = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = np.array(sorted(docs.approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.25 / n_ranges)))
    rows = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id")).first()
    null_ranges = 1 + n_ranges * (rows.n - rows.with_id) // max(rows.n, 1)
    tail = np.array([end_id], np.uint32).tobytes()

    def kernel(doc_ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        given = doc_ids.to_pylist()
        known = np.array([0 if d is None else d for d in given], np.int64)
        low, high = np.searchsorted(cuts, known, "left").tolist(), np.searchsorted(cuts, known, "right").tolist()
        ids = [np.frombuffer(x + tail, np.uint32) for x in encoder(tokenizer).encode_many(texts)]
        narrow = [b"\x02" + x.astype(np.uint16).tobytes() if x.max() < 1 << 16 else b"\x04" + x.tobytes() for x in ids]
        part = [len(cuts) + 1 + zlib.crc32(x) % null_ranges if d is None else h if h - l < 2 else l + 1 + zlib.crc32(x) % (h - l) for d, l, h, x in zip(given, low, high, narrow)]
        return [pa.array(part, pa.int32()), pa.array(narrow, pa.binary())]

    slim = docs.select("doc_id", "text")
    coded = append_columns(slim, ["doc_id", "text"], [T.StructField("range", T.IntegerType()), T.StructField("ids", T.BinaryType())], kernel, keep=["doc_id"])
    coded = coded.repartition("range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_last(), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"range": None, "shard": 0, "start": 0}
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held
            data = shard_bytes(doc_ids, np.array([len(x) for x in ids], np.int64), np.concatenate(ids), state["start"])
            row = [pa.array([state["range"]], pa.int32()), pa.array([state["shard"]], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            state["shard"] += 1
            state["start"] += held
            doc_ids, ids, held = [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["range", "shard", "n_tokens", "data"])

        for b in batches:
            for d, r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if r != state["range"]:
                    if ids:
                        yield closed()
                    state |= {"range": r, "shard": 0, "start": 0}
                doc_ids.append(d)
                ids.append(np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield closed()
        if ids:
            yield closed()

    coded.mapInArrow(run, "range int, shard int, n_tokens long, data binary").write.option("compression", "none").option("parquet.block.size", str(8 << 20)).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shard files under `path`.

    start counts the ids of all documents before it: the totals of the ranges, a number set by the writer and not by the
    data, are summed on the driver; places within a range are in the files.
    """
    shards = spark.read.schema("range int, shard int, n_tokens long, data binary").parquet(path)
    totals = {r["range"]: r["n"] for r in shards.groupBy("range").agg(F.sum("n_tokens").alias("n")).collect()}
    base, so_far = {}, 0
    for k in sorted(totals):
        base[k], so_far = so_far, so_far + totals[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, data in zip(b.column(0).to_pylist(), b.column(1)):
                start, doc_ids, lengths, wm = open_shard(data.as_py())
                ids = memoryview(wm.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(base[r] + start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("range", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as shard files in the shared folder and returns what read_shards finds there."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("word_bpe_49k.json"))
    path = scratch_path(docs.sparkSession, "shards")
    write_shards(docs.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, path)
    return read_shards(docs.sparkSession, path)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the shard files."""
    return encode_and_read_back(read(spark, sf_dir, "documents"))
