"""Operator 13, byte-pair encoding and decoding by a pair occurrence index.

A partition's texts become words (the tokenizer's own normalizer and splits), each different word once. All symbols of
the new words stand in one array, and the index maps each merge's rank to all places where its pair stands. Ranks that
are active are applied in ascending order, each to all its places at once; the neighbours' new pairs join the lists of
their ranks. No shuffle: the work is a map over partitions, and a lost one is encoded again.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import append_columns, read

#: Different words whose ids a worker keeps.
CACHE_WORDS = 1_000_000
#: Text bytes whose new words are encoded together.
GROUP_BYTES = 4 << 20
#: Lower-case letters of ASCII and Latin-1 in UTF-8, read as Latin-1, and texts of these, digits and ASCII signs.
LETTER = "(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
SIMPLE = re.compile(f"(?:[!-@\\[-~]|{LETTER})+".encode("latin-1"))
#: Character classes in a tokenizer file's split, and what they come to in such texts.
ANY_LETTERS = (r"[\p{L}]+", LETTER + "+")
ANY_DIGIT = (r"[\p{N}]", "[0-9]")
ANY_SIGNS = (r"[^\s\p{L}\p{N}]+", r"[!-/:-@\[-`{-~]+")
FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairMerger:
    """A merge table as sorted arrays, and the pair occurrence index over symbols of many words."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        letters = byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        made_at = {a + b: r for r, (a, b) in enumerate(merges)}
        if len(made_at) < len(merges) or any(made_at.get(x, -1) >= r for r, m in enumerate(merges) for x in m):
            raise ValueError("ranks can be applied to all places at once only if each merge comes after those that make its parts")
        self.left, self.right, self.size = left, right, 1 << 32
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for none."""
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where((self.keys[at] == want) & (a >= 0) & (b >= 0), self.order[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit integers) of each word; none may be empty."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(data), np.cumsum(sizes)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Puts the pairs that begin at these places into the lists of their ranks."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, places in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(places)

        enter(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            at = at[(symbol[at] == a) & (nxt >= 0) & (symbol[nxt] == b)]
            if a == b and len(at) > 1:  # of a run of overlapping places every second one, from its first
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            far = after[gone]
            symbol[at], symbol[gone], after[at] = self.made[r], -1, far
            joined = far >= 0
            before[far[joined]] = at[joined]
            behind = before[at]
            touched = np.concatenate((behind[behind >= 0], at[joined]))
            if len(touched):
                enter(np.unique(touched))
        left = symbol >= 0
        ids, counts = symbol[left].astype("<u4").tobytes(), np.bincount(word[left], minlength=len(words))
        stops = (4 * np.cumsum(counts)).tolist()
        return [ids[s:e] for s, e in zip([0, *stops], stops)]


class Coder:
    """Encodes and decodes whole texts with a tokenizer file's vocabulary, merges, normalizer and splits; added tokens in a text get their ids."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        model = given["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merger = PairMerger(model["vocab"], merges, model["end_of_word_suffix"] or "")
        own = Tokenizer.from_file(path)
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        added = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.added = {k.encode(): np.array([v], "<u4").tobytes() for k, v in added.items()}
        self.cut = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + b")") if added else None
        tokens = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in added.items()}
        self.token = [tokens.get(i, "").encode() for i in range(max(tokens) + 1)]
        split = given["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex", "")
        self.short = re.compile(split.replace(*ANY_LETTERS).replace(*ANY_DIGIT).replace(*ANY_SIGNS).encode("latin-1")) if all(x in split for x, _ in (ANY_LETTERS, ANY_DIGIT, ANY_SIGNS)) else None
        self.byte = {c: b for b, c in byte_letters().items()}
        self.known: dict[bytes, bytes] = {}  # text between blanks -> ids
        self.piece: dict[bytes, bytes] = {}  # word after all splits -> ids

    def pieces(self, text: bytes) -> list[bytes]:
        """The words of a text between blanks, as the tokenizer cuts it. ASCII and Latin-1 lower-case letters need no normalizer."""
        if self.short is not None and SIMPLE.fullmatch(text):
            return self.short.findall(text)
        plain = self.normalizer.normalize_str(text.decode("utf-8", "replace"))
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(plain)]

    def learn(self, texts: list[bytes]) -> None:
        """Makes all of these texts between blanks known, older ones give way: words that are new are encoded together."""
        if sum(w not in self.known for w in texts) + len(self.known) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
        if len(self.piece) > CACHE_WORDS:
            self.piece = dict(islice(self.piece.items(), len(self.piece) // 2, None))
        texts = [w for w in texts if w not in self.known]  # only now: what gave way may be among them
        cut = [self.pieces(w) for w in texts]
        new = list({p for own in cut for p in own if p not in self.piece})
        self.piece.update(zip(new, self.merger.encode(new)))
        self.known.update(zip(texts, (b"".join([self.piece[p] for p in own]) for own in cut)))

    def encode_many(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null as the empty text."""
        out: list[bytes] = []
        lists: list[list[bytes | tuple[bytes]]] = []
        size = 0
        gc.disable()  # millions of words are no garbage
        try:
            for i, text in enumerate(texts):
                text = text or b""
                parts = self.cut.split(text) if self.cut is not None and b"<|" in text else [text]
                lists.append([w for k, p in enumerate(parts) for w in ([(p,)] if k % 2 else p.lower().split())])
                size += len(text)
                if size >= GROUP_BYTES or i + 1 == len(texts):
                    words = set().union(*lists)
                    self.learn([w for w in words if isinstance(w, bytes)])
                    own = {w: self.added[w[0]] for w in words if isinstance(w, tuple)}
                    known = self.known if not own else {w: self.known[w] for w in words if isinstance(w, bytes)} | own
                    out += [b"".join(map(known.__getitem__, x)) for x in lists]
                    lists, size = [], 0
        finally:
            gc.enable()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8: a file without decoder puts blanks between its tokens."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """This worker's coder, which keeps what it has learned from task to task."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def with_ids(docs: DataFrame, tokenizer: str | None = None, text: str = "text") -> DataFrame:
    """docs with `ids` (array of int) of each whole text, null as the empty text; a column of that name gives way."""
    path = tokenizer or default_tokenizer()

    def kernel(texts: pa.Array) -> list[pa.Array]:
        ids = coder(path).encode_many(texts.to_pylist())
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids])))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

    return append_columns(docs, [text], [T.StructField("ids", T.ArrayType(T.IntegerType()))], kernel)


def digests(docs: DataFrame, tokenizer: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (default all) with n_tokens, ids_sha256 and decoded_sha256 of each whole text, encoded and decoded again.

    Null and empty texts have no ids; their digests are those of nothing. Repeated rows stay. Columns of these names give way.
    """
    path = tokenizer or default_tokenizer()

    def kernel(texts: pa.Array) -> list[pa.Array]:
        own = coder(path)
        ids = own.encode_many(texts.to_pylist())
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids]), pa.array([sha(own.decode(x)) for x in ids])]

    return append_columns(docs, [text], FIELDS, kernel, keep=keep)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole document, as digests."""
    return digests(read(spark, sf_dir, "documents"), keep=["doc_id"])
