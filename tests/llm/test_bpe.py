"""Byte-pair encoding against the tokenizers library, and its edges."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

from wireloom.llm import bpe
from wireloom.llm.queries import QUERIES

from ..conftest import SMALL

ODD = [
    None, "", "  ", "<|endoftext|>a<|startoftext|> B<|endoftext|", "aaaaaaaaaa aaaaa ababab", "İstanbul ΑΣ. é ﬁ  x　y \x1c\x1d z\x85w don't'S'll 12 ³Ⅷ १२", "á ́b퟿\u0000 ﻿",
    "x" * 5000, "日本語のテキスト 한국어 ภาษา", "<|ENDOFTEXT|> é", "e<|endoftext|>́", "it' s 'sx ''s", "größe,naïve(ÿ)×÷", "ab " * 30_000,
]


def expected(texts):
    t = Tokenizer.from_file(bpe.default_tokenizer())
    for x in texts:
        ids = t.encode(x or "", add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_against_library(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_bpe"](spark, SMALL).collect()}
    assert got == dict(zip([r.doc_id for r in rows], expected([r.text for r in rows])))


def test_odd_texts_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(i % 5 or None, x, "mine", i) for i, x in enumerate(ODD + ODD)], "doc_id long, text string, ids string, n_tokens long")
    got = [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()]
    assert got == list(expected(ODD + ODD))
    ids = [r.ids for r in bpe.with_ids(docs).collect()]
    assert [len(x) for x in ids] == [n for n, _, _ in got]
    assert bpe.digests(docs.limit(0)).count() == 0


def test_little_memory_for_words(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 8)
    own = bpe.Coder(bpe.default_tokenizer())
    texts = [x for x in ODD if x and len(x) < 100]
    ids = own.encode_many([x.encode() for x in texts])
    assert [hashlib.sha256(x).hexdigest() for x in ids] == [h for _, h, _ in expected(texts)]


def test_words_that_give_way_are_learned_again(monkeypatch):
    """Words of a group that are known when it begins are still known after older ones gave way to its new ones."""
    monkeypatch.setattr(bpe, "CACHE_WORDS", 6)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 1)
    own = bpe.Coder(bpe.default_tokenizer())
    texts = ["one two three four five", "one two six seven eight"]
    ids = own.encode_many([x.encode() for x in texts])
    assert [hashlib.sha256(x).hexdigest() for x in ids] == [h for _, h, _ in expected(texts)]
