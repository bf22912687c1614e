"""Ranked search against brute force and its edges."""

import re
from collections import Counter
from math import floor, log

from wireloom.llm import lexical
from wireloom.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL, same_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k=20):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c, c.total()) for d, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for i, t in items:
        scored = []
        for d, c, n in own:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(r * floor(1000 * log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, r in Counter(terms(t)).items() if w in c)
            if s > 0:
                scored.append((-s, d is None, d, s))
        out += [(i, rank, d, s) for rank, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_query_against_brute_force_and_sql(spark, duck):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    result = QUERIES["op12_search"](spark, SMALL)
    assert got(result) == expected(docs, items)
    names, ours, theirs = same_rows(result, duck, ORACLE_SQL["op12_search"])
    assert names and ours == theirs


DOCS = [(i, " ".join(["common"] * (i % 7) + [f"w{i % 11}", f"w{i % 5}", "ÄÖ", "É-Kant_x9"] + ["pad"] * (i % 3))) for i in range(300)] + [(None, "rare common"), (7, "rare common"), (7, "rare common"), (500, None), (501, ""), (502, "... !"), (503, "common " * 20_000)]
ITEMS = [(1, "Common RARE rare"), (1, "w3 w3 w4 common pad"), (2, None), (3, "?!"), (4, "äö ÄÖ kant"), (None, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 common pad x9"), (6, "unknown")]


def test_ties_repeats_nulls_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, score string, rank int").repartition(5)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    want = expected(DOCS, ITEMS)
    assert got(lexical.search(docs, items)) == want
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 40)
    monkeypatch.setattr(lexical, "HELD_ENTRIES", 10)
    assert got(lexical.search(docs, items)) == want
    assert got(lexical.search(docs, items, 3)) == expected(DOCS, ITEMS, 3)
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
