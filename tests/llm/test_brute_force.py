"""Each operator against a plain version on the small tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wireloom.llm import chat, common, decontam, langid, mixing, passages, quality_model, simhash, tokens, toxicity
from wireloom.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL, same_rows


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in common.read(spark, SMALL, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    named, got, want = same_rows(QUERIES[name](spark, SMALL), duck, ORACLE_SQL[name])
    assert named and got == want


def test_language_accuracy(spark):
    docs = common.read(spark, SMALL, "documents").select("doc_id", "lang")
    rows = QUERIES["op1_langid"](spark, SMALL).join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95


def test_language_masks_agree_with_sets():
    grams = {"a": np.arange(1, 900, dtype=np.uint64), "b": np.arange(600, 1500, dtype=np.uint64)}
    f = langid.LanguageFilter(["a", "b"], grams)
    x = np.arange(1, 3000, dtype=np.uint64)
    p = f.places(x)
    mask = f.planes[0][p[0]] & f.planes[0][p[1]] & f.planes[0][p[2]]
    for i, name in enumerate("ab"):
        has = (mask >> np.uint64(i) & np.uint64(1)).astype(bool)
        assert has[np.isin(x, grams[name])].all() and has[~np.isin(x, grams[name])].mean() < 0.05


def plain_simhash(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def union(edges, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_simhash_and_components(spark, texts):
    fp = {d: plain_simhash(t) for d, t in texts.items()}
    ids = list(fp)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 3]
    want = union(edges, ids)
    got = QUERIES["op2_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_planted_fingerprints_in_blocks(spark, monkeypatch):
    """Chains at distances 1 to 3, a dense ball, and a bucket dealt into blocks."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:100].tolist():
        for _ in range(4):
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps |= {int(base[0]) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    monkeypatch.setattr(simhash, "BLOCK", 64)
    ids = sorted(fps)
    arr = np.array(ids, np.uint64)
    want = union([(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 3) + i + 1], ids)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    for probes in (None, [(list(range(0, 22)), 1), (list(range(22, 43)), 0), (list(range(43, 64)), 0)], [(list(range(0, 32)), 1), (list(range(32, 64)), 1)]):
        with monkeypatch.context() as m:
            if probes:
                m.setattr(simhash, "plan_probes", lambda *a, probes=probes: probes)
            roots = {r.node: r.root for r in common.components(simhash.fingerprint_links(df)).collect()}
        groups = defaultdict(set)
        for x, s in zip(ids, arr.view(np.int64).tolist()):
            groups[want[x]].add(roots.get(s, s))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_allocation_is_the_cheapest():
    costs = [{-1: 0.0, 0: 5.0, 1: 9.0}, {-1: 0.0, 0: 50.0, 1: 51.0}, {-1: 0.0, 0: 1.0, 1: 100.0}]
    assert simhash.allocate(costs, 1) == min(((costs[0][a] + costs[1][b] + costs[2][c], [a, b, c]) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 1), key=lambda x: x[0])


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1001), (1001, 1000), (7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}


def test_mixing_meets_targets(spark):
    docs = common.read(spark, SMALL, "documents")
    rows = QUERIES["op4_mixing"](spark, SMALL).join(docs.select("doc_id", "source"), "doc_id").collect()
    again = {r.doc_id: r.taken for r in QUERIES["op4_mixing"](spark, SMALL).collect()}
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    share, target, free = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    left = float(sum(size.values()))
    while free:
        level = left / sum(share[s] for s in free)
        over = [s for s in free if level * share[s] > 3 * size[s]]
        if not over:
            target |= {s: level * share[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    taken = Counter()
    for r in rows:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == size[r.source]
        assert r.taken in {k * r.size for k in range(4)} and again[r.doc_id] == r.taken
        taken[r.source] += r.taken
    largest = {s: max(r.size for r in rows if r.source == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\<>|/[]sINTim_endstartSYpof ab\n"))
def test_escapes_are_reversible(text):
    import re

    safe = re.sub(chat.CONTROL, r"\1\\\2", text.replace("\\", "\\\\"))
    assert re.sub(r"\\(\\?)", r"\1", safe) == text
    assert not any(c in safe for c in ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]"))


def test_containment_against_sets(spark, texts):
    items = {r.item_id: r.text for r in common.read(spark, SMALL, "benchmark").collect()}
    shingles = lambda t: {b" ".join(w[i : i + 5]) for w in [decontam.folded_words(t.encode())] for i in range(max(len(w) - 4, 1))}
    sets = {i: shingles(t) for i, t in items.items()}
    want = {(d, i) for d, t in texts.items() if t for own in [shingles(t)] for i, s in sets.items() if len(own & s) >= 0.8 * len(s)}
    got = QUERIES["op8_decontaminate"](spark, SMALL).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want


def test_containment_of_large_domains_and_blocks(spark):
    rng = np.random.default_rng(3)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 12))) for i in range(400)]
    docs = [(1, " ".join(t for _, t in items)), (2, " ".join(t for _, t in items[:40])), (3, items[7][1]), (4, items[9][1][:20])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(1, i) for i in range(400)} | {(2, i) for i in range(40)} | {(3, 7)}
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == want
    assert len(decontam.item_indexes(b, 5, 0.8, block_chars=5000)) > 3


def test_token_shards_round_trip(spark, texts, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    t, start = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))), 0
    got = {r.doc_id: r for r in QUERIES["op9_token_shards"](spark, SMALL).collect()}
    for d in sorted(texts):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_ids_that_half_of_all_rows_share(spark):
    """One doc_id, and null ones, that many rows have are dealt over several ranges; the order and all counts hold."""
    rows = [(5, f"text number {i}") for i in range(300)] + [(None, f"no id {i}") for i in range(150)] + [(i, f"own {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = tokens.scratch_path(spark, "shards")
    tokens.write_shards(docs, str(public_tokenizers.path("word_bpe_49k.json")), path)
    assert spark.read.parquet(path).select("range").distinct().count() > 4
    got = sorted(tokens.read_shards(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted((d for d in ids if d is not None)) + [None] * 150 and len(ids) == 600
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(alphabet=st.sampled_from("aBcé'.,!? \n\t12ñ<|>startofex\u0301\u00a0s\u3000ﬁ\x00")))
def test_word_encoder_equals_whole_texts(text):
    e = tokens.encoder(str(public_tokenizers.path("word_bpe_49k.json")))
    for s in (text, text + "<|endoftext|>", "can't. we'll " + text):
        assert np.frombuffer(e.encode(s.encode()), np.uint32).tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=700))
def test_wavelet_matrix(ids):
    x = np.array(ids, np.int64)
    data = tokens.shard_bytes([1, None], np.array([len(ids), 0]), x, 9)
    start, doc_ids, lengths, wm = tokens.open_shard(data)
    assert (start, doc_ids, lengths.tolist(), wm.decode().tolist()) == (9, [1, None], [len(ids), 0], ids)
    for s in {*ids[:5], 3, 70001}:
        places = [i for i, v in enumerate(ids) if v == s]
        assert wm.count(s) == len(places) and [wm.select(s, k) for k in range(len(places) + 1)] == [*places, -1]
        assert wm.rank(s, len(ids) // 2) == sum(i < len(ids) // 2 for i in places)
    assert all(wm.access(i) == v for i, v in list(enumerate(ids))[:50])


def test_compact_windows_are_those_of_the_definition():
    rng = np.random.default_rng(1)
    values = rng.permutation(60).astype(np.uint64) + np.uint64(1)
    left, right = passages.tree_windows(list(range(61)), [0, *values.tolist()])
    for c in range(1, 61):
        l, r = c, c
        while l > 1 and values[l - 2] > values[c - 1]:
            l -= 1
        while r < 60 and values[r] > values[c - 1]:
            r += 1
        assert left[c] == l and (right[c] == r or right[c] == 0)
    assert passages.sliding_minimum(values, 7).tolist() == [values[i : i + 7].min() for i in range(54)]


def test_passages_against_brute_force(spark, texts):
    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    holders = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            holders[hashlib.md5(b" ".join(w[i : i + 50])).digest()].add(d)
    want = set().union(*(h for h in holders.values() if len(h) > 1))
    rows = QUERIES["op10_passages"](spark, SMALL).collect()
    assert want <= {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    for r in rows:
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.match_doc_id][r.match_start : r.match_end]
        sa, sb = set(passages.shingle_strings(a)), set(passages.shingle_strings(b))
        assert len(a) >= 50 and len(sa & sb) >= 0.8 * len(sa | sb)


def test_planted_near_passages(spark):
    """A hot passage in hundreds of documents, and near copies with a word replaced, amid unlike text."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    hot, near, docs = fresh(55), fresh(120), []
    for i in range(300):
        docs.append((i, " ".join(fresh(80) + hot + fresh(70))))
    for i in range(300, 340):
        own = list(near)
        own[int(rng.integers(0, 120))] = "changed"
        docs.append((i, " ".join(fresh(60) + own + fresh(60))))
    docs += [(i, " ".join(fresh(200) + "a line that all of them have in common".split() + fresh(100))) for i in range(340, 420)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    caught = {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    assert caught == set(range(340)) and len(rows) < 3000


def test_passages_one_after_the_other_in_one_text_only():
    """Two near repeats that one text has side by side and the other apart, close by, or in the other order."""
    rng = np.random.default_rng(21)
    fresh = lambda n: [b"x%d" % v for v in rng.integers(0, 10**9, n)]
    p, q = fresh(60), fresh(60)
    changed = lambda w: w[:30] + [b"changed"] + w[31:]
    a = b" ".join(fresh(20) + changed(p) + changed(q) + fresh(20))
    for b in (fresh(9) + p + fresh(200) + q, p + fresh(6) + q, fresh(9) + q + p + fresh(9), q + fresh(30) + p):
        rows = passages.shared_passages(a, b" ".join(b), 50, 0.8)
        for start in (20, 80):
            assert any(s <= start + 1 and start + 59 <= e for s, e, *_ in rows), rows
        for s, e, s2, e2, j in rows:
            one, two = (set(passages.shingle_strings(x)) for x in (a.split()[s:e], b[s2:e2]))
            assert j == len(one & two) / len(one | two) >= 0.8
    assert passages.shared_passages(a, a, 50, 0.8) == [(0, 160, 0, 160, 1.0)]


def test_near_copies_of_a_text_that_is_neither_smallest_nor_open(spark):
    """Copies with one word changed each are near the original only, which has not the smallest id and is soon covered."""
    rng = np.random.default_rng(31)
    docs = []
    for family in range(12):
        own = [f"x{v}" for v in rng.integers(0, 10**9, 60)]
        docs.append((family * 100 + 50, " ".join(own)))
        for i, at in enumerate(range(13, 47, 3)):
            docs.append((family * 100 + i, " ".join(own[:at] + [f"changed{family}-{i}"] + own[at + 1 :])))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.doc_id // 100 == r.match_doc_id // 100 for r in rows)
    caught = {r.doc_id for r in rows} | {r.match_doc_id for r in rows}
    assert len(caught) >= 0.95 * len(docs)


def test_passage_at_a_later_place_of_the_smallest_text(spark):
    """The smallest text has a common line twice, the second time in the passage that one other text repeats."""
    rng = np.random.default_rng(41)
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    docs, want = [], set()
    for family in range(12):
        line, tail = fresh(40), fresh(12)
        docs.append((family * 100, " ".join(fresh(70) + line + fresh(70) + line + tail + fresh(70))))
        docs += [(family * 100 + i, " ".join(fresh(70) + line + fresh(70))) for i in range(1, 14)]
        docs.append((family * 100 + 50, " ".join(fresh(70) + line + tail + fresh(70))))
        want.add((family * 100 + 50, family * 100, 180, 232))
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    links = passages.bucket_links(passages.window_rows(docs, 50)).where("large").collect()
    assert {r.doc for r in links if r.doc % 100 == 0 and r.c >= 180} == set(range(0, 1200, 100))
    rows = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.match_doc_id, r.match_start, r.match_end) for r in rows} == want


@pytest.mark.parametrize(("words", "changed"), [(50, 1), (60, 1), (100, 2), (150, 3)])
def test_recall_of_near_passages(spark, words, changed):
    """Passages in two texts with as many words replaced as a similarity of 0.8 allows: 9 of 10 or more are found, whole at either end but for a word or two."""
    rng, docs = np.random.default_rng(words), []
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    for i in range(100):
        own = fresh(words)
        docs.append((2 * i, " ".join(fresh(60) + own + fresh(60))))
        for k in range(changed):
            own[int(words * (k + 1) / (changed + 1)) + int(rng.integers(-4, 5))] = f"c{i}-{k}"
        docs.append((2 * i + 1, " ".join(fresh(70) + own + fresh(40))))
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.doc_id == r.match_doc_id + 1 and r.doc_id % 2 for r in rows)
    found = {r.doc_id for r in rows if r.start_word <= 72 and r.end_word >= 70 + words - 2}
    assert len(found) >= 90


def test_all_pairs_of_a_passage_in_a_dozen_texts(spark):
    """Every two of the texts that hold a passage are linked, not each to one of them only."""
    rng, docs = np.random.default_rng(91), []
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    for family in range(3):
        own = fresh(60)
        docs += [(family * 100 + i, " ".join(fresh(70) + own + fresh(70))) for i in range(12)]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {(f * 100 + i, f * 100 + j) for f in range(3) for i in range(12) for j in range(i)}
    assert {(r.doc_id, r.match_doc_id) for r in rows} == want


def test_near_repeats_among_many_texts_with_their_line(spark, monkeypatch):
    """Near repeats that hold a line of 200 texts, and a word more, less or another one after it: pairs whose windows have the line's minima only agree in nothing else at fixed distances."""
    rng, docs = np.random.default_rng(101), []
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    line = fresh(38)
    docs += [(i, " ".join(fresh(60) + line + fresh(60))) for i in range(80)]
    for i in range(60):
        tail = fresh(20)
        docs.append((1000 + i, " ".join(fresh(50) + line + tail + fresh(50))))
        docs.append((2000 + i, " ".join(fresh(55) + line + [f"in{i}"] * (i % 3 > 0) + tail[i % 3 != 1 :] + fresh(45))))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for held in (passages.RUNS_HELD, 0):
        monkeypatch.setattr(passages, "RUNS_HELD", held)
        pairs = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(table).collect()}
        assert pairs <= {(2000 + i, 1000 + i) for i in range(60)} and len(pairs) >= 58


def test_runs_with_one_gap_share_a_mark():
    """Any least length of tokens about the minimum, with a word replaced by up to three anywhere in it; not rows that share less."""
    rng, tried = np.random.default_rng(7), 0
    shared = lambda low, high, around: any(len(np.intersect1d(m[r == 0], m[r == 1])) for r, m in passages.run_marks(np.array([5, 5], np.uint64), low, high, around, 46))
    for _ in range(700):
        first, gap, more = int(rng.integers(-45, 1)), int(rng.integers(-44, 41)), int(rng.integers(0, 3))
        if not first < gap < first + 41 or gap <= 0 <= gap + 4:
            continue
        tried += 1
        a = rng.integers(1, 1 << 32, 400).astype(np.uint32)
        b = np.concatenate((a[: 200 + gap], rng.integers(1, 1 << 32, 5 + more).astype(np.uint32), a[205 + gap :]))
        at = 200 + more * (gap < 0)
        around = np.stack([a[153:248], b[at - 47 : at + 48]])
        low = np.array([47 + first, 47 + first - more * (gap < 0)])
        high = np.array([92 + first, 92 + first + more * (gap > 0)])
        assert around[0, 47] == around[1, 47] and shared(low, high, around), (first, gap, more)
        around[1, (np.arange(95) % 9 == 0) & (np.arange(95) != 47)] = 1
        assert not shared(low, high, around)
    assert tried > 150


def test_words_hash_alike_wherever_they_stand():
    """Hashes of the same five words are the same in any text and batch; cuts are those of bytes.split."""
    rng = np.random.default_rng(17)
    texts = [bytes(rng.choice(list(b"abc \t\n\x0b\x0c\r\x1c\x85"), int(rng.integers(0, 90))).astype(np.uint8)) for _ in range(300)]
    known: dict[bytes, int] = {}
    for some in (texts, texts[::-1], texts[:7], texts[9:10]):
        for text, x in zip(some, passages.tokens_of(some), strict=True):
            names = passages.shingle_strings(text.split())
            assert len(names) == len(x) and all(known.setdefault(n, h) == h for n, h in zip(names, x.tolist()))
    assert len(set(known.values())) == len(known)


def test_near_copies_of_large_groups_are_one_class(spark):
    """150 copies with two of 100 words replaced; the one that all are near to is neither first nor open for long. Links join them all."""
    rng, docs, edges = np.random.default_rng(77), [], []
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    for family in range(3):
        base = fresh(100)
        for i in range(150):
            own = list(base)
            for at in rng.choice(np.arange(5, 95), 2, replace=False) if i != 70 else ():
                own[at] = f"c{family}-{i}-{at}"
            docs.append((family * 1000 + i, " ".join(fresh(60) + own + fresh(60))))
    for r in passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        edges.append((r.doc_id, r.match_doc_id))
    roots = union(edges, [d for d, _ in docs])
    assert sum(roots[d] == d // 1000 * 1000 for d, _ in docs) >= 0.98 * len(docs) and len(edges) < 30 * len(docs)


def test_buckets_too_large_to_hold(spark, monkeypatch):
    """Buckets are taken in parts and what has no partner in its part is dealt by groups: the same texts are found."""
    rng, docs = np.random.default_rng(5), []
    fresh = lambda n: [f"x{v}" for v in rng.integers(0, 10**9, n)]
    line = fresh(30)
    for i in range(120):
        docs.append((i, " ".join(fresh(60) + line + fresh(60))))
    for i in range(30):
        own = line + fresh(30)
        docs += [(1000 + i, " ".join(fresh(50) + own + fresh(50))), (2000 + i, " ".join(fresh(55) + own + fresh(45)))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    whole = {(r.doc_id, r.match_doc_id) for r in passages.repeated_passages(table).collect()}
    assert {(2000 + i, 1000 + i) for i in range(30)} <= whole
    run = passages.bucket_links

    def small(rows):
        monkeypatch.setattr(passages, "HOT", 40)
        return run(rows)

    monkeypatch.setattr(passages, "bucket_links", small)
    rows = passages.repeated_passages(table).collect()
    assert {(2000 + i, 1000 + i) for i in range(30)} <= {(r.doc_id, r.match_doc_id) for r in rows}


def test_items_of_many_blocks(spark):
    """Blocks of items give what one block gives, in pairs and in documents that stay."""
    rng = np.random.default_rng(13)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 10))) for i in range(120)] + [(5, "twice the same item")] * 2
    docs = [(k, " ".join([" ".join(f"v{x}" for x in rng.integers(0, 3000, 30))] + [items[j][1] for j in range(k % 4)]), k) for k in range(40)] + [(1, None, 0), (1, "", 1)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, n long"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(decontam.contaminated(d, b)) == rows(decontam.contaminated(d, b, block_chars=900)) != []
    assert rows(decontam.clean_documents(d, b)) == rows(decontam.clean_documents(d, b, block_chars=900)) and decontam.clean_documents(d, b).count() == 12


def test_prior_from_positives_and_unlabelled_rows(spark):
    """Mixtures of two kinds of texts with a known share: the estimate is near it, and the model tells the kinds apart without a negative label."""
    rng = np.random.default_rng(2)
    good = lambda: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(80))
    bad = lambda: " ".join("#$%"[int(rng.integers(3))] * int(rng.integers(1, 9)) for _ in range(80))
    for share in (0.3, 0.7):
        docs = [(i, good() if i < 600 * share else bad()) for i in range(600)]
        stats = quality_model.with_statistics(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"])
        labels = spark.createDataFrame([(i, 1) for i in range(0, int(600 * share), 2)], "doc_id long, quality int")
        x = np.array([r.x for r in stats.orderBy("doc_id").collect()])
        first = quality_model.fit_nnpu(x[: int(600 * share) : 4], stats, quality_model.QualityModel(*quality_model.moments(stats), np.zeros(29)), 0.5)
        assert abs(quality_model.estimated_prior(x[2 : int(600 * share) : 4], stats, first) - share) < 0.12
        score = quality_model.learn_quality(stats, labels).score(x)
        assert (score[: int(600 * share)] > 0.5).mean() > 0.95 and (score[int(600 * share) :] < 0.5).mean() > 0.95


def test_moments_are_those_of_all_rows(spark):
    stats = quality_model.with_statistics(common.read(spark, SMALL, "documents"), ["doc_id"])
    x = np.array([r.x for r in stats.collect()])
    mean, sd = quality_model.moments(stats)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(sd, np.maximum(x.std(axis=0), 1e-3), atol=1e-6)


def test_targets_of_many_sources(spark):
    """Hundreds of sources of sizes from none to very large: ranks, caps and levels are those of filling one by one."""
    rng = np.random.default_rng(9)
    size = {f"s{i:03d}": int(rng.integers(0, 50)) * 10 ** int(rng.integers(0, 5)) for i in range(300)} | {None: 700, "": 3, "ß": 90, "Z": 0}
    names = sorted(s for s in size if s is not None) + [None]
    table = spark.createDataFrame(list(size.items()), "source string, source_size long").repartition(7)
    assert [r.source for r in mixing.ranked(table).orderBy("rank").collect()] == names and mixing.source_targets(table.limit(0)).count() == 0
    share, free, want, left = {s: i % 3 + 1 for i, s in enumerate(names)}, set(names), {}, float(sum(size.values()))
    while free:
        level = left / sum(share[s] for s in free)
        over = [s for s in free if level * share[s] >= 3 * size[s]]
        want |= {s: 3.0 * size[s] for s in over} if over else {s: level * share[s] for s in free}
        left -= sum(want[s] for s in over)
        free -= set(over) or free
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mixing_order_against_brute_force(spark):
    """What a source's fraction takes are the documents of the smallest keys -ln(u) / w, up to its budget."""
    import math

    docs = common.read(spark, SMALL, "documents")
    keys = mixing.sized(docs).withColumn("tag", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    keys = keys.select("doc_id", "source", "size", "weight", "row_key", F.shiftrightunsigned(F.xxhash64("row_key", "tag"), 11).alias("h")).distinct()
    plan = {(r.doc_id, r.source): r for r in mixing.mix_plan(docs).collect()}
    by_source = defaultdict(list)
    for r in keys.collect():
        by_source[r.source].append((-math.log((r.h + 0.5) / (1 << 53)) / r.weight, r.row_key, r.doc_id, r.size))
    for source, rows in by_source.items():
        first = plan[rows[0][2], source]
        rest = first.target - first.epochs * first.source_size
        gone = 0
        for _, _, doc, size in sorted(rows):
            n = plan[doc, source]["rows"]
            want = 0 if not size else max(0, min(n, math.floor((2 * (rest - gone) + size) / (2 * size))))
            assert plan[doc, source].extra == want
            gone += size * n


def test_out_of_fold_features_have_not_seen_the_fold(spark):
    rows = spark.createDataFrame([(f"common word{i % 7} " + ("poison " if i % 2 else "") + "only" + "abcde"[i % 5], i % 2, i % 5) for i in range(200)], "text string, label int, fold int")
    counts = toxicity.feature_counts(rows).cache()
    got = {r.h: r for r in counts.collect()}
    h = {w: toxicity.WordHashes()[w][0] for w in ("poison", "common")}
    assert sum(got[h["poison"]][f"yes{f}"] for f in range(5)) == 100 and sum(got[h["poison"]][f"no{f}"] for f in range(5)) == 0
    assert sum(got[None][f"yes{f}"] + got[None][f"no{f}"] for f in range(5)) == 200
    every, *without = toxicity.telling_features(counts)
    only = {f: {toxicity.WordHashes()["only" + "abcde"[f]][0]} for f in range(5)}
    assert all(not only[f] & set(without[f][0].tolist()) and only[f] <= set(every[0].tolist()) for f in range(5))


def test_models_on_held_out_rows_only(spark):
    sf = SMALL.replace("0.001", "0.1")
    labels = common.read(spark, sf, "labels")
    q = QUERIES["op6_quality"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in q]) > 0.95
    t = QUERIES["op7_toxicity"](spark, sf).where("held_out").join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert np.mean([r.toxic == r.y for r in t]) > 0.97 and np.mean([r.toxic for r in t if r.y == 0]) < 0.02


def test_models_on_held_out_rows(spark):
    sf = SMALL.replace("0.001", "0.01")
    labels = common.read(spark, sf, "labels")
    q = QUERIES["op6_quality"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in q]) > 0.9
    t = QUERIES["op7_toxicity"](spark, sf).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert np.mean([r.toxic == r.y for r in t]) > 0.95 and np.mean([r.toxic for r in t if r.y == 0]) < 0.02
