"""Nulls, empty and repeated rows, empty tables and extra columns through every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wireloom.llm import chat, decontam, langid, mixing, passages, quality_model, quality_rules, simhash, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double"
LONG = " ".join(f"word{i}" for i in range(3000))
ROWS = [
    (1, None, None, None, None, "x", None), (2, "", "en", "a", 0, None, 1.0), (3, " \n\t ", "en", None, 3, "x", None), (None, "some text here", "en", "a", 5, "x", 0.5), (4, "12 34 !!", "en", "a", 5, "x", 0.5),
    (5, LONG, "en", "a", 1, "x", 0.1), (5, LONG, "en", "a", 1, "x", 0.1), (6, LONG, "en", "b", 1, "x", 0.1), (7, "Größe und Straße sind schön, ñandú también.", "de", "b", 1, "x", 0.1), (8, "one two", None, "b", 1, "x", 0.1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_language(docs, empty):
    learned = langid.learn_filter(langid.training_rows(docs))
    got = langid.with_language(docs, learned, lang="p", score="s").collect()
    assert len(got) == len(ROWS) and all((r.p == "und") == (r.text is None or not any(c.isalpha() for c in r.text)) for r in got) and all(0 <= r.s <= 1 for r in got)
    none = langid.learn_filter(langid.training_rows(empty))
    assert none.langs == [] and {r.p for r in langid.with_language(docs, none, lang="p", score="s").collect()} == {"und"}
    assert langid.with_language(empty, learned, lang="p", score="s").count() == 0


def test_near_groups(docs, empty):
    got = simhash.near_groups(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.fp, []).append(r.doc_id)
    assert len(got) == len(ROWS) and sorted(by[0]) == [1, 2, 3] and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    kept = simhash.first_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x) for x in {r.component_id for r in got})
    assert simhash.near_groups(empty).count() == 0 and simhash.first_of_each_group(empty).count() == 0


def test_host_rules(docs, empty):
    got = {(r.doc_id, r.source): r for r in quality_rules.host_rules(docs).collect()}
    assert got[1, None].n_words == 0 and got[1, None].base_failed and not got[1, None].kept
    assert got[5, "a"].n_words == 3000 and not got[5, "a"].base_failed
    assert quality_rules.host_rules(empty).count() == 0


def test_mixing(docs, empty):
    plan = mixing.mix_plan(docs).collect()
    assert sum(r["rows"] for r in plan) == len(ROWS) and all(0 <= r.extra <= r["rows"] and r.epochs <= 3 for r in plan)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix_plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_chat(spark):
    turns = "conv_id long, turn long, role string, text string, formatted string"
    rows = [(1, 1, "user", None, "x"), (1, 2, None, "", None), (2, None, "assistant", "a", None), (2, None, "assistant", "a", None), (None, 1, "user", "only", None), (3, 1, "assistant", LONG, None)]
    got = {r.conv_id: r for r in chat.read_back(chat.examples(spark.createDataFrame(rows, turns))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (2, 0), 2: (2, 2), None: (1, 0), 3: (1, len(LONG))}
    assert chat.read_back(chat.examples(spark.createDataFrame([], turns))).count() == 0


def test_models(spark, docs, empty):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for lab, base in ((labels, docs), (labels.limit(0), docs), (labels, empty)):
        model = quality_model.learn_quality(quality_model.with_statistics(base, ["doc_id"]), lab)
        assert all(0 <= r.q <= 1 for r in quality_model.with_quality(quality_model.with_statistics(docs, ["doc_id"]), model, ["doc_id"], out="q").collect())
        chain = toxicity.learn_chain(base, lab)
        got = toxicity.with_toxicity(docs, chain, keep=["doc_id"]).collect()
        assert len(got) == len(ROWS) and all(0 <= r.p_toxic <= 1 for r in got)
        assert toxicity.with_toxicity(empty, chain).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, LONG[:400], "x"), (2, None, "x"), (3, "", "x"), (4, "one two", "x"), (5, "not there at all, is it", "x")], "item_id long, text string, doc_id string").select("item_id", "text")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(5, 1), (5, 1), (6, 1), (8, 4)]
    kept = decontam.clean_documents(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 4
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_token_shards(docs, empty):
    got = tokens.encode_and_read_back(docs).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 4, 5, 5, 6, 7, 8, None] and got[0].n_tokens == 1
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    assert tokens.encode_and_read_back(empty).count() == 0


def test_passages(docs, empty):
    got = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.match_doc_id) for r in got} == {(6, 0, 3000, 5)}
    assert passages.repeated_passages(empty).count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, row_key string, tag string, times long, clean string, lang_pred string, score double, in0 string, fp long, block int, key string"
NAMED = [(1, "the same words in one row and the other " * 3, lang, "a", n, "k", "t", 7, "c", "p", 0.5, "i", 3, 4, "y") for lang, n in (("en", 10), ("de", 20), ("de", 20))]
NAMED += [(2, "quite something else that is written here once and for all", "en", "a", 5, None, None, None, None, None, None, None, None, None, None), (3, "noch ein anderer Text auf Deutsch, der hier steht", "de", "b", 6, "k", "t", 7, "c", "p", 0.5, "i", 3, 4, "y")]


def test_columns_with_the_names_of_inner_ones(spark, tmp_path):
    "Stages keep all columns and values whatever their names; rows alike in id and text only are different rows."
    docs = spark.createDataFrame(NAMED, CLASH)
    spark.createDataFrame([(1, "not in any of these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = lambda rows: sorted(map(str, (tuple(r) for r in rows.collect())))
    given = plain(docs)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert set(plain(out)) <= set(given), name
    for stage in ("language", "decontamination"):
        assert plain(dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))) == given
    kept = plain(simhash.first_of_each_group(docs))
    assert kept == plain(simhash.first_of_each_group(docs.repartition(3))) and len(kept) == 3
    scored = langid.with_language(docs, langid.learn_filter(langid.training_rows(docs)))
    assert scored.columns.count("lang_pred") == 1 and scored.count() == len(NAMED) and "p" not in {r.lang_pred for r in scored.collect()}


def test_mixing_keeps_rows_alike_in_id_and_text(spark):
    docs = spark.createDataFrame(NAMED + [(9, "filler " * 400, "en", "c", n, *[None] * 10) for n in range(3)], CLASH)
    times = lambda rows: sorted((r.doc_id, r.lang, r.n_chars, r["count"]) for r in rows.groupBy("doc_id", "lang", "n_chars").count().collect())
    plan = {(r.doc_id, r.source): r for r in mixing.mix_plan(docs).collect()}
    out = times(mixing.mixed(docs))
    for key in plan:
        r = plan[key]
        assert sum(n for d, _, _, n in out if d == key[0]) == r["rows"] * r.epochs + r.extra
    assert out == times(mixing.mixed(docs.repartition(5)))
    assert {(d, lang, n) for d, lang, n, _ in out if d == 1} == {(1, "en", 10), (1, "de", 20)} or plan[1, "a"].epochs == 0


def test_mixing_ends_among_rows_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 2)
    rows = [(1, "one two three four", "a", n % 2) for n in range(9)] + [(2, "five six seven", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    got = [r.n for r in mixing.mixed(docs).where("doc_id = 1").collect()]
    assert 0 < plan[1].extra < 9 and len(got) == 9 * plan[1].epochs + plan[1].extra
    want = lambda n, k: k * plan[1].epochs <= got.count(n) <= k * (plan[1].epochs + 1)
    assert want(0, 5) and want(1, 4)


def test_texts_of_millions_of_characters(spark):
    """Texts that every operator takes in several blocks: equal ones are found equal, a passage at the far end is found, counts are whole."""
    long = " ".join(f"wort{i * 7919 % 100003}" for i in range(230_000))
    tail = " ".join(f"ende{i}" for i in range(80))
    docs = spark.createDataFrame([(1, long + " " + tail, "de", "a", 0, "x", 0.5), (2, long + " " + tail, "de", "a", 0, "x", 0.5), (3, tail, "de", "b", 0, "x", 0.5)], DOCS)
    assert len(long) > 2_000_000
    assert {r.lang_pred for r in langid.with_language(docs, langid.learn_filter(docs.select("lang", "text"))).collect()} == {"de"}
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert groups[1] == groups[2] == 1
    assert {r.doc_id: r.n_words for r in quality_rules.host_rules(docs).collect()} == {1: 230_080, 2: 230_080, 3: 80}
    items = spark.createDataFrame([(7, " ".join(tail.split()[20:60]))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()) == [(1, 7), (2, 7), (3, 7)]
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode_and_read_back(docs).collect()}
    assert sizes[1] == sizes[2] > 230_080 and sizes[3] > 80
    found = {(r.doc_id, r.start_word, r.end_word, r.match_doc_id, r.match_start, r.match_end) for r in passages.repeated_passages(docs).collect()}
    assert (2, 0, 230_080, 1, 0, 230_080) in found and (3, 0, 80, 1, 230_000, 230_080) in found


def test_pipeline_stages(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, "quite another text than any of these here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, empty):
        rows = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stage(spark, rows, str(tmp_path))
            assert i == 4 or rows.columns == docs.columns
        rows.count()


def test_no_bucket_of_keys_is_hot(spark):
    """Keys of documents of any mix of weights fall into many buckets, none of which holds much of its source."""
    from pyspark.sql import functions as F

    from wireloom.llm import mixing

    n = 200_000
    u = (F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    for weight in (F.lit(0.1), F.lit(1.0), F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.7)):
        key = -F.log(u) / weight
        rows = spark.range(n).select(mixing.bucket_of(key).alias("b"), key.alias("k"))
        sizes = rows.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("b").collect()
        assert max(r.n for r in sizes) < n * 0.00025 + 6 * (n * 0.00025) ** 0.5 and sum(r.n for r in sizes) == n
        assert all(a.high < b.low for a, b in zip(sizes, sizes[1:]))
    assert spark.range(1).select(mixing.bucket_of(F.lit(0.0)).alias("b")).first().b == -60 * mixing.STEPS
