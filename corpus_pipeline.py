"""A corpus pipeline: each stage is one operator over what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wireloom.llm.common import col, fresh, read, written
from wireloom.llm.decontam import clean_documents
from wireloom.llm.langid import learn_filter, training_rows, with_language
from wireloom.llm.mixing import mixed
from wireloom.llm.simhash import first_of_each_group
from wireloom.llm.tokens import encode_and_read_back

#: A document is rejected below this share of trigrams of its best language; prose is far above it.
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from docs stay; null texts and texts without letters or in no known language go."""
    lang, score = fresh(docs.columns, "lang_pred", "score")
    scored = with_language(docs, learn_filter(training_rows(docs)), lang=lang, score=score)
    return scored.where((scored[lang] != "und") & (scored[score] >= MIN_LANGUAGE_SCORE)).select(*[col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id."""
    return first_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return clean_documents(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return encode_and_read_back(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_shards", token_shards),
]

#: The stages hash, sketch and encode, which SQL cannot express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's rows written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
