"""Operator 3, host-level quality rules.

Rules over single texts give each document a base verdict. Failures are added up by host (the source column), each
host's failure rate is shrunk towards a beta prior fitted to all hosts by moments, and hosts whose shrunken rate
is over a limit are rejected; the verdict is joined back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, read, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Highest shrunken failure rate of a host that is kept.
MAX_HOST_RATE = 0.6
#: Most documents that the prior may weigh.
MAX_STRENGTH = 1e6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window which the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    _, pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)
    _, window, times = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = times[window] > 1
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= again
    return int(inside.sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    text = text or b""
    words = text.split()
    data = np.frombuffer(text, np.uint8)
    chars = sum(map(len, words)) - int(np.count_nonzero((data & 0xC0) == 0x80))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words)


def with_base_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed of each whole text; a null text has no words and fails."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        rows = np.array([text_counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS))
        return [pa.array(rows[:, i]) for i in range(len(COUNTS))]

    rows = append_columns(docs, ["text"], [T.StructField(c, T.LongType()) for c in COUNTS], kernel, keep)
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(rows: DataFrame) -> DataFrame:
    """(source, n, failed, rate) per non-null source; rate: the mean of the failure rate's posterior.

    The prior has the hosts' mean rate and their variance less what sampling alone gives; where nothing is left,
    its strength is MAX_STRENGTH documents and every host has the mean rate.
    """
    hosts = rows.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    p = F.col("failed") / F.col("n")
    prior = hosts.agg(F.avg(p).alias("m"), F.var_pop(p).alias("v"), F.avg(1 / F.col("n")).alias("inv"))
    m = F.col("m")
    left = F.col("v") - m * (1 - m) * F.col("inv")
    strength = F.when(left > 0, F.greatest(F.lit(1.0), F.least(F.lit(MAX_STRENGTH), m * (1 - m) / left - 1))).otherwise(F.lit(MAX_STRENGTH))
    got = prior.select("m", strength.alias("strength")).first()
    m, s = got.m or 0.0, got.strength or MAX_STRENGTH
    return hosts.withColumn("rate", (F.lit(m * s) + F.col("failed")) / (F.lit(s) + F.col("n")))


def host_rules(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Base counts and verdicts per row of docs (doc_id, source, text): doc_id, source, the counts, base_failed, kept, host_rate.

    kept: the base rules and the host pass. A null source is no host and passes (host_rate null). Repeated rows count
    each; an empty table gives no row; other columns are not read.
    """
    rows = written(with_base_rules(docs.select("doc_id", "source", "text"), ["doc_id", "source"]), "base-rules")
    hosts = host_rates(rows).select("source", F.col("rate").alias("host_rate"))
    rows = rows.join(hosts, "source", "left")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= max_rate))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return host_rules(read(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), tri AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), again AS (
  SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), inside AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid
), base AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN inside USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT avg(failed / n) AS m, var_pop(failed / n) - avg(failed / n) * (1 - avg(failed / n)) * avg(1 / n) AS v FROM h
), s AS (
  SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / v - 1)) ELSE 1e6 END AS s FROM p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce((m * s + failed) / (s + n), 0) <= 0.6 AS kept
FROM b LEFT JOIN h USING (source) CROSS JOIN s
"""
