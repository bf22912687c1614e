"""The report: a row per conversation, nested by host and capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .conversations import fmt_size, utc_text
from .objects import body_base64, hexdump

PEEK = 128


def report_rows(convs: DataFrame) -> DataFrame:
    """convs with the report's columns; binary bodies peek as hex, others as text."""
    binary = (F.col("magic_ext") == "BINARY") | (F.col("res_type").contains("application") & ~F.col("res_type").contains("javascript"))
    first = F.substring("res_body", 1, PEEK)
    text = F.concat(F.decode(first, "ISO-8859-1"), F.when(F.length("res_body") > PEEK, "...").otherwise(""))
    return convs.select(
        "capture", "id", "host", "server_ip_port", "uri", "short_uri", "filename", "res_type", "magic_name", "magic_ext", binary.alias("binary"), (F.col("magic_ext") == "EXE").alias("exe"),
        F.when(binary, hexdump(first)).otherwise(text).alias("peek"), body_base64(F.col("res_body")).alias("base64"), F.md5("res_body").alias("md5"), F.sha2("res_body", 256).alias("sha256"),
        fmt_size(F.length("res_body")).alias("size"), utc_text(F.col("ts_us")).alias("time"),
    )


def report_document(rows: DataFrame, paths: DataFrame, info: DataFrame, client: DataFrame) -> DataFrame:
    """(capture, flow, info, client, conversations): hosts nested in captures, rows in hosts.

    rows: report_rows, or only some of its columns: bodies ride along only if they are asked for.
    """
    inner = [c for c in rows.columns if c not in ("capture", "host", "server_ip_port")]
    hosts = rows.groupBy("capture", "host", "server_ip_port").agg(F.array_sort(F.collect_list(F.struct(*sorted(inner, key=lambda c: c != "id")))).alias("conversations"), F.min("id").alias("first_id"))
    convs = hosts.groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("first_id", "host", "server_ip_port", "conversations"))).alias("conversations"))
    flow = paths.groupBy("capture").agg(F.array_sort(F.collect_list("path")).alias("flow"))
    who = client.groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("client"))
    about = info.select("capture", F.struct(*[c for c in info.columns if c != "capture"]).alias("info"))
    return convs.join(flow, "capture", "left").join(about, "capture", "left").join(who, "capture", "left").select("capture", "flow", "info", "client", "conversations")
