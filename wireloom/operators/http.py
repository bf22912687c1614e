"""HTTP messages: heads to columns, bodies out of their framing, requests with their responses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.tables import short_batches
from .packets import METHODS

#: MIME types shown as text or as binary.
TEXT_SUBTYPES = ("html", "xml", "json", "javascript", "ecmascript", "atom+xml", "rss+xml", "xhtml+xml", "rdf+xml", "x-www-form-urlencoded")
BINARY_TOPS = ("audio", "image", "video")
BINARY_SUBTYPES = ("octet-stream", "pdf", "postscript", "zip", "gzip", "x-shockwave-flash", "oct-stream")
MAX_BODY = 10_000_000


def is_request(line: Column) -> Column:
    """The token before the first blank is a method."""
    return F.substring_index(line, " ", 1).isin(*METHODS)


def is_response(line: Column) -> Column:
    return line.startswith("HTTP/")


def split_message(raw: Column) -> Column:
    """(head text, body bytes) of a raw message, cut at the first blank line."""
    text = F.decode(raw, "ISO-8859-1")
    at = F.instr(text, "\r\n\r\n")
    bare = F.instr(text, "\n\n")
    use = (at > 0) & ((bare == 0) | (at < bare))
    end = F.when(use, at - 1).when(bare > 0, bare - 1).otherwise(F.length(text))
    skip = F.when(use, end + 4).when(bare > 0, end + 2).otherwise(end)
    return F.struct(F.substr(text, F.lit(1), end).alias("head"), F.substring(raw, skip.cast("int") + 1, F.lit(2147483647)).alias("body"))


def header_map(head: Column) -> Column:
    """Header lines as a map: names in lower case, cut at the first colon, both sides trimmed; of repeats the last counts.

    Lines are sorted by name and place, so that each needs a look at its neighbour only.
    """
    lines = F.filter(F.slice(F.split(head, "\r?\n"), 2, 1_000_000_000), lambda x: F.instr(x, ":") > 0)
    named = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), i.alias("i"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v"))))
    last = F.zip_with(named, F.slice(named, 2, 1_000_000_000), lambda a, b: F.when(b.isNull() | (a["k"] != b["k"]), F.struct(a["k"], a["v"])))
    return F.map_from_entries(F.filter(last, lambda x: x.isNotNull()))


def normalize_uri(uri: Column, host: Column) -> Column:
    """A request URI without `http://` and the host's length after it."""
    return F.when(uri.startswith("http://"), F.substr(uri, F.length(host) + 8)).otherwise(uri)


def full_url(host: Column, uri: Column) -> Column:
    return F.when(uri.startswith("http://") | uri.startswith("https://"), uri).otherwise(F.concat(F.lit("http://"), host, uri))


def request_columns(head: Column, headers: Column | None = None) -> dict[str, Column]:
    """Columns of a request head. A request line of other than three items leaves method and uri empty. headers: the head's map, where a column has it already."""
    line = F.split(F.regexp_replace(F.substring_index(head, "\n", 1), "\r$", ""), " ")
    ok, headers = F.size(line) == 3, header_map(head) if headers is None else headers
    of = lambda name: F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))
    return {
        "method": F.when(ok, line[0]).otherwise(F.lit("")), "uri": F.when(ok, normalize_uri(line[1], of("host"))).otherwise(F.lit("")),
        "host": of("host"), "referer": of("referer"), "content_type": of("content-type"), "content_length": F.coalesce(of("content-length").try_cast("long"), F.lit(0)),
        "chunked": of("transfer-encoding").contains("chunked"), "content_encoding": of("content-encoding"), "expects": of("expect") != "", "req_headers": headers,
    }


def response_columns(head: Column, headers: Column | None = None) -> dict[str, Column]:
    """Columns of a response head; res_num is the text after the first blank, filename that after the first = of the disposition."""
    line, headers = F.regexp_replace(F.substring_index(head, "\n", 1), "\r$", ""), header_map(head) if headers is None else headers
    of = lambda name: F.coalesce(F.try_element_at(headers, F.lit(name)), F.lit(""))
    return {
        "res_num": F.substr(line, F.instr(line, " ") + 1), "status": F.regexp_extract(line, r"^\S+ +(\d+)", 1).try_cast("int"), "redirect_to": of("location"), "res_type": of("content-type"),
        "res_length": F.coalesce(of("content-length").try_cast("long"), F.lit(0)), "chunked": of("transfer-encoding").contains("chunked"), "close": F.lower(of("connection")) == "close",
        "content_encoding": of("content-encoding"), "disposition_name": F.rtrim(F.coalesce(F.get(F.split(of("content-disposition"), "="), F.lit(1)), F.lit(""))),
    }


@F.pandas_udf(T.BinaryType())
def dechunk(raw: pd.Series) -> pd.Series:
    """Chunked bodies put together; a broken one gives what was read so far."""
    return raw.map(kernels.dechunk, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def gunzip(raw: pd.Series) -> pd.Series:
    """Bytes that start as gzip and are longer than 10, inflated; null if broken, others as they are. A stream that is cut or goes on beyond kernels.MAX_INFLATED bytes gives its first part; `with_bodies` tells."""
    return raw.map(kernels.gunzip, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def inflate(raw: pd.Series) -> pd.Series:
    """Raw or zlib deflate; null if broken."""
    return raw.map(kernels.inflate, na_action="ignore")


def frame_body(body: Column, length: Column, chunked: Column) -> Column:
    """The body by its framing: chunked, or length bytes, or, for length 0, the rest up to MAX_BODY."""
    return F.when(chunked, dechunk(F.when(chunked, body))).when(length > 0, F.substring(body, F.lit(1), F.least(length, F.lit(2147483647)).cast("int"))).otherwise(F.substring(body, 1, MAX_BODY))


def parse_content_type(value: Column) -> Column:
    """(mime, charset) in lower case; a parameter that is not charset leaves it empty."""
    rest = F.substr(value, F.length(F.substring_index(value, ";", 1)) + 2)
    at = F.instr(rest, "=")
    charset = F.when((at > 1) & (F.trim(F.substr(rest, F.lit(1), at - 1)) == "charset"), F.substr(rest, at + 1)).otherwise(F.lit(""))
    return F.struct(F.lower(F.trim(F.substring_index(value, ";", 1))).alias("mime"), F.lower(F.trim(charset)).alias("charset"))


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Text by the declared charset, else UTF-8, else GB18030, else an error text."""
    return pd.Series([kernels.decode(b, c) for b, c in zip(body, charset)])


def mime_class(mime: Column) -> Column:
    """text, binary or other, by top level and subtype."""
    top, sub = F.substring_index(mime, "/", 1), F.substring_index(mime, "/", -1)
    return F.when((top == "text") | sub.isin(*TEXT_SUBTYPES), "text").when(top.isin(*BINARY_TOPS) | sub.isin(*BINARY_SUBTYPES), "binary").otherwise("other")


def skip_continue(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Messages without responses of status 100; the client's run after one joins the request before it.

    messages: keys, msg_no, is_request, status (responses), expects (requests), raw.
    """
    w = Window.partitionBy(*keys).orderBy("msg_no")
    rows = messages.withColumns({"before": F.lag("status").over(w), "asked": F.coalesce(F.lag("expects", 2).over(w), F.lit(False)), "next_raw": F.lead("raw", 2).over(w), "next_status": F.lead("status").over(w), "next_request": F.lead("is_request", 2).over(w)})
    goes_on = F.coalesce("expects", F.lit(False)) & F.coalesce(F.col("next_status") == 100, F.lit(False)) & ~F.coalesce("next_request", F.lit(True))
    rows = rows.withColumn("raw", F.when(goes_on, F.concat("raw", F.coalesce("next_raw", F.lit(b"")))).otherwise(F.col("raw")))
    follows = ~F.coalesce("is_request", F.lit(False)) & F.coalesce(F.col("before") == 100, F.lit(False)) & F.col("asked") & F.col("status").isNull()
    return rows.where(~follows & ~F.coalesce(F.col("status") == 100, F.lit(False))).drop("before", "asked", "next_raw", "next_status", "next_request")


def pair_exchanges(messages: DataFrame, keys: list[str], order: str = "msg_no") -> DataFrame:
    """One row per request: its columns and those of the response that follows it, if the next message of the connection is one.

    messages: keys, order, is_request, payload columns as a struct `m`.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rows = messages.withColumns({"next_m": F.lead("m").over(w), "next_is_request": F.lead("is_request").over(w)})
    answer = F.when(~F.coalesce("next_is_request", F.lit(True)), F.col("next_m"))
    return rows.where("is_request").select(*keys, order, F.col("m").alias("request"), answer.alias("response"))


def exchanges(messages: DataFrame) -> DataFrame:
    """Messages (as packets.messages_of gives them) to conversation rows, bodies inflated where they are gzip.

    A request that expects a 100 gets the client's next run as its body, and the response after that.
    """
    keys = ["capture", "flow_key", "conn_no"]
    head = F.when(F.col("is_request"), split_message(F.col("raw"))["head"])
    status = F.when(~F.col("is_request"), F.regexp_extract(F.decode(F.substring("raw", 1, 64), "ISO-8859-1"), r"^HTTP/\S+ +(\d+)", 1).try_cast("int"))
    marked = messages.withColumns({"status": status, "expects": F.coalesce(head.rlike(r"(?i)\nexpect:[ \t]*[^\s]"), F.lit(False))})
    whole = skip_continue(marked, keys).drop("status", "expects")
    split = whole.withColumn("parts", split_message(F.col("raw"))).select(*keys, "msg_no", "is_request", F.struct(F.col("parts.head").alias("head"), F.col("parts.body").alias("body"), "client", "server", "first_ts_us", "first_packet_no").alias("m"))
    rows = pair_exchanges(split, keys).withColumns({"q": header_map(F.col("request.head")), "a": header_map(F.col("response.head"))})
    request, response = request_columns(F.col("request.head"), F.col("q")), response_columns(F.col("response.head"), F.col("a"))
    rows = rows.select(
        "capture", F.col("request.server").alias("server_ip_port"), F.col("request.client").alias("client"), *[c.alias(n) for n, c in request.items() if n in ("method", "uri", "host", "referer", "req_headers")],
        F.concat(F.encode("request.head", "ISO-8859-1"), F.lit(b"\r\n\r\n"), F.col("request.body")).alias("req"), F.col("response.head").alias("res_head"), *[c.alias(n) for n, c in response.items() if n in ("res_num", "redirect_to", "res_type", "disposition_name")],
        F.col("request.first_ts_us").alias("ts_us"), F.col("request.first_packet_no").alias("packet_no"), response["res_length"].alias("res_length"), response["chunked"].alias("chunked"), F.col("response.body").alias("body"),
    )
    return with_bodies(rows)


def with_bodies(rows: DataFrame) -> DataFrame:
    """rows with orig_resp, res_body, res_len and truncated in place of body, res_length and chunked: framing and gzip undone in one pass.

    truncated: the gzip stream ends early or goes on beyond kernels.MAX_INFLATED bytes, and res_body is its first part.
    """
    short_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("body", "res_length", "chunked")]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("orig_resp", T.BinaryType()), T.StructField("res_body", T.BinaryType()), T.StructField("res_len", T.LongType()), T.StructField("truncated", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [kernels.framed(*x) for x in zip(*(b.column(c).to_pylist() for c in ("body", "res_length", "chunked")))]
            cols = list(zip(*out)) if out else [[]] * 4
            made = [pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *made], names=schema.names)

    return rows.mapInArrow(run, schema)
