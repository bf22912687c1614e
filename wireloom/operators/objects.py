"""Operators over objects: bodies and what is derived from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions.tables import short_batches
from .http import gunzip

SHOW_BYTES = 256
#: Fixed value: the base64 alphabet with its padding, as a script writes it out in escapes.
ALPHABET_ESCAPED = (
    r"\x41\x42\x43\x44\x45\x46\x47\x48\x49\x4A\x4B\x4C\x4D\x4E\x4F\x50\x51\x52\x53\x54\x55\x56\x57\x58\x59\x5A"
    r"\x61\x62\x63\x64\x65\x66\x67\x68\x69\x6A\x6B\x6C\x6D\x6E\x6F\x70\x71\x72\x73\x74\x75\x76\x77\x78\x79\x7A"
    r"\x30\x31\x32\x33\x34\x35\x36\x37\x38\x39\x2B\x2F\x3D"
)


def latin(body: Column) -> Column:
    """Bytes as text with one character each."""
    return F.decode(body, "ISO-8859-1")


def objects(convs: DataFrame, derived: DataFrame | None = None, bucket: int = 4096) -> DataFrame:
    """(capture, id, conv_id, type, name, value): a body object per conversation, then derived ones (capture, conv_id, type, value) numbered after them by (conv_id, type).

    A derived object's name is `<type>-<name>`. A conversation has at most one derived object of a type. Only keys are numbered,
    within buckets of `bucket` conversations, after the counts of the buckets before; values are joined back.
    """
    body = convs.select("capture", "id", F.col("id").alias("conv_id"), F.lit("body").alias("type"), F.col("filename").alias("name"), F.col("res_body").alias("value"))
    if derived is None:
        return body
    keys = derived.select("capture", "conv_id", "type").withColumn("bucket", F.floor(F.col("conv_id") / bucket))
    top = body.groupBy("capture").agg((F.max("id") + 1).alias("next_id"))
    ahead = Window.partitionBy("capture").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("capture", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0))).join(top, "capture")
    within = F.row_number().over(Window.partitionBy("capture", "bucket").orderBy("conv_id", "type")) - 1
    ids = keys.withColumn("n_in", within).join(starts.select("capture", "bucket", (F.col("next_id") + F.col("start")).alias("start")), ["capture", "bucket"])
    ids = ids.select("capture", "conv_id", "type", (F.col("start") + F.col("n_in")).alias("id"))
    more = derived.join(ids, ["capture", "conv_id", "type"]).join(body.select("capture", "conv_id", F.col("name").alias("of")), ["capture", "conv_id"])
    return body.unionByName(more.select("capture", "id", "conv_id", "type", F.concat("type", F.lit("-"), "of").alias("name"), "value"))


def ungzip_objects(convs: DataFrame) -> DataFrame:
    """Derived objects (type `ungzip`) of conversations whose response head speaks of gzip."""
    short_batches(convs.sparkSession)
    rows = convs.where(F.lower("res_head").contains("gzip"))
    return rows.select("capture", F.col("id").alias("conv_id"), F.lit("ungzip").alias("type"), gunzip("orig_resp").alias("value"))


def plaintext_body(body: Column, magic_ext: Column) -> Column:
    """The body, inflated where its type is GZ and it starts as gzip: only such bytes are sent to Python."""
    zipped = F.hex(F.substring(body, 1, 3)) == "1F8B08"
    return F.when((magic_ext == "GZ") & zipped, gunzip(F.when(zipped, body))).otherwise(body)


def peek(body: Column, size: int | None = SHOW_BYTES) -> Column:
    """The first `size` bytes; None: all."""
    return body if size is None else F.substring(body, 1, size)


def slice_bytes(body: Column, offset: int, length: int) -> Column:
    return F.substring(body, offset + 1, length)


@F.pandas_udf(T.BinaryType())
def slice_block(body: pd.Series, offset: pd.Series) -> pd.Series:
    """From offset to the brace that closes the first one; null if none does."""
    return pd.Series([None if b is None else kernels.end_of_block(b, o) for b, o in zip(body, offset)])


def hexdump(body: Column) -> Column:
    """Lines of `%04X   <16 bytes in hex, padded to 48>   <text>`, unprintable bytes as points."""

    def line(i: Column) -> Column:
        part = F.substring(body, (16 * i + 1).cast("int"), F.lit(16))
        hexes = F.rpad(F.regexp_replace(F.hex(part), "(..)", "$1 "), 48, " ")
        return F.concat(F.format_string("%04X", (16 * i).cast("long")), F.lit("   "), hexes, F.lit("   "), F.regexp_replace(latin(part), r"[^\x20-\x7E]", "."))

    n = F.ceil(F.length(body) / 16).cast("int")
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), line), "\n")).otherwise(F.lit(""))


def hashes(body: Column) -> dict[str, Column]:
    return {"md5": F.md5(body), "sha1": F.sha1(body)} | {f"sha{n}": F.sha2(body, n) for n in (224, 256, 384, 512)}


def body_base64(body: Column) -> Column:
    """Base64 in lines of 76 characters."""
    return F.replace(F.base64(body), F.lit("\r\n"), F.lit("\n"))


def extract_strings(body: Column) -> Column:
    """Runs of five or more printable bytes, then such runs with a zero byte after each, without these."""
    text = latin(body)
    plain = F.regexp_extract_all(text, F.lit(r"([\x1f-\x7e]{5,})"), F.lit(1))
    wide = F.transform(F.regexp_extract_all(text, F.lit(r"((?:[\x1f-\x7e]\x00){5,})"), F.lit(1)), lambda s: F.regexp_replace(s, "\x00", ""))
    return F.concat(plain, wide)


def find_pattern(objs: DataFrame, pattern: str, key: str = "id", text: str = "value", needs: str | None = None) -> DataFrame:
    """(key, line, offset, before, match, after) of all case-insensitive matches in the text column.

    needs: a pattern in Spark's dialect that every text with a match has, so that no other leaves the JVM. A pattern of
    letters, digits, blanks and simple punctuation alone is its own.
    """
    short_batches(objs.sparkSession)
    rows = objs.select(key, text).where(F.col(text).isNotNull())
    if needs is not None:
        rows = rows.where(F.col(text).rlike(needs))
    elif re.fullmatch(r"[\w .@/:-]+", pattern, re.ASCII):
        rows = rows.where(F.col(text).rlike("(?iu)" + pattern.replace(".", "[\\s\\S]")))
    compiled = re.compile(pattern, re.IGNORECASE)
    kind = objs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(k, *m) for k, t in zip(f[key], f[text]) for m in kernels.find_pattern(t, compiled)]
            yield pd.DataFrame(found, columns=[key, "line", "offset", "before", "match", "after"])

    return rows.mapInPandas(run, f"{key} {kind}, line long, offset long, before string, match string, after string")


def extract_tag_sources(texts: DataFrame, tag: str, attr: str = "src", key: str = "id", text: str = "text") -> DataFrame:
    """(key, n, value): attribute values of every such start tag, in order, from 0."""
    short_batches(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(key, text).where(F.lower(F.col(text)).contains("<" + tag))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(k, i, v) for k, t in zip(f[key], f[text]) for i, v in enumerate(kernels.tag_sources(t, tag, attr))]
            yield pd.DataFrame(found, columns=[key, "n", "value"])

    return rows.mapInPandas(run, f"{key} {kind}, n long, value string")


def zip_entries(objs: DataFrame, key: str = "id", body: str = "value") -> DataFrame:
    """(key, n, name) of the files in zip objects, from 1."""
    short_batches(objs.sparkSession)
    kind = objs.schema[key].dataType.simpleString()
    rows = objs.select(key, body).where(F.hex(F.substring(body, 1, 2)) == "504B")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(k, i, v) for k, b in zip(f[key], f[body]) for i, v in enumerate(kernels.zip_names(b), 1)]
            yield pd.DataFrame(found, columns=[key, "n", "name"])

    return rows.mapInPandas(run, f"{key} {kind}, n long, name string")


def is_text(body: Column) -> Column:
    """Empty: text; with a zero byte: not; else if at most 30 % of the bytes are unusual."""
    text = latin(body)
    odd = F.length(F.regexp_replace(text, r"[\x20-\x7E\n\r\t\x08]", ""))
    return (F.length(body) == 0) | (~text.contains("\x00") & (odd <= 0.30 * F.length(body)))


def type_candidates(signatures: list[tuple[str, str, str, str]]) -> list[dict]:
    """Signatures (description, hex prefix, extension, required strings by ;) with their ranks among those of the same prefix.

    rank: the first row, then the last to the first; rank_deep, for bodies that go on like a longer prefix: the last to the first.
    """
    rows = [(d, p.replace(" ", ""), e, [s.lower() for s in req.split(";") if s]) for d, p, e, req in signatures]
    out = []
    for i, (d, p, e, req) in enumerate(rows):
        same = [j for j, r in enumerate(rows) if r[1] == p]
        deep = sorted({r[1][len(p) : len(p) + 2] for r in rows if r[1] != p and r[1].startswith(p)})
        back = [same[0], *same[:0:-1]]
        out.append({"name": d, "prefix": p, "ext": e, "required": req, "deep": deep, "rank": back.index(i), "rank_deep": same[::-1].index(i)})
    return out


def identify_type(body: Column, signatures: list[tuple[str, str, str, str]]) -> Column:
    """(name, ext) of a body: the longest prefix whose required strings, case ignored, all occur; else text or binary; empty: empty.

    The few signatures are a constant of the expression, so nothing is joined or shuffled; the body's start and its
    lower-case text are made once a row and bound to a name.
    """
    words = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    known = F.array(*[
        F.struct(F.lit(s["prefix"]).alias("prefix"), F.lit(len(s["prefix"])).alias("n"), F.lit(s["name"]).alias("name"), F.lit(s["ext"]).alias("ext"), words(s["required"]).alias("required"), words(s["deep"]).alias("deep"), F.lit(s["rank"]).alias("rank"), F.lit(s["rank_deep"]).alias("rank_deep"))
        for s in type_candidates(signatures)
    ])
    pair = lambda name, ext: F.struct(F.lit(name).alias("name"), F.lit(ext).alias("ext"))

    def decide(x: Column) -> Column:
        fits = F.filter(known, lambda s: x["start"].startswith(s["prefix"]) & F.forall(s["required"], lambda w: x["low"].contains(w)))
        rank = lambda s: F.when(F.array_contains(s["deep"], F.substr(x["start"], s["n"] + 1, F.lit(2))), s["rank_deep"]).otherwise(s["rank"])
        best = F.array_max(F.transform(fits, lambda s: F.struct((1000 * s["n"] - rank(s)).alias("score"), s["name"].alias("name"), s["ext"].alias("ext"))))
        plain = F.when(is_text(x["body"]), pair("Inconclusive. Probably text", "TEXT")).otherwise(pair("Inconclusive. Probably binary", "BINARY"))
        found = F.coalesce(F.transform(F.array(best), lambda b: F.when(b.isNotNull(), F.struct(b["name"].alias("name"), b["ext"].alias("ext"))))[0], plain)
        return F.when(F.coalesce(F.length(x["body"]), F.lit(0)) == 0, pair("", "")).otherwise(found)

    longest = 1 + max((len(s["prefix"]) // 2 for s in type_candidates(signatures)), default=0)
    bound = F.struct(body.alias("body"), F.hex(F.substring(body, 1, longest)).alias("start"), F.lower(latin(body)).alias("low"))
    return F.transform(F.array(bound), decide)[0]


def declares_list(code: Column) -> Column:
    """Whether a script begins by declaring a list under a name of _0x and hexadecimal digits, as kernels.unpack_string_array undoes it."""
    left = F.substring_index(code, "=", 1)
    digits = F.trim(F.substr(left, F.lit(len("var _0x") + 1)))
    return left.startswith("var _0x") & (digits != "") & (F.translate(digits, "0123456789abcdef", "") == "") & F.ltrim(F.substr(code, F.length(left) + 2)).startswith("[")


def detect_obfuscation(code: Column) -> Column:
    """The detectors that fire, in priority order: urlencoded, packed, string_array, reversed_base64."""
    percents = F.length(code) - F.length(F.replace(code, F.lit("%"), F.lit("")))
    tests = {
        "urlencoded": ~code.contains(" ") & (code.contains("%20") | (percents > 3)),
        "packed": F.replace(code, F.lit(" "), F.lit("")).startswith("eval(function(p,a,c,k,e,"),
        "string_array": declares_list(code),
        "reversed_base64": code.contains('["' + ALPHABET_ESCAPED + '"'),
    }
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())


@F.pandas_udf(T.StringType())
def unpack_script(code: pd.Series, kind: pd.Series) -> pd.Series:
    todo = {"packed": kernels.unpack_packed, "string_array": kernels.unpack_string_array, "reversed_base64": kernels.unpack_reversed_base64}
    return pd.Series([todo[k](c) if k in todo and c is not None else None for c, k in zip(code, kind)])


def deobfuscate(scripts: DataFrame, code: str = "code") -> DataFrame:
    """scripts with `detected` and `plain`: URL decoding, then the first other detector's unpacking; only flagged texts reach Python.

    No row is filtered by what the detectors say: Spark would move such a filter below whatever `code` is made of and make it once more for each mention.
    """
    short_batches(scripts.sparkSession)
    rows = scripts.withColumn("detected", detect_obfuscation(F.col(code)))
    decoded = F.when(F.array_contains("detected", "urlencoded"), F.coalesce(F.try_url_decode(code), F.col(code))).otherwise(F.col(code))
    kind = F.get(F.filter("detected", lambda x: x != "urlencoded"), F.lit(0))
    return rows.withColumn("plain", F.coalesce(unpack_script(F.when(kind.isNotNull(), decoded), kind), decoded))


def reputation_join(objs: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, detections): objs' keys with positives of total, null where the verdict table has no such md5; and one row per engine that detected."""
    keyed = objs.select("capture", "id", F.md5("value").alias("md5"))
    joined = keyed.join(verdicts, "md5", "left")
    summary = joined.select("capture", "id", "md5", F.col("positives").isNotNull().alias("found"), "positives", "total", "scan_date", "permalink")
    engines = joined.where("scans is not null").select("capture", "id", "md5", F.explode("scans").alias("engine", "scan")).where("scan.detected")
    return summary, engines.select("capture", "id", "md5", "engine", "scan.result")


@F.pandas_udf(T.DoubleType())
def byte_entropy(body: pd.Series) -> pd.Series:
    """Shannon entropy of the bytes, in bits."""
    return body.map(kernels.entropy, na_action="ignore").astype(float)
