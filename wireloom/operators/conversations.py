"""Operators over conversations: first per URL, numbers, names, hosts, clients, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Request headers that say nothing about a client.
COMMON_HEADERS = (
    "ACCEPT", "ACCEPT-ENCODING", "ACCEPT-LANGUAGE", "CONNECTION", "HOST", "REFERER", "CACHE-CONTROL", "CONTENT-TYPE", "COOKIE", "CONTENT-LENGTH",
    "X-REQUESTED-WITH", "IF-MODIFIED-SINCE", "IF-NONE-MATCH", "ORIGIN", "ACCEPT-ASTEROPE", "IF-UNMODIFIED-SINCE",
)


def dedupe_conversations(convs: DataFrame) -> DataFrame:
    """The first conversation of each (host, uri), case ignored, by (ts_us, packet_no).

    The winner is found on narrow columns by a combinable minimum and joined back, so bodies are not sorted and a
    busy URL is not one task.
    """
    key = F.struct("ts_us", "packet_no")
    first = convs.groupBy("capture", F.lower("host").alias("h"), F.lower("uri").alias("u")).agg(F.min(key).alias("k"))
    first = first.select(F.col("capture"), F.col("k.packet_no").alias("packet_no")).distinct()
    return convs.join(first, ["capture", "packet_no"], "left_semi")


def number_conversations(convs: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """convs with id: the 0-based place in its capture by (ts_us, packet_no).

    Counts per time bucket are summed up ahead of each bucket, and rows are numbered within a bucket only, so a capture
    of any length is no single task. Only keys go through the windows.
    """
    keys = convs.select("capture", "packet_no", "ts_us", F.floor(F.col("ts_us") / bucket_us).alias("bucket"))
    ahead = Window.partitionBy("capture").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("capture", "bucket").agg(F.count(F.lit(1)).alias("n")).select("capture", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("capture", "bucket").orderBy("ts_us", "packet_no")
    ids = keys.withColumn("at", F.row_number().over(within) - 1).join(starts, ["capture", "bucket"])
    return convs.join(ids.select("capture", "packet_no", (F.col("start") + F.col("at")).cast("long").alias("id")), ["capture", "packet_no"])


def derive_filename(uri: Column, id: Column, disposition: Column | None = None) -> Column:
    """The disposition's name, else the last path segment cut at &, else `<id>.html`."""
    path = F.regexp_replace(uri, r"[?#;].*$", "")
    last = F.substring_index(F.substring_index(path, "/", -1), "&", 1)
    made = F.coalesce(F.nullif(last, F.lit("")), F.concat(id.cast("string"), F.lit(".html")))
    return made if disposition is None else F.coalesce(F.nullif(disposition, F.lit("")), made)


def short_uri(uri: Column) -> Column:
    """Over 20 characters: the first and last 10 with three points between."""
    return F.when(F.length(uri) > 20, F.concat(F.left(uri, F.lit(10)), F.lit("..."), F.right(uri, F.lit(10)))).otherwise(uri)


def clean_res_type(res_type: Column) -> Column:
    return F.substring_index(res_type, ";", 1)


def content_category(res_type: Column) -> Column:
    has = res_type.contains
    return F.when(has("pdf"), "pdf").when(has("javascript"), "javascript").when(has("octet-stream") | has("application"), "binary").when(has("image"), "image").otherwise("other")


def fmt_size(n: Column) -> Column:
    """Bytes with one decimal and B, KB, MB, GB, TB or PB, at steps of 1024."""
    out, names = None, ["B", "KB", "MB", "GB", "TB", "PB"]
    for i in range(len(names) - 1, -1, -1):
        text = F.format_string(f"%3.1f {names[i]}", F.bround(n / float(1024**i), 1))
        out = text if out is None else F.when(F.abs(n) < float(1024 ** (i + 1)), text).otherwise(out)
    return out


def hosts_tree(convs: DataFrame) -> DataFrame:
    """(capture, host, server_ip_port, uris, first_id): URIs with ids in id order; order hosts by first_id to have them as first seen."""
    uris = F.array_sort(F.collect_list(F.struct("id", "uri")))
    return convs.groupBy("capture", "host", "server_ip_port").agg(uris.alias("uris"), F.min("id").alias("first_id"))


def host_domains(convs: DataFrame) -> DataFrame:
    """(capture, domain, is_ip) of every host without its port."""
    domain = F.substring_index("host", ":", 1)
    return convs.select("capture", domain.alias("domain"), domain.rlike(r"^\d{1,3}(\.\d{1,3}){3}$").alias("is_ip")).distinct()


def client_profile(requests: DataFrame, packets: DataFrame | None = None) -> DataFrame:
    """(capture, key, value): the first value of each request header that is not a common one; with packets, also the first IP and MAC.

    requests: capture, ts_us, packet_no, req_headers (map).
    """
    rows = requests.select("capture", "ts_us", "packet_no", F.explode("req_headers").alias("k", "value")).withColumn("key", F.upper("k")).where(~F.col("key").isin(*COMMON_HEADERS))
    found = rows.groupBy("capture", "key").agg(F.min_by("value", F.struct("ts_us", "packet_no")).alias("value"))
    if packets is not None:
        first = packets.groupBy("capture").agg(F.min_by(F.struct("src_ip", "src_mac"), "packet_no").alias("p"))
        pairs = F.explode(F.array(F.struct(F.lit("IP").alias("key"), F.col("p.src_ip").alias("value")), F.struct(F.lit("MAC").alias("key"), F.col("p.src_mac").alias("value"))))
        found = first.select("capture", pairs.alias("x")).select("capture", "x.key", "x.value").unionByName(found.where("key not in ('IP', 'MAC')"))
    return found


def capture_info(packets: DataFrame, convs: DataFrame) -> DataFrame:
    """Per capture: first packet's and first conversation's time, number of conversations."""
    a = packets.groupBy("capture").agg(F.min("ts_us").alias("first_packet_us"))
    b = convs.groupBy("capture").agg(F.min("ts_us").alias("first_conversation_us"), F.count(F.lit(1)).alias("conversations"))
    return a.join(b, "capture", "left").withColumn("conversations", F.coalesce("conversations", F.lit(0)))


def exe_verdict(convs: DataFrame) -> DataFrame:
    """Per capture, whether any conversation's type is EXE."""
    return convs.groupBy("capture").agg(F.bool_or(F.coalesce(F.col("magic_ext") == "EXE", F.lit(False))).alias("has_exe"))


def utc_text(ts_us: Column) -> Column:
    """Microseconds since 1970 as weekday, month/day/year and time, in UTC whatever the session's zone."""
    seconds = F.floor(ts_us / 1_000_000).cast("long")
    return F.date_format(F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "EEE, MM/dd/yy HH:mm:ss")


def conversation_info(convs: DataFrame) -> DataFrame:
    """Metadata with the request's UTC time."""
    time = utc_text(F.col("ts_us"))
    cols = [c for c in ("capture", "id", "server_ip_port", "host", "uri", "method", "referer", "redirect_to", "res_num", "res_type", "filename", "res_len", "magic_ext") if c in convs.columns]
    return convs.select(*cols, time.alias("time"))


def number_duplicate_uris(convs: DataFrame) -> DataFrame:
    """convs with numbered_uri: the second and later of a URI, case ignored, carry (2), (3), ..."""
    n = F.row_number().over(Window.partitionBy("capture", F.lower("uri")).orderBy("ts_us", "packet_no"))
    return convs.withColumn("numbered_uri", F.when(n > 1, F.concat("uri", F.lit("("), n.cast("string"), F.lit(")"))).otherwise(F.col("uri")))


def match_replay(requests: DataFrame, convs: DataFrame) -> DataFrame:
    """requests (request_id, host, uri) with id and status of the recorded conversation each finds.

    Equal host and URI, case ignored, or equal up to ? where both have one; the lowest id wins. Misses: `200 index` for /,
    else 404. The recorded side is reduced to the lowest id per key before the join.
    """
    path = lambda c: F.lower(F.substring_index(c, "?", 1))
    rec = convs.select(F.lower("host").alias("h"), F.lower("uri").alias("u"), path("uri").alias("p"), F.col("uri").contains("?").alias("q"), "id")
    exact = rec.groupBy("h", "u").agg(F.min("id").alias("exact_id"))
    loose = rec.where("q").groupBy("h", "p").agg(F.min("id").alias("loose_id"))
    asked = requests.withColumns({"h": F.lower("host"), "u": F.lower("uri"), "p": path("uri")})
    rows = asked.join(exact, ["h", "u"], "left").join(loose, ["h", "p"], "left")
    id = F.least("exact_id", F.when(F.col("uri").contains("?"), F.col("loose_id")))
    status = F.when(id.isNotNull(), "200").when(F.col("uri") == "/", "200 index").otherwise("404")
    return rows.select(*requests.columns, id.alias("id"), status.alias("status"))


def split_replay_url(requests: DataFrame, convs: DataFrame) -> DataFrame:
    """requests (request_id, url, host_header) as request_id, host, uri: /<host>/<uri> where the first folder is a recorded host, else the header's host."""
    folder = F.split("url", "/")[1]
    known = convs.select(F.lower("host").alias("known")).distinct()
    rows = requests.withColumn("folder", F.lower(folder)).join(known, F.col("folder") == F.col("known"), "left")
    rest = F.substr("url", F.length("folder") + 2)
    hit = F.col("known").isNotNull()
    return rows.select("request_id", F.when(hit, folder).otherwise(F.col("host_header")).alias("host"), F.when(hit, F.coalesce(F.nullif(rest, F.lit("")), F.lit("/"))).otherwise(F.col("url")).alias("uri"))
