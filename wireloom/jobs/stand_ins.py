"""Conversations, messages and frames that Spark makes of the given tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import short_batches

HOST, REST = r"^https?://([^/?#]*)", r"^https?://[^/?#]*(.*)$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Its rows reach Python in short batches, in column functions too."""
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without or with a zone, as it reads in UTC or the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, HOST, 1)


def uri_of(url: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, REST, 1), F.lit("")), F.lit("/"))


def page_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as conversations of one capture, in page order, without what is derived from others."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.lit("pages").alias("capture"), F.col("page_id").alias("packet_no"), (F.col("page_id") * 1_000_000).alias("ts_us"),
        F.concat(F.lit("10.0.0."), F.pmod("page_id", F.lit(7)).cast("string"), F.lit(":80")).alias("server_ip_port"), host_of(F.col("url")).alias("host"), uri_of(F.col("url")).alias("uri"),
        F.lit("GET").alias("method"), F.lit("").alias("referer"), F.lit("").alias("redirect_to"), F.lit("200 OK").alias("res_num"), F.lit("text/html; charset=UTF-8").alias("res_type"),
        F.lit("HTTP/1.1 200 OK").alias("res_head"), F.encode("html", "UTF-8").alias("res_body"), F.encode("html", "UTF-8").alias("orig_resp"), F.octet_length("html").cast("long").alias("res_len"), "html",
    )


def page_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw HTTP messages: one connection per page, a request and its response."""
    p = page_visits(spark, sf_dir)
    nl = "\r\n"
    request = F.concat(F.lit("GET "), "uri", F.lit(" HTTP/1.1" + nl + "Host: "), "host", F.lit(nl + "User-Agent:  reader/"), F.pmod("packet_no", F.lit(5)).cast("string"), F.lit(" " + nl + "Accept: */*" + nl + nl))
    head = F.concat(F.lit("HTTP/1.1 200 OK" + nl + "Content-Type: text/html; charset=UTF-8" + nl + "Content-Length: "), F.octet_length("html").cast("string"), F.lit(nl + nl))
    client = F.concat(F.lit("192.168.0.1:"), (F.lit(1024) + F.pmod("packet_no", F.lit(60000))).cast("string"))
    base = p.select(
        "capture", F.concat_ws("-", "server_ip_port", client).alias("flow_key"), F.col("packet_no").alias("conn_no"), client.alias("client"), F.col("server_ip_port").alias("server"), F.col("ts_us").alias("first_ts_us"),
        F.explode(F.array(F.struct(F.lit(1).cast("long").alias("msg_no"), F.lit(True).alias("is_request"), F.encode(request, "UTF-8").alias("raw")), F.struct(F.lit(2).cast("long").alias("msg_no"), F.lit(False).alias("is_request"), F.concat(F.encode(head, "UTF-8"), "res_body").alias("raw")))).alias("m"),
    )
    return base.select("capture", "flow_key", "conn_no", "m.msg_no", "m.is_request", "client", "server", "first_ts_us", (F.col("conn_no") * 1000 + F.col("m.msg_no")).alias("first_packet_no"), "m.raw")


def hexes(n: Column, width: int) -> Column:
    return F.lpad(F.hex(n.cast("long")), 2 * width, "0")


def tcp_frame(src_ip: Column, sport: Column, dst_ip: Column, dport: Column, flags: Column, seq: Column, ack: Column, payload: Column) -> Column:
    """An Ethernet frame: addresses as hex text of 8 digits, numbers, payload bytes."""
    head = F.concat(
        F.lit("0200000000020200000000010800" + "4500"), hexes(F.length(payload) + 40, 2), F.lit("00000000" + "40060000"), src_ip, dst_ip,
        hexes(sport, 2), hexes(dport, 2), hexes(seq, 4), hexes(ack, 4), F.lit("50"), hexes(flags, 1), F.lit("ffff00000000"),
    )
    return F.concat(F.unhex(head), payload)


def page_frames(spark: SparkSession, sf_dir: str, part: int = 1200, odd: bool = False) -> DataFrame:
    """Pages as link frames: handshake, request, response in parts (every other one early, one repeated), close.

    odd: of five pages one is asked for by POST with `Expect: 100-continue`, its body sent after the server's 100, and
    one is followed by another request on the same connection after the server's FIN.
    """
    m = page_messages(spark, sf_dir)
    pages = m.groupBy("capture", "conn_no").agg(F.max(F.when(F.col("is_request"), F.col("raw"))).alias("req"), F.max(F.when(~F.col("is_request"), F.col("raw"))).alias("res"), F.max("first_ts_us").alias("ts_us"))
    none, one = F.lit(b""), lambda *x: F.struct(*[v.alias(k) for k, v in zip(("n", "up", "flags", "seq", "ack", "payload"), x)])
    number = F.col("conn_no").cast("string")
    asks, again = F.lit(odd) & (F.col("conn_no") % 5 == 1), F.lit(odd) & (F.col("conn_no") % 5 == 2)
    posted = F.concat(F.lit(b"POST"), F.substring("req", F.lit(4), F.length("req") - 5), F.encode(F.concat(F.lit("Expect: 100-continue\r\nContent-Length: "), (F.length(number) + 6).cast("string"), F.lit("\r\n\r\n")), "UTF-8"))
    pages = pages.select("capture", "conn_no", "ts_us", "res", F.when(asks, posted).otherwise(F.col("req")).alias("req"), F.when(asks, F.lit(b"HTTP/1.1 100 Continue\r\n\r\n")).otherwise(none).alias("go_on"), F.when(asks, F.encode(F.concat(F.lit("field="), number), "UTF-8")).otherwise(none).alias("sent"), F.when(again, F.encode(F.concat(F.lit("GET /again/"), number, F.lit(" HTTP/1.1\r\nHost: again.example\r\n\r\n")), "UTF-8")).otherwise(none).alias("later"))
    n_req, n_go, n_sent, start = F.length("req").cast("long"), F.length("go_on").cast("long"), F.length("sent").cast("long"), F.lit(1000)
    parts = F.ceil(F.length("res") / part).cast("int")
    swapped = lambda i: F.when(i.bitwiseXOR(F.lit(1)) < parts, i.bitwiseXOR(F.lit(1))).otherwise(i)
    said = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: one((10 + swapped(i)).cast("long"), F.lit(False), F.lit(16), (start * 2 + 1 + n_go + i * part).cast("long"), (start + 1 + n_req + n_sent).cast("long"), F.substring(F.col("res"), (i * part + 1).cast("int"), F.lit(part))))
    L = lambda x: F.lit(x).cast("long")
    last, heard = (start * 2 + 1 + n_go + F.length("res")).cast("long"), (start + 1 + n_req + n_sent).cast("long")
    frames = F.concat(
        F.array(one(L(0), F.lit(True), F.lit(2), L(1000), L(0), none), one(L(1), F.lit(False), F.lit(18), L(2000), L(1001), none), one(L(2), F.lit(True), F.lit(24), L(1001), L(2001), F.col("req")), one(L(3), F.lit(True), F.lit(24), L(1001), L(2001), F.col("req"))),
        F.array(one(L(4), F.lit(False), F.lit(24), L(2001), 1001 + n_req, F.col("go_on")), one(L(5), F.lit(True), F.lit(24), 1001 + n_req, 2001 + n_go, F.col("sent"))),
        said,
        F.array(one((12 + parts).cast("long"), F.lit(False), F.lit(17), last, heard, none), one((13 + parts).cast("long"), F.lit(True), F.lit(24), heard, last + 1, F.col("later"))),
    )
    frames = F.filter(frames, lambda f: ~(f["n"].isin(4, 5) | (f["n"] == 13 + parts)) | (F.length(f["payload"]) > 0))
    rows = pages.select("capture", "conn_no", "ts_us", F.explode(frames).alias("f")).select("capture", "conn_no", "ts_us", "f.*")
    client, server = F.lit("c0a80001"), F.concat(F.lit("0a0000"), hexes(F.pmod("conn_no", F.lit(7)), 1))
    cport, sport = F.lit(1024) + F.pmod("conn_no", F.lit(60000)), F.lit(80)
    pick = lambda a, b: F.when(F.col("up"), a).otherwise(b)
    frame = tcp_frame(pick(client, server), pick(cport, sport), pick(server, client), pick(sport, cport), F.col("flags"), F.col("seq"), F.col("ack"), F.col("payload"))
    return rows.select("capture", (F.col("conn_no") * 100_000 + F.col("n")).alias("packet_no"), F.lit(1).alias("link_type"), (F.col("ts_us") + F.col("n")).alias("ts_us"), frame.alias("frame"))


def event_packets(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events as packets: a flow per user, signup as SYN, error as FIN, a purchase as a request, the value in cents as size."""
    e = table(spark, sf_dir, "events") if events is None else events
    kind = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return e.select(
        F.col("user_id").cast("string").alias("flow_key"), F.col("event_id").alias("packet_no"), F.col("ts").cast("timestamp").alias("ts"), micros(F.col("ts")).alias("ts_us"), kind.alias("kind"),
        F.round(F.col("value") * 100).cast("long").alias("size"), (F.col("event_type") == "purchase").alias("asks"),
    )


def small_pe(stamp: int, odd_entry: bool, body: bytes, calls: list[str]) -> bytes:
    """A minimal executable: .text with the body, .idata with the calls of kernel32.dll; the entry point in .text or, odd, in .idata."""
    va = 0x1000 + max(0x1000, -(-len(body) // 0x1000) * 0x1000)
    names = b"".join(struct.pack("<H", 0) + c.encode() + b"\0" for c in calls)
    at, places = va + 60 + 4 * (len(calls) + 1), []
    for c in calls:
        places.append(at)
        at += 3 + len(c)
    idata = struct.pack("<IIIII", va + 40, 0, 0, at, va + 40) + b"\0" * 20 + struct.pack(f"<{len(calls) + 1}I", *places, 0)
    idata = idata.ljust(60 + 4 * (len(calls) + 1), b"\0") + names + b"kernel32.dll\0"
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x14C, 2, stamp, 0, 0, 224, 0x102)
    opt = struct.pack("<HBBIIIIIIIIIHHHHHHIIIIHHIIIIII", 0x10B, 1, 0, 0, 0, 0, va if odd_entry else 0x1000, 0x1000, va, 0x400000, 0x1000, 0x200, 4, 0, 0, 0, 4, 0, 0, va + 0x1000, 0x200, 0, 3, 0, 0, 0, 0, 0, 0, 16)
    opt += b"\0" * 8 + struct.pack("<II", va, len(idata))
    opt = opt.ljust(224, b"\0")
    sections = struct.pack("<8sIIIIIIHHI", b".text", len(body), 0x1000, len(body), 0x200, 0, 0, 0, 0, 0) + struct.pack("<8sIIIIIIHHI", b".idata", len(idata), va, len(idata), 0x200 + len(body), 0, 0, 0, 0, 0)
    return (head + opt + sections).ljust(0x200, b"\0") + body + idata


def part_executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as executables: time from the size, every third with an odd entry point, every fifth with an alert call.

    A part is a few bytes and its executable takes far longer than reading it, so rows are dealt to all cores, however few files hold them.
    """
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [small_pe(900_000_000 + 2_000_000 * int(s), k % 3 == 0, b"\x55\x8b\xec" + n.encode() * 4, ["ExitProcess"] + ["WinExec"] * (k % 5 == 0)) for k, n, s in zip(f["p_partkey"], f["p_name"], f["p_size"])]
            yield pd.DataFrame({"capture": "parts", "id": f["p_partkey"], "value": made})

    return rows.mapInPandas(run, "capture string, id long, value binary")
