"""Queries of sources, streams and rules that the other modules leave unasked, with DuckDB SQL beside each."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.tables import dealt_by, shared_path, written
from ..operators import conversations as C
from ..operators import executables as X
from ..operators import flow as L
from ..operators import http as H
from ..operators import objects as O
from ..operators import packets as P
from ..operators import report as R
from ..sources import captures, sinks
from ..streaming import streams as T
from .flow_queries import EVENT_CONNECTIONS, ran
from .stand_ins import event_packets, host_of, page_frames, part_executables, small_pe, table
from .web_queries import FILENAME, SHORT, VISITS, conversations

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("continued_and_reopened", f"""WITH {VISITS} SELECT host, uri, CASE WHEN page_id % 5 = 1 THEN 'POST' ELSE 'GET' END AS method, '200 OK' AS res_num, 'reader/' || (page_id % 5) AS agent, server_ip_port,
  octet_length(encode(html))::BIGINT AS res_len, md5(html) AS md5, CASE WHEN page_id % 5 = 1 THEN 'field=' || page_id ELSE '' END AS sent FROM v
UNION ALL SELECT 'again.example', '/again/' || page_id, 'GET', NULL, NULL, server_ip_port, NULL, NULL, '' FROM v WHERE page_id % 5 = 2""")
def continued_and_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From frames to conversations where some requests wait for a 100 and some connections go on after the server's FIN."""
    rows = H.exchanges(P.messages_of(P.decode_packets(page_frames(spark, sf_dir, odd=True))))
    sent = F.substring_index(F.decode("req", "ISO-8859-1"), "\r\n\r\n", -1)
    return rows.select("host", "uri", "method", "res_num", F.try_element_at("req_headers", F.lit("user-agent")).alias("agent"), "server_ip_port", "res_len", F.md5("res_body").alias("md5"), sent.alias("sent"))


@query("stream_starts", """WITH s AS (SELECT l_orderkey AS k, (l_linenumber * 10000000::BIGINT + l_partkey) * 100 + l_quantity::BIGINT AS n, l_suppkey % 2 AS src, (4294967256 + l_partkey % 80) % 4294967296 AS seq, l_quantity::BIGINT AS len, l_partkey % 97 AS ack,
  CASE WHEN l_orderkey % 3 = 0 AND l_linenumber IN (1, 2) THEN l_linenumber ELSE 0 END AS kind FROM lineitem),
t AS (SELECT *, seq + (kind > 0)::INT AS shaken, first_value(src) OVER (PARTITION BY k ORDER BY n) AS fsrc, first_value(seq + (kind > 0)::INT) OVER (PARTITION BY k, src ORDER BY n) AS fseq FROM s),
u AS (SELECT *, min(CASE WHEN kind = 2 THEN n END) OVER (PARTITION BY k, src) AS an, min(CASE WHEN src = fsrc AND ack <> 0 THEN n END) OVER (PARTITION BY k) AS tn FROM t),
v AS (SELECT *, max(CASE WHEN n = an THEN shaken END) OVER (PARTITION BY k, src) AS answer, max(CASE WHEN n = tn THEN ack END) OVER (PARTITION BY k) AS told FROM u),
w AS (SELECT k, n, src, len, shaken, (CASE WHEN src = fsrc THEN fseq ELSE coalesce(answer, told, fseq) END) % 4294967296 AS start FROM v),
p AS (SELECT *, ((shaken - start + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS pos FROM w),
e AS (SELECT *, greatest(0, coalesce(max(pos + len) OVER (PARTITION BY k, src ORDER BY pos, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS expected FROM p),
g AS (SELECT *, max((pos > expected)::INT) OVER (PARTITION BY k, src ORDER BY pos, n ROWS UNBOUNDED PRECEDING) AS gap FROM e)
SELECT k AS l_orderkey, n AS packet_no, start, CASE WHEN gap = 1 THEN 0 ELSE least(len, greatest(0, pos + len - expected)) END AS kept, gap = 0 AS released FROM g""")
def stream_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as segments of two sides: with and without handshakes, numbers that wrap, and data from before the start."""
    n = F.col("l_linenumber")
    kind = F.when((F.col("l_orderkey") % 3 == 0) & n.isin(1, 2), n).otherwise(0)
    no = (n * F.lit(10_000_000).cast("long") + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")
    s = dealt_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).select("l_orderkey", (F.col("l_suppkey") % 2).alias("src"), no.alias("packet_no"), ((4294967256 + F.col("l_partkey") % 80) % (1 << 32)).alias("seq"), F.col("l_quantity").cast("long").alias("len"), (F.col("l_partkey") % 97).alias("ack"), kind.alias("kind"))
    rows = P.stream_starts(s, ["l_orderkey"]).withColumn("seq", F.col("seq") + F.when(F.col("kind") > 0, 1).otherwise(0))
    return P.reassemble(rows, ["l_orderkey", "src"]).select("l_orderkey", "packet_no", "start", "kept", "released")


@query("import_hashes", """SELECT p_partkey AS object_id, md5('ws2_32.' || CASE p_partkey % 5 WHEN 0 THEN 'wsastartup' WHEN 1 THEN 'wsacleanup' WHEN 2 THEN 'socket' WHEN 3 THEN 'connect' ELSE 'ord999' END || ',kernel32.exitprocess,other.ord7') AS imphash FROM part""")
def import_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by number, of a library whose numbers are known and of one whose are not."""
    number = F.element_at(F.array(*[F.lit(x) for x in (115, 116, 23, 4, 999)]), (F.col("p_partkey") % 5 + 1).cast("int"))
    one = lambda dll, name, ordinal: F.struct(F.lit(dll).alias("dll"), F.lit(name).cast("string").alias("name"), ordinal.cast("int").alias("ordinal"))
    imports = F.array(one("WS2_32.dll", None, number), one("KERNEL32.DLL", "ExitProcess", F.lit(None)), one("other.ocx", None, F.lit(7)))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), X.imphash(imports).alias("imphash"))


@query("folded_checksums", """WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, n, rpad(h, ((length(h) + 7) // 8 * 8)::INT, '0') AS h FROM b),
w AS (SELECT doc_id, i, substr(h, 8 * i + 1, 8) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 8)) AS i FROM p)),
s AS (SELECT doc_id, sum(('0x' || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2))::BIGINT)::BIGINT AS t FROM w WHERE i <> 2 GROUP BY 1),
f AS (SELECT doc_id, (t & 4294967295) + (t >> 32) AS t FROM s), g AS (SELECT doc_id, (t & 4294967295) + (t >> 32) AS t FROM f), k AS (SELECT doc_id, (t & 65535) + (t >> 16) AS t FROM g)
SELECT d.doc_id, (coalesce((t + (t >> 16)) & 65535, 0) + n)::BIGINT AS checksum FROM b d LEFT JOIN k USING (doc_id)""")
def folded_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum of executables, over the bytes of every document, with its field at byte 8."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", X.pe_checksum(F.encode("text", "UTF-8"), F.lit(8)).alias("checksum"))


@query("report_peeks", f"""WITH {VISITS} SELECT id, {FILENAME} AS filename, {SHORT} AS short_uri, md5(html) AS md5, regexp_replace(rtrim(regexp_replace(base64(encode(html)), '(.{{76}})', '\\1' || chr(10), 'g'), chr(10)), '^$', '') AS base64,
  CASE WHEN octet_length(encode(left(html, 128))) = length(left(html, 128)) THEN left(html, 128) || CASE WHEN octet_length(encode(html)) > 128 THEN '...' ELSE '' END END AS peek FROM n""")
def report_peeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the report shows of a body; peeks of other than ASCII, which SQL cuts by characters, are left out on both sides."""
    plain = F.octet_length(F.left(F.decode("res_body", "UTF-8"), F.lit(128))) == F.length(F.left(F.decode("res_body", "UTF-8"), F.lit(128)))
    convs = conversations(spark, sf_dir)
    rows = R.report_rows(convs).join(convs.select("id", plain.alias("plain")), "id")
    return rows.select("id", "filename", "short_uri", "md5", "base64", F.when(F.col("plain"), F.col("peek")).alias("peek"))


REFERERS = r"""h AS (SELECT page_id AS id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages),
c AS (SELECT a.id, b.host AS parent, a.host AS child FROM h a JOIN h b ON b.id = a.id // 2 WHERE a.host <> b.host AND a.id % 11 = 0),
s AS (SELECT host, min(id) AS f FROM h GROUP BY 1), q AS (SELECT host, row_number() OVER (ORDER BY f) AS pass FROM s),
k AS (SELECT child, min((pass, id, parent)) AS k FROM c JOIN q ON q.host = parent GROUP BY child),
e AS (SELECT row_number() OVER (ORDER BY k[1], k[2], child) AS idx, k[3] AS parent, child FROM k),
i AS (SELECT DISTINCT host FROM h WHERE host NOT IN (SELECT parent FROM e) AND host NOT IN (SELECT child FROM e))"""


def referred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages as conversations, every eleventh with the page of half its number as referer, and the edges of that."""
    p = table(spark, sf_dir, "pages")
    before = p.select(F.col("page_id").alias("b"), F.col("url").alias("before"))
    convs = p.join(before, F.floor(F.col("page_id") / 2) == F.col("b"), "left")
    convs = convs.select(F.lit("pages").alias("capture"), F.col("page_id").alias("id"), host_of(F.col("url")).alias("host"), F.when(F.col("page_id") % 11 == 0, F.col("before")).otherwise("").alias("referer"), F.lit("").alias("redirect_to"))
    return convs, written(L.flow_edges(L.flow_candidates(convs)), "flow-edges")


@query("isolated_pages", f"WITH {REFERERS} SELECT host FROM i")
def isolated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.isolated_hosts(*referred(spark, sf_dir)).select("host")


@query("report_parts", f"""WITH RECURSIVE {REFERERS}, r AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.child = e.parent AND x.idx < e.idx)),
p(idx, child, path) AS (SELECT idx, child, 'Client>' || parent || '>' || child FROM r UNION ALL SELECT e.idx, e.child, path || '>' || e.child FROM p JOIN e ON e.parent = p.child AND e.idx > p.idx)
SELECT 'flow' AS part, path AS value FROM (SELECT path FROM p UNION ALL SELECT DISTINCT 'Client>' || parent FROM r UNION ALL SELECT 'Client>' || host FROM i)
UNION ALL SELECT 'info', count(*) || ' ' || min(page_id) FROM pages UNION ALL SELECT 'client', 'X-FIRST=' || arg_min(url, page_id) FROM pages
UNION ALL SELECT 'conversation', regexp_extract(url, '^https?://([^/?#]*)', 1) || ' ' || page_id FROM pages""")
def report_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four parts of the report document, read back from its JSON."""
    convs, edges = referred(spark, sf_dir)
    urls = table(spark, sf_dir, "pages").select(F.lit("pages").alias("capture"), F.col("page_id").alias("ts_us"), F.col("page_id").alias("packet_no"), F.create_map(F.lit("x-first"), F.col("url")).alias("req_headers"))
    paths = L.flow_paths(edges, L.isolated_hosts(convs, edges)).select("capture", "path")
    rows = convs.select("capture", "id", "host", F.lit("").alias("server_ip_port"))
    doc = R.report_document(rows, paths, C.capture_info(urls, urls), C.client_profile(urls))
    kind = "flow array<array<string>>, info struct<conversations:long,first_packet_us:long>, client array<struct<key:string,value:string>>, conversations array<struct<host:string,conversations:array<struct<id:long>>>>"
    d = sinks.report_lines(doc).select(F.from_json("value", kind).alias("d")).select("d.*")
    part = lambda name, values: d.select(F.lit(name).alias("part"), F.explode(values).alias("value"))
    found = part("flow", F.transform("flow", lambda x: F.array_join(x, ">"))).unionByName(part("info", F.array(F.concat_ws(" ", F.col("info.conversations").cast("string"), F.col("info.first_packet_us").cast("string")))))
    found = found.unionByName(part("client", F.transform("client", lambda x: F.concat(x["key"], F.lit("="), x["value"]))))
    return found.unionByName(part("conversation", F.flatten(F.transform("conversations", lambda h: F.transform(h["conversations"], lambda c: F.concat_ws(" ", h["host"], c["id"].cast("string")))))))


@query("pcapng_files", "SELECT page_id AS file, k::BIGINT AS packet_no, page_id * 1000000 + k * 500000 AS ts_us, md5(html) AS md5 FROM pages, (VALUES (0), (1)) t(k)")
def pcapng_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a pcapng file of two frames, its time in units of 10^-6, 10^-9 or 2^-20 seconds, and read again."""

    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [kernels.write_pcapng([(int(k) * 1_000_000 + i * 500_000, (h or "").encode()) for i in (0, 1)], (6, 9, 0x80 | 20)[k % 3]) for k, h in zip(f["page_id"], f["html"])]
            yield pd.DataFrame({"path": f["page_id"].astype(str), "content": made})

    files = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(filed, "path string, content binary")
    return captures.frames_of(files).select(F.col("capture").cast("long").alias("file"), "packet_no", "ts_us", F.md5("frame").alias("md5"))


@query("proxy_archives", r"""SELECT page_id AS file, k = 0 AS is_request, '192.168.0.9:1234' AS client, '10.0.0.1:' || CASE WHEN page_id % 2 = 0 THEN '8080' ELSE '80' END AS server,
  md5(CASE k WHEN 0 THEN 'GET /p/' || page_id || '?q=1 HTTP/1.1' || chr(13) || chr(10) || 'Host: h' || chr(13) || chr(10) || chr(13) || chr(10) ELSE 'HTTP/1.1 200 OK' || chr(13) || chr(10) || chr(13) || chr(10) || html END) AS md5 FROM pages, (VALUES (0), (1)) t(k)""")
def proxy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a session in a proxy's archive, asked for through the proxy, and read again."""

    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bodies = []
            for k, html in zip(f["page_id"], f["html"]):
                with zipfile.ZipFile(out := io.BytesIO(), "w") as z:
                    z.writestr("raw/1_m.xml", '<Session><SessionFlags><SessionFlag N="x-clientip" V="::ffff:192.168.0.9"/><SessionFlag N="x-clientport" V="1234"/><SessionFlag N="x-hostip" V="10.0.0.1"/></SessionFlags></Session>')
                    z.writestr("raw/1_c.txt", f"GET http://h{':8080' if k % 2 == 0 else ''}/p/{k}?q=1 HTTP/1.1\r\nHost: h\r\n\r\n")
                    z.writestr("raw/1_s.txt", "HTTP/1.1 200 OK\r\n\r\n" + (html or ""))
                bodies.append(out.getvalue())
            yield pd.DataFrame({"path": f["page_id"].astype(str), "content": bodies})

    files = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(filed, "path string, content binary")
    return captures.saz_of(files).select(F.col("capture").cast("long").alias("file"), "is_request", "client", "server", F.md5("raw").alias("md5"))


@query("type_signature_files", "SELECT p_name || ' ' || p_partkey AS description, upper(printf('%04x', p_partkey::INT % 65536)) || '00' AS prefix_hex, 'X' || (p_partkey % 9) AS ext, CASE WHEN p_partkey % 2 = 0 THEN 'a,b' ELSE '' END AS required FROM part")
def type_signature_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of a signature file, written as CSV and read again."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", k.cast("string")), F.concat(F.regexp_replace(F.lpad(F.hex(k % 65536), 4, "0"), "(..)", "$1 "), F.lit("00")), F.concat(F.lit("X"), (k % 9).cast("string")), F.when(k % 2 == 0, "a;;b").otherwise(""))
    path = shared_path(spark, "signatures")
    rows.write.csv(path)
    return captures.read_signatures(spark, path).select("description", "prefix_hex", "ext", F.array_join("required", ",").alias("required"))


@query("streamed_frames", "SELECT page_id AS file, 0::BIGINT AS packet_no, page_id * 1000003 AS ts_us, md5(html) AS md5 FROM pages")
def streamed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files as they arrive, from a folder of tables that hold them."""

    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["page_id"].astype(str), "content": [kernels.write_pcap([(int(k) * 1_000_003, (h or "").encode())]) for k, h in zip(f["page_id"], f["html"])]})

    path = shared_path(spark, "arriving")
    table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(filed, "path string, content binary").write.parquet(path)
    rows = ran(T.arriving_frames(spark.readStream.schema("path string, content binary").parquet(path)))
    return rows.select(F.col("capture").cast("long").alias("file"), "packet_no", "ts_us", F.md5("frame").alias("md5"))


@query("stream_connections_flushed", EVENT_CONNECTIONS)
def stream_connections_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All connections: those still open are flushed when event time, moved on by a last packet of no flow, has left them idle for an hour."""
    p = event_packets(spark, sf_dir)
    day = F.max("ts_us") + 86_400_000_000
    end = p.agg(F.lit("").alias("flow_key"), F.lit(-1).cast("long").alias("packet_no"), F.timestamp_micros(day).alias("ts"), day.alias("ts_us"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("size"), F.lit(True).alias("asks"))
    path = shared_path(spark, "arriving")
    p.unionByName(end).write.parquet(path)
    return ran(T.stream_connections(spark.readStream.schema(p.schema).parquet(path))).where("flow_key <> ''")


@query("stream_segments", f"""WITH {VISITS}, m AS (SELECT packet_no, 'GET ' || uri || ' HTTP/1.1' || n || 'Host: ' || host || n || 'User-Agent:  reader/' || (page_id % 5) || ' ' || n || 'Accept: */*' || n || n AS req,
  'HTTP/1.1 200 OK' || n || 'Content-Type: text/html; charset=UTF-8' || n || 'Content-Length: ' || octet_length(encode(html)) || n || n || html AS res FROM v, (SELECT chr(13) || chr(10) AS n))
SELECT packet_no AS page_id, 'request' AS side, octet_length(encode(req))::BIGINT AS bytes, md5(req) AS md5 FROM m UNION ALL SELECT packet_no, 'response', octet_length(encode(res))::BIGINT, md5(res) FROM m""")
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each side of each page's connection, put together as packets arrive: parts come early and twice."""
    end = lambda x: F.concat_ws(":", f"{x}_ip", F.col(f"{x}_port").cast("string"))
    p = P.decode_packets(page_frames(spark, sf_dir))
    key = F.concat_ws("/", P.flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")), F.floor(F.col("packet_no") / 100_000).cast("string"))
    path = shared_path(spark, "arriving")
    p.select(key.alias("flow_key"), "packet_no", F.timestamp_micros("ts_us").alias("ts"), "ts_us", end("src").alias("src"), "kind", "seq", "ack", "payload").write.parquet(path)
    kinds = "flow_key string, packet_no long, ts timestamp, ts_us long, src string, kind int, seq long, ack long, payload binary"
    rows = ran(T.stream_segments(spark.readStream.schema(kinds).parquet(path)))
    whole = rows.groupBy("flow_key", "src").agg(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY at)").alias("data"))
    side = F.when(F.col("src").endswith(":80"), "response").otherwise("request")
    return whole.select(F.substring_index("flow_key", "/", -1).cast("long").alias("page_id"), side.alias("side"), F.length("data").cast("long").alias("bytes"), F.md5("data").alias("md5"))


@query("section_entropies", r"""WITH b AS (SELECT p_partkey, '558BEC' || repeat(hex(encode(p_name)), 4) AS h FROM part), x AS (SELECT p_partkey, substr(h, (2 * i + 1)::BIGINT, 2) AS x, length(h) / 2 AS n FROM (SELECT p_partkey, h, unnest(range(0, length(h) // 2)) AS i FROM b)),
c AS (SELECT p_partkey, x, n, count(*) / n AS p FROM x GROUP BY p_partkey, x, n), e AS (SELECT p_partkey, n, -sum(p * log2(p)) AS e FROM c GROUP BY 1, 2)
SELECT p_partkey AS object_id, n::BIGINT AS raw_size, round(e, 6) AS entropy, n = 0 OR (e > 0 AND e < 1) OR e > 7 AS suspicious FROM e""")
def section_entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the section rows say of the code of each part's executable."""
    rows = X.pe_sections(X.pe_headers(part_executables(spark, sf_dir))).where("name = '.text'")
    return rows.select("object_id", "raw_size", F.round("entropy", 6).alias("entropy"), "suspicious")


@query("client_of_frames", """SELECT 'IP' AS key, '192.168.0.1' AS value UNION ALL SELECT 'MAC', '02:00:00:00:00:01' UNION ALL SELECT 'USER-AGENT', 'reader/' || (min(page_id) % 5) FROM pages""")
def client_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address and unusual headers of the client, from frames."""
    packets = P.decode_packets(page_frames(spark, sf_dir))
    return C.client_profile(H.exchanges(P.messages_of(packets)), packets).select("key", "value")


@query("written_objects", f"WITH {VISITS} SELECT id || '-' || {FILENAME} AS file_name, md5(html) AS md5 FROM n WHERE NOT lower({FILENAME}) LIKE '%.exe'")
def written_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as their writer leaves them, read again."""
    path = shared_path(spark, "objects")
    sinks.write_objects(O.objects(conversations(spark, sf_dir)), path, dump_exe=False)
    return spark.read.parquet(path).where("capture = 'pages'").select("file_name", F.md5("value").alias("md5"))


@query("object_files", f"WITH {VISITS} SELECT id || '-' || {FILENAME} AS file_name, octet_length(encode(html))::BIGINT AS length, md5(html) AS md5 FROM n WHERE NOT lower({FILENAME}) LIKE '%.exe'")
def object_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as files of their own, found again in their capture's folder."""
    folder = shared_path(spark, "object-files")
    written(sinks.object_files(O.objects(conversations(spark, sf_dir)), folder, dump_exe=False), "object-paths")
    files = spark.read.format("binaryFile").load(f"{folder}/pages")
    return files.select(F.substring_index("path", "/", -1).alias("file_name"), "length", F.md5("content").alias("md5"))


@query("written_reports", f"WITH {VISITS} SELECT host, string_agg(id, ',' ORDER BY id) AS ids, min(md5(html)) AS least FROM n GROUP BY host, server_ip_port")
def written_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as its writer leaves it, a JSON line a capture, read again."""
    convs = conversations(spark, sf_dir)
    rows = R.report_rows(convs).select("capture", "id", "host", "server_ip_port", "uri", "md5")
    paths = C.hosts_tree(convs).select("capture", F.array(F.lit("Client"), "host").alias("path"))
    path = shared_path(spark, "reports")
    sinks.write_report(R.report_document(rows, paths, C.capture_info(convs, convs), C.client_profile(convs.withColumn("req_headers", F.create_map(F.lit("x"), F.col("host"))))), path)
    d = spark.read.text(path).where("capture = 'pages'").select(F.from_json("value", "conversations array<struct<host:string,conversations:array<struct<id:long,md5:string>>>>").alias("d"))
    hosts = d.select(F.explode("d.conversations").alias("h"))
    return hosts.select("h.host", F.array_join(F.transform("h.conversations", lambda c: c["id"].cast("string")), ",").alias("ids"), F.array_min(F.transform("h.conversations", lambda c: c["md5"])).alias("least"))


@query("deobfuscate_whole", r"""WITH x AS (SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z]{2,}'), ' ') AS plain FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR plain = '' OR (doc_id % 3 = 0 AND NOT contains(plain, ' ')) THEN '' WHEN doc_id % 3 = 0 THEN 'urlencoded' ELSE 'packed' END AS detected, plain FROM x""")
def deobfuscate_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as scripts, URL-encoded or packed with as many digits a key as it takes, and undone."""

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, text in zip(f["doc_id"], f["text"]):
                words = re.findall("[A-Za-z]{2,}", text)
                place = {w: i for i, w in enumerate(dict.fromkeys(words))}
                if k % 3 == 0:
                    out.append("%20".join(words))
                elif k % 3 == 1 and words:
                    keys = " ".join(np.base_repr(place[w], 36).lower() for w in words)
                    out.append(f"eval(function(p,a,c,k,e,d){{return p}}('{keys}',36,{len(place)},'{'|'.join(place)}'.split('|'),0,{{}}))")
                else:
                    out.append(" ".join(words))
            yield pd.DataFrame({"doc_id": f["doc_id"], "code": out})

    scripts = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text").mapInPandas(packed, "doc_id long, code string")
    return O.deobfuscate(scripts).select("doc_id", F.array_join("detected", ",").alias("detected"), "plain")


@query("packer_scan", r"""WITH d AS (SELECT doc_id, doc_id % 3 = 0 AS odd, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, substr(h, 1, 4) AS a, substr(h, 7, 26) AS b, substr(h, 7, 1018) AS c, doc_id % 2 = 0 AS ep FROM d WHERE length(h) >= 32),
i AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark WHERE length(text) > 9), p AS (SELECT item_id, substr(h, 1, 18) AS start, rtrim(regexp_replace(h, '(.{18})..', '\1..', 'g'), '.') AS pat FROM i)
SELECT d.doc_id, CASE WHEN ep THEN 'e' ELSE 's' END || s.doc_id AS name, CASE WHEN ep THEN 'entry' ELSE 'section' END AS place, 0::BIGINT AS at FROM s JOIN d ON substr(d.h, 1, 4) = a AND substr(d.h, 7, 26) = b AND starts_with(substr(d.h, 7), c) WHERE NOT (ep AND odd)
UNION ALL SELECT doc_id, 'a' || item_id, 'anywhere', length(regexp_extract(d.h, '^((?:..)*?)' || pat, 1)) // 2 FROM d JOIN p ON contains(d.h, start) WHERE regexp_matches(d.h, '^(?:..)*' || pat)""")
def packer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as code of executables, every third with its entry point elsewhere. Signatures: the starts of documents, of even ones for
    the entry point and of odd ones for starts of sections, with any third byte; whole benchmark items for anywhere, with any tenth byte."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")

    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"capture": "documents", "id": f["doc_id"], "value": [small_pe(1_300_000_000, k % 3 == 0, t.encode(), ["ExitProcess"]) for k, t in zip(f["doc_id"], f["text"])]})

    h = F.hex(F.encode(F.col("text"), "UTF-8"))
    even = F.col("doc_id") % 2 == 0
    starts = docs.where(F.length(h) >= 32).select(F.concat(F.when(even, "e").otherwise("s"), "doc_id").alias("name"), F.concat(F.substring(h, 1, 4), F.lit("??"), F.substring(h, 7, 1018)).alias("pattern_hex"), even.alias("ep_only"), (~even).alias("section_start_only"))
    items = table(spark, sf_dir, "benchmark").where("length(text) > 9")
    wild = F.regexp_replace(F.regexp_replace(h, "(.{18})..", "$1??"), r"(\?\?)+$", "")
    items = items.select(F.concat(F.lit("a"), "item_id").alias("name"), wild.alias("pattern_hex"), F.lit(False).alias("ep_only"), F.lit(False).alias("section_start_only"))
    found = X.packer_matches(docs.mapInPandas(filed, "capture string, id long, value binary"), starts.unionByName(items))
    return found.select(F.col("object_id").alias("doc_id"), "name", "place", (F.col("at") - 0x200).alias("at"))
