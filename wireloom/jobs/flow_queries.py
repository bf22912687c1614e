"""Queries over packet, message, edge and stream stand-ins, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flow as L
from ..operators import http as H
from ..operators import packets as P
from ..sources import captures, sinks
from ..sources.split_captures import frames_at
from ..functions import kernels
from ..functions.tables import TASK_ROWS, dealt_by, shared_path, written
from ..streaming import streams as T
from .stand_ins import event_packets, hexes, micros, page_visits, table, tcp_frame

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


@query("decode_packets", """SELECT event_id AS packet_no, '10.0.0.' || (user_id % 250) AS src_ip, (1024 + user_id % 60000)::INT AS src_port, '10.1.0.1' AS dst_ip, 80 AS dst_port,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 WHEN 'purchase' THEN 2 ELSE 0 END AS kind, event_id * 7 % 4294967296 AS seq, props AS payload, '02:00:00:00:00:01' AS src_mac,
  CASE WHEN '10.0.0.' || (user_id % 250) || ':' || (1024 + user_id % 60000) < '10.1.0.1:80' THEN '10.0.0.' || (user_id % 250) || ':' || (1024 + user_id % 60000) || '-10.1.0.1:80' END AS flow FROM events""")
def decode_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    flags = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 18).otherwise(24)
    u = F.col("user_id")
    frame = tcp_frame(F.concat(F.lit("0a0000"), hexes(u % 250, 1)), 1024 + u % 60000, F.lit("0a010001"), F.lit(80), flags, F.col("event_id") * 7 % (1 << 32), F.lit(0), F.encode("props", "UTF-8"))
    frames = e.select(F.lit("events").alias("capture"), F.col("event_id").alias("packet_no"), F.lit(1).alias("link_type"), micros(F.col("ts")).alias("ts_us"), F.concat(frame, F.lit(b"\0\0\0")).alias("frame"))
    p = P.decode_packets(frames)
    key = P.flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port"))
    return p.select("packet_no", "src_ip", "src_port", "dst_ip", "dst_port", "kind", "seq", F.decode("payload", "UTF-8").alias("payload"), "src_mac", key.alias("flow"))


@query("capture_files", "SELECT page_id AS file, 0::BIGINT AS packet_no, page_id * 1000003 AS ts_us, md5(html) AS md5 FROM pages")
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture file of one frame, written in either byte order, and read again."""

    def filed(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"path": f["page_id"].astype(str), "content": [kernels.write_pcap([(int(k) * 1_000_003, (h or "").encode())]) for k, h in zip(f["page_id"], f["html"])]})

    files = table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(filed, "path string, content binary")
    rows = captures.frames_of(files)
    return rows.select(F.col("capture").cast("long").alias("file"), "packet_no", "ts_us", F.md5("frame").alias("md5"))


@query("split_captures", "SELECT page_id // 1000 AS file, row_number() OVER (PARTITION BY page_id // 1000 ORDER BY page_id) - 1 AS packet_no, page_id * 1000003 AS ts_us, md5(html) AS md5 FROM pages")
def split_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of up to 1000 pages each, a page a packet, as files that are read in splits of 64 KB."""
    pages = table(spark, sf_dir, "pages").select(F.expr("page_id div 1000").alias("file"), (F.col("page_id") * 1_000_003).alias("ts_us"), F.encode("html", "UTF-8").alias("frame"))
    folder = shared_path(spark, "captures")
    written_files = sinks.write_captures(pages.select(F.col("file").cast("string").alias("capture"), F.lit(1).alias("link_type"), "ts_us", F.coalesce("frame", F.lit(b"")).alias("frame")), folder, "ts_us")
    rows = frames_at(written(written_files, "capture-files").select("path", "length"), 1 << 16)
    return rows.select(F.regexp_extract("capture", r"(\d+)\.pcap$", 1).cast("long").alias("file"), "packet_no", "ts_us", F.md5("frame").alias("md5"))


@query("filter_traffic", "SELECT event_id AS packet_no FROM events WHERE user_id % 250 = 7 AND 1024 + user_id % 60000 = 1031")
def filter_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("packet_no"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("src_ip"), F.lit("10.1.0.1").alias("dst_ip"), (1024 + F.col("user_id") % 60000).alias("src_port"), F.lit(80).alias("dst_port"))
    return P.filter_traffic(rows, ip="10.0.0.7", port=1031).select("packet_no")


@query("filter_requests", r"SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/?#]*)', 1) = (SELECT min(regexp_extract(url, '^https?://([^/?#]*)', 1)) FROM pages) AND contains(url, '/en/')")
def filter_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = page_visits(spark, sf_dir)
    return P.filter_requests(v, v.agg(F.min("host")).first()[0] or "", "/en/").select(F.col("packet_no").alias("page_id"))


@query("split_connections", "SELECT event_id AS packet_no, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS conn_no FROM events")
def split_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_packets(spark, sf_dir).withColumns({"capture": F.lit("events"), "src_ip": F.col("flow_key"), "src_port": F.lit(1), "dst_ip": F.lit("x"), "dst_port": F.lit(80)}).drop("flow_key")
    return P.split_connections(e).select("packet_no", "conn_no")


@query("close_connections", """SELECT user_id::VARCHAR AS flow_key, event_id AS packet_no FROM (SELECT *, coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM events) WHERE o = 0""")
def close_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_packets(spark, sf_dir).withColumns({"emit_no": F.col("packet_no"), "at": F.lit(0)})
    return P.close_connections(e, ["flow_key"]).select("flow_key", "packet_no")


@query("reassemble", """WITH s AS (SELECT l_orderkey, l_linenumber, (l_linenumber * 10000000::BIGINT + l_partkey) * 100 + l_quantity::BIGINT AS no, l_partkey % 50 AS seq, l_quantity::BIGINT AS len FROM lineitem), z AS (SELECT *, seq - min(seq) OVER (PARTITION BY l_orderkey) AS pos FROM s),
e AS (SELECT *, greatest(0, coalesce(max(pos + len) OVER (PARTITION BY l_orderkey ORDER BY pos, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS expected FROM z),
g AS (SELECT *, max((pos > expected)::INT) OVER (PARTITION BY l_orderkey ORDER BY pos, no ROWS UNBOUNDED PRECEDING) AS gap FROM e)
SELECT l_orderkey, l_linenumber, CASE WHEN gap = 1 THEN 0 ELSE least(len, greatest(0, pos + len - expected)) END AS kept, gap = 0 AS released FROM g""")
def reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = dealt_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", ((F.col("l_linenumber") * F.lit(10_000_000).cast("long") + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("packet_no"), (F.col("l_partkey") % 50).alias("seq"), F.col("l_quantity").cast("long").alias("len"))
    s = s.withColumn("start", F.min("seq").over(Window.partitionBy("l_orderkey")))
    return P.reassemble(s, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "kept", "released")


@query("reassemble_long", """WITH s AS (SELECT l_orderkey, l_linenumber, r, line * 8 + r AS i, l_quantity::BIGINT * 10000000 AS len FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS line FROM lineitem), range(8) t(r)),
z AS (SELECT *, max(CASE WHEN l_orderkey % 5 = 0 AND i = 21 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS gap FROM s)
SELECT l_orderkey, l_linenumber, r, CASE WHEN gap = 1 THEN 0 ELSE len END AS kept, gap = 0 AS released FROM z WHERE NOT (l_orderkey % 5 = 0 AND i = 21)""")
def reassemble_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of many GiB (their lengths only): numbers wrap, neighbours come in the wrong order, and every fifth stream lacks a segment."""
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    s = dealt_by(table(spark, sf_dir, "lineitem"), ["l_orderkey"], TASK_ROWS // 8).select("l_orderkey", "l_linenumber", line.alias("line"), (F.col("l_quantity").cast("long") * 10_000_000).alias("len"))
    s = s.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("r")).withColumn("i", F.col("line") * 8 + F.col("r"))
    ahead = Window.partitionBy("l_orderkey").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"start": F.lit(4_294_967_000), "seq": F.pmod(F.lit(4_294_967_000) + F.coalesce(F.sum("len").over(ahead), F.lit(0)), F.lit(1 << 32)), "packet_no": F.col("i").bitwiseXOR(F.lit(1).cast("long"))})
    s = s.where(~((F.col("l_orderkey") % 5 == 0) & (F.col("i") == 21)))
    return P.reassemble(s, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "r", "kept", "released")


@query("segment_messages", """SELECT conv_id, turn, sum(c) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS msg_no FROM (SELECT *, (lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role)::INT AS c FROM conversations)""")
def segment_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.segment_messages(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "msg_no")


@query("pair_exchanges", """SELECT conv_id, turn, md5(coalesce(text, '')) AS request, CASE WHEN nr = 'assistant' THEN md5(coalesce(nt, '')) END AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def pair_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("is_request"), F.struct("role", F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    pairs = H.pair_exchanges(m, ["conv_id"], "turn")
    return pairs.select("conv_id", "turn", F.md5("request.text").alias("request"), F.when(F.col("response.role") == "assistant", F.md5("response.text")).alias("response"))


@query("skip_continue", "SELECT page_id AS conn_no, 'head' || html AS request, 'answer' AS response FROM pages")
def skip_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    one = lambda n, q, s, x, raw: F.struct(F.lit(n).alias("msg_no"), F.lit(q).alias("is_request"), F.lit(s).cast("int").alias("status"), F.lit(x).alias("expects"), raw.alias("raw"))
    rows = p.select("page_id", F.explode(F.array(one(1, True, None, True, F.encode(F.lit("head"), "UTF-8")), one(2, False, 100, False, F.encode(F.lit("go on"), "UTF-8")), one(3, False, None, False, F.encode("html", "UTF-8")), one(4, False, 200, False, F.encode(F.lit("answer"), "UTF-8")))).alias("m")).select(F.col("page_id").alias("conn_no"), "m.*")
    kept = H.skip_continue(rows, ["conn_no"]).withColumn("m", F.struct("raw"))
    pairs = H.pair_exchanges(kept, ["conn_no"])
    return pairs.select("conn_no", F.decode("request.raw", "UTF-8").alias("request"), F.decode("response.raw", "UTF-8").alias("response"))


CANDIDATES = """c AS (SELECT o_orderdate, o_orderkey, l_linenumber, lower(a.n_name) AS parent, lower(b.n_name) AS child FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE a.n_name <> b.n_name),
e0 AS (SELECT child, min((o_orderdate, o_orderkey, l_linenumber, parent)) AS k FROM c GROUP BY child),
e AS (SELECT row_number() OVER (ORDER BY k, child) AS idx, k[4] AS parent, child FROM e0),
h AS (SELECT lower(n_name) AS host FROM nation), i AS (SELECT host FROM h WHERE host NOT IN (SELECT parent FROM e) AND host NOT IN (SELECT child FROM e))"""


def edge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer's nation to supplier's nation, in the order of orders and lines."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name"))
    c = table(spark, sf_dir, "customer").join(n.withColumnRenamed("name", "parent"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "parent")
    s = table(spark, sf_dir, "supplier").join(n.withColumnRenamed("name", "child"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "child")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", micros(F.col("o_orderdate")).alias("pass"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).where("parent <> child")
    return rows.select(F.lit("orders").alias("capture"), "pass", F.struct(F.col("o_orderkey").alias("o"), F.col("l_linenumber").alias("l")).alias("id"), "parent", "child", F.lit("order").alias("kind"))


def edges_and_alone(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    edges = written(L.flow_edges(edge_candidates(spark, sf_dir)), "flow-edges")
    hosts = table(spark, sf_dir, "nation").select(F.lit("orders").alias("capture"), F.col("n_name").alias("host"))
    return edges, L.isolated_hosts(hosts, edges)


@query("flow_edges", f"WITH {CANDIDATES} SELECT idx, parent, child FROM e")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_and_alone(spark, sf_dir)[0].select("idx", "parent", "child")


@query("isolated_hosts", f"WITH {CANDIDATES} SELECT host FROM i")
def isolated_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_and_alone(spark, sf_dir)[1].select("host")


@query("flow_paths", f"""WITH RECURSIVE {CANDIDATES}, r AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.child = e.parent AND x.idx < e.idx)),
p(idx, child, path) AS (SELECT idx, child, 'Client>' || parent || '>' || child FROM r UNION ALL SELECT e.idx, e.child, path || '>' || e.child FROM p JOIN e ON e.parent = p.child AND e.idx > p.idx)
SELECT path FROM p UNION ALL SELECT DISTINCT 'Client>' || parent FROM r UNION ALL SELECT 'Client>' || host FROM i""")
def flow_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, alone = edges_and_alone(spark, sf_dir)
    return L.flow_paths(edges, alone).select(F.array_join("path", ">").alias("path"))


@query("flow_size", f"WITH {CANDIDATES}, r AS (SELECT DISTINCT parent FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.child = e.parent AND x.idx < e.idx)) SELECT 'orders' AS capture, 45 * ((SELECT count(*) FROM r) + (SELECT count(*) FROM i)) AS size")
def flow_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flow_size(*edges_and_alone(spark, sf_dir))


@query("flow_candidates", r"""WITH v AS (SELECT page_id AS id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages), r AS (SELECT v.id, v.host, w.host AS ref FROM v LEFT JOIN v w ON w.id = v.id // 2), s AS (SELECT host, min(id) AS f FROM v GROUP BY 1), q AS (SELECT host, row_number() OVER (ORDER BY f) AS pass FROM s)
SELECT pass, id, ref AS parent, r.host AS child, 'referer' AS kind FROM r JOIN q ON q.host = ref WHERE ref <> r.host UNION ALL SELECT 0, id, host, 'moved.example', 'redirect' FROM v WHERE id % 10 = 0""")
def flow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    before = p.select(F.col("page_id").alias("b"), F.col("url").alias("referer"))
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    moved = F.when(F.col("page_id") % 10 == 0, "http://Moved.example/x").otherwise("")
    convs = p.join(before, F.floor(F.col("page_id") / 2) == F.col("b")).select(F.lit("pages").alias("capture"), F.col("page_id").alias("id"), host.alias("host"), "referer", moved.alias("redirect_to"))
    return L.flow_candidates(convs).select("pass", "id", "parent", "child", "kind")


def ran(stream: DataFrame) -> DataFrame:
    """The rows of a stream over what is there now, written to the shared folder and read again."""
    spark = stream.sparkSession
    base = shared_path(spark, "stream")
    name, provider = T.KEYED_STATE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a pattern, as a single file cannot be a stream's base path
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


#: Connections of events: a signup opens one, and so does a purchase while none is open; an error ends it; the rest is dropped while none is open.
EVENT_CONNECTIONS = """WITH e AS (SELECT user_id::VARCHAR AS flow_key, event_id, epoch_us(ts) AS ts_us, event_type, round(value * 100)::BIGINT AS size, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM events),
a AS (SELECT *, sum((event_type IN ('signup', 'purchase'))::INT) OVER (PARTITION BY flow_key, part ORDER BY event_id) AS asked FROM e), p AS (SELECT *, lag(asked) OVER (PARTITION BY flow_key, part ORDER BY event_id) AS b FROM a),
c AS (SELECT *, sum((event_type = 'signup' OR (event_type = 'purchase' AND coalesce(b, 0) = 0))::INT) OVER (PARTITION BY flow_key ORDER BY event_id) AS n FROM p WHERE asked > 0),
g AS (SELECT flow_key, n, min(event_id) AS first_packet_no, arg_min(ts_us, event_id) AS first_ts_us, arg_max(ts_us, event_id) AS last_ts_us, count(*) AS packets, sum(size)::BIGINT AS bytes, arg_max(event_type, event_id) = 'error' AS closed, max(n) OVER (PARTITION BY flow_key) AS last FROM c GROUP BY flow_key, n)
SELECT flow_key, first_packet_no, first_ts_us, last_ts_us, packets, bytes, closed FROM g"""


@query("stream_connections", EVENT_CONNECTIONS + " WHERE closed OR n < last")
def stream_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that ended; those still open wait for what is to come."""
    return ran(T.stream_connections(event_packets(spark, sf_dir, event_stream(spark, sf_dir)), idle_us=10 * 365 * 86_400_000_000))


@query("stream_dedupe", "SELECT DISTINCT user_id::VARCHAR AS host, event_type AS uri FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("host"), F.col("event_type").alias("uri"), F.col("ts").cast("timestamp").alias("ts"))
    return ran(T.stream_dedupe(e, "3650 days")).select("host", "uri")
