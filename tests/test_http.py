import gzip
import zlib

from pyspark.sql import functions as F

from wireloom.functions import kernels
from wireloom.operators import http as H

HEAD = "GET http://h.example/a?b HTTP/1.1\r\nHost: h.example\r\nX-A: one\r\nbroken\r\nx-a:  two : 3 \r\nExpect: 100-continue"


def one(spark, cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_request_head(spark):
    r = one(spark, H.request_columns(F.lit(HEAD)))
    assert (r.method, r.uri, r.host, r.expects, r.req_headers["x-a"]) == ("GET", "/a?b", "h.example", True, "two : 3")
    r = one(spark, H.request_columns(F.lit("GET /a b HTTP/1.1\r\nHost: x")))
    assert (r.method, r.uri, r.host) == ("", "", "x")


def test_response_head(spark):
    r = one(spark, H.response_columns(F.lit('HTTP/1.1 302 Moved Away\r\nLocation: http://b/\r\nContent-Disposition: attachment; filename="a=b.exe"  \r\nTransfer-Encoding: chunked\r\nConnection: close')))
    assert (r.res_num, r.status, r.redirect_to, r.disposition_name, r.chunked, r.close) == ("302 Moved Away", 302, "http://b/", '"a', True, True)


def test_bodies(spark):
    assert kernels.dechunk(b"3;x\r\nabc\r\n2\r\nde\r\n0\r\n\r\nrest") == b"abcde"
    assert kernels.dechunk(b"3\r\nabc\r\nzz\r\nde") == b"abc"
    text = b"hello " * 10
    assert kernels.framed(gzip.compress(text), 0, False)[1] == text
    assert kernels.gunzip(b"\x1f\x8b\x08broken-bytes") is None and kernels.gunzip(b"short") == b"short"
    assert kernels.inflate(zlib.compress(text)) == text and kernels.inflate(zlib.compress(text)[2:-4]) == text
    assert kernels.decode("é".encode("gb18030"), None) == "é" and kernels.decode(b"\xff", "no-such") == "[undecodable content]"
    df = spark.createDataFrame([(b"3\r\nabc\r\n0\r\n", 0, True), (b"abcdef", 4, False), (b"abc", 0, False), (None, 0, False)], "b binary, n long, c boolean")
    assert [None if r.x is None else bytes(r.x) for r in df.select(H.frame_body(F.col("b"), F.col("n"), F.col("c")).alias("x")).collect()] == [b"abc", b"abcd", b"abc", None]


def test_content_types_and_classes(spark):
    df = spark.createDataFrame([("Text/HTML; charset=UTF-8",), ("a/b; q=1",), ("image/png",), ("application/json",)], "t string")
    got = df.select(H.parse_content_type(F.col("t")).alias("c"), H.mime_class(F.lower(F.substring_index("t", ";", 1))).alias("k")).collect()
    assert [(r.c.mime, r.c.charset, r.k) for r in got] == [("text/html", "utf-8", "text"), ("a/b", "", "other"), ("image/png", "", "binary"), ("application/json", "", "text")]


def test_request_lines_and_unanswered_requests(spark):
    df = spark.createDataFrame([("PUT /",), ("PUTS /",), ("HTTP/1.0 200",)], "x string")
    assert [(r[0], r[1]) for r in df.select(H.is_request(F.col("x")), H.is_response(F.col("x"))).collect()] == [(True, False), (False, False), (False, True)]
    m = spark.createDataFrame([(1, 1, True, "q1"), (1, 2, True, "q2"), (1, 3, False, "a2"), (1, 4, False, "late")], "k int, msg_no int, is_request boolean, t string").withColumn("m", F.struct("t"))
    got = H.pair_exchanges(m, ["k"]).orderBy("msg_no").collect()
    assert [(r.request.t, r.response and r.response.t) for r in got] == [("q1", None), ("q2", "a2")]


def test_expected_100_and_cut_gzip_on_the_main_way(spark):
    zipped = gzip.compress(b"body " * 50)
    said = [
        (1, True, b"POST /a HTTP/1.1\r\nHost: h\r\nExpect: 100-continue\r\n\r\n"), (2, False, b"HTTP/1.1 100 Continue\r\n\r\n"), (3, False, b"sent\r\n\r\nbody"), (4, False, b"HTTP/1.1 200 OK\r\n\r\n" + zipped[:-6]),
        (5, True, b"GET /b HTTP/1.1\r\nHost: h\r\n\r\n"), (6, False, b"HTTP/1.1 100 Early\r\n\r\nx"), (7, True, b"GET /c HTTP/1.1\r\n\r\n"), (8, False, b"HTTP/1.1 200 OK\r\n\r\n" + zipped),
    ]
    m = spark.createDataFrame([("c", "f", 1, n, q, "1.1.1.1:9", "2.2.2.2:80", n, n, raw) for n, q, raw in said], "capture string, flow_key string, conn_no long, msg_no long, is_request boolean, client string, server string, first_ts_us long, first_packet_no long, raw binary")
    got = {r.uri: r for r in H.exchanges(m).collect()}
    assert got["/a"].res_num == "200 OK" and bytes(got["/a"].req).endswith(b"\r\n\r\nsent\r\n\r\nbody") and got["/a"].truncated and bytes(got["/a"].res_body) == b"body " * 50
    assert got["/c"].res_num == "200 OK" and bytes(got["/c"].res_body) == b"body " * 50 and not got["/c"].truncated
    assert kernels.inflated(zipped, 31, 10) == (b"body body ", False) and kernels.inflated(b"none", 31) == (None, False)


def test_headers_sorted_by_name_keep_the_last(spark):
    r = one(spark, H.request_columns(F.lit("GET / HTTP/1.1\r\nB: 1\r\na: 1\r\nb: 2\r\nA:3\r\nb : 4\r\nc:")))
    assert r.req_headers == {"a": "3", "b": "4", "c": ""}
