import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wireloom.operators import packets as P

SEGMENT = "s long, packet_no long, seq long, len long, start long"


def rebuilt(spark, streams):
    """streams: lists of (seq, bytes) in order of arrival; the released bytes of each."""
    rows = [(s, i, seq, len(data), None if start is None else start) for s, (start, parts) in enumerate(streams) for i, (seq, data) in enumerate(parts)]
    out = [b""] * len(streams)
    got = P.reassemble(spark.createDataFrame(rows, SEGMENT), ["s"]).where("kept > 0").orderBy("s", "at", "packet_no").collect()
    for r in got:
        data = streams[r.s][1][r.packet_no][1]
        out[r.s] += data[r.skip : r.skip + r.kept]
    return out


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10**6))
def test_shuffled_repeated_overlapping_and_lost_segments(spark, seed):
    rnd, streams, want = random.Random(seed), [], []
    for k in range(30):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 200)))
        start = rnd.choice([0, 1000, (1 << 32) - rnd.randrange(1, 50)])
        cuts, at = [], 0
        while at < len(data):
            n = rnd.randrange(1, 40)
            cuts.append((at, min(at + n, len(data))))
            at += n
        lost = rnd.choice(cuts) if len(cuts) > 1 and rnd.random() < 0.4 else None
        parts = [c for c in cuts if c != lost]
        parts += [c for c in parts if rnd.random() < 0.3]
        if lost is None:
            parts += [(max(a - rnd.randrange(5), 0), b) for a, b in parts if rnd.random() < 0.3]
        rnd.shuffle(parts)
        streams.append((start, [((start + a) % (1 << 32), data[a:b]) for a, b in parts]))
        want.append(data if lost is None else data[: lost[0]])
    assert rebuilt(spark, streams) == want


def test_conflicting_overlap_keeps_the_lower_sequence_number(spark):
    assert rebuilt(spark, [(0, [(2, b"XYZ"), (0, b"abcd")])]) == [b"abcdZ"]


def test_filters(spark):
    rows = spark.createDataFrame([("a", "b", 1, 80), ("b", "a", 80, 1), ("c", "d", 2, 443)], "src_ip string, dst_ip string, src_port int, dst_port int")
    assert P.filter_traffic(rows, ip="a").count() == 2 and P.filter_traffic(rows, port=443).count() == 1 and P.filter_traffic(rows).count() == 3


PACKET = "capture string, packet_no long, ts_us long, src_ip string, src_port int, dst_ip string, dst_port int, src_mac string, kind int, seq long, ack long, payload binary"


def talk(*packets):
    """Packets (from client, kind, seq, ack, payload) of one flow, in order."""
    up, down = ("1.1.1.1", 9, "2.2.2.2", 80), ("2.2.2.2", 80, "1.1.1.1", 9)
    return [("c", n, n, *(up if client else down), "m", kind, seq, ack, data) for n, (client, kind, seq, ack, data) in enumerate(packets)]


def messages(spark, rows):
    return [(r.conn_no, r.msg_no, r.is_request, r.client, bytes(r.raw)) for r in P.messages_of(spark.createDataFrame(rows, PACKET)).orderBy("conn_no", "msg_no").collect()]


def test_streams_start_where_the_handshake_or_the_acknowledgement_says(spark):
    ask, a = b"GET / HTTP/1.1\r\n\r\n", "1.1.1.1:9"
    whole = [(1, 1, True, a, ask), (1, 2, False, a, b"HTTP/1.1 200 OK")]
    assert messages(spark, talk((True, 1, 99, 0, b""), (False, 2, 499, 100, b""), (True, 0, 100, 500, ask), (False, 0, 500, 118, b"HTTP/1.1 200 OK"))) == whole
    # no handshake: the answer starts where the request acknowledges; what comes before is an old repeat
    assert messages(spark, talk((True, 0, 100, 500, ask), (False, 0, 490, 118, b"old bytes."), (False, 0, 500, 118, b"HTTP/1.1 200 OK"))) == whole
    # its first part is lost, so nothing of it is handed on
    assert messages(spark, talk((True, 0, 100, 500, ask), (False, 0, 501, 118, b"TTP/1.1 200 OK"))) == whole[:1]
    # numbers wrap within the answer and within the request
    assert messages(spark, talk((True, 0, 2**32 - 4, 2**32 - 2, ask[:4]), (True, 0, 0, 2**32 - 2, ask[4:]), (False, 0, 2**32 - 2, 14, b"HT"), (False, 0, 0, 14, b"TP/1.1 200 OK"))) == whole


def test_connections_end_with_the_first_fin_and_reopen_with_a_request(spark):
    ask, a, b = b"GET /1 HTTP/1.1\r\n\r\n", "1.1.1.1:9", "2.2.2.2:80"
    rows = talk((True, 0, 100, 500, ask), (False, 0, 500, 119, b"HTTP/1.1 200 OK"), (False, -1, 515, 119, b""), (False, 0, 515, 119, b"after its FIN"), (True, 0, 119, 516, b"no request"), (True, 0, 129, 516, ask), (True, 0, 148, 516, b"more"))
    assert messages(spark, rows) == [(1, 1, True, a, ask), (1, 2, False, a, b"HTTP/1.1 200 OK"), (2, 1, True, a, ask + b"more")]
    # after the client's FIN the server asks: it is the client of a connection of its own
    rows = talk((True, 0, 100, 500, ask), (True, -1, 119, 500, b""), (False, 0, 500, 120, b"HTTP/1.1 late"), (False, 0, 513, 120, ask))
    assert messages(spark, rows) == [(1, 1, True, a, ask), (2, 1, True, b, ask)]


def test_fields_of_a_frame_are_worked_out_once(spark):
    """Places of later fields hang on earlier ones; the plan must not hold the earlier ones again for each use."""
    frames = spark.createDataFrame([("c", 0, 1, 0, b"")], "capture string, packet_no long, link_type int, ts_us long, frame binary")
    plan = P.decode_packets(frames)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("conv(") < 60
