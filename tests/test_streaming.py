import random

from pyspark.sql import functions as F

from wireloom.functions import kernels
from wireloom.jobs.flow_queries import ran
from wireloom.jobs.stand_ins import event_packets
from wireloom.streaming import streams as T

from .conftest import SMALL


def test_stateful_rules_equal_windows(spark):
    """The keyed state's rules and the batch windows give the same connections."""
    rows = event_packets(spark, SMALL).orderBy("packet_no").collect()
    state, done = {}, []
    for r in rows:
        done += state.setdefault(r.flow_key, T.Connection()).take(r.flow_key, r.packet_no, r.ts_us, r.kind, r.size, r.asks)
    done += [(k, *c.now, False) for k, c in state.items() if c.now]
    assert sorted(done) == sorted(tuple(r) for r in T.batch_connections(event_packets(spark, SMALL)).collect())


def test_stream_of_capture_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pcap").write_bytes(kernels.write_pcap([(i, b"frame")] * (i + 1)))
    (tmp_path / "note.txt").write_bytes(b"no capture")
    got = ran(T.stream_frames(spark, str(tmp_path)))
    assert got.count() == 6


def test_released_bytes_of_shuffled_segments():
    """Segments cut at random, out of order, repeated and lost: each side gives what comes before its first gap, once and in order."""
    rnd = random.Random(4)
    for _ in range(200):
        sides, sent, start = T.Sides(), {}, {"a": rnd.choice([5, 2**32 - 20]), "b": rnd.choice([9, 2**32 - 3])}
        parts = []
        for side in "ab":
            data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 150)))
            cuts = sorted({0, len(data), *(rnd.randrange(len(data) + 1) for _ in range(6))})
            own = [(side, x, data[x:y]) for x, y in zip(cuts, cuts[1:])]
            lost = rnd.choice(own)[1] if rnd.random() < 0.4 else None
            own = [p for p in own if p[1] != lost]
            parts += own + [p for p in own if rnd.random() < 0.3]
            sent[side] = data if lost is None else data[:lost]
        rnd.shuffle(parts)
        got = {"a": b"", "b": b""}
        handshake = [("a", 1, start["a"] - 1, 0, b""), ("b", 2, (start["b"] - 1) % 2**32, start["a"], b"")]
        packets = handshake + [(s, 0, (start[s] + x) % 2**32, 1, d) for s, x, d in parts]
        for no, (src, kind, seq, ack, data) in enumerate(packets):
            for conn, side, at, _, piece in sides.take(no, src, kind, seq, ack, data):
                assert conn == 0 and at == len(got[side])
                got[side] += piece
        assert got == sent


def test_sides_close_and_reopen():
    sides = T.Sides()
    assert sides.take(0, "a", 0, 100, 500, b"GET") == [(0, "a", 0, 0, b"GET")]
    assert sides.take(1, "b", 0, 490, 103, b"old bytes ok") == [(0, "b", 0, 1, b"ok")]
    assert sides.take(2, "b", -1, 502, 103, b"!") == [(0, "b", 2, 2, b"!")] and sides.take(3, "b", 0, 503, 103, b"late") == []
    assert sides.take(4, "a", 0, 103, 503, b" on") == [(0, "a", 3, 4, b" on")]
    assert sides.take(5, "b", 1, 7, 0, b"") == [] and sides.take(6, "b", 0, 8, 1, b"new") == [(5, "b", 0, 6, b"new")]


def test_last_acknowledgement_opens_nothing():
    conn = T.Connection()
    assert conn.take("f", 1, 10, 1, 0, False) == [] and conn.take("f", 2, 20, -1, 5, False) == [("f", 1, 10, 20, 2, 5, True)]
    assert conn.take("f", 3, 30, 0, 0, False) == [] and conn.now is None and conn.take("f", 4, 40, -1, 0, True) == [] and conn.now is None
    assert conn.take("f", 5, 50, 0, 9, True) == [] and conn.take("f", 6, 60, 1, 0, False) == [("f", 5, 50, 50, 1, 9, False)]


def test_pieces_wait_in_state_over_batches_and_go_when_the_connection_is_over(spark, tmp_path):
    """A row a batch: bytes behind a gap come back from the state, and after both FINs only a request opens the flow again."""
    kinds = "flow_key string, packet_no long, ts timestamp, ts_us long, src string, kind int, seq long, ack long, payload binary"
    rows = [("a", 1, 99, 0, b""), ("b", 2, 499, 100, b""), ("a", 0, 103, 500, b"DEF"), ("a", 0, 106, 500, b"GHI"), ("a", 0, 100, 500, b"ABC"), ("b", 0, 500, 109, b"ok"), ("a", -1, 109, 502, b""), ("b", -1, 502, 110, b""), ("a", 0, 110, 503, b"late"), ("a", 0, 120, 503, b"GET /"), ("a", 0, 130, 503, b"gap")]
    folder = str(tmp_path / "in")
    for i, (src, kind, seq, ack, data) in enumerate(rows):
        spark.createDataFrame([("f", i, None, 1_000_000 + i, src, kind, seq, ack, data)], kinds).withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.mode("append").parquet(folder)
    stream = T.stream_segments(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(folder))
    got = [(r.first_packet_no, r.src, r["at"], r.emit_no, bytes(r.data)) for r in ran(stream).orderBy("emit_no", "at").collect()]
    assert got == [(0, "a", 0, 4, b"ABC"), (0, "a", 3, 4, b"DEF"), (0, "a", 6, 4, b"GHI"), (0, "b", 0, 5, b"ok"), (9, "a", 0, 9, b"GET /")]
