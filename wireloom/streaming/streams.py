"""Captures that keep arriving: frames, connections with state per flow, and first conversations."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.packets import METHODS
from ..sources.captures import BINARY_FILE, frames_of

REQUESTS = tuple(m.encode() for m in METHODS)
#: The setting that queries with keyed state need when they start.
KEYED_STATE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CONNECTION = "flow_key string, first_packet_no long, first_ts_us long, last_ts_us long, packets long, bytes long, closed boolean"
OPEN = "first_packet_no long, first_ts_us long, last_ts_us long, packets long, bytes long"
SEGMENT = "flow_key string, first_packet_no long, src string, at long, emit_no long, data binary"


def stream_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames of capture files as they arrive in a folder."""
    return arriving_frames(spark.readStream.format("binaryFile").schema(BINARY_FILE).load(folder))


def arriving_frames(files: DataFrame) -> DataFrame:
    """Frames of a stream of capture files (path, content), from wherever they come."""
    return frames_of(files)


def opens(kind: int, asks: bool, is_open: bool) -> bool:
    """A SYN (kind 1) opens the next connection of a flow, and so does data that starts with a request while none is open."""
    return kind == 1 or (kind == 0 and asks and not is_open)


class Connection:
    """The open connection of one flow, None if there is none: first_packet_no, first_ts_us, last_ts_us, packets, bytes.

    A FIN (kind -1) ends it; what else comes while none is open is dropped.
    """

    def __init__(self, now: tuple | None = None) -> None:
        self.now = now

    def take(self, key: str, no: int, ts: int, kind: int, size: int, asks: bool) -> list[tuple]:
        """Connections that this packet ends."""
        done = []
        if opens(kind, asks, self.now is not None):
            if self.now is not None:
                done.append((key, *self.now, False))
            self.now = no, ts, ts, 0, 0
        if self.now is None:
            return done
        first, start, _, packets, total = self.now
        self.now = first, start, ts, packets + 1, total + size
        if kind == -1:
            done.append((key, *self.now, True))
            self.now = None
        return done


def names_of(ddl: str) -> list[str]:
    return [x.split(" ")[0] for x in ddl.split(", ")]


class Idle:
    """The one timer of a flow: event time of its last packet and idle_us more."""

    def __init__(self, handle: StatefulProcessorHandle, idle_us: int) -> None:
        self.handle, self.idle_us = handle, idle_us

    def stop(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def start(self, last_us: int, now: TimerValues, known: bool) -> None:
        """known: whether the flow may have a timer already; a flow that is new spares the look-up."""
        if known:
            self.stop()
        self.handle.registerTimer(max((last_us + self.idle_us) // 1000, now.getCurrentWatermarkInMs() + 1))


class Connections(StatefulProcessor):
    """State of a flow: its open connection; none, and no timer, once it is closed."""

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.idle = Idle(handle, self.idle_us)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.open.get()
        conn, done = Connection(tuple(before) if before is not None else None), []
        for no, ts, kind, size, asks in sorted(x for f in rows for x in zip(f["packet_no"], f["ts_us"], f["kind"], f["size"], f["asks"])):
            done += conn.take(key[0], int(no), int(ts), int(kind), int(size), bool(asks))
        if conn.now is not None:
            self.open.update(conn.now)
            self.idle.start(conn.now[2], timerValues, before is not None)
        elif before is not None:
            self.open.clear()
            self.idle.stop()
        yield pd.DataFrame(done, columns=names_of(CONNECTION))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.open.get()
        self.open.clear()
        yield pd.DataFrame([] if now is None else [(key[0], *now, False)], columns=names_of(CONNECTION))

    def close(self) -> None:
        pass


def stream_connections(packets: DataFrame, idle_us: int = 3_600_000_000) -> DataFrame:
    """Connections of a packet stream (flow_key, packet_no, ts timestamp, ts_us, kind, size, asks), each when it ends or has been idle.

    asks: whether the packet's data starts with a request. State is a few numbers per open flow. Event time decides: the
    watermark's passing of last packet plus idle_us flushes a flow, so nothing waits for an end of input that never
    comes; what is open when a bounded run stops is flushed by the next. Start the query with KEYED_STATE set.
    """
    return packets.withWatermark("ts", "10 minutes").groupBy("flow_key").transformWithStateInPandas(Connections(idle_us), T.StructType.fromDDL(CONNECTION), "Append", "EventTime")


HALF = 1 << 31


def no_piece(src: str, at: int, no: int) -> bytes:
    raise KeyError((src, at, no))


class Sides:
    """The open connection of one flow: per side the next byte to hand on, what waits behind a gap, and whether it has sent its FIN.

    The rules are those of packets.stream_starts and packets.reassemble, as far as packets that have come tell. A
    connection is named by the packet that opens it (`conn`, None while none is open); it is over when both sides have
    sent their FIN. Waiting pieces are (place, packet, bytes); None for bytes that `fetch` gives when they are due.
    """

    def __init__(self, fetch: Callable[[str, int, int], bytes] = no_piece) -> None:
        self.fetch = fetch
        self.begin(None, None)

    def begin(self, conn: int | None, first: str | None) -> None:
        self.conn, self.first, self.told = conn, first, 0
        self.seq: dict[str, int] = {}
        self.at: dict[str, int] = {}
        self.next: dict[str, int] = {}
        self.held: dict[str, list[tuple[int, int, bytes | None]]] = {}
        self.closed: set[str] = set()

    def take(self, no: int, src: str, kind: int, seq: int, ack: int, data: bytes) -> list[tuple[int, str, int, int, bytes]]:
        """(connection, src, offset, packet_no, bytes) that this packet lets go, in order."""
        if opens(kind, data[:16].split(b" ")[0] in REQUESTS, self.conn is not None):
            self.begin(no, src)
        if self.conn is None:
            return []
        if src == self.first and not self.told:
            self.told = ack
        seq += kind > 0
        if src not in self.seq:
            self.at[src], self.seq[src] = 0, self.told if src != self.first and kind != 2 and self.told else seq
            self.next[src], self.held[src] = 0, []
        if src in self.closed:
            return []
        if kind == -1:
            self.closed.add(src)
        waiting, out = self.held[src], []
        if data or kind == -1:  # places add up from packet to packet, so they go beyond 2^32
            self.at[src] += (seq - self.seq[src] + HALF) % (2 * HALF) - HALF
            self.seq[src] = seq
        if data:
            heapq.heappush(waiting, (self.at[src], no, data))
        while waiting and waiting[0][0] <= self.next[src]:
            at, came, piece = heapq.heappop(waiting)
            piece = (self.fetch(src, at, came) if piece is None else piece)[self.next[src] - at :]
            if piece:
                out.append((self.conn, src, self.next[src], no, piece))
                self.next[src] += len(piece)
        if len(self.closed) == 2:
            self.begin(None, None)
        return out


class Segments(StatefulProcessor):
    """State of a flow: the open connection, a row per side, and a row per piece that waits; a piece's bytes are read once, when they are due.

    Nothing of a connection that is over is kept.
    """

    def __init__(self, idle_us: int) -> None:
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.idle = Idle(handle, self.idle_us)
        self.flow = handle.getValueState("flow", "conn long, first string, told long, last_us long")
        self.sides = handle.getMapState("sides", "src string", "seq long, at long, next long, closed boolean, waiting long")
        self.pieces = handle.getMapState("pieces", "src string, at long, no long", "data binary")

    def clear(self) -> None:
        for state in (self.flow, self.sides, self.pieces):
            state.clear()

    def fetch(self, src: str, at: int, no: int) -> bytes:
        data = bytes(self.pieces.getValue((src, at, no))[0])
        self.pieces.removeKey((src, at, no))
        return data

    def load(self) -> tuple[Sides, int, bool]:
        sides, flow = Sides(self.fetch), self.flow.get()
        if flow is None:
            return sides, 0, False
        sides.begin(flow[0], flow[1])
        sides.told, waits = flow[2], False
        for (src,), (seq, at, next_at, closed, waiting) in self.sides.iterator():
            sides.seq[src], sides.at[src], sides.next[src], sides.held[src] = seq, at, next_at, []
            sides.closed |= {src} if closed else set()
            waits |= waiting > 0
        for src, at, no in self.pieces.keys() if waits else ():
            heapq.heappush(sides.held[src], (at, no, None))
        return sides, flow[3], True

    def save(self, sides: Sides, before: int | None, last: int) -> None:
        if sides.conn != before and before is not None:
            self.clear()
        if sides.conn is None:
            return
        self.flow.update((sides.conn, sides.first, sides.told, last))
        for src, waiting in sides.held.items():
            self.sides.updateValue((src,), (sides.seq[src], sides.at[src], sides.next[src], src in sides.closed, len(waiting)))
            for at, no, data in waiting:
                if data is not None:
                    self.pieces.updateValue((src, at, no), (data,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        sides, last, known = self.load()
        before = sides.conn
        parts = sorted((x for f in rows for x in zip(f["packet_no"], f["ts_us"], f["src"], f["kind"], f["seq"], f["ack"], f["payload"])), key=lambda x: x[0])
        for at in range(0, max(1, len(parts)), 10_000):
            out = []
            for no, ts, src, kind, seq, ack, data in parts[at : at + 10_000]:
                last = max(last, int(ts))
                out += [(key[0], *x) for x in sides.take(int(no), src, int(kind), int(seq), int(ack), data or b"")]
            yield pd.DataFrame(out, columns=names_of(SEGMENT))
        self.save(sides, before, last)
        if sides.conn is not None:
            self.idle.start(last, timerValues, known)
        elif known:
            self.idle.stop()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        yield pd.DataFrame([], columns=names_of(SEGMENT))

    def close(self) -> None:
        pass


def stream_segments(packets: DataFrame, idle_us: int = 3_600_000_000) -> DataFrame:
    """The bytes of a packet stream (flow_key, packet_no, ts timestamp, ts_us, src, kind, seq, ack, payload), each side's in order and once, as soon as no gap is before them.

    A connection (first_packet_no) is over, and its state gone, when both sides have sent their FIN; a flow that has been
    idle for idle_us of event time is dropped, with what still waits. Packets of a batch are taken by packet_no. Start
    the query with KEYED_STATE set.
    """
    return packets.withWatermark("ts", "10 minutes").groupBy("flow_key").transformWithStateInPandas(Segments(idle_us), T.StructType.fromDDL(SEGMENT), "Append", "EventTime")


def batch_connections(packets: DataFrame) -> DataFrame:
    """The same connections from a bounded table, by windows, those still open among them."""
    flow, part = Window.partitionBy("flow_key").orderBy("packet_no"), Window.partitionBy("flow_key", "part").orderBy("packet_no")
    asks, syn = (F.col("kind") == 0) & F.col("asks"), F.col("kind") == 1
    ended = F.sum((F.col("kind") == -1).cast("int")).over(flow.rowsBetween(Window.unboundedPreceding, -1))
    rows = packets.withColumn("part", F.coalesce(ended, F.lit(0)))
    rows = rows.withColumn("asked", F.sum((syn | asks).cast("int")).over(part)).where("asked > 0")
    rows = rows.withColumn("n", F.sum((syn | (asks & (F.col("asked") == 1) & (F.coalesce(F.lag("asked").over(part), F.lit(0)) == 0))).cast("int")).over(flow))
    conns = rows.groupBy("flow_key", "n").agg(
        F.min("packet_no").alias("first_packet_no"), F.min_by("ts_us", "packet_no").alias("first_ts_us"), F.max_by("ts_us", "packet_no").alias("last_ts_us"), F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"), (F.max_by("kind", "packet_no") == -1).alias("closed")
    )
    return conns.select(*names_of(CONNECTION))


def stream_dedupe(convs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first conversation of each (host, uri), case ignored, as they arrive; ts (timestamp) bounds what is remembered."""
    rows = convs.withColumns({"__h": F.lower("host"), "__u": F.lower("uri")}).withWatermark("ts", delay)
    return rows.dropDuplicatesWithinWatermark(["__h", "__u"]).drop("__h", "__u")
