"""Link frames to packets, packets to streams, streams to messages: window functions over (capture, flow)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the link formats.
ETHERNET, LINUX_COOKED = 1, 113
TYPE_IPV4, TYPE_VLAN, TYPE_PPPOE, PPP_IPV4, PROTOCOL_TCP = 0x0800, 0x8100, 0x8864, 0x0021, 6
FIN, SYN, ACK = 1, 2, 16
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "TRACE", "OPTIONS", "PATCH")
UINT32 = 1 << 32


def uint(data: Column, at: Column | int, size: int) -> Column:
    """The big-endian unsigned integer of `size` bytes at offset `at`; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    part = F.substring(data, at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("long"))


def ipv4(data: Column, at: Column) -> Column:
    return F.concat_ws(".", *[uint(data, at + i, 1).cast("string") for i in range(4)])


def mac(data: Column, at: int) -> Column:
    h = F.lower(F.hex(F.substring(data, at + 1, 6)))
    return F.concat_ws(":", *[F.substring(h, 2 * i + 1, 2) for i in range(6)])


def packet_kind(flags: Column) -> Column:
    """1 for SYN, 2 for SYN with ACK, -1 for FIN, else 0; a reset is 0."""
    has = lambda bit: flags.bitwiseAND(bit) != 0
    return F.when(has(SYN) & has(ACK), 2).when(has(SYN), 1).when(has(FIN), -1).otherwise(0)


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with these columns, each worked out once a row: Spark copies a plain column into every expression that uses it, and so on through the steps."""
    return rows.select("*", F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("__once")).select("*", "__once.*").drop("__once")


def decode_packets(frames: DataFrame) -> DataFrame:
    """TCP over IPv4 packets of frames (capture, packet_no, link_type, ts_us, frame); anything else or cut short is dropped.

    Ethernet, with a VLAN tag or PPPoE, and Linux cooked captures. The payload ends where the IP length says, which
    drops link padding; 1 to 19 zero bytes alone count as no payload.
    """
    f, cooked = F.col("frame"), F.col("link_type") == LINUX_COOKED
    kind0 = F.when(cooked, uint(f, 14, 2)).otherwise(uint(f, 12, 2))
    rows = frames.where(F.col("link_type").isin(ETHERNET, LINUX_COOKED)).select("capture", "packet_no", "link_type", "ts_us", "frame")
    rows = once(rows, kind0=kind0)
    base = F.when(cooked, 16).when(F.col("kind0") == TYPE_VLAN, 18).otherwise(14)
    kind1 = F.when(~cooked & (F.col("kind0") == TYPE_VLAN), uint(f, 16, 2)).otherwise(F.col("kind0"))
    rows = once(rows, base=base, kind1=kind1)
    pppoe = F.col("kind1") == TYPE_PPPOE
    is_ip = (F.col("kind1") == TYPE_IPV4) | (pppoe & (uint(f, F.col("base") + 6, 2) == PPP_IPV4))
    rows = once(rows.where(is_ip), ip=F.when(pppoe, F.col("base") + 8).otherwise(F.col("base")))
    ip = F.col("ip")
    rows = once(rows, first=uint(f, ip, 1), total=uint(f, ip + 2, 2), protocol=uint(f, ip + 9, 1))
    rows = rows.where((F.shiftright("first", 4) == 4) & (F.col("protocol") == PROTOCOL_TCP))
    rows = once(rows, tcp=ip + 4 * F.col("first").bitwiseAND(15))
    tcp = F.col("tcp")
    rows = once(rows, head=4 * F.shiftright(uint(f, tcp + 12, 1), 4), flags=uint(f, tcp + 13, 1), end=ip + F.col("total"))
    rows = rows.where((F.col("head") >= 20) & (tcp + F.col("head") <= F.col("end")) & (tcp + 20 <= F.length("frame")))
    start = tcp + F.col("head")
    rows = once(rows, payload=F.substring(f, start.cast("int") + 1, (F.col("end") - start).cast("int")))
    payload = F.col("payload")
    blank = (F.length(payload) < 20) & (F.rtrim(F.translate(F.hex(payload), "0", " ")) == "")
    return rows.select(
        "capture", "packet_no", "ts_us", ipv4(f, ip + 12).alias("src_ip"), uint(f, tcp, 2).cast("int").alias("src_port"), ipv4(f, ip + 16).alias("dst_ip"), uint(f, tcp + 2, 2).cast("int").alias("dst_port"),
        mac(f, 6).alias("src_mac"), packet_kind(F.col("flags")).alias("kind"), uint(f, tcp + 4, 4).alias("seq"), uint(f, tcp + 8, 4).alias("ack"),
        F.when(blank, F.lit(b"")).otherwise(payload).alias("payload"),
    )


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> Column:
    """The same text for both directions: the smaller `ip:port` first."""
    a, b = F.concat_ws(":", src_ip, src_port.cast("string")), F.concat_ws(":", dst_ip, dst_port.cast("string"))
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def filter_traffic(packets: DataFrame, ip: str | None = None, port: int | None = None) -> DataFrame:
    """Packets from or to the ip, and from or to the port; what is unset keeps all."""
    if ip is not None:
        packets = packets.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))
    if port is not None:
        packets = packets.where((F.col("src_port") == port) | (F.col("dst_port") == port))
    return packets


def filter_requests(requests: DataFrame, domain: str | None = None, uri_pattern: str | None = None) -> DataFrame:
    """Requests to the host, with the pattern somewhere in the URI."""
    if domain is not None:
        requests = requests.where(F.col("host") == domain)
    if uri_pattern is not None:
        requests = requests.where(F.col("uri").contains(uri_pattern))
    return requests


def split_connections(packets: DataFrame) -> DataFrame:
    """packets with flow_key and conn_no: a SYN on a known flow starts its next connection."""
    keyed = packets.withColumn("flow_key", flow_key(F.col("src_ip"), F.col("src_port"), F.col("dst_ip"), F.col("dst_port")))
    w = Window.partitionBy("capture", "flow_key").orderBy("packet_no")
    return keyed.withColumn("conn_no", F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).over(w).cast("long"))


def stream_starts(packets: DataFrame, keys: list[str]) -> DataFrame:
    """packets (keys, src, packet_no, kind, seq, ack) with start, the first sequence number of their side of the connection.

    The side of the connection's first packet starts with that packet, one later if it is a handshake's. The other side
    starts one after its own SYN+ACK; without one, where the first side's first acknowledgement says; without that,
    with its own first packet.
    """
    whole, side = Window.partitionBy(*keys), Window.partitionBy(*keys, "src")
    shaken = F.col("seq") + F.when(F.col("kind") > 0, 1).otherwise(0)
    rows = packets.withColumns({"first_src": F.min_by("src", "packet_no").over(whole), "first_seq": F.min_by(shaken, "packet_no").over(side), "answer": F.min_by(F.when(F.col("kind") == 2, shaken), F.when(F.col("kind") == 2, F.col("packet_no"))).over(side)})
    told = F.when((F.col("src") == F.col("first_src")) & (F.col("ack") != 0), F.col("packet_no"))
    rows = rows.withColumn("told", F.min_by(F.when(told.isNotNull(), F.col("ack")), told).over(whole))
    start = F.when(F.col("src") == F.col("first_src"), F.col("first_seq")).otherwise(F.coalesce("answer", "told", "first_seq"))
    return rows.withColumn("start", start % UINT32).drop("first_src", "first_seq", "answer", "told")


def reassemble(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of each stream (keys) in order, without retransmits: skip (bytes to cut at the front), kept (bytes left), emit_no, released.

    segments: keys, packet_no, seq, len and start (the stream's first sequence number, or null: its first packet's).
    Numbers wrap at 2^32. A segment's place is the sum of the signed differences (modulo 2^32) from each packet to the next
    by arrival, from the start on, so a stream may be of any length as long as neighbours by arrival are within 2 GiB of each
    other. What lies before the start is dropped as a repeat. A segment is kept as far as it goes beyond all before it; after a gap nothing is released. emit_no: the
    packet with which it could first be handed on. Where copies of a byte differ, that of the lower sequence number wins.
    """
    stream = Window.partitionBy(*keys)
    first = F.coalesce(F.max("start").over(stream), F.min_by("seq", "packet_no").over(stream))
    arrival = stream.orderBy("packet_no", "seq", "len")
    step = F.col("seq") - F.coalesce(F.lag("seq").over(arrival), first)
    rows = segments.withColumn("step", F.pmod(step + (UINT32 >> 1), F.lit(UINT32)) - (UINT32 >> 1))
    rows = rows.withColumn("at", F.sum("step").over(arrival.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("step")
    order = stream.orderBy("at", "packet_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("expected", F.greatest(F.lit(0), F.coalesce(F.max(F.col("at") + F.col("len")).over(before), F.lit(0))))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.max((F.col("at") > F.col("expected")).cast("int")).over(upto)
    rows = rows.withColumns({"gap": gap, "emit_no": F.max("packet_no").over(upto)})
    kept = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.col("expected"))
    rows = rows.withColumn("kept", F.when(F.col("gap") == 1, 0).otherwise(F.least(kept, F.col("len"))))
    return rows.withColumns({"skip": F.col("len") - F.col("kept"), "released": F.col("gap") == 0}).drop("expected", "gap")


def close_connections(released: DataFrame, keys: list[str]) -> DataFrame:
    """Released rows (keys, emit_no, at, kind) up to the first FIN of either direction, by the order of release."""
    order = Window.partitionBy(*keys).orderBy("emit_no", "at").rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.max((F.col("kind") == -1).cast("int")).over(order), F.lit(0))
    return released.withColumn("over", over).where("over = 0").drop("over")


def reopen_connections(released: DataFrame, flow: list[str]) -> DataFrame:
    """Released rows (flow, conn_no, src, packet_no, emit_no, at, kind, asks) as HTTP connections: conn_no anew, from 1 in each flow, and client.

    A side sends nothing after its own FIN. The first FIN of either side ends an HTTP connection; a later packet that
    starts with a request (asks) opens the next one, and its sender is the client. What comes while none is open is dropped.
    """
    side = Window.partitionBy(*flow, "conn_no", "src").orderBy("packet_no").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*flow, "conn_no").orderBy("emit_no", "at", "packet_no")
    fin = (F.col("kind") == -1).cast("int")
    rows = released.withColumn("sent_fin", F.coalesce(F.max(fin).over(side), F.lit(0))).where("sent_fin = 0").drop("sent_fin")
    rows = rows.withColumn("part", F.coalesce(F.sum(fin).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = Window.partitionBy(*flow, "conn_no", "part").orderBy("emit_no", "at", "packet_no")
    asked = F.sum(F.col("asks").cast("int")).over(part)
    rows = rows.withColumns({"asked": asked, "client": F.first(F.when(F.col("asks"), F.col("src")), ignorenulls=True).over(part)}).where("asked > 0")
    opens = (F.col("asks") & (F.col("asked") == 1)).cast("int")
    return rows.withColumn("conn_no", F.sum(opens).over(Window.partitionBy(*flow).orderBy("conn_no", "part", "emit_no", "at", "packet_no"))).drop("part", "asked")


def segment_messages(pieces: DataFrame, keys: list[str], order: list[str], direction: str = "direction") -> DataFrame:
    """pieces with msg_no (from 1): a change of direction starts the next message of the connection (keys)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (F.lag(direction).over(w).isNull() | (F.lag(direction).over(w) != F.col(direction))).cast("int")
    return pieces.withColumn("change", change).withColumn("msg_no", F.sum("change").over(w)).drop("change")


def messages_of(packets: DataFrame) -> DataFrame:
    """Whole way from packets to messages: capture, flow_key, conn_no, msg_no, client, server, is_request, first_ts_us, first_packet_no, raw.

    Windows sort narrow columns only, all within one dealing by flow; payloads are joined back by (capture, packet_no) and
    concatenated per message.
    """
    flow = ["capture", "flow_key"]
    conn = [*flow, "conn_no"]
    side = lambda end: F.concat_ws(":", f"{end}_ip", F.col(f"{end}_port").cast("string"))
    asks = (F.col("kind") == 0) & F.substring_index(F.decode(F.substring("payload", 1, 16), "ISO-8859-1"), " ", 1).isin(*METHODS)
    size = F.length("payload").cast("long")
    slim = packets.select("capture", "packet_no", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "kind", "seq", "ack", size.alias("len"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = split_connections(slim).select(*conn, side("src").alias("src"), side("dst").alias("dst"), "packet_no", "ts_us", "kind", "seq", "ack", "len", "asks")
    rows = stream_starts(rows, conn).withColumn("seq", F.col("seq") + F.when(F.col("kind") > 0, 1).otherwise(0))
    rows = rows.where("len > 0 or kind = -1")
    placed = reassemble(rows, [*conn, "src"])
    placed = placed.where((F.col("released") & (F.col("kept") > 0)) | ((F.col("kind") == -1) & ((F.col("len") == 0) | F.col("released"))))
    placed = reopen_connections(placed.withColumn("asks", F.col("asks") & (F.col("skip") == 0)), flow).where("kept > 0")
    cut = segment_messages(placed.select(*conn, "src", "dst", "client", "packet_no", "ts_us", "skip", "kept", "emit_no", "at"), conn, ["emit_no", "at"], "src")
    joined = cut.join(packets.select("capture", "packet_no", "payload"), ["capture", "packet_no"]).withColumn("bytes", F.expr("substring(payload, cast(skip as int) + 1, cast(kept as int))"))
    raw = F.expr("listagg(bytes, X'') WITHIN GROUP (ORDER BY emit_no, at)")
    ends = F.min(F.struct("src", "dst", "client"))
    made = joined.repartition(*conn).groupBy(*conn, "msg_no").agg(ends.alias("e"), F.min("ts_us").alias("first_ts_us"), F.min("packet_no").alias("first_packet_no"), raw.alias("raw"))
    is_request = F.substring_index(F.decode(F.substring("raw", 1, 16), "ISO-8859-1"), " ", 1).isin(*METHODS)
    server = F.when(F.col("e.src") == F.col("e.client"), F.col("e.dst")).otherwise(F.col("e.src"))
    return made.select(*conn, "msg_no", is_request.alias("is_request"), F.col("e.client").alias("client"), server.alias("server"), "first_ts_us", "first_packet_no", "raw")
