"""Captures and web-proxy archives as tables."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
FRAMES = "capture string, packet_no long, link_type int, ts_us long, frame binary"
MESSAGES = "capture string, flow_key string, conn_no long, msg_no long, is_request boolean, client string, server string, first_ts_us long, first_packet_no long, raw binary"
#: Frames of one Arrow batch, and bytes from which on one is closed.
BATCH, BATCH_BYTES = 2048, 8 << 20


def frame_batches(path: str, packets: Iterable[tuple[int, int, bytes]], first_no: int = 0) -> Iterator[pa.RecordBatch]:
    """FRAMES batches of packets of one capture, of bounded numbers of rows and bytes."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["capture", "packet_no", "link_type", "ts_us", "frame"])

    for no, (link, ts, frame) in enumerate(packets, first_no):
        rows.append((path, no, link, ts, frame))
        size += len(frame)
        if len(rows) == BATCH or size > BATCH_BYTES:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def frames_of(files: DataFrame) -> DataFrame:
    """Frames of capture files (path, content): pcap of either byte order and pcapng, told by their magic; other files give none.

    A packet cut short ends its file. One task reads a file; deal the frames out by flow afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield from frame_batches(path, kernels.read_capture(io.BytesIO(content.as_py() or b"")))

    return files.select("path", "content").mapInArrow(run, FRAMES)


def read_frames(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Frames of the capture files at path. Spark hands a file over whole, up to 2 GB; with `large`, files of any size are read in splits by split_captures.frames_at."""
    files = spark.read.format("binaryFile").load(path)
    if large:
        from .split_captures import frames_at

        return frames_at(files.select("path", "length"))
    return frames_of(files)


def direct_request(request: bytes) -> tuple[bytes, int]:
    """(request, port) as the server itself would get it: an absolute target loses its scheme and host; the port is the one that it names, else 80."""
    line, end, rest = request.partition(b"\n")
    method, _, after = line.partition(b" ")
    target, blank, version = after.partition(b" ")
    try:
        url = urlsplit(target.decode("ISO-8859-1"))
        port = url.port or 80
    except ValueError:
        return request, 80
    if url.scheme not in ("http", "https") or not url.netloc or not url.path:
        return request, 80
    path = target[len(url.scheme) + 3 + len(url.netloc) :]
    return method + b" " + path + blank + version + end + rest, port


def saz_messages(data: bytes, strip_proxy: bool = True) -> list[tuple[int, bool, str, str, bytes]]:
    """(session, is request, client, server, raw) of the sessions in a proxy archive, requests before responses."""
    out, z = [], zipfile.ZipFile(io.BytesIO(data))
    for name in sorted(z.namelist()):
        m = re.fullmatch(r"raw/(\d+)_m\.xml", name)
        if not m:
            continue
        flags = {x.get("N"): x.get("V") or "" for x in ElementTree.fromstring(z.read(name)).iter("SessionFlag")}
        ip = lambda key: (re.findall(r"\d{1,3}(?:\.\d{1,3}){3}", flags.get(key, "")) or [""])[-1]
        request, port = z.read(f"raw/{m.group(1)}_c.txt"), 80
        if strip_proxy:
            request, port = direct_request(request)
        client, server = f"{ip('x-clientip')}:{flags.get('x-clientport', '')}", f"{ip('x-hostip')}:{port}"
        out += [(int(m.group(1)), True, client, server, request), (int(m.group(1)), False, client, server, z.read(f"raw/{m.group(1)}_s.txt"))]
    return out


def saz_of(files: DataFrame, strip_proxy: bool = True) -> DataFrame:
    """Messages of proxy archives (path, content): each session is a connection; broken archives give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows = saz_messages(content, strip_proxy)
                except (zipfile.BadZipFile, zlib.error, KeyError, ElementTree.ParseError, RuntimeError, ValueError, OSError, EOFError, struct.error):
                    continue  # broken or encrypted
                cols = [[path] * len(rows), ["-".join(sorted((c, s))) for _, _, c, s, _ in rows], [n for n, *_ in rows], [1 if q else 2 for _, q, *_ in rows], [q for _, q, *_ in rows], [c for _, _, c, _, _ in rows], [s for _, _, _, s, _ in rows], [0] * len(rows), [2 * n + (not q) for n, q, *_ in rows], [r for *_, r in rows]]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in MESSAGES.split(", ")])

    return files.select("path", "content").mapInArrow(run, MESSAGES)


def read_saz(spark: SparkSession, path: str, strip_proxy: bool = True) -> DataFrame:
    return saz_of(spark.read.format("binaryFile").load(path), strip_proxy)


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Type signatures of a four-column CSV file, in its order: row_no, description, prefix_hex, ext, required."""
    rows = spark.read.schema("description string, prefix string, ext string, required string").csv(path).coalesce(1)
    return rows.select(
        (F.row_number().over(_one()) - 1).alias("row_no"), "description", F.replace("prefix", F.lit(" "), F.lit("")).alias("prefix_hex"), "ext",
        F.filter(F.split(F.coalesce("required", F.lit("")), ";"), lambda x: x != "").alias("required"),
    )


def _one():
    from pyspark.sql import Window

    return Window.orderBy(F.monotonically_increasing_id())


def packer_signatures_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """Packer signatures of blocks `[name] signature = .. ep_only = .. section_start_only = ..`: name, pattern_hex (?? for any byte, none at the end), ep_only, section_start_only."""
    block = r"(?s)(\[[^\]]*\]\s+signature\s*=[^\[]*)"
    rows = texts.select(F.explode(F.regexp_extract_all(text, F.lit(block), F.lit(1))).alias("b"))
    get = lambda p: F.regexp_extract("b", p, 1)
    flag = lambda name: F.lower(get(rf"(?i){name}\s*=\s*(\w+)")) == "true"
    hexes = F.regexp_replace(F.upper(F.regexp_replace(get(r"(?im)signature\s*=\s*([0-9a-f? \t]+)"), r"\s", "")), r"(\?\?)+$", "")
    return rows.select(get(r"\[([^\]]*)\]").alias("name"), hexes.alias("pattern_hex"), flag("ep_only").alias("ep_only"), flag("section_start_only").alias("section_start_only"))


def read_packer_signatures(spark: SparkSession, path: str) -> DataFrame:
    return packer_signatures_of(spark.read.text(path, wholetext=True))
