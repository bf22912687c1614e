"""Writers of objects, captures and reports."""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = "path string, length long"


@contextmanager
def new_file(path: str) -> Iterator[BinaryIO]:
    """A file at a path of any store that Arrow writes, which gets its name when it is whole: a task that fails leaves none, one that runs again replaces it."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path) if path.startswith("file:") else path)
    folder, name = posixpath.split(place)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(part) as stream:
            yield stream
        store.move(part, f"{folder}/{name}")
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise


def files_batch(paths: list[str], sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])


def file_name(name: str | None, id: int) -> str:
    """`<id>-<name>`; of a name that comes from outside only what one part of a path may hold, its end if it is long."""
    return f"{id}-" + re.sub(r"[\0-\x1f/\\\\]", "_", name or "").encode("utf-8", "replace")[-200:].decode("utf-8", "ignore")


def object_files(objs: DataFrame, folder: str, dump_exe: bool = True) -> DataFrame:
    """Writes each object (capture, id, name, value) as the file `<folder>/<capture>/<id>-<name>` and gives (path, length) of those written; executors write, as the rows are read.

    A capture is named by its own last part of a path, with a checksum of the whole where that has others. Names cannot leave
    their folder. Objects without bytes give empty files. Every file is whole or not there.
    """
    rows = objs if dump_exe else objs.where(~F.lower(F.coalesce("name", F.lit(""))).endswith(".exe"))
    whole = F.coalesce("capture", F.lit(""))
    last = F.substring_index(whole, "/", -1)
    place = F.when(last == whole, whole).otherwise(F.concat(last, F.lit("-"), F.crc32(F.encode(whole, "UTF-8")).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, sizes = [], []
            for place, id, name, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                data = value.as_py() or b""
                paths.append(f"{folder.rstrip('/')}/{quote(place, safe=' ') if place.strip('.') else '_'}/{file_name(name, id)}")
                with new_file(paths[-1]) as stream:
                    stream.write(data)
                sizes.append(len(data))
            yield files_batch(paths, sizes)

    return rows.select(place.alias("place"), "id", "name", "value").mapInArrow(run, FILES)


def write_captures(frames: DataFrame, folder: str, *order: str) -> DataFrame:
    """Writes frames (capture, link_type, ts_us, frame) as pcap files `<folder>/<capture>.pcap`, packets by `order`, and gives (path, length) of each.

    A capture goes through one task, packet by packet; nothing of it is held. Its link type is that of its first packet.
    """
    rows = frames.repartition("capture").sortWithinPartitions("capture", *order).select("capture", "link_type", "ts_us", "frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)))
        now = next(packets, None)
        while now is not None:
            capture, link, size = now[0], now[1], 24
            path = f"{folder.rstrip('/')}/{quote(capture, safe='')}.pcap"
            with new_file(path) as stream:
                stream.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, link))
                while now is not None and now[0] == capture:
                    ts, frame = now[2], now[3].as_py() or b""
                    stream.write(struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(frame), len(frame)) + frame)
                    size += 16 + len(frame)
                    now = next(packets, None)
            yield files_batch([path], [size])

    return rows.mapInArrow(run, FILES)


def dumped_objects(objs: DataFrame, dump_exe: bool = True) -> DataFrame:
    """(capture, file_name, value) of the objects to dump; without dump_exe, names that end in .exe stay out."""
    rows = objs if dump_exe else objs.where(~F.lower("name").endswith(".exe"))
    return rows.select("capture", F.concat(F.col("id").cast("string"), F.lit("-"), "name").alias("file_name"), "value")


def write_objects(objs: DataFrame, path: str, dump_exe: bool = True) -> None:
    """Writes the dumped objects as a table by capture: executors write, and any store that Spark reaches will do."""
    dumped_objects(objs, dump_exe).write.partitionBy("capture").parquet(path)


def report_lines(report: DataFrame) -> DataFrame:
    """(capture, value): one JSON document per capture."""
    return report.select("capture", F.to_json(F.struct(*[c for c in report.columns if c != "capture"])).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_lines(report).write.partitionBy("capture").text(path)
