"""One capture file as many tasks.

A pcap file has no index: a packet's place is known from the one before it. Each split looks for its first packet by
itself, as a place from which several headers in a row make sense, counts its packets and says where the next split
ought to begin. Where a split began elsewhere, the rest of that file is walked from the last place that is sure, so the
rows are those of one reader from the start, whatever bytes the packets hold. A running sum of the counts numbers the packets.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.tables import written
from .captures import FRAMES, frame_batches

SPLIT_BYTES = 64 << 20
FILE_HEAD, PACKET_HEAD = 24, 16
#: Headers in a row that must make sense, and the longest packet that does. Guesses only: what they miss is walked.
CHAIN, LONGEST = 8, 1 << 18
#: Bytes in which a split looks for its first packet at a time.
LOOK = 1 << 20
PLACED = "path string, split long, begin long, end long, n long"
PLACED_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def opened(path: str) -> BinaryIO:
    """The file at a path of any store that Arrow reads, buffered and seekable."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path) if path.startswith("file:") else path)
    return io.BufferedReader(store.open_input_file(place), 1 << 20)


def makes_sense(stream: BinaryIO, at: int, order: str, length: int) -> bool:
    """Whether CHAIN headers, or all up to the file's end, follow one another from here."""
    for _ in range(CHAIN):
        if at == length:
            return True
        stream.seek(at)
        head = stream.read(PACKET_HEAD)
        if len(head) < PACKET_HEAD:
            return False
        _, usec, size, whole = struct.unpack(order + "IIII", head)
        if not (usec < 1_000_000 and 0 < size <= whole <= LONGEST):
            return False
        at += PACKET_HEAD + size
    return True


def first_packet(stream: BinaryIO, start: int, stop: int, order: str, length: int) -> int | None:
    """The first place from start on, before stop, from which headers make sense."""
    for low in range(start, stop, LOOK):
        stream.seek(low)
        data = np.frombuffer(stream.read(min(LOOK, stop - low) + PACKET_HEAD - 1), np.uint8).astype(np.uint32)
        if len(data) < PACKET_HEAD:
            return None
        shifts = (0, 8, 16, 24) if order == "<" else (24, 16, 8, 0)
        word = sum(data[i : len(data) - 3 + i] << np.uint32(s) for i, s in enumerate(shifts))
        n = len(data) - PACKET_HEAD + 1
        usec, size, whole = (word[i : i + n] for i in (4, 8, 12))
        for i in np.flatnonzero((usec < 1_000_000) & (size > 0) & (size <= whole) & (whole <= LONGEST)).tolist():
            if makes_sense(stream, low + i, order, length):
                return low + i
    return None


def walked(stream: BinaryIO, at: int, stop: int, order: str, length: int) -> tuple[int, int]:
    """(place of the first packet at or after stop, or where the file ends or is cut short; packets passed)."""
    n = 0
    stream.seek(at)
    while at < stop:
        head = stream.read(PACKET_HEAD)
        if len(head) < PACKET_HEAD:
            break
        size = struct.unpack_from(order + "I", head, 8)[0]
        if at + PACKET_HEAD + size > length:
            break
        stream.seek(size, io.SEEK_CUR)
        at += PACKET_HEAD + size
        n += 1
    return at, n


def placed_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[]] * len(PLACED_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, PLACED_KINDS)], names=[x.split(" ")[0] for x in PLACED.split(", ")])


def guessed(splits: DataFrame, split_bytes: int) -> DataFrame:
    """PLACED rows of splits (path, length, split): begin is null where no packet was found. A file that is no pcap has one split with n = -1: its length is not cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, split in zip(*(c.to_pylist() for c in b.columns)):
                with opened(path) as stream:
                    order = kernels.pcap_order(stream.read(4))
                    start, stop = split * split_bytes, min((split + 1) * split_bytes, length)
                    if order is None:
                        row = [(path, 0, 0, length, -1)] if split == 0 else []
                    else:
                        begin = FILE_HEAD if split == 0 else first_packet(stream, start, stop, order, length)
                        end, n = (start, 0) if begin is None else walked(stream, begin, stop, order, length)
                        row = [(path, split, begin, end, n)]
                yield placed_batch(row)

    return splits.select("path", "length", "split").mapInArrow(run, PLACED)


def walked_on(rests: DataFrame, split_bytes: int) -> DataFrame:
    """PLACED rows of all splits from `split` on of files (path, length, split, sure), walked from the place that is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, split, at in zip(*(c.to_pylist() for c in b.columns)):
                with opened(path) as stream:
                    order = kernels.pcap_order(stream.read(4)) or "<"
                    for k in range(split, -(-length // split_bytes)):
                        begin, (at, n) = at, walked(stream, at, min((k + 1) * split_bytes, length), order, length)
                        if n:
                            yield placed_batch([(path, k, begin, at, n)])
                        elif at < (k + 1) * split_bytes:
                            break  # cut short: nothing follows

    return rests.select("path", "length", "split", "sure").mapInArrow(run, PLACED)


def placed_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, split, begin, n, first_no): where the packets of each split begin, how many they are and the number of the first; files: path, length. n = -1 for a file that is no pcap and is not split."""
    splits = files.where("length > 0").withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {split_bytes}"))))
    spark = files.sparkSession
    n_tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    guesses = written(guessed(splits.repartition(4 * n_tasks), split_bytes), "capture-guesses")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    rows = guesses.withColumn("sure", F.coalesce(F.max("end").over(before), F.lit(FILE_HEAD)))
    # a split that another one's last packet covers begins nowhere
    right = F.when(F.col("begin").isNull(), F.col("sure") >= (F.col("split") + 1) * split_bytes).otherwise(F.col("begin") == F.col("sure"))
    wrong = rows.where((F.col("n") >= 0) & ~right).groupBy("path").agg(F.min("split").alias("bad"), F.min_by("sure", "split").alias("sure"))
    wrong = written(wrong, "capture-wrong")
    kept = guesses.join(wrong.select("path", "bad"), "path", "left").where("bad is null or split < bad").drop("bad")
    mended = walked_on(files.join(wrong.withColumnRenamed("bad", "split"), "path").repartition(n_tasks, "path"), split_bytes)
    both = kept.unionByName(mended).where("n <> 0")
    return both.withColumn("first_no", F.coalesce(F.sum("n").over(before), F.lit(0))).select("path", "split", "begin", "n", "first_no")


def frames_at(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Frames of captures of any size (path, length): pcap files in splits of split_bytes, pcapng whole, packet by packet.

    Splits are dealt over as many tasks as keep all cores busy several times over, and over more where a task would read over
    SPLIT_BYTES. Rows are those of captures.frames_of. Files are read twice: once to find and count packets, once for their bytes.
    Tables of places hold a row a split. Empty files and files of other kinds give nothing.
    """
    places = written(placed_splits(files, split_bytes), "capture-places")
    n_splits = places.count()
    n_tasks = min(n_splits, max(4 * files.sparkSession.sparkContext.defaultParallelism, -(-n_splits * split_bytes // SPLIT_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, n, first_no in zip(*(c.to_pylist() for c in b.columns)):
                with opened(path) as stream:
                    if n < 0:
                        yield from frame_batches(path, kernels.read_capture(stream))
                        continue
                    head = stream.read(FILE_HEAD)
                    order = kernels.pcap_order(head)
                    link = struct.unpack_from(order + "I", head, 20)[0]
                    stream.seek(begin)
                    yield from frame_batches(path, islice(kernels.pcap_packets(stream, order, link), n), first_no)

    return places.select("path", "begin", "n", "first_no").repartition(max(n_tasks, 1)).mapInArrow(run, FRAMES)
