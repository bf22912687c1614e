import random
import struct

import pytest

from wireloom.functions import kernels
from wireloom.sources import captures
from wireloom.sources import split_captures as S


def rows(df):
    return sorted((r.capture.rsplit("/", 1)[1], r.packet_no, r.link_type, r.ts_us, bytes(r.frame)) for r in df.collect())


def frames(seed, n, longest=300):
    r = random.Random(seed)
    return [(1_600_000_000_000_000 + i * 999_983, r.randbytes(r.randrange(longest))) for i in range(n)]


def hostile():
    """Packets whose bytes are captures, rows of zeros and headers of their own, and one that spans several splits."""
    inner = kernels.write_pcap(frames(1, 40))
    fake = struct.pack("<IIII", 1, 2, 16, 16) * 400
    return kernels.write_pcap([(5, inner), (6, fake), (7, b"\0" * 5000), (8, b""), (9, inner[24:]), (10, fake[8:]), (11, b"end")] + frames(2, 100))


def test_splits_equal_one_reader(spark, tmp_path):
    big = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 113) + b"".join(struct.pack(">IIII", t // 1_000_000, t % 1_000_000, len(f), len(f)) + f for t, f in frames(3, 200))
    plain = kernels.write_pcap(frames(4, 300))
    broken = bytearray(plain)
    broken[24 + 8 : 24 + 12] = b"\xff" * 4
    made = {"plain": plain, "big": big, "hostile": hostile(), "cut": plain[:-1], "broken": bytes(broken), "head": plain[:24], "short": plain[:10], "no": b"none" * 9000, "ng": kernels.write_pcapng(frames(5, 200)), "empty": b""}
    made["middle"] = plain[:20_000] + b"\xff" * 40 + plain[20_000:]
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    want = rows(captures.read_frames(spark, str(tmp_path)))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    assert {x[0] for x in want} == {"plain", "big", "hostile", "cut", "ng", "middle"}
    for size in (1000, 4096, 1 << 20):
        assert rows(S.frames_at(files, size)) == want


def test_a_capture_is_many_tasks_and_few_are_walked(spark, tmp_path):
    (tmp_path / "a").write_bytes(kernels.write_pcap(frames(6, 2000, 1400)))
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    places = S.placed_splits(files, 100_000).orderBy("split").collect()
    assert len(places) > 8 and places[0].begin == 24 and places[0].first_no == 0
    assert sum(p.n for p in places) == 2000 and all(a.first_no + a.n == b.first_no for a, b in zip(places, places[1:]))
    df = S.frames_at(files, 100_000)
    assert df.rdd.getNumPartitions() == min(len(places), 4 * spark.sparkContext.defaultParallelism)
    assert rows(df) == rows(captures.read_frames(spark, str(tmp_path)))


@pytest.mark.parametrize("seed", range(5))
def test_first_packets_are_found_without_a_walk(tmp_path, seed):
    data = kernels.write_pcap([(t, f + b"x") for t, f in frames(seed, 3000)])
    (tmp_path / "a").write_bytes(data)
    begins, at = set(), 24
    while at < len(data):
        begins.add(at)
        at += 16 + struct.unpack_from("<I", data, at + 8)[0]
    with S.opened(str(tmp_path / "a")) as stream:
        for start in range(1000, len(data) - 5000, 50_021):
            assert S.first_packet(stream, start, len(data), "<", len(data)) == min(b for b in begins if b >= start)
