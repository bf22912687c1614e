import io
import struct
import zipfile

from pyspark.sql import functions as F

from wireloom.functions import kernels
from wireloom.operators import packets as P
from wireloom.sources import captures


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def big_endian_pcap(frames):
    out = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return out + b"".join(struct.pack(">IIII", t // 1_000_000, t % 1_000_000, len(f), len(f)) + f for t, f in frames)


def pcapng(frames, tsresol):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, tsresol, 0, 0))
    for units, f in frames:
        out += block(6, struct.pack("<IIIII", 0, units >> 32, units & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out + block(5, b"\0" * 12)


def test_pcap_both_orders_and_cut_short(spark):
    frames = [(5_000_001, b"abc"), (6_000_002, b"defg")]
    rows = [("le", kernels.write_pcap(frames)), ("be", big_endian_pcap(frames)), ("cut", kernels.write_pcap(frames)[:-1]), ("nano", b"\x4d\x3c\xb2\xa1" + b"\0" * 40), ("none", b"")]
    got = {(r.capture, r.packet_no): (r.ts_us, bytes(r.frame)) for r in captures.frames_of(files(spark, rows)).collect()}
    assert got == {(f, i): frames[i] for f in ("le", "be") for i in (0, 1)} | {("cut", 0): frames[0]}


def test_pcapng_resolutions(spark):
    rows = [("micro", pcapng([(7_000_003, b"abc")], 6)), ("nano", pcapng([(7_000_003_000, b"abc")], 9)), ("two", pcapng([(7 << 10, b"abc")], 0x80 | 10))]
    got = {r.capture: r.ts_us for r in captures.frames_of(files(spark, rows)).collect()}
    assert got == {"micro": 7_000_003, "nano": 7_000_003, "two": 7_000_000}


def tcp(payload=b"hi", flags=24, pad=b"", link="eth", total=None):
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, (40 + len(payload)) if total is None else total, 0, 0, 64, 6, 0, bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8]))
    seg = ip + struct.pack(">HHIIBBHHH", 1000, 80, 4294967295, 7, 0x50, flags, 0, 0, 0) + payload + pad
    mac = bytes(range(12))
    return {
        "eth": mac + b"\x08\x00" + seg, "vlan": mac + b"\x81\x00\x00\x05\x08\x00" + seg, "pppoe": mac + b"\x88\x64" + b"\x11\x00\x00\x01\x00\x00\x00\x21" + seg,
        "cooked": struct.pack(">HHH8sH", 0, 1, 6, bytes(range(6, 14)), 0x0800) + seg, "arp": mac + b"\x08\x06" + seg,
    }[link]


def test_decode_packets(spark):
    frames = [tcp(), tcp(link="vlan"), tcp(link="pppoe"), tcp(link="cooked"), tcp(link="arp"), tcp(b"", pad=b"\0\0\0"), tcp(b"\0" * 19), tcp(b"\0" * 20), tcp(total=0), b"", tcp()[:30], tcp(flags=2), tcp(flags=18), tcp(flags=17), tcp(flags=4)]
    rows = [("c", i, 113 if i == 3 else 1, 0, f) for i, f in enumerate(frames)]
    got = {r.packet_no: r for r in P.decode_packets(spark.createDataFrame(rows, captures.FRAMES)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 5, 6, 7, 11, 12, 13, 14]
    assert all((got[i].src_ip, got[i].dst_port, got[i].seq, bytes(got[i].payload)) == ("1.2.3.4", 80, 4294967295, b"hi") for i in range(4))
    assert got[0].src_mac == "06:07:08:09:0a:0b"
    assert [len(got[i].payload) for i in (5, 6, 7)] == [0, 0, 20]
    assert [got[i].kind for i in (0, 11, 12, 13, 14)] == [0, 1, 2, -1, 0]


def test_saz(spark):
    z = zipfile.ZipFile(out := io.BytesIO(), "w")
    z.writestr("raw/1_m.xml", '<Session><SessionFlags><SessionFlag N="x-clientip" V="::ffff:10.0.0.9"/><SessionFlag N="x-clientport" V="55"/><SessionFlag N="x-hostip" V="1.1.1.1"/></SessionFlags></Session>')
    z.writestr("raw/1_c.txt", "GET http://a.example:8080/x HTTP/1.1\r\nHost: a.example\r\n\r\n")
    z.writestr("raw/1_s.txt", "HTTP/1.1 204 none\r\n\r\n")
    z.close()
    got = captures.saz_of(files(spark, [("s", out.getvalue()), ("broken", b"PKno")])).orderBy("msg_no").collect()
    assert [(r.client, r.server, r.is_request) for r in got] == [("10.0.0.9:55", "1.1.1.1:8080", True), ("10.0.0.9:55", "1.1.1.1:8080", False)]
    assert bytes(got[0].raw).startswith(b"GET /x HTTP/1.1")


def test_binary_files_read_and_signatures(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(kernels.write_pcap([(1, b"x")]))
    assert captures.read_frames(spark, str(tmp_path / "a.pcap")).count() == 1
    (tmp_path / "s.csv").write_text("GIF file,47 49 46 38,GIF,\nWeb page,3C,HTML,html;body\n")
    rows = captures.read_signatures(spark, str(tmp_path / "s.csv")).orderBy("row_no").collect()
    assert [(r.row_no, r.prefix_hex, r.required) for r in rows] == [(0, "47494638", []), (1, "3C", ["html", "body"])]
    (tmp_path / "p.txt").write_text("[UPX one]\nsignature = 60 E8 ?? 00 ?? ??\nep_only = true\nsection_start_only = false\n\n[Two]\nsignature = 55\nep_only = false\n")
    rows = captures.read_packer_signatures(spark, str(tmp_path / "p.txt")).orderBy("name").collect()
    assert [(r.name, r.pattern_hex, r.ep_only, r.section_start_only) for r in rows] == [("Two", "55", False, False), ("UPX one", "60E8??00", True, False)]


def test_requests_through_a_proxy():
    direct = captures.direct_request
    assert direct(b"GET http://h:8080/a b HTTP/1.1\r\nHost: h\r\n\r\nhttp://x/") == (b"GET /a b HTTP/1.1\r\nHost: h\r\n\r\nhttp://x/", 8080)
    assert direct(b"GET https://h/ HTTP/1.1\r\n") == (b"GET / HTTP/1.1\r\n", 80)
    for same in (b"GET /http://h/ HTTP/1.1\r\n", b"GET http://h HTTP/1.1\r\n", b"GET http://h:99999/ HTTP/1.1\r\n", b"CONNECT h:443 HTTP/1.1\r\n", b"", b"GET"):
        assert direct(same) == (same, 80)


def test_captures_of_any_size_are_streamed(spark, tmp_path):
    made = {"a": kernels.write_pcap([(5, b"one"), (6, b"two")]), "b": kernels.write_pcapng([(7, b"three")], 9), "cut": kernels.write_pcap([(5, b"one"), (6, b"two")])[:-1], "no": b"none", "empty": b""}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    rows = lambda df: sorted((r.capture.rsplit("/", 1)[1], r.packet_no, r.link_type, r.ts_us, bytes(r.frame)) for r in df.collect())
    want = [("a", 0, 1, 5, b"one"), ("a", 1, 1, 6, b"two"), ("b", 0, 1, 7, b"three"), ("cut", 0, 1, 5, b"one")]
    assert rows(captures.read_frames(spark, str(tmp_path))) == rows(captures.read_frames(spark, str(tmp_path), large=True)) == want
