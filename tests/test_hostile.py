"""Byte-level helpers never raise: random bytes, and well-formed inputs with bytes changed, cut or repeated."""

import io
import random
import re
import struct
import zipfile

import pytest

from wireloom.functions import kernels as K
from wireloom.sources import captures
from wireloom.streaming.streams import Sides


def archive() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("raw/1_m.xml", "<S><SessionFlags><SessionFlag N='x-clientip' V='1.1.1.1'/></SessionFlags></S>")
        z.writestr("raw/1_c.txt", "GET http://a.example/b HTTP/1.1\r\n\r\n")
        z.writestr("raw/1_s.txt", "HTTP/1.1 200 OK\r\n\r\n")
    return out.getvalue()


FRAMES = [(i * 1000, bytes(range(60 + i))) for i in range(5)]
SEEDS = {
    "pcap": K.write_pcap(FRAMES), "pcapng": K.write_pcapng(FRAMES, 9), "saz": archive(), "gzip": b"\x1f\x8b\x08" + bytes(30),
    "html": b"<html><![foo[<!DOCTYPE x [<script src='a'>]]><img src=b></html>&#99999999999;",
    "packed": b"eval(function(p,a,c,k,e,d){}('0 1',62,2,'a|b'.split('|'),0,{}))", "array": b'var _0xab = ["a","b"];f(_0xab[0], _0xab[1])', "chunks": b"5\r\nhello\r\n0\r\n\r\n",
}


def mutated(data: bytes, rnd: random.Random) -> bytes:
    out = bytearray(data)
    for _ in range(rnd.randint(1, 6)):
        at, what = rnd.randrange(len(out) + 1), rnd.randrange(4)
        if what == 0 and at < len(out):
            out[at] = rnd.choice((0, 255, rnd.randrange(256)))
        elif what == 1:
            del out[at : at + rnd.randint(1, 20)]
        elif what == 2:
            out[at:at] = rnd.randbytes(rnd.randint(1, 8))
        else:
            out[at:at] = out[at : at + rnd.randint(1, 30)] * rnd.randint(1, 3)
    return bytes(out)


def through_all(data: bytes) -> None:
    text = data.decode("latin-1")
    list(K.read_pcap(data))
    K.dechunk(data), K.ungzipped(data), K.inflate(data), K.framed(data, 5, True), K.end_of_block(data, 3), K.zip_names(data), K.entropy(data), K.parse_pe(data)
    K.decode(data, text[:12]), K.tag_sources(text, "script", "src"), K.find_pattern(text, re.compile("a", re.I))
    K.unpack_packed(text), K.unpack_string_array(text), K.unpack_reversed_base64(text)
    captures.direct_request(data)


@pytest.mark.parametrize("name", SEEDS)
def test_mutations_of_well_formed_inputs(name):
    rnd = random.Random(name)
    for _ in range(400):
        through_all(mutated(SEEDS[name], rnd))


def test_random_bytes():
    rnd = random.Random(1)
    for size in range(0, 300):
        for head in (b"", b"\x0a\x0d\x0d\x0a", b"\xd4\xc3\xb2\xa1", b"MZ", b"PK\x03\x04", b"\x1f\x8b\x08"):
            through_all(head + rnd.randbytes(size))


def test_named_cases():
    assert K.decode("ä".encode(), "undefined") == "ä" and K.decode(b"a", "x\0y") == "a"
    assert K.tag_sources("<script src=a></script><![foo[", "script", "src") == ["a"]
    nines = "9" * 5000
    assert K.unpack_packed(f"eval(function(p,a,c,k,e,d){{}}('0',{nines},{nines},'a'.split('|'),0,{{}}))") is None
    assert K.unpack_string_array(f'var _0xa = ["s"];_0xa[{nines}]') == f"_0xa[{nines}]"
    head = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    for kind, body in ((1, b"\0\0"), (6, b"\0\0\0\0"), (1, struct.pack("<HHIHH", 1, 0, 0, 9, 0)), (1, struct.pack("<HHIHHI", 1, 0, 0, 14, 4, 0))):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", 12 + len(body))
        assert list(K.read_pcap(head + struct.pack("<I", kind) + size + body + size)) == []


def test_broken_and_encrypted_archives_give_no_messages(spark):
    rnd, whole = random.Random(3), archive()
    locked = bytearray(whole)
    for at in [m.start() for m in re.finditer(b"PK\x03\x04", whole)]:
        locked[at + 6] |= 1
    for at in [m.start() for m in re.finditer(b"PK\x01\x02", whole)]:
        locked[at + 8] |= 1
    files = [("whole", whole), ("locked", bytes(locked))] + [(f"m{i}", mutated(whole, rnd)) for i in range(200)]
    rows = captures.saz_of(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {r.capture for r in rows} >= {"whole"} and "locked" not in {r.capture for r in rows}


def test_sides_beyond_four_gib():
    sides, seq, out = Sides(), 4_294_967_000, []
    for no in range(12):  # a step of 1 GiB between packets of one byte would be a gap, so the step stands in for bytes that came
        out += sides.take(no, "a", 0, seq % (1 << 32), 0, b"x" if no else b"GET /")
        sides.next["a"] = sides.at["a"] + (1 << 30)
        seq += 1 << 30
    assert [x[2] for x in out] == [i << 30 for i in range(12)]


def test_kinds_sections_and_long_signatures(spark):
    from wireloom.operators import executables as X

    imports = "array<struct<dll:string,name:string,ordinal:int>>"
    rows = spark.createDataFrame([(0x2000, [("HAL.dll", "a", None)]), (0, [("kernel32.dll", "a", None), ("NTOSKRNL.exe", "b", None)]), (0x1000, []), (0, None)], f"c int, i {imports}")
    assert [r[0] for r in rows.select(X.kind_of(rows.c, rows.i)).collect()] == ["DLL", "DRIVER", "EXE", "EXE"]
    body = bytes(i * 7 % 251 for i in range(512))
    pe = spark.createDataFrame([("c", 1, body)], "capture string, object_id long, ep_bytes binary")
    assert X.match_packers(pe, [("long", body[:400].hex().upper()), ("other", "00" * 300)]).first().best == "long"
