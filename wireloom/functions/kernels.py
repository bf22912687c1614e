"""Byte-level helpers that run inside vectorised functions: each takes one value and never raises."""

from __future__ import annotations

import base64
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import BinaryIO
from urllib.parse import unquote

import numpy as np

MAX_INFLATED = 256 << 20
MAX_BODY = 10_000_000
SHOW_AROUND = 25
#: Digits of a number in a script beyond which it is no count or index.
MOST_DIGITS = 18


def dechunk(raw: bytes) -> bytes:
    """The chunks of a chunked body in a row, extensions ignored, up to a size line that starts with 0 or is broken."""
    out, at = [], 0
    while True:
        end = raw.find(b"\n", at)
        if end < 0:
            break
        size = raw[at:end].split(b";")[0].strip()
        if size.startswith(b"0") or not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            break
        n = int(size, 16)
        out.append(raw[end + 1 : end + 1 + n])
        at = end + 1 + n
        at += 2 if raw[at : at + 2] == b"\r\n" else 1 if raw[at : at + 1] == b"\n" else 0
    return b"".join(out)


def inflated(raw: bytes, wbits: int, limit: int = MAX_INFLATED) -> tuple[bytes | None, bool]:
    """(bytes, whether they are all): None for bytes that are no such stream; what comes before the limit or a cut is given as part."""
    d = zlib.decompressobj(wbits)
    try:
        plain = d.decompress(raw, limit)
    except zlib.error:
        return None, False
    return plain, d.eof


def ungzipped(raw: bytes, limit: int = MAX_INFLATED) -> tuple[bytes | None, bool]:
    """inflated() of bytes that start as gzip and are longer than 10; others as they are, whole."""
    return inflated(raw, 31, limit) if raw[:3] == b"\x1f\x8b\x08" and len(raw) > 10 else (raw, True)


def gunzip(raw: bytes) -> bytes | None:
    return ungzipped(raw)[0]


def framed(body: bytes | None, length: int | None, chunked: bool | None, limit: int = MAX_INFLATED) -> tuple[bytes | None, bytes | None, int | None, bool | None]:
    """(body by its framing, the same without gzip, length, whether gzip was cut short): chunked, or length bytes, or, for length 0, the rest up to MAX_BODY."""
    if body is None:
        return None, None, None, None
    own = dechunk(body) if chunked else body[: length or MAX_BODY]
    plain, whole = ungzipped(own, limit)
    size = len(plain) if chunked and not length and plain is not None else len(own)
    return own, plain, size, plain is not None and not whole


def inflate(raw: bytes) -> bytes | None:
    plain = inflated(raw, 15)[0]
    return inflated(raw, -15)[0] if plain is None else plain


def decode(body: bytes | None, charset: str | None) -> str | None:
    if body is None:
        return None
    for name in (charset, "utf-8", "gb18030"):
        try:
            if name:
                return body.decode(name)
        except (UnicodeError, LookupError, ValueError):  # broken bytes, no such charset, a charset with a zero byte
            continue
    return "[undecodable content]"


def end_of_block(body: bytes, offset: int) -> bytes | None:
    """From offset to the brace that closes the first one after it; None if none does."""
    depth, opened = 0, False
    for m in re.finditer(rb"[{}]", body[offset:]):
        depth += 1 if m.group() == b"{" else -1
        opened = opened or m.group() == b"{"
        if opened and depth == 0:
            return body[offset : offset + m.end()]
    return None


def find_pattern(text: str, pattern: re.Pattern) -> list[tuple[int, int, str, str, str]]:
    """(line from 1, offset, before, match, after) of every match, with SHOW_AROUND characters of context but no line ends."""
    clean, out, line, counted = str.maketrans("", "", "\r\n"), [], 1, 0
    for m in pattern.finditer(text):
        line += text.count("\n", counted, m.start())
        counted = m.start()
        out.append((line, m.start(), text[max(m.start() - SHOW_AROUND, 0) : m.start()].translate(clean), m.group(), text[m.end() : m.end() + SHOW_AROUND].translate(clean)))
    return out


class _Sources(HTMLParser):
    def __init__(self, tag: str, attr: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.attr, self.found = tag, attr, []

    def handle_starttag(self, tag, attrs):
        if tag == self.tag:
            self.found += [v for k, v in attrs if k == self.attr and v is not None]


def tag_sources(text: str, tag: str, attr: str) -> list[str]:
    parser = _Sources(tag, attr)
    try:
        parser.feed(text)
        parser.close()
    except (AssertionError, ValueError):  # a declaration that the parser gives up on: what stands before it was found
        pass
    return parser.found


def zip_names(body: bytes) -> list[str]:
    try:
        return zipfile.ZipFile(io.BytesIO(body)).namelist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError, struct.error, OSError, EOFError):
        return []


def entropy(body: bytes) -> float:
    """Shannon entropy of the bytes, in bits; 0 for none."""
    if not body:
        return 0.0
    p = np.bincount(np.frombuffer(body, np.uint8), minlength=256) / len(body)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def after_blanks(code: str, at: int) -> int:
    while at < len(code) and code[at].isspace():
        at += 1
    return at


def argument(code: str, at: int) -> tuple[str, int] | None:
    """(text, place after it) of a call's argument: a literal in single quotes without them, or what stands before the next comma, bracket or quote."""
    at = end = after_blanks(code, at)
    if code.startswith("'", at):
        end += 1
        while end < len(code) and code[end] != "'":
            end += 2 if code[end] == "\\" else 1
        return (code[at + 1 : end], end + 1) if end < len(code) else None
    while end < len(code) and code[end] not in ",)'":
        end += 1
    return code[at:end].rstrip(), end


def call_arguments(code: str) -> list[str] | None:
    """The first four arguments of the first call of a function's text whose first is a literal and whose fourth is a literal split at bars."""
    brace = code.find("}")
    while brace >= 0:
        at = after_blanks(code, brace + 1)
        found: list[str] = []
        if code.startswith("(", at) and code.startswith("'", after_blanks(code, at + 1)):
            got = argument(code, at + 1)
            while got is not None:
                found.append(got[0])
                if len(found) == 4 and code.startswith(".split('|')", got[1]):
                    return found
                comma = after_blanks(code, got[1])
                got = argument(code, comma + 1) if len(found) < 4 and code.startswith(",", comma) else None
        brace = code.find("}", brace + 1)
    return None


def unpack_packed(code: str) -> str | None:
    """Script of the form eval(function(p,a,c,k,e,..}('payload',base,count,'words'.split('|'),..)) with its words put back, and the strings of a list that it begins with.

    Bases 2 to 62 count in digits and letters, base 95 in the printable ASCII characters.
    """
    got = call_arguments(code)
    if got is None or not got[1].isdecimal() and got[1] != "[]" or not got[2].isdecimal() or max(len(got[1]), len(got[2])) > MOST_DIGITS:
        return None
    payload, count, words = got[0], int(got[2]), got[3].split("|")
    base = 62 if got[1] == "[]" else int(got[1])
    if count != len(words) or not (2 <= base <= 62 or base == 95):
        return None
    letters = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" if base <= 62 else "".join(map(chr, range(32, 127)))
    digits = {c: i for i, c in enumerate(letters[:base])}

    def put_back(t: re.Match) -> str:
        value = 0
        for c in t.group():
            if c not in digits:
                return t.group()
            value = value * base + digits[c]
        return (words[value] or t.group()) if value < len(words) else t.group()

    plain = re.sub(r"\b\w+\b", put_back, payload.replace("\\\\", "\\").replace("\\'", "'"))
    listed = unpack_string_array(plain, "_")
    return plain if listed is None else listed


def quoted_items(code: str, at: int) -> tuple[list[str], int] | None:
    """(string literals, place after the bracket) of a list of double-quoted strings whose opening bracket stands at `at`; None if it is none."""
    items: list[str] = []
    at += 1
    while at < len(code):
        c = code[at]
        if c == "]":
            return items, at + 1
        if c == '"':
            end = at + 1
            while end < len(code) and code[end] != '"':
                end += 2 if code[end] == "\\" else 1
            if end >= len(code):
                return None
            items.append(code[at : end + 1])
            at = end
        elif c not in ", \t\r\n":
            return None
        at += 1
    return None


def unpack_string_array(code: str, prefix: str = "_0x") -> str | None:
    """Script that declares a list of strings under a name that starts with the prefix and uses them by index: each use gives way to its string, the declaration goes."""
    words = code.split(None, 2)
    if len(words) < 2 or words[0] != "var" or not words[1].startswith(prefix):
        return None
    name, equals = words[1].split("=")[0], code.find("=")
    at = equals + 1
    while code[at : at + 1].isspace():
        at += 1
    listed = quoted_items(code, at) if equals > 0 and code[at : at + 1] == "[" else None
    if listed is None:
        return None
    items, at = listed
    pieces = code[at:].removeprefix(";").split(name + "[")
    out = pieces[:1]
    for piece in pieces[1:]:
        index, bracket, rest = piece.partition("]")
        known = bracket and index.isdecimal() and len(index) <= MOST_DIGITS and int(index) < len(items)
        out.append(items[int(index)] + rest if known else name + "[" + piece)
    return "".join(out)


#: How the script that a reversed payload hides begins and ends.
ESCAPED_HEAD, ESCAPED_TAIL = "var _escape='<script>", "</script>'"


def unpack_reversed_base64(code: str) -> str | None:
    """Script that keeps a payload in a variable and evaluates it through nested calls: base64 from right to left of a percent-encoded script."""
    called = code.partition("eval(")[2]
    name = called.partition(")")[0].rpartition("(")[2].strip()
    if not name.isidentifier():
        return None
    for part in code.split("var ")[1:]:
        left, equals, right = part.partition("=")
        if equals and left.strip() == name and right.lstrip().startswith("'"):
            payload = right.lstrip()[1:].partition("'")[0]
            break
    else:
        return None
    try:
        plain = unquote(base64.b64decode(payload[::-1]).decode("utf-8"))
    except ValueError:
        return None
    end = plain.rfind(ESCAPED_TAIL)
    return plain[len(ESCAPED_HEAD) : end] if plain.startswith(ESCAPED_HEAD) and end >= len(ESCAPED_HEAD) else None


def pe_checksum(data: bytes, at: int) -> int:
    """The folding sum of the file's little-endian words without the checksum field at `at`, plus the length."""
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), "<u4").astype(np.uint64)
    if at % 4 == 0 and at // 4 < len(words):
        words[at // 4] = 0
    total = int(words.sum())
    while total >> 32:
        total = (total & 0xFFFFFFFF) + (total >> 32)
    total = (total & 0xFFFF) + (total >> 16)
    total = (total + (total >> 16)) & 0xFFFF
    return total + len(data)


def parse_pe(data: bytes, reach: int = 4096) -> dict | None:
    """Headers, sections and imports of an executable, or None if it is none; `reach` bytes of each section and from the entry point."""
    try:
        if data[:2] != b"MZ":
            return None
        pe = struct.unpack_from("<I", data, 0x3C)[0]
        if data[pe : pe + 4] != b"PE\0\0":
            return None
        _, n_sections, stamp, _, _, n_opt, characteristics = struct.unpack_from("<HHIIIHH", data, pe + 4)
        opt = pe + 24
        plus = struct.unpack_from("<H", data, opt)[0] == 0x20B
        entry = struct.unpack_from("<I", data, opt + 16)[0]
        image_base = struct.unpack_from("<Q", data, opt + 24)[0] if plus else struct.unpack_from("<I", data, opt + 28)[0]
        claimed = struct.unpack_from("<I", data, opt + 64)[0]
        sections = []
        for i in range(n_sections):
            at = opt + n_opt + 40 * i
            name, vsize, vaddr, raw_size, raw_ptr = struct.unpack_from("<8sIIII", data, at)
            body = data[raw_ptr : raw_ptr + raw_size]
            sections.append({"name": name.rstrip(b"\0").decode("latin-1"), "vaddr": vaddr, "vsize": vsize, "raw_ptr": raw_ptr, "raw_size": raw_size, "entropy": entropy(body), "head": body[:reach]})

        def offset(rva: int) -> int | None:
            for s in sections:
                if s["vaddr"] <= rva < s["vaddr"] + max(s["vsize"], s["raw_size"]):
                    return rva - s["vaddr"] + s["raw_ptr"]
            return rva if rva < 0x400 else None

        def text(at: int) -> str:
            return data[at : data.index(b"\0", at)].decode("latin-1")

        dirs = opt + (112 if plus else 96)
        table = offset(struct.unpack_from("<I", data, dirs + 8)[0]) if struct.unpack_from("<I", data, dirs - 4)[0] > 1 else None
        imports: list[dict] = []
        try:
            while table and table + 20 <= len(data):
                names, _, _, dll, first = struct.unpack_from("<IIIII", data, table)
                if not dll:
                    break
                size, at = 8 if plus else 4, offset(names or first)
                while at is not None and at + size <= len(data):
                    value = int.from_bytes(data[at : at + size], "little")
                    if not value:
                        break
                    ordinal = value & 0xFFFF if value >> (8 * size - 1) else None
                    imports.append({"dll": text(offset(dll)), "name": None if ordinal is not None else text(offset(value) + 2), "ordinal": ordinal})
                    at += size
                table += 20
        except (struct.error, ValueError, TypeError, IndexError):
            pass  # a broken table: what was read so far stands
        start = offset(entry)
        ep = data[start : start + reach] if start is not None else b""
        return {"size": len(data), "timestamp": stamp, "image_base": image_base & (2**63 - 1), "entry_point": entry, "checksum_claimed": claimed, "checksum_actual": pe_checksum(data, opt + 64),
                "characteristics": characteristics, "sections": sections, "imports": imports, "ep_bytes": ep, "entry_at": start}
    except (struct.error, ValueError, TypeError, IndexError):
        return None


def pcap_order(head: bytes) -> str | None:
    """The byte order of a pcap file as struct writes it, by its first bytes; None for any other file."""
    return {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">"}.get(head[:4])


def pcap_packets(stream: BinaryIO, order: str, link: int) -> Iterator[tuple[int, int, bytes]]:
    """(link type, microseconds, frame) of the packets from here on; one cut short ends them."""
    while len(head := stream.read(16)) == 16:
        sec, usec, size, _ = struct.unpack(order + "IIII", head)
        frame = stream.read(size)
        if len(frame) < size:
            return
        yield link, sec * 1_000_000 + usec, frame


def read_capture(stream: BinaryIO) -> Iterator[tuple[int, int, bytes]]:
    """(link type, microseconds, frame) of each packet of a pcap or pcapng file, read piece by piece; a packet cut short ends it."""
    magic = stream.read(4)
    if order := pcap_order(magic):
        rest = stream.read(20)
        yield from pcap_packets(stream, order, struct.unpack_from(order + "I", rest, 16)[0] if len(rest) == 20 else 0)
    elif magic == b"\x0a\x0d\x0d\x0a":
        order, links, head = "<", [], magic + stream.read(4)
        while len(head) == 8:
            if head[:4] == b"\x0a\x0d\x0d\x0a":
                mark = stream.read(4)
                order, links = ("<" if mark == b"\x4d\x3c\x2b\x1a" else ">"), []
            else:
                mark = b""
            kind, size = struct.unpack(order + "II", head)
            if size < 12:
                return
            block = mark + stream.read(size - 8 - len(mark))
            if len(block) < size - 8:
                return
            if kind == 1 and len(block) >= 12:
                links.append(interface(order, block[:-4]))
            elif kind == 1 or kind == 6 and len(block) < 24:  # too short for what it says it is
                return
            elif kind == 6:
                i, high, low, n = struct.unpack_from(order + "IIII", block, 0)
                if i < len(links):
                    link, unit, shift = links[i]
                    yield link, (high << 32 | low) * 1_000_000 // unit + shift * 1_000_000, block[20 : 20 + n]
            head = stream.read(8)


def interface(order: str, block: bytes) -> tuple[int, int, int]:
    """(link type, units of time in a second, seconds to add) of an interface block's body, by its options."""
    link, unit, shift, at = struct.unpack_from(order + "H", block, 0)[0], 1_000_000, 0, 8
    while at + 4 <= len(block):
        code, n = struct.unpack_from(order + "HH", block, at)
        if code == 0:
            break
        if code == 9 and n >= 1 and at + 5 <= len(block):
            unit = 2 ** (block[at + 4] & 0x7F) if block[at + 4] & 0x80 else 10 ** block[at + 4]
        if code == 14 and n >= 8 and at + 12 <= len(block):
            shift = struct.unpack_from(order + "q", block, at + 4)[0]
        at += 4 + n + (-n % 4)
    return link, unit, shift


def read_pcap(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    return read_capture(io.BytesIO(data))


def write_pcap(frames, link: int = 1) -> bytes:
    """A little-endian pcap file of (microseconds, frame)."""
    out = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)]
    for ts, frame in frames:
        out += [struct.pack("<IIII", ts // 1_000_000, ts % 1_000_000, len(frame), len(frame)), frame]
    return b"".join(out)


def write_pcapng(frames, resolution: int = 6, link: int = 1) -> bytes:
    """A little-endian pcapng file of (microseconds, frame) with times in units of 10^-resolution seconds, or, with the top bit set, of 2^-resolution."""
    unit = 2 ** (resolution & 0x7F) if resolution & 0x80 else 10**resolution

    def block(kind: int, body: bytes) -> bytes:
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", len(body) + 12)
        return struct.pack("<I", kind) + size + body + size

    out = [block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)), block(1, struct.pack("<HHIHHB3xHH", link, 0, 0, 9, 1, resolution, 0, 0))]
    for ts, frame in frames:
        at = ts * unit // 1_000_000
        out.append(block(6, struct.pack("<IIIII", 0, at >> 32, at & 0xFFFFFFFF, len(frame), len(frame)) + frame))
    return b"".join(out)
