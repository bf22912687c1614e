"""Executables as tables: one parser, then plain expressions over its nested rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import kernels, packers
from ..functions.ordinals import ordinal_names
from ..functions.tables import short_batches, written

#: Section names where an entry point is usual, names of calls to warn of, and files that only drivers import from.
GOOD_ENTRY_SECTIONS = (".text", ".code", "CODE", "INIT", "PAGE")
ALERT_CALLS = (
    "OpenProcess", "VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "ReadProcessMemory", "CreateProcess", "WinExec", "ShellExecute",
    "HttpSendRequest", "InternetReadFile", "InternetConnect", "CreateService", "StartService",
)
KERNEL_COMPONENTS = ("ntoskrnl.exe", "hal.dll", "ndis.sys", "bootvid.dll", "kdcom.dll")
SECTION = "struct<name:string,vaddr:long,vsize:long,raw_ptr:long,raw_size:long,entropy:double,head:binary>"
PE = f"capture string, object_id long, size long, timestamp long, image_base long, entry_point long, checksum_claimed long, checksum_actual long, characteristics int, sections array<{SECTION}>, imports array<struct<dll:string,name:string,ordinal:int>>, ep_bytes binary, error string"


def pe_headers(objs: DataFrame, reach: int = 4096) -> DataFrame:
    """PE rows of objects (capture, id, value) that start with MZ; what cannot be read has only `error`.

    reach: bytes kept of each section's start and from the entry point, the longest signature that can match there.
    """
    short_batches(objs.sparkSession)
    rows = objs.where(F.hex(F.substring("value", 1, 2)) == "4D5A").select("capture", "id", "value")

    arrow = to_arrow_schema(T.StructType.fromDDL(PE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for capture, id, value in zip(*(c.to_pylist() for c in b.columns)):
                got = kernels.parse_pe(value, reach)
                out.append({"capture": capture, "object_id": id, "error": None if got else "not readable"} | (got or {}))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, PE)


def kind_of(characteristics: Column, imports: Column) -> Column:
    """DLL by its flag; DRIVER if it imports from a component of the kernel; else EXE."""
    kernel = F.exists(imports, lambda i: F.lower(i["dll"]).isin(*KERNEL_COMPONENTS))
    return F.when(characteristics.bitwiseAND(0x2000) != 0, "DLL").when(kernel, "DRIVER").otherwise("EXE")


def in_section(section: Column, rva: Column) -> Column:
    return (rva >= section["vaddr"]) & (rva < section["vaddr"] + section["vsize"])


def pe_flags(pe: DataFrame, now: Column | None = None) -> DataFrame:
    """pe with bad_time (before 2000 or to come), bad_entry (in no section or an unusual one), bad_checksum."""
    now = F.unix_timestamp(F.current_timestamp()) if now is None else now
    good = F.exists("sections", lambda s: in_section(s, F.col("entry_point")) & s["name"].isin(*GOOD_ENTRY_SECTIONS))
    time = (F.col("timestamp") < 946684800) | (F.col("timestamp") > now)
    return pe.withColumns({"bad_time": time, "bad_entry": ~good, "bad_checksum": F.col("checksum_claimed") != F.col("checksum_actual"), "kind": kind_of(F.col("characteristics"), F.col("imports"))})


def pe_sections(pe: DataFrame) -> DataFrame:
    """One row per section; suspicious: no raw data, or entropy over 7 or between 0 and 1."""
    rows = pe.select("capture", "object_id", F.posexplode("sections").alias("n", "s")).select("capture", "object_id", "n", "s.*")
    e = F.col("entropy")
    return rows.withColumn("suspicious", (F.col("raw_size") == 0) | ((e > 0) & (e < 1)) | (e > 7))


def suspicious_imports(pe: DataFrame) -> DataFrame:
    """Imports whose name starts with an alert call's."""
    rows = pe.select("capture", "object_id", F.explode("imports").alias("i")).select("capture", "object_id", "i.dll", "i.name")
    return rows.where(F.exists(F.array(*[F.lit(x) for x in ALERT_CALLS]), lambda a: F.col("name").startswith(a)))


def imphash(imports: Column, names: dict[str, str] | None = None) -> Column:
    """md5 of `library.function` in lower case, library extensions dropped, joined by commas.

    names: `library:number` to the name of what is imported by number (functions.ordinals.ordinal_names; its libraries are
    the default, larger tables are the caller's). A number without a name is ordN.
    """
    known = F.create_map(*[F.lit(x) for pair in (ordinal_names() if names is None else names).items() for x in pair])

    def one(i: Column) -> Column:
        lib = F.regexp_replace(F.lower(i["dll"]), r"\.(dll|ocx|sys)$", "")
        number = i["ordinal"].cast("string")
        return F.concat(lib, F.lit("."), F.lower(F.coalesce(i["name"], F.try_element_at(known, F.concat(F.lower(i["dll"]), F.lit(":"), number)), F.concat(F.lit("ord"), number))))

    return F.when(F.size(imports) > 0, F.md5(F.array_join(F.transform(imports, one), ",")))


@F.pandas_udf(T.LongType())
def pe_checksum(data: pd.Series, at: pd.Series) -> pd.Series:
    """The folding checksum without the field at `at`, plus the length."""
    return pd.Series([None if d is None else kernels.pe_checksum(d, a) for d, a in zip(data, at)], dtype="Int64")


def probably_packed(sections: Column, size: Column) -> Column:
    """Bytes in sections of entropy over 7.4 are more than a fifth of the file up to the end of its last section."""
    dense = F.aggregate(sections, F.lit(0).cast("long"), lambda a, s: a + F.when(s["entropy"] > 7.4, s["raw_size"]).otherwise(0))
    end = F.aggregate(sections, F.lit(0).cast("long"), lambda a, s: F.greatest(a, s["raw_ptr"] + s["raw_size"]))
    whole = F.least(size, end)
    return F.coalesce((whole > 0) & (dense / F.nullif(whole, F.lit(0)) > 0.2), F.lit(False))


#: Bytes of packer signatures that a scan holds at a time.
SIGNATURE_BLOCK = 32 << 20
#: Bytes of signatures' starts by which they meet the places of files, and forms of starts that do.
STARTS, FORMS = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512), 32
PLACE = "capture string, object_id long, place string, section int, at long, form int, key binary, start binary, after binary"
PACKER = "capture string, object_id long, name string, place string, section int, at long, size int"
Signature = tuple[str, str, bool, bool]


def signature_rows(signatures: DataFrame) -> DataFrame:
    """(name, pattern_hex, ep_only, section_start_only) without nulls; without the flags, signatures of the entry point."""
    flag = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in signatures.columns else F.lit(other)
    return signatures.where("pattern_hex is not null").select("name", "pattern_hex", flag("ep_only", True).alias("ep_only"), flag("section_start_only", False).alias("section_start_only"))


def scan_block(objs: DataFrame, signatures: list[Signature]) -> DataFrame:
    """packer_matches for signatures that a task can hold."""
    arrow = to_arrow_schema(T.StructType.fromDDL(PACKER))
    of = {
        "entry": [s for s in signatures if s[2] and not s[3]],
        "section": [s for s in signatures if s[3]],
        "anywhere": [s for s in signatures if not s[2] and not s[3]],
    }

    def matches(value: bytes, made: dict[str, packers.Signatures]) -> Iterator[tuple[str, int | None, int, int]]:
        """(place, section, offset in the file, number of the signature)"""
        pe = kernels.parse_pe(value, 0)
        if pe and pe["entry_at"] is not None:
            yield from (("entry", None, pe["entry_at"], i) for i in made["entry"].starting(value, pe["entry_at"]))
        for n, s in enumerate(pe["sections"] if pe else []):
            yield from (("section", n, s["raw_ptr"], i) for i in made["section"].starting(value, s["raw_ptr"]))
        if pe:
            yield from (("anywhere", None, at, i) for i, at in made["anywhere"].anywhere(value).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {place: packers.Signatures(s[1] for s in some) for place, some in of.items()}
        for b in batches:
            for capture, id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                out = [
                    {"capture": capture, "object_id": id, "name": of[place][i][0], "place": place, "section": n, "at": at, "size": made[place].sizes[i]}
                    for place, n, at, i in matches(value.as_py(), made)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return objs.where(F.hex(F.substring("value", 1, 2)) == "4D5A").select("capture", "id", "value").mapInArrow(run, PACKER)


def signature_starts(rows: DataFrame) -> DataFrame:
    """signature_rows with pattern (upper case), size, n (the largest of STARTS up to the size), start (the pattern's first n bytes) and
    form (which of these are fixed); start and form are null for signatures that no place of a file is known for, that are no whole
    bytes, that are longer than what a place carries or whose start has more bytes of any value than fixed ones."""
    good = (F.col("ep_only") | F.col("section_start_only")) & F.col("pattern_hex").rlike(r"^([0-9A-Fa-f]{2}|\?\?)+$")
    rows = rows.withColumns({"pattern": F.upper("pattern_hex"), "size": F.when(good, (F.length("pattern_hex") / 2).cast("int"))})
    rows = rows.withColumn("n", F.array_max(F.filter(F.array(*[F.lit(x) for x in STARTS]), lambda x: x <= F.col("size"))))
    start = F.substr("pattern", F.lit(1), 2 * F.col("n"))
    fixed = F.length(F.replace(start, F.lit("?"), F.lit("")))
    rows = rows.withColumn("start", F.when((F.col("size") < 2 * STARTS[-1]) & (fixed >= F.col("n")), start))
    return rows.withColumn("form", F.translate("start", "0123456789ABCDEF", "x" * 16))


def joined_matches(objs: DataFrame, starts: DataFrame, forms: list[str]) -> DataFrame:
    """packer_matches of signature_starts of these forms: places of the objects and signatures meet by a digest of the start and
    are compared in full, so work grows with both and their matches, not with their product."""
    arrow = to_arrow_schema(T.StructType.fromDDL(PLACE))
    known = [(len(f) // 2, [i for i in range(len(f) // 2) if f[2 * i] == "?"]) for f in forms]

    def places(value: bytes) -> Iterator[tuple[str, int | None, int]]:
        pe = kernels.parse_pe(value, 0)
        if pe and pe["entry_at"] is not None:
            yield "entry", None, pe["entry_at"]
        for n, s in enumerate(pe["sections"] if pe else []):
            yield "section", n, s["raw_ptr"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for capture, id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for place, section, at in places(value):
                    for form, (n, wild) in enumerate(known):
                        if at + n <= len(value):
                            start = bytearray(value[at : at + n])
                            for i in wild:
                                start[i] = 0
                            out.append((capture, id, place, section, at, form, hashlib.md5(start).digest(), bytes(start), value[at + n : at + 2 * n - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)

    short_batches(objs.sparkSession)
    found = objs.where(F.hex(F.substring("value", 1, 2)) == "4D5A").select("capture", "id", "value").mapInArrow(run, PLACE)
    place = F.when(F.col("section_start_only"), "section").otherwise("entry")
    start, rest = F.unhex(F.replace("start", F.lit("?"), F.lit("0"))), F.substr("pattern", 2 * F.col("n") + 1)
    wanted = starts.where(F.col("form").isin(forms)).select("name", "size", "n", place.alias("place"), (F.array_position(F.lit(forms), F.col("form")) - 1).cast("int").alias("form"), F.md5(start).alias("key"), start.alias("own"), rest.alias("rest"))
    wanted = wanted.withColumns({"key": F.unhex("key"), "fixed": F.unhex(F.when(~F.contains("rest", F.lit("?")), F.col("rest")))})
    wild = F.rlike(F.hex("after"), F.concat(F.lit("^"), F.replace("rest", F.lit("?"), F.lit("."))))
    same = F.when(F.col("fixed").isNotNull(), F.substring("after", F.lit(1), F.col("size") - F.col("n")) == F.col("fixed")).otherwise(wild)
    rows = found.join(wanted, ["place", "form", "key"]).where((F.col("start") == F.col("own")) & same)
    return rows.select("capture", "object_id", "name", "place", "section", "at", "size")


def packer_matches(objs: DataFrame, signatures: DataFrame, block: int = SIGNATURE_BLOCK) -> DataFrame:
    """(capture, object_id, name, place, section, at, size): packer signatures that match objects (capture, id, value) that are executables.

    signatures: name, pattern_hex (?? for any byte), ep_only, section_start_only. With section_start_only they match where a
    section's data starts (section: its number), else with ep_only where the entry point lies in the file, else anywhere,
    of which the first place is given. at: offset in the file; size: bytes of the signature. A task holds
    `block` bytes of signatures. Of more, those for known places are joined with them by their starts (`signature_starts`, the FORMS most
    frequent forms); the rest, such as those for anywhere, is dealt into blocks, each a scan of the objects whose rows are written.
    """
    rows = signature_rows(signatures)
    blocks = lambda rows: max(1, -(-(rows.agg(F.sum(F.length("pattern_hex"))).first()[0] or 0) // (2 * block)))
    n, found = blocks(rows), []
    if n > 1:
        starts = written(signature_starts(rows), "signature-starts")
        counts = starts.where("form is not null").groupBy("form").count()
        forms = [r["form"] for r in counts.orderBy(F.desc("count"), "form").limit(FORMS).collect()]
        if forms:
            found.append(joined_matches(objs, starts, forms))
            rows = starts.where(~F.coalesce(F.col("form").isin(forms), F.lit(False))).select(*rows.columns)
            n = blocks(rows)
    part = F.pmod(F.xxhash64("pattern_hex", "name"), F.lit(n))
    of_block = lambda i: [tuple(r) for r in (rows if n == 1 else rows.where(part == i)).collect()]
    if n == 1:
        found.append(scan_block(objs, of_block(0)))
    else:
        found += [written(scan_block(objs, of_block(i)), "packers") for i in range(n)]
    return reduce(DataFrame.unionByName, found)


def starting_packers(heads: DataFrame, head: str, signatures: list[tuple[str, str]]) -> DataFrame:
    """heads with hits, the (n, name) of signatures (name, pattern) that the bytes in `head` start with; the bytes go."""
    kind = T.StructType([f for f in heads.schema.fields if f.name != head]).add("hits", T.ArrayType(T.StructType.fromDDL("n int, name string")))
    arrow, rest = to_arrow_schema(kind), [c for c in heads.columns if c != head]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = packers.Signatures(p for _, p in signatures)
        for b in batches:
            hits = [[{"n": made.sizes[i], "name": signatures[i][0]} for i in made.starting(x or b"", 0)] for x in b.column(head).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(hits, arrow.field("hits").type)], schema=arrow)

    return heads.mapInArrow(run, kind)


def match_section_packers(pe: DataFrame, signatures: list[tuple[str, str]]) -> DataFrame:
    """(capture, object_id, n, section, best): signatures that match where a section starts; sections without a match are left out."""
    rows = pe.select("capture", "object_id", F.posexplode("sections").alias("n", "s")).select("capture", "object_id", "n", F.col("s.name").alias("section"), F.col("s.head").alias("head"))
    return starting_packers(rows, "head", signatures).select("capture", "object_id", "n", "section", F.array_max("hits")["name"].alias("best")).where("best is not null")


def match_packers(pe: DataFrame, signatures: list[tuple[str, str]]) -> DataFrame:
    """(capture, object_id, names, best): packer signatures (name, pattern of hex with ?? for any byte) that match at the entry point; best: the longest."""
    rows = starting_packers(pe.select("capture", "object_id", "ep_bytes"), "ep_bytes", signatures)
    return rows.select("capture", "object_id", F.array_sort(F.transform("hits", lambda x: x["name"])).alias("names"), F.array_max("hits")["name"].alias("best"))
