import base64
import hashlib

from pyspark.sql import functions as F

from wireloom.functions import kernels
from wireloom.functions.signatures import type_signatures
from wireloom.operators import conversations as C
from wireloom.operators import executables as X
from wireloom.operators import objects as O
from wireloom.jobs.plugins import Plugins
from wireloom.jobs.stand_ins import small_pe


def typed(spark, *bodies):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b binary")
    return [r.x for r in df.orderBy("i").select(O.identify_type(F.col("b"), type_signatures())["ext"].alias("x")).collect()]


def test_types(spark):
    docx = bytes.fromhex("504B030414000600") + b" word DOCUMENT app.xmlPK"
    bodies = [b"", b"MZ..", b"GIF89a", b"<HTML><Body>", b"<?xml version", b"<x", b"ZWS", b"PK\x03\x04\x0a", b"PK\x03\x04\x14 AppManifest.xaml", docx, b"a\0b", b"plain", bytes(range(128, 200))]
    assert typed(spark, *bodies) == ["", "EXE", "GIF", "HTML", "XML", "TEXT", "SWF", "ZIP", "XAP", "DOCX", "BINARY", "TEXT", "BINARY"]


def test_sizes_names_and_info(spark):
    df = spark.createDataFrame([(5509,), (350008,), (139264,), (12,), (1 << 50,)], "n long")
    assert [r[0] for r in df.select(C.fmt_size(F.col("n"))).collect()] == ["5.4 KB", "341.8 KB", "136.0 KB", "12.0 B", "1.0 PB"]
    df = spark.createDataFrame([("/", 3, ""), ("/a/b.php?x=/y", 4, ""), ("/a/b&c", 5, ""), ("/x", 6, '"n.exe"')], "u string, i long, d string")
    assert [r[0] for r in df.select(C.derive_filename(F.col("u"), F.col("i"), F.col("d"))).collect()] == ["3.html", "b.php", "b", '"n.exe"']
    info = C.conversation_info(spark.createDataFrame([("c", 0, 1404218129000000)], "capture string, id long, ts_us long")).first()
    assert info.time == "Tue, 07/01/14 12:35:29"


def test_dedupe_ignores_case_and_keeps_the_first(spark):
    rows = [("c", 3, 10, "H", "/a"), ("c", 1, 20, "h", "/A"), ("c", 2, 10, "h", "/a"), ("d", 2, 5, "h", "/a")]
    df = spark.createDataFrame(rows, "capture string, packet_no long, ts_us long, host string, uri string")
    assert sorted((r.capture, r.packet_no) for r in C.dedupe_conversations(df).collect()) == [("c", 2), ("d", 2)]


def test_hexdump_strings_and_slices(spark):
    body = b"hello world\0" + b"w\0i\0d\0e\0!\0" + bytes([200])
    row = spark.createDataFrame([(body,)], "b binary").select(O.hexdump(F.col("b")).alias("h"), O.extract_strings(F.col("b")).alias("s"), O.body_base64(F.repeat(F.lit("a"), 100).cast("binary")).alias("e")).first()
    assert row.h.split("\n")[0] == "0000   68 65 6C 6C 6F 20 77 6F 72 6C 64 00 77 00 69 00    hello world.w.i."
    assert row.s == ["hello world", "dwide!"]
    assert row.e == "\n".join(base64.b64encode(b"a" * 100).decode()[i : i + 76] for i in (0, 76))
    assert kernels.end_of_block(b"x{a{b}c}d", 0) == b"x{a{b}c}" and kernels.end_of_block(b"{{}", 0) is None


def test_find_pattern_lines_offsets_and_context(spark):
    df = spark.createDataFrame([(1, "first\nsecond Evil line\r\nthird"), (2, "none"), (3, None)], "id long, value string")
    for pattern in ("evil", "e.il"):
        assert [tuple(r) for r in O.find_pattern(df, pattern).collect()] == [(1, 2, 13, "firstsecond ", "Evil", " linethird")]


def test_tag_sources_and_zip(spark):
    assert kernels.tag_sources('<SCRIPT SRC="a&amp;b"></script><script src=c><iframe src=d>', "script", "src") == ["a&b", "c"]
    assert kernels.zip_names(b"PKbroken") == []


def test_unpackers(spark):
    packed = "eval(function(p,a,c,k,e,r){return p}('0 1=\\'2\\';',62,3,'var|x|hi'.split('|'),0,{}))"
    array = 'var _0xab12= ["log","a\\"b"];console[_0xab12[0]](_0xab12[1])'
    rows = spark.createDataFrame([(0, packed), (1, array), (2, "a%20b"), (3, "plain text")], "i int, code string")
    got = {r.i: (r.detected, r.plain) for r in O.deobfuscate(rows).collect()}
    assert got == {0: (["packed"], "var x='hi';"), 1: (["string_array"], 'console["log"]("a\\"b")'), 2: (["urlencoded"], "a b"), 3: ([], "plain text")}


def test_reputation(spark):
    objs = spark.createDataFrame([("c", 1, b"bad"), ("c", 2, b"good")], "capture string, id long, value binary")
    v = spark.createDataFrame([(hashlib.md5(b"bad").hexdigest(), 1, 2, "d", "l", {"a": (True, "virus"), "b": (False, "")})], "md5 string, positives int, total int, scan_date string, permalink string, scans map<string,struct<detected:boolean,result:string>>")
    summary, engines = O.reputation_join(objs, v)
    assert sorted((r.id, r.found) for r in summary.collect()) == [(1, True), (2, False)]
    assert [(r.id, r.engine, r.result) for r in engines.collect()] == [(1, "a", "virus")]


def test_executables(spark):
    good = small_pe(1_300_000_000, False, bytes(range(256)) * 8, ["ExitProcess", "WinExec"])
    rows = spark.createDataFrame([("c", 1, good), ("c", 2, b"MZ broken"), ("c", 3, b"no")], "capture string, id long, value binary")
    pe = X.pe_headers(rows)
    got = {r.object_id: r for r in X.pe_flags(pe).collect()}
    assert sorted(got) == [1, 2] and got[2].error and not got[1].error
    assert [s.name for s in got[1].sections] == [".text", ".idata"] and [i.name for i in got[1].imports] == ["ExitProcess", "WinExec"]
    assert not got[1].bad_time and not got[1].bad_entry and got[1].bad_checksum
    assert [(r.name, r.suspicious) for r in X.pe_sections(pe).orderBy("n").collect()] == [(".text", True), (".idata", False)]
    assert [(r.section, r.best) for r in X.match_section_packers(pe, [("zero", "0001??"), ("longer", "00010203"), ("other", "FF")]).collect()] == [(".text", "longer")]
    assert [(r.object_id, r.best) for r in X.match_packers(pe, [("zero", "0001??03"), ("short", "00")]).where("best is not null").collect()] == [(1, "zero")]
    assert pe.where("object_id = 1").select(X.probably_packed(F.col("sections"), F.col("size"))).first()[0]


def test_plugins(spark):
    p = Plugins()
    p.register("Count", "rows")(lambda tables, *a: tables["t"].groupBy().count())
    tables = {"t": spark.range(3)}
    assert p.run("COUNT", tables).first()[0] == p.run("0", tables).first()[0] == 3 and p.listing() == [(0, "count", "rows")]
    try:
        p.run("nothing", tables)
        raise AssertionError
    except KeyError:
        pass


def test_scripts_with_strings_and_payloads():
    import base64
    from urllib.parse import quote

    from wireloom.functions import kernels

    assert kernels.unpack_string_array('var _0xa = ["x\\"y", "b" ] ; f(_0xa[1], _0xa[0], _0xa[2], _0xa[n]);') == ' ; f("b", "x\\"y", _0xa[2], _0xa[n]);'
    for other in ("var x = [];", 'var _0xa = ["open', "var _0xa = [1, 2];", "", "var"):
        assert kernels.unpack_string_array(other) is None
    hidden = base64.b64encode(quote("var _escape='<script>alert('x')</script>'; run()").encode()).decode()[::-1]
    assert kernels.unpack_reversed_base64(f"var k = '{hidden}'; var z = 'q'; eval(un(de(k)));") == "alert('x')"
    for other in ("eval(un(de(k)));", "var k = '!!!'; eval(un(de(k)));", "var k = 'YWJj'; eval(un(de(k)));", ""):
        assert kernels.unpack_reversed_base64(other) is None


def test_long_prefixes_of_types(spark):
    body = bytes(range(1, 41))
    rows = spark.createDataFrame([(body,), (body[:39],)], "b binary")
    signatures = [("short", "01 02", "S", ""), ("long", body.hex().upper(), "L", "")]
    assert [r[0].ext for r in rows.select(O.identify_type(rows.b, signatures)).collect()] == ["L", "S"]


def test_declared_lists(spark):
    texts = ['var _0x1f = ["a"]', 'var _0x1f=["a"]', "var _0xg=[1]", "var _0x=[1]", "var _0x1f", "x = [1]", 'var _0x1f = f(["a"])']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, c string").orderBy("i").select(O.declares_list(F.col("c"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False, False, False]


def test_packed_in_base_95_and_with_a_list_of_strings():
    packed = lambda payload, base, words: f"eval(function(p,a,c,k,e,d){{}}('{payload}',{base},{len(words)},'{'|'.join(words)}'.split('|'),0,{{}}))"
    words = [f"w{i}" for i in range(66)]
    assert kernels.unpack_packed(packed("A(0,a)", 95, words)) == "w33(w16,w65)"
    assert kernels.unpack_packed(packed('3 4=["x","y z"];5(4[0],4[1],4[2])', 62, ["", "", "", "var", "_s", "f"])) == 'f("x","y z",_s[2])'
    assert kernels.unpack_packed(packed("0", 70, ["a"])) is None


def test_arguments_of_packed_scripts():
    from wireloom.functions.kernels import call_arguments, unpack_packed

    code = r"eval(function(p,a,c,k,e,d){while(c--){p('x')};return p} ( '0(\'}(\');1' , 2 , 2 , 'alert|done'.split('|'),0,{}))"
    assert call_arguments(code) == [r"0(\'}(\');1", "2", "2", "alert|done"]
    assert unpack_packed(code) == "alert('}(');done"
    for broken in ("}('", "}('a'", "}('a',2,2,'b'", "}('a',2,2,'b')", "}('a',x,1,'b'.split('|')", "}(" * 50_000, "}('" * 50_000, "}" + " " * 50_000):
        assert unpack_packed(broken) is None
