import os

import pytest

from wireloom.sources import captures, sinks

OBJECT = "capture string, id long, name string, value binary"


def found(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


def test_objects_as_files_stay_in_their_folder(spark, tmp_path):
    rows = [("c", 0, "a.html", b"one"), ("c", 1, "../../x", b"two"), ("/far/c", 2, "b/c\\d\0", None), ("..", 3, None, b""), ("c", 4, "RUN.EXE", b"MZ"), (None, 5, "é" * 300, b"long")]
    df = spark.createDataFrame(rows, OBJECT)
    for dump_exe in (True, False):
        folder = str(tmp_path / str(dump_exe))
        listed = {os.path.relpath(r.path, folder): r.length for r in sinks.object_files(df, folder, dump_exe).collect()}
        files = found(folder)
        assert {p: len(v) for p, v in files.items()} == listed and len(files) == 5 + dump_exe
        assert files["c/0-a.html"] == b"one" and files["c/1-.._.._x"] == b"two" and files["_/3-"] == b"" and files["_/5-" + "é" * 100] == b"long"
        assert any(p.startswith("c-") and p.endswith("/2-b_c_d_") for p in files) and ("c/4-RUN.EXE" in files) == dump_exe


def test_a_file_that_fails_leaves_nothing_and_one_that_is_written_again_replaces(tmp_path):
    path = str(tmp_path / "d" / "f")
    with pytest.raises(ValueError), sinks.new_file(path) as stream:
        stream.write(b"half")
        raise ValueError
    assert found(tmp_path) == {}
    for data in (b"first", b"again"):
        with sinks.new_file(path) as stream:
            stream.write(data)
        assert found(tmp_path) == {"d/f": data}


def test_captures_are_written_and_read_again(spark, tmp_path):
    rows = [(c, 0, 113 if c == "b" else 1, 1_000_000 * i + 7, bytes([i]) * i) for c in ("a", "b") for i in (3, 1, 2, 0)]
    files = sinks.write_captures(spark.createDataFrame(rows, captures.FRAMES), str(tmp_path), "ts_us").collect()
    assert {os.path.basename(r.path): r.length for r in files} == {"a.pcap": 24 + 4 * 16 + 6, "b.pcap": 24 + 4 * 16 + 6}
    got = sorted((os.path.basename(r.capture), r.packet_no, r.link_type, r.ts_us, bytes(r.frame)) for r in captures.read_frames(spark, str(tmp_path)).collect())
    assert got == [(f"{c}.pcap", i, k, 1_000_000 * i + 7, bytes([i]) * i) for c, k in (("a", 1), ("b", 113)) for i in range(4)]
