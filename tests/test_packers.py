import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from wireloom.functions import packers
from wireloom.jobs.stand_ins import small_pe
from wireloom.operators import executables as X

byte = st.sampled_from(["00", "01", "0a", "FF", "5D", "??"])
pattern = st.lists(byte, min_size=1, max_size=14).map("".join)
data = st.binary(max_size=40) | st.lists(st.sampled_from([0, 1, 10, 255, 0x5D]), max_size=60).map(bytes)


def as_regex(p):
    return re.compile(b"(?s)" + b"".join(b"." if p[i : i + 2] == "??" else re.escape(bytes.fromhex(p[i : i + 2])) for i in range(0, len(p), 2)))


@given(st.lists(pattern, max_size=8), data, st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_scans_against_regular_expressions(patterns, value, piece):
    made = packers.Signatures(patterns)
    fixed = [i for i, p in enumerate(patterns) if p.replace("??", "")]
    for at in range(len(value)):
        assert sorted(made.starting(value, at)) == [i for i in fixed if as_regex(patterns[i]).match(value, at)]
    size, packers.PIECE = packers.PIECE, piece
    try:
        assert made.anywhere(value) == {i: m.start() for i in fixed if (m := as_regex(patterns[i]).search(value))}
    finally:
        packers.PIECE = size


def test_bad_patterns_match_nothing():
    made = packers.Signatures(["", "4", "4?", "??", "zz", None])
    assert made.starting(b"\x44" * 9, 0) == [] and made.anywhere(b"\x44" * 9) == {}


def test_many_long_signatures_at_their_places(spark):
    rng = random.Random(5)
    body = rng.randbytes(200_000)
    exe = small_pe(1_300_000_000, False, body, ["ExitProcess"])

    def cut(at):
        h = body[at : at + 512].hex().upper()
        return h[:40] + "??" + h[42:]

    odd = small_pe(1_300_000_000, True, body, ["ExitProcess"])
    rows = [(f"noise {i}", rng.randbytes(rng.randint(5, 512)).hex().upper(), i % 3 == 0, i % 3 == 1) for i in range(5000)]
    rows += [("at entry", cut(0), True, False), ("not at entry", cut(7), True, False), ("at section", cut(0), False, True), ("not at section", cut(7), False, True), ("inside", cut(123_456), False, False)]
    rows += [("no bytes", None, False, False), ("flags unset", cut(123_456), None, None)]
    objs = spark.createDataFrame([("c", 1, exe), ("c", 2, odd), ("c", 3, b"MZ broken"), ("c", 4, None), ("c", 5, b"")], "capture string, id long, value binary")
    sigs = spark.createDataFrame(rows, "name string, pattern_hex string, ep_only boolean, section_start_only boolean")
    want = {(1, "at entry", "entry", None, 0), (1, "at section", "section", 0, 0), (1, "inside", "anywhere", None, 123_456), (2, "at section", "section", 0, 0), (2, "inside", "anywhere", None, 123_456)}
    for block in (X.SIGNATURE_BLOCK, 300_000):
        got = X.packer_matches(objs, sigs, block).collect()
        assert {(r.object_id, r.name, r.place, r.section, r.at - 0x200) for r in got} == want and len(got) == len(want)
        assert {r["size"] for r in got} == {512}
    assert X.packer_matches(objs, sigs.limit(0)).count() == 0


def test_signatures_beyond_a_block_are_joined_not_scanned(spark, monkeypatch):
    """However many signatures there are for known places, the objects are scanned once; what the join gives is what scans give."""
    rng = random.Random(7)
    bodies = [bytes(rng.choice((0, 1, 10, 255)) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    objs = spark.createDataFrame([("c", i, small_pe(1_300_000_000, i % 3 == 0, b, ["ExitProcess"])) for i, b in enumerate(bodies)], "capture string, id long, value binary")
    rows = []
    for i in range(400):
        b = bodies[i % 60][: rng.randint(1, 40)].hex()
        p = "".join("??" if rng.random() < 0.2 else b[k : k + 2] for k in range(0, len(b), 2))
        rows.append((f"n{i}", p, i % 4 < 2, i % 4 == 2))
    sigs = spark.createDataFrame([*rows, ("bad", "4", True, False), ("any", "????", True, False)], "name string, pattern_hex string, ep_only boolean, section_start_only boolean")
    want = sorted(map(tuple, X.packer_matches(objs, sigs).collect()), key=str)
    scans, own = [], X.scan_block
    monkeypatch.setattr(X, "scan_block", lambda o, s: scans.append(len(s)) or own(o, s))
    monkeypatch.setattr(X, "FORMS", 1000)
    assert sorted(map(tuple, X.packer_matches(objs, sigs, 2500).collect()), key=str) == want and len(want) > 400
    assert len(scans) == 1 and scans[0] < 250
    monkeypatch.setattr(X, "FORMS", 3)
    assert sorted(map(tuple, X.packer_matches(objs, sigs, 2500).collect()), key=str) == want
