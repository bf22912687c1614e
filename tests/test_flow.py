from wireloom.operators import flow


def test_long_chains_and_cycles_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(flow, "written", lambda df, name, real=flow.written: rounds.append(name) or real(df, name))
    chain = [("chain", i + 1, f"h{i}", f"h{i + 1}") for i in range(500)]
    cycle = [("cycle", 1, "a", "b"), ("cycle", 2, "b", "c"), ("cycle", 3, "c", "a"), ("tree", 5, "x", "y"), ("tree", 6, "y", "z"), ("tree", 2, "z", "w"), ("tree", 9, "x", "v")]
    edges = flow.written(spark.createDataFrame(chain + cycle, "capture string, idx long, parent string, child string"), "edges")
    alone = spark.createDataFrame([("tree", "alone")], "capture string, host string")
    rounds.clear()
    got = sorted((r.capture, r.depth, tuple(r.path)) for r in flow.flow_paths(edges, alone).collect())
    assert len(rounds) <= 10
    want = [("chain", n + 1, ("Client", *(f"h{i}" for i in range(n + 1)))) for n in range(501)]
    # the edge c to a is the lowest of a, but comes after a's own edge, so the cycle is cut above a
    want += [("cycle", 1, ("Client", "a")), ("cycle", 2, ("Client", "a", "b")), ("cycle", 3, ("Client", "a", "b", "c")), ("cycle", 4, ("Client", "a", "b", "c", "a"))]
    tree = [("x",), ("z",), ("alone",), ("x", "y"), ("x", "y", "z"), ("z", "w"), ("x", "v")]
    want += [("tree", len(p), ("Client", *p)) for p in tree]
    assert got == sorted(want)


def test_no_edges(spark):
    none = spark.createDataFrame([], "capture string, idx long, parent string, child string")
    assert flow.flow_paths(none).count() == 0
