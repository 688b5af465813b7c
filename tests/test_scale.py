"""Steps that many queries share: what they write and how many rows go through their rounds."""

import random

from wireloom.operators import features, graph
from wireloom.operators.scale import carry_forward
from wireloom.plans import bindings
from wireloom.sources import netlists
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _smallest(links):
    low = {(c, x): x for c, u, v in links for x in (u, v)}
    while True:
        new = dict(low)
        for c, u, v in links:
            new[c, u] = new[c, v] = min(new[c, u], new[c, v], low[c, u], low[c, v])
        if new == low:
            return low
        low = new


def test_components_of_circuits_cut_over_batches(spark, monkeypatch):
    r = random.Random(3)
    links = [(c, f"{'gé'[r.random() < 0.5]}:{r.randrange(40)}", f"w:{r.randrange(40)}") for c in range(3) for _ in range(30)]
    links += [(7, f"p{i}", f"p{i + 1}") for i in range(50)] + [(8, "a", "a"), (None, "a", "b")]
    for size in (3, 50_000):
        monkeypatch.setattr(graph, "FOREST_LINKS", size)
        got = graph.components(spark.createDataFrame(links, "circuit_id int, u string, v string")).collect()
        assert {(x.circuit_id, x.vertex): x.component for x in got} == _smallest([x for x in links if x[0] is not None and x[1] != x[2]])
        assert len(got) == len({(x.circuit_id, x.vertex) for x in got})
    assert graph.components(spark.createDataFrame([], "circuit_id int, u int, v int")).count() == 0


def test_whole_components_of_a_batch_need_no_rounds(spark, monkeypatch):
    seen = []
    rounds = graph.until_stable
    monkeypatch.setattr(graph, "until_stable", lambda state, *a, **k: seen.append(state.count()) or rounds(state, *a, **k))
    links = [(1, i, i + 1) for i in range(200)] + [(2, 1, 5)]
    got = graph.components(spark.createDataFrame(links, "circuit_id int, u int, v int")).groupBy("circuit_id", "component").count().collect()
    assert {tuple(x) for x in got} == {(1, 0, 201), (2, 1, 2)}
    assert seen[0] <= 201  # circuit 1 may be cut by the ranges, circuit 2 is whole
    assert graph.components(spark.createDataFrame([(c, 1, 2) for c in range(300)], "circuit_id int, u int, v int")).count() == 600
    assert seen[1] == 0


def test_bound_tables_are_written_once(spark):
    t = bindings.tables(spark, SF)
    for table in (t.pins, t.gates, t.bus_bits, t.ports, t.preds, t.cell_pins):
        assert not [f for f in table.inputFiles() if f.startswith(f"file://{SF}/") or f.startswith(f"file:{SF}/")]
    assert t.pins.inputFiles() == t.pins.inputFiles() and t.gates.inputFiles() == t.preds.inputFiles()


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_lines_of_netlists_are_written_before_both_ways_read_them(spark):
    lines = spark.createDataFrame([("m", 0, i, t) for i, t in enumerate(["a /* x", "y */ b; // z", "c;"])], "circuit_id string, slice int, ord long, text string")
    clean = netlists._uncommented(lines)
    assert clean.inputFiles() and "ExistingRDD" not in _plan(clean)
    assert [x.text for x in clean.orderBy("ord").collect()] == ["a ", " b; ", "c;"]


def test_last_values_of_slices_are_combined_map_side(spark):
    r = random.Random(5)
    rows = [(g, i, r.choice([None, r.randrange(9)])) for g in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    for backward in (False, True):
        for strict in (False, True):
            out = carry_forward(df, ["g"], F.floor(F.col("i") / 7), [F.col("i")], F.col("v"), "near", backward, strict)
            assert _plan(out).count("Window ") == 2  # the rows of a slice, and the slices of a group
            for x in out.collect():
                seen = [v for g, i, v in rows if g == x.g and v is not None and ((i > x.i if backward else i < x.i) or (i == x.i and not strict))]
                assert x.near == ((seen[0] if backward else seen[-1]) if seen else None)


def test_gates_are_not_dealt_out_by_column(spark):
    gates = spark.createDataFrame([(1, i, float(i), 1.0, i % 2) for i in range(6)], "circuit_id int, gate_id int, a double, b double, label int")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(5)], "circuit_id int, src int, dst int")
    w = spark.createDataFrame([(i, j, 0.5) for i in range(2) for j in range(2)], "i int, j int, value double")
    p = features.gcn_score(gates, gates, edges, ["a", "b"], w, w)
    assert _plan(p).count("BroadcastHashJoin [i#") >= 2 and "hashpartitioning(i#" not in p._jdf.queryExecution().executedPlan().toString()
    assert p.groupBy("gate_id").agg(F.sum("p").alias("s")).filter("abs(s - 1) < 1e-9").count() == 6


def test_components_that_fit_a_task_need_no_rounds(spark, monkeypatch):
    """Cones of a chain of 300 gates and of many small circuits, closed in tasks or, beyond the bound, in rounds: the same rows."""
    from wireloom.operators import graph
    chain = [("c", i, i + 1) for i in range(300)] + [(f"s{k}", i, (i + 1) % 3) for k in range(40) for i in range(3)]
    edges = spark.createDataFrame(chain, "circuit_id string, src int, dst int")
    roots = spark.createDataFrame([("c", "last", 300), ("c", "mid", 20), *[(f"s{k}", "r", 0) for k in range(40)]], "circuit_id string, root string, gate_id int")
    rounds = []
    monkeypatch.setattr(graph, "_rounds", lambda *a, f=graph._rounds: rounds.append(1) or f(*a))
    want = {("c", "last", i) for i in range(301)} | {("c", "mid", i) for i in range(21)} | {(f"s{k}", "r", i) for k in range(40) for i in range(3)}
    rows = lambda df: {tuple(r) for r in df.select("circuit_id", "root", "gate_id").collect()}
    assert rows(graph.cones(edges, roots)) == want and not rounds
    monkeypatch.setattr(graph, "CLOSE_CELLS", 30)
    short = edges.filter("src < 25")
    assert rows(graph.cones(short, roots)) == {x for x in want if x[2] <= 25} - {("c", "last", i) for i in range(26)} | {("c", "last", 300)} and rounds


def test_words_of_bits_of_wide_buses(spark):
    """A target of 70 bits over an operand of 70: bit 66 misses operand bits 3 and 65 and has bit 68."""
    from wireloom.operators import buses
    have = [(w, o) for w in range(70) for o in range(w + 1) if not (w == 66 and o in (3, 65))] + [(66, 68)]
    profile = spark.createDataFrame([("c", "s", w, "a", o) for w, o in have], "circuit_id string, bus string, significance int, operand string, osig int")
    bits = spark.createDataFrame([("c", b, k, i, f"{b}{i}") for b, k in (("s", "output"), ("a", "input")) for i in range(70)], "circuit_id string, bus string, kind string, significance int, net string")
    driven = bits.filter("bus = 's'")
    ripple = buses.ripple_pattern(profile, bits, driven)
    r = ripple.first()
    assert (r.width, r.bits_with_dependency, r.bits_matching, r.top_bit) == (70, 70, 69, 69)
    run = [tuple(x)[3:] for x in buses.deviant_runs(profile, ripple, driven).collect()]
    assert run == [(66, 66, 2, 1, 65, 68)]
    assert [tuple(x)[3:] for x in buses.pattern_class(profile, bits.filter("bus = 'a'")).collect()] == [(70, 70, 69, "triangular")]
