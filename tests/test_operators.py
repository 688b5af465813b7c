"""Operators on small graphs against results worked out by hand or by plain Python."""

import random

import pytest

from wireloom.operators import buses, claims, faults, graph, insights, learning, repair, sampling
from wireloom.functions import statements
from wireloom.operators.scale import carry_forward, front_side, materialise, numbered, running_total
from wireloom.tables import Tables
from pyspark.sql import functions as F

E = "circuit_id int, src int, dst int"


def edges(spark, pairs, c=1):
    return spark.createDataFrame([(c, a, b) for a, b in pairs], E)


def gates(spark, n, c=1):
    return spark.createDataFrame([(c, i) for i in range(n)], "circuit_id int, gate_id int")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_set_bits_are_named_by_an_equal_bit(spark):
    """The first and the last bit of a word name one source each; a word meets its set bits only, not all 64 sources."""
    bit = lambda i: 1 << i if i < 63 else -(1 << 63)
    numbers = spark.createDataFrame([(1, f"n{i}", i // 64, bit(i % 64)) for i in range(128)], "circuit_id int, source string, word int, bit long")
    words = spark.createDataFrame([(1, 7, 0, bit(0) | bit(63)), (1, 8, 1, bit(5))], "circuit_id int, gate_id int, word int, bits long")
    named = graph.Support(words, numbers).named(words)
    assert got(named, "gate_id", "source") == [(7, "n0"), (7, "n63"), (8, "n69")]
    assert "(bit#" in named._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]


def test_cones_carry_roots_as_words(spark, monkeypatch):
    """70 roots on a ring of 5 gates with a tail: all cones are found, and a round writes words of 64 roots, not roots."""
    from wireloom.operators.scale import Store
    e = [(i, (i + 1) % 5) for i in range(5)] + [(4, 5), (5, 6)]
    roots = [(1, f"r{i}", i % 7) for i in range(70)] + [(2, "r0", 3)]
    before, rows, append = {i: {a for a, b in e if b == i} for i in range(7)}, [], Store.append

    def counted(self, df):
        out = append(self, df)
        if self.base.split("/")[-1].startswith("cones-"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(Store, "append", counted)
    want = {(2, "r0", 3)}
    for c, r, g in roots[:-1]:
        met, front = {g}, [g]
        while front:
            front = [x for x in set().union(*(before[i] for i in front)) if x not in met]
            met.update(front)
        want |= {(c, r, x) for x in met}
    table = spark.createDataFrame(roots, "circuit_id int, root string, gate_id int")
    assert set(got(graph.cones(edges(spark, e), table), "circuit_id", "root", "gate_id")) == want
    assert max(rows) <= 2 * 7 + 1


def test_numbering_of_one_hot_group(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("x"), F.lit("hot").alias("g")).repartition(7)
    r = numbered(df, ["g"], [F.col("x")], "rank").collect()
    assert all(x.rank == x.x + 1 for x in r) and len(r) == 5000


def test_large_written_tables_are_not_broadcast(spark):
    """Two million rows of ids are a small file and a large hash table; a small front still is broadcast."""
    adder(spark)
    rows = spark.range(2_000_000).select(F.pmod(F.xxhash64("id"), F.lit(4096)).alias("a"), F.floor(F.col("id") / 1000).alias("b"))
    t, u = materialise(rows, "packed"), materialise(rows, "packed")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(t.join(u, ["a", "b"]))
    assert "BroadcastHashJoin" in plan(front_side(t.filter("a < 3"), 6000).join(u, ["a", "b"]))
    assert "BroadcastHashJoin" not in plan(front_side(t, 2_000_000).join(u, ["a", "b"]))


def test_running_total_and_carry_over_slices(spark):
    df = spark.range(100).select(F.lit(1).alias("g"), "id", F.floor(F.col("id") / 7).alias("s"), F.when(F.col("id") % 30 == 5, F.col("id")).alias("v"))
    r = running_total(df, ["g"], "s", [F.col("id")], {"t": F.col("id")}).collect()
    assert all(x.t == x.id * (x.id + 1) // 2 for x in r)
    c = carry_forward(df, ["g"], F.col("s"), [F.col("id")], F.col("v"), "last").collect()
    assert all(x["last"] == (None if x.id < 5 else (x.id - 5) // 30 * 30 + 5) for x in c)
    b = carry_forward(df, ["g"], F.col("s"), [F.col("id")], F.col("v"), "nxt", backward=True).collect()
    assert all(x.nxt == next((v for v in (5, 35, 65, 95) if v >= x.id), None) for x in b)


def test_components_of_a_long_path(spark):
    e = edges(spark, [(i, i + 1) for i in range(200) if i != 100])
    c = graph.gate_components(gates(spark, 202), e)
    sizes = {r.component: r.n for r in c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {0: 101, 101: 100, 201: 1}


def test_levels_paths_and_peel(spark):
    e = edges(spark, [(0, 2), (1, 2), (2, 3), (3, 4), (1, 4)])
    g = gates(spark, 6)
    lv = graph.levels(g, e)
    assert got(lv, "gate_id", "level_in", "level_out") == [(0, 1, 4), (1, 1, 4), (2, 2, 3), (3, 3, 2), (4, 4, 1), (5, 1, 1)]
    p = graph.longest_paths(lv, e, g.filter("gate_id = 4"))
    assert [r.gate_id for r in p.orderBy("position").collect()] == [0, 2, 3, 4]
    cyc = edges(spark, [(0, 1), (1, 2), (2, 1), (2, 3)])
    assert got(graph.topo_levels(gates(spark, 4), cyc).na.fill(-1), "gate_id", "rank") == [(0, 1), (1, -1), (2, -1), (3, -1)]


def test_trace_prefers_small_ids_and_falls_back(spark):
    e = edges(spark, [(0, 2), (0, 1), (1, 3), (2, 3), (3, 4)])
    pairs = spark.createDataFrame([(1, 0, 4), (1, 4, 0), (1, 4, 9)], "circuit_id int, from_id int, to_id int")
    r = graph.trace_path(e, pairs).orderBy("from_id", "position").collect()
    assert [(x.from_id, x.gate_id, x.direction) for x in r] == [(0, 0, "forward"), (0, 1, "forward"), (0, 3, "forward"), (0, 4, "forward"),
                                                                 (4, 0, "reverse"), (4, 1, "reverse"), (4, 3, "reverse"), (4, 4, "reverse")]


def adder(spark, swap=False, cut=False):
    """Eight-bit ripple adder: gate i adds bit i and passes its carry on."""
    pins, n = [], 8
    for i in range(n):
        a = f"a[{i + 1 if swap and i == 3 else i - 1 if swap and i == 4 else i}]"
        pins += [(1, i, "A", a, "input"), (1, i, "B", f"b[{i}]", "input"), (1, i, "S", f"s[{i}]", "output"), (1, i, "CO", f"c{i}", "output")]
        if i and not (cut and i == 4):
            pins.append((1, i, "CI", f"c{i - 1}", "input"))
    p = spark.createDataFrame(pins, "circuit_id int, gate_id int, pin string, net string, direction string")
    bits = spark.createDataFrame([(1, b, k, i, f"{b}[{i}]") for b, k in (("a", "input"), ("b", "input"), ("s", "output")) for i in range(n)],
                                 "circuit_id int, bus string, kind string, significance int, net string")
    ports = bits.select("circuit_id", "net", F.col("kind").alias("port_dir"))
    g = spark.createDataFrame([(1, i, f"add_1/u{i}", "ADDF_X1M", "add_1", "add_1", 0) for i in range(n)],
                              "circuit_id int, gate_id int, inst string, cell string, hier_prefix string, block string, label int")
    lib = spark.createDataFrame([("ADDF_X1M", x, d) for x, d in (("A", "input"), ("B", "input"), ("CI", "input"), ("S", "output"), ("CO", "output"))],
                                "cell string, pin string, direction string")
    return Tables(gates=g, pins=p, ports=ports, bus_bits=bits, cell_pins=lib)


def runs_of(t):
    sup = graph.support_sets(t.pins, t.ports.filter("port_dir = 'input'"))
    prof = buses.dependency_profile(t.pins, t.bus_bits.filter("kind = 'output'"), t.bus_bits.filter("kind = 'input'"), sup)
    driven = buses.driven_bits(t.bus_bits.filter("kind = 'output'"), t.pins)
    ripple = buses.ripple_pattern(prof, t.bus_bits, driven)
    return prof, driven, ripple, buses.deviant_runs(prof, ripple, driven)


def test_clean_adder_has_no_deviation(spark):
    t = adder(spark)
    prof, driven, ripple, runs = runs_of(t)
    assert got(ripple, "operand", "bits_matching") == [("a", 8), ("b", 8)] and runs.count() == 0
    live = buses.live_bits(t.bus_bits, t.nets)
    pat = buses.pattern_class(prof, live)
    assert got(pat, "operand", "pattern") == [("a", "triangular"), ("b", "triangular")]
    inv = spark.createDataFrame([], "circuit_id int, bus string, operand string, inverted double")
    assert got(buses.cone_signatures(driven, pat, pat.filter("false"), inv), "bus", "classification", "operand_width") == [("s", "adder-like", 8)]


def test_cut_carry_is_a_carry_break(spark):
    t = adder(spark, cut=True)
    *_, runs = runs_of(t)
    assert got(buses.classify_runs(runs), "check", "first_bit", "last_bit", "operands") == [("carry_break", 4, 7, 2)]
    assert graph.link_chains(graph.carry_links(t.gates, t.pins)).select("length").distinct().count() == 1


def test_swapped_bits_are_an_anomaly_with_both_halves(spark):
    t = adder(spark, swap=True)
    *_, runs = runs_of(t)
    assert got(buses.classify_runs(runs), "check", "first_bit", "last_bit") == [("bit_slice_anomaly", 3, 3)]
    s = buses.swap_suggestions(runs, t.bus_bits, t.pins, t.gates, t.edges)
    assert got(s, "gate_id", "pin", "from_net", "replaces_net", "confidence") == [(3, "A", "a[3]", "a[4]", 0.8), (4, "A", "a[4]", "a[3]", 0.6)]


def test_bus_checks_share_one_profile(spark, monkeypatch):
    from wireloom.operators import checks
    calls, profile = [], buses.input_profile
    monkeypatch.setattr(buses, "input_profile", lambda t: calls.append(1) or profile(t))
    t = adder(spark, cut=True)
    for check in checks.BUS:
        check(t)
    assert len(calls) == 1


@pytest.mark.parametrize("kind,check", [("drop_pin", "missing_pin"), ("float_net", "floating_net"), ("cut_carry", "missing_pin"), ("disconnect_po", "undriven_po"),
                                        ("miswire_bits", "bit_slice_anomaly")])
def test_faults_are_found(spark, kind, check):
    from dataclasses import replace
    from wireloom.operators import checks
    t = adder(spark)
    pins, truth = faults.inject(t, kind, 3)
    f = replace(t, pins=pins)
    members = checks.run_checks(f, checks.ELECTRICAL)
    if kind == "miswire_bits":
        *_, runs = runs_of(f)
        members = members.union(buses.run_members(buses.classify_runs(runs), f.bus_bits))
        site = truth.first()
        assert check in {r.check for r in members.collect()} and site.expected_check == check
        return
    m = faults.detection_matrix(members, truth).first()
    assert (m.fault, m.faults, m.recall) == (kind, 1, 1.0)
    if kind in ("drop_pin", "float_net", "cut_carry"):
        sinks, sources = repair.broken_ends(f)
        a = repair.confidence(repair.assign(sinks, sources), sources)
        site = truth.first()
        fixes = {(r.sink_id, r.from_gate, r.from_pin) for r in a.collect()}
        assert any(s.startswith(f"pin.{site.gate_id}.{site.pin}") and (g, p) == (site.from_gate, site.from_pin) for s, g, p in fixes)


def test_fault_corpus_holds_every_kind_and_seed_as_a_mutant(spark):
    from wireloom.operators import checks
    t = adder(spark)
    mutants, truth = faults.fault_corpus(t, (1, 2))
    kinds = {r.fault for r in faults.all_sites(t).select("fault").distinct().collect()}
    assert {(r.fault, r.seed) for r in truth.collect()} == {(k, s) for k in kinds for s in (1, 2)}
    pins = {r.circuit_id: r.n for r in mutants.pins.groupBy("circuit_id").agg(F.count("*").alias("n")).collect()}
    n = t.pins.count()
    for r in truth.collect():
        assert r.circuit_id == f"{r.base}:{r.fault}:{r.seed}"
        assert pins[r.circuit_id] == n - (r.expected_check == "missing_pin")
    members = checks.run_checks(mutants, (*checks.ELECTRICAL, checks.check_bit_patterns))
    sinks, sources = repair.broken_ends(mutants)
    edges = faults.suggested_edges(repair.best_sources(sinks, sources, 2))
    m = {r.fault: r for r in faults.detection_matrix(members, truth, edges).collect()}
    assert {k: (r.faults, r.recall) for k, r in m.items()} == {k: (2, 1.0) for k in kinds}
    assert {"drop_pin", "float_net", "cut_carry", "disconnect_po", "miswire_bits"} <= kinds
    assert all(m[k].ranked_first == 1.0 for k in ("drop_pin", "float_net", "cut_carry"))


def test_links_stay_single_where_a_gate_is_listed_twice(spark):
    """Blocks with more than 15 slices share gate ids with the next block; that adds no sites."""
    from dataclasses import replace
    t = adder(spark)
    twice = replace(t, gates=t.gates.union(t.gates.filter("gate_id in (3, 4)")))
    key = ("gate_id", "pin", "net", "from_gate", "from_pin")
    for kind in ("drop_pin", "cut_carry"):
        sites = got(faults.fault_sites(t, kind), *key)
        assert sites and got(faults.fault_sites(twice, kind), *key) == sites


def test_weighted_draws_lose_none_and_follow_the_weights(spark):
    items = spark.createDataFrame([(i, 300.0 if i == 7 else 1.0 if i % 2 else 0.0) for i in range(200)], "id int, w double")
    draws = spark.range(4000).select(F.col("id").alias("k"))
    got_ = sampling.weighted_draws(items, "w", ["id"], draws, 5, piece_rows=16).groupBy("id").agg(F.count("*").alias("n")).collect()
    n = {r.id: r.n for r in got_}
    assert sum(n.values()) == 4000 and all(i % 2 for i in n)
    assert abs(n[7] / 4000 - 300 / 399) < 0.05


def _score(k, s):
    if s["kind"] == "gate" and k["gate_id"] == s["gate_id"]:
        return None
    x = 1 - s["penalty"] + (3 if k["block"] == s["block"] else 0) - min(abs(s["gate_id"] - k["gate_id"]), 1000) / 1000
    return x + ((4 if k["pin"] == "CI" else 0) if s["pin"] == "CO" else (-1 if k["pin"] == "CI" else 0))


def test_assignment_equals_the_sequential_greedy(spark):
    rnd = random.Random(5)
    ids = rnd.sample(range(400), 60)
    sinks = [dict(circuit_id=1, sink_id=f"k{i:02d}", kind="pin", gate_id=ids[i], pin=rnd.choice(["A", "CI"]), net=None, block=rnd.choice("xy"), allow_pi=True) for i in range(25)]
    sources = [dict(circuit_id=1, source_id=f"s{i:02d}", kind="gate", gate_id=ids[25 + i], pin=rnd.choice(["Y", "CO"]), net=f"q{i}", block=rnd.choice("xy"),
                    penalty=float(i % 5 == 0), reusable=i % 5 == 0) for i in range(30)]
    score = {(k["sink_id"], s["source_id"]): _score(k, s) for k in sinks for s in sources}
    ranked = {k["sink_id"]: sorted(((score[k["sink_id"], s["source_id"]], s["source_id"]) for s in sources if score[k["sink_id"], s["source_id"]] is not None), reverse=True) for k in sinks}
    used, want = set(), {}
    for _, k in sorted(((round(v[0][0], 9), k) for k, v in ranked.items()), reverse=True):
        sc, s = next((x, y) for x, y in ranked[k] if y not in used)
        want[k] = (s, round(sc, 6))
        if int(s[1:]) % 5:
            used.add(s)
    ks = spark.createDataFrame(sinks, "circuit_id int, sink_id string, kind string, gate_id int, pin string, net string, block string, allow_pi boolean")
    ss = spark.createDataFrame(sources, "circuit_id int, source_id string, kind string, gate_id int, pin string, net string, block string, penalty double, reusable boolean")
    best2 = {(r.sink_id, r.candidate): r.s_source_id for r in repair.best_sources(ks, ss, 2).collect()}
    assert all(best2[k, 1] == v[0][1] and abs(score[k, best2[k, 2]] - v[1][0]) < 1e-9 for k, v in ranked.items())
    for batch in (2000, 7):
        have = {r.sink_id: (r.s_source_id, round(r.score, 6)) for r in repair.assign(ks, ss, batch).collect()}
        assert have == want


def test_contested_sources_take_few_rounds(spark, monkeypatch):
    """10,000 ends on one side of 10,000 sources all want the same one first, and 3,000 ports have no position at all."""
    n, rounds = 10_000, []
    settle = repair._offers
    monkeypatch.setattr(repair, "_offers", lambda df: rounds.append(1) or settle(df))
    ks = spark.range(n).select(F.lit(1).alias("circuit_id"), F.format_string("k%05d", "id").alias("sink_id"), F.lit("pin").alias("kind"), F.col("id").cast("int").alias("gate_id"),
                               F.lit("A").alias("pin"), F.lit(None).cast("string").alias("net"), F.lit("x").alias("block"), F.lit(True).alias("allow_pi"))
    po = spark.range(3000).select(F.lit(1), F.format_string("p%05d", "id"), F.lit("po"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("z"), F.lit(None).cast("string"), F.lit(True))
    ss = spark.range(n).select(F.lit(1).alias("circuit_id"), F.format_string("s%05d", "id").alias("source_id"), F.lit("gate").alias("kind"), (F.col("id") + 9_500).cast("int").alias("gate_id"),
                               F.lit("Y").alias("pin"), F.lit(None).cast("string").alias("net"), F.lit("x").alias("block"), F.lit(0.0).alias("penalty"), F.lit(False).alias("reusable"))
    pi = spark.range(3000).select(F.lit(1), F.format_string("i%05d", "id"), F.lit("pi"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit("q"), F.lit(None).cast("string"), F.lit(0.0), F.lit(False))
    got = repair.assign(ks.union(po), ss.union(pi), 5000).select("sink_id", "s_source_id", "score").collect()
    assert len(got) == 13_000 and len({r.s_source_id for r in got}) == 13_000 and len(rounds) <= 6, len(rounds)


def test_second_driver_offers_both(spark):
    sinks = spark.createDataFrame([(1, "k", "pin", 5, "A", None, "x", True)], "circuit_id int, sink_id string, kind string, gate_id int, pin string, net string, block string, allow_pi boolean")
    sources = spark.createDataFrame([(1, f"m.{g}", "gate", g, "Y", "n", "x", 1.0, True) for g in (2, 3)],
                                    "circuit_id int, source_id string, kind string, gate_id int, pin string, net string, block string, penalty double, reusable boolean")
    c = repair.confidence(repair.assign(sinks, sources), sources)
    assert got(c, "from_gate", "confidence", "ambiguous") == [(2, 0.5, True), (3, 0.5, True)]


def test_duplicates_and_inverter_pairs(spark):
    P = [(0, "A", "x", "i"), (0, "B", "y", "i"), (0, "Y", "n0", "o"), (1, "A", "x", "i"), (1, "B", "y", "i"), (1, "Y", "n1", "o"), (2, "A", "n0", "i"), (2, "Y", "n2", "o"),
         (3, "A", "n2", "i"), (3, "Y", "z", "o"), (4, "A", "y", "i"), (4, "B", "x", "i"), (4, "Y", "n4", "o")]
    pins = spark.createDataFrame([(1, g, p, n, "input" if d == "i" else "output") for g, p, n, d in P], "circuit_id int, gate_id int, pin string, net string, direction string")
    cells = {0: "NAND2_X1M", 1: "NAND2_X2M", 2: "INV_X1M", 3: "INV_X1M", 4: "NAND2_X1M"}
    g = spark.createDataFrame([(1, i, c) for i, c in cells.items()], "circuit_id int, gate_id int, cell string")
    ports = spark.createDataFrame([(1, "x", "input"), (1, "y", "input"), (1, "z", "output")], "circuit_id int, net string, port_dir string")
    t = Tables(gates=g, pins=pins, ports=ports)
    assert got(insights.duplicates(t), "group", "gate_id") == [(0, 0), (0, 1)]
    assert got(insights.inverter_pairs(t), "first", "second") == [(2, 3)]


def test_false_claims_go_and_true_ones_stay(spark):
    g, e = gates(spark, 4), edges(spark, [(0, 1), (1, 2)])
    pins = spark.createDataFrame([(1, 0, "Y", "n0", "output"), (1, 1, "A", "n0", "input")], "circuit_id int, gate_id int, pin string, net string, direction string")
    text = ("G0 drives G1. G1 drives G0. [G2] is driven by G1, and it works.\nThe chain is:\n- G0 -> G1 -> G2\n- G2 -> G0\n"
            "Wrong ones:\n- G3 feeds G0.\nG0 drives [N:n0]. G2 reads n0.\nG9 drives G0.")
    t = spark.createDataFrame([("t", 1, text)], "text_id string, circuit_id int, text string")
    want = "G0 drives G1. [G2] is driven by G1, and it works.\nThe chain is:\n- G0 -> G1 -> G2\nG0 drives [N:n0].\nG9 drives G0."
    assert claims.check_claims(t, g, e, pins).first().text == want


def test_samples_stay_inside(spark):
    rnd = random.Random(2)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(200)}
    e = edges(spark, [(a, b) for a, b in pairs if a != b])
    train = gates(spark, 30)
    sym = {(r.src, r.dst) for r in graph.symmetric(e).collect()}
    walk = sampling.sample_rw(e, train, 3, 5, 2, 1)
    assert walk.collect() and {r.sample_id for r in walk.collect()} == {0, 1, 2}
    near = {a for a, _ in sym}
    assert all(r.gate_id < 30 or r.gate_id in near for r in walk.collect())
    nodes = sampling.sample_nodes(e, train, 2, 40, 1)
    assert all(r.gate_id < 30 for r in nodes.collect())
    i = sampling.induced(e, walk).collect()
    members = {(r.sample_id, r.gate_id) for r in walk.collect()}
    assert all((r.sample_id, r.src) in members and (r.sample_id, r.dst) in members for r in i)
    assert {(r.src, r.dst) for r in sampling.sample_edges(e, 1, 50, 3, "draw").alias("x").join(e.limit(0), "circuit_id").collect()} == set()
    a, b = (got(sampling.sample_rw(e.repartition(n), train, 2, 4, 2, 9), "sample_id", "gate_id") for n in (1, 5))
    assert a == b


def test_statements_are_read_by_tokens():
    small = {"and", "it", "gate"}  # words that are no names of nets
    read = lambda f, text: [tuple(c)[:5] for c in f(statements.tokens(text)) if c.name not in small]
    assert read(statements.relations, "[G1]'s output pin Y also drives [N:a[3]] and G2, which works") == [("edge", 1, 2, None, None), ("driver", 1, None, "a[3]", None)]
    assert read(statements.relations, "G4 is fed by G3 and it reads G9.") == [("edge", 3, 4, None, None)]
    assert read(statements.relations, "\\top/n4 is read by gate G5") == [("reader", 5, None, "\\top/n4", None)]
    assert read(statements.relations, "n4 reads G5") == []
    assert read(statements.classes, "G5 (u5) was predicted to be part of the Control Logic") == [("predicted", 5, None, None, 2)]
    assert read(statements.classes, "The model predicts that G7 is an Adder. [G8] belongs to the Comparator") == [("predicted", 7, None, None, 0), ("stated", 8, None, None, 4)]
    count = lambda text: read(statements.numbers, text)
    assert count("It takes 5 ns") == count("an area of 3.2 um^2") == count("saves about 30% of power by up to 20 %")[:1] == count("2x faster") == [("value", None, None, None, None)]
    assert count("30% of all gates are inverters") == [] == count("G5 drives 2-bit words") == count("a path of 7 levels")
    assert count("The longest path has 12 logic levels") == [("depth", None, None, None, 12)] and count("the next longest has 12 levels") == []
    assert count("G5 drives 3 readers") == [("fanout", 5, None, None, 3)] == count("G5 has a fan-out of 3") == count("[G5]'s load is 3") == count("G5 fans out to 3")
    assert count("n7's fan-out is 4") == [("fanout", None, None, "n7", 4)]
    assert count("The design consists of about 12 gates") == [("total", None, None, None, 12)] and count("alu/core block holds 12 gates") == [("block", None, None, "alu/core", 12)]
    assert count("NOR2_X0P5M: 67 instances") == count("67 x NOR2_X0P5M") == count("NOR2_X0P5M is used 67 times") == count("67 copies of NOR2_X0P5M") == [("cell", None, None, "nor2_x0p5m", 67)]
    assert statements.softened("It will definitely reduce delay and is guaranteed to certainly work.") == "It could reduce delay and could work."
    assert statements.softened("It will rain") == "It will rain" and statements.hedged("Likely an adder") and not statements.hedged("It remodels")


def test_aliases_and_routes(spark):
    g, e = gates(spark, 3), edges(spark, [(0, 1)])
    pins = spark.createDataFrame([(1, 0, "Y", "n0", "output"), (1, 1, "A", "n0", "input")], "circuit_id int, gate_id int, pin string, net string, direction string")
    alias = spark.createDataFrame([(1, "out", "n0")], "circuit_id int, alias string, net string")
    t = spark.createDataFrame([("a", 1, "G0 drives out. G1 drives out. G2 reads out.")], "text_id string, circuit_id int, text string")
    assert claims.check_claims(t, g, e, pins, alias).first().text == "G0 drives out."
    assert claims.check_claims(t, g, e, pins).first().text == "G0 drives out. G1 drives out. G2 reads out."
    m = spark.createDataFrame([(1, 0, "Is there a path between G1 and gate #7 through alu_1 or n9?"), (1, 1, "Nothing")], "conv_id int, turn int, text string")
    names = spark.createDataFrame([("block", "alu_1"), ("net", "n8")], "kind string, name string")
    assert [r.lookup for r in claims.route_messages(m, names).orderBy("rank").collect()] == ["trace_path:1-7", "get_gate:1", "get_gate:7", "get_block:alu_1"]


def test_log_records_stand_anywhere(spark):
    from wireloom.sources.datasets import best_epoch, parse_training_log
    text = ("TRAIN (Ep avg): loss = 1.5 mic = 0.3 VALIDATION: loss = 2.5 mic = 0.7 Epoch 1 TRAIN (Ep avg):\n loss = 0.5\nVALIDATION:\tloss = 0.25\tmic = 0.75\n Epoch 2 done\n"
            "VALIDATION: loss = 9.0 mic = 0.9 Epoch 3 TRAIN (Ep avg): loss = 4.0")
    df = spark.createDataFrame([("x", text), ("x", None), ("y", "no record")], "log_id string, text string")
    assert sorted(tuple(r) for r in parse_training_log(df).collect()) == [("x", 1, 1.5, 2.5, 0.7), ("x", 2, 0.5, 0.25, 0.75)]
    assert best_epoch(parse_training_log(df)).first().best_epoch == 2


def test_class_weights_average_to_one(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    w = {r.label: (r["count"], r.weight) for r in learning.class_weights(df).collect()}
    assert abs(sum(n * x for n, x in w.values()) / 8 - 1) < 1e-9 and abs(w[1][1] / w[0][1] - 3) < 1e-9
