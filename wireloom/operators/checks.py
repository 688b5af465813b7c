"""Connectivity checks. Each check returns member rows: one per gate, pin or net behind a finding.

`subject` names the finding inside its circuit and check, so a finding is the group of rows with equal
(circuit_id, check, subject). Lists are built only where a bounded sample is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom import schema as S
from wireloom.functions import names
from wireloom.operators import buses, graph
from wireloom.operators.model import GATE, NET, missing_pins, po_gates, unknown_cells
from wireloom.operators.scale import materialise, numbered, sample_list, top_k
from wireloom.tables import Tables

C = "circuit_id"
KEY = [C, "check", "subject"]


def _members(df: DataFrame, check, severity, subject: Column, gate=None, pin=None, net=None) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    opt = lambda x, t: F.col(x).cast(t) if isinstance(x, str) else (x if x is not None else F.lit(None).cast(t))
    return df.select(C, as_col(check).alias("check"), as_col(severity).alias("severity"), subject.alias("subject"),
                     opt(gate, "int").alias("gate_id"), opt(pin, "string").alias("pin"),
                     opt(net, "string").alias("net"))


def _gate_pin(gate="gate_id", pin="pin") -> Column:
    return F.concat(F.lit("G"), F.col(gate).cast("string"), F.lit("."), F.col(pin))


# ------------------------------------------------------------------ electrical
def check_missing_pin(t: Tables) -> DataFrame:
    m = missing_pins(t.gates, t.pins, t.cell_pins, t.empty_pins)
    sev = F.when(F.col("direction") == "input", "error").otherwise("warning")
    return _members(m, "missing_pin", sev, _gate_pin(), "gate_id", "pin")


def _ends_of(t: Tables, bad: DataFrame, side: str) -> DataFrame:
    return t.pins.filter(F.col("direction") == side).join(bad.select(*NET), NET, "left_semi")


def check_floating_net(t: Tables) -> DataFrame:
    bad = t.nets.filter("n_drivers = 0 and gate_readers > 0")
    return _members(_ends_of(t, bad, "input"), "floating_net", "error", F.col("net"), "gate_id", "pin", "net")


def check_multi_driver(t: Tables) -> DataFrame:
    bad = t.nets.filter("n_drivers > 1")
    rows = _members(_ends_of(t, bad, "output"), "multi_driver", "error", F.col("net"), "gate_id", "pin", "net")
    no_gate = bad.filter("gate_drivers = 0")
    return rows.union(_members(no_gate, "multi_driver", "error", F.col("net"), net="net"))


def check_dangling_output(t: Tables) -> DataFrame:
    """`dangling_output`, or `carry_out_unread` for the carry pin of an adder cell."""
    bad = t.nets.filter("gate_drivers > 0 and n_readers = 0")
    d = _ends_of(t, bad, "output").join(t.gates.select(*GATE, "cell"), GATE)
    carry = (F.col("pin") == "CO") & F.col("cell").rlike(S.ADDER_CELL)
    return _members(d, F.when(carry, "carry_out_unread").otherwise("dangling_output"), "warning",
                    F.concat(_gate_pin(), F.lit("="), F.col("net")), "gate_id", "pin", "net")


def check_const_input(t: Tables) -> DataFrame:
    bad = t.nets.filter("const_drivers > 0 and gate_readers > 0")
    return _members(_ends_of(t, bad, "input"), "const_input", "info", F.col("net"), "gate_id", "pin", "net")


def check_undriven_po(t: Tables) -> DataFrame:
    bad = t.net_ends.filter("kind = 'po'").join(t.nets.filter("n_drivers > 0"), NET, "left_anti")
    return _members(bad, "undriven_po", "error", F.col("name"), net="name")


def check_unused_pi(t: Tables) -> DataFrame:
    bad = t.net_ends.filter("kind = 'pi'").join(t.nets.filter("n_readers > 0"), NET, "left_anti")
    return _members(bad, "unused_pi", "warning", F.col("name"), net="name")


def check_unknown_cell(t: Tables) -> DataFrame:
    g = t.gates.join(t.cell_pins.select("cell").distinct(), "cell", "left_anti")
    return _members(g, "unknown_cell", "info", F.col("cell"), "gate_id")


# ------------------------------------------------------------------ reachability
def fed_gates(t: Tables) -> DataFrame:
    """Gates without inputs, or with an input driven by a port, a constant or an assign."""
    ins = t.pins.filter("direction = 'input'")
    live = t.net_ends.filter("side = 'driver' and kind <> 'gate'").select(*NET).distinct()
    return (t.gates.select(*GATE).join(ins, GATE, "left_anti")
            .union(ins.join(live, NET, "left_semi").select(*GATE)).distinct())


def ending_gates(t: Tables) -> DataFrame:
    """Gates that drive a primary output or feed an assign."""
    ends = t.net_ends.filter("side = 'reader' and kind in ('po','assign')").select(*NET).distinct()
    return t.pins.filter("direction = 'output'").join(ends, NET, "left_semi").select(*GATE).distinct()


def _region_check(t: Tables, seeds, direction, check, pin_side, loose_nets) -> DataFrame:
    ok = graph.reach(t.edges, seeds, direction).select(*GATE).distinct()
    rest = t.gates.select(*GATE).join(ok, GATE, "left_anti")
    reg = graph.regions(t.edges, rest)
    touch = t.pins.filter(F.col("direction") == pin_side).join(reg, GATE)
    loose = touch.join(loose_nets, NET, "left_semi").select(C, "region", "net").distinct()
    explained = loose.select(C, "region").distinct().withColumn("_x", F.lit(True))
    reg = reg.join(explained, [C, "region"], "left")
    sev = F.when(F.col("_x"), "info").otherwise("warning")
    subject = F.concat(F.lit("R"), F.col("region").cast("string"))
    gates = _members(reg, check, sev, subject, "gate_id")
    return gates.union(_members(loose, check, "info", subject, net="net"))


def check_unreachable(t: Tables) -> DataFrame:
    """Regions no primary input reaches; info when an undriven net explains the region."""
    undriven = t.nets.filter("n_drivers = 0").select(*NET)
    return _region_check(t, fed_gates(t), "forward", "unreachable_from_pi", "input", undriven)


def check_no_path_to_po(t: Tables) -> DataFrame:
    """Regions that reach no primary output; info when an unread net explains the region."""
    unread = t.nets.filter("n_readers = 0").select(*NET)
    return _region_check(t, ending_gates(t), "backward", "no_path_to_po", "output", unread)


# ------------------------------------------------------------------ structural
def component_summary(t: Tables, comp: DataFrame | None = None) -> DataFrame:
    """Components over gates and ports with their counts, largest first (`rank`)."""
    comp = graph.typed_components(t.net_ends) if comp is None else comp
    kind = F.split_part("vertex", F.lit(":"), F.lit(1))
    sizes = comp.groupBy(C, "component").agg(
        F.count_if(kind == "g").alias("gates"), F.count_if(kind == "pi").alias("inputs"),
        F.count_if(kind == "po").alias("outputs"),
        F.min(F.when(kind == "g", F.split_part("vertex", F.lit(":"), F.lit(2)).cast("int"))).alias("first_gate"))
    alone = (t.gates.select(*GATE).join(t.pins, GATE, "left_anti")
             .select(C, F.concat(F.lit("g:"), F.col("gate_id").cast("string")).alias("component"),
                     F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("gate_id")))
    sizes = sizes.filter("gates > 0").union(alone)
    return numbered(sizes, [C], [F.col("gates").desc(), F.col("first_gate")], "rank")


def check_isolated_component(t: Tables) -> DataFrame:
    """Every component but the largest of its circuit."""
    comp = graph.typed_components(t.net_ends)
    small = component_summary(t, comp).filter("rank > 1").select(C, "component", "first_gate")
    m = small.join(comp.filter("vertex like 'g:%'"), [C, "component"], "left").withColumn(
        "gate_id", F.coalesce(F.split_part("vertex", F.lit(":"), F.lit(2)).cast("int"), F.col("first_gate")))
    return _members(m, "isolated_component", "warning",
                    F.concat(F.lit("R"), F.col("first_gate").cast("string")), "gate_id")


def check_combinational_loop(t: Tables) -> DataFrame:
    """Gates on or behind a cycle when register outputs are cut."""
    regs = t.gates.filter(names.is_sequential("cell"))
    left = graph.topo_levels(t.gates, t.edges, regs).filter("rank is null")
    return _members(left, "combinational_loop", "warning", F.lit("loop"), "gate_id")


# ------------------------------------------------------------------ model hints
def neighbour_majority(edges: DataFrame, preds: DataFrame) -> DataFrame:
    """Most frequent predicted class among the neighbours of each gate (ties: smallest class)."""
    sym = graph.symmetric(edges)
    p = preds.select(C, F.col("gate_id").alias("dst"), F.col("pred_class").alias("c"))
    per = sym.join(p, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"), "c").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*GATE).agg(
        F.sum("n").alias("neighbours"),
        F.max(F.struct("n", (-F.col("c")).alias("m"))).alias("top")).select(
        *GATE, "neighbours", (-F.col("top.m")).alias("majority"), F.col("top.n").alias("majority_n"))


def check_class_disagrees(t: Tables) -> DataFrame:
    maj = neighbour_majority(t.edges, t.preds).filter(F.col("neighbours") >= S.MIN_NEIGHBOURS)
    bad = (maj.join(t.preds.select(*GATE, "pred_class"), GATE)
           .filter((F.col("majority") != F.col("pred_class"))
                   & (F.col("majority_n") / F.col("neighbours") >= S.NEIGHBOUR_MAJORITY))
           .join(t.gates.select(*GATE, "hier_prefix"), GATE))
    subject = F.concat_ws("|", "hier_prefix", F.col("pred_class").cast("string"), F.col("majority").cast("string"))
    return _members(bad, "class_disagrees_with_neighbours", "info", subject, "gate_id")


def check_low_confidence(t: Tables) -> DataFrame:
    bad = (t.preds.filter(F.array_max("prob") < S.LOW_PROBABILITY)
           .join(t.gates.select(*GATE, "hier_prefix"), GATE))
    return _members(bad, "low_confidence_prediction", "info", F.col("hier_prefix"), "gate_id")


def check_singleton_subcircuit(t: Tables) -> DataFrame:
    """Gates without a neighbour of their own predicted class."""
    p = t.preds.select(*GATE, "pred_class")
    sym = graph.symmetric(t.edges)
    same = (sym.join(p.select(C, F.col("gate_id").alias("src"), F.col("pred_class").alias("a")), [C, "src"])
            .join(p.select(C, F.col("gate_id").alias("dst"), F.col("pred_class").alias("b")), [C, "dst"])
            .filter("a = b").select(C, F.col("src").alias("gate_id")).distinct())
    return _members(p.join(same, GATE, "left_anti"), "singleton_subcircuit", "info",
                    F.concat(F.lit("class"), F.col("pred_class").cast("string")), "gate_id")


# ------------------------------------------------------------------ buses
def check_bit_patterns(t: Tables) -> DataFrame:
    """Bus bits that break an arithmetic dependency pattern; info where another run is the cause."""
    return buses.bit_pattern_members(t)


def check_intent(t: Tables) -> DataFrame:
    """Buses that don't depend on what their inferred function needs."""
    return buses.intent_checks(t)


# ------------------------------------------------------------------ pipeline
ELECTRICAL = (check_missing_pin, check_floating_net, check_multi_driver, check_dangling_output,
              check_const_input, check_undriven_po, check_unused_pi, check_unknown_cell)
REACHABILITY = (check_unreachable, check_no_path_to_po)
STRUCTURAL = (check_isolated_component, check_combinational_loop)
BUS = (check_bit_patterns, check_intent)
MODEL = (check_class_disagrees, check_low_confidence, check_singleton_subcircuit)


#: Checks that a function can report.
REPORTS = {
    check_missing_pin: ("missing_pin",), check_floating_net: ("floating_net",), check_multi_driver: ("multi_driver",),
    check_dangling_output: ("dangling_output", "carry_out_unread"), check_const_input: ("const_input",), check_undriven_po: ("undriven_po",),
    check_unused_pi: ("unused_pi",), check_unknown_cell: ("unknown_cell",), check_unreachable: ("unreachable_from_pi",),
    check_no_path_to_po: ("no_path_to_po",), check_isolated_component: ("isolated_component",), check_combinational_loop: ("combinational_loop",),
    check_class_disagrees: ("class_disagrees_with_neighbours",), check_low_confidence: ("low_confidence_prediction",),
    check_singleton_subcircuit: ("singleton_subcircuit",), check_bit_patterns: ("carry_break", "bit_slice_anomaly"), check_intent: ("intent_dependency",),
}


def default_checks(t: Tables, predictor: str = "graph") -> tuple:
    """Checks that the tables allow. Low confidence says nothing about the weak predictor, so it is left out there."""
    model = () if t.preds is None else tuple(c for c in MODEL if predictor != "baseline" or c is not check_low_confidence)
    return ELECTRICAL + REACHABILITY + STRUCTURAL + (() if t.bus_bits is None else BUS) + model


def reported_by(checks) -> tuple[str, ...]:
    return tuple(name for c in checks for name in REPORTS[c])


def run_checks(t: Tables, checks=None, extra: DataFrame | None = None, predictor: str = "graph") -> DataFrame:
    """Member rows of all checks that the tables allow, or of `checks`; `extra` adds rows of further ones."""
    if checks is None:
        checks = default_checks(t, predictor)
    t.nets = materialise(t.nets, "nets")  # nearly every check reads the net counts
    out = None
    for c in checks:
        rows = c(t)
        out = rows if out is None else out.unionByName(rows)
    return out if extra is None else out.unionByName(extra)


def _catalog_case(position: int, weak: bool = False) -> Column:
    out = None
    for row in S.CHECK_CATALOG:
        cond = F.col("check") == row[0]
        out = F.when(cond, row[position]) if out is None else out.when(cond, row[position])
    return out


def confidence(predictor: str = "graph") -> Column:
    """Facts have confidence 1; model hints start at 0.4, or 0.2 for the weak predictor."""
    base = 0.2 if predictor == "baseline" else 0.4
    return (F.when(_catalog_case(2) == "fact", 1.0)
            .when(F.col("check") == "class_disagrees_with_neighbours", base)
            .when(F.col("check") == "singleton_subcircuit", round(base * 0.75, 2))
            .when(F.col("check") == "low_confidence_prediction", 0.5)
            .when(F.col("check") == "carry_break", 0.9).when(F.col("check") == "bit_slice_anomaly", 0.8)
            .when(F.col("check") == "intent_dependency", 0.85).otherwise(0.7))


def findings(members: DataFrame, predictor: str = "graph") -> DataFrame:
    """One row per finding with its first gate and net and its size."""
    g = members.groupBy(C, "check", "severity", "subject").agg(
        F.min("gate_id").alias("first_gate"), F.min("net").alias("first_net"),
        F.count("gate_id").alias("gate_rows"), F.count(F.lit(1)).alias("members"))
    return (g.withColumn("category", _catalog_case(1)).withColumn("certainty", _catalog_case(2))
            .withColumn("confidence", confidence(predictor))
            .withColumn("model_based", F.col("category") == "gnn_suspicion"))


def merge_findings(members: DataFrame, gates: DataFrame, threshold: int = S.GROUP_THRESHOLD,
                   sample: int = S.MAX_SAMPLE) -> DataFrame:
    """More than `threshold` findings of one (check, severity, block) become one row with sampled gates."""
    f = findings(members)
    block = gates.select(C, F.col("gate_id").alias("first_gate"), F.col("hier_prefix").alias("_b"))
    f = f.join(block, [C, "first_gate"], "left").withColumn("block", F.coalesce("_b", F.lit(""))).drop("_b")
    key = [C, "check", "severity", "block"]
    size = f.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.min("subject").alias("_first"))
    f = f.join(size, key).withColumn("merged", F.col("count") > threshold)
    f = f.withColumn("group_subject", F.when(F.col("merged"), F.col("_first")).otherwise(F.col("subject")))
    out = [C, "check", "category", "severity", "block", "group_subject", "merged"]
    head = f.groupBy(*out).agg(F.count(F.lit(1)).alias("count"), F.min("first_gate").alias("first_gate"),
                               F.min("first_net").alias("first_net"))
    gates_of = members.filter("gate_id is not null").join(
        f.select(C, "check", "severity", "subject", "block", "group_subject"), [C, "check", "severity", "subject"])
    s = sample_list(gates_of, [C, "check", "severity", "block", "group_subject"], "gate_id", sample, "gate_ids")
    return head.join(s, [C, "check", "severity", "block", "group_subject"], "left")


def severity_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in S.SEVERITIES]), F.col("severity"))


def category_rank() -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in S.CATEGORIES]), F.col("category"))


def number_findings(f: DataFrame, subject: str = "subject") -> DataFrame:
    """Ids F001, F002, ... per circuit by severity, category, check, first gate and first net."""
    order = [severity_rank(), category_rank(), F.col("check"), F.coalesce("first_gate", F.lit(-1)),
             F.coalesce("first_net", F.lit("")), F.col(subject)]
    return numbered(f, [C], order, "number").withColumn("id", names.finding_label("number"))


def finding_stats(f: DataFrame, t: Tables) -> DataFrame:
    """Counts by severity per circuit next to the circuit's own sizes."""
    sev = f.groupBy(C).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in S.SEVERITIES])
    size = lambda df, n: df.groupBy(C).agg(F.count(F.lit(1)).alias(n))
    out = size(t.gates, "gates").join(size(t.nets, "nets"), C, "left").join(size(t.edges, "edges"), C, "left")
    out = out.join(size(t.ports, "ports"), C, "left").join(sev, C, "left")
    return out.na.fill(0)


def stats_by_check(f: DataFrame) -> DataFrame:
    return f.groupBy(C, "check", "severity").agg(F.count(F.lit(1)).alias("n"))


def passed_checks(f: DataFrame, circuits: DataFrame, ran: tuple[str, ...]) -> DataFrame:
    """Of the checks that ran, those without an error or warning, per circuit."""
    catalog = F.explode(F.array(*[F.lit(r[0]) for r in S.CHECK_CATALOG if r[0] in ran]).cast("array<string>")).alias("check")
    fired = f.filter("severity <> 'info'").select(C, "check").distinct()
    return circuits.select(C).distinct().select(C, catalog).join(fired, [C, "check"], "left_anti")


def health(f: DataFrame, circuits: DataFrame) -> DataFrame:
    """Worst severity per circuit; `ok` without findings."""
    worst = f.groupBy(C).agg(F.min(severity_rank()).alias("r"))
    return (circuits.select(C).distinct().join(worst, C, "left")
            .select(C, F.when(F.col("r") == 1, "error").when(F.col("r") == 2, "warning")
                    .when(F.col("r") == 3, "info").otherwise("ok").alias("health")))
