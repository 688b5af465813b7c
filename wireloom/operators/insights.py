"""Design insights: ports, blocks, timing levels, fan-out, area and power indicators, bills of materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom import schema as S
from wireloom.functions import names
from wireloom.operators.model import GATE, NET
from wireloom.operators.scale import numbered, top_k
from wireloom.tables import Tables

C = "circuit_id"


def _joined(label, count) -> F.Column:
    """'a:3' text of a small map entry."""
    return F.concat(F.col(label), F.lit(":"), F.col(count).cast("string"))


def ports_summary(t: Tables) -> DataFrame:
    buses = t.bus_bits.filter("kind in ('input','output','inout')").groupBy(C, F.col("bus").alias("name"), F.col("kind").alias("port_dir")).agg(
        F.count(F.lit(1)).alias("width"))
    scalar = t.ports.join(t.bus_bits.select(*NET), NET, "left_anti").select(C, F.col("net").alias("name"), "port_dir", F.lit(1).cast("long").alias("width"))
    return buses.union(scalar)


def control_signals(t: Tables, top: int = 10) -> DataFrame:
    """Nets on multiplexer select pins, or primary inputs outside wide operand buses with two or more readers."""
    mux = t.gates.filter(names.cell_base("cell").startswith("MX")).select(*GATE)
    sel = (t.pins.filter(F.col("pin").isin(*S.MUX_SELECT_PINS) & (F.col("direction") == "input")).join(mux, GATE, "left_semi")
           .groupBy(*NET).agg(F.count(F.lit(1)).alias("select_pins")))
    wide = t.bus_bits.filter("kind = 'input'").groupBy(C, "bus").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= S.MIN_BUS_WIDTH)
    operand = t.bus_bits.join(wide, [C, "bus"], "left_semi").select(*NET, F.lit(True).alias("_op"))
    n = t.nets.join(sel, NET, "left").join(operand, NET, "left").na.fill(0, ["select_pins"])
    narrow = (F.col("pi_drivers") > 0) & F.col("_op").isNull()
    keep = n.filter((F.col("select_pins") > 0) | (narrow & (F.col("n_readers") >= 2)))
    keep = keep.select(*NET, F.col("n_readers").alias("fanout"), "select_pins", (F.col("pi_drivers") > 0).alias("primary_input"))
    return top_k(keep, [C], [F.col("select_pins").desc(), F.col("fanout").desc(), F.col("net")], top)


def block_summary(gates: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Gates and share per block with its five most frequent cell families."""
    fam = gates.groupBy(C, "block", names.cell_base("cell").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    size = fam.groupBy(C, "block").agg(F.sum("n").alias("gates"))
    total = size.groupBy(C).agg(F.sum("gates").alias("_t"))
    best = top_k(fam, [C, "block"], [F.col("n").desc(), F.col("family")], 5, "_r")
    cells = best.groupBy(C, "block").agg(F.array_sort(F.collect_list(F.struct("_r", _joined("family", "n").alias("x")))).alias("_c"))
    out = size.join(total, C).join(cells, [C, "block"]).select(
        C, "block", "gates", F.round(F.col("gates") / F.col("_t"), 3).alias("share"),
        F.array_join(F.transform("_c", lambda s: s["x"]), ",").alias("top_cells"))
    if roles is not None:
        out = out.join(roles.groupBy(C, "block").agg(F.min("role").alias("role")), [C, "block"], "left")
    return out


def block_flow(t: Tables) -> DataFrame:
    """Block-to-block connections with the bus that carries them. Sides are reduced to distinct (net, block)."""
    b = t.pins.join(t.gates.select(*GATE, "block"), GATE).select(C, "net", "direction", "block").distinct()
    src = b.filter("direction = 'output'").select(*NET, F.col("block").alias("from_block"))
    dst = b.filter("direction = 'input'").select(*NET, F.col("block").alias("to_block"))
    bus = t.bus_bits.select(*NET, "bus")
    return (src.join(dst, NET).filter("from_block <> to_block").join(bus, NET, "left")
            .select(C, "from_block", "to_block", F.coalesce("bus", F.lit("(internal nets)")).alias("via")).distinct())


def datapaths(signatures: DataFrame, ops: DataFrame) -> DataFrame:
    """Classified buses with the buses they are computed from."""
    s = signatures.filter("classification <> 'unclassified'").select(C, F.col("bus").alias("to_bus"), "classification", "width")
    return s.join(ops.select(C, F.col("bus").alias("to_bus"), F.col("operand").alias("from_bus")), [C, "to_bus"])


def datapath_chains(paths: DataFrame, bus_kinds: DataFrame) -> DataFrame:
    """inputs -> middle bus -> output bus, one row per step pair."""
    out = paths.join(bus_kinds.filter("kind in ('output','inout')").select(C, F.col("bus").alias("to_bus")).distinct(), [C, "to_bus"], "left_semi")
    up = paths.select(C, F.col("to_bus").alias("from_bus"), F.col("from_bus").alias("origin"), F.col("classification").alias("middle_class"))
    return out.join(up, [C, "from_bus"]).select(C, "origin", "middle_class", F.col("from_bus").alias("middle"), "classification", "to_bus")


# ------------------------------------------------------------------ timing levels
def arrivals(t: Tables, levels: DataFrame) -> DataFrame:
    po = t.net_ends.filter("kind = 'po'").select(*NET, F.col("name").alias("output"))
    drv = t.pins.filter("direction = 'output'").join(po, NET).select(*GATE, "output")
    return drv.join(levels, GATE).groupBy(C, "output").agg(F.max("level_in").alias("levels"))


def fanout_histogram(nets: DataFrame) -> DataFrame:
    b = None
    for low, high, label in S.FANOUT_BUCKETS:
        cond = F.col("n_readers") >= low if high is None else F.col("n_readers").between(low, high)
        b = F.when(cond, label) if b is None else b.when(cond, label)
    return (nets.filter("n_readers > 0 and const_drivers = 0").withColumn("bucket", b).groupBy(C, "bucket")
            .agg(F.count(F.lit(1)).alias("nets")))


def depth_histogram(levels: DataFrame) -> DataFrame:
    return levels.groupBy(C, F.col("level_in").alias("level")).agg(F.count(F.lit(1)).alias("gates"))


def high_fanout(t: Tables, critical: DataFrame, top: int = 8, least: int = 2) -> DataFrame:
    """Nets with the most readers; whether a driver is weak or lies on a longest path."""
    n = t.nets.filter((F.col("n_readers") >= least) & (F.col("const_drivers") == 0)).select(*NET, F.col("n_readers").alias("fanout"))
    best = top_k(n, [C], [F.col("fanout").desc(), F.col("net")], top)
    drv = (t.pins.filter("direction = 'output'").join(best.select(*NET), NET, "left_semi").select(*NET, "gate_id")
           .join(t.gates.select(*GATE, names.drive_strength("cell").alias("drive")), GATE)
           .join(critical.select(*GATE, "critical"), GATE, "left"))
    flags = drv.groupBy(*NET).agg(F.bool_or(F.coalesce("drive", F.lit(99.0)) < 1).alias("weak_drive"),
                                  F.bool_or(F.coalesce("critical", F.lit(False))).alias("on_longest_path"),
                                  F.min("gate_id").alias("first_driver"), F.countDistinct("gate_id").alias("drivers"))
    return best.join(flags, NET, "left").na.fill(False, ["weak_drive", "on_longest_path"]).na.fill(-1, ["first_driver"]).na.fill(0, ["drivers"])


def gate_fanout(t: Tables) -> DataFrame:
    """Reader pins over all output nets of a gate, zero included."""
    out = t.pins.filter("direction = 'output'").join(t.nets.select(*NET, "n_readers"), NET)
    fo = out.groupBy(*GATE).agg(F.sum("n_readers").alias("fanout"))
    return t.gates.select(*GATE, "cell", "block").join(fo, GATE, "left").na.fill(0, ["fanout"])


# ------------------------------------------------------------------ area
def duplicates(t: Tables) -> DataFrame:
    """Gates with the same function, the same net on every input pin and one output: (circuit_id, group, gate_id).

    Input lists are compared by count and two order-free 64-bit hashes, so they are never gathered.
    """
    g = t.gates.filter(~names.is_sequential("cell")).select(*GATE, names.cell_base("cell").alias("family"))
    sig = t.pins.groupBy(*GATE).agg(
        F.count_if(F.col("direction") == "output").alias("outs"), F.count_if(F.col("direction") == "input").alias("ins"),
        F.bit_xor(F.when(F.col("direction") == "input", F.xxhash64("pin", "net"))).alias("h1"),
        F.bit_xor(F.when(F.col("direction") == "input", F.xxhash64("net", F.lit("~"), "pin"))).alias("h2"))
    k = [C, "family", "ins", "h1", "h2"]
    s = g.join(sig.filter("ins > 0 and outs = 1"), GATE)
    many = s.groupBy(*k).agg(F.count(F.lit(1)).alias("size"), F.min("gate_id").alias("group")).filter("size > 1")
    return s.join(many, k).select(C, "group", "family", "size", "gate_id")


def inverter_pairs(t: Tables) -> DataFrame:
    """An inverter whose net is read once, by another inverter."""
    inv = t.gates.filter(names.cell_base("cell") == "INV").select(*GATE)
    p = t.pins.join(inv, GATE, "left_semi")
    single = t.nets.filter("n_readers = 1 and gate_readers = 1").select(*NET)
    d = p.filter("direction = 'output'").join(single, NET, "left_semi").select(*NET, F.col("gate_id").alias("first"))
    r = p.filter("direction = 'input'").select(*NET, F.col("gate_id").alias("second"))
    return d.join(r, NET).filter("first <> second").select(C, "first", "second").distinct()


def area_proxy(gates: DataFrame) -> DataFrame:
    """Twelve most frequent families and six densest prefixes per circuit."""
    fam = gates.groupBy(C, names.cell_base("cell").alias("name")).agg(F.count(F.lit(1)).alias("gates"))
    pre = gates.filter("hier_prefix <> ''").groupBy(C, F.col("hier_prefix").alias("name")).agg(F.count(F.lit(1)).alias("gates"))
    order = [F.col("gates").desc(), F.col("name")]
    return (top_k(fam, [C], order, 12).select(C, F.lit("family").alias("kind"), "rank", "name", "gates")
            .union(top_k(pre, [C], order, 6).select(C, F.lit("prefix"), "rank", "name", "gates")))


# ------------------------------------------------------------------ power indicators
def cone_sizes(cones: DataFrame, gates: DataFrame) -> DataFrame:
    x = names.cell_base("cell").rlike(S.XOR_FAMILY)
    return (cones.join(gates.select(*GATE, x.alias("x")), GATE).groupBy(C, F.col("root").alias("bus"))
            .agg(F.count(F.lit(1)).alias("cone_gates"), F.count_if("x").alias("xor_adder_cells")))


def power_indicators(gates: DataFrame, levels: DataFrame) -> DataFrame:
    x = names.cell_base("cell").rlike(S.XOR_FAMILY)
    return gates.join(levels.select(*GATE, "level_in"), GATE, "left").groupBy(C, "block").agg(
        F.count(F.lit(1)).alias("gates"), F.count_if(x).alias("xor_adder_cells"), F.max("level_in").alias("max_level"))


# ------------------------------------------------------------------ bill of materials
def bom(gates: DataFrame, cell_pins: DataFrame | None = None, cell_attrs: DataFrame | None = None) -> DataFrame:
    """One row per cell and circuit: count, share, blocks, drive, pins, area and leakage where a library has them."""
    per = gates.groupBy(C, "cell", "block").agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy(C).agg(F.sum("n").alias("_t"))
    rows = per.groupBy(C, "cell").agg(
        F.sum("n").alias("count"), F.array_sort(F.collect_list(_joined("block", "n"))).alias("_b"))
    out = rows.join(tot, C).select(
        C, "cell", names.cell_base("cell").alias("family"), names.drive_strength("cell").alias("drive"), "count",
        F.round(F.col("count") / F.col("_t"), 4).alias("share"), F.array_join("_b", " ").alias("blocks"))
    if cell_pins is not None:
        lst = lambda d: F.array_join(F.array_sort(F.collect_set(F.when(F.col("direction") == d, F.col("pin")))), " ")
        lib = cell_pins.groupBy("cell").agg(lst("input").alias("inputs"), lst("output").alias("outputs"))
        out = out.join(lib, "cell", "left").withColumn("in_cell_library", F.col("inputs").isNotNull())
    if cell_attrs is not None:
        a = cell_attrs.select("cell", F.col("area").alias("area_each"), F.col("leakage").alias("leakage_each"))
        out = (out.join(a, "cell", "left").withColumn("area_total", F.round(F.col("area_each") * F.col("count"), 4))
               .withColumn("leakage_total", F.round(F.col("leakage_each") * F.col("count"), 6)))
    else:
        for c in ("area_each", "leakage_each", "area_total", "leakage_total"):
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out


def bom_rollup(bom_rows: DataFrame) -> DataFrame:
    """Cell, family and circuit totals in one pass; `level` is 0 for cells, 1 for families, 3 for circuits."""
    return (bom_rows.rollup(C, "family", "cell").agg(F.sum("count").alias("instances"), F.countDistinct("cell").alias("cell_types"),
                                                     F.sum("area_total").alias("area"), F.grouping_id().alias("level"))
            .filter(F.col(C).isNotNull()))


def drive_mix(gates: DataFrame) -> DataFrame:
    return (gates.withColumn("drive", names.drive_strength("cell")).filter("drive is not null")
            .groupBy(C, "drive").agg(F.count(F.lit(1)).alias("gates")))


def sizing(fanout: DataFrame, critical: DataFrame, top: int = 20) -> DataFrame:
    """Weak cells with a large load (longest path first) and strong cells with a light one."""
    f = fanout.withColumn("drive", names.drive_strength("cell")).join(critical.select(*GATE, "critical"), GATE, "left").na.fill(False, ["critical"])
    weak = top_k(f.filter((F.col("drive") < 1) & (F.col("fanout") >= S.HIGH_FANOUT)), [C],
                 [(~F.col("critical")), F.col("fanout").desc(), F.col("gate_id")], top)
    strong = top_k(f.filter("drive >= 2 and fanout <= 1"), [C], [F.col("drive").desc(), F.col("gate_id")], top)
    cols = [C, "rank", "gate_id", "cell", "drive", "fanout", "critical"]
    return weak.select(F.lit("weak_drive_high_fanout").alias("kind"), *cols).union(strong.select(F.lit("strong_drive_light_load"), *cols))


# ------------------------------------------------------------------ optimisation candidates
def optimizations(paths, chains, fan, cones, dups, dead, inv_pairs, blocks, sized, bom_rows) -> DataFrame:
    """Candidate rows of all rules, numbered O1, O2, ... per circuit by category and rule."""
    def row(df, cat, rule, pos, target, size, conf):
        return df.select(C, F.lit(cat).alias("category"), F.lit(rule).alias("rule"), pos.cast("long").alias("pos"),
                         target.cast("string").alias("target"), size.cast("long").alias("size"), conf.alias("confidence"))

    lit, one = F.lit, F.lit(1)
    lp = paths.filter("path = 1").groupBy(C).agg(F.max("position").alias("levels"), F.max_by("gate_id", "position").alias("end"))
    ch = top_k(chains.select(C, "head", "length").distinct().filter("length >= 4"), [C], [F.col("length").desc(), F.col("head")], 1)
    big = fan.filter(F.col("fanout") >= S.HIGH_FANOUT)
    loads = top_k(big, [C], [(~F.col("on_longest_path")), F.col("fanout").desc(), F.col("net")], 3, "_r")
    hot = top_k(fan, [C], [F.col("fanout").desc(), F.col("net")], 2, "_r").filter(F.col("fanout") >= S.HIGH_FANOUT)
    cone = top_k(cones, [C], [F.col("cone_gates").desc(), F.col("bus")], 1, "_r")
    grp = top_k(dups.select(C, "group", "family", "size").distinct(), [C], [F.col("size").desc(), F.col("group")], 3, "_r")
    top_b = top_k(blocks, [C], [F.col("gates").desc(), F.col("block")], 1, "_r").filter("share >= 0.4 and share < 1")
    buf = bom_rows.groupBy(C).agg(F.sum(F.when(F.col("family").isin("INV", "BUF", "BUFH"), F.col("count")).otherwise(0)).alias("b"),
                                  F.sum("count").alias("n")).filter("b / n >= 0.15")
    sz = sized.groupBy(C, "kind").agg(F.count(one).alias("n"), F.bool_or("critical").alias("crit"))
    rows = [
        row(lp, "performance", "longest_path", one, F.col("end"), F.col("levels"), lit("medium")),
        row(ch, "performance", "ripple_carry_chain", lit(2), F.col("head"), F.col("length"), lit("medium")),
        row(loads, "performance", "high_fanout", F.col("_r") + 2, F.col("net"), F.col("fanout"), F.when(F.col("on_longest_path"), "medium").otherwise("low")),
        row(sz.filter("kind = 'weak_drive_high_fanout'"), "performance", "weak_drive", lit(9), F.col("kind"), F.col("n"), F.when(F.col("crit"), "medium").otherwise("low")),
        row(hot, "power", "high_fanout", F.col("_r"), F.col("net"), F.col("fanout"), lit("low")),
        row(cone, "power", "largest_cone", lit(3), F.col("bus"), F.col("cone_gates"), lit("low")),
        row(grp, "area", "duplicate_gates", F.col("_r"), F.col("group"), F.col("size"), lit("high")),
        row(dead.groupBy(C).agg(F.countDistinct("gate_id").alias("n")), "area", "dead_logic", lit(4), lit("gates"), F.col("n"), lit("high")),
        row(inv_pairs.groupBy(C).agg(F.count(one).alias("n")), "area", "inverter_pairs", lit(5), lit("pairs"), F.col("n"), lit("medium")),
        row(top_b, "area", "dominant_block", lit(6), F.col("block"), F.col("gates"), lit("low")),
        row(sz.filter("kind = 'strong_drive_light_load'"), "area", "strong_drive", lit(7), F.col("kind"), F.col("n"), lit("low")),
        row(buf, "area", "inverters_and_buffers", lit(8), lit("cells"), F.col("b"), lit("low")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    cat = F.array_position(F.array(*[lit(x) for x in ("performance", "power", "area")]), F.col("category"))
    out = numbered(out.withColumn("_cat", cat), [C], [F.col("_cat"), F.col("pos"), F.col("rule")], "number")
    return out.withColumn("id", F.concat(lit("O"), F.col("number").cast("string"))).drop("_cat", "pos", "number")


# ------------------------------------------------------------------ predicted regions
def regions_report(modules: DataFrame, preds: DataFrame, gates: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per predicted module: probabilities, agreement with the names, outside neighbours and findings."""
    from wireloom.operators.graph import symmetric
    m = modules.select(*GATE, "module", "pred_class", "size")
    lab = gates.select(*GATE, F.col("label").alias("_l"))
    p = F.array_max("prob")
    base = (m.join(preds.select(*GATE, p.alias("p")), GATE).join(lab, GATE).groupBy(C, "module", "pred_class", "size")
            .agg(F.avg("p").alias("mean_probability"), F.min("p").alias("min_probability"),
                 F.count_if(F.col("p") < S.LOW_PROBABILITY).alias("below_0_6"), F.count_if(F.col("_l") == F.col("pred_class")).alias("agreeing")))
    sym = symmetric(edges)
    out = (sym.join(m.select(C, F.col("gate_id").alias("src"), F.col("module").alias("a")), [C, "src"])
           .join(m.select(C, F.col("gate_id").alias("dst"), F.col("module").alias("b")), [C, "dst"])
           .filter("a <> b").groupBy(C, F.col("a").alias("module")).agg(F.count(F.lit(1)).alias("outside_links")))
    f = members.filter("gate_id is not null").join(m.select(*GATE, "module"), GATE).select(C, "module", "check", "severity", "subject").distinct()
    hint = F.col("check").isin(*[c[0] for c in S.CHECK_CATALOG if c[1] == "gnn_suspicion"])
    fs = f.groupBy(C, "module").agg(F.count_if(hint).alias("hints"), F.count_if(~hint).alias("facts"))
    return base.join(out, [C, "module"], "left").join(fs, [C, "module"], "left").na.fill(0, ["outside_links", "hints", "facts"])


def suspicious_modules(modules: DataFrame, members: DataFrame, top: int = 5) -> DataFrame:
    """Modules with the most model-hint rows."""
    hints = [c[0] for c in S.CHECK_CATALOG if c[1] == "gnn_suspicion"]
    h = members.filter(F.col("check").isin(*hints) & F.col("gate_id").isNotNull()).select(*GATE, "check", "subject").distinct()
    n = h.join(modules.select(*GATE, "module"), GATE).groupBy(C, "module").agg(F.count(F.lit(1)).alias("hint_rows"))
    return top_k(n, [C], [F.col("hint_rows").desc(), F.col("module")], top)
