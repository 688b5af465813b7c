"""From pins to nets, edges, degrees and per-gate features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom import schema as S
from wireloom.functions import names

GATE = ["circuit_id", "gate_id"]
NET = ["circuit_id", "net"]


def resolve_direction(pins: DataFrame, cell_pins: DataFrame, output_pins=S.OUTPUT_PINS) -> DataFrame:
    """Direction of every pin: the cell library decides, unknown cells fall back to the pin name.

    `pins` carries `cell`. The library is a dimension table; Spark broadcasts it when its size allows.
    """
    lib = cell_pins.select("cell", "pin", F.col("direction").alias("_lib"))
    by_name = F.when(F.upper("pin").isin(*output_pins), "output").otherwise("input")
    return (pins.drop("direction").join(lib, ["cell", "pin"], "left")
            .withColumn("direction", F.coalesce("_lib", by_name)).drop("_lib"))


def alias_map(assigns: DataFrame) -> DataFrame:
    """Canonical name of every net that takes part in an alias or constant assign.

    The canonical net of a chain is its final right-hand side; when a net is assigned twice the later
    assign (column `ord`) decides, and a pure cycle takes its smallest name.
    """
    from wireloom.operators.graph import components
    a = assigns.filter(F.col("kind") != "expression")
    pairs = a.select("circuit_id", F.col("lhs").alias("u"), F.col("rhs").alias("v"))
    comp = components(pairs).withColumnRenamed("vertex", "net")
    targets = a.groupBy("circuit_id", F.col("rhs").alias("net")).agg(F.max("ord").alias("ord"))
    sinks = targets.join(a.select("circuit_id", F.col("lhs").alias("net")), NET, "left_anti")
    root = (comp.join(sinks, NET, "left").groupBy("circuit_id", "component")
            .agg(F.max_by(F.when(F.col("ord").isNotNull(), F.col("net")), F.coalesce("ord", F.lit(-1))).alias("_sink"),
                 F.min("net").alias("_low")))
    return (comp.join(root, ["circuit_id", "component"])
            .select("circuit_id", "net", F.coalesce("_sink", "_low").alias("canonical")))


def canonical_nets(df: DataFrame, aliases: DataFrame, column: str = "net") -> DataFrame:
    """Replace net names by their canonical ones; the old name stays in `net_raw`."""
    m = aliases.select("circuit_id", F.col("net").alias("net_raw"), "canonical")
    return (df.withColumnRenamed(column, "net_raw").join(m, ["circuit_id", "net_raw"], "left")
            .withColumn(column, F.coalesce("canonical", "net_raw")).drop("canonical"))


def net_ends(pins: DataFrame, ports: DataFrame, assigns: DataFrame | None = None) -> DataFrame:
    """One row per end of a net: gate pins, ports, constants and expression assigns."""
    none = F.lit(None)
    gate = pins.select("circuit_id", "net",
                       F.when(F.col("direction") == "output", "driver").otherwise("reader").alias("side"),
                       F.lit("gate").alias("kind"), "gate_id", "pin", none.cast("string").alias("name"))
    if "net_raw" not in ports.columns:
        ports = ports.withColumn("net_raw", F.col("net"))
    port = ports.filter(F.col("port_dir").isin("input", "output", "inout")).select(
        "circuit_id", "net", F.explode(
            F.when(F.col("port_dir") == "input", F.array(F.lit("driver")))
            .when(F.col("port_dir") == "output", F.array(F.lit("reader")))
            .otherwise(F.array(F.lit("driver"), F.lit("reader")))).alias("side"), "net_raw")
    port = port.select("circuit_id", "net", "side",
                       F.when(F.col("side") == "driver", "pi").otherwise("po").alias("kind"),
                       none.cast("int").alias("gate_id"), none.cast("string").alias("pin"),
                       F.col("net_raw").alias("name"))
    named = pins.select("circuit_id", "net").union(ports.select("circuit_id", "net"))
    if assigns is not None:
        named = named.union(assigns.filter("kind <> 'expression'").select("circuit_id", F.col("rhs").alias("net")))
    const = named.filter(names.is_constant("net")).distinct().select(
        "circuit_id", "net", F.lit("driver").alias("side"), F.lit("const").alias("kind"),
        none.cast("int").alias("gate_id"), none.cast("string").alias("pin"), F.col("net").alias("name"))
    out = gate.unionByName(port).unionByName(const)
    if assigns is not None:
        e = assigns.filter("kind = 'expression'")
        lhs = e.select("circuit_id", F.col("lhs").alias("net"), F.lit("driver").alias("side"),
                       F.lit("assign").alias("kind"), none.cast("int").alias("gate_id"),
                       none.cast("string").alias("pin"), F.col("rhs").alias("name"))
        ops = e.select("circuit_id", F.explode("operands").alias("net"), F.lit("reader").alias("side"),
                       F.lit("assign").alias("kind"), none.cast("int").alias("gate_id"),
                       none.cast("string").alias("pin"), F.col("lhs").alias("name"))
        out = out.unionByName(lhs).unionByName(ops.filter(~names.is_constant("net")))
    return out


def net_summary(ends: DataFrame) -> DataFrame:
    """Counts per net in one pass: drivers and readers by kind."""
    def n(side, kind=None):
        c = F.col("side") == side
        if kind:
            c = c & (F.col("kind") == kind)
        return F.count_if(c)
    return ends.groupBy("circuit_id", "net").agg(
        n("driver").alias("n_drivers"), n("reader").alias("n_readers"),
        n("driver", "gate").alias("gate_drivers"), n("reader", "gate").alias("gate_readers"),
        n("driver", "pi").alias("pi_drivers"), n("reader", "po").alias("po_readers"),
        n("driver", "const").alias("const_drivers"),
        F.count_if(F.col("kind") == "assign").alias("assign_ends"))


def gate_edges(pins: DataFrame) -> DataFrame:
    """Distinct (driver gate, reader gate) pairs over shared nets, without self edges.

    Both sides are reduced to distinct (net, gate) rows first. A hot net makes a skewed equi-join,
    which adaptive execution splits; the `distinct` after it combines map side.
    """
    d = pins.filter("direction = 'output'").select("circuit_id", "net", F.col("gate_id").alias("src")).distinct()
    r = pins.filter("direction = 'input'").select("circuit_id", "net", F.col("gate_id").alias("dst")).distinct()
    return d.join(r, NET).filter("src <> dst").select("circuit_id", "src", "dst").distinct()


def undirected_edges(edges: DataFrame, po_gates: DataFrame) -> DataFrame:
    """Both directions of every edge plus a self-loop on each gate that drives a primary output."""
    back = edges.select("circuit_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    loops = po_gates.select("circuit_id", F.col("gate_id").alias("src"), F.col("gate_id").alias("dst"))
    return edges.select("circuit_id", "src", "dst").union(back).union(loops).distinct()


def po_gates(pins: DataFrame, ports: DataFrame) -> DataFrame:
    """Gates that drive a primary output."""
    po = ports.filter("port_dir in ('output','inout')").select("circuit_id", "net")
    return pins.filter("direction = 'output'").join(po, NET, "left_semi").select(*GATE).distinct()


def degrees(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree, zero included."""
    i = edges.groupBy("circuit_id", F.col("dst").alias("gate_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy("circuit_id", F.col("src").alias("gate_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    return (gates.select(*GATE).join(i, GATE, "left").join(o, GATE, "left")
            .na.fill(0, ["in_degree", "out_degree"]))


def family_flags(gates: DataFrame, deg: DataFrame) -> DataFrame:
    """34 columns: a flag for every family key contained in the cell name, degrees in columns 20 and 21."""
    cell = F.upper("cell")
    keys: dict[int, list[str]] = {}
    for key, col in S.FEATURE_COLUMNS.items():
        if key not in ("in_degree", "out_degree"):
            keys.setdefault(col, []).append(key)
    cols = []
    for i in range(S.N_FEATURES):
        if i == S.FEATURE_COLUMNS["in_degree"]:
            c = F.col("in_degree").cast("double")
        elif i == S.FEATURE_COLUMNS["out_degree"]:
            c = F.col("out_degree").cast("double")
        else:
            hit = F.lit(False)
            for k in keys.get(i, []):
                hit = hit | cell.contains(k)
            c = hit.cast("double")
        cols.append(c.alias(f"f{i}"))
    return gates.join(deg, GATE).select(*GATE, *cols)


def neighbourhood_counts(gates: DataFrame, edges: DataFrame, pins: DataFrame, ports: DataFrame) -> DataFrame:
    """Family counts over a gate, its one-hop and its two-hop neighbours, per direction.

    Long form (circuit_id, gate_id, family, n). Two-hop counts add the already aggregated one-hop
    counts of the neighbours, so no two-hop pair is ever written out.
    """
    fam = gates.select(*GATE, names.cell_family("cell").alias("family"))
    fams = [k for k in S.FEATURE_COLUMNS if k not in ("PI", "PO", "KEY", "in_degree", "out_degree")]
    known = fam.filter(F.col("family").isin(*fams))

    def hop(a, b):
        """one-hop counts of the gates at end `a` over the families at end `b`, and their sums one hop on"""
        near = known.withColumnRenamed("gate_id", b)
        one = (edges.join(near, ["circuit_id", b]).groupBy("circuit_id", a, "family")
               .agg(F.count(F.lit(1)).alias("n")))
        two = (edges.join(one.withColumnRenamed(a, b), ["circuit_id", b])
               .groupBy("circuit_id", a, "family").agg(F.sum("n").alias("n")))
        return one.union(two).withColumnRenamed(a, "gate_id")

    own = known.withColumn("n", F.lit(1).cast("long"))
    pi = ports.filter("port_dir in ('input','inout')").select("circuit_id", "net").distinct()
    po = ports.filter("port_dir in ('output','inout')").select("circuit_id", "net").distinct()
    pi_pins = pins.filter("direction = 'input'").join(pi, NET, "left_semi").select(*GATE)
    po_pins = pins.filter("direction = 'output'").join(po, NET, "left_semi").select(*GATE)
    flags = (pi_pins.distinct().withColumn("family", F.lit("PI"))
             .union(po_pins.distinct().withColumn("family", F.lit("PO"))).withColumn("n", F.lit(1).cast("long")))
    fan_in = (edges.select("circuit_id", F.col("dst").alias("gate_id")).union(pi_pins)
              .groupBy(*GATE).agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit("in_degree")))
    fan_out = (edges.groupBy("circuit_id", F.col("src").alias("gate_id")).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("family", F.lit("out_degree")))
    cols = [*GATE, "family", "n"]
    parts = [own, hop("dst", "src"), hop("src", "dst"), flags, fan_in, fan_out]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.union(p.select(*cols))
    return out.groupBy(*GATE, "family").agg(F.sum("n").alias("n"))


def feature_vectors(counts: DataFrame) -> DataFrame:
    """Long family counts to one 34-element array per gate."""
    pairs = [x for k, v in S.FEATURE_COLUMNS.items() for x in (F.lit(k), F.lit(v))]
    idx = F.create_map(*pairs)[F.col("family")]
    sums = [F.coalesce(F.sum(F.when(idx == i, F.col("n"))), F.lit(0)).cast("double") for i in range(S.N_FEATURES)]
    return counts.groupBy(*GATE).agg(*[s.alias(f"f{i}") for i, s in enumerate(sums)]).select(
        *GATE, F.array(*[f"f{i}" for i in range(S.N_FEATURES)]).alias("features"))


def name_labels(gates: DataFrame, include_cell: bool = False) -> DataFrame:
    """Class id from the instance name; `include_cell` also looks at the cell name."""
    text = F.concat_ws(" ", "inst", "cell") if include_cell else F.col("inst")
    return gates.withColumn("name_label", names.name_label(text))


def with_hierarchy(gates: DataFrame) -> DataFrame:
    g = gates.withColumn("hier_prefix", names.hier_prefix(F.col("inst")))
    return g.withColumn("block", names.block_of("hier_prefix"))


def missing_pins(gates: DataFrame, pins: DataFrame, cell_pins: DataFrame,
                 empty_pins: DataFrame | None = None) -> DataFrame:
    """Pins of the library cell, or pins left empty in the text, that no net is connected to."""
    want = gates.select(*GATE, "cell").join(cell_pins, "cell").select(
        *GATE, "cell", "pin", F.col("direction").alias("_lib"), F.lit(False).alias("explicit_empty"))
    if empty_pins is not None:
        e = (empty_pins.select(*GATE, "pin").distinct().join(gates.select(*GATE, "cell"), GATE)
             .select(*GATE, "cell", "pin", F.lit(None).cast("string").alias("_lib"),
                     F.lit(True).alias("explicit_empty")))
        want = want.union(e).groupBy(*GATE, "cell", "pin").agg(
            F.max("_lib").alias("_lib"), F.bool_or("explicit_empty").alias("explicit_empty"))
    by_name = F.when(F.upper("pin").isin(*S.OUTPUT_PINS), "output").otherwise("input")
    return (want.join(pins.select(*GATE, "pin"), [*GATE, "pin"], "left_anti")
            .select(*GATE, "cell", "pin", F.coalesce("_lib", by_name).alias("direction"), "explicit_empty"))


def unknown_cells(gates: DataFrame, cell_pins: DataFrame) -> DataFrame:
    """Cells outside the library with their instance counts."""
    return (gates.join(cell_pins.select("cell").distinct(), "cell", "left_anti")
            .groupBy("circuit_id", "cell").agg(F.count(F.lit(1)).alias("instances")))


def decode_cells(gates: DataFrame) -> DataFrame:
    return gates.withColumn("family", names.cell_base("cell")).withColumn("drive", names.drive_strength("cell"))
