"""Registered queries: graph construction."""

from pyspark.sql import functions as F

from wireloom.functions import names
from wireloom.operators import model
from wireloom.plans import bindings as B
from wireloom.plans.registry import query
from wireloom.sources import datasets


@query("pin_direction", """SELECT p.circuit_id, gate_id, pin, net,
    coalesce(l.direction, CASE WHEN pin IN ('CO','Q','QN','S','Y','Z','ZN') THEN 'output' ELSE 'input' END) AS direction
    FROM pins p JOIN gates g USING (circuit_id, gate_id)
    LEFT JOIN cell_pins l USING (cell, pin)""")
def _(spark, d):
    t = B.tables(spark, d)
    pins = t.pins.join(t.gates.select("circuit_id", "gate_id", "cell"), ["circuit_id", "gate_id"])
    return model.resolve_direction(pins, t.cell_pins).select("circuit_id", "gate_id", "pin", "net", "direction")


@query("net_ends", """SELECT circuit_id, net, side, kind, coalesce(gate_id, -1) AS gate_id, coalesce(pin, '') AS pin,
    coalesce(name, '') AS name FROM net_ends""")
def _(spark, d):
    return B.tables(spark, d).net_ends.na.fill({"gate_id": -1, "pin": "", "name": ""})


@query("net_table", "SELECT * FROM nets")
def _(spark, d):
    return B.tables(spark, d).nets


@query("gate_edges", "SELECT * FROM edges")
def _(spark, d):
    return model.gate_edges(B.bound_pins(spark, d))


@query("undirected_edges", "SELECT * FROM uedges")
def _(spark, d):
    t = B.tables(spark, d)
    return model.undirected_edges(model.gate_edges(t.pins), model.po_gates(t.pins, t.ports))


@query("degrees", "SELECT * FROM deg")
def _(spark, d):
    t = B.tables(spark, d)
    return model.degrees(t.gates, t.edges)


_FLAG_SQL = ", ".join(
    "in_degree::DOUBLE AS f20" if i == 20 else "out_degree::DOUBLE AS f21" if i == 21 else
    "(" + (" OR ".join(f"contains(upper(cell), '{k}')" for k, v in B_KEYS.items() if v == i) or "false")
    + f")::INT::DOUBLE AS f{i}"
    for B_KEYS in [{k: v for k, v in __import__("wireloom.schema", fromlist=["x"]).FEATURE_COLUMNS.items()
                    if k not in ("in_degree", "out_degree")}] for i in range(34))


@query("family_flags", f"SELECT circuit_id, gate_id, {_FLAG_SQL} FROM gates JOIN deg USING (circuit_id, gate_id)")
def _(spark, d):
    t = B.tables(spark, d)
    return model.family_flags(t.gates, model.degrees(t.gates, t.edges))


@query("neighbourhood_counts", """
    SELECT circuit_id, gate_id, family, sum(n)::BIGINT AS n FROM (
      SELECT circuit_id, gate_id, family, 1 AS n FROM fam
      UNION ALL SELECT e.circuit_id, e.dst, f.family, 1 FROM edges e JOIN fam f ON f.circuit_id = e.circuit_id AND f.gate_id = e.src
      UNION ALL SELECT e.circuit_id, e.src, f.family, 1 FROM edges e JOIN fam f ON f.circuit_id = e.circuit_id AND f.gate_id = e.dst
      UNION ALL SELECT e.circuit_id, e.dst, f.family, 1 FROM edges e JOIN edges e2 ON e2.circuit_id = e.circuit_id AND e2.dst = e.src
        JOIN fam f ON f.circuit_id = e.circuit_id AND f.gate_id = e2.src
      UNION ALL SELECT e.circuit_id, e.src, f.family, 1 FROM edges e JOIN edges e2 ON e2.circuit_id = e.circuit_id AND e2.src = e.dst
        JOIN fam f ON f.circuit_id = e.circuit_id AND f.gate_id = e2.dst
      UNION ALL SELECT DISTINCT circuit_id, gate_id, 'PI', 1 FROM pins JOIN ports USING (circuit_id, net) WHERE direction = 'input' AND port_dir = 'input'
      UNION ALL SELECT circuit_id, gate_id, 'PO', 1 FROM po_gates
      UNION ALL SELECT circuit_id, gate_id, 'in_degree', 1 FROM pins JOIN ports USING (circuit_id, net) WHERE direction = 'input' AND port_dir = 'input'
      UNION ALL SELECT circuit_id, dst, 'in_degree', 1 FROM edges
      UNION ALL SELECT circuit_id, src, 'out_degree', 1 FROM edges) GROUP BY 1, 2, 3""",
       fam="SELECT circuit_id, gate_id, CASE WHEN cell LIKE 'NAND%' THEN 'NAND' WHEN cell LIKE 'XOR%' THEN 'XOR' WHEN cell LIKE 'MXT%' THEN 'MXT' WHEN cell LIKE 'MX%' THEN 'MX' ELSE family END AS family FROM gates WHERE regexp_matches(cell, '^(INV|ADDF|NAND|XOR|MX)')")
def _(spark, d):
    t = B.tables(spark, d)
    return model.neighbourhood_counts(t.gates, t.edges, t.pins, t.ports)


@query("name_labels", """SELECT circuit_id, gate_id,
    CASE WHEN inst LIKE '%add%' THEN 0 WHEN inst LIKE '%mult%' THEN 1 WHEN inst LIKE '%sub%' THEN 3
    WHEN inst LIKE '%comparator%' THEN 4 ELSE 2 END AS name_label,
    CASE WHEN lower(inst || ' ' || cell) LIKE '%add%' THEN 0 WHEN inst LIKE '%mult%' THEN 1 WHEN inst LIKE '%sub%' THEN 3
    WHEN inst LIKE '%comparator%' THEN 4 ELSE 2 END AS cell_label FROM gates""")
def _(spark, d):
    g = B.bound_gates(spark, d)
    return (model.name_labels(g).withColumn("cell_label", names.name_label(F.concat_ws(" ", "inst", "cell")))
            .select("circuit_id", "gate_id", "name_label", "cell_label"))


@query("hierarchy", "SELECT circuit_id, gate_id, inst, hier_prefix, block FROM gates")
def _(spark, d):
    g = B.bound_gates(spark, d).select("circuit_id", "gate_id", "inst")
    return model.with_hierarchy(g)


@query("missing_pins", """SELECT circuit_id, gate_id, g.cell, l.pin, l.direction, false AS explicit_empty
    FROM gates g JOIN cell_pins l USING (cell)
    WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.circuit_id = g.circuit_id AND p.gate_id = g.gate_id AND p.pin = l.pin)""")
def _(spark, d):
    t = B.tables(spark, d)
    return model.missing_pins(t.gates, t.pins, t.cell_pins)


@query("unknown_cells", """SELECT circuit_id, cell, count(*) AS instances FROM gates
    WHERE cell NOT IN (SELECT cell FROM cell_pins) GROUP BY 1, 2""")
def _(spark, d):
    t = B.tables(spark, d)
    return model.unknown_cells(t.gates, t.cell_pins)


@query("decode_cells", "SELECT circuit_id, gate_id, cell, family, drive FROM gates")
def _(spark, d):
    return model.decode_cells(B.bound_gates(spark, d)).select("circuit_id", "gate_id", "cell", "family", "drive")


@query("cell_library", """SELECT cell, pin, CASE WHEN pin IN ('CO','Y') THEN 'output' ELSE 'input' END AS direction,
    instances, varies FROM (SELECT DISTINCT cell, pin FROM pins JOIN gates USING (circuit_id, gate_id))
    JOIN (SELECT cell, count(*) AS instances, count(DISTINCT s) > 1 AS varies FROM (
        SELECT cell, circuit_id, gate_id, string_agg(DISTINCT pin, ',' ORDER BY pin) AS s
        FROM pins JOIN gates USING (circuit_id, gate_id) GROUP BY 1, 2, 3) GROUP BY 1) USING (cell)""")
def _(spark, d):
    t = B.tables(spark, d)
    return datasets.derive_cell_library(t.pins.join(t.gates.select("circuit_id", "gate_id", "cell"),
                                                    ["circuit_id", "gate_id"]))


@query("canonical_nets", """WITH RECURSIVE alias AS (SELECT DISTINCT circuit_id, 'n' || k AS lhs, 'n' || (k - 1) AS rhs
      FROM (SELECT circuit_id, significance, CAST(substr(net, 2) AS INT) AS k FROM bus_bits) WHERE significance >= 8),
    root AS (SELECT circuit_id, lhs AS net, rhs AS canonical FROM alias UNION
      SELECT r.circuit_id, r.net, a.rhs FROM root r JOIN alias a ON a.circuit_id = r.circuit_id AND a.lhs = r.canonical)
    SELECT p.circuit_id, p.gate_id, p.pin, p.net AS net_raw, coalesce(r.canonical, p.net) AS net FROM pins p
    LEFT JOIN (SELECT circuit_id, net, min_by(canonical, CAST(substr(canonical, 2) AS INT)) AS canonical FROM root GROUP BY 1, 2) r
    ON r.circuit_id = p.circuit_id AND r.net = p.net""")
def _(spark, d):
    """The two top bits of every bus are aliases of the bit below them: chains of two assigns."""
    t = B.tables(spark, d)
    k = F.substring("net", 2, 9).cast("int")
    assigns = t.bus_bits.filter("significance >= 8").select(
        "circuit_id", F.col("net").alias("lhs"), F.concat(F.lit("n"), (k - 1).cast("string")).alias("rhs"),
        F.lit("alias").alias("kind"), k.alias("ord"))
    out = model.canonical_nets(t.pins, model.alias_map(assigns))
    return out.select("circuit_id", "gate_id", "pin", "net_raw", "net")
