"""Registered queries: bus analysis, design insights and lookups."""

from pyspark.sql import functions as F

from wireloom.operators import buses, checks, graph, insights, lookups, model
from wireloom.operators.scale import materialise
from wireloom.plans import arith as A
from wireloom.plans import bindings as B
from wireloom.plans.q_checks import CHECK_SQL
from wireloom.plans.q_features import rnd
from wireloom.plans.q_graph import CHAIN_SQL, CONE_SQL, LEVEL_SQL, PATH_SQL, SUBC, SUPPORT_SQL, bound_levels, bus_cones, input_sets
from wireloom.plans.registry import query

C = "circuit_id"
KEYS = [C, "gate_id"]

# ------------------------------------------------------------------ buses
BUS_SQL = {
    "driven": """SELECT * FROM bus_bits b WHERE EXISTS (SELECT 1 FROM pins p WHERE p.circuit_id = b.circuit_id AND p.net = b.net AND p.direction = 'output')""",
    "bitgate": "SELECT t.circuit_id, t.bus, t.significance, p.gate_id FROM bus_bits t JOIN pins p USING (circuit_id, net) WHERE t.kind <> 'input' AND p.direction = 'output'",
    "gatebit": "SELECT s.circuit_id, s.gate_id, o.bus AS operand, o.significance AS osig FROM support s JOIN bus_bits o ON o.circuit_id = s.circuit_id AND o.net = s.source",
    "prof": "SELECT DISTINCT circuit_id, bus, significance, operand, osig FROM bitgate JOIN gatebit USING (circuit_id, gate_id) WHERE operand <> bus",
    "live": "SELECT b.* FROM bus_bits b JOIN nets n USING (circuit_id, net) WHERE n_drivers > 0",
    "osz": "SELECT circuit_id, bus AS operand, count(*) AS w, max(significance) AS top FROM live GROUP BY 1, 2",
    "bits": """SELECT p.circuit_id, p.bus, p.operand, p.significance, any_value(w) AS w, any_value(top) AS top, count(*) AS n, max(p.osig) AS hi, min(p.osig) AS lo,
        count(l.significance) AS n_live, count(*) FILTER (l.significance <= p.significance) AS n_low,
        any_value((SELECT count(*) FROM live x WHERE x.circuit_id = p.circuit_id AND x.bus = p.operand AND x.significance <= p.significance)) AS n_exp,
        any_value((SELECT max(significance) FROM live x WHERE x.circuit_id = p.circuit_id AND x.bus = p.operand AND x.significance <= p.significance)) AS hi_exp
        FROM prof p JOIN osz USING (circuit_id, operand) LEFT JOIN live l ON l.circuit_id = p.circuit_id AND l.bus = p.operand AND l.significance = p.osig GROUP BY 1, 2, 3, 4""",
    "pattern": """SELECT circuit_id, bus, operand, w AS operand_width, n AS bits, exact_bits, CASE WHEN w < 4 THEN 'too_small' WHEN n < 4 THEN CASE WHEN f THEN 'full' ELSE 'too_small' END
        WHEN bw AND upper >= 2 THEN 'bitwise' WHEN shaped >= 0.6 * n AND shaped_low >= 2 THEN 'triangular' WHEN f THEN 'full' ELSE 'partial' END AS pattern FROM (
        SELECT circuit_id, bus, operand, any_value(w) AS w, count(*) AS n, count(*) FILTER (n = n_exp AND n_low = n) AS exact_bits,
          count(*) FILTER (n_exp > 0 AND n_low = n AND hi = hi_exp) AS shaped, count(*) FILTER (n_exp > 0 AND n_low = n AND hi = hi_exp AND significance < top) AS shaped_low,
          bool_and(n_live = w) AS f, bool_and(lo >= significance - 1 AND hi <= significance) AS bw, count(*) FILTER (significance >= 2) AS upper FROM bits GROUP BY 1, 2, 3)""",
    **SUPPORT_SQL,
}


def bus_inputs(t):
    sup = input_sets(t)
    targets, src = t.bus_bits.filter("kind <> 'input'"), t.bus_bits.filter("kind = 'input'")
    return buses.dependency_profile(t.pins, targets, src, sup)


@query("dependency_profile", "SELECT * FROM prof", **BUS_SQL)
def _(spark, d):
    return bus_inputs(B.tables(spark, d))


@query("live_bits", "SELECT circuit_id, bus, significance FROM live", **BUS_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return buses.live_bits(t.bus_bits, t.nets).select(C, "bus", "significance")


@query("pattern_class", "SELECT * FROM pattern", **BUS_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return buses.pattern_class(bus_inputs(t), buses.live_bits(t.bus_bits, t.nets))


RIPPLE_SQL = {
    # the same ten operand bits for every input bus that has ten declared bits; others by their own count
    "decl": "SELECT circuit_id, bus AS operand, significance AS osig FROM bus_bits WHERE kind = 'input'",
    "rbits": """SELECT p.circuit_id, p.bus, p.operand, p.significance, count(*) AS n, max(p.osig) AS hi, count(*) FILTER (p.osig <= p.significance) AS n_low,
        any_value(w) AS w, any_value((SELECT count(*) FROM decl x WHERE x.circuit_id = p.circuit_id AND x.operand = p.operand AND x.osig <= p.significance)) AS n_exp
        FROM prof p JOIN (SELECT circuit_id, operand, count(*) AS w FROM decl GROUP BY 1, 2) USING (circuit_id, operand) GROUP BY 1, 2, 3, 4""",
    "ripple": """SELECT circuit_id, bus, operand, any_value(w) AS width, count(*) AS bits_with_dependency, count(*) FILTER (n_low = n_exp AND n = n_exp) AS bits_matching,
        count(*) FILTER (n_low = n AND hi = least(significance, w - 1)) AS shaped, count(*) FILTER (n_low = n AND hi = least(significance, w - 1) AND significance < w - 1) AS nontrivial,
        max(significance) AS top_bit FROM rbits JOIN (SELECT circuit_id, bus FROM driven GROUP BY 1, 2 HAVING count(*) >= 4) USING (circuit_id, bus) WHERE w >= 4 GROUP BY 1, 2, 3
        HAVING count(*) >= 4 AND count(*) FILTER (n_low = n AND hi = least(significance, w - 1)) >= 0.6 * count(*)
        AND count(*) FILTER (n_low = n AND hi = least(significance, w - 1) AND significance < w - 1) >= 2""",
    "diff": """SELECT *, 'missing' AS d FROM (SELECT circuit_id, bus, operand, significance, unnest(range(0, least(significance, width - 1) + 1)) AS osig FROM driven
          JOIN ripple USING (circuit_id, bus) WHERE significance <= top_bit EXCEPT SELECT circuit_id, bus, operand, significance, osig FROM prof)
        UNION ALL SELECT s.circuit_id, s.bus, s.operand, s.significance, s.osig, 'extra' FROM prof s JOIN ripple USING (circuit_id, bus, operand)
          WHERE s.significance <= top_bit AND s.osig > least(s.significance, width - 1)""",
    "runs": """SELECT r.circuit_id, r.bus, r.operand, first_bit, last_bit, count(*) FILTER (d = 'missing') AS missing, count(*) FILTER (d = 'extra') AS extra,
        max(osig) FILTER (d = 'missing') AS max_missing, max(osig) FILTER (d = 'extra') AS max_extra FROM (
          SELECT circuit_id, bus, operand, min(significance) AS first_bit, max(significance) AS last_bit FROM (
            SELECT *, significance - row_number() OVER (PARTITION BY circuit_id, bus, operand ORDER BY significance) AS i FROM (
              SELECT DISTINCT circuit_id, bus, operand, significance FROM diff)) GROUP BY circuit_id, bus, operand, i) r
        JOIN diff x ON x.circuit_id = r.circuit_id AND x.bus = r.bus AND x.operand = r.operand AND x.significance = r.first_bit GROUP BY 1, 2, 3, 4, 5""",
}
RIPPLE_SQL = {**A.CTES, **BUS_SQL, **RIPPLE_SQL}


def _ripple(spark, d):
    t = A.tables(spark, d)
    p = buses.input_profile(t)
    driven = buses.driven_bits(t.bus_bits, t.pins)
    r = materialise(buses.ripple_pattern(p, t.bus_bits, driven), "ripple")
    return t, r, buses.deviant_runs(p, r, driven)


@query("ripple_pattern", "SELECT * FROM ripple", **RIPPLE_SQL)
def _(spark, d):
    return _ripple(spark, d)[1]


@query("deviant_runs", """SELECT circuit_id, bus, operand, first_bit, last_bit, missing, extra, coalesce(max_missing, -1) AS max_missing, coalesce(max_extra, -1) AS max_extra FROM runs""", **RIPPLE_SQL)
def _(spark, d):
    return _ripple(spark, d)[2].na.fill(-1, ["max_missing", "max_extra"])


@query("bus_run_findings", """SELECT circuit_id, bus, first_bit, last_bit, count(*) AS operands, CASE WHEN bool_and(missing > 0 AND extra = 0 AND max_missing < first_bit)
    THEN 'carry_break' ELSE 'bit_slice_anomaly' END AS "check", CASE WHEN bool_and(missing > 0 AND extra = 0 AND max_missing < first_bit) THEN 0.9 ELSE 0.8 END::DOUBLE AS confidence
    FROM runs GROUP BY 1, 2, 3, 4""", **RIPPLE_SQL)
def _(spark, d):
    return buses.classify_runs(_ripple(spark, d)[2])


#: What a bus depends on when walks end at internal buses: these are the buses that feed it.
FEED_SQL = {
    "isrc": "SELECT DISTINCT circuit_id, net FROM bus_bits WHERE kind <> 'input'",
    "fedge": """SELECT DISTINCT d.circuit_id, d.gate_id AS src, r.gate_id AS dst FROM pins d JOIN pins r ON d.circuit_id = r.circuit_id AND d.net = r.net
        WHERE d.direction = 'output' AND r.direction = 'input' AND d.gate_id <> r.gate_id AND NOT EXISTS (SELECT 1 FROM isrc s WHERE s.circuit_id = d.circuit_id AND s.net = d.net)""",
    "fsup": """SELECT * FROM (WITH RECURSIVE s AS (SELECT DISTINCT p.circuit_id, p.net AS source, p.gate_id FROM pins p JOIN isrc USING (circuit_id, net) WHERE direction = 'input'
        UNION SELECT s.circuit_id, s.source, e.dst FROM s JOIN fedge e ON e.circuit_id = s.circuit_id AND e.src = s.gate_id) SELECT * FROM s)""",
    "fgatebit": "SELECT s.circuit_id, s.gate_id, o.bus AS operand, o.significance AS osig FROM fsup s JOIN bus_bits o ON o.circuit_id = s.circuit_id AND o.net = s.source",
    "fprof": "SELECT DISTINCT circuit_id, bus, significance, operand, osig FROM bitgate JOIN fgatebit USING (circuit_id, gate_id) WHERE operand <> bus",
    "fbits": BUS_SQL["bits"].replace("FROM prof p", "FROM fprof p"), "feed": BUS_SQL["pattern"].replace("FROM bits", "FROM fbits")}
SIG_SQL = {
    "invread": """SELECT DISTINCT p.circuit_id, p.gate_id, o.bus AS operand, p.net FROM pins p JOIN gates g USING (circuit_id, gate_id) JOIN bus_bits o ON o.circuit_id = p.circuit_id AND o.net = p.net
        WHERE g.family = 'INV' AND p.direction = 'input' AND o.kind = 'input'""",
    "inv": """SELECT c.circuit_id, c.root AS bus, operand, round(count(DISTINCT net) / any_value(w), 2) AS inverted FROM cone c JOIN invread r USING (circuit_id, gate_id)
        JOIN (SELECT circuit_id, bus AS operand, count(*) AS w FROM bus_bits GROUP BY 1, 2) z USING (circuit_id, operand) GROUP BY 1, 2, 3""",
    "feeds": """SELECT circuit_id, bus, count(*) FILTER (pattern = 'bitwise') AS bf, count(*) FILTER (pattern = 'triangular') AS tf, max(operand_width) FILTER (pattern = 'triangular') AS fw FROM feed GROUP BY 1, 2""",
    "ops": """SELECT circuit_id, bus, any_value(dw) AS dw, count(*) FILTER (pattern = 'triangular') AS tri, count(*) FILTER (pattern = 'full') AS fu, max(operand_width) FILTER (pattern = 'triangular') AS tw,
        max(bits) FILTER (pattern = 'triangular') AS tb, max(inverted) FILTER (pattern = 'triangular' AND k = 1) AS i1, max(inverted) FILTER (pattern = 'triangular' AND k = 2) AS i2 FROM (
          SELECT circuit_id, bus, dw, pattern, operand_width, bits, coalesce(inverted, 0) AS inverted, row_number() OVER (PARTITION BY circuit_id, bus, pattern ORDER BY coalesce(inverted, 0) DESC, operand) AS k
          FROM (SELECT circuit_id, bus, count(*) AS dw FROM driven WHERE kind <> 'input' GROUP BY 1, 2) LEFT JOIN pattern USING (circuit_id, bus) LEFT JOIN inv USING (circuit_id, bus, operand)) GROUP BY 1, 2""",
    "signature": """SELECT circuit_id, bus, dw AS width, coalesce(bf, 0) AS bitwise_feeds, coalesce(tf, 0) AS tri_feeds, tri, fu AS "full",
        CASE WHEN bf >= 2 THEN 'select-like' WHEN tf >= 2 THEN CASE WHEN dw >= 1.75 * fw THEN 'multiplier-like' ELSE 'adder-like' END
          WHEN tri >= 1 THEN CASE WHEN tb >= 1.75 * tw THEN 'multiplier-like' WHEN i1 >= 0.5 AND i2 <= 0.25 THEN 'subtractor-like' ELSE 'adder-like' END
          WHEN fu >= 2 AND dw <= 2 THEN 'comparator-like' ELSE 'unclassified' END AS classification,
        coalesce(CASE WHEN tf >= 2 THEN fw END, tw, dw) AS operand_width FROM ops LEFT JOIN feeds USING (circuit_id, bus)""",
    "opbus": """SELECT DISTINCT s.circuit_id, s.bus, p.operand FROM signature s JOIN pattern p USING (circuit_id, bus) WHERE classification = 'unclassified'
          OR (classification = 'comparator-like' AND pattern = 'full') OR (classification NOT IN ('comparator-like', 'select-like', 'unclassified') AND tri_feeds < 2 AND pattern = 'triangular')
        UNION SELECT s.circuit_id, s.bus, p.operand FROM signature s JOIN feed p USING (circuit_id, bus) WHERE (classification = 'select-like' AND pattern = 'bitwise')
          OR (classification NOT IN ('select-like', 'comparator-like', 'unclassified') AND tri_feeds >= 2 AND pattern = 'triangular')""",
    **A.CTES, **BUS_SQL, **CONE_SQL, **FEED_SQL}


def bound_signatures(t):
    """Signatures of the arithmetic circuits, and the operand patterns behind them."""
    live = materialise(buses.live_bits(t.bus_bits, t.nets), "live")
    ops = materialise(buses.pattern_class(buses.input_profile(t), live), "patterns")
    feeds = materialise(buses.pattern_class(buses.feed_profile(t), live), "feeds")
    inv = buses.inverted_share(t.bus_bits, t.pins, t.gates, bus_cones(t))
    driven = buses.driven_bits(t.bus_bits.filter("kind <> 'input'"), t.pins)
    return materialise(buses.cone_signatures(driven, ops, feeds, inv), "signatures"), ops, feeds


@query("cone_signatures", "SELECT * FROM signature", **SIG_SQL)
def _(spark, d):
    return bound_signatures(A.tables(spark, d))[0]


BLOCKS_SQL = {"iblock": """SELECT circuit_id, bus, CASE classification WHEN 'adder-like' THEN 'adder' WHEN 'multiplier-like' THEN 'multiplier' WHEN 'subtractor-like' THEN 'subtractor' WHEN 'select-like' THEN 'control'
    ELSE 'comparator' END AS role, operand_width, b.block, round(0.55::DOUBLE * CASE WHEN hints THEN 1 ELSE 0.6 END, 2) AS confidence FROM signature JOIN (
      SELECT o.circuit_id, o.bus, min(g.block) AS block FROM bus_bits o JOIN pins p USING (circuit_id, net) JOIN gates g USING (circuit_id, gate_id) WHERE direction = 'output' GROUP BY 1, 2) b
    USING (circuit_id, bus) JOIN (SELECT circuit_id, bool_or(regexp_matches(lower(inst), 'add|mul|sub|comp|control')) AS hints FROM gates GROUP BY 1) USING (circuit_id) WHERE classification <> 'unclassified'""", **SIG_SQL}


def bound_blocks(t):
    s, ops, feeds = bound_signatures(t)
    drv = (t.bus_bits.join(t.pins.filter("direction = 'output'"), [C, "net"]).join(t.gates.select(*KEYS, "block"), KEYS).select(C, "bus", "block").distinct())
    hints = t.gates.groupBy(C).agg(F.bool_or(F.lower("inst").rlike("add|mul|sub|comp|control")).alias("hints"))
    operands = materialise(buses.operand_buses(s, ops, feeds), "operands")
    return materialise(buses.infer_blocks(s, operands, drv, hints), "blocks"), operands


@query("inferred_blocks", "SELECT * FROM iblock", **BLOCKS_SQL)
def _(spark, d):
    return bound_blocks(A.tables(spark, d))[0].drop("phrase")


@query("inferred_dataflow", """SELECT DISTINCT o.circuit_id, f.block AS from_block, t.block AS to_block, o.operand AS via_bus FROM opbus o JOIN iblock f ON f.circuit_id = o.circuit_id AND f.bus = o.operand
    JOIN iblock t ON t.circuit_id = o.circuit_id AND t.bus = o.bus WHERE f.block <> t.block""", **BLOCKS_SQL)
def _(spark, d):
    """Selectors lie in blocks of their own, so they are fed from the adders' blocks."""
    blocks, operands = bound_blocks(A.tables(spark, d))
    return buses.inferred_dataflow(blocks, operands)


TPL_SQL = {
    "tpl": """SELECT DISTINCT o.circuit_id, t.template, o.bus, i.bus AS operand FROM bus_bits o JOIN bus_bits i ON i.circuit_id = o.circuit_id,
        (SELECT unnest(['adder_triangular', 'comparator_all_bits']) AS template) t WHERE o.kind = 'output' AND i.kind = 'input'""",
    "bad": """SELECT t.circuit_id, t.template, t.bus, t.operand, d.significance FROM tpl t JOIN driven d USING (circuit_id, bus)
        WHERE EXISTS (SELECT 1 FROM live l WHERE l.circuit_id = t.circuit_id AND l.bus = t.operand AND (t.template = 'comparator_all_bits' OR l.significance <= d.significance)
            AND NOT EXISTS (SELECT 1 FROM prof p WHERE p.circuit_id = t.circuit_id AND p.bus = t.bus AND p.operand = t.operand AND p.significance = d.significance AND p.osig = l.significance))
          OR (t.template <> 'comparator_all_bits' AND EXISTS (SELECT 1 FROM prof p WHERE p.circuit_id = t.circuit_id AND p.bus = t.bus AND p.operand = t.operand
            AND p.significance = d.significance AND (p.osig > d.significance OR NOT EXISTS (SELECT 1 FROM live l WHERE l.circuit_id = p.circuit_id AND l.bus = p.operand AND l.significance = p.osig))))"""}


@query("check_templates", """SELECT circuit_id, template, bus, operand, count(significance) AS bad_bits, CASE WHEN count(significance) > 0 THEN 'fail' ELSE 'pass' END AS status
    FROM tpl LEFT JOIN (SELECT DISTINCT * FROM bad) USING (circuit_id, template, bus, operand) GROUP BY 1, 2, 3, 4""", **TPL_SQL, **BUS_SQL)
def _(spark, d):
    """Every output bus is tested as an adder and as a comparator of every input bus."""
    t = B.tables(spark, d)
    o = t.bus_bits.filter("kind = 'output'").select(C, "bus").distinct()
    i = t.bus_bits.filter("kind = 'input'").select(C, F.col("bus").alias("operand")).distinct()
    tpl = o.join(i, C).select(C, F.explode(F.array(F.lit("adder_triangular"), F.lit("comparator_all_bits"))).alias("template"), "bus", "operand")
    return buses.check_templates(tpl, bus_inputs(t), buses.driven_bits(t.bus_bits, t.pins), buses.live_bits(t.bus_bits, t.nets))


_ELEC = {k: v for k, v in CHECK_SQL.items() if k in ("m_missing_pin", "m_floating_net", "m_multi_driver", "m_dangling_output", "m_const_input", "m_undriven_po", "m_unused_pi", "m_unknown_cell")}
ELEC_SQL = {**_ELEC, "emembers": " UNION ALL ".join(f"SELECT * FROM {k}" for k in _ELEC)}


def elec_members(t):
    return materialise(checks.run_checks(t, checks.ELECTRICAL), "members")


@query("check_carry_templates", """SELECT circuit_id, b.block, coalesce(n, 0) AS adder_cells, coalesce(r, 0) AS related,
    CASE WHEN n IS NULL THEN 'not_checkable' WHEN r > 0 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT DISTINCT circuit_id, block FROM gates) b
    LEFT JOIN (SELECT circuit_id, block, count(*) AS n FROM gates WHERE family = 'ADDF' GROUP BY 1, 2) USING (circuit_id, block)
    LEFT JOIN (SELECT circuit_id, block, count(DISTINCT m."check" || '|' || subject) AS r FROM gates g JOIN emembers m USING (circuit_id, gate_id) WHERE family = 'ADDF'
      AND m."check" IN ('missing_pin','floating_net','carry_out_unread','dangling_output','multi_driver') GROUP BY 1, 2) USING (circuit_id, block)""", **ELEC_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return buses.check_carry_templates(t.gates.select(C, "block").distinct(), t.gates, elec_members(t))


@query("evidence_profile", """SELECT circuit_id, rank, family, n, round(arith / total, 3) AS arithmetic_share FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY n DESC, family) AS rank,
    sum(n) OVER w AS total, sum(CASE WHEN family IN ('ADDF', 'XOR2') THEN n ELSE 0 END) OVER w AS arith FROM (SELECT circuit_id, family, count(*) AS n FROM gates GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY circuit_id)) WHERE rank <= 15""")
def _(spark, d):
    return buses.evidence_profile(B.bound_gates(spark, d))


# ------------------------------------------------------------------ insights
@query("ports_summary", "SELECT circuit_id, bus AS name, kind AS port_dir, count(*) AS width FROM bus_bits WHERE kind <> 'wire' GROUP BY 1, 2, 3")
def _(spark, d):
    return insights.ports_summary(B.tables(spark, d))


@query("control_signals", """SELECT circuit_id, net, n_readers AS fanout, select_pins, pi_drivers > 0 AS primary_input, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY select_pins DESC, n_readers DESC, net) AS rank FROM nets JOIN (
      SELECT circuit_id, net, count(*) AS select_pins FROM pins JOIN gates USING (circuit_id, gate_id) WHERE pin = 'S0' AND family = 'MX2' GROUP BY 1, 2) USING (circuit_id, net)) WHERE rank <= 10""")
def _(spark, d):
    return insights.control_signals(B.tables(spark, d))


BLOCK_SQL = {"blocks": """SELECT circuit_id, block, gates, round(gates / sum(gates) OVER (PARTITION BY circuit_id), 3) AS share, top_cells FROM (
    SELECT circuit_id, block, sum(n)::BIGINT AS gates, string_agg(family || ':' || n, ',' ORDER BY k) FILTER (k <= 5) AS top_cells FROM (
      SELECT *, row_number() OVER (PARTITION BY circuit_id, block ORDER BY n DESC, family) AS k FROM (SELECT circuit_id, block, family, count(*) AS n FROM gates GROUP BY 1, 2, 3))
    GROUP BY 1, 2)"""}


@query("block_summary", "SELECT * FROM blocks", **BLOCK_SQL)
def _(spark, d):
    return insights.block_summary(B.bound_gates(spark, d))


FLOW_SQL = {"flow": """SELECT DISTINCT p.circuit_id, g.block AS from_block, h.block AS to_block, coalesce(b.bus, '(internal nets)') AS via FROM pins p JOIN pins q USING (circuit_id, net)
    JOIN gates g ON g.circuit_id = p.circuit_id AND g.gate_id = p.gate_id JOIN gates h ON h.circuit_id = q.circuit_id AND h.gate_id = q.gate_id
    LEFT JOIN bus_bits b ON b.circuit_id = p.circuit_id AND b.net = p.net WHERE p.direction = 'output' AND q.direction = 'input' AND g.block <> h.block"""}


@query("block_flow", "SELECT * FROM flow", **FLOW_SQL)
def _(spark, d):
    return insights.block_flow(B.tables(spark, d))


@query("datapaths", """SELECT s.circuit_id, s.bus AS to_bus, o.operand AS from_bus, s.classification, s.width FROM signature s JOIN opbus o USING (circuit_id, bus) WHERE classification <> 'unclassified'""", **SIG_SQL)
def _(spark, d):
    s, ops, feeds = bound_signatures(A.tables(spark, d))
    return insights.datapaths(s, buses.operand_buses(s, ops, feeds))


@query("arrivals", """SELECT circuit_id, net AS output, max(level_in) AS levels FROM ports JOIN pins USING (circuit_id, net) JOIN levels USING (circuit_id, gate_id)
    WHERE port_dir = 'output' AND direction = 'output' GROUP BY 1, 2""", **LEVEL_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return insights.arrivals(t, bound_levels(t))


FAN_SQL = {"fan": """SELECT n.circuit_id, n.net, n.n_readers AS fanout, n.rank, coalesce(bool_or(drive < 1), false) AS weak_drive, coalesce(bool_or(critical), false) AS on_longest_path,
    coalesce(min(p.gate_id), -1) AS first_driver, count(DISTINCT p.gate_id) AS drivers FROM (
      SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY n_readers DESC, net) AS rank FROM nets WHERE n_readers >= 2 AND const_drivers = 0) n
    LEFT JOIN (SELECT circuit_id, net, gate_id, drive, critical FROM pins JOIN gates USING (circuit_id, gate_id) JOIN crit USING (circuit_id, gate_id) WHERE direction = 'output') p
      ON p.circuit_id = n.circuit_id AND p.net = n.net WHERE rank <= 8 GROUP BY 1, 2, 3, 4""",
           "gfan": """SELECT g.circuit_id, g.gate_id, g.cell, g.block, g.drive, coalesce(sum(n_readers), 0)::BIGINT AS fanout FROM gates g
    LEFT JOIN (SELECT * FROM pins WHERE direction = 'output') p ON p.circuit_id = g.circuit_id AND p.gate_id = g.gate_id
    LEFT JOIN nets n ON n.circuit_id = p.circuit_id AND n.net = p.net GROUP BY 1, 2, 3, 4, 5""", **LEVEL_SQL}


def crit(t, lv=None):
    return materialise(graph.criticality(lv if lv is not None else bound_levels(t)), "critical")


@query("high_fanout", "SELECT * FROM fan", **FAN_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return insights.high_fanout(t, crit(t))


@query("fanout_histogram", """SELECT circuit_id, CASE WHEN n_readers <= 3 THEN n_readers::VARCHAR WHEN n_readers <= 5 THEN '4-5' WHEN n_readers <= 8 THEN '6-8' WHEN n_readers <= 16 THEN '9-16'
    WHEN n_readers <= 32 THEN '17-32' ELSE '33+' END AS bucket, count(*) AS nets FROM nets WHERE n_readers > 0 AND const_drivers = 0 GROUP BY 1, 2""")
def _(spark, d):
    return insights.fanout_histogram(B.tables(spark, d).nets)


@query("depth_histogram", "SELECT circuit_id, level_in AS level, count(*) AS gates FROM levels GROUP BY 1, 2", **LEVEL_SQL)
def _(spark, d):
    return insights.depth_histogram(bound_levels(B.tables(spark, d)))


@query("gate_fanout", "SELECT circuit_id, gate_id, cell, block, fanout FROM gfan", **FAN_SQL)
def _(spark, d):
    return insights.gate_fanout(B.tables(spark, d))


DUP_SQL = {"dups": """SELECT circuit_id, min(gate_id) OVER w AS "group", family, count(*) OVER w AS size, gate_id FROM (
    SELECT circuit_id, gate_id, family, string_agg(pin || '=' || net, ',' ORDER BY pin, net) FILTER (direction = 'input') AS ins, count(*) FILTER (direction = 'output') AS outs
    FROM pins JOIN gates USING (circuit_id, gate_id) WHERE family <> 'DFFQ' GROUP BY 1, 2, 3) WHERE ins IS NOT NULL AND outs = 1
    WINDOW w AS (PARTITION BY circuit_id, family, ins) QUALIFY count(*) OVER w > 1""",
           "invp": """SELECT DISTINCT p.circuit_id, p.gate_id AS first, q.gate_id AS second FROM pins p JOIN nets n USING (circuit_id, net) JOIN pins q USING (circuit_id, net)
    JOIN gates g ON g.circuit_id = p.circuit_id AND g.gate_id = p.gate_id JOIN gates h ON h.circuit_id = q.circuit_id AND h.gate_id = q.gate_id
    WHERE p.direction = 'output' AND q.direction = 'input' AND n_readers = 1 AND gate_readers = 1 AND g.family = 'INV' AND h.family = 'INV' AND p.gate_id <> q.gate_id"""}


@query("duplicate_gates", "SELECT * FROM dups", **DUP_SQL)
def _(spark, d):
    return insights.duplicates(B.tables(spark, d))


@query("inverter_pairs", "SELECT * FROM invp", **DUP_SQL)
def _(spark, d):
    return insights.inverter_pairs(B.tables(spark, d))


@query("area_proxy", """SELECT kind, circuit_id, rank, name, gates FROM (SELECT *, row_number() OVER (PARTITION BY kind, circuit_id ORDER BY gates DESC, name) AS rank FROM (
    SELECT 'family' AS kind, circuit_id, family AS name, count(*) AS gates FROM gates GROUP BY 2, 3 UNION ALL SELECT 'prefix', circuit_id, hier_prefix, count(*) FROM gates GROUP BY 2, 3))
    WHERE rank <= CASE kind WHEN 'family' THEN 12 ELSE 6 END""")
def _(spark, d):
    return insights.area_proxy(B.bound_gates(spark, d))


SIZE_SQL = {"csize": "SELECT circuit_id, root AS bus, count(*) AS cone_gates, count(*) FILTER (family IN ('ADDF', 'XOR2')) AS xor_adder_cells FROM cone JOIN gates USING (circuit_id, gate_id) GROUP BY 1, 2", **CONE_SQL}


@query("cone_sizes", "SELECT * FROM csize", **SIZE_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return insights.cone_sizes(bus_cones(t), t.gates)


@query("power_indicators", """SELECT circuit_id, block, count(*) AS gates, count(*) FILTER (family IN ('ADDF', 'XOR2')) AS xor_adder_cells, max(level_in) AS max_level
    FROM gates JOIN levels USING (circuit_id, gate_id) GROUP BY 1, 2""", **LEVEL_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return insights.power_indicators(t.gates, bound_levels(t))


BOM_SQL = {"bom": """SELECT circuit_id, cell, family, drive, sum(n)::BIGINT AS count, round(sum(n) / any_value(total), 4) AS share, string_agg(block || ':' || n, ' ' ORDER BY block || ':' || n) AS blocks,
      any_value(area) AS area_each, round(any_value(area) * sum(n), 4) AS area_total FROM (
        SELECT circuit_id, cell, family, drive, block, count(*) AS n, sum(count(*)) OVER (PARTITION BY circuit_id) AS total FROM gates GROUP BY 1, 2, 3, 4, 5) LEFT JOIN attrs USING (cell) GROUP BY 1, 2, 3, 4""",
           "attrs": f"""SELECT t.cell, min(p_partkey)::DOUBLE AS area FROM (SELECT p_partkey, {B._case(B.FAMILIES, 'p_type')} || '_X' || CASE WHEN p_size < 10 THEN '0P' ELSE '' END || p_size || 'M' AS cell, p_retailprice, p_size FROM part) t
      WHERE p_size < 40 GROUP BY 1"""}


def bound_attrs(spark, d):
    """Cell areas from part keys; parts of size 40 and above stay without library data."""
    p = B.read(spark, d, "part").filter("p_size < 40")
    drive = F.concat(F.when(F.col("p_size") < 10, "0P").otherwise(""), F.col("p_size").cast("string"))
    cell = F.concat(B._lookup(B.FAMILIES, F.col("p_type")), F.lit("_X"), drive, F.lit("M"))
    return p.groupBy(cell.alias("cell")).agg(F.min("p_partkey").cast("double").alias("area")).withColumn("leakage", F.col("area") / 10)


@query("bill_of_materials", "SELECT circuit_id, cell, family, drive, count, share, blocks, round(area_each, 4) AS area_each, round(area_total, 2) AS area_total FROM bom", **BOM_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    b = insights.bom(t.gates, t.cell_pins, bound_attrs(spark, d))
    return b.select(C, "cell", "family", "drive", "count", "share", "blocks", F.round("area_each", 4).alias("area_each"), F.round("area_total", 2).alias("area_total"))


@query("bom_rollup", """SELECT circuit_id, coalesce(family, '') AS family, coalesce(cell, '') AS cell, sum(count)::BIGINT AS instances, count(DISTINCT cell) AS cell_types, round(sum(area_total), 2) AS area,
    (grouping(family) * 2 + grouping(cell))::BIGINT AS level FROM bom GROUP BY GROUPING SETS ((circuit_id, family, cell), (circuit_id, family), (circuit_id))""", **BOM_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    r = insights.bom_rollup(insights.bom(t.gates, t.cell_pins, bound_attrs(spark, d)))
    return r.na.fill("", ["family", "cell"]).withColumn("area", F.round("area", 2))


@query("drive_mix", "SELECT circuit_id, drive, count(*) AS gates FROM gates GROUP BY 1, 2")
def _(spark, d):
    return insights.drive_mix(B.bound_gates(spark, d))


SIZING_SQL = {"sized": """SELECT 'weak_drive_high_fanout' AS kind, circuit_id, row_number() OVER (PARTITION BY circuit_id ORDER BY NOT critical, fanout DESC, gate_id) AS rank, gate_id, cell, drive, fanout, critical
      FROM gfan JOIN crit USING (circuit_id, gate_id) WHERE drive < 1 AND fanout >= 8 QUALIFY rank <= 20
    UNION ALL SELECT 'strong_drive_light_load', circuit_id, row_number() OVER (PARTITION BY circuit_id ORDER BY drive DESC, gate_id) AS rank, gate_id, cell, drive, fanout, critical
      FROM gfan JOIN crit USING (circuit_id, gate_id) WHERE drive >= 2 AND fanout <= 1 QUALIFY rank <= 20""", **FAN_SQL}


@query("sizing", "SELECT * FROM sized", **SIZING_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return insights.sizing(insights.gate_fanout(t), crit(t))


OPT_SQL = {"opt": """SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY CASE category WHEN 'performance' THEN 1 WHEN 'power' THEN 2 ELSE 3 END, pos, rule) AS number FROM (
      SELECT circuit_id, 'performance' AS category, 'longest_path' AS rule, 1 AS pos, arg_max(gate_id, position)::VARCHAR AS target, max(position)::BIGINT AS size, 'medium' AS confidence FROM paths WHERE path = 1 GROUP BY 1
      UNION ALL SELECT circuit_id, 'performance', 'ripple_carry_chain', 2, head::VARCHAR, length, 'medium' FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY length DESC, head) AS k FROM
        (SELECT DISTINCT circuit_id, head, length FROM chains WHERE length >= 4)) WHERE k = 1
      UNION ALL SELECT circuit_id, 'performance', 'high_fanout', 2 + k, net, fanout, CASE WHEN on_longest_path THEN 'medium' ELSE 'low' END FROM (
        SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY NOT on_longest_path, fanout DESC, net) AS k FROM fan WHERE fanout >= 8) WHERE k <= 3
      UNION ALL SELECT circuit_id, 'performance', 'weak_drive', 9, kind, count(*), CASE WHEN bool_or(critical) THEN 'medium' ELSE 'low' END FROM sized WHERE kind LIKE 'weak%' GROUP BY 1, 5
      UNION ALL SELECT circuit_id, 'power', 'high_fanout', rank, net, fanout, 'low' FROM fan WHERE rank <= 2 AND fanout >= 8
      UNION ALL SELECT circuit_id, 'power', 'largest_cone', 3, bus, cone_gates, 'low' FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY cone_gates DESC, bus) AS k FROM csize) WHERE k = 1
      UNION ALL SELECT circuit_id, 'area', 'duplicate_gates', k, "group"::VARCHAR, size, 'high' FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY size DESC, "group") AS k FROM
        (SELECT DISTINCT circuit_id, "group", size FROM dups)) WHERE k <= 3
      UNION ALL SELECT circuit_id, 'area', 'dead_logic', 4, 'gates', count(DISTINCT gate_id), 'high' FROM m_no_path_to_po WHERE gate_id IS NOT NULL GROUP BY 1
      UNION ALL SELECT circuit_id, 'area', 'inverter_pairs', 5, 'pairs', count(*), 'medium' FROM invp GROUP BY 1
      UNION ALL SELECT circuit_id, 'area', 'dominant_block', 6, block, gates, 'low' FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY gates DESC, block) AS k FROM blocks) WHERE k = 1 AND share >= 0.4 AND share < 1
      UNION ALL SELECT circuit_id, 'area', 'strong_drive', 7, kind, count(*), 'low' FROM sized WHERE kind LIKE 'strong%' GROUP BY 1, 5
      UNION ALL SELECT circuit_id, 'area', 'inverters_and_buffers', 8, 'cells', count(*) FILTER (family = 'INV'), 'low' FROM gates GROUP BY 1 HAVING count(*) FILTER (family = 'INV') / count(*) >= 0.15)""",
           **PATH_SQL, **CHAIN_SQL, **SIZING_SQL, **SIZE_SQL, **DUP_SQL, **BLOCK_SQL, **{k: CHECK_SQL[k] for k in ("bwd", "m_no_path_to_po")}}


@query("optimizations", "SELECT circuit_id, category, rule, target, size, confidence, 'O' || number AS id FROM opt", **OPT_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    lv = materialise(bound_levels(t), "levels")
    c = crit(t, lv)
    return insights.optimizations(
        graph.longest_paths(lv, t.edges, model.po_gates(t.pins, t.ports)), graph.link_chains(graph.carry_links(t.gates, t.pins)),
        materialise(insights.high_fanout(t, c), "fanout"), insights.cone_sizes(bus_cones(t), t.gates), insights.duplicates(t),
        checks.check_no_path_to_po(t).filter("gate_id is not null"), insights.inverter_pairs(t), insights.block_summary(t.gates),
        materialise(insights.sizing(insights.gate_fanout(t), c), "sizing"), insights.bom(t.gates))


MODEL_SQL = {**{k: CHECK_SQL[k] for k in ("m_class_disagrees", "m_low_confidence", "m_singleton")},
             "hints": "SELECT * FROM m_class_disagrees UNION ALL SELECT * FROM m_low_confidence UNION ALL SELECT * FROM m_singleton"}


def model_members(t):
    return materialise(checks.run_checks(t, checks.MODEL), "hints")


@query("region_report", """SELECT circuit_id, module, pred_class, size, round(avg(top), 6) AS mean_probability, round(min(top), 6) AS min_probability, count(*) FILTER (top < 0.6) AS below_0_6,
    count(*) FILTER (label = s.pred_class) AS agreeing, any_value(coalesce(links, 0)) AS outside_links, any_value(coalesce(nh, 0)) AS hints, 0::BIGINT AS facts FROM subc s
    JOIN (SELECT circuit_id, gate_id, top FROM preds) USING (circuit_id, gate_id) JOIN gates USING (circuit_id, gate_id)
    LEFT JOIN (SELECT y.circuit_id, a.module, count(*) AS links FROM sym y JOIN subc a ON a.circuit_id = y.circuit_id AND a.gate_id = y.src JOIN subc b ON b.circuit_id = y.circuit_id AND b.gate_id = y.dst
      WHERE a.module <> b.module GROUP BY 1, 2) USING (circuit_id, module)
    LEFT JOIN (SELECT circuit_id, module, count(DISTINCT h."check" || '|' || subject) AS nh FROM hints h JOIN subc USING (circuit_id, gate_id) GROUP BY 1, 2) USING (circuit_id, module)
    GROUP BY 1, 2, 3, 4""", **SUBC, **MODEL_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    m = materialise(graph.subcircuits(t.gates, t.edges, t.preds), "modules")
    return rnd(insights.regions_report(m, t.preds, t.gates, t.edges, model_members(t)))


@query("suspicious_modules", """SELECT circuit_id, module, hint_rows, rank FROM (SELECT circuit_id, module, count(*) AS hint_rows, row_number() OVER (PARTITION BY circuit_id ORDER BY count(*) DESC, module) AS rank
    FROM hints JOIN subc USING (circuit_id, gate_id) GROUP BY 1, 2) WHERE rank <= 5""", **SUBC, **MODEL_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return insights.suspicious_modules(materialise(graph.subcircuits(t.gates, t.edges, t.preds), "modules"), model_members(t))


# ------------------------------------------------------------------ lookups
_TOP20 = lambda a, b: f"""SELECT circuit_id, {a} AS gate_id, string_agg({b}, ',' ORDER BY {b}) AS l FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id, {a} ORDER BY {b}) AS k FROM edges) WHERE k <= 20 GROUP BY 1, 2"""


@query("gate_card", f"""SELECT circuit_id, gate_id, inst, cell, block, label, pred_class, coalesce(np, 0) AS connections, coalesce(i.l, '') AS fanin, coalesce(o.l, '') AS fanout, coalesce(nm, 0) AS missing,
    coalesce(nf, 0) AS findings FROM gates JOIN (SELECT circuit_id, gate_id, pred_class FROM preds) USING (circuit_id, gate_id)
    LEFT JOIN (SELECT circuit_id, gate_id, count(*) AS np FROM pins GROUP BY 1, 2) USING (circuit_id, gate_id) LEFT JOIN fi i USING (circuit_id, gate_id) LEFT JOIN fo o USING (circuit_id, gate_id)
    LEFT JOIN (SELECT circuit_id, gate_id, count(*) AS nm FROM m_missing_pin GROUP BY 1, 2) USING (circuit_id, gate_id)
    LEFT JOIN (SELECT circuit_id, gate_id, count(DISTINCT m."check" || '|' || subject) AS nf FROM emembers m WHERE gate_id IS NOT NULL GROUP BY 1, 2) USING (circuit_id, gate_id)""",
       fi=_TOP20("dst", "src"), fo=_TOP20("src", "dst"), **ELEC_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return lookups.gate_card(t, t.gates, elec_members(t))


@query("gate_pins", """SELECT circuit_id, gate_id, pin, direction, net, CASE direction WHEN 'output' THEN n_readers ELSE n_drivers END AS far_ends FROM pins JOIN nets USING (circuit_id, net)""")
def _(spark, d):
    t = B.tables(spark, d)
    return lookups.gate_pins(t, t.gates)


_TOP30 = lambda side: f"""SELECT circuit_id, net, string_agg(gate_id, ',' ORDER BY gate_id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id, net ORDER BY gate_id) AS k FROM
    (SELECT DISTINCT circuit_id, net, gate_id FROM pins WHERE direction = '{side}')) WHERE k <= 30 GROUP BY 1, 2"""


@query("net_card", """SELECT circuit_id, net, n_drivers, n_readers, coalesce(bus, '') AS bus, coalesce(significance, -1) AS significance, coalesce(a.l, '') AS driver_gates, coalesce(b.l, '') AS reader_gates,
    coalesce(nf, 0) AS findings FROM nets LEFT JOIN bus_bits USING (circuit_id, net) LEFT JOIN dl a USING (circuit_id, net) LEFT JOIN rl b USING (circuit_id, net)
    LEFT JOIN (SELECT circuit_id, net, count(DISTINCT m."check" || '|' || subject) AS nf FROM emembers m WHERE net IS NOT NULL GROUP BY 1, 2) USING (circuit_id, net)""",
       dl=_TOP30("output"), rl=_TOP30("input"), **ELEC_SQL)
def _(spark, d):
    """Keys are given as escaped names, so the backslash has to be tolerated."""
    t = B.tables(spark, d)
    names = t.nets.select(C, F.concat(F.lit("\\"), F.col("net")).alias("name"))
    return lookups.net_card(t, lookups.match_nets(t, names), elec_members(t))


@query("bus_card", "SELECT circuit_id, bus, kind, significance, net, n_drivers, n_readers FROM bus_bits JOIN nets USING (circuit_id, net)")
def _(spark, d):
    t = B.tables(spark, d)
    return lookups.bus_card(t, t.bus_bits)


@query("list_findings", """SELECT DISTINCT circuit_id, m."check", subject, severity, 'wiring' AS "group" FROM emembers m WHERE severity = 'error'""", **ELEC_SQL)
def _(spark, d):
    f = lookups.list_findings(checks.findings(elec_members(B.tables(spark, d))), "electrical", "error")
    return f.select(C, "check", "subject", "severity", "group")


@query("block_card", """SELECT circuit_id, block, gates, coalesce(feeds, 0) AS feeds, coalesce(fed_by, 0) AS fed_by, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings, coalesce(i, 0) AS infos FROM blocks
    LEFT JOIN (SELECT circuit_id, from_block AS block, count(DISTINCT to_block) AS feeds FROM flow GROUP BY 1, 2) USING (circuit_id, block)
    LEFT JOIN (SELECT circuit_id, to_block AS block, count(DISTINCT from_block) AS fed_by FROM flow GROUP BY 1, 2) USING (circuit_id, block)
    LEFT JOIN (SELECT circuit_id, block, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i FROM (
      SELECT DISTINCT circuit_id, g.block, m."check", m.severity, m.subject FROM emembers m JOIN gates g USING (circuit_id, gate_id)) GROUP BY 1, 2) USING (circuit_id, block)""", **BLOCK_SQL, **FLOW_SQL, **ELEC_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return lookups.block_card(t, t.gates, insights.block_flow(t), elec_members(t))


@query("explain_findings", """SELECT DISTINCT circuit_id, m."check", subject, severity, gate_id, inst, cell, block FROM m_multi_driver m JOIN gates USING (circuit_id, gate_id)""", **ELEC_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    m = materialise(checks.check_multi_driver(t), "multi")
    return lookups.explain_findings(m, t.gates, m)


@query("optimizations_for_gates", """SELECT kind, circuit_id, gate_id, fanout FROM sized JOIN (SELECT DISTINCT circuit_id, gate_id FROM gates WHERE family = 'ADDF') USING (circuit_id, gate_id)""", **SIZING_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    s = insights.sizing(insights.gate_fanout(t), crit(t))
    return lookups.optimizations_for(s, gates=t.gates.filter("cell like 'ADDF%'")).select("kind", C, "gate_id", "fanout")
