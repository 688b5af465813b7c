"""Registered queries: connectivity checks and the findings pipeline."""

from pyspark.sql import functions as F

from wireloom import schema as S
from wireloom.operators import checks
from wireloom.plans import bindings as B
from wireloom.plans.registry import query

# Member rows of every check in SQL, keyed like the operators.
_GP = "'G' || gate_id || '.' || pin"
CHECK_SQL = {
    "m_missing_pin": f"""SELECT circuit_id, 'missing_pin' AS "check", CASE l.direction WHEN 'input' THEN 'error' ELSE 'warning' END AS severity,
        'G' || gate_id || '.' || l.pin AS subject, gate_id, l.pin, NULL::VARCHAR AS net FROM gates g JOIN cell_pins l USING (cell)
        WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.circuit_id = g.circuit_id AND p.gate_id = g.gate_id AND p.pin = l.pin)""",
    "m_floating_net": """SELECT circuit_id, 'floating_net' AS "check", 'error' AS severity, net AS subject, gate_id, pin, net
        FROM pins JOIN nets USING (circuit_id, net) WHERE n_drivers = 0 AND direction = 'input'""",
    "m_multi_driver": """SELECT circuit_id, 'multi_driver' AS "check", 'error' AS severity, net AS subject, gate_id, pin, net
        FROM pins JOIN nets USING (circuit_id, net) WHERE n_drivers > 1 AND direction = 'output'""",
    "m_dangling_output": f"""SELECT circuit_id, CASE WHEN pin = 'CO' AND family IN ('ADDF', 'ADDH') THEN 'carry_out_unread' ELSE 'dangling_output' END AS "check",
        'warning' AS severity, {_GP} || '=' || net AS subject, gate_id, pin, net
        FROM pins JOIN nets USING (circuit_id, net) JOIN gates USING (circuit_id, gate_id)
        WHERE n_readers = 0 AND direction = 'output'""",
    "m_const_input": """SELECT circuit_id, 'const_input' AS "check", 'info' AS severity, net AS subject, gate_id, pin, net
        FROM pins WHERE net = '1''b0' AND direction = 'input'""",
    "m_undriven_po": """SELECT circuit_id, 'undriven_po' AS "check", 'error' AS severity, net AS subject, NULL::INT AS gate_id, NULL::VARCHAR AS pin, net
        FROM ports JOIN nets USING (circuit_id, net) WHERE port_dir = 'output' AND n_drivers = 0""",
    "m_unused_pi": """SELECT circuit_id, 'unused_pi' AS "check", 'warning' AS severity, net AS subject, NULL::INT AS gate_id, NULL::VARCHAR AS pin, net
        FROM ports JOIN nets USING (circuit_id, net) WHERE port_dir = 'input' AND n_readers = 0""",
    "m_unknown_cell": """SELECT circuit_id, 'unknown_cell' AS "check", 'info' AS severity, cell AS subject, gate_id, NULL::VARCHAR AS pin, NULL::VARCHAR AS net
        FROM gates WHERE cell NOT IN (SELECT cell FROM cell_pins)""",
    "fed": """SELECT circuit_id, gate_id FROM gates g WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.circuit_id = g.circuit_id
        AND p.gate_id = g.gate_id AND direction = 'input') UNION SELECT circuit_id, gate_id FROM pins JOIN nets USING (circuit_id, net)
        WHERE direction = 'input' AND (pi_drivers > 0 OR const_drivers > 0)""",
    "fwd": """SELECT * FROM (WITH RECURSIVE r AS (SELECT circuit_id, gate_id FROM fed UNION SELECT e.circuit_id, e.dst FROM r JOIN edges e
        ON e.circuit_id = r.circuit_id AND e.src = r.gate_id) SELECT * FROM r)""",
    "bwd": """SELECT * FROM (WITH RECURSIVE r AS (SELECT circuit_id, gate_id FROM po_gates UNION SELECT e.circuit_id, e.src FROM r JOIN edges e
        ON e.circuit_id = r.circuit_id AND e.dst = r.gate_id) SELECT * FROM r)""",
}


def _region_sql(check, ok, side, cond):
    return f"""SELECT * FROM (WITH RECURSIVE rest AS (SELECT circuit_id, gate_id FROM gates EXCEPT SELECT circuit_id, gate_id FROM {ok}),
        link AS (SELECT e.* FROM sym e JOIN rest a ON a.circuit_id = e.circuit_id AND a.gate_id = e.src
            JOIN rest b ON b.circuit_id = e.circuit_id AND b.gate_id = e.dst),
        r AS (SELECT circuit_id, gate_id, gate_id AS o FROM rest UNION SELECT l.circuit_id, r.gate_id, l.dst FROM r JOIN link l
            ON l.circuit_id = r.circuit_id AND l.src = r.o),
        reg AS (SELECT circuit_id, gate_id, min(o) AS region FROM r GROUP BY 1, 2),
        loose AS (SELECT DISTINCT circuit_id, region, net FROM reg JOIN pins USING (circuit_id, gate_id) JOIN nets USING (circuit_id, net)
            WHERE direction = '{side}' AND {cond})
        SELECT circuit_id, '{check}' AS "check", CASE WHEN EXISTS (SELECT 1 FROM loose l WHERE l.circuit_id = g.circuit_id AND l.region = g.region)
            THEN 'info' ELSE 'warning' END AS severity, 'R' || region AS subject, gate_id, NULL::VARCHAR AS pin, NULL::VARCHAR AS net FROM reg g
        UNION ALL SELECT circuit_id, '{check}', 'info', 'R' || region, NULL, NULL, net FROM loose)"""


CHECK_SQL["m_unreachable_from_pi"] = _region_sql("unreachable_from_pi", "fwd", "input", "n_drivers = 0")
CHECK_SQL["m_no_path_to_po"] = _region_sql("no_path_to_po", "bwd", "output", "n_readers = 0")
CHECK_SQL["comp_link"] = """SELECT circuit_id, 'g:' || gate_id AS u, net AS w FROM pins
    UNION ALL SELECT circuit_id, CASE port_dir WHEN 'input' THEN 'pi:' ELSE 'po:' END || net, net FROM ports"""
CHECK_SQL["comp"] = """SELECT * FROM (WITH RECURSIVE w AS (SELECT DISTINCT a.circuit_id, a.w AS x, b.w AS y FROM comp_link a JOIN comp_link b
        ON a.circuit_id = b.circuit_id AND a.u = b.u),
    r AS (SELECT DISTINCT circuit_id, w AS x, w AS o FROM comp_link UNION SELECT r.circuit_id, r.x, w.y FROM r JOIN w ON w.circuit_id = r.circuit_id AND w.x = r.o),
    root AS (SELECT circuit_id, x, min(o) AS root FROM r GROUP BY 1, 2)
    SELECT DISTINCT l.circuit_id, l.u, root.root FROM comp_link l JOIN root ON root.circuit_id = l.circuit_id AND root.x = l.w)"""
CHECK_SQL["comp_rank"] = """SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY gates DESC, first_gate) AS rank FROM (
    SELECT circuit_id, root, count(*) FILTER (u LIKE 'g:%') AS gates, count(*) FILTER (u LIKE 'pi:%') AS inputs,
    count(*) FILTER (u LIKE 'po:%') AS outputs, min(CASE WHEN u LIKE 'g:%' THEN substr(u, 3)::INT END) AS first_gate
    FROM comp GROUP BY 1, 2) WHERE gates > 0"""
CHECK_SQL["m_isolated_component"] = """SELECT circuit_id, 'isolated_component' AS "check", 'warning' AS severity, 'R' || first_gate AS subject,
    substr(u, 3)::INT AS gate_id, NULL::VARCHAR AS pin, NULL::VARCHAR AS net FROM comp JOIN comp_rank USING (circuit_id, root)
    WHERE rank > 1 AND u LIKE 'g:%'"""
# on or behind a cycle: some gate on a cycle reaches it over edges that do not leave a register
CHECK_SQL["m_combinational_loop"] = """SELECT * FROM (WITH RECURSIVE e AS (SELECT e.* FROM edges e JOIN gates g ON g.circuit_id = e.circuit_id
        AND g.gate_id = e.src WHERE g.family <> 'DFFQ'),
    tc AS (SELECT circuit_id, src, dst FROM e UNION SELECT tc.circuit_id, tc.src, e.dst FROM tc JOIN e ON e.circuit_id = tc.circuit_id AND e.src = tc.dst)
    SELECT DISTINCT t.circuit_id, 'combinational_loop' AS "check", 'warning' AS severity, 'loop' AS subject, t.dst AS gate_id,
      NULL::VARCHAR AS pin, NULL::VARCHAR AS net
    FROM tc t JOIN tc c ON c.circuit_id = t.circuit_id AND c.src = c.dst AND c.src = t.src)"""
CHECK_SQL["m_class_disagrees"] = """SELECT circuit_id, 'class_disagrees_with_neighbours' AS "check", 'info' AS severity,
    hier_prefix || '|' || pred_class || '|' || majority AS subject, gate_id, NULL::VARCHAR AS pin, NULL::VARCHAR AS net FROM (
      SELECT circuit_id, src AS gate_id, sum(n) AS total, max(n) AS top_n, arg_max(c, n * 10 - c) AS majority FROM (
        SELECT s.circuit_id, s.src, p.pred_class AS c, count(*) AS n FROM sym s JOIN preds p ON p.circuit_id = s.circuit_id AND p.gate_id = s.dst
        GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN preds USING (circuit_id, gate_id) JOIN gates USING (circuit_id, gate_id)
    WHERE total >= 3 AND majority <> pred_class AND top_n / total >= 0.75"""
CHECK_SQL["m_low_confidence"] = """SELECT circuit_id, 'low_confidence_prediction' AS "check", 'info' AS severity, hier_prefix AS subject, gate_id,
    NULL::VARCHAR AS pin, NULL::VARCHAR AS net FROM preds JOIN gates USING (circuit_id, gate_id) WHERE top < 0.6"""
CHECK_SQL["m_singleton"] = """SELECT circuit_id, 'singleton_subcircuit' AS "check", 'info' AS severity, 'class' || pred_class AS subject, gate_id,
    NULL::VARCHAR AS pin, NULL::VARCHAR AS net FROM preds p WHERE NOT EXISTS (SELECT 1 FROM sym s JOIN preds q ON q.circuit_id = s.circuit_id
    AND q.gate_id = s.dst WHERE s.circuit_id = p.circuit_id AND s.src = p.gate_id AND q.pred_class = p.pred_class)"""
ALL = [k for k in CHECK_SQL if k.startswith("m_")]
CHECK_SQL["members"] = " UNION ALL ".join(f"SELECT * FROM {k}" for k in ALL)
CHECK_SQL["catalog"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', '{cat}', '{cert}', {i})" for i, (c, cat, cert) in enumerate(S.CHECK_CATALOG)) + ') v("check", category, certainty, pos)'
CHECK_SQL["findings"] = """SELECT m.circuit_id, m."check", m.severity, m.subject, min(gate_id) AS first_gate, min(net) AS first_net,
    count(gate_id) AS gate_rows, count(*) AS members, any_value(c.category) AS category, any_value(c.certainty) AS certainty,
    CASE WHEN any_value(c.certainty) = 'fact' THEN 1.0 WHEN m."check" = 'class_disagrees_with_neighbours' THEN 0.4
      WHEN m."check" = 'singleton_subcircuit' THEN 0.3 WHEN m."check" = 'low_confidence_prediction' THEN 0.5
      WHEN m."check" = 'carry_break' THEN 0.9 WHEN m."check" = 'bit_slice_anomaly' THEN 0.8 WHEN m."check" = 'intent_dependency' THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence,
    any_value(c.category) = 'gnn_suspicion' AS model_based
    FROM members m JOIN catalog c ON c."check" = m."check" GROUP BY 1, 2, 3, 4"""
NUMBERED = """SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY
    CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END,
    CASE category WHEN 'electrical' THEN 1 WHEN 'reachability' THEN 2 WHEN 'structural' THEN 3 WHEN 'intent' THEN 4 ELSE 5 END,
    "check", coalesce(first_gate, -1), coalesce(first_net, ''), g) AS number FROM heads"""

_OUT = """SELECT circuit_id, "check", severity, subject, coalesce(gate_id, -1) AS gate_id, coalesce(pin, '') AS pin,
    coalesce(net, '') AS net FROM """


def _plain(df):
    return df.na.fill({"gate_id": -1, "pin": "", "net": ""})


for _name, _fn, _key in (
        ("check_missing_pin", checks.check_missing_pin, "m_missing_pin"),
        ("check_floating_net", checks.check_floating_net, "m_floating_net"),
        ("check_multi_driver", checks.check_multi_driver, "m_multi_driver"),
        ("check_dangling_output", checks.check_dangling_output, "m_dangling_output"),
        ("check_const_input", checks.check_const_input, "m_const_input"),
        ("check_undriven_po", checks.check_undriven_po, "m_undriven_po"),
        ("check_unused_pi", checks.check_unused_pi, "m_unused_pi"),
        ("check_unknown_cell", checks.check_unknown_cell, "m_unknown_cell"),
        ("check_unreachable_from_pi", checks.check_unreachable, "m_unreachable_from_pi"),
        ("check_no_path_to_po", checks.check_no_path_to_po, "m_no_path_to_po"),
        ("check_isolated_component", checks.check_isolated_component, "m_isolated_component"),
        ("check_combinational_loop", checks.check_combinational_loop, "m_combinational_loop"),
        ("check_class_disagrees", checks.check_class_disagrees, "m_class_disagrees"),
        ("check_low_confidence", checks.check_low_confidence, "m_low_confidence"),
        ("check_singleton_subcircuit", checks.check_singleton_subcircuit, "m_singleton")):
    query(_name, _OUT + _key, **CHECK_SQL)(lambda spark, d, f=_fn: _plain(f(B.tables(spark, d))))


@query("component_summary", "SELECT circuit_id, gates, inputs, outputs, first_gate, rank FROM comp_rank", **CHECK_SQL)
def _(spark, d):
    return checks.component_summary(B.tables(spark, d)).drop("component")


def _ran(t):
    """All but the bus checks: these circuits have no arithmetic (see `q_arith` for those that do)."""
    return tuple(c for c in checks.default_checks(t) if c not in checks.BUS)


def _members(spark, d):
    """All checks, written once: the pipeline reads the member rows several times."""
    from wireloom.operators.scale import materialise
    t = B.tables(spark, d)
    return t, materialise(checks.run_checks(t, _ran(t)), "members")


@query("findings", """SELECT circuit_id, "check", severity, subject, coalesce(first_gate, -1) AS first_gate, coalesce(first_net, '') AS first_net,
    gate_rows, members, category, certainty, confidence, model_based FROM findings""", **CHECK_SQL)
def _(spark, d):
    t, m = _members(spark, d)
    return checks.findings(m).na.fill({"first_gate": -1, "first_net": ""})


MERGE_SQL = {
    "flist": """SELECT m.circuit_id, m."check", m.severity, m.subject, min(gate_id) AS first_gate, min(net) AS first_net, any_value(c.category) AS category,
        list(DISTINCT gate_id) FILTER (gate_id IS NOT NULL) AS gl FROM members m JOIN catalog c ON c."check" = m."check" GROUP BY 1, 2, 3, 4""",
    "fblock": """SELECT f.*, coalesce(hier_prefix, '') AS block FROM flist f LEFT JOIN gates g ON g.circuit_id = f.circuit_id AND g.gate_id = f.first_gate""",
    "fsize": """SELECT circuit_id, "check" AS c, severity AS s, block AS b, count(*) > 25 AS merged, min(subject) AS first FROM fblock GROUP BY 1, 2, 3, 4""",
    "grouped": """SELECT f.*, merged, CASE WHEN merged THEN first ELSE subject END AS g FROM fblock f JOIN fsize z ON z.circuit_id = f.circuit_id AND z.c = f."check" AND z.s = f.severity AND z.b = f.block""",
    "heads": """SELECT circuit_id, "check", category, severity, block, g, merged, count(*) AS n, min(first_gate) AS first_gate, min(first_net) AS first_net FROM grouped GROUP BY 1, 2, 3, 4, 5, 6, 7""",
    "mgates": """SELECT DISTINCT circuit_id, "check", severity, block, g, unnest(gl) AS gate_id FROM grouped""",
    "mlist": """SELECT circuit_id, "check" AS c, severity AS s, block AS b, g AS gg, string_agg(gate_id, ',' ORDER BY gate_id) AS gate_ids FROM (
        SELECT *, row_number() OVER (PARTITION BY circuit_id, "check", severity, block, g ORDER BY gate_id) AS k FROM mgates) WHERE k <= 50 GROUP BY 1, 2, 3, 4, 5""",
    **CHECK_SQL}


@query("merged_findings", """SELECT h.circuit_id, "check", category, severity, block, g AS group_subject, merged, n AS count, coalesce(first_gate, -1) AS first_gate, coalesce(first_net, '') AS first_net,
    coalesce(gate_ids, '') AS gate_ids FROM heads h LEFT JOIN mlist l ON l.circuit_id = h.circuit_id AND l.c = h."check" AND l.s = h.severity AND l.b = h.block AND l.gg = h.g""", **MERGE_SQL)
def _(spark, d):
    t, m = _members(spark, d)
    out = checks.merge_findings(m, t.gates)
    return out.withColumn("gate_ids", F.coalesce(F.array_join("gate_ids", ","), F.lit(""))).na.fill(
        {"first_gate": -1, "first_net": ""})


@query("numbered_findings", """SELECT circuit_id, "check", severity, g AS group_subject, number,
    'F' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS id FROM numbered""", **MERGE_SQL, numbered=NUMBERED)
def _(spark, d):
    """Findings are grouped first and then numbered."""
    t, m = _members(spark, d)
    return checks.number_findings(checks.merge_findings(m, t.gates), "group_subject").select("circuit_id", "check", "severity", "group_subject", "number", "id")


@query("finding_stats", """SELECT * FROM (SELECT circuit_id, count(*) AS gates FROM gates GROUP BY 1)
    JOIN (SELECT circuit_id, count(*) AS nets FROM nets GROUP BY 1) USING (circuit_id)
    JOIN (SELECT circuit_id, count(*) AS edges FROM edges GROUP BY 1) USING (circuit_id)
    JOIN (SELECT circuit_id, count(*) AS ports FROM ports GROUP BY 1) USING (circuit_id)
    JOIN (SELECT circuit_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
      count(*) FILTER (severity = 'info') AS infos FROM findings GROUP BY 1) USING (circuit_id)""", **CHECK_SQL)
def _(spark, d):
    t, m = _members(spark, d)
    return checks.finding_stats(checks.findings(m), t)


@query("passed_checks", """SELECT circuit_id, "check" FROM (SELECT DISTINCT circuit_id FROM gates), (SELECT "check" FROM catalog WHERE "check" NOT IN ('carry_break', 'bit_slice_anomaly', 'intent_dependency'))
    EXCEPT SELECT circuit_id, "check" FROM findings WHERE severity <> 'info'""", **CHECK_SQL)
def _(spark, d):
    t, m = _members(spark, d)
    return checks.passed_checks(checks.findings(m), t.gates, checks.reported_by(_ran(t)))


@query("circuit_health", """SELECT circuit_id, CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning'
    WHEN count(severity) > 0 THEN 'info' ELSE 'ok' END AS health FROM (SELECT DISTINCT circuit_id FROM gates) LEFT JOIN findings USING (circuit_id)
    GROUP BY 1""", **CHECK_SQL)
def _(spark, d):
    t, m = _members(spark, d)
    return checks.health(checks.findings(m), t.gates)
