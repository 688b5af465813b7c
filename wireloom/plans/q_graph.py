"""Registered queries: graph algorithms."""

from pyspark.sql import functions as F

from wireloom.operators import checks, graph, model
from wireloom.operators.scale import materialise
from wireloom.plans import bindings as B
from wireloom.plans.q_checks import CHECK_SQL
from wireloom.plans.registry import query

#: Gates on or behind a cycle have level 0, those in front of one have no level to the outputs.
LEVEL_SQL = {
    "tc": """SELECT * FROM (WITH RECURSIVE tc AS (SELECT circuit_id, src, dst FROM edges UNION SELECT tc.circuit_id, tc.src, e.dst FROM tc JOIN edges e ON e.circuit_id = tc.circuit_id AND e.src = tc.dst)
        SELECT * FROM tc)""",
    "oncyc": "SELECT DISTINCT circuit_id, src AS gate_id FROM tc WHERE src = dst",
    **{f"level_{way}": f"""SELECT * FROM (WITH RECURSIVE hit AS (SELECT circuit_id, gate_id FROM oncyc UNION SELECT t.circuit_id, t.{b} FROM tc t JOIN oncyc c ON c.circuit_id = t.circuit_id AND c.gate_id = t.{a}),
        ok AS (SELECT circuit_id, gate_id FROM gates EXCEPT SELECT circuit_id, gate_id FROM hit),
        w AS (SELECT circuit_id, gate_id, 1::INT AS r FROM ok UNION SELECT e.circuit_id, e.{b}, r + 1 FROM w JOIN edges e ON e.circuit_id = w.circuit_id AND e.{a} = w.gate_id
          JOIN ok ON ok.circuit_id = e.circuit_id AND ok.gate_id = e.{b})
        SELECT circuit_id, gate_id, max(r) AS level_{way} FROM w GROUP BY 1, 2 UNION ALL SELECT DISTINCT circuit_id, gate_id, 0 FROM hit SEMI JOIN gates USING (circuit_id, gate_id))"""
       for way, a, b in (("in", "src", "dst"), ("out", "dst", "src"))},
    "levels": "SELECT * FROM level_in JOIN level_out USING (circuit_id, gate_id)",
    "crit": """SELECT *, level_in + level_out - 1 AS through, max_depth - (level_in + level_out - 1) AS slack,
        level_in + level_out - 1 = max_depth AS critical
        FROM levels JOIN (SELECT circuit_id, max(level_in) AS max_depth FROM levels GROUP BY 1) USING (circuit_id)""",
}
GCOMP = {"gcomp": """SELECT * FROM (WITH RECURSIVE r AS (SELECT circuit_id, gate_id, gate_id AS o FROM gates UNION SELECT s.circuit_id, r.gate_id, s.dst
    FROM r JOIN sym s ON s.circuit_id = r.circuit_id AND s.src = r.o) SELECT circuit_id, gate_id, min(o) AS component FROM r GROUP BY 1, 2)"""}


def bound_levels(t):
    return graph.levels(t.gates, t.edges)


@query("reach_from_inputs", """SELECT * FROM (WITH RECURSIVE r AS (SELECT circuit_id, gate_id, 0 AS round FROM fed UNION SELECT e.circuit_id, e.dst, round + 1
    FROM r JOIN edges e ON e.circuit_id = r.circuit_id AND e.src = r.gate_id WHERE round < 40)
    SELECT circuit_id, gate_id, min(round) AS hops FROM r GROUP BY 1, 2)""", fed=CHECK_SQL["fed"])
def _(spark, d):
    t = B.tables(spark, d)
    return graph.reach(t.edges, checks.fed_gates(t)).withColumnRenamed("round", "hops")


@query("gate_components", "SELECT circuit_id, gate_id, component FROM gcomp", **GCOMP)
def _(spark, d):
    t = B.tables(spark, d)
    return graph.gate_components(t.gates, t.edges)


@query("regions", """SELECT * FROM (WITH RECURSIVE sub AS (SELECT circuit_id, gate_id FROM gates WHERE label IN (0, 3)),
    link AS (SELECT s.* FROM sym s JOIN sub a ON a.circuit_id = s.circuit_id AND a.gate_id = s.src JOIN sub b ON b.circuit_id = s.circuit_id AND b.gate_id = s.dst),
    r AS (SELECT circuit_id, gate_id, gate_id AS o FROM sub UNION SELECT l.circuit_id, r.gate_id, l.dst FROM r JOIN link l
      ON l.circuit_id = r.circuit_id AND l.src = r.o) SELECT circuit_id, gate_id, min(o) AS region FROM r GROUP BY 1, 2)""")
def _(spark, d):
    t = B.tables(spark, d)
    return graph.regions(t.edges, t.gates.filter("label in (0, 3)"))


SUBC = {"subc": """SELECT * FROM (WITH RECURSIVE link AS (SELECT s.circuit_id, s.src, s.dst FROM sym s JOIN preds a ON a.circuit_id = s.circuit_id AND a.gate_id = s.src
      JOIN preds b ON b.circuit_id = s.circuit_id AND b.gate_id = s.dst WHERE a.pred_class = b.pred_class),
    r AS (SELECT circuit_id, gate_id, gate_id AS o FROM gates UNION SELECT l.circuit_id, r.gate_id, l.dst FROM r JOIN link l
      ON l.circuit_id = r.circuit_id AND l.src = r.o),
    m AS (SELECT circuit_id, gate_id, min(o) AS module FROM r GROUP BY 1, 2)
    SELECT circuit_id, gate_id, module, pred_class, count(*) OVER (PARTITION BY circuit_id, module) AS size FROM m JOIN preds USING (circuit_id, gate_id))"""}


@query("subcircuits", "SELECT * FROM subc", **SUBC)
def _(spark, d):
    t = B.tables(spark, d)
    return graph.subcircuits(t.gates, t.edges, t.preds)


@query("topo_levels", """SELECT * FROM (WITH RECURSIVE cyc AS (SELECT circuit_id, gate_id FROM m_combinational_loop),
    e AS (SELECT e.* FROM edges e JOIN gates g ON g.circuit_id = e.circuit_id AND g.gate_id = e.src WHERE family <> 'DFFQ'),
    ok AS (SELECT circuit_id, gate_id FROM gates EXCEPT SELECT circuit_id, gate_id FROM cyc),
    w AS (SELECT circuit_id, gate_id, 1 AS r FROM ok UNION SELECT e.circuit_id, e.dst, r + 1 FROM w JOIN e ON e.circuit_id = w.circuit_id AND e.src = w.gate_id
      JOIN ok ON ok.circuit_id = e.circuit_id AND ok.gate_id = e.dst)
    SELECT circuit_id, gate_id, max(r) AS rank FROM w GROUP BY 1, 2 UNION ALL SELECT circuit_id, gate_id, -1 FROM cyc)""",
       m_combinational_loop=CHECK_SQL["m_combinational_loop"])
def _(spark, d):
    from wireloom.functions import names
    t = B.tables(spark, d)
    return graph.topo_levels(t.gates, t.edges, t.gates.filter(names.is_sequential("cell"))).na.fill({"rank": -1})


@query("levels", "SELECT circuit_id, gate_id, level_in, level_out FROM levels", **LEVEL_SQL)
def _(spark, d):
    return bound_levels(B.tables(spark, d))


@query("criticality", "SELECT circuit_id, gate_id, level_in, level_out, max_depth, through, slack, critical FROM crit", **LEVEL_SQL)
def _(spark, d):
    return graph.criticality(bound_levels(B.tables(spark, d)))


PATH_SQL = {
    "outs": """SELECT * FROM (SELECT circuit_id, gate_id, level_in, row_number() OVER (PARTITION BY circuit_id ORDER BY level_in DESC, gate_id) AS end_rank
        FROM levels JOIN po_gates USING (circuit_id, gate_id)) WHERE end_rank <= 5""",
    "deepest": """SELECT circuit_id, gate_id, level_in, 0 AS end_rank FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY level_in DESC, gate_id) AS k
        FROM levels) d WHERE k = 1 AND level_in > (SELECT max(level_in) FROM outs o WHERE o.circuit_id = d.circuit_id)""",
    "ends": """SELECT circuit_id, gate_id, path FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id ORDER BY end_rank) AS path FROM (
        SELECT * FROM outs UNION ALL SELECT * FROM deepest)) WHERE path <= 5""",
    "parent": """SELECT d.circuit_id, d.dst AS gate_id, min(d.src) AS prev FROM edges d JOIN levels a ON a.circuit_id = d.circuit_id AND a.gate_id = d.src
        JOIN levels b ON b.circuit_id = d.circuit_id AND b.gate_id = d.dst WHERE a.level_in = b.level_in - 1 GROUP BY 1, 2""",
    "paths": """SELECT * FROM (WITH RECURSIVE w AS (SELECT circuit_id, path, gate_id FROM ends UNION SELECT w.circuit_id, w.path, p.prev FROM w JOIN parent p
        ON p.circuit_id = w.circuit_id AND p.gate_id = w.gate_id)
        SELECT w.circuit_id, path, level_in AS position, w.gate_id FROM w JOIN levels USING (circuit_id, gate_id))""", **LEVEL_SQL}


@query("longest_paths", "SELECT * FROM paths", **PATH_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return graph.longest_paths(materialise(bound_levels(t), "levels"), t.edges, model.po_gates(t.pins, t.ports))


def pi_gates(t):
    pi = t.ports.filter("port_dir = 'input'").select("circuit_id", "net")
    return t.pins.filter("direction = 'input'").join(pi, ["circuit_id", "net"], "left_semi").select("circuit_id", "gate_id").distinct()


HOP_SQL = {
    "pi_gates": "SELECT DISTINCT circuit_id, gate_id FROM pins JOIN ports USING (circuit_id, net) WHERE direction = 'input' AND port_dir = 'input'",
    **{f"hop_{s}": f"""SELECT circuit_id, gate_id, component, coalesce(dist, -1) AS distance, coalesce(max(dist) OVER (PARTITION BY circuit_id, component), 0) AS component_max
        FROM gcomp LEFT JOIN (SELECT * FROM (WITH RECURSIVE r AS (SELECT circuit_id, gate_id, 0 AS h FROM {s}_gates UNION SELECT s.circuit_id, s.dst, h + 1 FROM r
        JOIN sym s ON s.circuit_id = r.circuit_id AND s.src = r.gate_id WHERE h < 25) SELECT circuit_id, gate_id, min(h) AS dist FROM r GROUP BY 1, 2))
        USING (circuit_id, gate_id)""" for s in ("pi", "po")}, **GCOMP}


@query("hop_distance", "SELECT circuit_id, gate_id, component, distance, component_max FROM hop_pi", **HOP_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    sym = materialise(graph.symmetric(t.edges), "sym")
    comp = materialise(graph.gate_components(t.gates, sym), "comp")
    return graph.hop_distance(sym, pi_gates(t), comp)


CONE_SQL = {"cone": """SELECT * FROM (WITH RECURSIVE c AS (SELECT DISTINCT p.circuit_id, b.bus AS root, p.gate_id FROM bus_bits b JOIN pins p USING (circuit_id, net)
    WHERE b.kind <> 'input' AND p.direction = 'output' UNION SELECT c.circuit_id, c.root, d.src FROM c JOIN edges d ON d.circuit_id = c.circuit_id AND d.dst = c.gate_id)
    SELECT * FROM c)"""}


def bus_cones(t):
    bits = t.bus_bits.filter("kind <> 'input'").select("circuit_id", "net", F.col("bus").alias("root"))
    roots = t.pins.filter("direction = 'output'").join(bits, ["circuit_id", "net"]).select("circuit_id", "root", "gate_id")
    return graph.cones(t.edges, roots)


@query("cones", "SELECT * FROM cone", **CONE_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return bus_cones(t)


SUPPORT_SQL = {
    "src_net": "SELECT circuit_id, net FROM ports WHERE port_dir = 'input'",
    "inner_edge": """SELECT DISTINCT d.circuit_id, d.gate_id AS src, r.gate_id AS dst FROM pins d JOIN pins r ON d.circuit_id = r.circuit_id AND d.net = r.net
        WHERE d.direction = 'output' AND r.direction = 'input' AND d.gate_id <> r.gate_id
        AND NOT EXISTS (SELECT 1 FROM src_net s WHERE s.circuit_id = d.circuit_id AND s.net = d.net)""",
    "support": """SELECT * FROM (WITH RECURSIVE s AS (SELECT DISTINCT p.circuit_id, p.net AS source, p.gate_id FROM pins p JOIN src_net USING (circuit_id, net)
        WHERE direction = 'input' UNION SELECT s.circuit_id, s.source, e.dst FROM s JOIN inner_edge e ON e.circuit_id = s.circuit_id AND e.src = s.gate_id)
        SELECT * FROM s)""",
}


def input_support(t):
    return graph.support(t.pins, t.ports.filter("port_dir = 'input'"))


def input_sets(t):
    return graph.support_sets(t.pins, t.ports.filter("port_dir = 'input'"))


@query("support_sets", "SELECT * FROM support", **SUPPORT_SQL)
def _(spark, d):
    return input_support(B.tables(spark, d))


@query("driven_support", """SELECT DISTINCT p.circuit_id, p.net, s.source FROM pins p JOIN ports o USING (circuit_id, net)
    JOIN support s ON s.circuit_id = p.circuit_id AND s.gate_id = p.gate_id WHERE o.port_dir = 'output' AND p.direction = 'output'""", **SUPPORT_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return graph.driven_support(input_sets(t), t.pins, t.ports.filter("port_dir = 'output'"))


def _pairs(gates):
    return gates.groupBy("circuit_id", "block").agg(F.min("gate_id").alias("from_id"), F.max("gate_id").alias("to_id")).drop("block")


@query("trace_path", """SELECT circuit_id, from_id, to_id, gate_id, position, direction FROM (
    SELECT *, 'forward' AS direction FROM fpath UNION ALL
    SELECT *, 'reverse' FROM rpath r WHERE NOT EXISTS (SELECT 1 FROM fpath f WHERE f.circuit_id = r.circuit_id AND f.from_id = r.from_id AND f.to_id = r.to_id))""",
       pair="SELECT DISTINCT circuit_id, min(gate_id) AS from_id, max(gate_id) AS to_id FROM gates GROUP BY circuit_id, block",
       **{f"{k}path": f"""SELECT * FROM (WITH RECURSIVE b AS (SELECT circuit_id, from_id, to_id, {z} AS gate_id, 0 AS h FROM pair
         UNION SELECT b.circuit_id, b.from_id, b.to_id, d.src, h + 1 FROM b JOIN edges d ON d.circuit_id = b.circuit_id AND d.dst = b.gate_id WHERE h < 20 AND b.gate_id <> b.{a}),
         dist AS (SELECT circuit_id, from_id, to_id, gate_id, min(h) AS h FROM b GROUP BY ALL),
         p AS (SELECT circuit_id, from_id, to_id, gate_id, h, 0 AS position FROM dist WHERE gate_id = {a}
           UNION ALL SELECT p.circuit_id, p.from_id, p.to_id, n.dst, p.h - 1, p.position + 1 FROM p JOIN (
             SELECT e.circuit_id, x.from_id, x.to_id, e.src, y.h, min(e.dst) AS dst FROM edges e JOIN dist x ON x.circuit_id = e.circuit_id AND x.gate_id = e.src
             JOIN dist y ON y.circuit_id = e.circuit_id AND y.gate_id = e.dst AND y.from_id = x.from_id AND y.to_id = x.to_id
             WHERE y.h = x.h - 1 GROUP BY ALL) n ON n.circuit_id = p.circuit_id AND n.from_id = p.from_id AND n.to_id = p.to_id AND n.src = p.gate_id)
         SELECT circuit_id, from_id, to_id, gate_id, position FROM p)""" for k, a, z in (("f", "from_id", "to_id"), ("r", "to_id", "from_id"))})
def _(spark, d):
    t = B.tables(spark, d)
    return graph.trace_path(t.edges, _pairs(t.gates))


NEAR_SQL = {"near": """SELECT circuit_id, center, gate_id, hop, row_number() OVER (PARTITION BY circuit_id, center ORDER BY hop, gate_id) AS rank FROM (
    SELECT circuit_id, center, gate_id, min(hop) AS hop FROM (
      SELECT circuit_id, gate_id AS center, gate_id, 0 AS hop FROM gates WHERE family = 'ADDF'
      UNION ALL SELECT g.circuit_id, g.gate_id, s.dst, 1 FROM gates g JOIN sym s ON s.circuit_id = g.circuit_id AND s.src = g.gate_id WHERE family = 'ADDF'
      UNION ALL SELECT g.circuit_id, g.gate_id, s2.dst, 2 FROM gates g JOIN sym s ON s.circuit_id = g.circuit_id AND s.src = g.gate_id
        JOIN sym s2 ON s2.circuit_id = s.circuit_id AND s2.src = s.dst WHERE family = 'ADDF') GROUP BY 1, 2, 3) QUALIFY rank <= 50"""}


@query("neighbourhood", "SELECT * FROM near", **NEAR_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return graph.neighbourhood(t.edges, t.gates.filter("cell like 'ADDF%'"), hops=2)


@query("neighbourhood_edges", """SELECT e.circuit_id, a.center, e.src, e.dst FROM edges e JOIN near a ON a.circuit_id = e.circuit_id AND a.gate_id = e.src
    JOIN near b ON b.circuit_id = e.circuit_id AND b.gate_id = e.dst AND a.center = b.center""", **NEAR_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    near = materialise(graph.neighbourhood(t.edges, t.gates.filter("cell like 'ADDF%'"), hops=2), "near")
    return graph.induced_edges(t.edges, near)


CHAIN_SQL = {
    "links": """SELECT DISTINCT a.circuit_id, a.gate_id AS src, b.gate_id AS dst FROM pins a JOIN pins b USING (circuit_id, net)
        JOIN gates g ON g.circuit_id = a.circuit_id AND g.gate_id = a.gate_id JOIN gates h ON h.circuit_id = b.circuit_id AND h.gate_id = b.gate_id
        WHERE a.pin = 'CO' AND b.pin = 'CI' AND g.family = 'ADDF' AND h.family = 'ADDF'""",
    "chains": """SELECT * FROM (WITH RECURSIVE nxt AS (SELECT circuit_id, src, min(dst) AS dst FROM links GROUP BY 1, 2),
        w AS (SELECT DISTINCT circuit_id, src AS head, src AS gate_id, 0 AS position FROM links l WHERE NOT EXISTS (SELECT 1 FROM links m WHERE m.circuit_id = l.circuit_id AND m.dst = l.src)
          UNION ALL SELECT w.circuit_id, w.head, n.dst, position + 1 FROM w JOIN nxt n ON n.circuit_id = w.circuit_id AND n.src = w.gate_id WHERE position < 60),
        f AS (SELECT circuit_id, head, gate_id, min(position) AS position FROM w GROUP BY 1, 2, 3)
        SELECT circuit_id, head, count(*) OVER (PARTITION BY circuit_id, head) AS length, position, gate_id FROM f)""",
}


@query("carry_chains", "SELECT * FROM chains WHERE length >= 3", **CHAIN_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return graph.link_chains(graph.carry_links(t.gates, t.pins))


SDEG = {"sdeg": "SELECT circuit_id, src AS gate_id, count(*) AS degree FROM sym GROUP BY 1, 2",
        "tri": """SELECT a.circuit_id, a.src AS gate_id, count(*) // 2 AS triangles FROM sym a JOIN sym b ON b.circuit_id = a.circuit_id AND b.src = a.dst
            JOIN sym c ON c.circuit_id = b.circuit_id AND c.src = b.dst AND c.dst = a.src GROUP BY 1, 2""",
        "clus": """SELECT circuit_id, gate_id, degree, coalesce(triangles, 0) AS triangles,
            coalesce(triangles, 0) / greatest(degree * (degree - 1) / 2.0, 1.0)::DOUBLE AS clustering FROM sdeg LEFT JOIN tri USING (circuit_id, gate_id)""",
        "two": """SELECT circuit_id, gate_id, count(*) AS reach2, sum(n * n)::BIGINT AS two_path_sq FROM (SELECT circuit_id, gate_id, far, sum(n)::BIGINT AS n FROM (
            SELECT a.circuit_id, a.src AS gate_id, b.dst AS far, count(*) AS n FROM sym a JOIN sym b ON b.circuit_id = a.circuit_id AND b.src = a.dst GROUP BY 1, 2, 3
            UNION ALL SELECT circuit_id, src, dst, 0 FROM sym) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "nd": """SELECT s.circuit_id, s.src AS gate_id, avg(degree) AS nd_mean, max(degree) AS nd_max FROM sym s JOIN sdeg d ON d.circuit_id = s.circuit_id AND d.gate_id = s.dst GROUP BY 1, 2"""}


def _sym(spark, d):
    return materialise(graph.symmetric(B.tables(spark, d).edges), "sym")


@query("triangles", "SELECT * FROM tri", **SDEG)
def _(spark, d):
    return graph.triangles(_sym(spark, d))


@query("clustering", "SELECT circuit_id, gate_id, degree, triangles, round(clustering, 6) AS clustering FROM clus", **SDEG)
def _(spark, d):
    s = _sym(spark, d)
    return graph.clustering(s, graph.triangles(s)).withColumn("clustering", F.round("clustering", 6))


@query("two_hop", "SELECT * FROM two", **SDEG)
def _(spark, d):
    return graph.two_hop(_sym(spark, d))


@query("neighbour_degree", "SELECT circuit_id, gate_id, round(nd_mean, 6) AS nd_mean, nd_max FROM nd", **SDEG)
def _(spark, d):
    return graph.neighbour_degree(_sym(spark, d)).withColumn("nd_mean", F.round("nd_mean", 6))


_PR = {"r0": "SELECT circuit_id, gate_id, 1.0::DOUBLE / (SELECT count(*) FROM sdeg) AS rank FROM sdeg", **{
    f"r{i}": f"""SELECT s.circuit_id, s.dst AS gate_id, 0.1::DOUBLE / (SELECT count(*) FROM sdeg) + 0.9::DOUBLE * sum(r.rank / d.degree) AS rank
    FROM sym s JOIN sdeg d ON d.circuit_id = s.circuit_id AND d.gate_id = s.src JOIN r{i - 1} r ON r.circuit_id = s.circuit_id AND r.gate_id = s.src GROUP BY 1, 2"""
    for i in range(1, 7)}}


@query("pagerank", "SELECT circuit_id, gate_id, round(rank * 1000000, 4) AS rank FROM r6", **_PR, **SDEG)
def _(spark, d):
    return graph.pagerank(_sym(spark, d), rounds=6).withColumn("rank", F.round(F.col("rank") * 1000000, 4))
