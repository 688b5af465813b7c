"""Registered queries: repairs, faults, sampling and learning."""

from pyspark.sql import functions as F

from wireloom.operators import checks, evaluation, faults, graph, learning, repair, sampling
from wireloom.operators.scale import materialise
from wireloom.plans import bindings as B
from wireloom.plans.q_checks import CHECK_SQL
from wireloom.plans.q_features import bound_features, rnd
from wireloom.plans.registry import query

C = "circuit_id"
KEYS = [C, "gate_id"]
_M = ("m_missing_pin", "m_floating_net", "m_undriven_po", "m_dangling_output", "m_multi_driver", "m_unused_pi")
REP = {
    "sink": """SELECT circuit_id, concat_ws('.', 'pin', gate_id::VARCHAR, pin, net) AS sink_id, 'pin' AS kind, gate_id, pin, net, hier_prefix AS block, m."check" = 'missing_pin' AS allow_pi FROM (
          SELECT * FROM m_missing_pin WHERE severity = 'error' UNION ALL SELECT * FROM m_floating_net) m JOIN gates USING (circuit_id, gate_id)
        UNION ALL SELECT circuit_id, 'po.' || net, 'po', NULL, NULL, net, NULL, true FROM m_undriven_po""",
    "source": """SELECT circuit_id, CASE WHEN m."check" = 'multi_driver' THEN 'm.' ELSE 'd.' END || gate_id || '.' || pin || '.' || net AS source_id, 'gate' AS kind, gate_id, pin, net,
          hier_prefix AS block, CASE WHEN m."check" = 'multi_driver' THEN 1 ELSE 0 END AS penalty FROM (SELECT * FROM m_dangling_output UNION ALL SELECT * FROM m_multi_driver WHERE gate_id IS NOT NULL) m
          JOIN gates USING (circuit_id, gate_id) UNION ALL SELECT circuit_id, 'pi.' || net, 'pi', NULL, NULL, net, NULL, 0 FROM m_unused_pi""",
    "pair": """SELECT k.circuit_id, k.sink_id, s.source_id, 1 - penalty + CASE WHEN k.kind = 'pin' AND s.kind = 'gate' THEN CASE WHEN k.block = s.block THEN 3 ELSE 0 END
          + CASE WHEN s.pin = 'CO' THEN CASE WHEN k.pin = 'CI' THEN 4 ELSE 0 END ELSE CASE WHEN k.pin = 'CI' THEN -1 ELSE 0 END END - least(abs(s.gate_id - k.gate_id), 1000) / 1000.0::DOUBLE ELSE 0 END
          + CASE WHEN k.kind = 'po' AND s.kind = 'pi' THEN -2 ELSE 0 END
          + CASE WHEN (k.kind = 'pin' OR s.kind = 'gate') AND k.net <> '' AND s.net <> '' AND regexp_replace(k.net, '[\\d\\[\\]]+', '', 'g') = regexp_replace(s.net, '[\\d\\[\\]]+', '', 'g') THEN 1 ELSE 0 END AS score
        FROM sink k JOIN source s USING (circuit_id) WHERE (k.allow_pi OR s.kind <> 'pi') AND k.gate_id IS DISTINCT FROM coalesce(s.gate_id, -1)""",
    **{k: CHECK_SQL[k] for k in _M}}


@query("repair_candidates", "SELECT circuit_id, sink_id, round(max(score), 6) AS score FROM pair GROUP BY 1, 2", **REP)
def _(spark, d):
    """Best score of every broken end; the oracle scores all pairs of a circuit."""
    sinks, sources = repair.broken_ends(B.tables(spark, d))
    b = repair.best_sources(materialise(sinks, "sinks"), materialise(sources, "sources"))
    return b.select(C, "sink_id", F.round("score", 6).alias("score"))


@query("repair_confidence", """SELECT circuit_id, sink_id, round(best, 6) AS score, CASE WHEN second IS NULL OR round(best - second, 9) >= 2 THEN 0.9 WHEN round(best - second, 9) >= 0.5 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM (
    SELECT circuit_id, sink_id, max(score) AS best, max(score) FILTER (k = 2) AS second FROM (SELECT *, row_number() OVER (PARTITION BY circuit_id, sink_id ORDER BY score DESC, source_id DESC) AS k FROM pair) GROUP BY 1, 2)""", **REP)
def _(spark, d):
    """Margin between the two best sources of every broken end."""
    sinks, sources = repair.broken_ends(B.tables(spark, d))
    b = materialise(repair.best_sources(materialise(sinks, "sinks"), materialise(sources, "sources"), 2), "candidates")
    return repair.margin_confidence(b.filter("candidate = 1"), b).select(C, "sink_id", F.round("score", 6).alias("score"), "confidence")


#: Every circuit's broken ends one after the other, with the list of the sources that are used up.
GREEDY = {
    "turn": "SELECT circuit_id, sink_id, row_number() OVER (PARTITION BY circuit_id ORDER BY max(round(score, 9)) DESC, sink_id DESC) AS k FROM pair GROUP BY 1, 2",
    "greedy": """SELECT * FROM (WITH RECURSIVE g AS (SELECT DISTINCT circuit_id, 0::BIGINT AS k, []::VARCHAR[] AS used, ''::VARCHAR AS sink_id, []::STRUCT(score DOUBLE, source_id VARCHAR)[] AS best FROM turn
        UNION ALL SELECT circuit_id, k, CASE WHEN len(best) = 0 OR best[1].source_id LIKE 'm.%' THEN used ELSE list_append(used, best[1].source_id) END, sink_id, best FROM (
          SELECT g.circuit_id, g.k + 1 AS k, any_value(g.used) AS used, o.sink_id, list_reverse_sort(coalesce(list({'score': round(p.score, 9), 'source_id': p.source_id}) FILTER (p.source_id IS NOT NULL), []))[1:2] AS best
          FROM g JOIN turn o ON o.circuit_id = g.circuit_id AND o.k = g.k + 1
          LEFT JOIN pair p ON p.circuit_id = o.circuit_id AND p.sink_id = o.sink_id AND NOT list_contains(g.used, p.source_id) GROUP BY g.circuit_id, g.k, o.sink_id))
        SELECT circuit_id, sink_id, best[1].source_id AS source_id, best[1].score AS score, best[2].score AS second FROM g WHERE len(best) > 0)""",
    "link": """SELECT g.circuit_id, g.sink_id, d.gate_id AS from_gate, d.pin AS from_pin, d.net AS from_net, CASE WHEN g.source_id LIKE 'm.%' THEN round(1.0::DOUBLE / count(*) OVER (PARTITION BY g.circuit_id, g.sink_id), 2)
          WHEN second IS NULL OR round(g.score - second, 9) >= 2 THEN 0.9 WHEN round(g.score - second, 9) >= 0.5 THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence, g.source_id LIKE 'm.%' AS ambiguous
        FROM greedy g JOIN source s ON s.circuit_id = g.circuit_id AND s.source_id = g.source_id JOIN source d ON d.circuit_id = s.circuit_id
          AND CASE WHEN s.source_id LIKE 'm.%' THEN d.source_id LIKE 'm.%' AND d.net = s.net ELSE d.source_id = s.source_id END""", **REP}


def bound_assignment(spark, d):
    """Assigned ends of the bound corpus and its sources."""
    sinks, sources = repair.broken_ends(B.tables(spark, d))
    sinks, sources = materialise(sinks, "sinks"), materialise(sources, "sources")
    return materialise(repair.assign(sinks, sources), "assigned"), sources


@query("repair_assignment", "SELECT circuit_id, sink_id, source_id, round(score, 6) AS score, round(coalesce(second, -99), 6) AS second FROM greedy", **GREEDY)
def _(spark, d):
    """Source of every broken end in the order of the ends' best scores; the oracle walks the ends one by one."""
    a, _ = bound_assignment(spark, d)
    return a.select(C, "sink_id", F.col("s_source_id").alias("source_id"), F.round("score", 6).alias("score"), F.round(F.coalesce("second", F.lit(-99.0)), 6).alias("second"))


@query("repair_links", "SELECT * FROM link", **GREEDY)
def _(spark, d):
    """Suggested wires with their confidence: by the margin to what else was free, or shared by the drivers of a net."""
    return repair.confidence(*bound_assignment(spark, d))


@query("inherited_repairs", """SELECT DISTINCT l.circuit_id, 'b' || b.bus AS subject, k.gate_id AS to_gate, k.pin AS to_pin, from_gate, from_pin FROM link l JOIN sink k USING (circuit_id, sink_id)
    JOIN (SELECT DISTINCT circuit_id, bus, gate_id FROM bus_bits JOIN pins USING (circuit_id, net) WHERE kind = 'output' AND direction = 'output') b ON b.circuit_id = k.circuit_id AND b.gate_id = k.gate_id
    WHERE k.kind = 'pin'""", **GREEDY)
def _(spark, d):
    """Output buses inherit the suggested wires of the broken pins on the gates that drive them."""
    t = B.tables(spark, d)
    a, sources = bound_assignment(spark, d)
    to = a.filter("kind = 'pin'").select(C, "sink_id", F.col("gate_id").alias("to_gate"), F.col("pin").alias("to_pin"))
    rep = repair.confidence(a, sources).join(to, [C, "sink_id"])
    s = (t.bus_bits.filter("kind = 'output'").join(t.pins.filter("direction = 'output'"), [C, "net"])
         .select(C, F.concat(F.lit("b"), "bus").alias("subject"), "gate_id").distinct())
    return repair.inherit_repairs(s, rep)


@query("verified_repairs", """SELECT circuit_id, sink_id, candidate, matching, matching = n AS accepted, CASE k WHEN 0 THEN 'no_fix_found' WHEN 1 THEN 'verified' ELSE 'equivalent' END AS verdict FROM (
    SELECT *, count(*) FILTER (matching = n) OVER (PARTITION BY circuit_id, sink_id) AS k FROM (
      SELECT a.circuit_id, a.pin AS sink_id, b.pin AS candidate, count(*) FILTER (a.v = b.v) AS matching, any_value((SELECT count(*) FROM resp z WHERE z.circuit_id = a.circuit_id AND z.pin = a.pin)) AS n
      FROM resp a JOIN resp b ON a.circuit_id = b.circuit_id AND a.gate_id = b.gate_id GROUP BY 1, 2, 3))""",
       resp="SELECT circuit_id, pin, gate_id, (count(*) > 1)::INT AS v FROM pins GROUP BY 1, 2, 3")
def _(spark, d):
    """Recorded response of a pin at a gate: whether it has more than one net. Every pin is tried as a repair of every pin."""
    v = B.bound_pins(spark, d).groupBy(C, "pin", "gate_id").agg((F.count(F.lit(1)) > 1).cast("int").alias("value"))
    exp = v.select(C, F.col("pin").alias("sink_id"), F.col("gate_id").alias("row_id"), "value")
    res = v.select(C, F.col("pin").alias("candidate"), F.col("gate_id").alias("row_id"), "value").join(exp.select(C, "sink_id", "row_id"), [C, "row_id"])
    return repair.verify_candidates(res, exp)


@query("signature_alignment", """SELECT count(*) AS paired, count(*) FILTER (true) AS same FROM gates""")
def _(spark, d):
    """Every circuit aligned with itself: by unique signature or by name, each gate meets itself."""
    t = B.tables(spark, d)
    s = materialise(repair.gate_signatures(t.gates, t.pins).join(t.gates.select(*KEYS, "inst"), KEYS), "signatures")
    a = repair.align_by_signature(s, s)
    return a.agg(F.count(F.lit(1)).alias("paired"), F.count_if(F.col("gate_a") == F.col("gate_b")).alias("same"))


@query("fault_sites", """SELECT circuit_id, r.gate_id, r.pin, net, p.gate_id AS from_gate, p.pin AS from_pin FROM pins r JOIN pins p USING (circuit_id, net) JOIN nets n USING (circuit_id, net)
    WHERE r.direction = 'input' AND p.direction = 'output' AND n_drivers = 1 AND n_readers = 1 AND gate_drivers = 1 AND gate_readers = 1 AND r.gate_id <> p.gate_id""")
def _(spark, d):
    return faults.fault_sites(B.tables(spark, d), "drop_pin").select(C, "gate_id", "pin", "net", "from_gate", "from_pin")


@query("injected_pins", "SELECT circuit_id, count(*) - (max(link) > 0)::INT AS pins FROM (SELECT p.*, (EXISTS (SELECT 1 FROM link l WHERE l.circuit_id = p.circuit_id))::INT AS link FROM pins p) GROUP BY 1",
       link="""SELECT r.circuit_id FROM pins r JOIN pins p USING (circuit_id, net) JOIN nets n USING (circuit_id, net) WHERE r.direction = 'input' AND p.direction = 'output' AND n_drivers = 1
         AND n_readers = 1 AND gate_drivers = 1 AND gate_readers = 1 AND r.gate_id <> p.gate_id""")
def _(spark, d):
    """One pin less in every circuit that has a site for a dropped pin."""
    return faults.inject(B.tables(spark, d), "drop_pin", 7)[0].groupBy(C).agg(F.count(F.lit(1)).alias("pins"))


@query("detection_matrix")
def _(spark, d):
    """Recall of the electrical checks for the four fault kinds the bound circuits have sites for."""
    from dataclasses import replace
    t = B.tables(spark, d)
    out = None
    for kind, check in (("drop_pin", checks.check_missing_pin), ("float_net", checks.check_floating_net), ("second_driver", checks.check_multi_driver), ("disconnect_po", checks.check_undriven_po)):
        pins, truth = faults.inject(t, kind, 1)
        f = replace(t, pins=materialise(pins, "faulty"))
        m = faults.detection_matrix(check(f), truth)
        out = m if out is None else out.union(m)
    return out


# ------------------------------------------------------------------ sampling
def train_gates(t):
    return B.bound_splits(t.gates).filter("split = 'tr'").select(*KEYS)


SAMPLE = {"smp": "SELECT label AS sample_id, circuit_id, gate_id FROM splits WHERE split = 'tr' UNION SELECT label, e.circuit_id, e.dst FROM splits s JOIN edges e ON e.circuit_id = s.circuit_id AND e.src = s.gate_id WHERE split = 'tr'"}
SAMPLE["ind"] = """SELECT a.sample_id, e.circuit_id, e.src, e.dst, a.i AS new_src, b.i AS new_dst, e.edge_id FROM (SELECT *, row_number() OVER (ORDER BY circuit_id, src, dst) - 1 AS edge_id FROM edges) e
    JOIN num a ON a.circuit_id = e.circuit_id AND a.gate_id = e.src JOIN num b ON b.circuit_id = e.circuit_id AND b.gate_id = e.dst AND a.sample_id = b.sample_id"""
SAMPLE["num"] = "SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY circuit_id, gate_id) - 1 AS i FROM smp"


def bound_samples(t):
    """Five subgraphs: the train gates of each class and the gates they feed."""
    s = B.bound_splits(t.gates).filter("split = 'tr'").select(F.col("label").alias("sample_id"), *KEYS)
    return s.union(s.join(t.edges.withColumnRenamed("src", "gate_id"), KEYS).select("sample_id", C, F.col("dst").alias("gate_id"))).distinct()


@query("induced_subgraphs", "SELECT * FROM ind", **SAMPLE)
def _(spark, d):
    t = B.tables(spark, d)
    return sampling.induced(t.edges, bound_samples(t))


@query("edge_norms", """SELECT circuit_id, src, dst, coalesce(nc, 0) AS node_count, coalesce(ec, 0) AS edge_count, round(CASE WHEN nc IS NULL AND ec IS NULL THEN 0.1 WHEN ec IS NULL THEN 10000 ELSE least(nc / ec, 10000) END, 6) AS alpha
    FROM edges LEFT JOIN (SELECT circuit_id, gate_id AS src, count(*) AS nc FROM smp GROUP BY 1, 2) USING (circuit_id, src) LEFT JOIN (SELECT circuit_id, src, dst, count(*) AS ec FROM ind GROUP BY 1, 2, 3) USING (circuit_id, src, dst)""", **SAMPLE)
def _(spark, d):
    t = B.tables(spark, d)
    s = materialise(bound_samples(t), "samples")
    return rnd(sampling.sampling_norms(s, sampling.induced(t.edges, s), t.edges, train_gates(t), 5)[0])


@query("loss_weights", """SELECT circuit_id, gate_id, round(5.0::DOUBLE / coalesce(nc, 0.1) / (SELECT count(*) FROM splits WHERE split = 'tr') * 1000, 6) AS loss_weight FROM splits
    LEFT JOIN (SELECT circuit_id, gate_id, count(*)::DOUBLE AS nc FROM smp GROUP BY 1, 2) USING (circuit_id, gate_id) WHERE split = 'tr'""", **SAMPLE)
def _(spark, d):
    t = B.tables(spark, d)
    s = materialise(bound_samples(t), "samples")
    w = sampling.sampling_norms(s, sampling.induced(t.edges, s), t.edges, train_gates(t), 5)[1]
    return w.withColumn("loss_weight", F.round(F.col("loss_weight") * 1000, 6))


@query("planned_samples", """SELECT sample_id, gates, covered, covered - gates <= 2 * n AS needed, ceil(n / 1000.0)::BIGINT AS batches_per_epoch FROM (SELECT *, sum(gates) OVER (ORDER BY sample_id)::BIGINT AS covered,
    (SELECT count(*) FROM splits WHERE split = 'tr') AS n FROM (SELECT circuit_id AS sample_id, count(*) AS gates FROM gates GROUP BY 1))""")
def _(spark, d):
    """Circuits taken as the drawn subgraphs, coverage 2, budget 1000."""
    t = B.tables(spark, d)
    sizes = t.gates.groupBy(F.col(C).alias("sample_id")).agg(F.count(F.lit(1)).alias("gates"))
    return sampling.plan_samples(sizes, train_gates(t).count(), 2.0, 1000)


for _name, _fn in (("sampled_walks", lambda t, tr: sampling.sample_rw(t.edges, tr, 8, 50, 2, 1)),
                   ("sampled_edges", lambda t, tr: sampling.sample_edges(t.edges, 4, 200, 1)),
                   ("sampled_edge_draws", lambda t, tr: sampling.sample_edges(t.edges, 4, 200, 1, "draw")),
                   ("sampled_nodes", lambda t, tr: sampling.sample_nodes(t.edges, tr, 4, 200, 1)),
                   ("sampled_frontier", lambda t, tr: sampling.sample_frontier(t.edges, tr, 4, 20, 6, 1))):
    def _run(spark, d, f=_fn):
        t = B.tables(spark, d)
        return f(t, train_gates(t))
    query(_name)(_run)


@query("weighted_draws", """SELECT sample_id, 1000 AS draws, 1000 AS on_edges, true AS near_share FROM (SELECT unnest(range(4))::INT AS sample_id) WHERE EXISTS (FROM edges)""")
def _(spark, d):
    """Every draw meets one edge, and edges with weights over the mean get their share of all draws (to a tenth)."""
    t = B.tables(spark, d)
    w = materialise(sampling.edge_weights(t.edges), "edge-weights")
    got = materialise(sampling.weighted_draws(w, "w", [C, "src", "dst"], sampling._draws(spark, 4, 1000), 3), "draws")
    mean = w.agg(F.avg("w").alias("_mean"))
    heavy = F.col("w") > F.col("_mean")
    want = w.join(F.broadcast(mean)).agg((F.sum(F.when(heavy, F.col("w"))) / F.sum("w")).alias("_want"))  # one row each
    have = got.join(F.broadcast(mean)).agg(F.avg(heavy.cast("double")).alias("_have"))
    near = have.join(F.broadcast(want)).select((F.abs(F.col("_have") - F.col("_want")) <= 0.1).alias("near_share"))
    real = got.join(graph.symmetric(t.edges), [C, "src", "dst"], "left_semi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("on_edges"))
    n = got.groupBy("sample_id").agg(F.countDistinct("k").alias("draws"))
    return n.join(real, "sample_id").join(F.broadcast(near)).select("sample_id", F.col("draws").cast("int").alias("draws"), F.col("on_edges").cast("int").alias("on_edges"), "near_share")


# ------------------------------------------------------------------ learning
@query("class_weights", """SELECT label, n AS count, round(w / (sum(w * n) OVER () / sum(n) OVER ()), 6) AS weight FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () / count(*) AS w FROM gates GROUP BY 1)""")
def _(spark, d):
    return rnd(learning.class_weights(B.bound_gates(spark, d)))


@query("width_folds", """SELECT circuit_id, gate_id, 'w32' AS fold, CASE WHEN split = 'tr' AND width = 32 THEN 'eval' WHEN split = 'tr' THEN 'fit' ELSE 'stop' END AS part FROM splits WHERE split <> 'te'
    UNION ALL SELECT circuit_id, gate_id, 'w64', CASE WHEN split = 'tr' AND width = 64 THEN 'eval' WHEN split = 'tr' THEN 'fit' ELSE 'stop' END FROM splits WHERE split <> 'te'
    UNION ALL SELECT circuit_id, gate_id, 'val', CASE WHEN split = 'tr' THEN 'fit' ELSE 'eval' END FROM splits WHERE split <> 'te'""")
def _(spark, d):
    return learning.width_folds(B.bound_splits(B.bound_gates(spark, d)))


@query("ranked_configs", """SELECT *, row_number() OVER (ORDER BY score DESC, config) AS rank FROM (SELECT block AS config, round(avg(acc), 6) AS score, count(*) AS folds FROM (
    SELECT circuit_id, block, avg((label = pred_class)::INT) AS acc FROM gates JOIN preds USING (circuit_id, gate_id) GROUP BY 1, 2) GROUP BY 1)""")
def _(spark, d):
    """Blocks as configurations, circuits as folds, accuracy in both score columns."""
    t = B.tables(spark, d)
    s = t.preds.join(t.gates.select(*KEYS, F.col("block").alias("config")), KEYS).groupBy(C, "config").agg(F.avg((F.col("true_class") == F.col("pred_class")).cast("double")).alias("accuracy"))
    return rnd(learning.rank_configs(s.withColumn("macro_f1", F.col("accuracy"))))


@query("fitted_nodes")
def _(spark, d):
    """Random forests on three gate features over the width folds, scored per fold."""
    t = B.tables(spark, d)
    f = materialise(bound_features(t).join(t.gates.select(*KEYS, "label"), KEYS), "features")
    folds = materialise(learning.width_folds(B.bound_splits(t.gates)), "folds")
    p = learning.fit_nodes(f, ["x0", "x1", "x2"], folds, seeds=(0,), trees=5, depth=4)
    return rnd(evaluation.scores(learning.predicted(p), ["fold"]), 3)
