"""Registered queries: features, evaluation and dataset tables."""

from pyspark.sql import functions as F

from wireloom.operators import evaluation as E
from wireloom.operators import features as X
from wireloom.operators import graph, model
from wireloom.operators.scale import materialise, shared_dir
from wireloom.plans import bindings as B
from wireloom.plans.q_graph import GCOMP, HOP_SQL, LEVEL_SQL, SDEG, SUPPORT_SQL, bound_levels, input_support, pi_gates
from wireloom.plans.registry import query as register
from wireloom.sources import datasets as D

COLS = ["x0", "x1", "x2"]
KEYS = ["circuit_id", "gate_id"]
FEAT = {"feat": """SELECT circuit_id, gate_id, in_degree::DOUBLE AS x0, out_degree::DOUBLE AS x1, drive AS x2, 1.0::DOUBLE AS x3
    FROM deg JOIN gates USING (circuit_id, gate_id)""",
        "rw": """SELECT e.circuit_id, e.src, e.dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY e.circuit_id, e.src) AS w FROM (
            SELECT * FROM sym UNION SELECT circuit_id, gate_id, gate_id FROM gates) e""",
        "sw": """SELECT a.circuit_id, a.src, a.dst, 1.0::DOUBLE / sqrt(x.n * y.n) AS w FROM rw a
            JOIN (SELECT circuit_id, src, count(*) AS n FROM rw GROUP BY 1, 2) x ON x.circuit_id = a.circuit_id AND x.src = a.src
            JOIN (SELECT circuit_id, src, count(*) AS n FROM rw GROUP BY 1, 2) y ON y.circuit_id = a.circuit_id AND y.src = a.dst""",
        **{f"{k}{i}": f"""SELECT w.circuit_id, w.src AS gate_id, sum(w * x0) AS x0, sum(w * x1) AS x1, sum(w * x2) AS x2 FROM {t} w
            JOIN {'feat' if i == 1 else k + str(i - 1)} f ON f.circuit_id = w.circuit_id AND f.gate_id = w.dst GROUP BY 1, 2"""
           for k, t in (("hr", "rw"), ("hs", "sw")) for i in (1, 2)}}


def bound_features(t):
    deg = model.degrees(t.gates, t.edges)
    g = model.decode_cells(t.gates).select(*KEYS, "drive")
    return deg.join(g, KEYS).select(*KEYS, F.col("in_degree").cast("double").alias("x0"),
                                    F.col("out_degree").cast("double").alias("x1"), F.col("drive").alias("x2"),
                                    F.lit(1.0).alias("x3"))


NUDGE = 1e-9


def rnd(df, digits=6, nudge=0.0):
    """Round every double column: sums in a different order differ in the last bits.

    `nudge` moves exact ties off the rounding border, where those bits would decide.
    """
    return df.select(*[F.round(F.col(n) + F.lit(nudge), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def query(name, sql=None, **ctes):
    """Register with the same nudge inside every rounding of the SQL."""
    return register(name, sql and sql.replace("round(", f"round({NUDGE}::DOUBLE + "), **ctes)


def r6(*cols, t=""):
    return ", ".join(f"round({t}{c}, 6) AS {c}" for c in cols)


@query("scaled_features", f"""SELECT circuit_id, gate_id, {", ".join(f"round(({c} - m{c}) / s{c}, 6) AS {c}" for c in COLS)} FROM feat,
    (SELECT {", ".join(f"avg({c}) AS m{c}, stddev_pop({c}) AS s{c}" for c in COLS)} FROM feat JOIN splits USING (circuit_id, gate_id) WHERE split = 'tr')""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.scale_train_only(bound_features(t), B.bound_splits(t.gates).filter("split = 'tr'"), COLS + ["x3"]), nudge=NUDGE)


@query("feature_audit", """SELECT * FROM (SELECT 'x0' AS "column", min(x0) AS low, max(x0) AS high, min(x0) = max(x0) AS constant FROM feat
    UNION ALL SELECT 'x1', min(x1), max(x1), min(x1) = max(x1) FROM feat UNION ALL SELECT 'x2', min(x2), max(x2), min(x2) = max(x2) FROM feat
    UNION ALL SELECT 'x3', min(x3), max(x3), min(x3) = max(x3) FROM feat)""", **FEAT)
def _(spark, d):
    return X.constant_columns(bound_features(B.tables(spark, d)), COLS + ["x3"])


@query("scaling_audit", "SELECT unnest(['x0', 'x1', 'x2']) AS \"column\", 0.0::DOUBLE AS max_difference")
def _(spark, d):
    """Stored scaled features against a second scaling of the raw ones: no difference expected."""
    t = B.tables(spark, d)
    f = materialise(bound_features(t), "features")
    train = B.bound_splits(t.gates).filter("split = 'tr'")
    scaled = materialise(X.scale_train_only(f, train, COLS), "scaled")
    return rnd(E.audit_scaling(f, scaled, train, COLS), nudge=NUDGE)


@query("mean_aggregate", f"""SELECT s.circuit_id, s.src AS gate_id, {", ".join(f"round(avg({c}), 6) AS {c}" for c in COLS)} FROM sym s
    JOIN feat f ON f.circuit_id = s.circuit_id AND f.gate_id = s.dst GROUP BY 1, 2""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.mean_aggregate(bound_features(t), t.edges, COLS), nudge=NUDGE)


@query("sym_aggregate", f"SELECT circuit_id, gate_id, {r6(*COLS)} FROM hs1", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.aggregate(bound_features(t), X.sym_weights(t.edges, t.gates), COLS), nudge=NUDGE)


_PROP = ", ".join([r6(*COLS, t="f.")] + [f"round({k}.{c}, 6) AS {c}_{n}" for k, n in (("a", "rw1"), ("b", "rw2"), ("c", "sym1"), ("e", "sym2")) for c in COLS])


@query("propagated_features", f"""SELECT circuit_id, gate_id, {_PROP} FROM feat f JOIN hr1 a USING (circuit_id, gate_id)
    JOIN hr2 b USING (circuit_id, gate_id) JOIN hs1 c USING (circuit_id, gate_id) JOIN hs2 e USING (circuit_id, gate_id)""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.propagate(materialise(bound_features(t), "features"), t.gates, t.edges, COLS), nudge=NUDGE)


@query("directed_features", f"""SELECT circuit_id, gate_id, {", ".join(f"round({c}_in, 6) AS {c}_in, round({c}_out, 6) AS {c}_out" for c in COLS)} FROM
    (SELECT e.circuit_id, e.dst AS gate_id, {", ".join(f"avg({c}) AS {c}_in" for c in COLS)} FROM loops e JOIN feat f ON f.circuit_id = e.circuit_id AND f.gate_id = e.src GROUP BY 1, 2)
    JOIN (SELECT e.circuit_id, e.src AS gate_id, {", ".join(f"avg({c}) AS {c}_out" for c in COLS)} FROM loops e JOIN feat f ON f.circuit_id = e.circuit_id AND f.gate_id = e.dst GROUP BY 1, 2)
    USING (circuit_id, gate_id)""", loops="SELECT * FROM edges UNION ALL SELECT circuit_id, gate_id, gate_id FROM gates", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.propagate_directed(bound_features(t), t.gates, t.edges, COLS), nudge=NUDGE)


@query("combined_hops", """SELECT circuit_id, gate_id, round(greatest(f.x0, a.x0), 6) AS m0, round(greatest(f.x1, a.x1), 6) AS m1, round((f.x2 + a.x2) / 2, 6) AS a2
    FROM feat f JOIN hr1 a USING (circuit_id, gate_id)""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    p = X.propagate(materialise(bound_features(t), "features"), t.gates, t.edges, COLS, hops=1, sym=0)
    hops = [COLS, [f"{c}_rw1" for c in COLS]]
    mx = X.combine_hops(p, hops, "max").withColumnRenamed("features", "mx")
    av = X.combine_hops(p, hops, "mean").withColumnRenamed("features", "av")
    return rnd(mx.join(av, KEYS).select(*KEYS, F.col("mx")[0].alias("m0"), F.col("mx")[1].alias("m1"), F.col("av")[2].alias("a2")), nudge=NUDGE)


@query("pooled_neighbours", f"""SELECT s.circuit_id, s.src AS gate_id, {", ".join(f"max({c}) AS {c}_max, round(avg({c}), 6) AS {c}_mean" for c in COLS)} FROM sym s
    JOIN feat f ON f.circuit_id = s.circuit_id AND f.gate_id = s.dst GROUP BY 1, 2""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.pool_neighbours(bound_features(t), graph.symmetric(t.edges), COLS), nudge=NUDGE)


A_SELF, A_NEIGH = (0.5, -0.25, 0.01), (0.1, 0.2, -0.02)
_DOT = lambda p, v: "greatest(" + " + ".join(f"{p}.{c} * {w}::DOUBLE" for c, w in zip(COLS, v)) + ", 0)"


@query("attention_aggregate", f"""SELECT w.circuit_id, w.src AS gate_id, {", ".join(f"round(sum(w.w * ({_DOT('a', A_SELF)} + {_DOT('b', A_NEIGH)}) * b.{c}), 6) AS {c}" for c in COLS)}
    FROM rw w JOIN feat a ON a.circuit_id = w.circuit_id AND a.gate_id = w.src JOIN feat b ON b.circuit_id = w.circuit_id AND b.gate_id = w.dst GROUP BY 1, 2""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    f = materialise(bound_features(t), "features")
    return rnd(X.attention_aggregate(f, X.row_weights(t.edges, t.gates), COLS, A_SELF, A_NEIGH), nudge=NUDGE)


W1 = [(i, j, round(0.1 * (i + 1) - 0.05 * j, 2)) for i in range(3) for j in range(4)]
W2 = [(i, j, round(0.02 * (j + 1) - 0.015 * i, 3)) for i in range(4) for j in range(5)]
_VALS = lambda w: "SELECT i::INT AS i, j::INT AS j, v::DOUBLE AS v FROM (VALUES " + ", ".join(f"({a}, {b}, {v})" for a, b, v in w) + ") t(i, j, v)"


@query("gcn_score", """SELECT circuit_id, gate_id, class, round(e / sum(e) OVER (PARTITION BY circuit_id, gate_id), 6) AS p FROM (
      SELECT circuit_id, gate_id, j AS class, exp(x - max(x) OVER (PARTITION BY circuit_id, gate_id)) AS e FROM l2)""",
       w1=_VALS(W1), w2=_VALS(W2),
       flong="SELECT circuit_id, gate_id, 0 AS i, x0 AS x FROM feat UNION ALL SELECT circuit_id, gate_id, 1, x1 FROM feat UNION ALL SELECT circuit_id, gate_id, 2, x2 FROM feat",
       l1="""SELECT s.circuit_id, s.src AS gate_id, h.j AS i, greatest(sum(s.w * h.x), 0) AS x FROM sw s JOIN (
         SELECT circuit_id, gate_id, j, sum(x * v) AS x FROM flong JOIN w1 USING (i) GROUP BY 1, 2, 3) h ON h.circuit_id = s.circuit_id AND h.gate_id = s.dst GROUP BY 1, 2, 3""",
       l2="""SELECT s.circuit_id, s.src AS gate_id, h.j, sum(s.w * h.x) AS x FROM sw s JOIN (
         SELECT circuit_id, gate_id, j, sum(x * v) AS x FROM l1 JOIN w2 USING (i) GROUP BY 1, 2, 3) h ON h.circuit_id = s.circuit_id AND h.gate_id = s.dst GROUP BY 1, 2, 3""", **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    w = [spark.createDataFrame(x, "i int, j int, value double") for x in (W1, W2)]
    return rnd(X.gcn_score(bound_features(t), t.gates, t.edges, COLS, *w), nudge=NUDGE)


@query("depth_encoding", f"""SELECT circuit_id, gate_id, round(ln(count(*) OVER (PARTITION BY circuit_id, p.component)), 6) AS log_size,
    p.distance::DOUBLE AS d_pi, CASE WHEN p.distance < 0 THEN -1.0::DOUBLE ELSE round(p.distance / greatest(p.component_max, 1), 6) END AS rel_pi, round(ln(1 + p.component_max), 6) AS logmax_pi,
    o.distance::DOUBLE AS d_po, CASE WHEN o.distance < 0 THEN -1.0::DOUBLE ELSE round(o.distance / greatest(o.component_max, 1), 6) END AS rel_po, round(ln(1 + o.component_max), 6) AS logmax_po,
    CASE WHEN p.distance >= 0 AND o.distance >= 0 THEN round(p.distance / greatest(p.distance + o.distance, 1), 6) ELSE -1.0::DOUBLE END AS position
    FROM hop_pi p JOIN hop_po o USING (circuit_id, gate_id)""", **HOP_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.depth_encoding(t.gates, t.edges, pi_gates(t), model.po_gates(t.pins, t.ports)), nudge=NUDGE)


@query("structure_features", """SELECT circuit_id, gate_id, round(ln(1 + coalesce(degree, 0)), 6) AS log_degree, round(ln(1 + coalesce(triangles, 0)), 6) AS log_triangles,
    round(coalesce(clustering, 0), 6) AS clustering, round(ln(1 + coalesce(reach2, 0)), 6) AS log_reach2, round(ln(1 + coalesce(nd_mean, 0)), 6) AS log_nd_mean,
    round(ln(1 + coalesce(nd_max, 0)), 6) AS log_nd_max, round(ln(1 + coalesce(two_path_sq, 0)), 6) AS log_two_path_sq
    FROM gates LEFT JOIN clus USING (circuit_id, gate_id) LEFT JOIN two USING (circuit_id, gate_id) LEFT JOIN nd USING (circuit_id, gate_id)""", **SDEG)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.structure_features(t.edges, t.gates), nudge=NUDGE)


@query("support_features", """SELECT circuit_id, gate_id, round(coalesce(ns, 0) / greatest(n_inputs, 1), 6) AS support_share, round(ln(1 + coalesce(ns, 0)), 6) AS log_support,
    round(coalesce(nr, 0) / greatest(n_outputs, 1), 6) AS reach_share, level_in, round(level_in / max(level_in) OVER (PARTITION BY circuit_id), 6) AS level_in_share,
    level_out, round(level_out / max(level_out) OVER (PARTITION BY circuit_id), 6) AS level_out_share
    FROM levels LEFT JOIN (SELECT circuit_id, gate_id, count(*) AS ns FROM support GROUP BY 1, 2) USING (circuit_id, gate_id)
    LEFT JOIN (SELECT circuit_id, gate_id, count(DISTINCT root) AS nr FROM pocone GROUP BY 1, 2) USING (circuit_id, gate_id)
    JOIN (SELECT circuit_id, count(*) FILTER (port_dir = 'input') AS n_inputs, count(*) FILTER (port_dir = 'output') AS n_outputs FROM ports GROUP BY 1) USING (circuit_id)""",
       pocone="""SELECT * FROM (WITH RECURSIVE c AS (SELECT DISTINCT p.circuit_id, p.net AS root, p.gate_id FROM pins p JOIN ports o USING (circuit_id, net)
         WHERE port_dir = 'output' AND direction = 'output' UNION SELECT c.circuit_id, c.root, d.src FROM c JOIN edges d ON d.circuit_id = c.circuit_id AND d.dst = c.gate_id)
         SELECT * FROM c)""", **SUPPORT_SQL, **LEVEL_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    po = t.ports.filter("port_dir = 'output'").select("circuit_id", "net")
    roots = t.pins.filter("direction = 'output'").join(po, ["circuit_id", "net"]).select("circuit_id", F.col("net").alias("root"), "gate_id")
    n = lambda side, name: t.ports.filter(F.col("port_dir") == side).groupBy("circuit_id").agg(F.count(F.lit(1)).alias(name))
    return rnd(X.support_features(t.gates, input_support(t), graph.cones(t.edges, roots), bound_levels(t), n("input", "n_inputs"), n("output", "n_outputs")), nudge=NUDGE)


# ------------------------------------------------------------------ signals from the embedding table
SIG = {"samples": """SELECT vec_id AS sample_id, 's' || (pos - 1) AS signal, pos - 1 AS pos, (embedding[pos] > 0)::INT AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)""",
       "corrs": """SELECT a.signal, b.signal AS input, coalesce(CASE WHEN isnan(corr(a.value, b.value)) THEN 0 ELSE corr(a.value, b.value) END, 0) AS r
         FROM samples a JOIN samples b USING (sample_id) GROUP BY 1, 2""",
       "inf": """SELECT a.signal, b.signal AS input, b.pos, b.pos // 4 AS bus, b.pos % 4 AS bit, avg((a.value <> b.value)::INT) AS i FROM samples a JOIN samples b USING (sample_id)
         GROUP BY 1, 2, 3""",
       "bsum": "SELECT signal, max(s) AS top_bus FROM (SELECT signal, bus, sum(i) FILTER (i > 0.01) AS s FROM inf GROUP BY 1, 2) GROUP BY 1"}


def bound_samples(spark, d):
    e = B.read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("pos", "x")).select(
        "sample_id", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("signal"), "pos", (F.col("x") > 0).cast("int").alias("value"))


@query("signal_stats", """SELECT signal, round(p1, 6) AS p1, round(-(p1 * log2(p1 + 1e-12) + (1 - p1) * log2(1 - p1 + 1e-12)), 6) AS entropy
    FROM (SELECT signal, avg(value) AS p1 FROM samples GROUP BY 1)""", **SIG)
def _(spark, d):
    return rnd(X.signal_stats(bound_samples(spark, d)), nudge=NUDGE)


@query("correlation_profile", """SELECT signal, round(max(abs(r)), 6) AS max_abs, round(avg(abs(r)), 6) AS mean_abs, round(coalesce(avg(r) FILTER (abs(r) > 0.05), 0), 6) AS signed_mean,
    round(CASE WHEN count(*) FILTER (abs(r) > 0.05) > 0 THEN count(*) FILTER (r > 0.05) / count(*) FILTER (abs(r) > 0.05) ELSE 0.5 END, 6) AS positive_share,
    round(count(*) FILTER (abs(r) > 0.1) / count(*), 6) AS share_above_0_1 FROM corrs GROUP BY 1""", **SIG)
def _(spark, d):
    s = bound_samples(spark, d)
    return rnd(X.corr_profile(s, s), nudge=NUDGE)


@query("influence_profile", """SELECT signal, round(tot / npi, 6) AS mean_influence, round(ln(1 + tot), 6) AS log_total, round(first, 6) AS first, round(second, 6) AS second,
    round(full_n / npi, 6) AS full_share, round(ln(1 + full_n), 6) AS log_full, round(half / npi, 6) AS half_share, round(ent / ln(npi), 6) AS entropy, round(sup / npi, 6) AS support_share,
    round(tot / greatest(sup, 1), 6) AS mean_on_support, buses, round(buses / 16, 6) AS bus_share, round(top_bus / tot, 6) AS top_bus_share, full_buses,
    (full_n >= 2 AND full_bits < full_n AND full_buses > 1)::INT::DOUBLE AS aligned, round(ib / isup / 3, 6) AS mean_bit, round((hi - lo) / 3, 6) AS bit_span, round(hi / 3, 6) AS top_bit FROM (
      SELECT signal, any_value(tot) AS tot, any_value(npi) AS npi, max(i) AS first, max(i) FILTER (k = 2) AS second, count(*) FILTER (i > 0.9) AS full_n,
        count(*) FILTER (i > 0.3 AND i <= 0.9) AS half, sum(CASE WHEN i > 0 THEN -i / tot * ln(i / tot) ELSE 0 END) AS ent, count(*) FILTER (i > 0.01) AS sup,
        count(DISTINCT bus) FILTER (i > 0.01) AS buses, count(DISTINCT bus) FILTER (i > 0.9) AS full_buses, count(DISTINCT bit) FILTER (i > 0.9) AS full_bits,
        sum(i * bit) FILTER (i > 0.01) AS ib, sum(i) FILTER (i > 0.01) AS isup, max(bit) FILTER (i > 0.01) AS hi, min(bit) FILTER (i > 0.01) AS lo
      FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY i DESC, input) AS k, sum(i) OVER (PARTITION BY signal) AS tot, count(*) OVER (PARTITION BY signal) AS npi FROM inf)
      GROUP BY 1) JOIN bsum USING (signal)""", **SIG)
def _(spark, d):
    s = bound_samples(spark, d)
    b = s.select("sample_id", F.col("signal").alias("input"), "pos", F.col("value").alias("flipped"))
    pairs = s.select("sample_id", "signal", F.col("value").alias("base")).join(b, "sample_id")
    bits = b.select("input", F.floor(F.col("pos") / 4).alias("bus"), (F.col("pos") % 4).alias("bit")).distinct()
    return rnd(X.influence_profile(X.influence(pairs), bits), nudge=NUDGE)


_SM = {"inner": "SELECT s.* FROM sym s", **{f"p{i}": f"""SELECT p.circuit_id, p.gate_id, p.class, 0.4::DOUBLE * p.p + 0.6::DOUBLE * sum(w.w * q.p) AS p FROM probs p
    JOIN rw w ON w.circuit_id = p.circuit_id AND w.src = p.gate_id JOIN {'probs' if i == 1 else f'p{i - 1}'} q ON q.circuit_id = p.circuit_id AND q.gate_id = w.dst AND q.class = p.class
    GROUP BY p.circuit_id, p.gate_id, p.class, p.p""" for i in range(1, 5)}}


def bound_probs(t):
    return t.preds.select(*KEYS, F.posexplode("prob").alias("class", "p"))


@query("smoothed_probabilities", "SELECT circuit_id, gate_id, class, round(p, 6) AS p FROM p4", **_SM, **FEAT)
def _(spark, d):
    t = B.tables(spark, d)
    return rnd(X.smooth(bound_probs(t), t.edges, 0.6, 4), nudge=NUDGE)


# ------------------------------------------------------------------ evaluation
def _score_sql(by):
    b = "".join(f"{c}, " for c in by)
    tail = f"GROUP BY {', '.join(by)}" if by else ""
    key = "".join(f"p.{c}, " for c in by)
    return f"""SELECT {b}n, round(tp / n, 6) AS accuracy, round(macro_precision, 6) AS macro_precision, round(weighted_precision, 6) AS weighted_precision,
      round(macro_recall, 6) AS macro_recall, round(weighted_recall, 6) AS weighted_recall, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM (
      SELECT {b}sum(support)::BIGINT AS n, sum(tp) AS tp, avg(pr) AS macro_precision, sum(pr * support) / sum(support) AS weighted_precision, avg(re) AS macro_recall,
        sum(re * support) / sum(support) AS weighted_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM (
        SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM (
          SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM (
            SELECT {key}class, count(*) FILTER (true_class = class AND pred_class = class) AS tp, count(*) FILTER (true_class <> class AND pred_class = class) AS fp,
              count(*) FILTER (true_class = class) AS support FROM preds p, classes GROUP BY {key}class) WHERE tp + fp + support > 0)) {tail})"""


@query("scores", _score_sql([]))
def _(spark, d):
    return rnd(E.scores(B.tables(spark, d).preds), nudge=NUDGE)


@query("scores_by_circuit", _score_sql(["circuit_id"]))
def _(spark, d):
    return rnd(E.scores(B.tables(spark, d).preds, ["circuit_id"]), nudge=NUDGE)


@query("per_class", """SELECT class, class_name, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support FROM (
    SELECT class, CASE class WHEN 0 THEN 'Adder' WHEN 1 THEN 'Multiplier' WHEN 2 THEN 'Control Logic' WHEN 3 THEN 'Subtractor' ELSE 'Comparator' END AS class_name,
      CASE WHEN count(*) FILTER (pred_class = class) > 0 THEN count(*) FILTER (pred_class = class AND true_class = class) / count(*) FILTER (pred_class = class) ELSE 0 END AS pr,
      CASE WHEN count(*) FILTER (true_class = class) > 0 THEN count(*) FILTER (pred_class = class AND true_class = class) / count(*) FILTER (true_class = class) ELSE 0 END AS re,
      count(*) FILTER (true_class = class) AS support FROM preds, classes GROUP BY 1)""")
def _(spark, d):
    return rnd(E.per_class(B.tables(spark, d).preds), nudge=NUDGE)


@query("confusion", "SELECT true_class, " + ", ".join(f"count(*) FILTER (pred_class = {i}) AS pred_{i}" for i in range(5)) + " FROM preds GROUP BY 1")
def _(spark, d):
    return E.confusion(B.tables(spark, d).preds)


@query("error_directions", """SELECT true_class, pred_class, n, round(n / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, true_class, pred_class) AS rank
    FROM (SELECT true_class, pred_class, count(*) AS n FROM preds WHERE true_class <> pred_class GROUP BY 1, 2)""")
def _(spark, d):
    return rnd(E.error_directions(B.tables(spark, d).preds), nudge=NUDGE)


@query("compare_predictions", """SELECT count(*) AS n, count(*) FILTER (pa <> pb) AS differ, count(*) FILTER (pa = label AND pb <> label) AS only_a_right,
    count(*) FILTER (pa <> label AND pb = label) AS only_b_right, round(avg((pb = label)::INT) - avg((pa = label)::INT), 6) AS accuracy_gain FROM (
    SELECT label, pred_class AS pa, CASE WHEN inst LIKE '%add%' THEN 0 WHEN inst LIKE '%mult%' THEN 1 WHEN inst LIKE '%sub%' THEN 3 WHEN inst LIKE '%comparator%' THEN 4 ELSE 2 END AS pb
    FROM preds JOIN gates USING (circuit_id, gate_id))""")
def _(spark, d):
    t = B.tables(spark, d)
    b = model.name_labels(t.gates).select(*KEYS, F.col("name_label").alias("pred_class"))
    return rnd(E.compare(t.preds, b), nudge=NUDGE)


@query("multilabel_f1", """SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM (
    SELECT class, count(*) FILTER (p > 0.5 AND class = true_class) AS tp, count(*) FILTER (p > 0.5 AND class <> true_class) AS fp, count(*) FILTER (p <= 0.5 AND class = true_class) AS fn
    FROM probs JOIN preds USING (circuit_id, gate_id) GROUP BY 1)""")
def _(spark, d):
    p = B.tables(spark, d).preds.select("true_class", F.posexplode("prob").alias("class", "p"))
    return rnd(E.multilabel_f1(p.withColumn("truth", (F.col("class") == F.col("true_class")).cast("int"))), nudge=NUDGE)


ROLES = {"roles": """SELECT circuit_id, gate_id, split FROM splits UNION ALL SELECT circuit_id, gate_id, 'te' FROM splits WHERE family = 'DFFQ' AND block = 'adder_1'"""}


@query("audit_splits", """SELECT circuit_id, 'circuit_spans_splits' AS problem, -1 AS gate_id FROM roles GROUP BY 1 HAVING count(DISTINCT split) > 1
    UNION ALL SELECT circuit_id, 'gate_in_several_splits', gate_id FROM roles GROUP BY 1, gate_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT DISTINCT circuit_id, 'prefix_mismatch', -1 FROM roles r WHERE split <> CASE circuit_id % 10 WHEN 0 THEN 'te' WHEN 1 THEN 'va' ELSE 'tr' END""", **ROLES)
def _(spark, d):
    """Register cells of one block are listed a second time as test gates: every circuit but the test ones is contaminated."""
    g = B.bound_splits(B.bound_gates(spark, d))
    own = g.select(*KEYS, "split", F.col("split").alias("expected_split"))
    twice = g.filter("cell like 'DFFQ%' and block = 'adder_1'").select(*KEYS, F.lit("te"), "split")
    return E.audit_splits(own.union(twice))


@query("audit_graph", """SELECT 'entries' AS measure, count(*) AS value FROM uedges UNION ALL SELECT 'asymmetric', 0
    UNION ALL SELECT 'self_loops', count(*) FROM uedges WHERE src = dst
    UNION ALL SELECT 'train_edges_outside_train', count(*) FROM edges WHERE circuit_id % 10 = 1""")
def _(spark, d):
    """The train edges under audit include the validation circuits by mistake."""
    t = B.tables(spark, d)
    roles = B.bound_splits(t.gates)
    u = model.undirected_edges(t.edges, model.po_gates(t.pins, t.ports))
    leaky = t.edges.join(roles.filter("split <> 'te'").select("circuit_id").distinct(), "circuit_id", "left_semi")
    return E.audit_graph(u, roles, leaky)


@query("expected_values", """SELECT measure, expected, value, CASE WHEN value IS NULL THEN 'MISSING' WHEN value = expected THEN 'OK' ELSE 'MISMATCH' END AS status FROM
    (SELECT 'c' || l_suppkey AS measure, count(DISTINCT l_orderkey % 150) AS expected FROM lineitem GROUP BY 1)
    LEFT JOIN (SELECT 'c' || circuit_id AS measure, count(*) AS value FROM deg WHERE in_degree + out_degree > 0 GROUP BY 1) USING (measure)""")
def _(spark, d):
    t = B.tables(spark, d)
    name = F.concat(F.lit("c"), F.col("circuit_id").cast("string")).alias("measure")
    linked = model.degrees(t.gates, t.edges).filter("in_degree + out_degree > 0")
    n = F.count(F.lit(1)).alias("value")
    return E.expect(linked.groupBy(name).agg(n), t.gates.groupBy(name).agg(n))


@query("latency_summary", """SELECT event_type AS kind, count(*) AS n, min(value) AS min_s, max(value) AS max_s, count(*) FILTER (value < 50) AS passed,
    max(value) FILTER (r = n // 2) AS median_s, max(value) FILTER (r = least(n - 1, n * 9 // 10)) AS p90_s FROM (
    SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r FROM events) GROUP BY 1""")
def _(spark, d):
    e = B.read(spark, d, "events")
    return E.latency_summary(e.select(F.col("event_type").alias("kind"), F.col("value").alias("seconds"),
                                      F.col("event_id").alias("run_id"), (F.col("value") < 50).alias("passed")))


@query("order_alignment", """SELECT circuit_id, gate_id, inst AS inst_a, label AS label_a, inst AS inst_b, pred_class AS label_b FROM gates JOIN preds USING (circuit_id, gate_id)
    WHERE label <> pred_class""")
def _(spark, d):
    t = B.tables(spark, d)
    table = t.preds.join(t.gates.select(*KEYS, "inst"), KEYS).withColumn("label", F.col("pred_class"))
    return E.align(t.gates, table)


# ------------------------------------------------------------------ dataset tables
@query("dataset_profile", "SELECT split, count(*) AS gates, count(DISTINCT circuit_id) AS circuits, " + ", ".join(
    f"round(count(*) FILTER (label = {i}) * 100.0 / count(*), 6) AS pct_{i}" for i in range(5)) + " FROM splits GROUP BY 1")
def _(spark, d):
    return rnd(D.dataset_profile(B.bound_splits(B.bound_gates(spark, d))), nudge=NUDGE)


@query("edges_by_split", """SELECT 'tr' AS role, circuit_id, src, dst FROM edges WHERE circuit_id % 10 NOT IN (0, 1)
    UNION ALL SELECT 'va', circuit_id, src, dst FROM edges WHERE circuit_id % 10 <> 0""")
def _(spark, d):
    t = B.tables(spark, d)
    roles = B.bound_splits(t.gates)
    both = [D.edges_by_split(t.edges, roles, r).select(F.lit(r).alias("role"), "circuit_id", "src", "dst") for r in ("tr", "va")]
    return both[0].union(both[1])


@query("graph_dataset", """SELECT 'nodes' AS part, circuit_id, count(*) AS n FROM gates GROUP BY 2 UNION ALL SELECT 'edges', circuit_id, count(*) FROM uedges GROUP BY 2
    UNION ALL SELECT 'train_edges', circuit_id, count(*) FROM uedges WHERE circuit_id % 10 NOT IN (0, 1) GROUP BY 2""")
def _(spark, d):
    """Writes the graph dataset and reads it back."""
    import uuid
    t = B.tables(spark, d)
    nodes = B.bound_splits(t.gates)
    path = f"{shared_dir(spark)}/wireloom/graph-{uuid.uuid4().hex[:12]}"
    D.write_graph(path, nodes, model.undirected_edges(t.edges, model.po_gates(t.pins, t.ports)), nodes)
    out = None
    for name, df in D.read_graph(spark, path).items():
        part = df.groupBy("circuit_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "circuit_id", "n")
        out = part if out is None else out.union(part)
    return out


@query("prediction_csv", """SELECT circuit_id::VARCHAR AS circuit_id, (row_number() OVER (PARTITION BY circuit_id ORDER BY gate_id) - 1)::INT AS gate_id, inst, split AS role,
    label AS true_class, pred_class, CASE WHEN split = 'te' THEN round(top, 6) ELSE 0 END AS top FROM splits JOIN preds USING (circuit_id, gate_id)""")
def _(spark, d):
    """Writes both prediction files and reads them back."""
    import uuid
    t = B.tables(spark, d)
    p = t.preds.join(B.bound_splits(t.gates), KEYS).select(
        (F.col("circuit_id") * 1000 + F.col("gate_id")).alias("node_id"), F.col("inst").alias("cell_name"),
        F.col("circuit_id").alias("circuit_file"), F.col("split").alias("role"), "true_class", "pred_class",
        (F.col("true_class") == F.col("pred_class")).alias("is_correct"), "prob")
    path = f"{shared_dir(spark)}/wireloom/preds-{uuid.uuid4().hex[:12]}"
    p.drop("prob").write.csv(f"{path}/all", header=True)
    p.filter("role = 'te'").select(*[c for c in p.columns if c not in ("role", "prob")],
                                   *[F.col("prob")[i].alias(n) for i, n in enumerate(D.PROB_COLUMNS)]).write.csv(f"{path}/test", header=True)
    r = D.read_predictions(spark, f"{path}/all", f"{path}/test")
    return rnd(r.select("circuit_id", "gate_id", "inst", "role", "true_class", "pred_class", F.array_max("prob").alias("top")), nudge=NUDGE)


@query("text_fingerprints", r"""WITH f AS (SELECT doc_id, source, sha256(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+(\n|$)', '\1', 'g'), '^\s+|\s+$', '', 'g')) AS fingerprint FROM documents)
    SELECT a.doc_id, a.fingerprint, coalesce(k.name, '') AS known_as FROM f a LEFT JOIN (SELECT fingerprint, min(source || ':' || lpad(doc_id::VARCHAR, 9, '0')) AS name FROM f WHERE lang_id = 0 GROUP BY 1) k USING (fingerprint)""".replace(
    "SELECT doc_id, source, sha256", "SELECT doc_id, source, (lang <> 'en')::INT AS lang_id, sha256"))
def _(spark, d):
    """English documents are the known ones; every document is matched against them."""
    f = D.fingerprint(B.read(spark, d, "documents"))
    name = F.concat("source", F.lit(":"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    known = f.filter("lang = 'en'").select("fingerprint", name.alias("name"))
    return D.match_known(f.select("doc_id", "fingerprint"), known).select("doc_id", "fingerprint", F.coalesce("known_as", F.lit("")).alias("known_as"))


@query("retained_uploads", "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 100")
def _(spark, d):
    return D.retain_latest(B.read(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)
