"""Graph features for node classification: scaling, propagation, encodings, signal statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators import graph
from wireloom.operators.model import GATE
from wireloom.operators.scale import materialise

C = "circuit_id"


# ------------------------------------------------------------------ scaling
def scale_train_only(f: DataFrame, train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard scaling with mean and deviation of the train gates; columns constant there are dropped.

    The statistics are one row, computed once; which columns stay is a property of the schema.
    """
    fit = f.join(train.select(*GATE).distinct(), GATE, "left_semi")
    aggs = [a for c in columns for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    stats = fit.agg(*aggs).first()
    keep = [c for c in columns if stats[f"s_{c}"]]
    return f.select(*GATE, *[((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"])).alias(c) for c in keep])


def constant_columns(f: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and constancy of every feature column, one row per column."""
    row = f.agg(*[a for c in columns for a in (F.min(c).alias(f"l_{c}"), F.max(c).alias(f"h_{c}"))])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").cast("double").alias("low"),
                                 F.col(f"h_{c}").cast("double").alias("high")) for c in columns])
    return row.select(F.inline(entries)).withColumn("constant", F.col("low") == F.col("high"))


# ------------------------------------------------------------------ normalised neighbour sums
def row_weights(edges: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Weights 1/degree on symmetric edges, with a self-loop on every gate when `gates` is given."""
    e = graph.symmetric(edges)
    if gates is not None:
        e = e.union(gates.select(C, F.col("gate_id").alias("src"), F.col("gate_id").alias("dst")))
    deg = e.groupBy(C, "src").agg(F.count(F.lit(1)).alias("degree"))
    return e.join(deg, [C, "src"]).select(C, "src", "dst", (F.lit(1.0) / F.col("degree")).alias("w"))


def sym_weights(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """Weights 1/sqrt(d_i d_j) on symmetric edges with self-loops."""
    loops = gates.select(C, F.col("gate_id").alias("src"), F.col("gate_id").alias("dst"))
    e = graph.symmetric(edges).union(loops)
    deg = e.groupBy(C, "src").agg(F.count(F.lit(1)).alias("degree"))
    return (e.join(deg, [C, "src"]).join(deg.select(C, F.col("src").alias("dst"), F.col("degree").alias("d2")), [C, "dst"])
            .select(C, "src", "dst", (1.0 / F.sqrt(F.col("degree") * F.col("d2"))).alias("w")))


def aggregate(f: DataFrame, weights: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weighted sum of the neighbours' features: (circuit_id, gate_id, columns)."""
    near = f.select(C, F.col("gate_id").alias("dst"), *columns)
    return (weights.join(near, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"))
            .agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in columns]))


def mean_aggregate(f: DataFrame, edges: DataFrame, columns: Sequence[str], gates: DataFrame | None = None) -> DataFrame:
    return aggregate(f, row_weights(edges, gates), columns)


def propagate(f: DataFrame, gates: DataFrame, edges: DataFrame, columns: Sequence[str], hops: int = 2,
              sym: int = 2) -> DataFrame:
    """[X, A_rw^k X, A_sym^k X] side by side: columns c, c_rw1.., c_sym1.."""
    out = f.select(*GATE, *columns)
    for label, w, n in (("rw", row_weights(edges, gates), hops), ("sym", sym_weights(edges, gates), sym)):
        w, cur = materialise(w, f"weights-{label}"), f
        for k in range(1, n + 1):
            cur = aggregate(cur, w, columns)
            out = out.join(cur.select(*GATE, *[F.col(c).alias(f"{c}_{label}{k}") for c in columns]), GATE)
    return out


def propagate_directed(f: DataFrame, gates: DataFrame, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean over the fan-in and over the fan-out, self included, as columns c_in and c_out."""
    loops = gates.select(C, F.col("gate_id").alias("src"), F.col("gate_id").alias("dst"))
    out = f.select(*GATE)
    for label, e in (("in", edges.select(C, F.col("dst").alias("src"), F.col("src").alias("dst"))), ("out", edges)):
        near = f.select(C, F.col("gate_id").alias("dst"), *columns)
        m = (e.select(C, "src", "dst").union(loops).join(near, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"))
             .agg(*[F.avg(c).alias(f"{c}_{label}") for c in columns]))
        out = out.join(m, GATE)
    return out


def combine_hops(f: DataFrame, hops: Sequence[Sequence[str]], mode: str = "concat") -> DataFrame:
    """Join the column groups of several hops: concatenated, averaged or element-wise maximum."""
    width = len(hops[0])
    if mode == "concat":
        v = F.array(*[F.col(c) for h in hops for c in h])
    elif mode == "mean":
        v = F.array(*[sum((F.col(h[i]) for h in hops), F.lit(0.0)) / len(hops) for i in range(width)])
    else:
        v = F.array(*[F.greatest(*[F.col(h[i]) for h in hops]) for i in range(width)])
    return f.select(*GATE, v.alias("features"))


def pool_neighbours(f: DataFrame, sym: DataFrame, columns: Sequence[str]) -> DataFrame:
    near = f.select(C, F.col("gate_id").alias("dst"), *columns)
    aggs = [a for c in columns for a in (F.max(c).alias(f"{c}_max"), F.avg(c).alias(f"{c}_mean"))]
    return sym.join(near, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id")).agg(*aggs)


def attention_aggregate(f: DataFrame, weights: DataFrame, columns: Sequence[str], a_self: Sequence[float],
                        a_neigh: Sequence[float]) -> DataFrame:
    """Sum of neighbours weighted by edge weight times ReLU(a_self.x_i) + ReLU(a_neigh.x_j)."""
    dot = lambda vec: sum((F.col(c) * F.lit(float(w)) for c, w in zip(columns, vec)), F.lit(0.0))
    relu = lambda x: F.greatest(x, F.lit(0.0))
    me = f.select(C, F.col("gate_id").alias("src"), relu(dot(a_self)).alias("s"))
    other = f.select(C, F.col("gate_id").alias("dst"), relu(dot(a_neigh)).alias("t"), *columns)
    k = F.col("w") * (F.col("s") + F.col("t"))
    return (weights.join(me, [C, "src"]).join(other, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"))
            .agg(*[F.sum(k * F.col(c)).alias(c) for c in columns]))


# ------------------------------------------------------------------ positional and structural encodings
def depth_encoding(gates: DataFrame, edges: DataFrame, pi_gates: DataFrame, po_gates: DataFrame) -> DataFrame:
    """Hops to the nearest input- and output-connected gate, scaled per component, and component size."""
    sym = materialise(graph.symmetric(edges), "sym")
    comp = materialise(graph.gate_components(gates, sym), "components")
    size = comp.groupBy(C, "component").agg(F.count(F.lit(1)).alias("n"))
    out = comp.join(size, [C, "component"]).select(*GATE, F.log(F.col("n").cast("double")).alias("log_size"))
    for name, seeds in (("pi", pi_gates), ("po", po_gates)):
        d = graph.hop_distance(sym, seeds, comp)
        top = F.col("component_max")
        out = out.join(d.select(
            *GATE, F.col("distance").cast("double").alias(f"d_{name}"),
            F.when(F.col("distance") < 0, -1.0).otherwise(F.col("distance") / F.greatest(top, F.lit(1))).alias(f"rel_{name}"),
            F.log1p(top.cast("double")).alias(f"logmax_{name}")), GATE)
    both = (F.col("d_pi") >= 0) & (F.col("d_po") >= 0)
    return out.withColumn("position", F.when(both, F.col("d_pi") / F.greatest(F.col("d_pi") + F.col("d_po"), F.lit(1.0)))
                          .otherwise(-1.0))


def structure_features(edges: DataFrame, gates: DataFrame) -> DataFrame:
    """Seven columns: degree, triangles, clustering, two-hop reach, neighbour degrees, two-path multiplicity."""
    sym = materialise(graph.symmetric(edges), "sym")
    tri = graph.triangles(sym)
    base = graph.clustering(sym, tri).join(graph.two_hop(sym), GATE).join(graph.neighbour_degree(sym), GATE)
    all_ = gates.select(*GATE).join(base, GATE, "left").na.fill(0)
    log = lambda c: F.log1p(F.col(c).cast("double"))
    return all_.select(*GATE, log("degree").alias("log_degree"), log("triangles").alias("log_triangles"), "clustering",
                       log("reach2").alias("log_reach2"), log("nd_mean").alias("log_nd_mean"),
                       log("nd_max").alias("log_nd_max"), log("two_path_sq").alias("log_two_path_sq"))


def support_features(gates: DataFrame, support: DataFrame, reach_po: DataFrame, levels: DataFrame,
                     n_inputs: DataFrame, n_outputs: DataFrame) -> DataFrame:
    """Shares of supporting inputs and reachable outputs, and levels scaled by the circuit's depth."""
    s = support.groupBy(*GATE).agg(F.count(F.lit(1)).alias("ns"))
    r = reach_po.groupBy(*GATE).agg(F.count(F.lit(1)).alias("nr"))
    top = levels.groupBy(C).agg(F.max("level_in").alias("mi"), F.max("level_out").alias("mo"))
    j = (gates.select(*GATE).join(s, GATE, "left").join(r, GATE, "left").join(levels, GATE)
         .join(top, C).join(n_inputs, C, "left").join(n_outputs, C, "left").na.fill(0))
    one = F.lit(1)
    return j.select(*GATE, (F.col("ns") / F.greatest("n_inputs", one)).alias("support_share"),
                    F.log1p(F.col("ns").cast("double")).alias("log_support"),
                    (F.col("nr") / F.greatest("n_outputs", one)).alias("reach_share"), "level_in",
                    (F.col("level_in") / F.greatest("mi", one)).alias("level_in_share"), "level_out",
                    (F.col("level_out") / F.greatest("mo", one)).alias("level_out_share"))


# ------------------------------------------------------------------ recorded signal values
def signal_stats(samples: DataFrame) -> DataFrame:
    """Probability of 1 and its entropy per signal of (signal, sample_id, value)."""
    p = samples.groupBy("signal").agg(F.avg(F.col("value").cast("double")).alias("p1"))
    e = 1e-12
    ent = -(F.col("p1") * F.log2(F.col("p1") + e) + (1 - F.col("p1")) * F.log2(1 - F.col("p1") + e))
    return p.withColumn("entropy", ent)


def corr_profile(samples: DataFrame, inputs: DataFrame) -> DataFrame:
    """Profile of the correlations of every signal with every input signal.

    Pair sums are built map side per (signal, input) before the shuffle; `n_inputs` inputs per sample
    make n_inputs rows per signal value.
    """
    a = samples.select("sample_id", "signal", F.col("value").cast("double").alias("x"))
    b = inputs.select("sample_id", F.col("signal").alias("input"), F.col("value").cast("double").alias("y"))
    r = a.join(b, "sample_id").groupBy("signal", "input").agg(F.corr("x", "y").alias("r"))
    r = r.withColumn("r", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))).withColumn("a", F.abs("r"))
    strong = F.col("a") > 0.05
    n = F.count_if(strong)
    return r.groupBy("signal").agg(
        F.max("a").alias("max_abs"), F.avg("a").alias("mean_abs"),
        F.when(n > 0, F.sum(F.when(strong, F.col("r"))) / n).otherwise(0.0).alias("signed_mean"),
        F.when(n > 0, F.count_if(F.col("r") > 0.05) / n).otherwise(0.5).alias("positive_share"),
        (F.count_if(F.col("a") > 0.1) / F.count(F.lit(1))).alias("share_above_0_1"))


def influence(pairs: DataFrame) -> DataFrame:
    """Share of differing values per (signal, input) of (signal, input, base, flipped)."""
    return pairs.groupBy("signal", "input").agg(F.avg((F.col("base") != F.col("flipped")).cast("double")).alias("i"))


def influence_profile(inf: DataFrame, input_bits: DataFrame) -> DataFrame:
    """Eighteen summary columns of one output's influences over the inputs.

    `inf` is (signal, input, i); `input_bits` is (input, bus, bit). Buses are reduced first, so a signal
    is never gathered as a list.
    """
    meta = input_bits.agg(F.countDistinct("bus").alias("nbus"), F.max("bit").alias("maxbit")).first()
    nbus, maxbit = float(max(meta["nbus"], 1)), float(max(meta["maxbit"] or 0, 1))
    x = inf.join(input_bits, "input")
    tot = inf.groupBy("signal").agg(F.sum("i").alias("tot"), F.count(F.lit(1)).alias("npi"))
    x = x.join(tot, "signal")
    sup, full = F.col("i") > 0.01, F.col("i") > 0.9
    p = F.col("i") / F.col("tot")
    main = x.groupBy("signal", "tot", "npi").agg(
        F.max("i").alias("first"), F.count_if(full).alias("full"),
        F.count_if((F.col("i") > 0.3) & (F.col("i") <= 0.9)).alias("half"),
        F.sum(F.when((F.col("tot") > 0) & (F.col("i") > 0), -p * F.log(p))).alias("ent"),
        F.count_if(sup).alias("sup"), F.sum(F.when(sup, F.col("i") * F.col("bit"))).alias("ib"),
        F.sum(F.when(sup, F.col("i"))).alias("isup"), F.max(F.when(sup, F.col("bit"))).alias("hi"),
        F.min(F.when(sup, F.col("bit"))).alias("lo"))
    second = graph.top_k(inf, ["signal"], [F.col("i").desc(), F.col("input")], 2, "_r").filter("_r = 2").select(
        "signal", F.col("i").alias("second"))
    bus = x.groupBy("signal", "bus").agg(F.sum(F.when(sup, F.col("i"))).alias("bi"), F.max(full.cast("int")).alias("bf"))
    bus = bus.groupBy("signal").agg(F.count("bi").alias("buses"), F.max("bi").alias("top_bus"), F.sum("bf").alias("full_buses"))
    bits = x.filter(full).groupBy("signal").agg(F.countDistinct("bit").alias("full_bits"))
    j = main.join(second, "signal", "left").join(bus, "signal").join(bits, "signal", "left")
    n = F.greatest("npi", F.lit(1))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    aligned = (F.col("full") >= 2) & (z("full_bits") < F.col("full")) & (F.col("full_buses") > 1)
    some = F.col("sup") > 0
    return j.select(
        "signal", (F.col("tot") / n).alias("mean_influence"), F.log1p("tot").alias("log_total"), F.col("first"),
        z("second").alias("second"), (F.col("full") / n).alias("full_share"), F.log1p(F.col("full").cast("double")).alias("log_full"),
        (F.col("half") / n).alias("half_share"),
        (z("ent") / F.log(F.greatest("npi", F.lit(2)).cast("double"))).alias("entropy"), (F.col("sup") / n).alias("support_share"),
        (F.col("tot") / F.greatest("sup", F.lit(1))).alias("mean_on_support"), F.col("buses"),
        (F.col("buses") / nbus).alias("bus_share"),
        F.when(F.col("tot") > 0, z("top_bus") / F.col("tot")).otherwise(0.0).alias("top_bus_share"), F.col("full_buses").cast("long"),
        aligned.cast("double").alias("aligned"),
        F.when(some, F.col("ib") / F.greatest("isup", F.lit(1e-9)) / maxbit).otherwise(-1.0).alias("mean_bit"),
        F.when(some, (F.col("hi") - F.col("lo")) / maxbit).otherwise(-1.0).alias("bit_span"),
        F.when(some, F.col("hi") / maxbit).otherwise(-1.0).alias("top_bit"))


# ------------------------------------------------------------------ probability smoothing
def smooth(prob: DataFrame, edges: DataFrame, a: float = 0.6, rounds: int = 10) -> DataFrame:
    """P <- (1-a) P0 + a A P over the evaluated gates, self-loops included.

    `prob` is long (circuit_id, gate_id, class, p); edges to gates outside it are ignored.
    """
    nodes = prob.select(*GATE).distinct()
    inside = graph.induced_edges(edges, nodes.withColumn("g", F.lit(0)), ("g",)).drop("g")
    w = materialise(row_weights(inside, nodes), "smooth-weights")
    p0 = materialise(prob.select(*GATE, "class", "p"), "smooth-p0")
    cur = p0
    for i in range(rounds):
        near = cur.select(C, F.col("gate_id").alias("dst"), "class", "p")
        mean = (w.join(near, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"), "class")
                .agg(F.sum(F.col("w") * F.col("p")).alias("m")))
        cur = p0.join(mean, [*GATE, "class"]).select(*GATE, "class", ((1 - a) * F.col("p") + a * F.col("m")).alias("p"))
        if i % 4 == 3 and i + 1 < rounds:
            cur = materialise(cur, "smooth")
    return cur


def gcn_score(f: DataFrame, gates: DataFrame, edges: DataFrame, columns: Sequence[str], w1: DataFrame, w2: DataFrame) -> DataFrame:
    """Two graph-convolution layers with given weights: ReLU hidden layer, softmax classes.

    Weights are tables (i, j, value) with `i` the input position; output is (circuit_id, gate_id, class, p). They are the
    model, of fixed size, and go to every task: shuffled by `i`, all gates would meet in as many tasks as there are columns.
    """
    w = materialise(sym_weights(edges, gates), "gcn-weights")

    def layer(long, weight):
        lin = long.join(F.broadcast(weight), "i").groupBy(*GATE, "j").agg(F.sum(F.col("x") * F.col("value")).alias("x"))
        near = lin.select(C, F.col("gate_id").alias("dst"), "j", "x")
        return (w.join(near, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"), "j")
                .agg(F.sum(F.col("w") * F.col("x")).alias("x")))

    long = f.select(*GATE, F.posexplode(F.array(*columns)).alias("i", "x"))
    hidden = layer(long, w1).select(*GATE, F.col("j").alias("i"), F.greatest("x", F.lit(0.0)).alias("x"))
    logits = layer(hidden, w2)
    top = logits.groupBy(*GATE).agg(F.max("x").alias("m"))
    e = logits.join(top, GATE).select(*GATE, "j", F.exp(F.col("x") - F.col("m")).alias("e"))
    total = e.groupBy(*GATE).agg(F.sum("e").alias("t"))
    return e.join(total, GATE).select(*GATE, F.col("j").alias("class"), (F.col("e") / F.col("t")).alias("p"))
