"""Graph sampling: many subgraphs per job, keyed by sample_id. Random choices are seeded hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.operators import graph
from wireloom.operators.model import GATE
from wireloom.operators.scale import materialise, numbered, running_total, uniform

C = "circuit_id"
NODE = ["sample_id", C, "gate_id"]


def _ranked_nodes(nodes: DataFrame) -> DataFrame:
    return materialise(numbered(nodes.select(*GATE).distinct(), [], [F.col(C), F.col("gate_id")], "node_rank"), "ranked-nodes")


def _draws(spark, n_samples: int, per_sample: int) -> DataFrame:
    return spark.range(n_samples * per_sample).select((F.col("id") % n_samples).cast("int").alias("sample_id"), F.floor(F.col("id") / n_samples).alias("k"))


def ranked_neighbours(edges: DataFrame) -> DataFrame:
    """Neighbours of every gate numbered from 1, with its degree; a hub's neighbours are numbered in slices."""
    sym = graph.symmetric(edges)
    r = numbered(sym, [C, "src"], [F.col("dst")], "nth")
    deg = sym.groupBy(C, "src").agg(F.count(F.lit(1)).alias("degree"))
    return materialise(r.join(deg, [C, "src"]).withColumnRenamed("src", "gate_id"), "neighbours")


def _step(at: DataFrame, near: DataFrame, seed: int, *key) -> DataFrame:
    """Replace `gate_id` by a uniformly chosen neighbour; gates without one stay."""
    deg = near.filter("nth = 1").select(*GATE, "degree")
    a = at.join(deg, GATE, "left").withColumn("nth", F.floor(uniform(seed, *key, C, "gate_id") * F.coalesce("degree", F.lit(1))) + 1).drop("degree")
    return a.join(near.select(*GATE, "nth", "dst"), [*GATE, "nth"], "left").withColumn("gate_id", F.coalesce("dst", "gate_id")).drop("nth", "dst")


def sample_rw(edges: DataFrame, train: DataFrame, n_subgraphs: int, roots: int, depth: int, seed: int = 0) -> DataFrame:
    """Random-walk subgraphs: roots drawn with replacement from the train gates, `depth` uniform steps each."""
    nodes = _ranked_nodes(train)
    n = nodes.count()
    start = _draws(edges.sparkSession, n_subgraphs, roots).withColumn("node_rank", F.floor(uniform(seed, "sample_id", "k") * n) + 1)
    at = start.join(nodes, "node_rank").select("sample_id", "k", *GATE)
    near = ranked_neighbours(edges)
    met = at
    for i in range(depth):
        at = materialise(_step(at, near, seed + 1 + i, "sample_id", "k"), "walk").select("sample_id", "k", *GATE)
        met = met.union(at)
    return met.select(*NODE).distinct()


def edge_weights(edges: DataFrame) -> DataFrame:
    """Each undirected edge once (src < dst) with weight 1/deg(src) + 1/deg(dst)."""
    sym = graph.symmetric(edges)
    deg = graph.vertex_degrees(sym)
    d = lambda end, name: deg.select(C, F.col("gate_id").alias(end), F.col("degree").alias(name))
    return sym.filter("src < dst").join(d("src", "_a"), [C, "src"]).join(d("dst", "_b"), [C, "dst"]).select(C, "src", "dst", (1.0 / F.col("_a") + 1.0 / F.col("_b")).alias("w"))


def weighted_draws(items: DataFrame, weight: str, key: list[str], draws: DataFrame, seed: int, piece_rows: int = 65_536) -> DataFrame:
    """Draw items with probability proportional to `weight`: every row of `draws` meets one item.

    Items stand one after the other in the order of a hash. Running weights are summed in pieces of about `piece_rows`
    rows, however many there are. The line is then cut into as many bins as there are items, so a bin holds about one
    item and an item of large weight spans several bins: draws and items are joined by bin, in linear work.
    """
    h = F.xxhash64(*key)
    x = materialise(items.withColumn("_h", h), "weights")
    n = x.count()
    bits = max(n // piece_rows, 1).bit_length()
    x = x.withColumn("_piece", F.shiftrightunsigned("_h", 64 - bits))
    x = running_total(x, [], "_piece", [F.col("_h"), *[F.col(k) for k in key]], {"_hi": F.col(weight)})
    x = materialise(x.withColumn("_lo", F.col("_hi") - F.col(weight)).drop("_h", "_piece"), "cumulative")
    total = x.agg(F.max("_hi")).first()[0] or 0.0
    width = max(total / max(n, 1), 1e-300)
    x = x.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    d = draws.withColumn("_x", uniform(seed, *draws.columns) * F.lit(total)).withColumn("_b", F.floor(F.col("_x") / width))
    return d.join(x, "_b").filter("_x >= _lo and _x < _hi").drop("_x", "_b", "_lo", "_hi")


def sample_edges(edges: DataFrame, n_subgraphs: int, budget: int, seed: int = 0, mode: str = "bernoulli") -> DataFrame:
    """Nodes of edge-sampled subgraphs. `bernoulli`: every edge by its own chance; `draw`: `budget` draws."""
    w = materialise(edge_weights(edges), "edge-weights")
    if mode == "bernoulli":
        total = w.agg(F.sum("w")).first()[0] or 1.0
        s = w.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_subgraphs - 1))))
        s = s.filter(uniform(seed, "sample_id", C, "src", "dst") < F.col("w") * (budget / total))
    else:
        s = weighted_draws(w, "w", [C, "src", "dst"], _draws(edges.sparkSession, n_subgraphs, budget), seed)
    return s.select("sample_id", C, F.explode(F.array("src", "dst")).alias("gate_id")).distinct()


def sample_nodes(edges: DataFrame, train: DataFrame, n_subgraphs: int, budget: int, seed: int = 0, mode: str = "degree") -> DataFrame:
    """Node-sampled subgraphs: by degree, uniformly, or the full set of train gates."""
    spark = edges.sparkSession
    if mode == "full":
        return train.select(*GATE).distinct().withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n_subgraphs - 1)))).select(*NODE)
    if mode == "uniform":
        nodes = _ranked_nodes(train)
        d = _draws(spark, n_subgraphs, budget).withColumn("node_rank", F.floor(uniform(seed, "sample_id", "k") * nodes.count()) + 1)
        return d.join(nodes, "node_rank").select(*NODE).distinct()
    deg = graph.vertex_degrees(graph.symmetric(edges)).join(train.select(*GATE).distinct(), GATE, "left_semi")
    return weighted_draws(deg.withColumn("w", F.col("degree").cast("double")), "w", GATE, _draws(spark, n_subgraphs, budget), seed).select(*NODE).distinct()


def sample_frontier(edges: DataFrame, train: DataFrame, n_subgraphs: int, frontier: int, steps: int, seed: int = 0, clip: int | None = None) -> DataFrame:
    """Frontier sampling: each step one walker per subgraph, chosen by degree, moves to a random neighbour.

    The walker with the smallest -ln(u)/degree moves, which is a choice proportional to the degree; one
    round advances all subgraphs.
    """
    near = ranked_neighbours(edges)
    deg = near.filter("nth = 1").select(*GATE, (F.least("degree", F.lit(clip)) if clip else F.col("degree")).alias("_d"))
    nodes = _ranked_nodes(train.join(deg, GATE, "left_semi"))
    at = _draws(edges.sparkSession, n_subgraphs, frontier).withColumn("node_rank", F.floor(uniform(seed, "sample_id", "k") * nodes.count()) + 1)
    at = materialise(at.join(nodes, "node_rank").select("sample_id", "k", *GATE), "frontier")
    met = at.select(*NODE)
    for i in range(steps):
        race = -F.log(uniform(seed + 7 * i + 1, "sample_id", "k", C, "gate_id") + 1e-18) / F.col("_d")
        go = at.join(deg, GATE).groupBy("sample_id").agg(F.min_by("k", race).alias("k"))
        moved = _step(at.join(go, ["sample_id", "k"], "left_semi"), near, seed + 7 * i + 2, "sample_id", "k").select("sample_id", "k", *GATE)
        at = materialise(at.join(go, ["sample_id", "k"], "left_anti").union(moved), "frontier")
        met = met.union(at.join(go, ["sample_id", "k"], "left_semi").select(*NODE))
    return met.distinct()


def induced(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Edges inside every sample with gates renumbered from 0 and the number of the original edge."""
    e = numbered(edges.select(C, "src", "dst"), [], [F.col(C), F.col("src"), F.col("dst")], "_e").withColumn("edge_id", F.col("_e") - 1).drop("_e")
    m = materialise(numbered(samples.select(*NODE).distinct(), ["sample_id"], [F.col(C), F.col("gate_id")], "_i"), "members")
    end = lambda c, name: m.select("sample_id", C, F.col("gate_id").alias(c), (F.col("_i") - 1).alias(name))
    return e.join(end("src", "new_src"), [C, "src"]).join(end("dst", "new_dst"), ["sample_id", C, "dst"]).select("sample_id", C, "src", "dst", "new_src", "new_dst", "edge_id")


def sampling_norms(samples: DataFrame, sampled_edges: DataFrame, edges: DataFrame, train: DataFrame, n_subgraphs: int) -> tuple[DataFrame, DataFrame]:
    """Edge factors (node count over edge count, at most 10,000; 0.1 without counts) and node loss weights.

    A node's weight is (subgraphs / its count) / train size; a count of zero is taken as 0.1.
    """
    n = samples.groupBy(*GATE).agg(F.count(F.lit(1)).alias("node_count"))
    e = sampled_edges.groupBy(C, "src", "dst").agg(F.count(F.lit(1)).alias("edge_count"))
    j = (edges.select(C, "src", "dst").join(n.withColumnRenamed("gate_id", "src"), [C, "src"], "left").join(e, [C, "src", "dst"], "left").na.fill(0))
    ratio = (F.when((F.col("node_count") == 0) & (F.col("edge_count") == 0), 0.1).when(F.col("edge_count") == 0, 10000.0)
             .otherwise(F.least(F.col("node_count") / F.col("edge_count"), F.lit(10000.0))))
    size = train.count()
    w = train.select(*GATE).distinct().join(n, GATE, "left").withColumn("_c", F.coalesce(F.col("node_count").cast("double"), F.lit(0.1)))
    return j.withColumn("alpha", ratio), w.select(*GATE, (F.lit(float(n_subgraphs)) / F.col("_c") / size).alias("loss_weight"))


def plan_samples(sizes: DataFrame, train_size: int, coverage: float, budget: int) -> DataFrame:
    """Subgraphs to draw until their gates exceed coverage x train size, and batches per epoch.

    `sizes` is (sample_id, gates), one row per drawn subgraph.
    """
    s = sizes.withColumn("_p", F.floor(F.col("sample_id") / 4096))
    r = running_total(s, [], "_p", [F.col("sample_id")], {"covered": F.col("gates")}).drop("_p")
    need = coverage * train_size
    return r.withColumn("needed", (F.col("covered") - F.col("gates")) <= need).withColumn("batches_per_epoch", F.ceil(F.lit(train_size / budget)))
