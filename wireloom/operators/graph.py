"""Graph algorithms as loops over DataFrames; every vertex belongs to a circuit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.functions import names
from wireloom.operators.model import GATE, NET
from wireloom.operators.scale import closure, front_side, materialise, numbered, release, top_k, until_stable, Store

C = "circuit_id"


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(C, F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions, distinct, without self-loops."""
    e = edges.select(C, "src", "dst").filter("src <> dst")
    return e.union(_flip(e)).distinct()


# ------------------------------------------------------------------ reachability and components
def reach(edges: DataFrame, seeds: DataFrame, direction: str = "forward") -> DataFrame:
    """Gates reachable from the seed gates; `round` is the hop count."""
    e = edges if direction == "forward" else _flip(edges)
    e = e.select(C, F.col("src").alias("gate_id"), "dst")

    def step(frontier):
        return frontier.join(e, GATE).select(C, F.col("dst").alias("gate_id"))

    return closure(seeds, step, GATE, "reach")


#: Links that one task contracts at a time.
FOREST_LINKS = 50_000


def _stars(parts: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(circuit, u, v): each vertex u of the given links with the smallest vertex v it is connected to by them, without u = v."""
    circuit, u, v = (pa.concat_arrays([b.column(i) for b in parts]) for i in range(3))
    circuit, ends = circuit.dictionary_encode(), pa.concat_arrays([u, v]).dictionary_encode()
    n, order = len(ends.dictionary), pc.sort_indices(ends.dictionary).to_numpy()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    at = np.tile(circuit.indices.to_numpy().astype(np.int64), 2) * n + rank[ends.indices.to_numpy()]
    vertex, at = np.unique(at, return_inverse=True)
    a, b = np.split(at, 2)
    low, before = np.arange(len(vertex)), None
    while before is None or (low != before).any():
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, before[a], least)
        np.minimum.at(low, before[b], least)
        low = low[low]
    leaf = np.flatnonzero(low != np.arange(len(vertex)))
    name = lambda x: ends.dictionary.take(pa.array(order[x % n]))
    return circuit.dictionary.take(pa.array(vertex[leaf] // n)), name(vertex[leaf]), name(vertex[low[leaf]])


def _forest(pairs: DataFrame) -> DataFrame:
    """(circuit_id, u, v, batch): stars of the components of every `FOREST_LINKS` pairs (circuit_id, u, v).

    Pairs are dealt out by ranges, so a large circuit is in many batches and a small one mostly in one, which then holds
    its whole components. Within a batch the pairs follow each other by circuit and u.
    """
    def run(batches):
        names, number, rows, held = [C, "u", "v", "batch"], TaskContext.get().partitionId() << 40, 0, []

        def flush():
            cols = _stars(held)
            return pa.RecordBatch.from_arrays([*(x.cast(held[0].schema[i].type) for i, x in enumerate(cols)), pa.array(np.full(len(cols[0]), number), pa.int64())], names=names)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= FOREST_LINKS:
                yield flush()
                number, rows, held = number + 1, 0, []
        if rows:
            yield flush()

    kind = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    return pairs.repartitionByRange(C, "u").sortWithinPartitions(C, "u").mapInArrow(run, f"{C} {kind[C]}, u {kind['u']}, v {kind['v']}, batch long")


def components(links: DataFrame, vertices: DataFrame | None = None, batched: bool = True) -> DataFrame:
    """Connected components as (circuit_id, vertex, component), named by their smallest vertex.

    Tasks contract bounded batches of links to stars first. Stars of which no vertex is in another batch are done; for the
    others follows alternating large-star and small-star contraction: the number of rounds grows with the
    logarithm of the component size, not with its diameter. `links` is (circuit_id, u, v); vertices without links
    are added from `vertices`. Without `batched` all links go through the contraction, in DataFrame functions only.
    """
    pairs = materialise(links.filter("u <> v").filter(F.col(C).isNotNull()).select(C, "u", "v"), "links")
    if batched:
        forest = materialise(_forest(pairs), "forest")
        release(pairs)
        ends = forest.select(C, "u", "batch").union(forest.select(C, "v", "batch"))
        shared = ends.groupBy(C, "u").agg(F.min("batch").alias("a"), F.max("batch").alias("b")).filter("a < b").select(C, "u")
        cut = forest.withColumn("u", F.explode(F.array("u", "v"))).join(shared, [C, "u"], "left_semi").select(C, "v", "batch").distinct()
        cut = materialise(cut, "cut-stars")
        done, rest = forest.join(cut, [C, "v", "batch"], "left_anti").select(C, "u", "v"), forest.join(cut, [C, "v", "batch"], "left_semi").select(C, "u", "v").distinct()
    else:
        done, rest = None, pairs.select(C, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def step(e):
        both = e.union(e.select(C, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(C, "u").agg(F.min("v").alias("m")).select(
            C, F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, [C, "v"]).filter("u <> m").select(C, "u", F.col("m").alias("v")).distinct()
        small_low = large.groupBy(C, "u").agg(F.min("v").alias("m"))
        small = large.join(small_low, [C, "u"])
        return (small.filter("v <> m").select(C, F.col("v").alias("u"), F.col("m").alias("v"))
                .union(small_low.select(C, "u", F.col("m").alias("v"))).distinct())

    stars = until_stable(rest, step, "components")
    stars = stars if done is None else done.unionByName(stars)
    out = stars.select(C, F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = stars.select(C, F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    out = out.union(roots)
    if vertices is not None:
        alone = vertices.select(C, "vertex").distinct().join(out, [C, "vertex"], "left_anti")
        out = out.union(alone.select(C, "vertex", F.col("vertex").alias("component")))
    return out


def gate_components(gates: DataFrame, edges: DataFrame) -> DataFrame:
    links = edges.select(C, F.col("src").alias("u"), F.col("dst").alias("v"))
    v = gates.select(C, F.col("gate_id").alias("vertex"))
    return components(links, v).withColumnRenamed("vertex", "gate_id")


def regions(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Components of the graph induced on a set of gates."""
    s = subset.select(*GATE).distinct()
    inside = (edges.join(s.withColumnRenamed("gate_id", "src"), [C, "src"], "left_semi")
              .join(s.withColumnRenamed("gate_id", "dst"), [C, "dst"], "left_semi"))
    return gate_components(s, inside).withColumnRenamed("component", "region")


def typed_components(net_ends: DataFrame) -> DataFrame:
    """Components over gates, primary inputs and outputs, linked through nets.

    Links go from an end to its net, so a net with r readers costs r rows and not r squared.
    """
    ends = net_ends.filter("kind in ('gate','pi','po')")
    end = F.when(F.col("kind") == "gate", F.concat(F.lit("g:"), F.col("gate_id").cast("string"))).otherwise(
        F.concat(F.col("kind"), F.lit(":"), F.col("name")))
    return components(ends.select(C, end.alias("u"), F.concat(F.lit("w:"), F.col("net")).alias("v")))


def subcircuits(gates: DataFrame, edges: DataFrame, preds: DataFrame) -> DataFrame:
    """Connected groups of gates with the same predicted class, with their sizes."""
    p = preds.select(*GATE, "pred_class")
    same = (edges.join(p.select(C, F.col("gate_id").alias("src"), F.col("pred_class").alias("a")), [C, "src"])
            .join(p.select(C, F.col("gate_id").alias("dst"), F.col("pred_class").alias("b")), [C, "dst"])
            .filter("a = b"))
    comp = gate_components(gates, same).join(p, GATE)
    size = comp.groupBy(C, "component").agg(F.count(F.lit(1)).alias("size"))
    return comp.join(size, [C, "component"]).select(*GATE, F.col("component").alias("module"), "pred_class", "size")


# ------------------------------------------------------------------ orders and levels
def _peeled(vertices: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(*keys, rank): rounds in which vertices without remaining predecessors go, null for those that never do.

    `edges` is (*keys[:-1], src, dst). Predecessors are counted once; a round adds up what the last front took from its
    successors, so only the front and the vertices that wait for further predecessors are written.
    """
    group, own = list(keys[:-1]), keys[-1]
    spark = vertices.sparkSession
    e = materialise(edges.select(*group, "src", "dst"), "peel-edges")
    need = materialise(e.groupBy(*group, F.col("dst").alias(own)).agg(F.count(F.lit(1)).alias("need")), "peel-need")
    out = e.withColumnRenamed("src", own)
    every = materialise(vertices.select(*keys).distinct(), "peel-vertices")
    done, wait = Store(spark, "peel-done"), Store(spark, "peel-wait")
    front, waiting, rank = done.append(every.join(need, list(keys), "left_anti").withColumn("rank", F.lit(1))), None, 1
    while rows := front.count():
        rank += 1
        got = front_side(front, rows).join(out, list(keys)).groupBy(*group, F.col("dst").alias(own)).agg(F.count(F.lit(1)).alias("got"))
        if waiting is not None:
            got = got.union(waiting).groupBy(*keys).agg(F.sum("got").alias("got"))
        state = wait.append(got.join(need, list(keys)).select(*keys, "got", (F.col("got") == F.col("need")).alias("free")))
        wait.forget()
        waiting = state.filter("not free").select(*keys, "got")
        front = done.append(state.filter("free").select(*keys, F.lit(rank).alias("rank")))
    gone = done.all()
    return every.join(gone, list(keys), "left").select(*keys, "rank")


def topo_levels(gates: DataFrame, edges: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Peel gates without remaining predecessors; `rank` is the round, null for gates on or behind a cycle.

    Edges leaving a gate in `cut` do not count.
    """
    e = edges.select(C, "src", "dst")
    if cut is not None:
        e = e.join(cut.select(C, F.col("gate_id").alias("src")), [C, "src"], "left_anti")
    return _peeled(gates, e, GATE)


def levels(gates: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest unit-delay level from the inputs and to the outputs; 0 for gates on or behind a cycle.

    A gate is peeled in the round after its last predecessor, so the round is its level. Both directions are peeled in
    the same rounds.
    """
    way = lambda df, name: df.withColumn("way", F.lit(name))
    both = way(edges.select(C, "src", "dst"), "in").unionByName(way(_flip(edges), "out"))
    g = gates.select(*GATE).withColumn("way", F.explode(F.array(F.lit("in"), F.lit("out"))))
    rank = _peeled(g, both, [C, "way", "gate_id"])
    level = lambda name: F.coalesce(F.max(F.when(F.col("way") == name, F.col("rank"))), F.lit(0)).alias(f"level_{name}")
    return rank.groupBy(*GATE).agg(level("in"), level("out"))


def criticality(level: DataFrame) -> DataFrame:
    """Longest path through each gate, slack against the circuit's depth, and the critical set."""
    depth = level.groupBy(C).agg(F.max("level_in").alias("max_depth"))
    return (level.join(depth, C).withColumn("through", F.col("level_in") + F.col("level_out") - 1)
            .withColumn("slack", F.col("max_depth") - F.col("through"))
            .withColumn("critical", F.col("through") == F.col("max_depth")))


def longest_paths(level: DataFrame, edges: DataFrame, po_gates: DataFrame, k: int = 5) -> DataFrame:
    """Gates of the longest paths to the `k` deepest output gates, one row per gate in `position` order.

    If no output gate reaches the circuit's depth the deepest gate replaces the last end; the
    predecessor with the smallest id continues a path.
    """
    lv = level.select(*GATE, "level_in")
    order = [F.col("level_in").desc(), F.col("gate_id")]
    deepest = top_k(lv, [C], order, 1, "_d").drop("_d")
    outs = top_k(lv.join(po_gates.select(*GATE).distinct(), GATE, "left_semi"), [C], order, k, "end_rank")
    bare = lv.join(outs.select(C).distinct(), C, "left_anti")
    ends = outs.union(top_k(bare, [C], order, k, "end_rank"))
    first = ends.filter("end_rank = 1").select(C, F.col("level_in").alias("_best"))
    lift = deepest.join(first, C).filter("level_in > _best").select(*GATE, "level_in", F.lit(0).alias("end_rank"))
    ends = top_k(ends.union(lift), [C], [F.col("end_rank")], k, "path")
    parent = (edges.join(lv.select(C, F.col("gate_id").alias("src"), F.col("level_in").alias("a")), [C, "src"])
              .join(lv.select(C, F.col("gate_id").alias("dst"), F.col("level_in").alias("b")), [C, "dst"])
              .filter("a = b - 1").groupBy(C, F.col("dst").alias("gate_id")).agg(F.min("src").alias("prev")))
    parent = materialise(parent, "parents")

    def back(f):
        return f.join(parent, GATE).select(C, "path", F.col("prev").alias("gate_id"))

    met = closure(ends.select(C, "path", "gate_id"), back, [C, "path", "gate_id"], "paths")
    return met.join(lv, GATE).select(C, "path", F.col("level_in").alias("position"), "gate_id")


# ------------------------------------------------------------------ distances, cones, support
def hop_distance(uedges: DataFrame, seeds: DataFrame, comp: DataFrame) -> DataFrame:
    """Undirected hops to the nearest seed with the largest distance of the component; -1 if unreachable."""
    d = reach(uedges, seeds).groupBy(*GATE).agg(F.min("round").alias("distance"))
    far = comp.join(d, GATE).groupBy(C, "component").agg(F.max("distance").alias("component_max"))
    return (comp.join(d, GATE, "left").join(far, [C, "component"], "left")
            .select(*GATE, "component", F.coalesce("distance", F.lit(-1)).alias("distance"),
                    F.coalesce("component_max", F.lit(0)).alias("component_max")))


def cones(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Transitive fan-in: (circuit_id, root, gate_id) for roots given as (circuit_id, root, gate_id).

    Roots are numbered within their circuit and a gate carries words of the roots behind which it stands, so a round
    passes on one row per gate and 64 roots, and rows per root are only made at the end.
    """
    roots = materialise(roots.select(C, "root", "gate_id").distinct(), "cone-roots")
    numbers = _numbers(roots.select(C, F.col("root").alias("source")).distinct(), "cone-numbers")
    start = roots.join(numbers.withColumnRenamed("source", "root"), [C, "root"]).groupBy(*GATE, "word").agg(F.bit_or("bit").alias("bits"))
    words = _spread(start, edges.select(C, F.col("dst").alias("gate_id"), F.col("src").alias("dst")), "cones")
    return Support(words, numbers).named(words).select(C, F.col("source").alias("root"), "gate_id")


@dataclass
class Support:
    """Sets of source nets as words of 64 bits: `words` (circuit_id, gate_id, word, bits), one row per gate and word with
    any bit set, and `numbers` (circuit_id, source, word, bit), what each bit stands for."""

    words: DataFrame
    numbers: DataFrame

    def named(self, words: DataFrame) -> DataFrame:
        """(..., source): a row for each bit that is set in `words` (circuit_id, ..., word, bits)."""
        keep = [c for c in words.columns if c not in ("word", "bits")]
        return each_bit(words).join(self.numbers, [C, "word", "bit"]).select(C, "source", *[c for c in keep if c != C])


def each_bit(words: DataFrame) -> DataFrame:
    """`words` (..., bits) with a row for each bit that is set, `bit`, instead of `bits`."""
    eight = words.select("*", F.posexplode(F.array(*[F.expr(f"bits & shiftleft(255L, {i})") for i in range(0, 64, 8)])).alias("_byte", "_set")).filter("_set <> 0")
    each = eight.withColumn("bit", F.explode(F.array(*[F.expr(f"shiftleft({1 << i}L, _byte * 8)") for i in range(8)])))
    return each.filter(F.col("_set").bitwiseAND(F.col("bit")) != 0).drop("bits", "_byte", "_set")


def _numbers(sources: DataFrame, tag: str) -> DataFrame:
    """(circuit_id, source, word, bit) of distinct (circuit_id, source): a bit of a word for each within its circuit."""
    number = F.col("_n") - 1
    return materialise(numbered(sources, [C], [F.col("source")], "_n").select(
        C, "source", F.floor(number / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast((_n - 1) % 64 as int))").alias("bit")), tag)


#: (gate, word) cells that one task closes at a time, at most: a component with more goes through rounds over frames.
CLOSE_CELLS = 1_000_000


def _closed(rows: pa.Table) -> pa.Table:
    """(circuit_id, gate_id, word, bits): the words of whole components (circuit_id, part, gate_id, dst, word, bits), whose rows
    are edges (dst is set) or starts, carried along the edges until no gate gains a bit.

    The cells of a component are numbered gate by gate, so an edge moves each word by a fixed number of cells.
    """
    rows = rows.combine_chunks()
    code = lambda name: rows[name].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    part, group = rows["part"].combine_chunks().fill_null(-1).to_numpy(), code(C)
    _, group = np.unique(np.stack([group, part]), axis=1, return_inverse=True)
    group, edge = group.ravel(), rows["dst"].is_valid().to_numpy()
    ids = pa.concat_arrays([rows["gate_id"].combine_chunks(), rows["dst"].combine_chunks().filter(pa.array(edge))]).dictionary_encode()
    n, at = len(ids.dictionary), ids.indices.to_numpy().astype(np.int64)
    own, vertex = np.unique(np.r_[group, group[edge]] * n + at, return_inverse=True)  # the gates of a component follow each other
    of = own // n
    word = rows["word"].combine_chunks().filter(pa.array(~edge)).to_numpy().astype(np.int64)
    span = int(word.max(initial=0)) + 1
    words, at_word = np.unique(group[~edge] * span + word, return_inverse=True)
    groups = np.arange(group.max(initial=-1) + 2)
    first_gate, first_word = np.searchsorted(of, groups), np.searchsorted(words // span, groups)
    width = np.diff(first_word)
    base = np.r_[0, np.cumsum(np.diff(first_gate) * width)]
    start_of = lambda v: base[of[v]] + (v - first_gate[of[v]]) * width[of[v]]
    src, dst = vertex[:len(edge)][edge], vertex[len(edge):]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    out, move = np.searchsorted(src, np.arange(len(own) + 1)), start_of(dst) - start_of(src)
    state = np.zeros(base[-1], np.uint64)

    def gained(cell, bits, gate):
        """Adds `bits` to cells and gives those that gained any."""
        order = np.argsort(cell, kind="stable")
        cell, bits, gate = cell[order], bits[order], gate[order]
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        cell, bits, gate = cell[new], np.bitwise_or.reduceat(bits, new), gate[new]
        bits &= ~state[cell]
        state[cell] |= bits
        some = bits != 0
        return cell[some], bits[some], gate[some]

    gate = vertex[:len(edge)][~edge]
    cell = start_of(gate) + at_word - first_word[group[~edge]]
    bits = rows["bits"].combine_chunks().filter(pa.array(~edge)).to_numpy().astype(np.int64).view(np.uint64)
    while len(cell):
        cell, bits, gate = gained(cell, bits, gate)
        many = out[gate + 1] - out[gate]
        each = np.repeat(out[gate] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell, bits, gate = np.repeat(cell, many) + move[each], np.repeat(bits, many), dst[each]
    cell = np.flatnonzero(state)
    comp = np.searchsorted(base, cell, side="right") - 1
    place, local = np.divmod(cell - base[comp], np.maximum(width[comp], 1))
    gate = first_gate[comp] + place
    some = np.zeros(len(groups) - 1, np.int64)
    some[group] = np.arange(len(group))  # a row of each component
    return pa.table({C: rows[C].take(pa.array(some[comp])), "gate_id": ids.dictionary.take(pa.array(own[gate] % n)),
                     "word": pa.array((words[first_word[comp] + local] % span).astype(np.int32)), "bits": pa.array(state[cell].view(np.int64))})


def _rounds(start: DataFrame, e: DataFrame, tag: str) -> DataFrame:
    """The words of components too large for a task.

    What a round brings and what the gates had are added up together, one row per gate and word after the map side.
    """
    keys = [*GATE, "word"]
    store = Store(start.sparkSession, tag)
    fresh = store.append(start.select(*keys, "bits"))
    while rows := fresh.count():
        got = front_side(fresh, rows).join(e, GATE).select(C, F.col("dst").alias("gate_id"), "word", "bits", F.lit(0).cast("long").alias("had"))
        both = got.unionByName(store.all().select(*keys, F.lit(0).cast("long").alias("bits"), F.col("bits").alias("had")))
        new = both.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), F.bit_or("had").alias("had"))
        fresh = store.append(new.select(*keys, F.col("bits").bitwiseAND(F.bitwise_not("had")).alias("bits")).filter("bits <> 0"))
    return store.all().groupBy(*keys).agg(F.bit_or("bits").alias("bits"))


def _cells(e: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """(*by, cells): no fewer than the (gate, word) cells of each group."""
    edges = e.select(*by, F.lit(1).alias("rows"), F.lit(None).cast("int").alias("word"))
    both = edges.unionByName(start.select(*by, F.lit(1).alias("rows"), "word"))
    return both.groupBy(*by, "word").agg(F.sum("rows").alias("rows")).groupBy(*by).agg((F.sum("rows") * F.greatest(F.count("word"), F.lit(1)) * 2).alias("cells"))


def _spread(start: DataFrame, e: DataFrame, tag: str) -> DataFrame:
    """Words (circuit_id, gate_id, word, bits) carried along `e` (circuit_id, gate_id, dst) from `start` until no gate gains a bit.

    No word leaves its component, so tasks close batches of whole circuits, of circuits with too many cells whole components,
    however many rounds that takes. Only components with too many cells for a task go through rounds over frames.
    """
    keys, spark = [*GATE, "word"], start.sparkSession
    start = materialise(start.select(*keys, "bits"), f"{tag}-start")
    cells = materialise(_cells(e, start, [C]), f"{tag}-cells")
    total, most = cells.agg(F.sum("cells"), F.max("cells")).first()
    whole = lambda df: df.withColumn("part", F.lit(None).cast("long"))
    if (most or 0) <= CLOSE_CELLS:
        edges, starts, rest = whole(e), whole(start), None
    else:
        large = cells.filter(F.col("cells") > CLOSE_CELLS).select(C)
        e_large, s_large = e.join(large, C, "left_semi"), start.join(large, C, "left_semi")
        comp = materialise(components(e_large.select(C, F.col("gate_id").alias("u"), F.col("dst").alias("v"))).select(
            C, F.col("vertex").alias("gate_id"), F.col("component").cast("long").alias("part")), f"{tag}-components")
        e_large = materialise(e_large.join(comp, GATE), f"{tag}-edges")
        s_large = materialise(s_large.join(comp, GATE, "left").withColumn("part", F.coalesce("part", F.col("gate_id").cast("long"))), f"{tag}-starts")
        sizes = materialise(_cells(e_large, s_large, [C, "part"]), f"{tag}-part-cells")
        total = sum(x or 0 for x in (cells.join(large, C, "left_anti").agg(F.sum("cells")).first()[0], sizes.filter(F.col("cells") <= CLOSE_CELLS).agg(F.sum("cells")).first()[0]))
        over = materialise(sizes.filter(F.col("cells") > CLOSE_CELLS).select(C, "part"), f"{tag}-large")
        rest = None
        if not over.isEmpty():
            rest = _rounds(s_large.join(over, [C, "part"], "left_semi"), e_large.join(over, [C, "part"], "left_semi").drop("part"), tag)
            e_large, s_large = (x.join(over, [C, "part"], "left_anti") for x in (e_large, s_large))
        edges = whole(e.join(large, C, "left_anti")).unionByName(e_large)
        starts = whole(start.join(large, C, "left_anti")).unionByName(s_large)
    batches = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total or 0) // CLOSE_CELLS + 1)
    rows = edges.select(C, "part", "gate_id", "dst").unionByName(starts.select(C, "part", *keys[1:], "bits"), allowMissingColumns=True)
    rows = rows.withColumn("g", F.pmod(F.xxhash64(C, "part"), F.lit(batches)).cast("int")).repartition(batches, "g")
    kind = {f.name: f.dataType.simpleString() for f in start.schema.fields}
    out = rows.groupBy("g").applyInArrow(_closed, f"{C} {kind[C]}, gate_id {kind['gate_id']}, word int, bits long")
    return materialise(out if rest is None else out.unionByName(rest), f"{tag}-words")


def support_sets(pins: DataFrame, sources: DataFrame, stop: bool = True) -> Support:
    """Source nets that every gate depends on.

    Sources are numbered within their circuit; a word is the set of 64 of them. A round passes on only the bits that a
    gate did not have before, OR-ed over its predecessors, so a gate costs one row per word and round in which the word
    grew, not one per source, and the rounds are those of the farthest source.
    """
    from wireloom.operators.model import gate_edges
    src = sources.select(C, F.col("net").alias("source")).distinct()
    numbers = _numbers(src, "source-numbers")
    inner = pins.join(src.withColumnRenamed("source", "net"), NET, "left_anti") if stop else pins
    e = materialise(gate_edges(inner), "support-edges").select(C, F.col("src").alias("gate_id"), "dst")
    start = (pins.filter("direction = 'input'").join(numbers.withColumnRenamed("source", "net"), NET)
             .groupBy(*GATE, "word").agg(F.bit_or("bit").alias("bits")))
    return Support(_spread(start, e, "support"), numbers)


def support(pins: DataFrame, sources: DataFrame, stop: bool = True) -> DataFrame:
    """(circuit_id, source, gate_id): source nets every gate depends on.

    With `stop` a walk ends at the next source net; otherwise source nets with a gate behind them also
    pass on what that gate depends on. Starts from the readers of the sources, so only gates that
    depend on something appear.
    """
    sets = support_sets(pins, sources, stop)
    return sets.named(sets.words)


def driven_support(sets: Support, pins: DataFrame, targets: DataFrame) -> DataFrame:
    """Support of whatever drives each target net: (circuit_id, source, net)."""
    return sets.named(driven_words(sets, pins, targets))


def driven_words(sets: Support, pins: DataFrame, targets: DataFrame) -> DataFrame:
    """The same as words: (circuit_id, net, word, bits)."""
    drv = pins.filter("direction = 'output'").join(targets.select(C, "net").distinct(), NET, "left_semi")
    return drv.select(C, "net", "gate_id").join(sets.words, GATE).groupBy(C, "net", "word").agg(F.bit_or("bits").alias("bits"))


def trace_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shortest directed path per (circuit_id, from_id, to_id): forward, else in the reverse direction.

    Among shortest paths the smallest next gate id is taken at every step.
    """
    keys = [C, "from_id", "to_id", "gate_id"]
    pairs = pairs.select(C, "from_id", "to_id").distinct()

    def one_way(todo, e, a, b, label):
        prev = e.select(C, F.col("dst").alias("gate_id"), F.col("src").alias("before"))

        def grow(f):
            return (f.filter(F.col("gate_id") != F.col(a)).join(prev, GATE)
                    .select(C, "from_id", "to_id", F.col("before").alias("gate_id")))

        dist = closure(todo.withColumn("gate_id", F.col(b)), grow, keys, f"trace-{label}")
        dist = dist.groupBy(*keys).agg(F.min("round").alias("left"))
        step = (dist.join(e.select(C, F.col("src").alias("gate_id"), "dst"), GATE)
                .join(dist.select(C, "from_id", "to_id", F.col("gate_id").alias("dst"), F.col("left").alias("_l")),
                      [C, "from_id", "to_id", "dst"])
                .filter(F.col("_l") == F.col("left") - 1)
                .groupBy(*keys).agg(F.min("dst").alias("next")))
        step = materialise(step, f"trace-next-{label}")
        hit = dist.filter(F.col("gate_id") == F.col(a)).select(C, "from_id", "to_id")
        path = closure(hit.withColumn("gate_id", F.col(a)),
                       lambda f: f.join(step, keys).select(C, "from_id", "to_id", F.col("next").alias("gate_id")),
                       keys, f"trace-path-{label}")
        return path.select(*keys, F.col("round").alias("position"), F.lit(label).alias("direction"))

    forward = one_way(pairs, edges, "from_id", "to_id", "forward")
    rest = pairs.join(forward.select(C, "from_id", "to_id"), [C, "from_id", "to_id"], "left_anti")
    return forward.union(one_way(rest, edges, "to_id", "from_id", "reverse"))


def neighbourhood(edges: DataFrame, centers: DataFrame, hops: int = 1, cap: int = 50) -> DataFrame:
    """Gates within `hops` undirected steps of each centre, nearest and smallest ids first, at most `cap`."""
    u = symmetric(edges).select(C, F.col("src").alias("gate_id"), "dst")
    start = centers.select(C, F.col("gate_id").alias("center"), "gate_id")
    keys = [C, "center", "gate_id"]
    near = closure(start, lambda f: f.join(u, GATE).select(C, "center", F.col("dst").alias("gate_id")),
                   keys, "near", max_rounds=hops)
    near = near.groupBy(*keys).agg(F.min("round").alias("hop"))
    return top_k(near, [C, "center"], [F.col("hop"), F.col("gate_id")], cap)


def induced_edges(edges: DataFrame, members: DataFrame, group: Sequence[str] = ("center",)) -> DataFrame:
    """Edges with both ends in the same group of gates."""
    g = list(group)
    a = members.select(C, *g, F.col("gate_id").alias("src"))
    b = members.select(C, *g, F.col("gate_id").alias("dst"))
    return edges.join(a, [C, "src"]).join(b, [C, *g, "dst"]).select(C, *g, "src", "dst")


def link_chains(links: DataFrame, min_len: int = 3) -> DataFrame:
    """Chains over directed links: start at gates without a predecessor and follow the smallest successor."""
    nxt = materialise(links.groupBy(C, F.col("src").alias("gate_id")).agg(F.min("dst").alias("next")), "chain-next")
    heads = (links.select(C, F.col("src").alias("gate_id")).distinct()
             .join(links.select(C, F.col("dst").alias("gate_id")), GATE, "left_anti"))
    keys = [C, "head", "gate_id"]
    met = closure(heads.select(C, F.col("gate_id").alias("head"), "gate_id"),
                  lambda f: f.join(nxt, GATE).select(C, "head", F.col("next").alias("gate_id")), keys, "chains")
    length = met.groupBy(C, "head").agg(F.count(F.lit(1)).alias("length")).filter(F.col("length") >= min_len)
    return met.join(length, [C, "head"]).select(C, "head", "length", F.col("round").alias("position"), "gate_id")


def carry_links(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """Adder cells whose CO net is read by the CI pin of another adder cell."""
    add = gates.filter(F.col("cell").rlike("^(ADDF|ADDH)")).select(*GATE)
    p = pins.join(add, GATE, "left_semi")
    co = p.filter("pin = 'CO'").select(C, "net", F.col("gate_id").alias("src")).distinct()
    ci = p.filter("pin = 'CI' and direction = 'input'").select(C, "net", F.col("gate_id").alias("dst")).distinct()
    return co.join(ci, NET).select(C, "src", "dst").distinct()


# ------------------------------------------------------------------ local structure
def vertex_degrees(sym: DataFrame) -> DataFrame:
    return sym.groupBy(C, F.col("src").alias("gate_id")).agg(F.count(F.lit(1)).alias("degree"))


def triangles(sym: DataFrame) -> DataFrame:
    """Triangles per vertex. Edges point to the end with the higher (degree, id), which bounds the wedges
    of every vertex by the square root of the edge count even next to a hub."""
    deg = vertex_degrees(sym)
    e = (sym.filter("src < dst")
         .join(deg.select(C, F.col("gate_id").alias("src"), F.col("degree").alias("ds")), [C, "src"])
         .join(deg.select(C, F.col("gate_id").alias("dst"), F.col("degree").alias("dd")), [C, "dst"]))
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    o = materialise(e.select(C, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"),
                             F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")), "oriented")
    wedge = o.join(o.select(C, "a", F.col("b").alias("c")), [C, "a"]).filter("b <> c")
    tri = wedge.join(o.select(C, F.col("a").alias("b"), F.col("b").alias("c")), [C, "b", "c"])
    return (tri.select(C, F.explode(F.array("a", "b", "c")).alias("gate_id"))
            .groupBy(*GATE).agg(F.count(F.lit(1)).alias("triangles")))


def clustering(sym: DataFrame, tri: DataFrame) -> DataFrame:
    deg = vertex_degrees(sym)
    t = F.coalesce("triangles", F.lit(0))
    pairs = F.greatest(F.col("degree") * (F.col("degree") - 1) / 2.0, F.lit(1.0))
    return deg.join(tri, GATE, "left").select(*GATE, "degree", t.alias("triangles"), (t / pairs).alias("clustering"))


def two_hop(sym: DataFrame) -> DataFrame:
    """Vertices within two hops and the sum of squared two-path counts. Two-paths are counted map side
    per end pair before the shuffle."""
    a = sym.select(C, F.col("src").alias("gate_id"), F.col("dst").alias("mid"))
    b = sym.select(C, F.col("src").alias("mid"), F.col("dst").alias("far"))
    paths = a.join(b, [C, "mid"]).groupBy(C, "gate_id", "far").agg(F.count(F.lit(1)).alias("n"))
    near = sym.select(C, F.col("src").alias("gate_id"), F.col("dst").alias("far"), F.lit(0).cast("long").alias("n"))
    cells = paths.union(near).groupBy(C, "gate_id", "far").agg(F.sum("n").alias("n"))
    return cells.groupBy(*GATE).agg(F.count(F.lit(1)).alias("reach2"),
                                    F.sum(F.col("n") * F.col("n")).alias("two_path_sq"))


def neighbour_degree(sym: DataFrame) -> DataFrame:
    deg = vertex_degrees(sym).select(C, F.col("gate_id").alias("dst"), "degree")
    return (sym.join(deg, [C, "dst"]).groupBy(C, F.col("src").alias("gate_id"))
            .agg(F.avg("degree").alias("nd_mean"), F.max("degree").alias("nd_max")))


def pagerank(sym: DataFrame, alpha: float = 0.9, rounds: int = 10) -> DataFrame:
    """PageRank over the vertices of an undirected graph, a fixed number of rounds."""
    deg = vertex_degrees(sym)
    n = deg.count()
    out = materialise(sym.join(deg.withColumnRenamed("gate_id", "src"), [C, "src"]), "pagerank-edges")
    rank = deg.select(*GATE, F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        flow = (out.join(rank.withColumnRenamed("gate_id", "src"), [C, "src"])
                .groupBy(C, F.col("dst").alias("gate_id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("_in")))
        rank = flow.select(*GATE, ((1 - alpha) / max(n, 1) + alpha * F.col("_in")).alias("rank"))
        if i % 5 == 4 and i + 1 < rounds:
            rank = materialise(rank, "pagerank")
    return rank
