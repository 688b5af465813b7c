"""What bus bits depend on, and which arithmetic shape that dependency has.

Dependencies stay long: one row per (target bit, operand bit). No set is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom import schema as S
from wireloom.operators import graph
from wireloom.operators.model import GATE, NET
from wireloom.operators.scale import materialise, top_k
from wireloom.tables import Tables

C = "circuit_id"
PAIR = [C, "bus", "operand"]
ROLE = {"adder-like": "adder", "multiplier-like": "multiplier", "subtractor-like": "subtractor",
        "comparator-like": "comparator", "select-like": "control"}
TEMPLATE = {"adder-like": "adder_triangular", "multiplier-like": "multiplier_pp_complete", "subtractor-like": "subtractor_inverted",
            "comparator-like": "comparator_all_bits"}


def driven_bits(bus_bits: DataFrame, pins: DataFrame) -> DataFrame:
    """Bits with a gate behind them."""
    drv = pins.filter("direction = 'output'").select(*NET).distinct()
    return bus_bits.join(drv, NET, "left_semi")


def live_bits(bus_bits: DataFrame, nets: DataFrame) -> DataFrame:
    """Bits that anything drives: a gate, an input or a constant."""
    return bus_bits.join(nets.filter("n_drivers > 0").select(*NET), NET, "left_semi")


def dependency_profile(pins: DataFrame, targets: DataFrame, sources: DataFrame, support: graph.Support) -> DataFrame:
    """(circuit_id, bus, significance, operand, osig): which operand bits every driven target bit depends on.

    Kept as words of 64 operand bits (see `_masks`), which are written; the rows are read off them.
    """
    bits = sources.select(C, F.col("bus").alias("operand"), F.col("significance").alias("osig"), F.col("net").alias("source"))
    named = support.numbers.join(bits, [C, "source"]).groupBy(C, "word").agg(F.collect_list(F.struct("bit", "operand", "osig")).alias("_named"))  # for 64 sources
    words = graph.driven_words(support, pins, targets).join(targets.select(C, "bus", "significance", "net"), NET)
    rows = (words.join(named, [C, "word"]).select(C, "bus", "significance", F.explode(F.expr("filter(_named, x -> bits & x.bit <> 0 AND x.operand <> bus)")).alias("x"))
            .select(C, "bus", "significance", "x.operand", "x.osig"))
    masks = materialise(_packed(rows, [*PAIR, "significance"], "mask"), "masks")
    kind = sources.schema["significance"].dataType.simpleString()
    out = graph.each_bit(masks.withColumnRenamed("mask", "bits")).select(
        C, "bus", "significance", "operand", F.expr(f"cast(64 * oword + length(bin(bit)) - 1 as {kind})").alias("osig"))
    out._masks = masks
    return out


def input_profile(t: Tables) -> DataFrame:
    """What every internal and output bit depends on among the bits of the input buses."""
    sets = graph.support_sets(t.pins, t.ports.filter("port_dir in ('input', 'inout')"))
    return dependency_profile(t.pins, t.bus_bits.filter("kind <> 'input'"), t.bus_bits.filter("kind = 'input'"), sets)


def feed_profile(t: Tables) -> DataFrame:
    """The same among the bits of internal and output buses; walks end at the first of them."""
    inner = t.bus_bits.filter("kind <> 'input'")
    return dependency_profile(t.pins, inner, inner, graph.support_sets(t.pins, inner))


def _packed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(*keys, oword, name): the values of `osig` as words of 64 bits."""
    return rows.groupBy(*keys, F.floor(F.col("osig") / 64).cast("int").alias("oword")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(osig, 64) as int))")).alias(name))


def _masks(profile: DataFrame) -> DataFrame:
    """(circuit_id, bus, operand, significance, oword, mask): a profile with a row for 64 operand bits, written once."""
    if not hasattr(profile, "_masks"):
        profile._masks = materialise(_packed(profile, [*PAIR, "significance"], "mask"), "masks")
    return profile._masks


def _upto(limit: str, word: str = "oword") -> str:
    """SQL for the bits of a word that stand for 0 to `limit` or, in words before 0, for all."""
    n = f"cast({limit} - 64 * {word} + 1 as int)"
    return f"(CASE WHEN {n} <= 0 THEN 0L WHEN {n} >= 64 THEN -1L ELSE ~shiftleft(-1L, {n}) END)"


def _highest(mask: str, word: str) -> str:
    return f"(CASE WHEN {mask} <> 0 THEN 64 * {word} + length(bin({mask})) - 1 END)"


def _bit_stats(masks: DataFrame, operand_bits: DataFrame) -> DataFrame:
    """Per (target bit, operand): size and extent of the dependency against the expected bits 0..w.

    `masks` come from `_masks`; `operand_bits` is (circuit_id, operand, osig): the bits that can be depended on.
    """
    words = _packed(operand_bits, [C, "operand"], "live")
    size = words.groupBy(C, "operand").agg(F.sum(F.bit_count("live")).alias("width"), F.expr(f"max({_highest('live', 'oword')})").alias("top"),
                                           F.collect_list(F.struct("oword", "live")).alias("_words"))  # one for 64 bits of a bus
    both = masks.join(size, [C, "operand"]).withColumn("_live", F.expr("coalesce(element_at(filter(_words, x -> x.oword = oword), 1).live, 0L)"))
    count = lambda mask: F.sum(F.expr(f"bit_count({mask})").cast("long"))
    own = both.groupBy(*PAIR, "significance").agg(
        count("mask").alias("n"), F.expr(f"max({_highest('mask', 'oword')})").alias("hi"), F.expr("min(64 * oword + instr(reverse(bin(mask)), '1') - 1)").alias("lo"),
        count("mask & _live").alias("n_live"), count(f"mask & _live & {_upto('significance')}").alias("n_low"),
        F.first("width").alias("width"), F.first("top").alias("top"), F.first("_words").alias("_words"))
    expected = f"(x.live & {_upto('significance', 'x.oword')})"
    return own.withColumns({"n_exp": F.expr(f"aggregate(_words, 0L, (a, x) -> a + bit_count({expected}))"),
                            "hi_exp": F.expr(f"array_max(transform(_words, x -> {_highest(expected, 'x.oword')}))")}).drop("_words")


def pattern_class(profile: DataFrame, live: DataFrame) -> DataFrame:
    """Shape of every (bus, operand) dependency: too_small, full, bitwise, triangular or partial."""
    lb = live.select(C, F.col("bus").alias("operand"), F.col("significance").alias("osig"))
    s = _bit_stats(_masks(profile), lb)
    shaped = (F.col("n_exp") > 0) & (F.col("n_low") == F.col("n")) & (F.col("hi") == F.col("hi_exp"))
    exact = (F.col("n") == F.col("n_exp")) & (F.col("n_low") == F.col("n"))
    covers = F.col("n_live") == F.col("width")
    g = s.groupBy(*PAIR, "width", "top").agg(
        F.count(F.lit(1)).alias("bits"), F.count_if(exact).alias("exact_bits"), F.count_if(shaped).alias("shaped"),
        F.count_if(shaped & (F.col("significance") < F.col("top"))).alias("shaped_low"),
        F.bool_and(covers).alias("full"),
        F.bool_and((F.col("lo") >= F.col("significance") - 1) & (F.col("hi") <= F.col("significance"))).alias("bitwise"),
        F.count_if(F.col("significance") >= 2).alias("upper"))
    pattern = (F.when(F.col("width") < S.MIN_BUS_WIDTH, "too_small")
               .when(F.col("bits") < S.MIN_BUS_WIDTH, F.when(F.col("full"), "full").otherwise("too_small"))
               .when(F.col("bitwise") & (F.col("upper") >= 2), "bitwise")
               .when((F.col("shaped") >= 0.6 * F.col("bits")) & (F.col("shaped_low") >= 2), "triangular")
               .when(F.col("full"), "full").otherwise("partial"))
    return g.select(*PAIR, F.col("width").alias("operand_width"), "bits", "exact_bits", pattern.alias("pattern"))


def ripple_pattern(profile: DataFrame, bus_bits: DataFrame, driven: DataFrame) -> DataFrame:
    """(bus, operand) pairs whose bits follow the ripple pattern 0..min(w, W-1) of the declared operand bits."""
    declared = bus_bits.filter("kind = 'input'").select(C, F.col("bus").alias("operand"), F.col("significance").alias("osig"))
    ok_bus = driven.groupBy(C, "bus").agg(F.count(F.lit(1)).alias("_b")).filter(F.col("_b") >= S.MIN_BUS_WIDTH).drop("_b")
    s = _bit_stats(_masks(profile).join(ok_bus, [C, "bus"], "left_semi"), declared).filter(F.col("width") >= S.MIN_BUS_WIDTH)
    shaped = (F.col("n_low") == F.col("n")) & (F.col("hi") == F.least("significance", F.col("width") - 1))
    g = s.groupBy(*PAIR, "width").agg(
        F.count(F.lit(1)).alias("bits_with_dependency"), F.count_if(F.col("n_low") == F.col("n_exp")).alias("_m"),
        F.count_if((F.col("n_low") == F.col("n_exp")) & (F.col("n") == F.col("n_exp"))).alias("bits_matching"),
        F.count_if(shaped).alias("shaped"), F.count_if(shaped & (F.col("significance") < F.col("width") - 1)).alias("nontrivial"),
        F.max("significance").alias("top_bit")).drop("_m")
    return g.filter((F.col("bits_with_dependency") >= S.MIN_BUS_WIDTH)
                    & (F.col("shaped") >= 0.6 * F.col("bits_with_dependency")) & (F.col("nontrivial") >= 2))


def _bit_diff(profile: DataFrame, ripple: DataFrame, driven: DataFrame) -> DataFrame:
    """Missing and extra operand bits of every driven bit of the recognised pairs, one row each."""
    bits = driven.select(C, "bus", "significance").distinct().join(ripple, [C, "bus"]).filter("significance <= top_bit").select(*PAIR, "significance", "width")
    key, last = [*PAIR, "significance", "oword"], "least(significance, width - 1)"
    zero = F.lit(0).cast("long")
    want = bits.withColumn("oword", F.explode(F.expr(f"sequence(0, cast({last} div 64 as int))"))).select(*key, F.expr(_upto(last)).alias("want"), zero.alias("have"))
    have = _masks(profile).join(bits, [*PAIR, "significance"]).select(*key, F.expr(f"CASE WHEN oword < 0 THEN 0L ELSE {_upto(last)} END").alias("want"), F.col("mask").alias("have"))
    both = want.union(have).groupBy(*key).agg(F.bit_or("want").alias("want"), F.bit_or("have").alias("have")).filter("want <> have")
    each = both.select(*key, F.explode(F.expr("array(struct('missing' AS diff, want & ~have AS bits), struct('extra' AS diff, have & ~want AS bits))")).alias("d")).filter("d.bits <> 0")
    each = each.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(63)))).filter("shiftright(d.bits, _i) & 1 = 1")
    return each.select(*key[:4], F.expr("oword * 64 + _i").alias("osig"), "d.diff")


def deviant_runs(profile: DataFrame, ripple: DataFrame, driven: DataFrame) -> DataFrame:
    """Consecutive deviating bits per (bus, operand) as runs; a bus has few bits, so the window is small."""
    diff = _bit_diff(profile, ripple, driven)
    bad = diff.select(*PAIR, "significance").distinct()
    w = Window.partitionBy(*PAIR).orderBy("significance")
    runs = (bad.withColumn("_i", F.col("significance") - F.row_number().over(w)).groupBy(*PAIR, "_i")
            .agg(F.min("significance").alias("first_bit"), F.max("significance").alias("last_bit")).drop("_i"))
    at = diff.select(*PAIR, F.col("significance").alias("first_bit"), "osig", "diff")
    return runs.join(at, [*PAIR, "first_bit"]).groupBy(*PAIR, "first_bit", "last_bit").agg(
        F.count_if(F.col("diff") == "missing").alias("missing"), F.count_if(F.col("diff") == "extra").alias("extra"),
        F.max(F.when(F.col("diff") == "missing", F.col("osig"))).alias("max_missing"),
        F.max(F.when(F.col("diff") == "extra", F.col("osig"))).alias("max_extra"))


def classify_runs(runs: DataFrame) -> DataFrame:
    """Runs merged over operands: `carry_break` if every operand only misses bits below the run."""
    carry = (F.col("missing") > 0) & (F.col("extra") == 0) & (F.col("max_missing") < F.col("first_bit"))
    g = runs.groupBy(C, "bus", "first_bit", "last_bit").agg(F.bool_and(carry).alias("_c"), F.count(F.lit(1)).alias("operands"))
    return g.select(C, "bus", "first_bit", "last_bit", "operands",
                    F.when(F.col("_c"), "carry_break").otherwise("bit_slice_anomaly").alias("check"),
                    F.when(F.col("_c"), 0.9).otherwise(0.8).alias("confidence"))


def swap_suggestions(runs: DataFrame, bus_bits: DataFrame, pins: DataFrame, gates: DataFrame, edges: DataFrame) -> DataFrame:
    """Gate pins to rewire where a run has exactly one missing and one extra bit, with the likely other half."""
    one = runs.filter("missing = 1 and extra = 1")
    bit = bus_bits.select(C, "bus", "significance", "net")
    name = lambda bus, sig, out: bit.select(C, F.col("bus").alias(bus), F.col("significance").alias(sig), F.col("net").alias(out))
    one = (one.join(name("operand", "max_missing", "want"), [C, "operand", "max_missing"])
           .join(name("operand", "max_extra", "have"), [C, "operand", "max_extra"])
           .join(name("bus", "first_bit", "first_net"), [C, "bus", "first_bit"]))
    roots = (pins.filter("direction = 'output'").select(C, F.col("net").alias("first_net"), "gate_id")
             .join(one.select(C, "first_net").distinct(), [C, "first_net"]).select(C, F.col("first_net").alias("root"), "gate_id"))
    cone = graph.cones(edges, roots).withColumnRenamed("root", "first_net")
    ins = pins.filter("direction = 'input'").join(gates.select(*GATE, "hier_prefix"), GATE)
    readers = lambda col: ins.select(C, F.col("net").alias(col), "gate_id", "pin", "hier_prefix")
    keep = [C, "bus", "first_bit", "operand"]
    mine = one.join(readers("have"), [C, "have"]).join(cone, [C, "first_net", "gate_id"], "left_semi")
    first = mine.select(*keep, "gate_id", "pin", F.col("want").alias("from_net"), F.col("have").alias("replaces_net"), F.lit(0.8).alias("confidence"))
    blocks = mine.select(*keep, "hier_prefix").distinct()
    other = (one.join(readers("want"), [C, "want"]).join(cone, [C, "first_net", "gate_id"], "left_anti")
             .join(blocks, [*keep, "hier_prefix"], "left_semi"))
    return first.union(other.select(*keep, "gate_id", "pin", F.col("have").alias("from_net"), F.col("want").alias("replaces_net"), F.lit(0.6)))


def _run_subject():
    return F.concat("bus", F.lit(":"), F.col("first_bit").cast("string"), F.lit("-"), F.col("last_bit").cast("string"))


def run_members(classified: DataFrame, bus_bits: DataFrame) -> DataFrame:
    """Bus runs as finding members: one row per deviating net."""
    bits = bus_bits.select(C, "bus", "significance", "net")
    m = classified.join(bits, [C, "bus"]).filter("significance between first_bit and last_bit")
    return m.select(C, "check", F.lit("warning").alias("severity"), _run_subject().alias("subject"),
                    F.lit(None).cast("int").alias("gate_id"), F.lit(None).cast("string").alias("pin"), "net")


def run_gates(profile: DataFrame, ripple: DataFrame, driven: DataFrame, runs: DataFrame, t: Tables) -> DataFrame:
    """Gates behind each run, (circuit_id, bus, first_bit, last_bit, gate_id): in the cone of the run's first bit, those
    that read an operand bit it should not depend on, or, where it only misses lower bits, the first bit it still has."""
    key = [C, "bus", "first_bit", "last_bit"]
    extra = (_bit_diff(profile, ripple, driven).filter("diff = 'extra'").withColumnRenamed("significance", "first_bit")
             .join(runs.select(*PAIR, "first_bit", "last_bit"), [*PAIR, "first_bit"]).select(*key, "operand", "osig"))
    stage = runs.filter("missing > 0 and extra = 0 and max_missing < first_bit").select(*key, "operand", (F.col("max_missing") + 1).alias("osig"))
    bits = t.bus_bits.select(C, F.col("bus").alias("operand"), F.col("significance").alias("osig"), "net")
    want = extra.union(stage).distinct().join(bits, [C, "operand", "osig"]).select(*key, "net")
    first = t.bus_bits.select(C, "bus", F.col("significance").alias("first_bit"), "net").join(runs.select(*key).distinct(), [C, "bus", "first_bit"])
    root = F.concat_ws(":", "bus", F.col("first_bit").cast("string"), F.col("last_bit").cast("string")).alias("root")
    drv = t.pins.filter("direction = 'output'").join(first, NET).select(C, root, "gate_id")
    cone = graph.cones(t.edges, drv)
    reads = t.pins.filter("direction = 'input'").join(want, NET).select(*key, root, "gate_id").distinct()
    return reads.join(cone, [C, "root", "gate_id"], "left_semi").select(*key, "gate_id")


def consequences(classified: DataFrame, bus_bits: DataFrame, pins: DataFrame) -> DataFrame:
    """(circuit_id, bus, first_bit, last_bit, consequence_of): runs whose first bit depends on a deviating net of another
    run, with the sorted buses of those runs.

    One walk for all runs: each gate carries the set of deviating nets it depends on as words of bits.
    """
    key = [C, "bus", "first_bit", "last_bit"]
    nets = classified.select(*key).join(bus_bits.select(C, "bus", "significance", "net"), [C, "bus"]).filter("significance between first_bit and last_bit")
    nets = materialise(nets, "deviating")
    sets = graph.support_sets(pins, nets, stop=False)
    heads = nets.filter("significance = first_bit")
    up = graph.driven_support(sets, pins, heads).join(heads.select(*key, "net"), NET)
    other = nets.select(C, F.col("net").alias("source"), F.col("bus").alias("by"), F.col("first_bit").alias("_f"), F.col("last_bit").alias("_l"))
    hit = up.join(other, [C, "source"]).filter("not (bus = by and first_bit = _f and last_bit = _l)")
    return hit.groupBy(*key).agg(F.array_sort(F.collect_set("by")).alias("consequence_of"))  # buses of one cone


def bus_runs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Dependencies on input bits, driven bits, ripple pairs and their deviating runs, written for the checks that read them."""
    profile, driven = input_profile(t), driven_bits(t.bus_bits, t.pins)
    ripple = materialise(ripple_pattern(profile, t.bus_bits, driven), "ripple")
    return profile, driven, ripple, materialise(deviant_runs(profile, ripple, driven), "runs")


def bit_pattern_members(t: Tables) -> DataFrame:
    """Finding members of all deviating runs: a row per net and per gate; `info` for consequences of other runs."""
    profile, driven, ripple, runs = t.bus_runs
    classified = materialise(classify_runs(runs), "classified")
    key = [C, "bus", "first_bit", "last_bit"]
    after = consequences(classified, t.bus_bits, t.pins).select(*key, F.lit(True).alias("_after"))
    head = classified.join(after, key, "left").select(*key, "check", F.when(F.col("_after"), "info").otherwise("warning").alias("severity"), _run_subject().alias("subject"))
    nets = head.join(t.bus_bits.select(C, "bus", "significance", "net"), [C, "bus"]).filter("significance between first_bit and last_bit")
    none_g, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")
    out = [C, "check", "severity", "subject"]
    return nets.select(*out, none_g.alias("gate_id"), none_s.alias("pin"), "net").union(
        run_gates(profile, ripple, driven, runs, t).join(head, key).select(*out, "gate_id", none_s.alias("pin"), none_s.alias("net")))


def inverted_share(bus_bits: DataFrame, pins: DataFrame, gates: DataFrame, cones: DataFrame) -> DataFrame:
    """Share of an operand's bits that an inverter inside the bus's cone reads."""
    inv = gates.filter("cell like 'INV%'").select(*GATE)
    op = bus_bits.filter("kind = 'input'").select(C, F.col("bus").alias("operand"), "net")
    read = (pins.filter("direction = 'input'").join(inv, GATE, "left_semi").join(op, NET)
            .join(cones.withColumnRenamed("root", "bus"), GATE).select(C, "bus", "operand", "net").distinct())
    size = op.groupBy(C, "operand").agg(F.count(F.lit(1)).alias("w"))
    return (read.groupBy(C, "bus", "operand").agg(F.count(F.lit(1)).alias("n")).join(size, [C, "operand"])
            .select(C, "bus", "operand", F.round(F.col("n") / F.col("w"), 2).alias("inverted")))


def cone_signatures(driven: DataFrame, operands: DataFrame, feeds: DataFrame, inverted: DataFrame) -> DataFrame:
    """Class of every target bus from its operand patterns, its feeding buses and inverted operand bits.

    `operands` and `feeds` come from `pattern_class` (towards inputs and towards internal buses).
    """
    width = driven.groupBy(C, "bus").agg(F.count(F.lit(1)).alias("width"))
    f = feeds.groupBy(C, "bus").agg(
        F.count_if(F.col("pattern") == "bitwise").alias("bitwise_feeds"), F.count_if(F.col("pattern") == "triangular").alias("tri_feeds"),
        F.max(F.when(F.col("pattern") == "triangular", F.col("operand_width"))).alias("feed_width"))
    tri = F.col("pattern") == "triangular"
    o = operands.join(inverted, PAIR, "left").na.fill(0.0, ["inverted"])
    agg = o.groupBy(C, "bus").agg(
        F.count_if(tri).alias("tri"), F.max(F.when(tri, F.col("operand_width"))).alias("tri_width"),
        F.max(F.when(tri, F.col("bits"))).alias("tri_bits"), F.count_if(F.col("pattern") == "full").alias("full"))
    two = top_k(o.filter(tri), [C, "bus"], [F.col("inverted").desc(), F.col("operand")], 2, "_r")
    inv = two.groupBy(C, "bus").agg(F.max(F.when(F.col("_r") == 1, F.col("inverted"))).alias("inv1"),
                                    F.max(F.when(F.col("_r") == 2, F.col("inverted"))).alias("inv2"))
    j = width.join(f, [C, "bus"], "left").join(agg, [C, "bus"], "left").join(inv, [C, "bus"], "left")
    j = j.na.fill(0, ["bitwise_feeds", "tri_feeds", "tri", "full"])
    cls = (F.when(F.col("bitwise_feeds") >= 2, "select-like")
           .when(F.col("tri_feeds") >= 2, F.when(F.col("width") >= 1.75 * F.col("feed_width"), "multiplier-like").otherwise("adder-like"))
           .when(F.col("tri") >= 1, F.when(F.col("tri_bits") >= 1.75 * F.col("tri_width"), "multiplier-like")
                 .when((F.col("inv1") >= 0.5) & (F.col("inv2") <= 0.25), "subtractor-like").otherwise("adder-like"))
           .when((F.col("full") >= 2) & (F.col("width") <= 2), "comparator-like").otherwise("unclassified"))
    return j.select(C, "bus", "width", "bitwise_feeds", "tri_feeds", "tri", "full", cls.alias("classification"),
                    F.coalesce(F.when(F.col("tri_feeds") >= 2, F.col("feed_width")), "tri_width", "width").alias("operand_width"))


def operand_buses(signatures: DataFrame, operands: DataFrame, feeds: DataFrame) -> DataFrame:
    """The buses a classified bus works on: (circuit_id, bus, operand)."""
    s = signatures.select(C, "bus", "classification", "tri_feeds")
    pick = (F.when(F.col("classification") == "select-like", "bitwise").when(F.col("classification") == "comparator-like", "full")
            .otherwise("triangular"))
    by_feed = (F.col("classification") == "select-like") | (F.col("tri_feeds") >= 2)
    s = s.withColumn("_p", pick).withColumn("_f", by_feed)
    both = feeds.select(*PAIR, "pattern", F.lit(True).alias("_s")).union(operands.select(*PAIR, "pattern", F.lit(False)))
    known = (s.filter("classification <> 'unclassified'").join(both, [C, "bus"])
             .filter((F.col("_p") == F.col("pattern")) & (F.col("_f") == F.col("_s"))).select(*PAIR))
    rest = s.filter("classification = 'unclassified'").join(operands, [C, "bus"]).select(*PAIR)
    return known.union(rest).distinct()


def infer_blocks(signatures: DataFrame, ops: DataFrame, driver_blocks: DataFrame, has_hints: DataFrame) -> DataFrame:
    """Role, width and phrase of every classified bus with the confidence of the guess.

    `driver_blocks` is (circuit_id, bus, block); `has_hints` is (circuit_id, hints boolean).
    """
    s = signatures.filter("classification <> 'unclassified'")
    pairs = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    s = s.withColumn("role", pairs[F.col("classification")])
    name = driver_blocks.filter("block <> 'top'").groupBy(C, "bus").agg(F.min("block").alias("block"))
    s = s.join(name, [C, "bus"], "left").join(has_hints, C, "left")
    w = F.col("operand_width").cast("string")
    phrase = (F.when(F.col("role") == "multiplier", F.concat(w, F.lit("x"), w, F.lit(" multiplier")))
              .when(F.col("role") == "control", F.lit("output select logic")).otherwise(F.concat(w, F.lit("-bit "), F.col("role"))))
    return s.select(C, "bus", "role", "operand_width", phrase.alias("phrase"),
                    F.coalesce("block", F.concat("role", F.lit("_"), F.col("bus"))).alias("block"),
                    F.round(0.55 * F.when(F.col("hints"), 1.0).otherwise(0.6), 2).alias("confidence"))


def inferred_dataflow(blocks: DataFrame, ops: DataFrame) -> DataFrame:
    """Block to block over the bus one produces and the other works on."""
    src = blocks.select(C, F.col("bus").alias("operand"), F.col("block").alias("from_block"))
    dst = blocks.select(C, "bus", F.col("block").alias("to_block"))
    return (ops.join(src, [C, "operand"]).join(dst, [C, "bus"]).filter("from_block <> to_block")
            .select(C, "from_block", "to_block", F.col("operand").alias("via_bus")).distinct())


def _template_deviations(templates: DataFrame, profile: DataFrame, targets: DataFrame, live: DataFrame) -> DataFrame:
    """Target bits that depend on other operand bits than the template asks for: the keys of `templates` and significance."""
    words = _packed(live.select(C, F.col("bus").alias("operand"), F.col("significance").alias("osig")), [C, "operand"], "live")
    bits = templates.join(targets.select(C, "bus", "significance").distinct(), [C, "bus"])
    key, zero = [C, "template", "bus", "operand", "significance"], F.lit(0).cast("long")
    every = "template = 'comparator_all_bits'"
    want = bits.join(words, [C, "operand"]).select(*key, "oword", F.expr(f"CASE WHEN {every} THEN live ELSE live & {_upto('significance')} END").alias("want"), zero.alias("have"))
    have = bits.join(_masks(profile), [*PAIR, "significance"]).select(*key, "oword", zero.alias("want"), F.col("mask").alias("have"))
    both = want.union(have).groupBy(*key, "oword").agg(F.bit_or("want").alias("want"), F.bit_or("have").alias("have"))
    return both.filter(f"want & ~have <> 0 OR (NOT ({every}) AND have & ~want <> 0)").select(*key).distinct()


def check_templates(templates: DataFrame, profile: DataFrame, targets: DataFrame, live: DataFrame) -> DataFrame:
    """Pass or fail of dependency templates (circuit_id, template, bus, operand).

    `comparator_all_bits` needs every live operand bit in every target bit; the arithmetic templates need
    exactly the live bits up to the target's own significance.
    """
    bad = _template_deviations(templates, profile, targets, live).groupBy(C, "template", "bus", "operand").agg(F.count(F.lit(1)).alias("bad_bits"))
    return (templates.join(bad, [C, "template", "bus", "operand"], "left").na.fill(0, ["bad_bits"])
            .withColumn("status", F.when(F.col("bad_bits") > 0, "fail").otherwise("pass")))


def templates_of(signatures: DataFrame, operands: DataFrame) -> DataFrame:
    """(circuit_id, template, bus, operand): the template of every classified bus with its operands among the input buses."""
    kind = F.create_map(*[F.lit(x) for kv in TEMPLATE.items() for x in kv])
    s = signatures.select(C, "bus", kind[F.col("classification")].alias("template")).filter("template is not null")
    return s.join(operands.filter("pattern in ('triangular', 'full')"), [C, "bus"]).filter(
        F.when(F.col("template") == "comparator_all_bits", F.col("pattern") == "full").otherwise(F.col("pattern") == "triangular")).select(C, "template", "bus", "operand")


def intent_members(templates: DataFrame, profile: DataFrame, live: DataFrame, runs: DataFrame, t: Tables) -> DataFrame:
    """Members of `intent_dependency` findings, one row per deviating bit and gate that drives it.

    An arithmetic template whose deviation a run of the same bus already reports gives no finding of its own.
    """
    targets = driven_bits(t.bus_bits, t.pins)
    bad = materialise(_template_deviations(templates, profile, targets, live).select(C, "template", "bus", "significance").distinct(), "deviations")
    said = (bad.filter("template <> 'comparator_all_bits'").join(runs.select(C, "bus", "first_bit", "last_bit"), [C, "bus"])
            .filter("significance between first_bit and last_bit").select(C, "template", "bus").distinct())
    new = bad.join(said, [C, "template", "bus"], "left_anti").join(t.bus_bits.select(C, "bus", "significance", "net"), [C, "bus", "significance"])
    drv = t.pins.filter("direction = 'output'").select(*NET, "gate_id")
    return new.join(drv, NET).select(C, F.lit("intent_dependency").alias("check"), F.lit("warning").alias("severity"), F.concat_ws(":", "template", "bus").alias("subject"),
                                     "gate_id", F.lit(None).cast("string").alias("pin"), "net")


def intent_checks(t: Tables) -> DataFrame:
    """Infers what each bus computes and checks the dependencies that follow from it; see `intent_members`."""
    live, (profile, driven, _, runs) = materialise(live_bits(t.bus_bits, t.nets), "live"), t.bus_runs
    operands = materialise(pattern_class(profile, live), "patterns")
    feeds = pattern_class(feed_profile(t), live)
    roots = t.pins.filter("direction = 'output'").join(t.bus_bits.filter("kind <> 'input'"), NET).select(C, F.col("bus").alias("root"), "gate_id")
    inverted = inverted_share(t.bus_bits, t.pins, t.gates, graph.cones(t.edges, roots))
    signatures = cone_signatures(driven.filter("kind <> 'input'"), operands, feeds, inverted)
    return intent_members(templates_of(signatures, operands), profile, live, runs, t)


def check_carry_templates(templates: DataFrame, gates: DataFrame, members: DataFrame) -> DataFrame:
    """`carry_chain` templates (circuit_id, block): broken links found by other checks on the block's adder cells."""
    add = gates.filter(F.col("cell").rlike(S.ADDER_CELL)).select(*GATE, F.col("hier_prefix").alias("block"))
    n = add.groupBy(C, "block").agg(F.count(F.lit(1)).alias("adder_cells"))
    kinds = ("missing_pin", "floating_net", "carry_out_unread", "dangling_output", "carry_break", "multi_driver")
    hit = (members.filter(F.col("check").isin(*kinds) & F.col("gate_id").isNotNull()).join(add, GATE)
           .select(C, "block", "check", "subject").distinct().groupBy(C, "block").agg(F.count(F.lit(1)).alias("related")))
    j = templates.select(C, "block").join(n, [C, "block"], "left").join(hit, [C, "block"], "left").na.fill(0)
    status = F.when(F.col("adder_cells") == 0, "not_checkable").when(F.col("related") > 0, "fail").otherwise("pass")
    return j.withColumn("status", status)


def evidence_profile(gates: DataFrame, top: int = 15) -> DataFrame:
    """Cell families per circuit, most frequent first, with the circuit's share of arithmetic cells."""
    from wireloom.functions import names
    fam = gates.groupBy(C, names.cell_base("cell").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    tot = fam.groupBy(C).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("family").rlike(S.ARITHMETIC_FAMILY), F.col("n")).otherwise(0)).alias("arith"))
    return (top_k(fam, [C], [F.col("n").desc(), F.col("family")], top).join(tot, C)
            .select(C, "rank", "family", "n", F.round(F.col("arith") / F.col("total"), 3).alias("arithmetic_share")))
