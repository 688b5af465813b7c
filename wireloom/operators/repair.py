"""Repair suggestions: pair pins that need a wire with outputs that offer one.

sinks(circuit_id, sink_id, kind 'pin'|'po', gate_id, pin, net, block, allow_pi)
sources(circuit_id, source_id, kind 'gate'|'pi', gate_id, pin, net, block, penalty, reusable)

The score of a pair is 1 - penalty, +3 in the same block, +4 for CO to CI, -1 for another source of a CI
pin, minus the id distance (at most 1), +1 when both nets have the same name stem; a port as source of a
port costs 2. Only the best source of a sink is needed, and for fixed properties of the source that is
the nearest one by id. So every sink looks at the nearest source on both sides in each property class,
and no list of all pairs is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.operators.model import GATE, NET
from wireloom.operators.scale import Store, carry_forward, materialise, numbered, top_k
from wireloom.tables import Tables

C = "circuit_id"
FAR = 2_000_000_000


def name_stem(net) -> Column:
    """Name without its digits: the part two bits of one bus share."""
    return F.regexp_replace(F.coalesce(net, F.lit("")), r"[\d\[\]]+", "")


def broken_ends(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Sinks and sources from the electrical checks of a corpus."""
    from wireloom.operators import checks
    block = t.gates.select(*GATE, F.col("hier_prefix").alias("block"))
    miss = checks.check_missing_pin(t).filter("severity = 'error'").withColumn("allow_pi", F.lit(True))
    flo = checks.check_floating_net(t).withColumn("allow_pi", F.lit(False))
    pin = miss.union(flo).join(block, GATE).select(
        C, F.concat_ws(".", F.lit("pin"), F.col("gate_id").cast("string"), "pin", "net").alias("sink_id"), F.lit("pin").alias("kind"),
        "gate_id", "pin", "net", "block", "allow_pi")
    po = checks.check_undriven_po(t).select(C, F.concat(F.lit("po."), "net").alias("sink_id"), F.lit("po").alias("kind"), F.lit(None).cast("int").alias("gate_id"),
                                            F.lit(None).cast("string").alias("pin"), "net", F.lit(None).cast("string").alias("block"), F.lit(True).alias("allow_pi"))
    dang = checks.check_dangling_output(t).withColumn("penalty", F.lit(0.0)).withColumn("reusable", F.lit(False))
    multi = checks.check_multi_driver(t).filter("gate_id is not null").withColumn("penalty", F.lit(1.0)).withColumn("reusable", F.lit(True))
    gate = dang.union(multi).join(block, GATE).select(
        C, F.concat_ws(".", F.when(F.col("reusable"), "m").otherwise("d"), F.col("gate_id").cast("string"), "pin", "net").alias("source_id"),
        F.lit("gate").alias("kind"), "gate_id", "pin", "net", "block", "penalty", "reusable")
    pi = checks.check_unused_pi(t).select(C, F.concat(F.lit("pi."), "net").alias("source_id"), F.lit("pi").alias("kind"), F.lit(None).cast("int").alias("gate_id"),
                                          F.lit(None).cast("string").alias("pin"), "net", F.lit(None).cast("string").alias("block"), F.lit(0.0).alias("penalty"), F.lit(False).alias("reusable"))
    return pin.union(po), gate.union(pi)


def pair_score() -> Column:
    """Score of a joined pair: sink columns as they are, source columns with prefix s_."""
    gate = F.col("s_kind") == "gate"
    pin = F.col("kind") == "pin"
    stem = F.when((F.col("net") != "") & (F.col("s_net") != "") & (name_stem(F.col("net")) == name_stem(F.col("s_net"))), 1.0).otherwise(0.0)
    to_pin = (F.when(F.col("block") == F.col("s_block"), 3.0).otherwise(0.0)
              + F.when(F.col("s_pin") == "CO", F.when(F.col("pin") == "CI", 4.0).otherwise(0.0)).otherwise(F.when(F.col("pin") == "CI", -1.0).otherwise(0.0))
              - F.least(F.abs(F.col("s_gate_id") - F.col("gate_id")), F.lit(1000)) / 1000.0)
    return (1.0 - F.col("s_penalty") + F.when(pin & gate, to_pin).otherwise(0.0) + F.when(~pin & ~gate, -2.0).otherwise(0.0)
            + F.when(pin | gate, stem).otherwise(0.0))


def best_sources(sinks: DataFrame, sources: DataFrame, k: int = 1) -> DataFrame:
    """The best, or the two best (`k` = 2), sources per sink, best first (ties: larger source id)."""
    anything, same = F.lit("*"), lambda c: F.coalesce(F.col(c), F.lit(""))
    src = sources.withColumn("_stem", name_stem(F.col("net"))).withColumn("_pos", F.coalesce(F.col("gate_id"), F.lit(0)))
    # property classes of a source that a sink can ask for: (block or any) x (stem or any), by kind, carry pin and penalty
    attrs = [F.col("kind").alias("_k"), (F.col("pin").eqNullSafe("CO")).cast("string").alias("_co"), F.col("penalty").cast("string").alias("_pen")]
    wide = lambda df: df.withColumn("_blk", F.explode(F.array(anything, same("block")))).withColumn("_st", F.explode(F.array(anything, F.col("_stem"))))
    item = F.struct(*[F.col(c).alias(f"s_{c}") for c in ("source_id", "kind", "gate_id", "pin", "net", "block", "penalty", "reusable")])
    s_rows = wide(src.select(C, "block", "_stem", "_pos", *attrs, item.alias("item"))).select(
        C, "_blk", "_st", "_k", "_co", "_pen", "_pos", F.lit(None).cast("string").alias("sink_id"), "item")
    ask = F.array(*[F.struct(F.lit(k_).alias("_k"), F.lit(co).alias("_co"), F.lit(pen).alias("_pen"))
                    for k_, co, pen in (("gate", "true", "0.0"), ("gate", "true", "1.0"), ("gate", "false", "0.0"), ("gate", "false", "1.0"), ("pi", "false", "0.0"))])
    q = sinks.withColumn("_stem", name_stem(F.col("net"))).withColumn("_a", F.explode(ask)).filter("allow_pi or _a._k <> 'pi'")
    pos = F.when((F.col("_a._k") == "pi") | F.col("gate_id").isNull(), F.lit(FAR)).otherwise(F.col("gate_id"))
    q = wide(q.withColumn("_pos", pos)).select(C, "_blk", "_st", F.col("_a._k").alias("_k"), F.col("_a._co").alias("_co"), F.col("_a._pen").alias("_pen"), "_pos", "sink_id",
                                                     F.lit(None).cast(s_rows.schema["item"].dataType).alias("item"))
    group = [C, "_blk", "_st", "_k", "_co", "_pen"]
    both = s_rows.union(q.distinct())
    both = materialise(both, "positions")
    source_first, source_last = F.col("sink_id").isNotNull(), F.col("sink_id").isNull()
    cut = F.floor(F.col("_pos") / 65536)

    def look(shift, tie, backward):
        """Nearest source strictly below or above each sink: sources at its own place belong to its own gate.

        For more than one candidate every source also carries the one before it.
        """
        d = both
        if k > 1:
            s_only = carry_forward(d.filter("sink_id is null"), group, cut, [F.col("_pos"), F.col("item.s_source_id")], F.col("item"), "prev", backward, strict=True)
            d = s_only.unionByName(d.filter("sink_id is not null").withColumn("prev", F.col("item")))
        d = d.withColumn("_pos", F.when(F.col("sink_id").isNotNull(), F.col("_pos") + shift).otherwise(F.col("_pos")))
        value = F.when(F.col("sink_id").isNull(), F.array("item", "prev") if k > 1 else F.array("item"))
        d = carry_forward(d, group, cut, [F.col("_pos"), tie, F.col("item.s_source_id")], value, "near", backward)
        return d.filter("sink_id is not null and near is not null").select(C, "sink_id", F.explode("near").alias("n")).filter("n is not null").select(C, "sink_id", "n.*")

    near = look(-1, source_first, False).union(look(1, source_last, True))
    j = sinks.join(near.distinct(), [C, "sink_id"]).filter(~F.col("gate_id").eqNullSafe(F.col("s_gate_id")) | F.col("gate_id").isNull())
    return top_k(j.withColumn("score", pair_score()), [C, "sink_id"], [F.col("score").desc(), F.col("s_source_id").desc()], k, "candidate")


# ------------------------------------------------------------------ assignment
#: Broken ends of one circuit that a task settles in one round.
BATCH = 2000
#: Sources beyond those that the ends of a batch can use up; they settle ties and second choices.
SPARE = 4
_OFFER = ("source_id", "kind", "gate_id", "pin", "net", "block", "penalty", "reusable")


def _offers(sources: DataFrame) -> DataFrame:
    """Sources in every list that a broken end may search: (circuit_id, list, seq, size, pos, s_...).

    Pins search sources of gates by position, one list for each carry pin, penalty, block (or any) and name stem (or
    any). Where the position doesn't count (ports on either side) lists are in the order of source ids.
    """
    stem = F.concat(F.lit("="), name_stem(F.col("net")))
    st = F.explode(F.array(F.lit("*"), stem)).alias("_st")
    item = [F.col(c).alias(f"s_{c}") for c in _OFFER]
    gate = sources.filter("kind = 'gate'")
    blk = F.explode(F.array(F.lit("*"), F.concat(F.lit("="), F.coalesce("block", F.lit(""))))).alias("_blk")
    located = (gate.select(C, "*", st).select("*", blk).select(
        C, F.concat_ws("|", F.lit("at"), F.col("pin").eqNullSafe("CO").cast("string"), F.col("penalty").cast("string"), "_blk", "_st").alias("list"), F.col("gate_id").alias("pos"), *item))
    flat = sources.select("*", st).select(C, F.concat_ws("|", F.lit("all"), "kind", F.when(F.col("kind") == "gate", F.col("penalty").cast("string")).otherwise(""), "_st").alias("list"),
                                          F.lit(0).alias("pos"), *item)
    rows = numbered(located.union(flat), [C, "list"], [F.col("pos"), F.col("s_source_id")], "seq")
    rows = materialise(rows, "offers")
    return rows.join(rows.groupBy(C, "list").agg(F.max("seq").alias("size")), [C, "list"])


def _asks(sinks: DataFrame) -> DataFrame:
    """The lists that every broken end searches, with its position: (circuit_id, sink_id, list, at)."""
    stem, blk = F.concat(F.lit("="), name_stem(F.col("net"))), F.concat(F.lit("="), F.coalesce("block", F.lit("")))
    name = lambda *x: F.concat_ws("|", *[F.lit(v) if isinstance(v, str) else v for v in x])
    pin = [name("at", co, pen, b, s) for co in ("true", "false") for pen in ("0.0", "1.0") for b in (F.lit("*"), blk) for s in (F.lit("*"), stem)]
    free = [name("all", "pi", "", s) for s in (F.lit("*"), stem)]
    port = [name("all", "gate", pen, s) for pen in ("0.0", "1.0") for s in (F.lit("*"), stem)] + free[:1]
    none = F.array().cast("array<string>")
    lists = F.when(F.col("kind") == "pin", F.concat(F.array(*pin), F.when(F.col("allow_pi"), F.array(*free)).otherwise(none))).otherwise(F.array(*port))
    rows = sinks.select(C, "sink_id", "gate_id", F.explode(F.array_distinct(lists)).alias("list"))
    return rows.select(C, "sink_id", "list", F.when(F.col("list").startswith("at|"), F.col("gate_id")).otherwise(FAR).alias("at"))


def _score(k: dict, s: dict) -> float:
    """Score of one pair, as `pair_score`."""
    out, pin, gate = 1.0 - s["s_penalty"], k["kind"] == "pin", s["s_kind"] == "gate"
    if pin and gate:
        if k["block"] is not None and k["block"] == s["s_block"]:
            out += 3
        out += (4 if k["pin"] == "CI" else 0) if s["s_pin"] == "CO" else (-1 if k["pin"] == "CI" else 0)
        out -= min(abs(s["s_gate_id"] - k["gate_id"]), 1000) / 1000
    elif not pin and not gate:
        out -= 2
    stem = lambda net: re.sub(r"[\d\[\]]+", "", net or "")
    if (pin or gate) and k["net"] and s["s_net"] and stem(k["net"]) == stem(s["s_net"]):
        out += 1
    return round(out, 9)


class _List:
    """What a task knows of one list, with the used sources skipped in both directions."""

    def __init__(self, size: int):
        self.size, self.known, self.onward = size, {}, ({}, {})

    def next(self, seq: int, step: int) -> int:
        """First unused place from `seq` on; places passed on the way then point at it."""
        jump, path = self.onward[step > 0], []
        while seq in jump:
            path.append(seq)
            seq = jump[seq]
        for p in path:
            jump[p] = seq
        return seq

    def nearest(self, seq: int, step: int) -> tuple[list[dict], bool]:
        """The two next unused sources and those at the place of the second; whether all places up to there are known."""
        out = []
        seq = self.next(seq, step)
        while 1 <= seq <= self.size:
            s = self.known.get(seq)
            if s is None:
                return out, False
            if len(out) > 1 and s["pos"] != out[-1]["pos"]:
                break
            out.append(s)
            if len(out) > 1 and step < 0:
                break
            seq = self.next(seq + step, step)
        return out, True


def _settled(batch):
    """The broken ends of one batch, one after the other; each takes its best unused source. Stops where the sources
    that the task was given don't suffice; what is left is settled in the next round."""
    import pandas as pd

    offers, lists, where = batch[batch["sink_id"].isna()].to_dict("records"), {}, {}
    for s in offers:
        own = lists.setdefault(s["list"], _List(int(s["size"])))
        own.known[int(s["seq"])] = s
        where.setdefault(s["s_source_id"], []).append((own, int(s["seq"])))
    asks: dict = {}
    for a in batch[batch["sink_id"].notna()].sort_values(["rank", "list"]).to_dict("records"):
        asks.setdefault(a["sink_id"], []).append(a)
    rows = []
    for sink, own in asks.items():
        found, whole = {}, True
        for a in own:
            for start, step in ((a["low"], -1), (a["high"], 1)):
                if a["list"] in lists and start == start and start is not None:
                    got, known = lists[a["list"]].nearest(int(start), step)
                    found |= {s["s_source_id"]: s for s in got}
                    whole &= known
        if not whole and rows:
            break
        k = own[0]
        ranked = sorted(((_score(k, s), x) for x, s in found.items() if k["kind"] != "pin" or s["s_gate_id"] != k["gate_id"]), reverse=True)
        best = ranked[0] if ranked else (None, None)
        rows.append((k[C], sink, best[1], best[0], ranked[1][0] if len(ranked) > 1 else None))
        if best[1] is not None and not found[best[1]]["s_reusable"]:
            for at, seq in where[best[1]]:
                at.onward[0][seq], at.onward[1][seq] = seq - 1, seq + 1
    return pd.DataFrame(rows, columns=[C, "sink_id", "s_source_id", "score", "second"])


def assign(sinks: DataFrame, sources: DataFrame, batch: int = BATCH) -> DataFrame:
    """One-to-one assignment, greedy in the order of the sinks' own best scores (ties: larger sink id): every sink takes
    its best unused source (ties: larger source id); sources that can be reused stay free.

    Sinks with the columns of their source (`s_...`), `score`, and `second`: the best score among what else was free at
    that moment (null if nothing was). Sinks without a source are left out.

    A round takes the next `batch` sinks of every circuit. Each of them can use up one source, so beside the nearest
    source of every sink in every list as many of its neighbours are fetched as sinks start there. A task then settles
    the batch of a circuit in order, on a number of rows bounded by the batch; rounds grow with the sinks of the
    largest circuit over `batch`, however contested the sources are.
    """
    ends, src = materialise(sinks, "sinks"), materialise(sources, "sources")
    order = best_sources(ends, src).select(C, "sink_id", F.col("score").alias("priority"))
    todo = materialise(numbered(ends.join(order, [C, "sink_id"]), [C], [F.round("priority", 9).desc(), F.col("sink_id").desc()], "rank"), "ordered")
    free, done = src, Store(sinks.sparkSession, "assigned")
    circuit = sinks.schema[C].dataType.simpleString()
    while True:
        now = top_k(todo, [C], [F.col("rank")], batch, "_turn").drop("_turn")
        offers = materialise(_offers(free), "offers")
        asks, group = _asks(now), [C, "list"]
        both = materialise(offers.select(*group, "pos", "seq", F.lit(None).cast("string").alias("sink_id")).union(
            asks.select(*group, F.col("at").alias("pos"), F.lit(None).cast("long").alias("seq"), "sink_id")), "positions")

        def nearest(shift, name, backward):
            d = both.withColumn("pos", F.col("pos") + F.when(F.col("sink_id").isNotNull(), shift).otherwise(0))
            last = F.col("sink_id").isNull() if backward else F.col("sink_id").isNotNull()  # an end looks past the sources at its place
            tie = F.when(last, 1).otherwise(0)
            d = carry_forward(d, group, F.floor(F.col("pos") / 65536), [F.col("pos"), tie, F.coalesce("seq", F.lit(0))], F.col("seq"), name, backward)
            return d.filter("sink_id is not null").select(*group, "sink_id", name)

        at = materialise(nearest(-1, "low", False).join(nearest(1, "high", True), [*group, "sink_id"]), "nearest")
        starts = at.groupBy(*group, F.col("low").alias("seq")).agg(F.count(F.lit(1)).alias("n")).select(*group, (F.col("seq") - F.col("n") - SPARE).alias("a"), F.col("seq").alias("b")).union(
            at.groupBy(*group, F.col("high").alias("seq")).agg(F.count(F.lit(1)).alias("n")).select(*group, F.col("seq"), F.col("seq") + F.col("n") + SPARE))
        wanted = starts.filter("a is not null").select(*group, F.explode(F.sequence("a", "b")).alias("seq")).distinct()
        given = offers.join(wanted, [*group, "seq"])
        ask = at.join(now.select(C, "sink_id", "rank", "kind", "gate_id", "pin", "net", "block"), [C, "sink_id"])
        rows = ask.unionByName(given, allowMissingColumns=True)
        out = rows.groupBy(C).applyInPandas(_settled, f"{C} {circuit}, sink_id string, s_source_id string, score double, second double")
        out = done.append(out)
        rest = todo.join(out.select(C, "sink_id"), [C, "sink_id"], "left_anti")
        todo = materialise(rest, "ordered")
        if todo.isEmpty():
            break
        used = out.join(src.filter("not reusable").select(C, F.col("source_id").alias("s_source_id")), [C, "s_source_id"]).select(C, F.col("s_source_id").alias("source_id"))
        free = materialise(free.join(used, [C, "source_id"], "left_anti"), "free")
    item = src.select(C, *[F.col(c).alias(f"s_{c}") for c in _OFFER])
    return done.all().filter("s_source_id is not null").join(ends, [C, "sink_id"]).join(item, [C, "s_source_id"])


def _by_margin(margin: Column) -> Column:
    m = F.round(F.coalesce(margin, F.lit(99.0)), 9)
    return F.when(m >= 2, 0.9).when(m >= 0.5, 0.6).otherwise(0.4)


def margin_confidence(best: DataFrame, candidates: DataFrame) -> DataFrame:
    """0.9 from a margin of 2 to the second candidate, 0.6 from 0.5, else 0.4; 0.9 without a second one."""
    two = candidates.filter("candidate = 2").select(C, "sink_id", F.col("score").alias("_second"))
    return best.join(two, [C, "sink_id"], "left").withColumn("confidence", _by_margin(F.col("score") - F.col("_second"))).drop("_second")


def confidence(assigned: DataFrame, sources: DataFrame) -> DataFrame:
    """0.9, 0.6 or 0.4 by the margin to the best source that was left; drivers of a shared net get 1/n each.

    A source of a multiply driven net stands for all drivers of that net: one row per driver.
    """
    a = assigned.withColumn("confidence", _by_margin(F.col("score") - F.col("second")))
    n = sources.filter("reusable").groupBy(C, "net").agg(F.count(F.lit(1)).alias("_n"))
    grp = sources.filter("reusable").join(n, NET).select(C, F.col("net").alias("s_net"), F.col("gate_id").alias("from_gate"), F.col("pin").alias("from_pin"), "_n")
    single = a.filter(~F.col("s_reusable")).select(C, "sink_id", F.col("s_gate_id").alias("from_gate"), F.col("s_pin").alias("from_pin"), F.col("s_net").alias("from_net"), "confidence",
                                                   F.lit(False).alias("ambiguous"))
    many = a.filter("s_reusable").join(grp, [C, "s_net"]).select(C, "sink_id", "from_gate", "from_pin", F.col("s_net"), F.round(1.0 / F.col("_n"), 2), F.lit(True))
    return single.union(many)


def inherit_repairs(structural: DataFrame, repairs: DataFrame) -> DataFrame:
    """Structural findings take over the repairs of broken pins on their gates.

    structural(circuit_id, subject, gate_id); repairs(circuit_id, to_gate, to_pin, from_gate, from_pin).
    """
    return structural.join(repairs.withColumnRenamed("to_gate", "gate_id"), GATE).select(C, "subject", F.col("gate_id").alias("to_gate"), "to_pin", "from_gate", "from_pin").distinct()


def verify_candidates(responses: DataFrame, expected: DataFrame) -> DataFrame:
    """Which candidates answer every recorded input as expected, and what that says about the sink.

    responses(circuit_id, sink_id, candidate, row_id, value); expected(circuit_id, sink_id, row_id, value).
    """
    n = expected.groupBy(C, "sink_id").agg(F.count(F.lit(1)).alias("_n"))
    e = expected.select(C, "sink_id", "row_id", F.col("value").alias("_e"))
    ok = (responses.join(e, [C, "sink_id", "row_id"]).groupBy(C, "sink_id", "candidate")
          .agg(F.count_if(F.col("value") == F.col("_e")).alias("matching")).join(n, [C, "sink_id"])
          .withColumn("accepted", F.col("matching") == F.col("_n")))
    k = ok.groupBy(C, "sink_id").agg(F.count_if("accepted").alias("_k"))
    verdict = F.when(F.col("_k") == 1, "verified").when(F.col("_k") > 1, "equivalent").otherwise("no_fix_found")
    return ok.join(k, [C, "sink_id"]).select(C, "sink_id", "candidate", "matching", "accepted", verdict.alias("verdict"))


def _order_free(*columns: str) -> list:
    """Count and sums of two independent hashes: the same whatever the order, and equal rows don't cancel."""
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("n"), wide(*columns).alias("h1"), wide(F.lit("second"), *columns).alias("h2")]


def gate_signatures(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """Order-free fingerprint of a gate: its cell and the cell types at the far end of each pin."""
    cell = gates.select(*GATE, "cell")
    p = pins.select(*GATE, "pin", "net", "direction").join(cell, GATE)
    # what a net looks like from outside: its driver and reader cell types, order-free
    look = p.groupBy(*NET, "direction").agg(*_order_free("cell", "pin"))
    look = look.groupBy(*NET).agg(F.max(F.when(F.col("direction") == "output", F.struct("n", "h1", "h2"))).alias("_d"),
                                  F.max(F.when(F.col("direction") == "input", F.struct("n", "h1", "h2"))).alias("_r"))
    far = F.when(F.col("direction") == "input", F.col("_d")).otherwise(F.col("_r"))
    s = p.join(look, NET).withColumn("_f", far)
    return s.groupBy(*GATE, "cell").agg(*_order_free("pin", "_f")).select(
        *GATE, F.concat_ws("|", "cell", *[F.col(x).cast("string") for x in ("n", "h1", "h2")]).alias("signature"))


def align_by_signature(a: DataFrame, b: DataFrame) -> DataFrame:
    """Gates of two versions of a circuit paired where a signature is unique on both sides.

    Both are (circuit_id, gate_id, signature, inst); equal instance names settle repeated signatures.
    """
    key = [C, "signature"]
    one = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("gate_id").alias("gate_id")).filter("n = 1")
    unique = one(a).select(*key, F.col("gate_id").alias("gate_a")).join(one(b).select(*key, F.col("gate_id").alias("gate_b")), key)
    u = unique.select(C, "gate_a", "gate_b", F.lit("signature").alias("by"))
    rest_a = a.join(u.select(C, F.col("gate_a").alias("gate_id")), GATE, "left_anti").select(*key, "inst", F.col("gate_id").alias("gate_a"))
    rest_b = b.join(u.select(C, F.col("gate_b").alias("gate_id")), GATE, "left_anti").select(*key, "inst", F.col("gate_id").alias("gate_b"))
    return u.union(rest_a.join(rest_b, [*key, "inst"]).select(C, "gate_a", "gate_b", F.lit("name")))
