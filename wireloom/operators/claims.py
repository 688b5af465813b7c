"""Checks of written statements against the circuit tables: references, connections, predictions, numbers.

Texts are (text_id, circuit_id, text). They are split into lines and sentences, every claim becomes a
row, false claims are found with joins, and the surviving sentences are put together again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.functions import statements
from wireloom.operators.scale import carry_forward, top_k

C = "circuit_id"
TEXT = ["text_id", C]
SENT = ["text_id", "line_no", "sent_no"]

# ---- fixed values: the written forms of references and marks -----------------
REFERENCE = r"\[(?:G\d+|F\d+|M\d+|N:(?:[^\[\]]|\[\d+\])+|B:[^\[\]\s]+)\]"
UNVERIFIED = "[unverified]"
QUALIFIER = " (GraphSAINT prediction, not a verified fact)"
# lookups by priority, and the words of a question that lead to them (`*`: any ending)
TOPICS = (
    ("trace_path", "path, trace, route, between, reach, reaches, flow, flows"),
    ("list_findings", "issue, issues, problem, problems, error, errors, warning, warnings, wrong, fault, faults, faulty, missing, suspicious, flagged, "
                      "finding, findings, broken, unconnected, floating, dangling, health, healthy"),
    ("timing_analysis", "timing, critical, longest, delay, delays, propagation, bottleneck, bottlenecks, slow*, latency, depth, level, levels, performance, "
                        "speed, fast*, high fan out, high fan outs, high fanout, high fanouts"),
    ("power_analysis", "power, switching, activity, toggl*, energy, dynamic, leakage, glitch*, consum*"),
    ("area_analysis", "area, largest, biggest, size, gate count, gate counts, concentrat*, logic heavy, duplicat*, redundan*, simplif*, footprint"),
    ("optimization_suggestions", "optimis*, optimiz*, improv*, reduc*, ppa, speedup, speed up, shrink"),
    ("circuit_overview", "block, blocks, datapath, datapaths, data path, data paths, control signal, control signals, input and output, input and outputs, "
                         "inputs and output, inputs and outputs, output and input, output and inputs, outputs and input, outputs and inputs, port, ports, overview, architecture, main part, main parts"),
    ("get_neighborhood", "graphsaint, predict*, gnn, classif*"),
)
DEICTIC = "this, that, these, those, it, its, they, them, their, same, above, previous, selected"
MAX_LOOKUPS = 4
# ------------------------------------------------------------------------------


def _all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sentences(texts: DataFrame) -> DataFrame:
    """One row per sentence with its line and position."""
    lines = texts.select(*TEXT, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select(*TEXT, "line_no", "line", F.posexplode(F.split("line", r"(?<=[.!?])\s+")).alias("sent_no", "sentence"))


def reassemble(kept: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts from the surviving sentences of `sentences`.

    Lines whose sentences are all gone disappear, and so does a lead-in ending with a colon that is no
    longer followed by a list item.
    """
    lines = kept.groupBy(*TEXT, "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))), lambda s: s["sentence"]), " ").alias("line"))
    # the next line with content
    full = F.when(F.trim("line") != "", F.col("line"))
    nxt = F.first(full, ignorenulls=True).over(Window.partitionBy("text_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing))
    lines = lines.withColumn("_next", F.coalesce(nxt, F.lit("")))
    lead = F.regexp_replace("line", r"[ *_]+$", "").endswith(":") & ~F.col("_next").rlike(r"^\s*([-*]\s|[0-9]+\.\s)")
    lines = lines.filter(~lead)
    out = lines.groupBy(*TEXT).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("_t"))
    tidy = F.trim(F.regexp_replace("_t", r"\n{3,}", "\n\n"))
    return texts.select(*TEXT).join(out, TEXT, "left").select(*TEXT, F.coalesce(tidy, F.lit("")).alias("text"))


# ------------------------------------------------------------------ references
def _kind_key(ref: Column) -> tuple[Column, Column]:
    kind = F.substring(ref, 2, 1)
    body = F.regexp_replace(ref, r"^\[(?:[NB]:|[GFM])|\]$", "")
    return kind, body


def extract_refs(texts: DataFrame) -> DataFrame:
    """Every reference tag with its sentence: (text_id, circuit_id, line_no, sent_no, kind, key)."""
    s = sentences(texts).select(*TEXT, "line_no", "sent_no", F.explode(_all("sentence", REFERENCE)).alias("ref"))
    kind, key = _kind_key(F.col("ref"))
    return s.select(*TEXT, "line_no", "sent_no", "ref", kind.alias("kind"), key.alias("key"))


def _pieces(texts: DataFrame, pattern: str) -> DataFrame:
    """Text cut at every match: the piece before it and the match itself, in order."""
    p = F.split("text", pattern)
    return texts.select(*TEXT, F.posexplode(F.arrays_zip(p.alias("before"), _all("text", pattern).alias("ref"))).alias("pos", "p")).select(
        *TEXT, "pos", F.col("p.before").alias("before"), F.col("p.ref").alias("ref"))


def _join_pieces(df: DataFrame, new: Column) -> DataFrame:
    part = F.concat("before", F.coalesce(new, F.lit("")))
    return df.groupBy(*TEXT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("x")))), lambda s: s["x"]), "").alias("text"))


def validate_refs(texts: DataFrame, dims: DataFrame) -> DataFrame:
    """Unknown references become `[unverified]`; `dims` is (circuit_id, kind, key)."""
    p = _pieces(texts, REFERENCE)
    kind, key = _kind_key(F.col("ref"))
    known = dims.select(C, "kind", "key").distinct().withColumn("_ok", F.lit(True))
    j = p.withColumn("kind", kind).withColumn("key", key).join(known, [C, "kind", "key"], "left")
    return _join_pieces(j, F.when(F.col("ref").isNull() | F.col("_ok"), F.col("ref")).otherwise(UNVERIFIED))


def normalize_refs(texts: DataFrame, dims: DataFrame) -> DataFrame:
    """Near-miss tags into canonical ones; [N:..] and [B:..] are exchanged when only the other one exists.

    A tag is its letters, a sign and a body: gates and findings are written by number, placeholders in angle brackets
    go, and what is tagged as a gate, finding or block without a number is the bare name.
    """
    t = F.regexp_replace("text", r"\\\\(\w)", r"\\$1")
    p = _pieces(texts.withColumn("text", t), r"\[[^\[\]]*(?:\[\d+\][^\[\]]*)*\]")
    inner = F.trim(F.expr("substring(ref, 2, length(ref) - 2)"))
    head = F.upper(F.regexp_extract(inner, r"^([A-Za-z]+)", 1))
    body = F.trim(F.regexp_replace(inner, r"^[A-Za-z]+\s*[:#]?\s*", ""))
    # "F12" and "F:12" have their number behind the letter, "F:F12" behind a second one
    digits = F.regexp_extract(body, r"^[Ff]?0*([0-9]{1,4})$", 1)
    joined = F.regexp_extract(inner, r"^[Ff]0*([0-9]{1,4})$", 1)
    number = F.when(joined != "", joined).otherwise(digits)
    gate = head.isin("G", "GATE") & body.rlike("^[0-9]+$")
    finding = (head == "F") & (number != "")
    named = head.isin("G", "F", "BLOCK", "BLK") & F.regexp_extract(inner, "^[A-Za-z]+ *(:)", 1).eqNullSafe(":") & ~body.rlike("^[0-9<]")
    kind, key = _kind_key(F.col("ref"))
    names = dims.filter("kind in ('N','B')").groupBy(C, "key").agg(F.bool_or(F.col("kind") == "N").alias("_n"), F.bool_or(F.col("kind") == "B").alias("_b"))
    j = p.withColumn("kind", kind).withColumn("key", key).join(names, [C, "key"], "left")
    tag = lambda letter, x: F.concat(F.lit(f"[{letter}"), x, F.lit("]"))
    is_name = F.col("ref").rlike(r"^\[[NB]:")
    new = (F.when(is_name & (F.col("kind") == "N") & F.col("_b") & ~F.col("_n"), tag("B:", F.col("key")))
           .when(is_name & (F.col("kind") == "B") & F.col("_n") & ~F.col("_b"), tag("N:", F.col("key")))
           .when(head.isin("G", "F", "N", "B") & body.rlike("^<.*>$"), F.lit(""))
           .when(gate, tag("G", body)).when(finding, tag("F", F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)))
           .when(named, body).otherwise(F.col("ref")))
    return _join_pieces(j, new)


# ------------------------------------------------------------------ claims
_CLAIM = "kind string, gate int, other int, name string, value long, end int"


def read_claims(rows: DataFrame, reader) -> DataFrame:
    """What `reader` finds in the tokens of each sentence: the keys of the sentence, its place among them, and the claim."""
    keys = rows.select(*TEXT, "line_no", "sent_no")
    names = keys.columns

    def run(batches):
        for b in batches:
            own = [(k, n, c) for k, text in enumerate(b["sentence"].to_pylist()) for n, c in enumerate(reader(statements.tokens(text or "")))]
            at = pa.array([k for k, _, _ in own], pa.int64())
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b[n].take(at) for n in names], pa.array([n for _, n, _ in own], pa.int32()), *[pa.array([c[i] for _, _, c in own], t) for i, t in enumerate(kinds)]],
                                             names=[*names, "i", "kind", "gate", "other", "name", "value", "end"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
    return rows.select(*names, "sentence").mapInArrow(run, f"{head}, i int, {_CLAIM}")


def connection_claims(texts: DataFrame) -> DataFrame:
    """Claims as rows: an edge (src, dst), or a gate at a side of a net (src, net, side)."""
    c = read_claims(sentences(texts), statements.relations)
    edge = F.col("kind") == "edge"
    return c.select(*TEXT, "line_no", "sent_no", F.col("gate").alias("src"), F.col("other").alias("dst"), F.col("name").alias("net"),
                    F.when(~edge, F.col("kind")).alias("side")).distinct()


def false_connections(claims: DataFrame, gates: DataFrame, edges: DataFrame, pins: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Sentences with a claim that both ends exist for but the tables contradict.

    `aliases` (circuit_id, alias, net) names nets by other names; names are matched without a leading backslash.
    """
    g = gates.select(C, "gate_id").distinct()
    e = claims.filter("net is null")
    e = (e.join(g.withColumnRenamed("gate_id", "src"), [C, "src"], "left_semi")
         .join(g.withColumnRenamed("gate_id", "dst"), [C, "dst"], "left_semi"))
    bad_e = e.join(edges.select(C, "src", "dst"), [C, "src", "dst"], "left_anti")
    bare = lambda c: F.regexp_replace(c, r"^\\+", "")
    own = pins.select(C, bare("net").alias("_k"), F.col("net").alias("_net")).distinct()
    known = own if aliases is None else own.union(
        aliases.select(C, bare("alias").alias("_k"), F.col("net").alias("_net")).join(own.select(C, "_k"), [C, "_k"], "left_anti"))
    ends = pins.select(C, F.col("net").alias("_net"), F.col("gate_id").alias("src"), F.when(F.col("direction") == "output", "driver").otherwise("reader").alias("side")).distinct()
    n = (claims.filter("net is not null").withColumn("_k", bare("net")).join(g.withColumnRenamed("gate_id", "src"), [C, "src"], "left_semi")
         .join(known, [C, "_k"]))
    bad_n = n.join(ends, [C, "_net", "src", "side"], "left_anti")
    return bad_e.select(*TEXT, "line_no", "sent_no").union(bad_n.select(*TEXT, "line_no", "sent_no")).distinct()


def check_claims(texts: DataFrame, gates: DataFrame, edges: DataFrame, pins: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Texts without the sentences whose connection claims are false."""
    bad = false_connections(connection_claims(texts), gates, edges, pins, aliases)
    kept = sentences(texts).join(bad, [*TEXT, "line_no", "sent_no"], "left_anti")
    return reassemble(kept, texts)


# ------------------------------------------------------------------ prediction claims
def check_predictions(texts: DataFrame, gates: DataFrame, preds: DataFrame) -> DataFrame:
    """Sentences that misstate a predicted class go; a class that only the prediction supports is marked so."""
    s = sentences(texts)
    key = [*TEXT, "line_no", "sent_no"]
    c = read_claims(s, statements.classes).withColumnRenamed("gate", "gate_id").join(preds.select(C, "gate_id", "pred_class"), [C, "gate_id"])
    bad = c.filter("kind = 'predicted' and value <> pred_class").select(*key).distinct()
    stated = c.filter("kind = 'stated'").join(gates.select(C, "gate_id", "label"), [C, "gate_id"]).filter("value <> label")
    # the first statement that is not what the names say decides
    first = stated.groupBy(*key).agg(F.min(F.struct("i", "value", "pred_class", "end")).alias("v")).select(
        *key, F.when(F.col("v.value") == F.col("v.pred_class"), F.col("v.end")).alias("mark"), F.lit(True).alias("doubt"))
    hedged = F.pandas_udf(lambda x: x.map(statements.hedged), "boolean")
    j = s.join(bad, key, "left_anti").join(first, key, "left").withColumn("doubt", F.coalesce("doubt", F.lit(False)) & ~hedged("sentence"))
    j = j.filter(~F.col("doubt") | F.col("mark").isNotNull())
    marked = F.concat(F.substr("sentence", F.lit(1), F.col("mark")), F.lit(QUALIFIER), F.substr("sentence", F.col("mark") + 1))
    return reassemble(j.withColumn("sentence", F.when(F.col("doubt"), marked).otherwise(F.col("sentence"))), texts)


# ------------------------------------------------------------------ number claims
def check_metrics(texts: DataFrame, depth: DataFrame, totals: DataFrame, nets: DataFrame, gate_fanout: DataFrame,
                  blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Drop sentences with values no table backs: unit values, unmeasured gains, wrong depth, fan-out or counts.

    depth(circuit_id, max_depth), totals(circuit_id, gates), nets(circuit_id, net, n_readers),
    gate_fanout(circuit_id, gate_id, fanout), blocks(circuit_id, block, gates), cells(circuit_id, cell, count).
    """
    soft = F.pandas_udf(lambda x: x.map(statements.softened), "string")
    s = sentences(texts).withColumn("sentence", soft("sentence"))
    key = [*TEXT, "line_no", "sent_no"]
    c = read_claims(s, statements.numbers).select(*key, "kind", "gate", "name", "value")
    of = lambda kind: c.filter(F.col("kind") == kind)
    wrong = lambda df, known, on, count: df.join(known, on).filter(F.col("value") != F.col(count)).select(*key)
    named = lambda df, name, count: df.select(C, F.lower(name).alias("name"), count)
    net = F.regexp_replace("net", r"^\\+", "").alias("name")
    bad = (of("value").select(*key)
           .union(wrong(of("depth"), depth, C, "max_depth")).union(wrong(of("total"), totals, C, "gates"))
           .union(wrong(of("fanout").filter("gate is not null"), gate_fanout.select(C, F.col("gate_id").alias("gate"), "fanout"), [C, "gate"], "fanout"))
           .union(wrong(of("fanout").filter("gate is null").withColumn("name", F.regexp_replace("name", r"^\\+", "")), nets.select(C, net, "n_readers"), [C, "name"], "n_readers"))
           .union(wrong(of("block"), named(blocks, "block", "gates"), [C, "name"], "gates"))
           .union(wrong(of("cell"), named(cells, "cell", "count"), [C, "name"], "count")))
    return reassemble(s.join(bad.distinct(), key, "left_anti"), texts)


# ------------------------------------------------------------------ messages
def _plain(text) -> Column:
    """Lower-case words with single spaces between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9_]+", " ")), F.lit(" "))


def _mentions(words: Column, terms: str) -> Column:
    out = F.lit(False)
    for term in terms.split(", "):
        out = out | words.contains(f" {term[:-1]}" if term.endswith("*") else f" {term} ")
    return out


def _gate_numbers(words: Column) -> Column:
    """Numbers of `G12`, `gate 12` and `gate #12`, in order."""
    return _all(words, r"(?<= )g(?:ate ?)?([0-9]+)(?= )", 1)


def _finding_numbers(words: Column) -> Column:
    return F.transform(_all(words, r"(?<= )f([0-9]{1,4})(?= )", 1), lambda x: F.concat(F.lit("F"), F.when(F.length(x) < 3, F.lpad(x, 3, "0")).otherwise(x)))


def route_messages(messages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lookups of each message in priority order, at most four: gates, findings, named nets, buses and blocks, then topics.

    `names` is (kind, name) with kinds `net`, `bus` and `block`; a message's words are joined to it. Two gates beside a
    word for paths ask for the path between them.
    """
    m = messages.select("conv_id", "turn", "text", _plain(F.col("text")).alias("_w"))
    gates = F.array_distinct(_gate_numbers(F.col("_w")))
    path = _mentions(F.col("_w"), dict(TOPICS)["trace_path"]) & (F.size(gates) >= 2)
    pair = F.when(path, F.array(F.concat(F.lit("trace_path:"), gates[0], F.lit("-"), F.get(gates, F.lit(1)))))
    one = F.transform(F.slice(gates, 1, 3), lambda x: F.concat(F.lit("get_gate:"), x))
    found = F.transform(F.slice(F.array_distinct(_finding_numbers(F.col("_w"))), 1, 2), lambda x: F.concat(F.lit("explain_finding:"), x))
    hits = F.array_compact(F.array(*[F.when(_mentions(F.col("_w"), terms) & ~(path if tool == "trace_path" else F.lit(False)), F.lit(tool)) for tool, terms in TOPICS]))
    none = F.array().cast("array<string>")
    if names is None:
        m = m.withColumn("_named", none)
    else:
        words = m.select("conv_id", "turn", F.explode(F.array_distinct(_all("text", r"[A-Za-z_][\w/$]*(?:\[[0-9]+\])?"))).alias("name"))
        own = words.join(names.select("kind", "name").distinct(), "name").select("conv_id", "turn", F.concat(F.lit("get_"), "kind", F.lit(":"), "name").alias("call"))
        own = top_k(own, ["conv_id", "turn"], [F.col("call")], MAX_LOOKUPS, "_k").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("call")).alias("_named"))
        m = m.join(own, ["conv_id", "turn"], "left").withColumn("_named", F.coalesce("_named", none))
    calls = F.slice(F.array_distinct(F.concat(F.coalesce(pair, none), one, found, F.col("_named"), hits)), 1, MAX_LOOKUPS)
    return m.select("conv_id", "turn", F.posexplode(calls).alias("pos", "lookup")).select("conv_id", "turn", (F.col("pos") + 1).alias("rank"), "lookup")


def carry_subject(turns: DataFrame) -> DataFrame:
    """Subject of every message: the entity it names, else, for "this" and "it", the latest earlier one."""
    t = turns.select("conv_id", "turn", "text", _plain(F.col("text")).alias("_w"))
    g, f = F.get(_gate_numbers(F.col("_w")), F.lit(0)), F.get(_finding_numbers(F.col("_w")), F.lit(0))
    t = t.withColumn("entity", F.when(g.isNotNull(), F.concat(F.lit("gate:"), g)).when(f.isNotNull(), F.concat(F.lit("finding:"), f)))
    t = carry_forward(t, ["conv_id"], F.floor(F.col("turn") / 1024), [F.col("turn")], F.col("entity"), "latest")
    ask = F.col("entity").isNull() & _mentions(F.col("_w"), DEICTIC)
    return t.select("conv_id", "turn", F.coalesce("entity", F.when(ask, F.col("latest"))).alias("subject"))


def validate_edges(suggested: DataFrame, gates: DataFrame, nets: DataFrame, ports: DataFrame, gate_pins: DataFrame) -> DataFrame:
    """Suggested connections whose ends exist and whose target pin belongs to the target's cell.

    suggested(circuit_id, edge_id, from_gate, from_net, to_gate, to_pin, to_po); gate_pins(circuit_id, gate_id, pin).
    """
    g = gates.select(C, "gate_id").distinct()
    src = (suggested.filter("from_gate is not null").join(g.withColumnRenamed("gate_id", "from_gate"), [C, "from_gate"], "left_semi").select(C, "edge_id")
           .union(suggested.filter("from_gate is null and from_net is not null").join(nets.select(C, F.col("net").alias("from_net")), [C, "from_net"], "left_semi").select(C, "edge_id")))
    pin = gate_pins.select(C, F.col("gate_id").alias("to_gate"), F.col("pin").alias("to_pin")).distinct()
    po = ports.filter("port_dir in ('output','inout')").select(C, F.col("net").alias("to_po")).distinct()
    dst = (suggested.filter("to_gate is not null and to_pin is not null").join(pin, [C, "to_gate", "to_pin"], "left_semi").select(C, "edge_id")
           .union(suggested.filter("to_gate is not null and to_pin is null").join(g.withColumnRenamed("gate_id", "to_gate"), [C, "to_gate"], "left_semi").select(C, "edge_id"))
           .union(suggested.filter("to_gate is null and to_po is not null").join(po, [C, "to_po"], "left_semi").select(C, "edge_id")))
    return suggested.join(src, [C, "edge_id"], "left_semi").join(dst, [C, "edge_id"], "left_semi")
