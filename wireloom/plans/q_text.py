"""Registered queries: text claims, netlist text, sessions and routing."""

from pyspark.sql import functions as F

from wireloom.operators import claims as K
from wireloom.operators import insights
from wireloom.operators.scale import materialise
from wireloom.plans import bindings as B
from wireloom.plans.q_graph import LEVEL_SQL, bound_levels
from wireloom.plans.registry import query
from wireloom.sources import datasets as D
from wireloom.sources import netlists as N
from wireloom.streaming import sessions as ST

C = "circuit_id"
KEYS = [C, "gate_id"]
Q = F.lit


G = ("gate_id",)  # stands for the gate id inside a text


def gid():
    return F.col("gate_id").cast("string")


def s(*parts):
    return F.concat(*[gid() if p is G else F.lit(p) if isinstance(p, str) else p for p in parts])


def gate_texts(t, *parts):
    """One text per gate; `text_id` is made of circuit and gate."""
    return t.gates.select((F.col(C) * 1000 + F.col("gate_id")).alias("text_id"), C, "gate_id", s(*parts).alias("text"))


def ref_text():
    return ("[G", G, "] reads [N:n", G, "] of [B:b", (F.col("gate_id") % 25).cast("string"), "]. Ask [F001] or [G", (F.col("gate_id") + 100).cast("string"), "].")
_REFS = {"rtext": """SELECT circuit_id * 1000 + gate_id AS text_id, circuit_id, gate_id, [['G', gate_id::VARCHAR, '0'], ['N', 'n' || gate_id, '0'], ['B', 'b' || (gate_id % 25), '0'],
    ['F', '001', '1'], ['G', (gate_id + 100)::VARCHAR, '1']] AS refs FROM gates""",
         "dim": """SELECT circuit_id, 'G' AS kind, gate_id::VARCHAR AS key FROM gates UNION SELECT circuit_id, 'N', net FROM nets UNION SELECT circuit_id, 'B', bus FROM bus_bits"""}


def ref_dims(t):
    return (t.gates.select(C, Q("G").alias("kind"), gid().alias("key")).union(t.nets.select(C, Q("N"), "net"))
            .union(t.bus_bits.select(C, Q("B"), "bus").distinct()))


@query("extract_refs", """SELECT text_id, circuit_id, 0 AS line_no, r[3]::INT AS sent_no, r[1] AS kind, r[2] AS key FROM (SELECT text_id, circuit_id, unnest(refs) AS r FROM rtext)""", **_REFS)
def _(spark, d):
    t = B.tables(spark, d)
    return K.extract_refs(gate_texts(t, *ref_text()).drop("gate_id")).drop("ref")


_V = lambda i, txt: f"CASE WHEN EXISTS (SELECT 1 FROM dim d WHERE d.circuit_id = t.circuit_id AND d.kind = refs[{i}][1] AND d.key = refs[{i}][2]) THEN {txt} ELSE '[unverified]' END"


@query("validate_refs", f"""SELECT text_id, circuit_id, {_V(1, "'[G' || refs[1][2] || ']'")} || ' reads ' || {_V(2, "'[N:' || refs[2][2] || ']'")} || ' of ' || {_V(3, "'[B:' || refs[3][2] || ']'")}
    || '. Ask [unverified] or ' || {_V(5, "'[G' || refs[5][2] || ']'")} || '.' AS text FROM rtext t""", **_REFS)
def _(spark, d):
    t = B.tables(spark, d)
    return K.validate_refs(gate_texts(t, *ref_text()), ref_dims(t))


@query("normalize_refs", """SELECT circuit_id * 1000 + gate_id AS text_id, circuit_id, '[G' || gate_id || '] uses ' || CASE WHEN gate_id % 25 < 20 AND EXISTS (SELECT 1 FROM dim d
    WHERE d.circuit_id = g.circuit_id AND d.kind = 'B' AND d.key = 'b' || (gate_id % 25)) THEN '[B:' ELSE '[N:' END || 'b' || (gate_id % 25) || '] and [F007] in ' || block AS text FROM gates g""", **_REFS)
def _(spark, d):
    t = B.tables(spark, d)
    txt = t.gates.select((F.col(C) * 1000 + F.col("gate_id")).alias("text_id"), C,
                         s("[Gate #", G, "] uses [N:b", (F.col("gate_id") % 25).cast("string"), "] and [F:7] in [Block:", F.col("block"), "]").alias("text"))
    return K.normalize_refs(txt, ref_dims(t))


_CL = {"ends": "SELECT circuit_id, src AS gate_id, min(dst) AS a, max(dst) AS b FROM edges GROUP BY 1, 2"}


@query("check_claims", """SELECT circuit_id * 1000 + gate_id AS text_id, circuit_id, 'G' || gate_id || ' drives G' || a || '.'
    || CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.circuit_id = x.circuit_id AND e.src = x.a AND e.dst = x.gate_id) THEN ' G' || gate_id || ' is driven by G' || a || '.' ELSE '' END
    || CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.circuit_id = x.circuit_id AND e.src = x.a AND e.dst = x.b) THEN ' G' || gate_id || ' -> G' || a || ' -> G' || b ELSE '' END
    || CASE WHEN EXISTS (SELECT 1 FROM pins p WHERE p.circuit_id = x.circuit_id AND p.gate_id = x.gate_id AND p.net = 'n7' AND direction = 'input')
      OR NOT EXISTS (SELECT 1 FROM pins p WHERE p.circuit_id = x.circuit_id AND p.net = 'n7') THEN chr(10) || 'G' || gate_id || ' reads n7.' ELSE '' END AS text FROM ends x""", **_CL)
def _(spark, d):
    t = B.tables(spark, d)
    e = t.edges.groupBy(C, F.col("src").alias("gate_id")).agg(F.min("dst").cast("string").alias("a"), F.max("dst").cast("string").alias("b"))
    txt = e.select((F.col(C) * 1000 + F.col("gate_id")).alias("text_id"), C,
                   s("G", G, " drives G", F.col("a"), ". G", G, " is driven by G", F.col("a"), ". G", G, " -> G", F.col("a"), " -> G", F.col("b"), "\nG", G, " reads n7.").alias("text"))
    return K.check_claims(materialise(txt, "texts"), t.gates, t.edges, t.pins)


@query("check_prediction_claims", """SELECT circuit_id * 1000 + gate_id AS text_id, circuit_id, concat_ws(' ', CASE WHEN pred_class = 0 THEN 'G' || gate_id || ' is predicted Adder.' END,
    CASE WHEN label = 1 THEN 'G' || gate_id || ' is a Multiplier.' WHEN pred_class = 1 THEN 'G' || gate_id || ' is a Multiplier (GraphSAINT prediction, not a verified fact).' END, 'Done.') AS text
    FROM gates JOIN preds USING (circuit_id, gate_id)""")
def _(spark, d):
    t = B.tables(spark, d)
    txt = gate_texts(t, "G", G, " is predicted Adder. G", G, " is a Multiplier. Done.").drop("gate_id")
    return K.check_predictions(txt, t.gates, t.preds)


@query("check_metric_claims", """SELECT circuit_id AS text_id, circuit_id, concat_ws(' ', CASE WHEN d = 9 THEN 'The longest path has 9 levels.' END, CASE WHEN n = 147 THEN 'The circuit has 147 gates.' END,
    CASE WHEN f IS NULL OR f = 3 THEN 'n50 has a fan-out of 3.' END, 'A buffer could reduce the delay.', CASE WHEN b IS NULL OR b = 30 THEN 'adder_1 has 30 gates.' END) AS text FROM (
      SELECT circuit_id, max(level_in) AS d, count(*) AS n FROM levels GROUP BY 1) LEFT JOIN (SELECT circuit_id, n_readers AS f FROM nets WHERE net = 'n50') USING (circuit_id)
    LEFT JOIN (SELECT circuit_id, count(*) AS b FROM gates WHERE block = 'adder_1' GROUP BY 1) USING (circuit_id)""", **LEVEL_SQL)
def _(spark, d):
    t = B.tables(spark, d)
    lv = materialise(bound_levels(t), "levels")
    depth = lv.groupBy(C).agg(F.max("level_in").alias("max_depth"))
    txt = depth.select(F.col(C).alias("text_id"), C, s(
        "The longest path has 9 levels. The circuit has 147 gates. It reduces power by 30%. Power is 5 mW. n50 has a fan-out of 3. "
        "A buffer will reduce the delay. adder_1 has 30 gates.").alias("text"))
    n = lambda *k: t.gates.groupBy(C, *k).agg(F.count(F.lit(1)).alias("gates"))
    return K.check_metrics(txt, depth, n(), t.nets, insights.gate_fanout(t), n("block"), n("cell").withColumnRenamed("gates", "count"))


_MSG = {"msg": """SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' Is G' || conv_id || ' on the critical path?' WHEN 1 THEN ' What drives it?' WHEN 2 THEN ' Show errors and reduce power.'
    ELSE ' Explain F' || (conv_id % 50) || '.' END AS text FROM conversations"""}


def bound_messages(spark, d):
    m = B.read(spark, d, "conversations")
    k, t = F.col("conv_id"), F.col("turn") % 4
    tail = (F.when(t == 0, s(" Is G", k.cast("string"), " on the critical path?")).when(t == 1, " What drives it?")
            .when(t == 2, " Show errors and reduce power.").otherwise(s(" Explain F", (k % 50).cast("string"), ".")))
    return m.select("conv_id", "turn", F.concat("text", tail).alias("text"))


#: The words of the topics as rows; the oracle splits messages into words and joins them.
_TERMS = ", ".join(f"('{tool}', {k}, '{term.rstrip('*')}', {term.endswith('*')})" for k, (tool, terms) in enumerate(K.TOPICS) for term in terms.split(", "))


def _route_sql(named="[]"):
    return f"""SELECT conv_id, turn, unnest(range(1, len(calls) + 1))::INT AS rank, unnest(calls) AS lookup FROM (SELECT conv_id, turn, (list_concat(
      [x FOR x IN [CASE WHEN turn % 4 = 0 THEN 'get_gate:' || conv_id END, CASE WHEN turn % 4 = 3 THEN 'explain_finding:F' || lpad((conv_id % 50)::VARCHAR, 3, '0') END] IF x IS NOT NULL], {named},
      coalesce(tools, [])))[1:4] AS calls FROM msg LEFT JOIN (SELECT conv_id, turn, list(tool ORDER BY k) AS tools FROM hit GROUP BY 1, 2) USING (conv_id, turn)) WHERE len(calls) > 0"""


_ROUTE = {"term": f"SELECT * FROM (VALUES {_TERMS}) v(tool, k, term, prefix)",
          "word": "SELECT conv_id, turn, string_split(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g')), ' ') AS ws FROM msg",
          "phrase": """SELECT DISTINCT conv_id, turn, array_to_string(ws[i:i + n], ' ') AS p, n FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM word), (SELECT unnest([0, 1, 2]) AS n) WHERE i + n <= len(ws)""",
          "hit": "SELECT DISTINCT conv_id, turn, tool, k FROM phrase JOIN term ON CASE WHEN prefix THEN n = 0 AND starts_with(p, term) ELSE p = term END", **_MSG}


@query("route_messages", _route_sql(), **_ROUTE)
def _(spark, d):
    return K.route_messages(bound_messages(spark, d))


@query("route_named", _route_sql("list_sort([x FOR x IN [CASE WHEN conv_id % 250 IN (SELECT substr(net, 2)::INT FROM nets WHERE net LIKE 'n%') THEN 'get_net:n' || (conv_id % 250) END, CASE WHEN turn % 25 IN (SELECT substr(bus, 2)::INT FROM bus_bits) THEN 'get_bus:b' || (turn % 25) END] IF x IS NOT NULL])"),
       **{**_ROUTE, "msg": f"SELECT conv_id, turn, text || ' Check n' || (conv_id % 250) || ' and b' || (turn % 25) || '.' AS text FROM ({_MSG['msg']})"})
def _(spark, d):
    """Messages that also name a net and a bus; names of no table are not looked up."""
    t = B.tables(spark, d)
    names = t.nets.select(Q("net").alias("kind"), F.col("net").alias("name")).union(t.bus_bits.select(Q("bus"), "bus")).union(t.gates.select(Q("block"), "block")).distinct()
    m = bound_messages(spark, d)
    return K.route_messages(m.withColumn("text", F.concat("text", Q(" Check n"), (F.col("conv_id") % 250).cast("string"), Q(" and b"), (F.col("turn") % 25).cast("string"), Q("."))), materialise(names, "names"))


@query("carry_subject", r"""SELECT conv_id, turn, coalesce(CASE WHEN e IS NULL AND NOT regexp_matches(text, '(?i)\b(this|that|these|those|it|its|they|them|their|same|above|previous|selected)\b') THEN '' ELSE
    last_value(e IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) END, '') AS subject FROM (
    SELECT *, CASE turn % 4 WHEN 0 THEN 'gate:' || conv_id WHEN 3 THEN 'finding:F' || lpad((conv_id % 50)::VARCHAR, 3, '0') END AS e FROM msg)""", **_MSG)
def _(spark, d):
    return K.carry_subject(bound_messages(spark, d)).na.fill("", ["subject"])


@query("validate_suggested_edges", """SELECT p.circuit_id, p.circuit_id * 1000000 + p.gate_id * 1000 + k AS edge_id FROM (SELECT DISTINCT circuit_id, gate_id, pin, CASE pin WHEN 'A' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS k
    FROM (SELECT circuit_id, gate_id, unnest(['A', 'B', 'ZZ']) AS pin FROM gates)) p WHERE EXISTS (SELECT 1 FROM gates g WHERE g.circuit_id = p.circuit_id AND g.gate_id = p.gate_id + 1)
    AND EXISTS (SELECT 1 FROM pins q WHERE q.circuit_id = p.circuit_id AND q.gate_id = p.gate_id AND q.pin = p.pin)""")
def _(spark, d):
    """Suggested: the next gate feeds pins A, B and the unknown ZZ of every gate."""
    t = B.tables(spark, d)
    e = t.gates.select(C, F.posexplode(F.array(*[Q(x) for x in ("A", "B", "ZZ")])).alias("k", "to_pin"), F.col("gate_id").alias("to_gate"))
    e = e.select(C, (F.col(C) * 1000000 + F.col("to_gate") * 1000 + F.col("k") + 1).alias("edge_id"), (F.col("to_gate") + 1).alias("from_gate"),
                 Q(None).cast("string").alias("from_net"), "to_gate", "to_pin", Q(None).cast("string").alias("to_po"))
    return K.validate_edges(e, t.gates, t.nets, t.ports, t.pins).select(C, "edge_id")


# ------------------------------------------------------------------ netlist text
def rendered_lines(spark, d):
    """The bound circuits as netlist text, one row per line: declarations, then one line per pin of each gate.

    Nothing is gathered: line order is computed from the keys.
    """
    t = B.tables(spark, d)
    g = t.gates.select(C, "gate_id", "inst", "cell")
    bus = t.bus_bits.groupBy(C, "bus", "kind").agg(F.max("significance").alias("hi"))
    no = F.substring("bus", 2, 9).cast("long")
    decl = bus.select(C, (no * 2).alias("ord"), s(F.col("kind"), " [", F.col("hi").cast("string"), ":0] ", F.col("bus"), "; // declared ; here").alias("text"))
    decl = decl.union(bus.select(C, (no * 2 + 1).alias("ord"), s("/* bus ; ", F.col("bus"), " */").alias("text")))
    base = F.lit(1000) + F.col("gate_id").cast("long") * 1000
    pin = t.pins.join(g, KEYS).select(C, (base + 1 + F.pmod(F.xxhash64("pin", "net"), F.lit(900))).alias("ord"), s("  .", F.col("pin"), "(", F.col("net"), "),").alias("text"))
    head = g.select(C, base.alias("ord"), s(F.col("cell"), " ", F.col("inst"), " (").alias("text"))
    tail = g.select(C, (base + 999).alias("ord"), s("  .NC( ) );").alias("text"))
    # a comment over two lines inside every instance
    note = g.select(C, (base + 997).alias("ord"), Q("/* note ; with").alias("text")).union(g.select(C, (base + 998).alias("ord"), Q("two ( lines ; */").alias("text")))
    pin = pin.union(note)
    return decl.union(head).union(pin).union(tail).withColumn("slice", F.floor(F.col("ord") / N.SLICE))


@query("netlist_gates", "SELECT circuit_id, (row_number() OVER (PARTITION BY circuit_id ORDER BY gate_id) - 1)::INT AS gate_id, inst, cell, hier_prefix, block FROM gates")
def _(spark, d):
    g = N.extract_gates(N.statements(rendered_lines(spark, d)))
    return g.select(C, "gate_id", "inst", "cell", "hier_prefix", "block")


@query("netlist_pins", """SELECT circuit_id, inst, p.pin, count(*) AS n FROM (SELECT DISTINCT circuit_id, gate_id, pin FROM pins) p JOIN gates USING (circuit_id, gate_id) GROUP BY 1, 2, 3""")
def _(spark, d):
    g = materialise(N.extract_gates(N.statements(rendered_lines(spark, d))), "gates")
    p = N.extract_pins(g)
    return p.join(g.select(*KEYS, "inst"), KEYS).groupBy(C, "inst", "pin").agg(F.count(F.lit(1)).alias("n"))


@query("netlist_empty_pins", "SELECT circuit_id, inst, 'NC' AS pin FROM gates")
def _(spark, d):
    g = materialise(N.extract_gates(N.statements(rendered_lines(spark, d))), "gates")
    return N.extract_empty_pins(g).join(g.select(*KEYS, "inst"), KEYS).select(C, "inst", "pin")


@query("netlist_bus_bits", """SELECT circuit_id, bus, kind, hi AS msb, 0 AS lsb, s AS significance, bus || '[' || s || ']' AS net FROM (SELECT circuit_id, bus, kind, hi, unnest(range(0, hi + 1))::INT AS s FROM (
    SELECT circuit_id, bus, kind, max(significance)::INT AS hi FROM bus_bits GROUP BY 1, 2, 3))""")
def _(spark, d):
    return N.extract_bus_bits(N.extract_declarations(N.statements(rendered_lines(spark, d))))


@query("netlist_ports", """SELECT circuit_id, bus || '[' || unnest(range(0, hi + 1)) || ']' AS net, kind AS port_dir FROM (
    SELECT circuit_id, bus, kind, max(significance)::INT AS hi FROM bus_bits WHERE kind <> 'wire' GROUP BY 1, 2, 3)""")
def _(spark, d):
    return N.extract_ports(N.extract_declarations(N.statements(rendered_lines(spark, d))))


@query("netlist_assigns", """SELECT circuit_id, net AS lhs, CASE significance % 3 WHEN 0 THEN '1''b0' WHEN 1 THEN bus || '[0]' ELSE bus || '[0] & x' END AS rhs,
    CASE significance % 3 WHEN 0 THEN 'const' WHEN 1 THEN 'alias' ELSE 'expression' END AS kind, CASE significance % 3 WHEN 2 THEN bus || '[0],x' ELSE '' END AS operands FROM bus_bits""")
def _(spark, d):
    t = B.tables(spark, d)
    k = F.col("significance") % 3
    rhs = F.when(k == 0, "1'b0").when(k == 1, s(F.col("bus"), "[0]")).otherwise(s(F.col("bus"), " [0] & x"))
    lines = t.bus_bits.select(C, F.substring("net", 2, 9).cast("long").alias("ord"), s("assign ", F.col("net"), " = ", rhs, ";").alias("text"))
    a = N.extract_assigns(N.statements(lines.withColumn("slice", F.floor(F.col("ord") / N.SLICE))))
    return a.select(C, "lhs", F.regexp_replace("rhs", r"\s+\[", "[").alias("rhs"), "kind", F.coalesce(F.array_join("operands", ","), F.lit("")).alias("operands"))


@query("corpus_names", """SELECT DISTINCT circuit_id, split, width FROM (SELECT CASE split WHEN 'te' THEN 'Test' WHEN 'va' THEN 'Validate' ELSE 'Train' END || '_add_' || circuit_id || '_' || width || '_bit_Syn' AS circuit_id, split, width FROM splits)""")
def _(spark, d):
    g = B.bound_splits(B.bound_gates(spark, d))
    word = F.when(F.col("split") == "te", "Test").when(F.col("split") == "va", "Validate").otherwise("Train")
    n = g.select(s(word, "_add_", F.col(C).cast("string"), "_", F.col("width").cast("string"), "_bit_Syn").alias(C)).distinct()
    return N.with_name_facts(n).select(C, "split", "width")


_LOG = {"log": """SELECT c_nationkey AS log_id, c_custkey::INT AS epoch, (c_custkey % 97)::DOUBLE / 10 AS train_loss, (c_custkey % 89)::DOUBLE / 10 AS val_loss, (c_custkey % 83)::DOUBLE / 100 AS val_mic FROM customer"""}


def bound_logs(spark, d):
    """One log per customer: its record is spread over several lines."""
    c, k = B.read(spark, d, "customer"), F.col("c_custkey")
    n = lambda m, q, p: F.format_number((k % m) / Q(q), p)
    txt = s("TRAIN (Ep avg): loss = ", n(97, 10, 1), "\tmic = 0.5\n VALIDATION:     loss = ", n(89, 10, 1), "\tmic = ", n(83, 100, 2), "\n    Epoch ", k.cast("string"), " done")
    return c.select(F.col("c_nationkey").alias("log_id"), txt.alias("text"))


@query("training_log", "SELECT log_id, epoch, train_loss, val_loss, val_mic FROM log", **_LOG)
def _(spark, d):
    return D.parse_training_log(bound_logs(spark, d))


@query("best_epochs", "SELECT log_id, min(epoch) AS best_epoch, val_mic AS best_val_mic FROM log JOIN (SELECT log_id, max(val_mic) AS m FROM log GROUP BY 1) USING (log_id) WHERE val_mic = m GROUP BY 1, 3", **_LOG)
def _(spark, d):
    return D.best_epoch(D.parse_training_log(bound_logs(spark, d)))


@query("bom_csv", "SELECT circuit_id, cell, family, count(*) AS count FROM gates GROUP BY 1, 2, 3")
def _(spark, d):
    """Writes the bill of materials as CSV and reads it back."""
    import uuid
    from wireloom.operators.scale import shared_dir
    t = B.tables(spark, d)
    path = f"{shared_dir(spark)}/wireloom/bom-{uuid.uuid4().hex[:12]}"
    b = insights.bom(t.gates, t.cell_pins)
    D.write_bom_csv(b.repartition(C), path)
    r = spark.read.csv(path, header=True)
    return r.select(F.col(C).cast("long").alias(C), "cell", "family", F.col("count").cast("long").alias("count"))


# ------------------------------------------------------------------ sessions
_SES = {"ses": """SELECT user_id AS session_id, max(started) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS started, ts, event_id FROM (
    SELECT *, CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 3600000000 THEN ts END AS started FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))"""}


def stamp(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(col)


def bound_turns(spark, d):
    e = B.read(spark, d, "events")
    return e.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("turn_id"))


@query("sessions", "SELECT session_id, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used, count(*) AS turns, least(count(*), 20) AS kept_turns FROM ses GROUP BY session_id, ses.started", **_SES)
def _(spark, d):
    r = ST.sessions(bound_turns(spark, d))
    return r.select("session_id", stamp("started"), stamp("last_used"), "turns", "kept_turns")


@query("last_turns", "SELECT user_id AS session_id, event_id AS turn_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 20")
def _(spark, d):
    return ST.last_turns(bound_turns(spark, d)).select("session_id", "turn_id", "age")


@query("streamed_sessions", "SELECT session_id, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used, count(*) AS turns FROM ses GROUP BY session_id, ses.started HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000", **_SES)
def _(spark, d):
    """The events as a stream: sessions closed by the watermark when all input is read."""
    import uuid
    from wireloom.operators.scale import shared_dir
    src = spark.read.parquet(f"{d}/events.parquet")
    base = f"{shared_dir(spark)}/wireloom/sessions-{uuid.uuid4().hex[:12]}"
    stream = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    stream = stream.select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("turn_id"))
    q = (ST.stream_sessions(stream).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    r = spark.read.parquet(f"{base}/out")
    return r.select("session_id", stamp("started"), stamp("last_used"), "turns")


@query("streamed_last_turns", """SELECT session_id, turn_id, turns, age FROM (SELECT session_id, event_id AS turn_id, count(*) OVER w AS turns, max(epoch_us(ts)) OVER w AS last,
    (row_number() OVER (PARTITION BY session_id, ses.started ORDER BY ts DESC, event_id DESC))::INT AS age FROM ses WINDOW w AS (PARTITION BY session_id, ses.started))
    WHERE age <= 20 AND last + 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""", **_SES)
def _(spark, d):
    """The events as a stream in several batches: the kept turns of every session that the watermark has closed."""
    import uuid
    from wireloom.operators.scale import shared_dir
    base = f"{shared_dir(spark)}/wireloom/turns-{uuid.uuid4().hex[:12]}"
    bound_turns(spark, d).repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(bound_turns(spark, d).schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    q = (ST.stream_last_turns(stream).writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("session_id", "turn_id", "turns", "age")


#: An uploaded text has one net for each pin, the first in order.
_INTAKE = {"pin1": "SELECT circuit_id, gate_id, pin, direction, min(net) AS net FROM pins SEMI JOIN gates USING (circuit_id, gate_id) GROUP BY 1, 2, 3, 4",
           "floating": """SELECT circuit_id, 'floating_net' AS "check", net AS subject, count(*) AS members FROM pin1 WHERE net <> '1''b0' GROUP BY 1, 3 HAVING count(*) FILTER (direction = 'output') = 0""",
           "multi": """SELECT circuit_id, 'multi_driver' AS "check", net AS subject, count(*) FILTER (direction = 'output') AS members FROM pin1 GROUP BY 1, 3
               HAVING count(*) FILTER (direction = 'output') + (net = '1''b0')::INT > 1 AND count(*) FILTER (direction = 'output') > 0"""}


@query("intake_findings", """SELECT 'c' || circuit_id AS circuit_id, "check", subject, members, CASE WHEN circuit_id % 7 = 0 THEN 'known_' || circuit_id ELSE '' END AS known_as FROM (SELECT * FROM floating UNION ALL SELECT * FROM multi)""", **_INTAKE)
def _(spark, d):
    """Every circuit as an uploaded text, then all of them again with other line ends, in a stream of several batches that
    are each handled twice: the findings are those of every text once."""
    import uuid
    from wireloom.operators import checks
    from wireloom.operators.scale import shared_dir
    from wireloom.streaming import intake
    base = f"{shared_dir(spark)}/wireloom/intake-{uuid.uuid4().hex[:12]}"
    t = B.tables(spark, d)
    pin = t.pins.groupBy(*KEYS, "pin").agg(F.min("net").alias("net")).select(*KEYS, s(".", F.col("pin"), "(", F.col("net"), ")").alias("port"))
    gate = pin.join(t.gates.select(*KEYS, "cell", "inst"), KEYS).groupBy(*KEYS, "cell", "inst").agg(F.array_join(F.sort_array(F.collect_list("port")), ",\n  ").alias("ports"))
    text = s(F.col("cell"), " ", F.col("inst"), " (", F.col("ports"), ");")
    lines = gate.select(C, "gate_id", text.alias("text")).groupBy(C).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gate_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    first = materialise(lines.select(s("c", F.col(C).cast("string")).alias("name"), "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("arrived"), (F.col(C) % 7 == 0).alias("known")), "uploads")
    again = first.select(s("again_", F.col("name")).alias("name"), s(F.regexp_replace("text", "\n", " \r\n"), "\n").alias("text"), (F.col("arrived") + F.expr("interval 1 hour")).alias("arrived"))
    upload = lambda df: df.withColumnRenamed("name", C).coalesce(1).write.mode("append").parquet(f"{base}/in")
    upload(first.drop("known"))
    upload(again)
    known = D.fingerprint(first.filter("known")).select("fingerprint", s("known_", F.substring("name", 2, 20)).alias("name"))
    sink = intake.checking_sink(f"{base}/out", run=(checks.check_floating_net, checks.check_multi_driver))

    def twice(df, batch_id):
        for _ in range(2):
            sink(df, batch_id)

    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    intake.run_intake(stream, known, twice, f"{base}/state").awaitTermination()
    r = spark.read.parquet(f"{base}/out")
    return r.groupBy(C, "check", "subject", F.coalesce("known_as", F.lit("")).alias("known_as")).agg(F.count(F.lit(1)).alias("members"))


# ------------------------------------------------------------------ functions in plain SQL
@query("sql_cell_functions", "SELECT circuit_id, gate_id, family, drive, hier_prefix, block, family = 'DFFQ' AS sequential FROM gates")
def _(spark, d):
    """Names taken apart by the functions that `register_operators` adds to the session."""
    from wireloom.functions.register import register_operators
    register_operators(spark)
    return spark.sql("""SELECT circuit_id, gate_id, cell_base(cell) AS family, drive_strength(cell) AS drive, hier_prefix(inst) AS hier_prefix, block_of(hier_prefix(inst)) AS block,
                        is_sequential(cell) AS sequential FROM {gates}""", gates=B.bound_gates(spark, d))


@query("sql_references", "SELECT text_id, r[1] AS kind, r[2] AS key FROM (SELECT text_id, unnest(refs) AS r FROM rtext)", **_REFS)
def _(spark, d):
    from wireloom.functions.register import register_operators
    register_operators(spark)
    return spark.sql("SELECT text_id, kind, key FROM {texts}, LATERAL extract_references(text)", texts=gate_texts(B.tables(spark, d), *ref_text()))
