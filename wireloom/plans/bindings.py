"""Projects the star-schema tables onto the netlist model.

A supplier is a circuit, an order a gate, a part a net and a line number a pin. The same projection
is written once as DataFrames and once as SQL (`CTES`) for the oracle.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.functions import names
from wireloom.operators.scale import expect_packed_files, materialise
from wireloom.tables import Tables

# ---- fixed values of the projection ----------------------------------------
PINS = {1: "CO", 2: "Y", 3: "CI", 4: "A", 5: "B", 6: "S0", 7: "C"}
FAMILIES = {"ECONOMY": "INV", "SMALL": "NAND2", "STANDARD": "ADDF", "PROMO": "MX2", "MEDIUM": "XOR2",
            "LARGE": "DFFQ"}
BLOCKS = {"AUTOMOBILE": "adder_1", "BUILDING": "multiplier_1", "FURNITURE": "control_1",
          "HOUSEHOLD": "subtractor_1", "MACHINERY": "comparator_1"}
# ----------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(values: dict, col) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[col]


def _net(k):
    return F.when(k == 199, F.lit("1'b0")).otherwise(F.concat(F.lit("n"), k.cast("string")))


def bound_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("circuit_id"), (F.col("l_orderkey") % 150).cast("int").alias("gate_id"),
        _lookup(PINS, F.col("l_linenumber")).alias("pin"), _net(F.col("l_partkey") % 200).alias("net"),
        F.when(F.col("l_linenumber") <= 2, "output").otherwise("input").alias("direction")).distinct()


def bound_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("circuit_id"), (F.col("l_orderkey") % 150).cast("int").alias("gate_id")).agg(
        F.min("l_partkey").alias("p_partkey"), F.min("l_orderkey").alias("o_orderkey"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    drive = F.concat(F.when(F.col("p_size") < 10, "0P").otherwise(""), F.col("p_size").cast("string"))
    g = g.join(part, "p_partkey").join(orders, "o_orderkey").join(cust, "o_custkey")
    block = _lookup(BLOCKS, F.col("c_mktsegment"))
    return g.select(
        "circuit_id", "gate_id", F.concat(block, F.lit("/u"), F.col("gate_id").cast("string")).alias("inst"),
        F.concat(_lookup(FAMILIES, F.col("p_type")), F.lit("_X"), drive, F.lit("M")).alias("cell"),
        block.alias("hier_prefix"), block.alias("block"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label"), "o_orderkey")


def bound_bus_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("l_partkey") % 200).cast("int")
    b = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("circuit_id"), k.alias("k")).distinct()
    bus = F.floor(F.col("k") / 10).cast("int")
    kind = F.when(bus < 4, "input").when(bus >= 17, "output").otherwise("wire")
    return b.filter("k < 199").select("circuit_id", F.concat(F.lit("b"), bus.cast("string")).alias("bus"),
                                      kind.alias("kind"), (F.col("k") % 10).alias("significance"),
                                      _net(F.col("k")).alias("net"))


def bound_ports(bus_bits: DataFrame) -> DataFrame:
    return bus_bits.filter("kind <> 'wire'").select("circuit_id", "net", F.col("kind").alias("port_dir"))


def bound_cell_pins(gates: DataFrame, pins: DataFrame) -> DataFrame:
    """Library of every cell seen, without the register family (those stay unknown cells)."""
    from wireloom.sources.datasets import derive_cell_library
    known = gates.filter(names.cell_base("cell") != "DFFQ").select("circuit_id", "gate_id", "cell")
    return derive_cell_library(pins.join(known, ["circuit_id", "gate_id"])).select("cell", "pin", "direction")


def bound_preds(gates: DataFrame) -> DataFrame:
    pred = F.when(F.col("o_orderkey") % 7 == 0, (F.col("label") + 1) % 5).otherwise(F.col("label"))
    top = (F.lit(5) + F.col("o_orderkey") % 5) / F.lit(10)
    g = gates.select("circuit_id", "gate_id", F.col("label").alias("true_class"), pred.alias("pred_class"),
                     top.alias("_top"))
    probs = [F.when(F.col("pred_class") == c, F.col("_top")).otherwise((1 - F.col("_top")) / 4) for c in range(5)]
    return g.select("circuit_id", "gate_id", "true_class", "pred_class", F.array(*probs).alias("prob"))


def bound_splits(gates: DataFrame) -> DataFrame:
    """Split and width of each circuit, from digits of its id."""
    d = F.col("circuit_id") % 10
    w = F.pow(F.lit(2), 3 + F.col("circuit_id") % 4).cast("int")
    return gates.withColumn("split", F.when(d == 0, "te").when(d == 1, "va").otherwise("tr")).withColumn("width", w)


class BoundTables(Tables):
    """The bound corpus. Nearly every operator reads a table of it more than once, so each is written when first read."""

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> BoundTables:
        t = cls.__new__(cls)
        t._source = spark, sf_dir
        expect_packed_files(spark)
        return t

    @cached_property
    def pins(self) -> DataFrame:
        return materialise(bound_pins(*self._source), "pins")

    @cached_property
    def gates(self) -> DataFrame:
        return materialise(bound_gates(*self._source), "gates")

    @cached_property
    def bus_bits(self) -> DataFrame:
        return materialise(bound_bus_bits(*self._source), "bus-bits")

    @cached_property
    def ports(self) -> DataFrame:
        return bound_ports(self.bus_bits)

    @cached_property
    def cell_pins(self) -> DataFrame:
        return materialise(bound_cell_pins(self.gates, self.pins), "cell-pins")

    @cached_property
    def preds(self) -> DataFrame:
        return bound_preds(self.gates)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The bound corpus. Gates carry `o_orderkey`, the smallest order behind them."""
    return BoundTables.of(spark, sf_dir)


# ------------------------------------------------------------------ the same in SQL
def _case(values: dict, col: str) -> str:
    return "CASE " + col + " ".join(f" WHEN {k!r} THEN '{v}'" for k, v in values.items()) + " END"


_NET = "CASE WHEN l_partkey % 200 = 199 THEN '1''b0' ELSE 'n' || (l_partkey % 200)::VARCHAR END"

CTES = {
    "pins": f"""SELECT DISTINCT l_suppkey AS circuit_id, (l_orderkey % 150)::INT AS gate_id,
        {_case(PINS, 'l_linenumber')} AS pin, {_NET} AS net,
        CASE WHEN l_linenumber <= 2 THEN 'output' ELSE 'input' END AS direction FROM lineitem""",
    "gates": f"""SELECT g.circuit_id, g.gate_id, b.block || '/u' || g.gate_id AS inst,
        {_case(FAMILIES, 'p_type')} || '_X' || CASE WHEN p_size < 10 THEN '0P' ELSE '' END || p_size || 'M' AS cell,
        b.block AS hier_prefix, b.block, substr(o_orderpriority, 1, 1)::INT - 1 AS label, g.o_orderkey,
        {_case(FAMILIES, 'p_type')} AS family,
        CASE WHEN p_size < 10 THEN ('0.' || p_size)::DOUBLE ELSE p_size::DOUBLE END AS drive
        FROM (SELECT l_suppkey AS circuit_id, (l_orderkey % 150)::INT AS gate_id, min(l_partkey) AS p_partkey,
              min(l_orderkey) AS o_orderkey FROM lineitem GROUP BY 1, 2) g
        JOIN part USING (p_partkey) JOIN orders USING (o_orderkey)
        JOIN (SELECT c_custkey, {_case(BLOCKS, 'c_mktsegment')} AS block FROM customer) b ON b.c_custkey = o_custkey""",
    "bus_bits": """SELECT circuit_id, 'b' || (k // 10) AS bus,
        CASE WHEN k // 10 < 4 THEN 'input' WHEN k // 10 >= 17 THEN 'output' ELSE 'wire' END AS kind,
        k % 10 AS significance, 'n' || k AS net
        FROM (SELECT DISTINCT l_suppkey AS circuit_id, (l_partkey % 200)::INT AS k FROM lineitem) WHERE k < 199""",
    "ports": "SELECT circuit_id, net, kind AS port_dir FROM bus_bits WHERE kind <> 'wire'",
    "cell_pins": """SELECT DISTINCT cell, pin, CASE WHEN pin IN ('CO','Y') THEN 'output' ELSE 'input' END AS direction
        FROM pins JOIN gates USING (circuit_id, gate_id) WHERE family <> 'DFFQ'""",
    "preds": """SELECT circuit_id, gate_id, label AS true_class,
        CASE WHEN o_orderkey % 7 = 0 THEN (label + 1) % 5 ELSE label END AS pred_class,
        (5 + o_orderkey % 5) / 10.0::DOUBLE AS top FROM gates""",
    "classes": "SELECT unnest([0, 1, 2, 3, 4]) AS class",
    "probs": """SELECT circuit_id, gate_id, class, CASE WHEN class = pred_class THEN top ELSE (1 - top) / 4 END AS p
        FROM preds, classes""",
    "splits": """SELECT *, CASE circuit_id % 10 WHEN 0 THEN 'te' WHEN 1 THEN 'va' ELSE 'tr' END AS split,
        CASE circuit_id % 4 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 ELSE 64 END AS width FROM gates""",
    "net_ends": """SELECT circuit_id, net, CASE direction WHEN 'output' THEN 'driver' ELSE 'reader' END AS side,
          'gate' AS kind, gate_id, pin, NULL AS name FROM pins
        UNION ALL SELECT circuit_id, net, CASE port_dir WHEN 'input' THEN 'driver' ELSE 'reader' END,
          CASE port_dir WHEN 'input' THEN 'pi' ELSE 'po' END, NULL, NULL, net FROM ports
        UNION ALL SELECT DISTINCT circuit_id, net, 'driver', 'const', NULL::INT, NULL, net FROM pins WHERE net = '1''b0'""",
    "nets": """SELECT circuit_id, net, count(*) FILTER (side = 'driver') AS n_drivers,
        count(*) FILTER (side = 'reader') AS n_readers,
        count(*) FILTER (side = 'driver' AND kind = 'gate') AS gate_drivers,
        count(*) FILTER (side = 'reader' AND kind = 'gate') AS gate_readers,
        count(*) FILTER (kind = 'pi') AS pi_drivers, count(*) FILTER (kind = 'po') AS po_readers,
        count(*) FILTER (kind = 'const') AS const_drivers, count(*) FILTER (kind = 'assign') AS assign_ends
        FROM net_ends GROUP BY 1, 2""",
    "edges": """SELECT DISTINCT d.circuit_id, d.gate_id AS src, r.gate_id AS dst FROM pins d JOIN pins r
        ON d.circuit_id = r.circuit_id AND d.net = r.net WHERE d.direction = 'output' AND r.direction = 'input'
        AND d.gate_id <> r.gate_id""",
    "po_gates": """SELECT DISTINCT circuit_id, gate_id FROM pins JOIN ports USING (circuit_id, net)
        WHERE port_dir = 'output' AND direction = 'output'""",
    "sym": "SELECT circuit_id, src, dst FROM edges UNION SELECT circuit_id, dst, src FROM edges",
    "uedges": "SELECT * FROM sym UNION SELECT circuit_id, gate_id, gate_id FROM po_gates",
    "deg": """SELECT circuit_id, gate_id, (SELECT count(*) FROM edges e WHERE e.circuit_id = g.circuit_id AND e.dst = g.gate_id) AS in_degree,
        (SELECT count(*) FROM edges e WHERE e.circuit_id = g.circuit_id AND e.src = g.gate_id) AS out_degree FROM gates g""",
}


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefix `sql` with the named tables it reads, in dependency order."""
    ctes = {**CTES, **(extra or {})}
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in ctes:
            if name not in seen and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text, re.I):
                seen.add(name)
                visit(ctes[name])
                order.append(name)

    visit(sql)
    body = sql.strip()
    rec = body.upper().startswith("WITH RECURSIVE")
    if not order:
        return body
    head = ", ".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in order)
    if rec:
        return "WITH RECURSIVE " + head + ", " + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH"):
        return "WITH " + head + ", " + body[4:].lstrip()
    return f"WITH {head} {body}"
