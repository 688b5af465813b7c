"""Second projection of the star-schema tables: circuits with adders, subtractors, selectors and comparators.

A nation is a circuit, an order an arithmetic block and its lines the bit slices, so circuits grow with the tables. The
priority of an order says what it is, part numbers place the faults. The text of every table is SQL that Spark and
DuckDB both run; operators and oracles share the bound tables and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wireloom.operators.scale import materialise
from wireloom.plans import bindings as B
from wireloom.tables import Tables



def _bit(letter: str, shift: int = 0) -> str:
    return f"'{letter}' || o || '[' || (i - {1 - shift}) || ']'"


def _slot(stage: int) -> str:
    return f"CAST(o * 64 + i * 4 + {stage} AS INT)"


#: (rows, stage, pin, direction, net). Faults: cut carry (23), crossed operand bits (29), open pin (31), second driver (37), top bit from elsewhere (41).
_PINS = (
    ("pr <= 4 AND pk % 29 <> 0", 0, "A", "input", _bit("a")),
    ("pr <= 4 AND pk % 29 = 0", 0, "A", "input", "'a' || o || '[' || CASE WHEN i < w THEN i WHEN i > 1 THEN i - 2 ELSE 0 END || ']'"),
    ("pr <= 4 AND NOT inv AND pk % 31 <> 0", 0, "B", "input", _bit("b")),
    ("inv AND pk % 31 <> 0", 0, "B", "input", _bit("nb")),
    ("inv", 2, "A", "input", _bit("b")), ("inv", 2, "Y", "output", _bit("nb")),
    ("pr <= 4 AND i > 1 AND pk % 23 <> 0", 0, "CI", "input", _bit("c", -1)),
    ("pr <= 4 AND i > 1 AND pk % 23 = 0", 0, "CI", "input", "'open' || o || '_' || i"),
    ("pr <= 4 AND (pk % 37 <> 0 OR i = 1)", 0, "S", "output", _bit("s")),
    ("pr <= 4 AND pk % 37 = 0 AND i > 1", 0, "S", "output", "'s' || o || '[0]'"),
    ("pr <= 4", 0, "CO", "output", _bit("c")),
    ("pr <= 2", 1, "A", "input", _bit("s")), ("pr <= 2", 1, "B", "input", _bit("d")), ("pr <= 2 AND i > 1", 1, "CI", "input", _bit("e", -1)),
    ("pr <= 2", 1, "S", "output", _bit("t")), ("pr <= 2", 1, "CO", "output", _bit("e")),
    ("pr = 3", 1, "A", "input", _bit("a")), ("pr = 3", 1, "B", "input", _bit("b")), ("pr = 3", 1, "Y", "output", _bit("x")),
    ("pr = 3", 3, "A", "input", _bit("s")), ("pr = 3", 3, "B", "input", _bit("x")), ("pr = 3", 3, "S0", "input", "'sel' || o"), ("pr = 3", 3, "Y", "output", _bit("m")),
    ("pr = 4 AND i = w AND pk % 41 = 0", 3, "A", "input", "'sel' || o"), ("pr = 4 AND i = w AND pk % 41 = 0", 3, "Y", "output", "'k' || o"),
    ("pr = 5", 0, "A", "input", _bit("a")), ("pr = 5 AND pk % 31 <> 0", 0, "B", "input", _bit("b")), ("pr = 5 AND i > 1", 0, "C", "input", _bit("q", -1)), ("pr = 5", 0, "Y", "output", _bit("q")),
)
_GATES = (("pr <= 4", 0, "CASE WHEN i = 1 THEN 'ADDH_X1M' ELSE 'ADDF_X1M' END"), ("pr <= 2", 1, "CASE WHEN i = 1 THEN 'ADDH_X1M' ELSE 'ADDF_X2M' END"), ("inv", 2, "'INV_X1M'"),
          ("pr = 3", 1, "'XOR2_X1M'"), ("pr = 3", 3, "'MX2_X1M'"), ("pr = 4 AND i = w AND pk % 41 = 0", 3, "'INV_X1M'"), ("pr = 5", 0, "'AOI21_X0P5M'"))
_BITS = (("true", "a", "input"), ("true", "b", "input"), ("pr <= 3", "s", "wire"), ("pr = 4", "s", "output"), ("pr <= 2", "d", "input"), ("pr <= 2", "t", "output"),
         ("pr = 3", "x", "wire"), ("pr = 3", "m", "output"))

TABLES = {
    "slices": """SELECT c_nationkey AS circuit_id, l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS i,
        CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS w, l_partkey AS pk, CAST(substr(o_orderpriority, 1, 1) AS INT) AS pr, o_orderpriority LIKE '4%' AND o_orderstatus = 'F' AS inv,
        lower(c_mktsegment) AS seg FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "pins": " UNION ALL ".join(f"SELECT circuit_id, {_slot(stage)} AS gate_id, '{pin}' AS pin, {net} AS net, '{way}' AS direction FROM slices WHERE {rows}" for rows, stage, pin, way, net in _PINS),
    "gates": " UNION ALL ".join(
        f"""SELECT circuit_id, {_slot(stage)} AS gate_id, {block} || '/u' || {_slot(stage)} AS inst, {cell} AS cell, {block} AS hier_prefix, {block} AS block,
        CASE WHEN pr = 5 THEN 4 WHEN inv THEN 3 WHEN pr = 3 THEN 2 ELSE 0 END AS label FROM slices WHERE {rows}""" for rows, stage, cell in _GATES for block in ("'select_' || seg" if stage == 3 else "seg",)),
    "bus_bits": " UNION ALL ".join(f"SELECT circuit_id, '{bus}' || o AS bus, '{kind}' AS kind, i - 1 AS significance, {_bit(bus)} AS net FROM slices WHERE {rows}" for rows, bus, kind in _BITS)
    + f" UNION ALL SELECT circuit_id, 's' || o, 'output', w, CASE WHEN pk % 41 = 0 THEN 'k' || o ELSE {_bit('c')} END FROM slices WHERE pr = 4 AND i = w UNION ALL SELECT circuit_id, 't' || o, 'output', w, {_bit('e')} FROM slices WHERE pr <= 2 AND i = w"
    + f" UNION ALL SELECT circuit_id, 'q' || o, 'output', 0, {_bit('q')} FROM slices WHERE pr = 5 AND i = w",
    "ports": "SELECT circuit_id, net, kind AS port_dir FROM bus_bits WHERE kind <> 'wire' UNION ALL SELECT DISTINCT circuit_id, 'sel' || o, 'input' FROM slices WHERE pr = 3 OR (pr = 4 AND i = w AND pk % 41 = 0)"
    + f" UNION ALL SELECT circuit_id, {_bit('c')}, 'output' FROM slices WHERE pr <= 3 AND i = w",
}

#: For the oracles: the same names as those of the first projection.
CTES = {**TABLES, "gates": f"SELECT *, regexp_replace(cell, '_X.*', '') AS family FROM ({TABLES['gates']})",
        "cell_pins": "SELECT DISTINCT cell, pin, direction FROM pins JOIN gates USING (circuit_id, gate_id)",
        "dag": "SELECT * FROM edges",
        "net_ends": """SELECT circuit_id, net, CASE direction WHEN 'output' THEN 'driver' ELSE 'reader' END AS side, 'gate' AS kind, gate_id, pin, NULL AS name FROM pins
        UNION ALL SELECT circuit_id, net, CASE port_dir WHEN 'input' THEN 'driver' ELSE 'reader' END, CASE port_dir WHEN 'input' THEN 'pi' ELSE 'po' END, NULL, NULL, net FROM ports"""}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The bound circuits; slices and pins are written once, as everything else is read from them."""
    from wireloom.sources.datasets import derive_cell_library
    source = {name: B.read(spark, sf_dir, name) for name in ("lineitem", "orders", "customer")}

    def table(name: str, **known: DataFrame) -> DataFrame:
        text = TABLES[name]
        for k in (*source, "slices", "bus_bits"):
            text = text.replace(f"FROM {k}", f"FROM {{{k}}}").replace(f"JOIN {k} ", f"JOIN {{{k}}} ")
        used = {k: v for k, v in {**source, **known}.items() if f"{{{k}}}" in text}
        return spark.sql(text, **used)

    slices = materialise(table("slices"), "slices")
    pins, gates = materialise(table("pins", slices=slices), "pins"), materialise(table("gates", slices=slices), "gates")
    bits = materialise(table("bus_bits", slices=slices), "bus-bits")
    return Tables(gates=gates, pins=pins, ports=table("ports", slices=slices, bus_bits=bits), bus_bits=bits,
                  cell_pins=derive_cell_library(pins.join(gates.select("circuit_id", "gate_id", "cell"), ["circuit_id", "gate_id"])).select("cell", "pin", "direction"))
