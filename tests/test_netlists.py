"""Netlist text to tables on a small hand-written design."""

import pytest

from wireloom.operators import checks, model
from wireloom.sources import netlists as N
from wireloom.sources.datasets import best_epoch, fingerprint, match_known, parse_training_log

TEXT = r"""
// a small design ; with a comment
module top (a, b, sel, y, z);
  input [3:0] a; /* bus ;
  over two lines */ input [0:1] b;
  input sel;
  output [1:0] y;
  output z;
  wire n1, n2;
  NAND2_X1M \add_1/u1  ( .A(a[0]), .B(b [1]), .Y(n1) );
  NAND2_X1M \add_1/u2  ( .A(a[1]),
                         .B(), .Y(n2) );
  INV_X0P5M inv1 (.A(n1), .Y(y[0]));
  MYSTERY u9 (.P(n2), .Q(n9));
  BUF_X2M (n8, sel);
  assign z = n2;
  assign y[1] = 1'b0;
  assign n7 = a[2] & n1;
endmodule
"""
LIB = [("NAND2_X1M", "A", "input"), ("NAND2_X1M", "B", "input"), ("NAND2_X1M", "Y", "output"), ("INV_X0P5M", "A", "input"), ("INV_X0P5M", "Y", "output"),
       ("BUF_X2M", "A", "input"), ("BUF_X2M", "Y", "output")]


@pytest.fixture(scope="module")
def t(spark):
    lib = spark.createDataFrame(LIB, "cell string, pin string, direction string")
    return N.load_tables(N.lines_of(spark.createDataFrame([("c", TEXT)], "circuit_id string, text string")), lib)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_gates_in_file_order(t):
    assert rows(t.gates, "gate_id", "inst", "cell", "block", "label") == [
        (0, "add_1/u1", "NAND2_X1M", "add_1", 0), (1, "add_1/u2", "NAND2_X1M", "add_1", 0), (2, "inv1", "INV_X0P5M", "top", 2),
        (3, "u9", "MYSTERY", "top", 2), (4, "g_BUF_X2M_1", "BUF_X2M", "top", 2)]


def test_pins_and_directions(t):
    assert rows(t.pins.filter("gate_id in (0, 3, 4)"), "gate_id", "pin", "net", "direction") == [
        (0, "A", "a[0]", "input"), (0, "B", "b[1]", "input"), (0, "Y", "n1", "output"), (3, "P", "n2", "input"), (3, "Q", "n9", "output"),
        (4, "A", "sel", "input"), (4, "Y", "n8", "output")]


def test_bus_bits_start_at_the_least_significant(t):
    assert rows(t.bus_bits.filter("significance = 0"), "bus", "net_raw") == [("a", "a[0]"), ("b", "b[1]"), ("y", "y[0]")]


def test_aliases_constants_and_expressions(t):
    ends = {(r.net, r.side, r.kind, r.name) for r in t.net_ends.filter("kind <> 'gate'").collect()}
    assert ("n2", "reader", "po", "z") in ends
    assert ("1'b0", "driver", "const", "1'b0") in ends and ("1'b0", "reader", "po", "y[1]") in ends
    assert ("n7", "driver", "assign", "a[2] & n1") in ends and ("a[2]", "reader", "assign", "n7") in ends


def test_missing_pin_and_unknown_cell(t):
    m = model.missing_pins(t.gates, t.pins, t.cell_pins, t.empty_pins)
    assert rows(m, "gate_id", "pin", "direction", "explicit_empty") == [(1, "B", "input", True)]
    assert rows(model.unknown_cells(t.gates, t.cell_pins), "cell", "instances") == [("MYSTERY", 1)]


def test_checks_of_the_design(t):
    got = {(r.check, r.subject) for r in checks.run_checks(t, checks.ELECTRICAL).collect()}
    assert ("missing_pin", "G1.B") in got and ("unused_pi", "a[3]") in got and ("unknown_cell", "MYSTERY") in got
    assert ("dangling_output", "G4.Y=n8") in got and ("dangling_output", "G3.Q=n9") in got
    assert not any(c in ("floating_net", "multi_driver", "undriven_po") for c, _ in got)


def test_behavioural_text_has_no_gates(spark):
    text = "module m(a, y); input a; output y; always @(posedge a) begin y <= a; end endmodule"
    s = N.statements(N.lines_of(spark.createDataFrame([("x", text)], "circuit_id string, text string")))
    assert N.extract_gates(s).count() == 0


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "Train_add_8_bit_Syn.v").write_text(TEXT)
    (tmp_path / "Test_add_16_bit_Syn.v").write_text(TEXT)
    lines = N.read_corpus(spark, str(tmp_path))
    assert rows(lines.distinct(), "circuit_id", "split", "width")[0][1:] == ("te", 16)
    g = N.extract_gates(N.statements(lines))
    assert rows(g.groupBy("circuit_id").count(), "circuit_id", "count") == [("Test_add_16_bit_Syn", 5), ("Train_add_8_bit_Syn", 5)]


def test_alias_chain_takes_the_last_right_side(spark):
    a = spark.createDataFrame([("c", 1, "a", "b", "alias"), ("c", 2, "b", "d", "alias"), ("c", 3, "x", "1'b1", "const"), ("c", 4, "p", "q", "alias"), ("c", 5, "p", "r", "alias")],
                              "circuit_id string, ord long, lhs string, rhs string, kind string")
    got = {(r.net, r.canonical) for r in model.alias_map(a).collect()}
    assert {("a", "d"), ("b", "d"), ("x", "1'b1"), ("p", "r"), ("q", "r")} <= got


def test_fingerprint_ignores_line_ends(spark):
    df = fingerprint(spark.createDataFrame([("a", "x  \r\ny\n\n"), ("b", "x\ny"), ("c", "x\n y")], "name string, text string"))
    f = {r.name: r.fingerprint for r in df.collect()}
    assert f["a"] == f["b"] != f["c"]
    known = df.filter("name <> 'c'").select("fingerprint", "name")
    assert {r.name: r.known_as for r in match_known(df, known).collect()} == {"a": "a", "b": "a", "c": None}


def test_training_log(spark):
    rec = "TRAIN (Ep avg): loss = {0}\tmic = 0.1\n VALIDATION: loss = 0.5\tmic = {1}\n Epoch {2}\n"
    text = rec.format("1.5", "0.80", 1) + rec.format("1.2", "0.90", 2) + rec.format("1.1", "0.90", 3)
    log = parse_training_log(spark.createDataFrame([("l", text)], "log_id string, text string"))
    assert rows(log, "epoch", "train_loss", "val_mic") == [(1, 1.5, 0.8), (2, 1.2, 0.9), (3, 1.1, 0.9)]
    assert rows(best_epoch(log), "best_epoch") == [(2,)]
