"""The tables of a netlist corpus; derived ones are plans built on first use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame


@dataclass
class Tables:
    """Base tables. `pins` is the fact table; every other graph table follows from it.

    gates(circuit_id, gate_id, inst, cell, hier_prefix, block, label)
    pins(circuit_id, gate_id, pin, net, direction)
    ports(circuit_id, net, port_dir)
    bus_bits(circuit_id, bus, kind, significance, net)
    cell_pins(cell, pin, direction)
    preds(circuit_id, gate_id, true_class, pred_class, prob)
    assigns(circuit_id, lhs, rhs, kind), empty_pins(circuit_id, gate_id, pin)
    """

    gates: DataFrame
    pins: DataFrame
    ports: DataFrame
    bus_bits: DataFrame | None = None
    cell_pins: DataFrame | None = None
    preds: DataFrame | None = None
    assigns: DataFrame | None = None
    empty_pins: DataFrame | None = None
    cell_attrs: DataFrame | None = None

    def __post_init__(self) -> None:
        from wireloom.operators.scale import expect_packed_files
        expect_packed_files(self.pins.sparkSession)

    @cached_property
    def net_ends(self) -> DataFrame:
        from wireloom.operators.model import net_ends
        return net_ends(self.pins, self.ports, self.assigns)

    @cached_property
    def nets(self) -> DataFrame:
        from wireloom.operators.model import net_summary
        return net_summary(self.net_ends)

    @cached_property
    def edges(self) -> DataFrame:
        """Gate edges, written once because most operators read them repeatedly."""
        from wireloom.operators.model import gate_edges
        from wireloom.operators.scale import materialise
        return materialise(gate_edges(self.pins), "edges")

    @cached_property
    def bus_runs(self):
        """What the bus checks share, found once for all of them."""
        from wireloom.operators.buses import bus_runs
        return bus_runs(self)
