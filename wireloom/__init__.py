"""Circuit-graph analytics over a corpus of gate-level netlists, as Spark DataFrame jobs."""

from wireloom.tables import Tables

__all__ = ["Tables"]
