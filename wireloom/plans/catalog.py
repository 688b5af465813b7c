"""Loads every module that registers queries."""

from wireloom.plans import q_arith, q_checks, q_faults, q_features, q_graph, q_insights, q_model, q_repair, q_text  # noqa: F401
from wireloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
