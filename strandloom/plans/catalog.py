"""Imports every query module so that the registry is full."""

from strandloom.plans import q_calling, q_evidence, q_intervals, q_metrics, q_sequence, q_sources, q_validation  # noqa: F401
from strandloom.plans.registry import ORACLES, QUERIES  # noqa: F401
