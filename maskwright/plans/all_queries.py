"""Importing this module registers every query."""

from maskwright.plans import (  # noqa: F401
    box_queries,
    large_path_queries,
    outcome_queries,
    report_queries,
    state_queries,
    text_queries,
    vector_queries,
)
from maskwright.plans.registry import ORACLES, QUERIES  # noqa: F401
