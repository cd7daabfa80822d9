"""The library's queries over the driver's tables."""

from . import gold_queries, prospect_queries, report_queries, retrieval_queries, rule_queries, source_queries, stemmed_queries, sweep_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
