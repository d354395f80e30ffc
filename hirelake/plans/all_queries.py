"""Importing this module registers every query of the library."""

from . import q_extract, q_fit, q_metrics, q_more, q_rules, q_search, q_text

FLAGSHIP = q_metrics.macro_micro
