"""Registered queries and their SQL counterparts."""

from catalog.base import ORACLE, QUERIES
from catalog import a_sources, b_quality, c_predicates, d_alignment, e_windows, f_signals, g_returns, h_metrics, k_validation, l_ticks, m_screens  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
