"""Registered queries beside their SQL on the smallest tables."""

import os

import pytest

from catalog import ORACLE, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"

# One or two of each family keep this quick; `python -m tests.compare` runs all of them.
PICKED = [
    "op_A5_sort_dedupe", "op_A12_universe_fingerprint", "op_B5_spacing_histogram", "op_C1_validate_weights", "op_D4_align_ffill",
    "op_D6_month_snap", "op_E2_ema", "op_E31_drawdown_episodes", "op_F5_donchian_breakout", "op_F17_orb_breakout", "op_flagship_golden_cross",
    "op_G5_fills_to_trades", "op_G7_bracket_exit", "op_H5_var_cvar", "op_K3_bootstrap_block",
]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, duck(SF), name, SF)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
