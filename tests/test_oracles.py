"""Registered queries against their SQL on sf0.001. A sample by default; BARLOOM_ALL=1 runs every one."""

import os

import check
import pytest

import __spark_entry__ as entry

SAMPLE = """b05_nearest_trading_day b06_bar_build b07_resample_within_day b15_curve_overlay f05_rolling_beta f13_six_factor_scores f16_ic_series
f19_quantile_portfolios f23_combine_orthogonal f30_composite_rank f40_factor_decay i04_macd i16_sar i26_period_analysis i32_minute_score p07_deferred_execution p10_panel_backtest
p14_parameter_sweep p15_walk_forward g001_bar_single_trend g022_tas_macd_bc g083_pos_volume_profile g089_sta_autocorr g115_jcc_ta_xing c01_inclusion_merge c09_strokes c17_pivot_zones
c23_area_divergence c26_third_class_points c36_category_fusion g134_cxt_eleven_bi g129_cxt_bi_stop s05_technical_breakthrough s07_limit_up_leaders s11_fund_flow u01_point_in_time u07_health_score
u15_dcf_grid u26_pead u32_chip_distribution d03_implied_vol d16_break_evens d25_linkage_score l02_northbound l09_linkage_aggregate e06_yield_to_maturity e07_six_dimension_score e15_top_lists
t01_lexicon_score t06_sentiment_reversal t11_report_facts c15_segments c27_level_confirmation c37_signal_strategies c38_event_rules""".split()
NAMES = sorted(entry.queries()) if os.environ.get("BARLOOM_ALL") else SAMPLE


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    ok, message, _ = check.compare(spark, duck, name, "/root/testdata/sf0.001")
    assert ok is not False, message


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["date", "ic", "n"]
