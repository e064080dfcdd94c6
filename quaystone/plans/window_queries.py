"""Registered queries of the windows by asset and across assets, over the daily panel."""

from __future__ import annotations

from quaystone.functions.recipe import Recipe
from quaystone.operators import cross_section as xs
from quaystone.operators import timeseries as ts
from quaystone.sources.panels import DAILY_SQL, daily

RECIPES: dict[str, Recipe] = {
    "ts_changes": ts.changes(), "ts_diff_present": ts.diff_of_present(), "ts_rolling": ts.rolling(), "ts_zscores": ts.zscores(), "ts_ewm": ts.ewm_stats(), "ts_robust_vol": ts.robust_vol(), "ts_ewmac": ts.ewmac(), "ts_ewmac_grid": ts.ewmac_grid(),
    "ts_pct_scores": ts.pct_scores(), "ts_past_percentile": ts.past_percentile(), "ts_hl_kdj": ts.hl_kdj(), "ts_scored": ts.scored(), "ts_cumulative": ts.cumulative(), "ts_drawdown": ts.drawdown(), "ts_rolling_fit": ts.rolling_fit(),
    "ts_skew_kurt": ts.skew_kurt(), "ts_range_vols": ts.range_vols(), "ts_asset_vols": ts.asset_vols(), "ts_state_fill": ts.state_fill(), "ts_season_stats": ts.season_stats(), "ts_tilt_timing": ts.tilt_timing(), "ts_fills": ts.fills(),
    "ts_winsorised": ts.winsorised(), "ts_roll_yield": ts.roll_yield(),
    "xs_scores": xs.scores(), "xs_ranks": xs.ranks(), "xs_rank_tails": xs.ranks(0.2), "xs_rank_cut": xs.rank_cut(), "xs_demedian": xs.demedian(), "xs_asset_scaling": xs.asset_scaling(), "xs_directional": xs.directional(), "xs_long_short": xs.long_short(), "xs_top_n": xs.top_n(), "xs_staggered": xs.staggered(),
} | {f"sig_conv_{k}": ts.conv_signal(k, x="close - open" if k in ts.OF_CHANGES else "close") for k in ts.CONV}
QUERIES = {k: (lambda spark, sf_dir, r=r: r.result(daily(spark, sf_dir))) for k, r in RECIPES.items()}
SQL = {k: r.oracle(DAILY_SQL) for k, r in RECIPES.items()}
