"""Registered queries against their SQL on the smallest tables."""

import pytest

from quaystone.plans import registry
from tests.conftest import SF, rows

CHOSEN = [
    "bars_daily", "bars_period", "bars_session", "bars_twap", "clean_sessions", "cal_trading_date", "roll_back_adjust", "join_as_of_limit", "upsert_replace", "upsert_ignore", "agg_brokers",
    "ind_atr", "ind_adx", "ind_svapo", "ind_donchian", "ts_ewm", "ts_robust_vol", "ts_range_vols", "ts_past_percentile", "xs_ranks", "xs_staggered", "sig_conv_kdj", "sig_conv_qtl",
    "sig_hysteresis", "sig_buffer", "pnl_stats_tenor", "grid_backtest", "pnl_lead_lag", "risk_var", "stat_hurst", "stream_minute_bars", "stream_running_means",
]


def test_every_query_is_callable_and_sql_belongs_to_one():
    q, s = registry.queries(), registry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 120 and all(callable(f) for f in q.values())
    assert registry.FLAGSHIP in q


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, name):
    got = rows(registry.queries()[name](spark, SF))
    cursor = duck.execute(registry.oracle_sql()[name])
    want = rows(cursor.fetchall(), [d[0] for d in cursor.description])
    assert got[1] == want[1] and len(got[0]) == len(want[0])
    for a, b in zip(got[0], want[0], strict=True):
        assert len(a) == len(b)
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 2e-6 * max(1, abs(x))), (a, b)
