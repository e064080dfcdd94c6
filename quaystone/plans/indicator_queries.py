"""Registered queries of the indicators, over the daily panel."""

from __future__ import annotations

from quaystone.functions.recipe import Recipe
from quaystone.operators import indicators as ind
from quaystone.sources.panels import DAILY_SQL, daily

RECIPES: dict[str, Recipe] = {
    "ind_tr": ind.tr(), "ind_atr": Recipe(ind.atr(20), ("atr",)), "ind_cmi": ind.cmi(), "ind_eff_ratio": ind.efficiency(), "ind_price_density": ind.price_density(),
    "ind_momentum": ind.momentum(), "ind_averages": ind.averages(), "ind_bbands": ind.bbands(), "ind_pivots": ind.pivots(), "ind_stochastic": ind.stochastic(),
    "ind_rsi": ind.rsi(), "ind_stoch_rsi": ind.stoch_rsi(), "ind_trix": ind.trix(), "ind_adx": ind.adx(), "ind_macd": ind.macd(), "ind_mass_index": ind.mass_index(),
    "ind_vortex": ind.vortex(), "ind_kst": ind.kst(), "ind_tsi": ind.tsi(), "ind_acc_dist": ind.acc_dist(), "ind_chaikin": ind.chaikin(), "ind_money_flow": ind.money_flow(),
    "ind_on_balance": ind.on_balance(), "ind_force": ind.force(), "ind_ease": ind.ease(), "ind_coppock": ind.coppock(), "ind_keltner": ind.keltner(), "ind_ultimate": ind.ultimate(),
    "ind_donchian": ind.donchian(), "ind_plunger": ind.plunger(), "ind_fisher": ind.fisher(), "ind_pct_channel": ind.pct_channel(), "ind_value_chart": ind.value_chart(),
    "ind_tema": ind.tema(), "ind_slope": ind.slope(), "ind_dvo": ind.dvo(), "ind_dual_thrust": ind.dual_thrust(), "ind_kumo": ind.kumo(), "ind_crosses": ind.crosses(),
    "ind_heiken_ashi": ind.heiken_ashi(), "ind_svapo": ind.svapo(), "ind_tail_mean": ind.tail_mean(), "ind_tail_mean_low": ind.tail_mean(pct=0.3, direction=-1), "ind_ribbon": ind.ribbon(),
    "ind_value_chart_short": ind.value_chart(5), "ind_dvo_weighted": ind.dvo((0.4, 0.3, 0.2, 0.1), (0.5, 0.3, 0.2), 40),
}
QUERIES = {k: (lambda spark, sf_dir, r=r: r.result(daily(spark, sf_dir))) for k, r in RECIPES.items()}
SQL = {k: r.oracle(DAILY_SQL) for k, r in RECIPES.items()}
