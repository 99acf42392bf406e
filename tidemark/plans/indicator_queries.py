"""Queries on the indicator library: the last bar of each ticker."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rows
from ..operators import indicators
from ..operators.screens import Screen, screened, side_by_side
from ..sources import bars as source
from .common import Queries, shown
from .screen_queries import screen_sql
from .sql import on_bars

Q = Queries()
COLUMNS = {
    "rsi": (indicators.rsi_layers(), ("rsi", "rsi_signal")),
    "macd": (indicators.macd_layers(), ("macd", "macd_signal", "macd_histogram")),
    "ppo": (indicators.ppo_layers(), ("ppo", "ppo_signal", "ppo_histogram")),
    "tsi": (indicators.tsi_layers(), ("tsi", "tsi_signal")),
    "ema": (indicators.ema_layers(21), ("ema_21",)),
    "sma": (indicators.sma_layers(21), ("sma_21",)),
    "kurutoga": (indicators.kurutoga_layers(), ("kurutoga_14", "kurutoga_28", "kurutoga_56")),
    "mfi": (indicators.mfi_layers(), ("mfi", "mfi_signal")),
    "momentum": (indicators.momentum_layers(), ("momentum", "momentum_place")),
    "gravity": (indicators.gravity_layers(), ("cog", "cog_mean")),
    "crosses": (indicators.crosses_layers(), ("cross_fast", "cross_slow", "golden_cross", "death_cross")),
    "easy_trade": (indicators.easy_trade_layers(), ("macd", "band_upper", "band_lower", "easy_up", "easy_down")),
    "ribbon": (indicators.ribbon_layers(), ("ribbon_10", "ribbon_20", "ribbon_50", "ribbon")),
    "envelope": (indicators.envelope_layers(), ("envelope_upper", "envelope_lower", "envelope")),
    "adline": (indicators.adline_layers(), ("adl", "adl_trend")),
}
SCREENS = {k: Screen(f"i_{k}", layers, "true", columns) for k, (layers, columns) in COLUMNS.items()}


def _add(name: str, screen: Screen) -> None:
    def query(spark, sf_dir):
        rows_ = screened(source.daily(spark, sf_dir), screen)
        return shown(rows_.select("ticker", "date", *(F.col(c).cast("double").alias(c) for c in screen.columns)), digits=3)

    Q.add(f"indicator_{name}", screen_sql(screen))(query)


for _name, _screen in SCREENS.items():
    _add(_name, _screen)

DIVERGENCE = Screen("i_divergence", (*indicators.rsi_layers(), *indicators.divergence_layers("rsi")), "divergence <> 0", ("close", "rsi", "divergence"), last_only=False)


@Q.add("indicator_rsi_divergence", screen_sql(DIVERGENCE))
def rsi_divergence(spark, sf_dir):
    return shown(screened(source.daily(spark, sf_dir), DIVERGENCE).select("ticker", "date", *(F.col(c).cast("double").alias(c) for c in DIVERGENCE.columns)), digits=3)


@Q.add("indicator_price_statistics", on_bars(
    f"k as (select *, max(close) over {rows(None)} as peak from bars)",
    select="select ticker, count(close) as n, round(avg(close), 3) as mean, round(quantile_cont(close, 0.5), 3) as median, round(quantile_cont(close, 0.25), 3) as q25, round(quantile_cont(close, 0.75), 3) as q75, round(stddev_samp(close), 3) as sd, round(min(close), 3) as least, round(max(close), 3) as most, round((max_by(close, date) / nullif(min_by(close, date), 0) - 1) * 100, 3) as return_pct, round(min(close / nullif(peak, 0) - 1) * 100, 3) as drawdown_pct from k group by ticker",
))
def price_statistics(spark, sf_dir):
    return shown(indicators.price_statistics(source.daily(spark, sf_dir)), digits=3)


ANCHORS = ("1996-01-01", "1998-07-01")


@Q.add("indicator_anchored_vwap", on_bars(
    "a as (select *, unnest([date '1996-01-01', date '1998-07-01']) as anchor from bars)", "f as (select * from a where date >= anchor)",
    "v as (select ticker, anchor, min(date) as start, max(date) as date, max_by(close, date) as close, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) as vwap from f group by ticker, anchor)",
    select="select ticker, anchor, start, cast(date - start as int) as days, round(vwap, 3) as vwap, round((close / nullif(vwap, 0) - 1) * 100, 3) as distance_pct, cast(close > vwap as int) as above from v",
))
def anchored_vwap(spark, sf_dir):
    return shown(indicators.vwap_statistics(indicators.anchored_vwap(source.daily(spark, sf_dir), ANCHORS)), digits=3)


@Q.add("indicator_correlation", on_bars(
    "j as (select a.date, a.close as x, b.close as y from bars a join bars b using (date) where a.ticker = 'S1' and b.ticker = 'S2')",
    "m as (select *, x / nullif(lag(x) over (order by date), 0) - 1 as rx, y / nullif(lag(y) over (order by date), 0) - 1 as ry from j)",
    "c as (select date, case when count(rx) over w >= 20 then corr(rx, ry) over w end as correlation from m window w as (order by date rows between 19 preceding and current row))",
    select="select date, round(correlation, 3) as correlation, case when correlation >= 0.7 then 'strong positive' when correlation >= 0.3 then 'moderate positive' when correlation > -0.3 then 'weak' when correlation > -0.7 then 'moderate negative' when correlation is not null then 'strong negative' end as strength from c",
))
def correlation(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    return shown(indicators.rolling_correlation(bars.where("ticker = 'S1'"), bars.where("ticker = 'S2'")), digits=3)


@Q.add("indicator_combined")
def combined(spark, sf_dir):
    return shown(source.latest(indicators.combined(source.daily(spark, sf_dir))), "ticker", "date", "momentum", "mfi", "rsi", "agree", digits=3)


@Q.add("indicator_all")
def all_indicators(spark, sf_dir):
    """Every indicator on the last bar, all made on the same bars one after another."""
    out = side_by_side(source.daily(spark, sf_dir), list(COLUMNS.values()))
    return shown(out, digits=3)
