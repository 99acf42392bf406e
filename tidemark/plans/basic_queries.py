"""Queries on the basic calculations and stages."""

from __future__ import annotations

from ..functions.windows import TICKER, change, clamp, lag, rows, sma, true_range
from ..operators import basics, stage
from ..sources import bars as source
from .common import Queries, shown
from .sql import ewm, ewm_adjusted, latest, layer, on_bars, wilder

Q = Queries()

STAGE_STEPS = (
    layer("r", "bars", tr=true_range()),
    layer("i", "r", ema10=ewm_adjusted("close", 10), sma20=sma("close", 20), sma50=sma("close", 50), atr=sma("tr", 14)),
    layer("j", "i", atr_ratio="atr / nullif(sma50, 0) * 100"),
    layer("l", "j", back="row_number() over (partition by ticker order by date desc)"),
    "s as (select *, " + stage.stage_code() + " as stage from l where back = 1)",
)


@Q.add("bars", on_bars(select="select ticker, date, round(open, 4) as open, round(high, 4) as high, round(low, 4) as low, round(close, 4) as close, volume from bars"))
def daily_bars(spark, sf_dir):
    return shown(source.daily(spark, sf_dir))


@Q.add("bars_weekly", on_bars(select="select ticker, cast(date_trunc('week', date) as date) as date, round(min_by(open, date), 4) as open, round(max(high), 4) as high, round(min(low), 4) as low, round(max_by(close, date), 4) as close, sum(volume) as volume from bars group by all"))
def weekly_bars(spark, sf_dir):
    return shown(source.rolled_up(source.daily(spark, sf_dir), "weekly"), "ticker", "date", "open", "high", "low", "close", "volume")


@Q.add("bars_monthly", on_bars(select="select ticker, cast(date_trunc('month', date) as date) as date, round(min_by(open, date), 4) as open, round(max(high), 4) as high, round(min(low), 4) as low, round(max_by(close, date), 4) as close, sum(volume) as volume from bars group by all"))
def monthly_bars(spark, sf_dir):
    return shown(source.rolled_up(source.daily(spark, sf_dir), "monthly"), "ticker", "date", "open", "high", "low", "close", "volume")


@Q.add("bars_quality", on_bars(
    layer("m", "bars", moved=f"case when abs(close / nullif({lag('close')}, 0) - 1) > 0.5 then 1 else 0 end"),
    select="select ticker, count(*) as rows, round(avg(case when close is null then 1 else 0 end), 4) as null_share, round(min(close), 4) as least_close, round(avg(moved), 4) as jump_share, case when count(*) >= 252 and avg(case when close is null then 1 else 0 end) <= 0.1 and min(close) > 0 and avg(moved) <= 0.01 then 1 else 0 end as valid from m group by ticker",
))
def bars_quality(spark, sf_dir):
    return shown(source.quality(source.daily(spark, sf_dir)))


@Q.add("bars_latest_dates", on_bars(select="select ticker, max(date) as latest from bars group by ticker"))
def latest_dates(spark, sf_dir):
    return source.latest_dates(source.daily(spark, sf_dir))


@Q.add("bars_capped", on_bars(select="select ticker, count(*) as n, min(date) as first from (select * from bars qualify row_number() over (partition by ticker order by date desc) <= 252) group by ticker"))
def bars_capped(spark, sf_dir):
    from pyspark.sql import functions as F

    return source.capped(source.daily(spark, sf_dir), "daily", 1).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@Q.add("bars_summary", on_bars("p as (select ticker, count(*) as n, min(date) as first, max(date) as last from bars group by ticker)", select="select count(*) as tickers, cast(sum(n) as bigint) as bars, min(first) as first_date, max(last) as last_date, round(avg(n), 4) as bars_per_ticker from p"))
def bars_summary(spark, sf_dir):
    return shown(source.summary(source.daily(spark, sf_dir)))


@Q.add("returns_risk", on_bars(
    layer("d", "bars", ret=change("close"), base=f"first_value(close) over ({TICKER})"),
    layer("g", "d", grown="case when ret is not null then close / nullif(base, 0) end"),
    layer("p", "g", peak=f"max(grown) over {rows(None)}"),
    select="select ticker, count(ret) as days, round(max_by(grown, date) - 1, 4) as total_return, round(stddev_samp(ret) * sqrt(252), 4) as volatility, round((avg(ret) * 252 - 0.02) / nullif(stddev_samp(ret) * sqrt(252), 0), 4) as sharpe, round(min(grown / nullif(peak, 0) - 1), 4) as max_drawdown from p group by ticker",
))
def returns_risk(spark, sf_dir):
    return shown(basics.returns(source.daily(spark, sf_dir)))


@Q.add("candles", on_bars(
    layer("a", "bars", b="abs(close - open) / nullif(high - low, 0)", u="(high - greatest(open, close)) / nullif(high - low, 0)", w="(least(open, close) - low) / nullif(high - low, 0)"),
    layer("c", "a", s="b * (1 - case when close > open then w else u end)"),
    select="select ticker, date, round(coalesce(b, 0), 4) as body_ratio, round(coalesce(u, 0), 4) as upper_wick_ratio, round(coalesce(w, 0), 4) as lower_wick_ratio, round(coalesce(s, 0), 4) as strength, "
    f"round(avg(s) over {rows(4)}, 4) as strength_5, case when b > 0.7 then 'Strong Body' when b > 0.4 then 'Moderate Body' when b > 0.1 then 'Weak Body' else 'Doji' end as candle from c",
))
def candles(spark, sf_dir):
    return shown(basics.candles(source.daily(spark, sf_dir)), "ticker", "date", "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "strength", "strength_5", "candle")


AVERAGES = ("ema_10", "ema_20", "sma_20", "sma_50")


@Q.add("moving_averages", on_bars(
    layer("a", "bars", ema_10=ewm_adjusted("close", 10), ema_20=ewm_adjusted("close", 20), sma_20=sma("close", 20), sma_50=sma("close", 50)),
    layer("b", "a", **{f"{c}_slope": f"({c} - {lag(c, 5)}) / 5.0" for c in AVERAGES}, **{f"price_to_sma_{n}": f"(close / nullif(sma_{n}, 0) - 1) * 100" for n in (20, 50)}),
    select=latest("b", *(f"#{c}" for c in AVERAGES), *(f"#{c}_slope" for c in AVERAGES), "#price_to_sma_20", "#price_to_sma_50"),
))
def moving_averages(spark, sf_dir):
    out = source.latest(basics.averages(source.daily(spark, sf_dir)))
    return shown(out, "ticker", *AVERAGES, *(f"{c}_slope" for c in AVERAGES), "price_to_sma_20", "price_to_sma_50")


HIGH, LOW = f"max(close) over {rows(251)}", f"min(close) over {rows(251)}"


@Q.add("technicals", on_bars(
    layer("a", "bars", diff=f"coalesce(close - {lag('close')}, 0)", bar=f"row_number() over ({TICKER})", fast=ewm_adjusted("close", 12), slow=ewm_adjusted("close", 26)),
    layer("b", "a", line="fast - slow"),
    layer("c", "b", sig=ewm_adjusted("line", 9), rsi_14=basics.rsi_simple(), position_52w=f"case when {HIGH} = {LOW} then 0.5 else (close - {LOW}) / nullif({HIGH} - {LOW}, 0) end"),
    layer("d", "c", macd="case when bar >= 35 then line end", macd_signal="case when bar >= 35 then sig end"),
    layer("e", "d", macd_histogram="macd - macd_signal"),
    select=latest("e", "#rsi_14", "#position_52w", "#macd", "#macd_signal", "#macd_histogram"),
))
def technicals(spark, sf_dir):
    return shown(source.latest(basics.technicals(source.daily(spark, sf_dir))), "ticker", "rsi_14", "position_52w", "macd", "macd_signal", "macd_histogram")


@Q.add("atr", on_bars(
    layer("a", "bars", tr=true_range()),
    layer("b", "a", atr=wilder("tr", 14)),
    layer("c", "b", atr_pct="atr / nullif(close, 0) * 100", atr_ext=f"(close - {sma('close', 50)}) / nullif(atr, 0)", past=f"list(atr) over {rows(99)}", n=f"count(*) over {rows(99)}"),
    layer("d", "c", atr_percentile="case when n >= 100 then len(list_filter(past, lambda x: x < atr)) / 100.0 end"),
    select=latest("d", "#atr", "#atr_pct", "#atr_ext", "#atr_percentile"),
))
def atr(spark, sf_dir):
    return shown(source.latest(basics.atr(source.daily(spark, sf_dir))), "ticker", "atr", "atr_pct", "atr_ext", "atr_percentile")


PERIODS = (5, 10, 22, 66, 132, 252)


@Q.add("percentage_moves", on_bars(
    layer("a", "bars", intraday_pct="(close / nullif(open, 0) - 1) * 100", **{f"pct_{p}": f"{change('close', p - 1)} * 100" for p in PERIODS},
          momentum_20=f"case when count(close) over {rows(19)} >= 20 then (avg(close) over {rows(4)} / nullif(avg(close) over {rows(19, -15)}, 0) - 1) * 100 end"),
    select=latest("a", "#intraday_pct", *(f"#pct_{p}" for p in PERIODS), "#momentum_20"),
))
def percentage_moves(spark, sf_dir):
    return shown(source.latest(basics.moves(source.daily(spark, sf_dir))), "ticker", "intraday_pct", *(f"pct_{p}" for p in PERIODS), "momentum_20")


@Q.add("extremes", on_bars(
    "e as (select ticker, max(close) as ath, min(close) as atl, max_by(close, date) as c from bars group by ticker)",
    select="select ticker, round(c, 4) as close, round(ath, 4) as ath, round(atl, 4) as atl, cast(c >= ath as int) as new_ath, cast(c <= atl as int) as new_atl, round(c / nullif(ath, 0) * 100 - 100, 4) as from_ath_pct, round(c / nullif(atl, 0) * 100 - 100, 4) as from_atl_pct, round(coalesce((c - atl) / nullif(ath - atl, 0) * 100, 50.0), 4) as position_pct from e",
))
def extremes(spark, sf_dir):
    return shown(basics.extremes(source.daily(spark, sf_dir)), "ticker", "close", "ath", "atl", "new_ath", "new_atl", "from_ath_pct", "from_atl_pct", "position_pct")


@Q.add("volume_metrics", on_bars(
    layer("a", "bars", signed=f"coalesce(sign(close - {lag('close')}) * volume, 0)"),
    layer("b", "a", avg_volume_20=f"avg(volume) over {rows(19)}", volume_trend=f"case when count(volume) over {rows(9)} >= 10 then coalesce(avg(volume) over {rows(4)} / nullif(avg(volume) over {rows(9, -5)}, 0) - 1, 0) end", obv=f"sum(signed) over {rows(None)}"),
    layer("c", "b", obv_slope=f"(obv - {lag('obv', 19)}) / 20.0"),
    select=latest("c", "#avg_volume_20", "#volume_trend", "#obv", "#obv_slope"),
))
def volume_metrics(spark, sf_dir):
    return shown(source.latest(basics.volume_metrics(source.daily(spark, sf_dir))), "ticker", "avg_volume_20", "volume_trend", "obv", "obv_slope")


def _scooter_sql(variant: str) -> str:
    (long, middle, short), (long_ema, long_roc, short_ema, short_roc, rsi), (top, strong, average) = basics.SCOOTER[variant]
    total = f"(long_pct + long_roc) / 2 * {long} + (short_pct + short_roc) / 2 * {middle} + (ppo_slope + rsi_centred) / 2 * {short}"
    return on_bars(
        layer("a", "bars", bar=f"row_number() over ({TICKER})", diff=f"close - {lag('close')}", le=ewm("close", long_ema), se=ewm("close", short_ema), pf=ewm("close", 12), ps=ewm("close", 26)),
        layer("b", "a", up="greatest(diff, 0 * diff)", down="greatest(-diff, 0 * diff)", ppo="(pf - ps) / nullif(ps, 0) * 100"),
        layer("c", "b", gain=ewm("up", alpha=1 / rsi), loss=ewm("down", alpha=1 / rsi), sig=ewm("ppo", 9)),
        layer("d", "c", h="ppo - sig"),
        layer("e", "d", rsi_centred="coalesce(100 - 100 / nullif(1 + gain / nullif(loss, 0), 0) - 50, 0)", long_pct="(close / nullif(le, 0) - 1) * 100", long_roc=f"coalesce({change('close', long_roc)} * 100, 0)",
              short_pct="(close / nullif(se, 0) - 1) * 100", short_roc=f"coalesce({change('close', short_roc)} * 100, 0)", ppo_slope=clamp(f"coalesce((h - {lag('h', 3)}) / 3, 0)", -50, 50)),
        layer("f", "e", scooter=f"case when bar >= {max(long_ema, long_roc, 35)} then {clamp(f'50 + 2.5 * ({total})', 0, 99.9)} end"),
        layer("g", "f", scooter_label=f"case when scooter >= {top} then 'leader' when scooter >= {strong} then 'strong' when scooter >= {average} then 'average' when scooter is not null then 'weak' end"),
        select=latest("g", "#scooter", "scooter_label"),
    )


for _variant in basics.SCOOTER:

    @Q.add(f"scooter_{_variant}", _scooter_sql(_variant))
    def scooter(spark, sf_dir, variant=_variant):
        return shown(source.latest(basics.scooter(source.daily(spark, sf_dir), variant)), "ticker", "scooter", "scooter_label")


@Q.add("stage_overview", on_bars(*STAGE_STEPS, dim=True, select="select ticker, date, stage, case when ema10 is null or sma20 is null or sma50 is null then 'Unknown' when ema10 > sma20 and sma20 > sma50 then 'Bullish' when ema10 < sma20 and sma20 < sma50 then 'Bearish' else 'Mixed' end as alignment, round(atr_ratio, 4) as atr_ratio, round((close / nullif(sma50, 0) - 1) * 100, 4) as from_sma50_pct, sector, industry from s left join dim using (ticker)"))
def stage_overview(spark, sf_dir):
    stages = stage.overview(source.daily(spark, sf_dir))
    joined = stages.join(source.dimension(spark, sf_dir), "ticker", "left")
    return shown(joined, "ticker", "date", "stage", "alignment", "atr_ratio", "from_sma50_pct", "sector", "industry")


@Q.add("stage_distribution", on_bars(*STAGE_STEPS, select="select stage, count(*) as tickers, round(count(*) * 100.0 / sum(count(*)) over (), 4) as share_pct from s group by stage"))
def stage_distribution(spark, sf_dir):
    return shown(stage.distribution(stage.overview(source.daily(spark, sf_dir))))


@Q.add("basic_matrix")
def basic_matrix(spark, sf_dir):
    return basics.matrix(source.daily(spark, sf_dir))
