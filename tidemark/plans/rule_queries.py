"""Queries on classes of stocks and groups, stages by timeframe, divergences of the accumulation line, recent listings, the base filter and standard signals.

The SQL is written by hand from the rules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import backtest, indicators, leaders, screeners, stage, strength
from ..operators.adl import LINE
from ..operators.screens import Screen, screened
from ..sources import bars as source
from .common import Queries, shown
from .market_queries import GRID
from .sql import ewm_adjusted, on_bars

Q = Queries()
PERIODS = leaders.PERIODS
RS = [f"rs_{p}" for p in PERIODS]
LAST = "qualify row_number() over (partition by ticker order by date desc) = 1"


def _strengths(prices: str, name: str) -> tuple[str, str]:
    """SQL of the last strengths of prices (ticker, date, close) against the market of the grid."""
    made = ", ".join(f"(close / nullif(lag(close, {p}) over w, 0)) / nullif(base / nullif(lag(base, {p}) over w, 0), 0) as rs_{p}" for p in PERIODS)
    return f"j_{name} as (select * from {prices} join mk using (date))", f"{name} as (select ticker, {made} from j_{name} window w as (partition by ticker order by date) {LAST})"


def _ranks(source_: str, by: str | None = None) -> str:
    own = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    made = ", ".join(
        f"case when rs_{p} is not null then cast(round_even((rank() over (partition by {own}rs_{p} is null order by rs_{p}) + (count(*) over (partition by {own}rs_{p}) - 1) / 2.0)::double / (count(rs_{p}) over ({part})) * 98 + 1, 0) as int) end as per_rs_{p}" for p in PERIODS
    )
    return f"(select *, {made} from {source_})"


def _measures(source_: str) -> tuple[str, ...]:
    one = {p: f"coalesce(rs_{p}, 1)" for p in PERIODS}
    back = lambda a, b: f"case when {one[b]} = 0 then 0 else ({one[a]} / {one[b]} - 1) * 100 end"
    return (
        f"m1 as (select *, {back(3, 7)} as ms, {back(14, 44)} as mm, {back(66, 252)} as ml, list_filter([{', '.join(one.values())}], lambda x: x > 0) as pos, "
        f"({' + '.join(f'({x} > 1)::int' for x in one.values())}) * 100.0 / 9 as consistency, ({' + '.join(f'coalesce(per_rs_{p}, 50)' for p in PERIODS)}) / 9.0 as mean_percentile from {source_})",
        "m2 as (select *, case when len(pos) = 0 then 1 else exp(list_sum(list_transform(pos, lambda x: ln(x))) / len(pos)) end as composite, (ms + mm + ml) / 3 as mean, "
        "case when ms > 0 and mm > 0 and ml > 0 then 'ACCELERATING' when ms > 0 and mm > 0 then 'BUILDING' when ms < 0 and mm < 0 and ml < 0 then 'DECELERATING' when ms < 0 and mm < 0 then 'WEAKENING' "
        "when abs(ms) < 2 and abs(mm) < 2 and abs(ml) < 2 then 'CONSOLIDATING' else 'MIXED' end as pattern from m1)",
    )


MEASURED = (
    "round(ms, 3) as momentum_short, round(mm, 3) as momentum_middle, round(ml, 3) as momentum_long, pattern, case when mean > 5 then 'STRONG_BULLISH' when mean > 0 then 'BULLISH' when mean > -5 then 'NEUTRAL' else 'BEARISH' end as momentum, "
    "round(composite, 3) as composite, round(consistency, 3) as consistency, round(mean_percentile, 3) as mean_percentile"
)
SHOWN = ("momentum_short", "momentum_middle", "momentum_long", "pattern", "momentum", "composite", "consistency", "mean_percentile")
_MA = ", ".join(f"case when count(close) over (partition by ticker order by date rows between {p - 1} preceding and current row) = {p} then (close / nullif(avg(close) over (partition by ticker order by date rows between {p - 1} preceding and current row), 0) - 1) * 100 end as ma_{p}" for p in PERIODS)
STOCKS = (
    *GRID, *_strengths("e", "l"), f"a as (select ticker, {_MA} from bars {LAST})", f"r as {_ranks('l')}",
    f"k as (select r.* replace ({', '.join(f'coalesce(r.rs_{p}, a.ma_{p}) as rs_{p}' for p in PERIODS)}) from r left join a using (ticker))", *_measures("k"),
)


def stocks(spark, sf_dir) -> DataFrame:
    """Percentiles of each stock with its strengths by both methods beside them, measured."""
    bars = source.daily(spark, sf_dir)
    prices = source.filled(bars, max(PERIODS) + 1)
    own = strength.relative_strength(prices, strength.market(prices), PERIODS)
    averages = strength.average_strength(bars, PERIODS).withColumnsRenamed({f"ma_{p}": f"rs_{p}" for p in PERIODS})
    ranks = strength.percentiles(own, RS).select("ticker", *(f"per_{c}" for c in RS))
    return leaders.measured(leaders.beside(ranks, {"returns": own, "averages": averages}, RS))


@Q.add("rs_stock_classes", on_bars(*STOCKS, select=f"""select ticker, {MEASURED}, case when composite > 1.05 and consistency > 75 and mean_percentile > 80 then 'ELITE_LEADER' when composite > 1.05 and consistency > 50 then 'STRONG_PERFORMER'
    when composite > 1 and mean_percentile > 60 then 'ABOVE_AVERAGE' when composite < 0.95 and consistency < 25 then 'WEAK_LAGGARD' else 'AVERAGE' end as class from m2"""))  # fmt: skip
def rs_stock_classes(spark, sf_dir):
    return shown(leaders.stock_classes(stocks(spark, sf_dir)), "ticker", *SHOWN, "class", digits=3)


@Q.add("rs_leaders", on_bars(*STOCKS, "n as (select count(*) as stocks, count(*) filter (composite > 1.05) as up, count(*) filter (composite < 0.95) as down from m2)",
    "t as (select 'leader' as side, row_number() over (order by composite desc, ticker) as place, ticker, composite, up as of_side, stocks from m2, n where composite > 1.05 union all select 'laggard', row_number() over (order by composite, ticker), ticker, composite, down, stocks from m2, n where composite < 0.95)",
    select="select side, place, ticker, round(composite, 3) as composite, of_side, round(of_side * 100.0 / stocks, 3) as share_pct from t where place <= 10"))
def rs_leaders(spark, sf_dir):
    """The ten strongest leaders and weakest laggards."""
    return shown(leaders.leaders_and_laggards(stocks(spark, sf_dir)), digits=3)


KINDS = ("sector", "industry")


def _groups(kind: str) -> tuple[str, ...]:
    """SQL of the mean price of each group of two tickers or more, and of the groups' strengths."""
    return (
        f"h_{kind} as (select {kind} as grp, ticker, date, close from e join dim using (ticker) where close is not null)",
        f"c_{kind} as (select grp as ticker, date, avg(close) as close from h_{kind} where grp in (select grp from h_{kind} group by grp having count(distinct ticker) >= 2) group by grp, date)",
        *_strengths(f"c_{kind}", f"s_{kind}"),
    )


@Q.add("rs_group_classes", on_bars(*GRID, *(s for k in KINDS for s in _groups(k)), "g2 as (" + " union all ".join(f"select '{k}' as kind, * from s_{k}" for k in KINDS) + ")", f"k as {_ranks('g2', 'kind')}", *_measures("k"), dim=True,
    select=f"""select kind, ticker, {MEASURED}, case when composite > 1.05 and mm > 0 then 'LEADING' when composite > 1 then 'OUTPERFORMING' when composite < 0.95 then 'LAGGING' else 'NEUTRAL' end as class,
    case when ms > 0 and mm > 0 then 'STRONG_IN' when ms < 0 and mm < 0 then 'ROTATING_OUT' else 'NEUTRAL' end as rotation,
    case when composite > 1 and mm > 0 then 'leading_improving' when composite > 1 and mm < 0 then 'leading_weakening' when composite < 1 and mm > 0 then 'lagging_improving' else 'lagging_weakening' end as quadrant from m2"""))  # fmt: skip
def rs_group_classes(spark, sf_dir):
    """Sectors and industries: percentiles within their kind beside their strengths, with class, rotation and quadrant."""
    bars, dimension = source.daily(spark, sf_dir), source.dimension(spark, sf_dir)
    groups = reduce(DataFrame.unionByName, (strength.strength_of_groups(bars, dimension, PERIODS, k).withColumn("kind", F.lit(k)) for k in KINDS))
    return shown(leaders.group_classes(leaders.measured(strength.percentiles(groups, RS, within="kind"))), "kind", "ticker", *SHOWN, "class", "rotation", "quadrant", digits=3)


RULES = {"daily": stage.Rules(), "weekly": stage.Rules(5, 10, 30, 10, 8.0, 14.0, 0.02), "monthly": stage.Rules(3, 6, 12, 6, 15.0, 25.0, 0.03)}


def _stages(name: str) -> tuple[str, ...]:
    r, unit = RULES[name], {"weekly": "week", "monthly": "month"}.get(name)
    rolled = f"(select ticker, cast(date_trunc('{unit}', date) as date) as date, max(high) as high, min(low) as low, max_by(close, date) as close from bars group by ticker, date_trunc('{unit}', date))" if unit else "bars"
    mean = lambda c, n: f"case when count({c}) over (partition by ticker order by date rows between {n - 1} preceding and current row) = {n} then avg({c}) over (partition by ticker order by date rows between {n - 1} preceding and current row) end"
    return (
        f"a_{name} as (select *, lag(close) over (partition by ticker order by date) as before from {rolled})",
        f"b_{name} as (select *, greatest(high, coalesce(before, high)) - least(low, coalesce(before, low)) as tr, {ewm_adjusted('close', r.fast)} as f, {mean('close', r.middle)} as m, {mean('close', r.slow)} as s from a_{name})",
        f"""d_{name} as (select '{name}' as timeframe, ticker, date, close, f, m, s, ({mean('tr', r.atr)}) / s * 100 as ratio, {r.quiet} as quiet, {r.wide} as wide, {r.close} as near from b_{name} {LAST})""",
    )


STAGE = """case when f is null or m is null or s is null or ratio is null then '??' when greatest(abs(f / m - 1), abs(m / s - 1), abs(f / s - 1)) <= near then 'LP'
  when close <= least(f, m, s) then case when ratio >= wide then '4C' when ratio < quiet then '4A' when f < m and m < s then '4B' when close <= f and close <= m and close >= s then '3C' else '3B' end
  when close <= f and close <= m and close >= s then case when ratio >= quiet then '3C' else '3A' end
  when close >= greatest(f, m, s) then case when ratio >= wide then '2C' when ratio < quiet then '2A' when f > m and m > s then '2B' when close <= s then '1B' else '??' end
  when close < f and close >= m and close >= s then '1C' when close >= f and close >= m and close <= s then '1B' when close >= f and close <= m and close <= s then '1A' else '??' end"""


@Q.add("stage_timeframes", on_bars(*(s for t in RULES for s in _stages(t)), "u as (" + " union all ".join(f"select * from d_{t}" for t in RULES) + ")",
    select=f"select timeframe, ticker, date, {STAGE} as stage, case when f is null or m is null or s is null then 'Unknown' when f > m and m > s then 'Bullish' when f < m and m < s then 'Bearish' else 'Mixed' end as alignment, round(ratio, 3) as atr_ratio from u"))
def stage_timeframes(spark, sf_dir):
    """Stages by day, week and month, each by its own averages and limits."""
    bars = source.daily(spark, sf_dir)
    tables = {t: bars if t == "daily" else source.rolled_up(bars, t) for t in RULES}
    return shown(stage.by_timeframe(tables, RULES), "timeframe", "ticker", "date", "stage", "alignment", "atr_ratio", digits=3)


DIVERGENCE = Screen("adl_divergence", (*LINE, *indicators.line_divergence_layers("adl")), "divergence <> 0", ("close", "adl", "divergence"), last_only=False)
_AROUND, _BEFORE = "over (partition by ticker order by date rows between 10 preceding and 9 following)", "over (partition by ticker order by date rows between 20 preceding and 1 preceding)"


@Q.add("indicator_adline_divergence", on_bars(
    "f as (select *, case when high = low then 0 else ((close - low) - (high - close)) / (high - low) end * volume as flow from bars)",
    "g as (select *, round(sum(flow) over (partition by ticker order by date), 6) as adl, row_number() over (partition by ticker order by date) as bar, count(*) over (partition by ticker) as bars from f)",
    "h as (select *, " + ", ".join(f"case when count(*) {_AROUND} = 20 and {c} = {a}({c}) {_AROUND} then {c} end as {c}_{a}" for c in ("close", "adl") for a in ("min", "max")) + " from g)",
    "i as (select *, " + ", ".join(f"last_value({c}_{a} ignore nulls) {_BEFORE} as {c}_{a}_before" for c in ("close", "adl") for a in ("min", "max")) + " from h)",
    "j as (select *, case when close_min < close_min_before and adl_min > adl_min_before then 1 when close_max > close_max_before and adl_max < adl_max_before then -1 else 0 end as divergence from i where bar > 20 and bar <= bars - 20)",
    select="select ticker, date, round(close, 3) as close, round(adl, 3) as adl, divergence from j where divergence <> 0"))
def adline_divergence(spark, sf_dir):
    return shown(screened(source.daily(spark, sf_dir), DIVERGENCE), "ticker", "date", "close", "adl", "divergence", digits=3)


#: Bars below which the tickers of the tables, which all have some 600, count as listed lately.
LISTED = 600


@Q.add("screen_recent_listing", on_bars(
    f"n as (select *, row_number() over w as bar, {ewm_adjusted('close', 10)} as ema10, avg(close) over (w rows 19 preceding) as sma20, avg(close) over (w rows 49 preceding) as sma50, max(high) over (w rows 19 preceding) as top, min(low) over (w rows 19 preceding) as bottom from bars window w as (partition by ticker order by date))",
    f"l as (select *, case when top = bottom then 1 else (close - bottom) / (top - bottom) end as place from n {LAST})",
    select=f"select ticker, date, round(close, 3) as close, round(ema10, 3) as ema10, round(sma20, 3) as sma20, round(sma50, 3) as sma50, bar, round(place, 3) as range_position from l where bar >= 50 and bar < {LISTED} and close >= ema10 and ema10 >= sma20 and sma20 >= sma50 and place >= 0.5"))
def recent_listing(spark, sf_dir):
    return shown(screened(source.daily(spark, sf_dir), screeners.recent_listing(LISTED)), digits=3)


@Q.add("screen_tradable", on_bars("n as (select ticker, count(*) as bars, max_by(close, date) as close from bars group by ticker)", dim=True,
    select="select ticker, bars, round(close, 4) as close from n left join dim using (ticker) where bars >= 50 and close >= 1000 and coalesce(market_cap >= 5e10, true) and coalesce(exchange in ('NYSE', 'NASDAQ'), true) and not coalesce(regexp_matches(upper(description), '7'), false)"))
def tradable(spark, sf_dir):
    """The base filter, with limits that the tables' prices and names meet in part."""
    return shown(screeners.tradable(source.daily(spark, sf_dir), source.dimension(spark, sf_dir), 1000, 5e10, ("NYSE", "NASDAQ"), ("7",)))


@Q.add("bar_scores", on_bars("v as (select *, lag(close) over w as before, array_agg(close) over (w rows 2 preceding) as three from bars window w as (partition by ticker order by date))", f"l as (select *, case when high = low then 0 else (close - low) / (high - low) end as part, case when before = 0 or before is null then 0 else (close - before) / abs(before) * 100 end as move from v {LAST})",
    "m as (select *, greatest(0, least(100, (move + 20) / 40 * 100)) as up from l)",
    select="""select ticker, round(part, 4) as part, round(move, 4) as move, round(up, 4) as up, round(100 - up, 4) as down, round((part * 100 * 3 + up) / 4, 4) as score,
    case when (part * 300 + up) / 4 >= 80 then 'Excellent' when (part * 300 + up) / 4 >= 60 then 'Good' when (part * 300 + up) / 4 >= 40 then 'Fair' when (part * 300 + up) / 4 >= 20 then 'Poor' else 'Very Poor' end as category,
    case when len(three) < 2 then 'mixed' when three = list_sort(three) and len(list_distinct(three)) = len(three) then 'increasing' when three = list_reverse_sort(three) and len(list_distinct(three)) = len(three) then 'decreasing' else 'mixed' end as trend from m"""))  # fmt: skip
def bar_scores(spark, sf_dir):
    """The scalar helpers on each ticker's last bar: guarded quotients and changes, scores between bounds, weighted scores, their categories, trends of lists."""
    by = "over (partition by ticker order by date"
    last = source.latest(source.daily(spark, sf_dir).withColumns({"before": F.expr(f"lag(close) {by})"), "three": F.expr(f"collect_list(close) {by} rows 2 preceding)")}))
    out = last.withColumns({"part": scalars.safe_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), "move": scalars.percentage_change(F.col("close"), F.col("before"))})
    out = out.withColumns({"up": scalars.normalised(F.col("move"), -20.0, 20.0), "down": scalars.normalised(F.col("move"), -20.0, 20.0, reverse=True), "whole": F.col("part") * 100})
    out = out.withColumn("score", scalars.weighted_score({"whole": 3.0, "up": 1.0}))
    return shown(out.withColumns({"category": scalars.score_category(F.col("score")), "trend": scalars.trend_of(F.col("three"))}), "ticker", "part", "move", "up", "down", "score", "category", "trend")


@Q.add("backtest_signals", on_bars("p as (select *, close / lag(close) over (partition by ticker order by date) - 1 as move from bars)",
    "s as (select ticker, date as signal_date, case when move > 0.3 then 'Buy' else 'Sell' end as signal_type, close as signal_price from p where abs(move) > 0.3 and date <= date '1998-06-30' and date >= date '1995-01-01')",
    select="select 'jumps' as strategy, ticker, signal_date, signal_type, round(signal_price, 4) as signal_price, 'moves' as screener_type, 'moves_daily.csv' as source_file, 'daily' as timeframe from s"))
def backtest_signals(spark, sf_dir):
    """Large moves as standard signals, each twice in what comes in, with where they are from, between two dates."""
    moves = source.daily(spark, sf_dir).withColumn("move", F.expr("close / lag(close) over (partition by ticker order by date) - 1")).where("abs(move) > 0.3")
    signals = moves.select("ticker", F.col("date").alias("signal_date"), F.when(F.col("move") > 0.3, "Buy").otherwise("Sell").alias("signal_type"), F.col("close").alias("signal_price"))
    about = {"screener_type": "moves", "source_file": "moves_daily.csv", "timeframe": "daily"}
    return shown(backtest.between(backtest.standard(signals.unionByName(signals), "jumps", "1998-06-30", about), "1995-01-01", "2100-01-01"))
