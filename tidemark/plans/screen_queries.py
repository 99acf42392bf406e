"""Queries on the screeners. Volumes and prices of the test tables are small, so thresholds are lowered to let rows through."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import rank_share, rows, sma, true_range
from ..operators import adl, machines, screeners, volume
from ..operators.screens import Screen, screened, united
from ..sources import bars as source
from . import sql
from .common import Queries, shown

Q = Queries()
#: What Spark and DuckDB name differently.
NAMES = (("percentile(", "quantile_cont("), ("unix_date(", "date_diff('day', date '1970-01-01', "), ("struct(-pivot", "row(-pivot"))


def _recursive(r) -> str:
    if r.kind == "wilder":
        return sql.wilder(r.column, r.n)
    return sql.ewm_adjusted(r.column, r.n, r.weight, r.least) if r.kind == "ewm_adjusted" else sql.ewm(r.column, r.n, r.weight)


def steps(screen: Screen, start: str = "bars") -> tuple[list[str], str]:
    """SQL steps of a screen's layers, and the name of the last."""
    out, name = [], start
    for i, layer in enumerate(screen.layers):
        columns = layer if isinstance(layer, dict) else {r.name: _recursive(r) for r in layer}
        out.append(sql.layer(f"{screen.name}_{i}", name, **columns))
        name = f"{screen.name}_{i}"
    return out, name


def screen_sql(screen: Screen, before: tuple[str, ...] = (), start: str = "bars", dim: bool = False) -> str:
    made, name = steps(screen, start)
    if screen.last_only:
        made.append(f"last_rows as (select * from {name} qualify row_number() over (partition by ticker order by date desc) = 1)")
        name = "last_rows"
    columns = ", ".join(["ticker", "date", *(f"round({c}, 3) as {c}" for c in screen.columns), *screen.labels])
    text = sql.on_bars(*before, *made, select=f"select {columns} from {name} where {screen.keep}", dim=dim)
    for spark_name, duck_name in NAMES:
        text = text.replace(spark_name, duck_name)
    return text


def result(table, screen: Screen):
    return shown(screened(table, screen).select("ticker", "date", *(F.col(c).cast("double").alias(c) for c in screen.columns), *screen.labels), digits=3)


SCREENS = {
    "momentum": screeners.momentum(0.0, 0.0, 0.5, 90),
    "breakout": screeners.breakout(20, 20.0, 0.0, 0.5).every(),
    "rti": screeners.rti(zones=(20, 40, 80), low=90, expansion=1.05, volume=0),
    "launch_pad": screeners.launch_pad(volume=0).every(),
    **{f"guppy_{k}": screeners.guppy(k, 0.6, 0.2, 10, (0.5, 30), 0) for k in ("alignment", "compression", "expansion", "crossover", "convergence")},
    "stockbee_nine_million": screeners.nine_million(40, 1.0),
    "stockbee_weekly": screeners.weekly_movers(5.0, 0.8, 0),
    "stockbee_daily": screeners.daily_gainers(4.0, 0.9, 0),
    "stock_metrics": screeners.stock_metrics(),
    "qullamaggie": screeners.qullamaggie().every(),
    "drwish_blue_dot": screeners.blue_dot(),
    "drwish_black_dot": screeners.black_dot(),
    "drwish_green_line": screeners.green_line(5, 63, 10),
    "trend_model": screeners.trend_model(),
    "mean_reversion_model": screeners.mean_reversion(),
    "volatility_model": screeners.volatility_model(),
    "momentum_volume": screeners.momentum_volume(),
    "volume_vroc": volume.vroc(threshold=100),
    "volume_rvol": volume.rvol(threshold=1.8, volume=10),
    "volume_adtv": volume.adtv(threshold=1.2, volume=10),
    "volume_mfi": volume.mfi(),
    "volume_vpt": volume.vpt(0.5),
    "volume_sigma": volume.sigma(2.0, 10),
    "volume_absolute": volume.absolute(60, 2000, 1.0, 10, 0),
    "volume_statistical": volume.statistical(cutoff=2.0, volume=10),
    "volume_breakout": volume.breakout(ratio=1.2),
    "volume_top_share": volume.top_share(relative=1.2),
    "adl_bullish_divergence": adl.divergence(True, 0.7, 0).every(),
    "adl_bearish_divergence": adl.divergence(False, 0.7, 0).every(),
    "adl_breakout": adl.breakout(True, 30, 0.001, 0),
    "adl_breakdown": adl.breakout(False, 30, 0.001, 0),
    "adl_monthly": adl.monthly(least=0, months=0),
    "adl_short_term": adl.short_term(least=0),
    "adl_averages": adl.averages(),
}


def _add(name: str, screen: Screen) -> None:
    Q.add(f"screen_{name}", screen_sql(screen))(lambda spark, sf_dir: result(source.daily(spark, sf_dir), screen))


for _name, _screen in SCREENS.items():
    _add(_name, _screen)


VALUE = screeners.value_momentum(0.0, 1000, 0.0)
MARKET = "m as (select bars.*, i.close as market from bars join (select date, close from bars where ticker = 'S1') i using (date))"


@Q.add("screen_value_momentum", screen_sql(VALUE, (MARKET,), "m"))
def value_momentum(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    market = bars.where("ticker = 'S1'").select("date", F.col("close").alias("market"))
    return result(bars.join(market, "date"), VALUE)


MINERVINI = screeners.minervini(30, 0, 5, 4)
RATING = ("rr as (select ticker, max_by(close, date) / nullif(min_by(close, date), 0) as grown from bars group by ticker)", f"rs as (select ticker, {rank_share('grown')} * 98 + 1 as rs_rating from rr)", "b2 as (select * from bars join rs using (ticker))")


@Q.add("screen_minervini", screen_sql(MINERVINI, RATING, "b2"))
def minervini(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    rating = bars.groupBy("ticker").agg(F.try_divide(F.max_by("close", "date"), F.min_by("close", "date")).alias("grown"))
    rating = rating.select("ticker", (F.expr(rank_share("grown")) * 98 + 1).alias("rs_rating"))
    return result(bars.join(rating, "ticker"), MINERVINI)


@Q.add("screen_volume_suite", sql.on_bars(*[x for k in ("volume_vroc", "volume_rvol", "volume_mfi") for x in steps(SCREENS[k])[0]],
       select=" union all ".join(f"select '{SCREENS[k].name}' as component, ticker, date, round(close, 3) as close, round({SCREENS[k].order}, 3) as score from {steps(SCREENS[k])[1]} where {SCREENS[k].keep}" for k in ("volume_vroc", "volume_rvol", "volume_mfi"))))
def volume_suite(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    parts = [SCREENS[k] for k in ("volume_vroc", "volume_rvol", "volume_mfi")]
    return shown(united(*(screened(bars, p).select(F.lit(p.name).alias("component"), "ticker", "date", "close", F.col(p.order).alias("score")) for p in parts)), digits=3)


_PARTS = [SCREENS["adl_monthly"], SCREENS["adl_short_term"], SCREENS["adl_averages"]]
_COMPOSITE = [f"c{i} as (select ticker, score from (select * from {steps(p)[1]} qualify row_number() over (partition by ticker order by date desc) = 1) where {p.keep})" for i, p in enumerate(_PARTS)]


@Q.add("screen_adl_composite", sql.on_bars(*(x for p in _PARTS for x in steps(p)[0]), *_COMPOSITE,
       "j as (select ticker, c0.score * 0.4 + c1.score * 0.3 + c2.score * 0.3 as score from c0 join c1 using (ticker) join c2 using (ticker))",
       select="select ticker, round(score, 3) as score, row_number() over (order by score desc, ticker) as place from j order by score desc, ticker limit 50"))
def adl_composite(spark, sf_dir):
    return shown(adl.composite(source.daily(spark, sf_dir), _PARTS), digits=3)


INDUSTRY = SCREENS["stock_metrics"]
_MADE, _LAST = steps(INDUSTRY)


@Q.add("screen_industry_leaders", sql.on_bars(*_MADE, f"x as (select * from {_LAST} where bar >= 50 qualify row_number() over (partition by ticker order by date desc) = 1)",
       "y as (select x.ticker, momentum, industry, avg(momentum) over (partition by industry) as industry_score, count(*) over (partition by industry) as members from x join dim using (ticker))",
       "z as (select *, dense_rank() over (order by industry_score desc, industry) as industry_place, row_number() over (partition by industry order by momentum desc, ticker) as place from y where members >= 3)",
       "n as (select greatest(1, cast(floor(count(distinct industry) * 0.2) as int)) as top from z)", dim=True,
       select="select ticker, industry, round(industry_score, 3) as industry_score, industry_place, round(momentum, 3) as momentum, place from z, n where industry_place <= top and place <= 4"))
def industry_leaders(spark, sf_dir):
    """The best four tickers of the best fifth of industries."""
    metrics = screened(source.daily(spark, sf_dir), INDUSTRY).select("ticker", "momentum")
    best = screeners.leaders(metrics, source.dimension(spark, sf_dir), {"momentum": 1.0})
    return shown(best.withColumnsRenamed({"strength": "momentum", "industry_strength": "industry_score"}), digits=3)


@Q.add("screen_giusti", sql.on_bars(
    "mm as (select ticker, date_trunc('month', date) as month, max_by(close, date) as close, max(date) as date from bars group by all)",
    "g as (select ticker, month, close, (close / nullif(lag(close, 12) over w, 0) - 1) * 100 as perf_12m, (close / nullif(lag(close, 6) over w, 0) - 1) * 100 as perf_6m, (close / nullif(lag(close, 3) over w, 0) - 1) * 100 as perf_3m from mm window w as (partition by ticker order by month))",
    "l as (select * from g qualify row_number() over (partition by ticker order by month desc) = 1)",
    "a as (select * from l where perf_12m is not null order by perf_12m desc, ticker limit 50)", "b as (select * from a order by perf_6m desc, ticker limit 30)",
    select="select ticker, round(perf_12m, 3) as perf_12m, round(perf_6m, 3) as perf_6m, round(perf_3m, 3) as perf_3m from b order by perf_3m desc, ticker limit 10"))
def giusti(spark, sf_dir):
    """The best 50 over twelve months, of these the best 30 over six, of these the best 10 over three, by month-end closes."""
    monthly = source.rolled_up(source.daily(spark, sf_dir), "monthly")
    return shown(screeners.cascade(monthly), "ticker", "perf_12m", "perf_6m", "perf_3m", digits=3)


_ATR = (
    sql.layer("a", "bars", tr=true_range()), sql.layer("b", "a", atr=sql.wilder("tr", 14), bar="row_number() over (partition by ticker order by date)"),
    sql.layer("c", "b", atr_pct="atr / nullif(close, 0) * 100", atr_ext=f"(close - {sma('close', 50)}) / nullif(atr, 0)", past=f"list(atr) over {rows(99)}"),
    "l as (select *, len(list_filter(past, lambda x: x < atr)) / 100.0::double as atr_percentile from c qualify row_number() over (partition by ticker order by date desc) = 1)",
    "f as (" + " union all ".join(f"select ticker, date, '{k}' as kind, close, atr, atr_pct, atr_ext, atr_percentile, {s} as score from l where bar >= 110 and {c}" for k, (c, s) in screeners.ATR_TYPES.items()) + ")",
)


@Q.add("screen_atr_types", sql.on_bars(*_ATR, select="select ticker, date, kind, round(close, 3) as close, round(atr, 3) as atr, round(atr_pct, 3) as atr_pct, round(atr_ext, 3) as atr_ext, round(atr_percentile, 3) as atr_percentile, round(score, 3) as score from f where score > 0"))
def atr_types(spark, sf_dir):
    return shown(screeners.atr_types(source.daily(spark, sf_dir), volume=0), digits=3)


@Q.add("screen_atr_signals")
def atr_signals(spark, sf_dir):
    return shown(machines.atr_signals(source.daily(spark, sf_dir), volume=0), digits=3)


@Q.add("screen_atr_stops")
def atr_stops(spark, sf_dir):
    return shown(machines.stops(source.daily(spark, sf_dir)), "ticker", "date", "close", "stop", "uptrend", "distance_pct", digits=3)


@Q.add("screen_breakout_positions")
def breakout_positions(spark, sf_dir):
    rows = machines.breakout_positions(source.daily(spark, sf_dir)).where("changed = 1")
    return shown(rows, "ticker", "date", "close", "volume", "trend", "position", digits=3)


@Q.add("screen_breakout_signals")
def breakout_signals(spark, sf_dir):
    return shown(machines.breakout_signals(source.daily(spark, sf_dir), volume=0), digits=3)


