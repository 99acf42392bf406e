"""Queries on relative strength, composites and market pulse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import change, rank_share, rows, sma
from ..operators import breadth, machines, pulse, strength
from ..sources import bars as source
from . import breadth_queries
from .common import Queries, shown
from .sql import layer, on_bars

Q = Queries()
PERIODS = (5, 22, 66, 252)
GRID = (
    "d as (select distinct date from bars)", "f as (select ticker, min(date) as first from bars group by ticker)", "g as (select ticker, date from f, d where date >= first)",
    "e as (select g.ticker, g.date, last_value(close ignore nulls) over (partition by g.ticker order by g.date rows unbounded preceding) as close from g left join bars using (ticker, date))",
    "mk as (select date, avg(close) as base from e group by date)",
)
RS = {f"rs_{p}": f"(1 + {change('close', p)}) / nullif(1 + {change('base', p)}, 0)" for p in PERIODS}
STOCKS = (*GRID, "j as (select * from e join mk using (date))", layer("r", "j", **RS), "l as (select * from r qualify row_number() over (partition by ticker order by date desc) = 1)")
RS_SHOWN = ", ".join(f"round({c}, 4) as {c}" for c in RS)


def stock_strength(spark, sf_dir):
    prices = source.filled(source.daily(spark, sf_dir), max(PERIODS) + 1)
    return strength.relative_strength(prices, strength.market(prices), PERIODS)


@Q.add("rs_stocks", on_bars(*STOCKS, select=f"select ticker, date, {RS_SHOWN} from l"))
def rs_stocks(spark, sf_dir):
    return shown(stock_strength(spark, sf_dir))


@Q.add("rs_averages", on_bars(layer("r", "bars", **{f"ma_{p}": f"(close - {sma('close', p)}) / nullif({sma('close', p)}, 0) * 100" for p in (20, 50)}), select="select ticker, date, round(ma_20, 4) as ma_20, round(ma_50, 4) as ma_50 from r qualify row_number() over (partition by ticker order by date desc) = 1"))
def rs_averages(spark, sf_dir):
    return shown(strength.average_strength(source.daily(spark, sf_dir)))


def _composite(by: str, weighted: bool) -> tuple[str, ...]:
    price = "sum(close * w) / sum(w)" if weighted else "avg(close)"
    return (
        *GRID, f"h as (select *, {by} as grp, case when market_cap > 0 then market_cap else 1.0 end as w from e join dim using (ticker) where close is not null)",
        "k as (select grp from h group by grp having count(distinct ticker) >= 2)", f"c as (select grp as ticker, date, {price} as close from h semi join k using (grp) group by grp, date)",
        "j as (select * from c join mk using (date))", layer("r", "j", **RS), "l as (select * from r qualify row_number() over (partition by ticker order by date desc) = 1)",
    )


for _by in ("sector", "industry"):
    for _weighted in (False, True):

        @Q.add(f"rs_{_by}_{'cap' if _weighted else 'equal'}", on_bars(*_composite(_by, _weighted), select=f"select ticker, date, {RS_SHOWN} from l", dim=True))
        def rs_groups(spark, sf_dir, by=_by, weighted=_weighted):
            return shown(strength.strength_of_groups(source.daily(spark, sf_dir), source.dimension(spark, sf_dir), PERIODS, by, weighted))


def _per(scale: str, ties: str, within: str | None = None) -> str:
    def one(c: str) -> str:
        share = rank_share(c, ties, within)
        return {"ibd": f"cast(round_even({share} * 98 + 1, 0) as int)", "standard": f"cast(round_even({share} * 100, 0) as int)", "fine": f"round(least({share} * 100, 99.9), 1)"}[scale]

    return ", ".join(f"{one(c)} as per_{c}" for c in RS)


for _scale, _ties in (("ibd", "average"), ("standard", "min"), ("fine", "average")):

    @Q.add(f"per_{_scale}", on_bars(*STOCKS, select=f"select ticker, {_per(_scale, _ties)} from l"))
    def per(spark, sf_dir, scale=_scale, ties=_ties):
        return strength.percentiles(stock_strength(spark, sf_dir), list(RS), scale, ties).select("ticker", *(f"per_{c}" for c in RS))


@Q.add("per_universes", on_bars(*STOCKS, "u as (select l.*, sector as universe from l join dim using (ticker))", select=f"select ticker, universe, {_per('ibd', 'average', 'universe')} from u", dim=True))
def per_universes(spark, sf_dir):
    members = breadth_queries.members(spark, sf_dir)
    return strength.percentiles_by_universe(stock_strength(spark, sf_dir), members, list(RS)).select("ticker", "universe", *(f"per_{c}" for c in RS))


@Q.add("rs_rating", on_bars(*STOCKS, f"p as (select ticker, {_per('ibd', 'average')} from l)", select="select ticker, round((coalesce(per_rs_66 * 2.0, 0) + coalesce(per_rs_252 * 1.0, 0)) / nullif(case when per_rs_66 is not null then 2.0 else 0 end + case when per_rs_252 is not null then 1.0 else 0 end, 0), 4) as rating from p"))
def rs_rating(spark, sf_dir):
    values = strength.percentiles(stock_strength(spark, sf_dir), list(RS))
    return shown(strength.weighted_rating(values, {"per_rs_66": 2.0, "per_rs_252": 1.0}), "ticker", "rating")


@Q.add("rs_performance", on_bars(*STOCKS, "p as (select ticker, rs_5 / nullif(rs_22, 0) as short_momentum, rs_22 / nullif(rs_66, 0) as middle_momentum, rs_66 / nullif(rs_252, 0) as long_momentum, list_filter([rs_5, rs_22, rs_22, rs_66, rs_66, rs_252], lambda x: x > 0) as v from l)",
       "q as (select *, case when len(v) > 0 then exp(list_avg(list_transform(v, lambda x: ln(x)))) else 1.0 end as composite from p)",
       select="select ticker, round(short_momentum, 4) as short_momentum, round(middle_momentum, 4) as middle_momentum, round(long_momentum, 4) as long_momentum, round(composite, 4) as composite, case when composite > 1 and short_momentum > 1 then 'leading' when composite > 1 then 'weakening' when short_momentum > 1 then 'improving' else 'lagging' end as quadrant, case when composite >= 1.2 then 'elite' when composite >= 1.05 then 'strong' when composite >= 0.95 then 'average' else 'weak' end as class from q"))
def rs_performance(spark, sf_dir):
    out = strength.performance(stock_strength(spark, sf_dir), ("rs_5", "rs_22"), ("rs_22", "rs_66"), ("rs_66", "rs_252"))
    return shown(out, "ticker", "short_momentum", "middle_momentum", "long_momentum", "composite", "quadrant", "class")


ZONE_STEPS = [layer(f"z{i}", f"z{i - 1}" if i else "bars", **x) for i, x in enumerate(pulse.ZONE_LAYERS)]
_ZONE_DAYS = ", ".join(f"count(*) filter (zone = '{z}') as {z.lower()}_days" for z in pulse.ZONES)


@Q.add("pulse_zones", on_bars(*ZONE_STEPS, f"s as (select ticker, count(*) as days, {_ZONE_DAYS} from z2 group by ticker)", select="select *, round((dark_green_days + light_green_days) * 100.0 / days, 4) as bullish_pct, round((light_red_days + dark_red_days) * 100.0 / days, 4) as bearish_pct from s"))
def pulse_zones(spark, sf_dir):
    return shown(pulse.zone_statistics(source.daily(spark, sf_dir)))


CYCLE_STEPS = (*(layer(f"y{i}", f"y{i - 1}" if i else "bars", **x) for i, x in enumerate(pulse.CYCLE_LAYERS)), "yk as (select * from y3 where cycle is not null)", layer("ya", "yk", **pulse.RUN_LAYERS[0]), layer("yb", "ya", **pulse.RUN_LAYERS[1]))


@Q.add("pulse_cycles", on_bars(*CYCLE_STEPS, select="select ticker, cast(number as bigint) as number, cycle, min(date) as first, max(date) as last, count(*) as candles, round(max(distance_pct), 4) as farthest_pct, round(max(high), 4) as peak, round(min(low), 4) as trough from yb group by ticker, number, cycle"))
def pulse_cycles(spark, sf_dir):
    return shown(pulse.cycles(source.daily(spark, sf_dir)))


@Q.add("pulse_cycle_statistics", on_bars(*CYCLE_STEPS, "yc as (select ticker, number, cycle, count(*) as candles, max(distance_pct) as far from yb group by all)", select="select ticker, cycle, count(*) as cycles, max(candles) as longest, round(avg(candles), 4) as mean_candles, round(max(far), 4) as farthest_pct from yc group by ticker, cycle"))
def pulse_cycle_statistics(spark, sf_dir):
    return shown(pulse.cycle_statistics(source.daily(spark, sf_dir)))


DAY_STEPS = [layer(f"t{i}", f"t{i - 1}" if i else "bars", **x) for i, x in enumerate(pulse.DAY_LAYERS)]


@Q.add("pulse_special_days", on_bars(*DAY_STEPS, select="select ticker, date, round(close, 4) as close, round(change_pct, 4) as change_pct, round(volume_ratio, 4) as volume_ratio, day from t2 where day is not null"))
def special_days(spark, sf_dir):
    return shown(pulse.special_days(source.daily(spark, sf_dir)))


@Q.add("pulse_market_state", on_bars(*DAY_STEPS, "tn as (select *, max(date) over (partition by ticker) as as_of from t2)", "tc as (select ticker, count(*) filter (as_of - date <= 250 and day = 'FTD') as ftd, count(*) filter (as_of - date <= 250 and day = 'DD') as dd from tn group by ticker)", select=f"select ticker, ftd, dd, {pulse.STATE} as state from tc"))
def market_state(spark, sf_dir):
    return pulse.market_state(source.daily(spark, sf_dir), 250)


INDEX_STEPS = [layer(f"x{i}", f"x{i - 1}" if i else "bars", **x) for i, x in enumerate(pulse.INDEX_LAYERS)]


@Q.add("pulse_index_scores", on_bars(*INDEX_STEPS, select="select ticker, date, round(close, 4) as close, round(r1, 4) as r1, round(r2, 4) as r2, round(r3, 4) as r3, round(r4, 4) as r4, r5, r6, round(score, 4) as score, case when score >= 5 then 'GREEN' when score <= 3 then 'RED' else 'YELLOW' end as light from x4 qualify row_number() over (partition by ticker order by date desc) = 1"))
def index_scores(spark, sf_dir):
    out = pulse.index_scores(source.daily(spark, sf_dir))
    return shown(out.withColumns({c: F.col(c).cast("double") for c in ("r1", "r2", "r3", "r4", "score")}))


@Q.add("pulse_general_market")
def general_market(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    return shown(pulse.general_market(breadth.breadth(bars, many=3), bars.where("ticker = 'S1'")))


@Q.add("pulse_longest_runs", on_bars(f"i as (select *, sum(case when close > open then 0 else 1 end) over {rows(None)} as run from bars)", "n as (select ticker, run, count(*) as n from i where close > open group by all)", select="select ticker, cast(coalesce(max(n), 0) as bigint) as longest from (select distinct ticker from bars) left join n using (ticker) group by ticker"))
def longest_runs(spark, sf_dir):
    return pulse.longest_runs(source.daily(spark, sf_dir), "close > open")


@Q.add("pulse_smoothed_cycles")
def smoothed_cycles(spark, sf_dir):
    return machines.smoothed_cycles(source.daily(spark, sf_dir)).groupBy("ticker", "cycle").agg(F.count("*").alias("bars"))
