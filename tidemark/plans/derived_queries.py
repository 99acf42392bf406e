"""Queries on market indexes, several benchmarks, levels, cascades, leaders and summaries. The SQL is written by hand from the rules, not from the operators' text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import weighted_average
from ..operators import adl, backtest, basics, breadth, options, pulse, screeners, strength, universes
from ..operators.screens import layered
from ..sources import bars as source
from . import basic_queries, portfolio_queries
from .common import Queries, shown
from .sql import on_bars

Q = Queries()
W = "window w as (partition by ticker order by date)"


@Q.add("weighted_averages", on_bars("n as (select *, row_number() over (partition by ticker order by date) as bar from bars)", select="select a.ticker, a.date, round(sum(b.close * (b.bar - a.bar + 10)) / 55, 4) as wma_10 from n a join n b on a.ticker = b.ticker and b.bar between a.bar - 9 and a.bar where a.bar >= 10 group by a.ticker, a.date"))
def weighted_averages(spark, sf_dir):
    return shown(source.daily(spark, sf_dir).withColumn("wma_10", F.expr(weighted_average("close", 10))).where("wma_10 is not null"), "ticker", "date", "wma_10")


BREADTH = (
    "p as (select *, lag(close) over w as before, count(*) over (partition by ticker order by date rows between 251 preceding and current row) as n_252, max(high) over (partition by ticker order by date rows between 251 preceding and current row) as top_252 from bars " + W + ")",
    "adv as (select date, cast(count(*) filter (close > before) - count(*) filter (close < before) as bigint) as net_advances from p group by date)",
)


def breadth_rows(spark, sf_dir):
    return breadth.breadth(source.daily(spark, sf_dir), many=3)


INDEXES = ("S1", "S2", "S3")
_POINT = "(case when close > {0} then 0.5 else 0 end + case when {0} > {0}_before then 0.5 else 0 end)"


@Q.add("pulse_requirements", on_bars(*BREADTH,
    "i as (select *, " + ", ".join(f"case when count(close) over r{n} = {n} then avg(close) over r{n} end as s{n}" for n in (10, 20, 50, 150)) + ", coalesce(100 * (close - case when count(low) over r10 = 10 then min(low) over r10 end) / nullif(max(high) over r10 - min(low) over r10, 0), 0) as k from bars where ticker in ('S1', 'S2', 'S3') window " + ", ".join(f"r{n} as (partition by ticker order by date rows between {n - 1} preceding and current row)" for n in (10, 20, 50, 150)) + ")",
    "i2 as (select *, " + ", ".join(f"lag(s{n}) over w as s{n}_before" for n in (10, 20, 50)) + ", row_number() over w as bar, coalesce(case when count(*) over r4 = 4 then avg(k) over r4 end, 0) as slow from i window w as (partition by ticker order by date), r4 as (partition by ticker order by date rows between 3 preceding and current row))",
    "i3 as (select *, coalesce(case when count(*) over r4 = 4 then avg(slow) over r4 end, 0) as fast from i2 window r4 as (partition by ticker order by date rows between 3 preceding and current row))",
    "l as (select * from i3 qualify row_number() over (partition by ticker order by date desc) = 1)",
    "a as (select l.*, (select adv.net_advances from adv where adv.date <= l.date order by adv.date desc limit 1) as net from l)",
    "q as (select ticker, date, case when net > 0 then 1.0 else 0.0 end as r1, " + ", ".join(f"{_POINT.format(f's{n}')} as r{r}" for r, n in ((2, 50), (3, 20), (4, 10))) + ", case when s20 > s50 and s50 > s150 then 1.0 else 0.0 end as r5, case when slow < 20 then 1.0 else 0.0 end as r6, 0.0 as r7, case when fast > slow or fast > 80 then 1.0 else 0.0 end as r8, case when slow <= 20 then 1.0 else 0.0 end as r9 from a)",
    select="select ticker, date, " + ", ".join(f"round(r{i}::double, 4) as r{i}" for i in range(1, 10)) + ", round((r1 + r2 + r3 + r4 + r5 + r6 + r7 + r8 + r9)::double, 4) as score, case when r1 + r2 + r3 + r4 + r5 + r6 + r7 + r8 + r9 >= 5 then 'GREEN' when r1 + r2 + r3 + r4 + r5 + r6 + r7 + r8 + r9 <= 3 then 'RED' else 'NEUTRAL' end as light from q"))
def requirements(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    return shown(pulse.index_requirements(bars.where(F.col("ticker").isin(*INDEXES)), breadth_rows(spark, sf_dir)))


@Q.add("pulse_requirements_mean", "select max(date) as date, count(*) as indexes, " + ", ".join(f"round(avg(r{i}), 4) as r{i}" for i in range(1, 6)) + ", round(avg(r1) + avg(r2) + avg(r3) + avg(r4) + avg(r5), 4) as score, case when avg(r1) + avg(r2) + avg(r3) + avg(r4) + avg(r5) >= 5 then 'GREEN' when avg(r1) + avg(r2) + avg(r3) + avg(r4) + avg(r5) <= 3 then 'RED' else 'NEUTRAL' end as light from (" + Q.sql["pulse_requirements"] + ")")
def requirements_mean(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    return shown(pulse.mean_requirements(pulse.index_requirements(bars.where(F.col("ticker").isin(*INDEXES)), breadth_rows(spark, sf_dir))))


@Q.add("pulse_general_index")
def general_index(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    one = lambda t: bars.where(F.col("ticker") == t)
    return shown(pulse.general_market_index(breadth_rows(spark, sf_dir), one("S1"), one("S2"), one("S3"), many=3))


@Q.add("pulse_as_of", on_bars(select="select x.ticker, x.date, round(y.close, 4) as other from (select * from bars where ticker = 'S1') x asof left join (select * from bars where ticker = 'S2') y on y.date <= x.date"))
def as_of(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    other = bars.where("ticker = 'S2'").select("date", F.col("close").alias("other"))
    return shown(pulse.as_of(bars.where("ticker = 'S1'").select("ticker", "date"), other, ["other"]))


MARKS = ("d as (select distinct date from bars)", "f as (select ticker, min(date) as first from bars group by ticker)", "g as (select ticker, date from f, d where date >= first)",
         "e as (select g.ticker, g.date, last_value(close ignore nulls) over (partition by g.ticker order by g.date rows unbounded preceding) as close from g left join bars using (ticker, date))",
         "m as (select 'ALL' as benchmark, date, avg(close) as base from e group by date union all select ticker, date, close from e where ticker in ('S1', 'S2'))",
         "j as (select e.ticker, e.date, e.close, m.benchmark, m.base from e join m using (date))")
_BACK = ", ".join(f"(close / nullif(lag(close, {p}) over w, 0)) / nullif(base / nullif(lag(base, {p}) over w, 0), 0) as rs_{p}" for p in (5, 22, 66))
STRENGTHS = (*MARKS, f"s as (select ticker, benchmark, date, {_BACK} from j window w as (partition by ticker, benchmark order by date) qualify row_number() over (partition by ticker, benchmark order by date desc) = 1)")


def benchmarks(spark, sf_dir, dates):
    prices = source.filled(source.daily(spark, sf_dir), dates)
    own = prices.where("ticker in ('S1', 'S2')").select(F.col("ticker").alias("benchmark"), "date", "close")
    return prices, strength.market(prices).select(F.lit("ALL").alias("benchmark"), "date", "close").unionByName(own)


def strengths(spark, sf_dir):
    return strength.strength_against(*benchmarks(spark, sf_dir, 67), (5, 22, 66))


@Q.add("rs_benchmarks", on_bars(*STRENGTHS, select="select ticker, " + ", ".join(f"round(max(case when benchmark = '{b}' then rs_{p} end), 4) as rs_{p}_vs_{b}" for p in (5, 22, 66) for b in ("ALL", "S1", "S2")) + ", " + ", ".join(f"round(avg(rs_{p}), 4) as mean_rs_{p}" for p in (5, 22, 66)) + " from s group by ticker"))
def rs_benchmarks(spark, sf_dir):
    return shown(strength.side_by_side(strengths(spark, sf_dir), ["ALL", "S1", "S2"], ["rs_5", "rs_22", "rs_66"]))


@Q.add("rs_average_ratios", on_bars(*MARKS, "q as (select *, close / nullif(base, 0) as ratio from j)", "r as (select ticker, benchmark, date, ratio, avg(ratio) over v as mean, count(ratio) over v as n from q window v as (partition by ticker, benchmark order by date rows between 19 preceding and current row) qualify row_number() over (partition by ticker, benchmark order by date desc) = 1)", select="select ticker, benchmark, date, round(case when n >= 20 then (ratio - mean) / nullif(mean, 0) * 100 end, 4) as mr_20 from r"))
def rs_average_ratios(spark, sf_dir):
    return shown(strength.average_ratio(*benchmarks(spark, sf_dir, 20), (20,)))


MAPPING = "ALL:ASIA;ALL:EUROPE;S1:ASIA;broken"


@Q.add("per_benchmarks", on_bars(*STRENGTHS, "x as (select s.*, sector as universe from s join dim using (ticker) where (benchmark = 'ALL' and sector in ('ASIA', 'EUROPE')) or (benchmark = 'S1' and sector = 'ASIA'))",
    "y as (select *, rank() over (partition by benchmark, universe, rs_22 is null order by rs_22) as low, count(*) over (partition by benchmark, universe, rs_22) as ties, count(rs_22) over (partition by benchmark, universe) as n from x)",
    select="select ticker, benchmark, universe, round(rs_22, 4) as rs_22, case when rs_22 is not null then cast(round_even((low + (ties - 1) / 2.0)::double / n * 98 + 1, 0) as int) end as per_rs_22 from y", dim=True))
def per_benchmarks(spark, sf_dir):
    members = source.dimension(spark, sf_dir).select("ticker", F.col("sector").alias("universe"))
    ranked = strength.ranked_against(strengths(spark, sf_dir), members, strength.mappings(MAPPING), ["rs_22"])
    return shown(ranked, "ticker", "benchmark", "universe", "rs_22", "per_rs_22")


@Q.add("rs_condition", on_bars(*STRENGTHS, "a as (select ticker, rs_66 as composite, case when rs_5 > 1 then 1 else 0 end * 0.5 + case when rs_22 > 1 then 1 else 0 end * 0.5 as consistency, rs_22 from s where benchmark = 'ALL' and rs_66 is not null)",
    "b as (select *, cast(round_even((rank() over (partition by rs_22 is null order by rs_22) + (count(*) over (partition by rs_22) - 1) / 2.0)::double / count(rs_22) over () * 98 + 1, 0) as double) as p from a)",
    "c as (select count(*) as stocks, count(*) filter (composite > 1.05) as strong, count(*) filter (consistency > 0.6) as consistent, count(*) filter (p >= 80) as elite from b)",
    select="select *, round(strong * 100.0::double / stocks, 4) as strong_pct, round(consistent * 100.0::double / stocks, 4) as consistent_pct, round(elite * 100.0::double / stocks, 4) as elite_pct, case when strong * 100.0 / stocks > 50 and consistent * 100.0 / stocks > 30 then 'BROADLY_BULLISH' when strong * 100.0 / stocks > 30 and consistent * 100.0 / stocks > 20 then 'SELECTIVELY_BULLISH' when strong * 100.0 / stocks > 20 then 'MIXED_DEFENSIVE' else 'BEARISH_RISK_OFF' end as condition from c"))
def condition(spark, sf_dir):
    own = strengths(spark, sf_dir).where("benchmark = 'ALL' and rs_66 is not null")
    ranked = strength.percentiles(own, ["rs_22"])
    return shown(strength.market_condition(ranked.select(F.col("rs_66").alias("composite"), F.expr("case when rs_5 > 1 then 1 else 0 end * 0.5e0 + case when rs_22 > 1 then 1 else 0 end * 0.5e0").alias("consistency"), F.col("per_rs_22").alias("mean_percentile"))))


@Q.add("screen_green_levels", on_bars("n as (select *, row_number() over (partition by ticker order by date) - 1 as bar from bars)",
    "p as (select a.ticker, a.bar, a.date, a.high as level from n a join n b on a.ticker = b.ticker and b.bar between a.bar - 5 and a.bar + 5 and b.bar <> a.bar group by a.ticker, a.bar, a.date, a.high having count(*) = 10 and bool_and(case when b.bar < a.bar then b.high < a.high else b.high <= a.high end))",
    "q as (select p.* from p where level >= (select max(high) from n where n.ticker = p.ticker and n.bar between p.bar - 63 and p.bar))",
    "r as (select q.*, coalesce((select max(high) from n where n.ticker = q.ticker and n.bar between q.bar + 1 and q.bar + 9) <= level, true) as confirmed, (select min(bar) from n where n.ticker = q.ticker and n.bar >= q.bar + 10 and n.close > q.level) as broken from q)",
    select="select r.ticker, r.bar + 1 as bar, r.date, round(level, 3) as level, confirmed::int as confirmed, broken + 1 as breakout_bar, n.date as breakout_date from r left join n on n.ticker = r.ticker and n.bar = r.broken"))
def green_levels(spark, sf_dir):
    out = screeners.green_line_levels(source.daily(spark, sf_dir), 5, 63, 10)
    return shown(out.withColumns({c: F.col(c).cast("long") for c in ("bar", "breakout_bar")}), "ticker", "bar", "date", "level", "confirmed", "breakout_bar", "breakout_date", digits=3)


MONTHS = "mm as (select ticker, cast(date_trunc('month', date) as date) as date, max_by(close, date) as close from bars group by all)"


@Q.add("screen_cascade_performance", on_bars(MONTHS, "g as (select *, close / nullif(lag(close, 12) over w, 0) - 1 as a, close / nullif(lag(close, 6) over w, 0) - 1 as b, close / nullif(lag(close, 3) over w, 0) - 1 as c, lead(close) over w / nullif(close, 0) - 1 as after from mm " + W + ")",
    "x as (select * from g where a is not null qualify count(*) over (partition by date) >= 10)", "t1 as (select * from x qualify row_number() over (partition by date order by a desc, ticker) <= 50)", "t2 as (select * from t1 qualify row_number() over (partition by date order by b desc, ticker) <= 30)", "t3 as (select * from t2 qualify row_number() over (partition by date order by c desc, ticker) <= 10)",
    select="select date as month, string_agg(ticker, ',' order by ticker) as tickers, round(1 + coalesce(avg(after), 0), 4) as performance from t3 group by date"))
def cascade_performance(spark, sf_dir):
    return shown(screeners.cascade_performance(source.rolled_up(source.daily(spark, sf_dir), "monthly").select("ticker", "date", "close")))


@Q.add("screen_weighted_leaders", on_bars(*STRENGTHS[:-1], "s as (select ticker, (close / nullif(lag(close) over w, 0)) / nullif(base / nullif(lag(base) over w, 0), 0) as d, (close / nullif(lag(close, 5) over w, 0)) / nullif(base / nullif(lag(base, 5) over w, 0), 0) as k, (close / nullif(lag(close, 22) over w, 0)) / nullif(base / nullif(lag(base, 22) over w, 0), 0) as m, date from j where benchmark = 'ALL' window w as (partition by ticker order by date) qualify row_number() over (partition by ticker order by date desc) = 1)",
    "o as (select ticker, industry, (coalesce(d, 0) + coalesce(k * 2, 0) + coalesce(m * 4, 0)) / nullif((d is not null)::int + (k is not null)::int * 2 + (m is not null)::int * 4, 0) as strength from s join dim using (ticker))",
    "i as (select industry, avg(strength) as industry_strength from o where strength is not null group by industry having count(*) >= 3)", "p as (select *, row_number() over (order by industry_strength desc, industry) as industry_place, greatest(1, floor(count(*) over () * 0.2)) as top from i)",
    dim=True, select="select ticker, industry, round(strength, 4) as strength, round(industry_strength, 4) as industry_strength, industry_place, row_number() over (partition by industry order by strength desc, ticker) as place from o join p using (industry) where industry_place <= top and strength is not null qualify place <= 4"))
def weighted_leaders(spark, sf_dir):
    periods = (1, 5, 22)
    prices = source.filled(source.daily(spark, sf_dir), max(periods) + 1)
    return shown(screeners.leaders(strength.relative_strength(prices, strength.market(prices), periods), source.dimension(spark, sf_dir)))


@Q.add("screen_range_rank", on_bars("t as (select *, greatest(high - low, coalesce(abs(high - lag(close) over w), 0), coalesce(abs(low - lag(close) over w), 0)) as tr from bars " + W + ")", "a as (select ticker, date, case when count(tr) over v >= 14 then avg(tr) over v end as atr from t window v as (partition by ticker order by date rows between 13 preceding and current row) qualify row_number() over (partition by ticker order by date desc) = 1)",
    select="select ticker, date, round(atr, 3) as atr, round(case when atr is not null then (rank() over (partition by atr is null order by atr) + (count(*) over (partition by atr) - 1) / 2.0)::double / count(atr) over () * 100 end, 3) as atr_rank from a"))
def range_rank(spark, sf_dir):
    return shown(screeners.range_rank(source.daily(spark, sf_dir)), digits=3)


@Q.add("screen_adl_strength", on_bars("n as (select *, row_number() over w as bar, round(sum(coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume) over (partition by ticker order by date rows unbounded preceding), 6) as line from bars " + W + ")",
    "c as (select *, round(line - lag(line, 20) over w, 6) as x, round(close - lag(close, 20) over w, 6) as y from n " + W + ")",
    select="select ticker, date, round(case when x is null or y is null then 50 when (x > 0 and y > 0) or (x < 0 and y < 0) then 50 + least(abs(x), abs(y)) / greatest(abs(x), abs(y), 1) * 50 else 50 - abs(x - y) / (abs(x) + abs(y) + 1) * 50 end, 3) as strength from c"))
def adl_strength(spark, sf_dir):
    return shown(layered(source.daily(spark, sf_dir), (*adl.LINE, *adl.strength_layers())), "ticker", "date", "strength", digits=3)


@Q.add("options_signals", f"with {portfolio_queries.CHAIN}, net as (select ticker, sum(gex) as g from lev group by ticker), key as (select * from lev where level <> 'none' qualify row_number() over (partition by ticker order by abs(gex) desc, strike) = 1) select ticker, 'regime' as type, case when g > 0 then 'MEAN_REVERSION_SETUP' else 'MOMENTUM_BREAKOUT' end as signal, case when g > 0 then 0.75::double else 0.8::double end as confidence, null::double as strike from net where g <> 0 union all select ticker, 'level', case when gex > 0 then 'SUPPORT_TEST' else 'RESISTANCE_TEST' end, case when level = 'extreme' then 0.8::double else 0.5::double end, strike from key where abs(strike / spot - 1) * 100 <= 2")
def option_signals(spark, sf_dir):
    return options.signals(options.exposure(portfolio_queries.clean_chain(spark, sf_dir)))


#: Variant, least score, and from where on a score is strong and leading.
SCORES = (("st", 40, 70, 90), ("fast", 40, 65, 85))
_TIER = "case when {0}.scooter >= {2} then 'leader' when {0}.scooter >= {1} then 'strong' else 'average' end as {0}_tier"


@Q.add("scooter_screens", f"select st.ticker, st.scooter as st, fast.scooter as fast, {_TIER.format('st', 70, 90)}, {_TIER.format('fast', 65, 85)}, round((st.scooter + fast.scooter) / 2, 3) as mean_score from ({basic_queries._scooter_sql('st')}) st join ({basic_queries._scooter_sql('fast')}) fast using (ticker) where st.scooter >= 40 and fast.scooter >= 40")
def scooter_screens(spark, sf_dir):
    bars = source.daily(spark, sf_dir)
    rounded = lambda v: F.floor(F.col("scooter") * 1e4 + 0.5) / 1e4
    slow, fast = (screeners.scored(source.latest(basics.scooter(bars, v)).withColumn(v, rounded(v)), v, least, strong, top, price=0.0) for v, least, strong, top in SCORES)
    both = screeners.scored_twice(slow, fast, ("st", "fast"))
    return both.select("ticker", "st", "fast", "st_tier", "fast_tier", (F.floor(F.col("mean_score") * 1e3 + 0.5) / 1e3).alias("mean_score"))


@Q.add("movers_summary", on_bars("a as (select sector, ticker, (close / nullif(lag(close) over (partition by ticker order by date), 0) - 1) * 100 as c, date from bars join dim using (ticker))", "l as (select * from a qualify row_number() over (partition by ticker order by date desc) = 1)", dim=True,
    select='select sector, count(c) as "rows", round(avg(c), 4) as mean, round(median(c), 4) as median, round(stddev_samp(c), 4) as sd, round(min(c), 4) as least, round(max(c), 4) as greatest, round(quantile_cont(c, 0.25), 4) as quartile_1, round(quantile_cont(c, 0.75), 4) as quartile_3 from l group by sector'))
def movers_summary(spark, sf_dir):
    bars = source.daily(spark, sf_dir).withColumn("c", F.expr("(close / nullif(lag(close) over (partition by ticker order by date), 0) - 1) * 100"))
    return shown(backtest.summary(source.latest(bars).join(source.dimension(spark, sf_dir), "ticker"), "c", "sector"))


@Q.add("universe_flags", on_bars(dim=True, select="select ticker, 'big' as universe from dim where market_cap >= 1e11 union all select ticker, 'nyse' from dim where exchange = 'NYSE' union all select ticker, 'rating_' || case when market_cap >= 1e11 then 'StrongBuy' else 'Hold' end from dim"))
def universe_flags(spark, sf_dir):
    table = source.dimension(spark, sf_dir).withColumns({"big": F.col("market_cap") >= 1e11, "nyse": F.col("exchange") == "NYSE", "rating": F.when(F.col("market_cap") >= 1e11, "Strong Buy").otherwise("Hold")})
    return universes.of_flags(table, ["big", "nyse"]).unionByName(universes.rated(table))


@Q.add("universe_choices", on_bars(dim=True, select="select ticker, exchange from dim where sector in ('ASIA', 'AFRICA')"))
def universe_choices(spark, sf_dir):
    table = source.dimension(spark, sf_dir)
    members = table.select("ticker", F.col("sector").alias("universe"))
    both = universes.chosen(table, "1-2", {1: "ASIA", 2: "AFRICA"}, members).select("ticker", "exchange")
    return universes.together(both, both.where("exchange = 'NYSE'"), universes.chosen(table, "2", {2: "AFRICA"}, members).select("ticker", "exchange"))


@Q.add("breadth_tornado", on_bars(*BREADTH[:1], "a as (select date, count(*) filter (close > before) as up, count(*) filter (close < before) as down from p group by date order by date desc limit 10)", "u as (select date, 'advancing' as \"column\", up::double as value from a union all select date, 'declining', down::double from a)", select='select date, "column", round(value, 4) as value from u'))
def breadth_tornado(spark, sf_dir):
    out = breadth.counts(source.daily(spark, sf_dir)).orderBy(F.col("date").desc()).limit(10)  # the last ten days are the report
    return shown(out.select("date", F.expr("stack(2, 'advancing', cast(advancing as double), 'declining', cast(declining as double)) as (`column`, value)")))


@Q.add("backtest_tests")
def backtest_tests(spark, sf_dir):
    trades = backtest.simulated(portfolio_queries.dot_signals(spark, sf_dir))
    own = backtest.t_test(trades).join(backtest.contributions(trades).drop("trades"), "strategy")
    return shown(own.crossJoin(F.broadcast(backtest.variance_test(trades).select("f", F.col("p").alias("f_p")))))

