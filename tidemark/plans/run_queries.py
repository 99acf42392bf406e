"""Queries on what goes on between runs and between files: states, commits, as-of joins, correlations, ranks, programs, masters, tiers, dashboards.

The SQL is written by hand from the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import change
from ..operators import asof, breadth, correlation, dashboards, masters, options, programs, pulse, ranks, volume
from ..operators.screens import screened
from ..sources import bars as source
from ..sources import commits, settings, tiers, transforms
from ..streaming import state
from . import breadth_queries, derived_queries, market_queries, portfolio_queries
from .common import Queries, shown
from .sql import ewm, ewm_adjusted, on_bars, wilder

Q = Queries()
W = "window w as (partition by ticker order by date)"
LATE = "year(date) = 1997 and month(date) = 6"

RUNNING = (
    f"r as (select *, lag(close) over w as before, row_number() over w as bar, max(high) over w as top from bars {W})",
    "t as (select *, greatest(high - low, abs(high - before), abs(low - before)) as range, coalesce(sign(close - before) * volume, 0) as flow from r)",
    f"s as (select *, {ewm('close', 12)} as ema_fast, {ewm('close', 26)} as ema_slow, {ewm_adjusted('close', 12)} as ema_fast_adjusted, {wilder('range', 14)} as atr, "
    "sum(flow) over (partition by ticker order by date rows unbounded preceding) as on_balance from t)",
    "u as (select *, ema_fast - ema_slow as macd from s)",
    f"v as (select *, {ewm('macd', 9)} as signal from u)",
)
RUNNING_SHOWN = ("close", "top", "on_balance", "ema_fast", "ema_slow", "ema_fast_adjusted", "signal", "atr")


@Q.add("running_rows", on_bars(*RUNNING, select="select ticker, date, bar, " + ", ".join(f"round({c}, 3) as {c}" for c in RUNNING_SHOWN) + " from v"))
def running_rows(spark, sf_dir):
    """Series folded on in four batches by year; a month's bars come late, in a fifth one."""
    bars, path, plan = source.daily(spark, sf_dir), commits.shared_folder(spark), state.daily_plan()
    edges = ("1900-01-01", "1996-07-01", "1998-01-01", "1999-07-01", "2100-01-01")
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        state.add(path, plan, bars.where(f"date >= '{low}' and date < '{high}' and not ({LATE})"), k)
    state.add(path, plan, bars.where(LATE), len(edges))
    columns = ["ticker", "date", "bar", *RUNNING_SHOWN]
    return shown(state.results(spark, path, columns), *columns, digits=3)


@Q.add("commits_widened", on_bars("m as (select cast(date_trunc('month', date) as date) as month, count(*) as bars, sum(volume) as volume from bars group by all)",
    select="select month, bars, case when month >= date '1998-01-01' then round(volume, 4) end as volume from m"))
def commits_widened(spark, sf_dir):
    """Months appended in two batches, the second with a further column, each tried twice."""
    months, path = source.daily(spark, sf_dir).groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")), commits.shared_folder(spark)
    early = F.col("month") < F.lit("1998-01-01").cast("date")
    for _ in range(2):
        commits.append(months.where(early).drop("volume"), path, 0)
        commits.append(months.where(~early), path, 1)
    commits.compacted(spark, path)
    return shown(commits.read(spark, path), "month", "bars", "volume")


WEEKS = "k as (select ticker, max(date) as date, max_by(close, date) as week_close from bars group by ticker, date_trunc('week', date))"


@Q.add("asof_weeks", on_bars(WEEKS, select="select x.ticker, x.date, round(x.close, 4) as close, round(k.week_close, 4) as week_close from bars x asof left join k on k.ticker = x.ticker and k.date < x.date"))
def asof_weeks(spark, sf_dir):
    """Every bar with its ticker's last weekly close before it."""
    bars = source.daily(spark, sf_dir)
    weeks = bars.groupBy("ticker", F.date_trunc("week", "date").alias("week")).agg(F.max("date").alias("date"), F.max_by("close", "date").alias("week_close"))
    return shown(asof.as_of(bars.select("ticker", "date", "close"), weeks, ["week_close"], ["ticker"], exact=False))


@Q.add("asof_market", on_bars(f"p as (select *, lag(close) over w as before from bars {W})", "a as (select date, count(*) filter (close > before) - count(*) filter (close < before) as net from p where month(date) % 3 = 1 group by date)",
    "m as (select ticker, last_day(date) as date, sum(volume) as volume from bars group by all)",
    select="select m.ticker, m.date, round(m.volume, 4) as volume, a.net from m asof left join a on a.date <= m.date"))
def asof_market(spark, sf_dir):
    """Every ticker's months with the market's last row in the first month of a quarter: no key, all tickers."""
    bars = source.daily(spark, sf_dir)
    moved = bars.withColumn("move", F.expr(change("close"))).where("month(date) % 3 = 1").groupBy("date").agg((F.count_if(F.col("move") > 0) - F.count_if(F.col("move") < 0)).alias("net"))
    months = bars.groupBy("ticker", F.last_day("date").alias("date")).agg(F.sum("volume").alias("volume"))
    return shown(asof.as_of(months, moved, ["net"]))


RETURNS = f"r as (select ticker, date, close / nullif(lag(close) over w, 0) - 1 as ret from bars {W})"
PAIRS = (RETURNS, "c as (select x.ticker as a, y.ticker as b, count(*) as n, corr(x.ret, y.ret) as correlation from r x join r y on x.date = y.date and x.ticker < y.ticker where x.ret is not null and y.ret is not null group by x.ticker, y.ticker having count(*) >= 20)")


@Q.add("correlation_pairs", on_bars(*PAIRS, select="select a, b, n, round(correlation, 4) as correlation from c"))
def correlation_pairs(spark, sf_dir):
    return shown(correlation.correlations(source.daily(spark, sf_dir)))


@Q.add("correlation_model", on_bars(*PAIRS, "q as (select * from c where correlation is not null)", "t as (select ticker, max(date) as last from r where ret is not null group by ticker having count(*) >= 20)",
    select="""select (select max(last) from t) as analysis_date, (select count(*) from t) as assets, count(*) as pairs, round(max(correlation), 4) as highest_correlation,
      (select a || '-' || b from q order by correlation desc, a, b limit 1) as highest_pair, round(min(correlation), 4) as lowest_correlation,
      (select a || '-' || b from q order by correlation, a, b limit 1) as lowest_pair, round(avg(correlation), 4) as mean_correlation, round(1 - abs(avg(correlation)), 4) as diversification from q"""))  # fmt: skip
def correlation_model(spark, sf_dir):
    return shown(correlation.model(source.daily(spark, sf_dir)))


@Q.add("ranks_moves", on_bars(RETURNS, "v as (select * from r where ret is not null)",
    select="""select ticker, date, round(rank() over (order by ret) + (count(*) over (partition by ret) - 1) / 2.0, 1) as rank, count(*) over () as rank_of,
      cast(rank() over (partition by date order by ret) as double) as place, cast(round_even((rank() over (partition by ticker order by ret) + (count(*) over (partition by ticker, ret) - 1) / 2.0) / count(*) over (partition by ticker) * 98 + 1, 0) as int) as own from v"""))  # fmt: skip
def ranks_moves(spark, sf_dir):
    """Each move's rank among all moves of all tickers, its place on its date, and its percentile in its ticker's history."""
    moves = source.daily(spark, sf_dir).select("ticker", "date", F.expr(change("close")).alias("ret")).where("ret is not null")
    out = ranks.with_ranks(moves, [ranks.Rank("rank", "ret"), ranks.Rank("place", "ret", ["date"], "least"), ranks.Rank("in_own", "ret", ["ticker"])])
    return shown(out.withColumn("own", ranks.scaled(F.col("in_own"), F.col("in_own_of"))), "ticker", "date", "rank", "rank_of", "place", "own")


PROGRAM = [
    ("# file, id, ...", None, None, None, None, None, None, None, None, None),
    ("latest", "1", "TRUE", "1", "filter", "sector", "equals", "ASIA", "OR", "regions"), ("latest", "1", "TRUE", "2", "filter", "sector", "equals", "EUROPE", "OR", None),
    ("latest", "1", "TRUE", "3", "filter", "close", "greater_than", "1200", "AND", None), ("latest", "1", "TRUE", "4", "sort", "close", "desc", None, None, None),
    ("regions", "2", None, "1", "filter", "exchange", "equals", "NYSE", None, "listed"), ("latest", "3", "FALSE", "1", "filter", "close", "greater_than", "0", None, "off"),
    ("latest", "4", "TRUE", "1", "filter", "market_cap", "between", "1e10,2e11", None, None), ("latest", "5", "TRUE", "1", "filter", "absent", "equals", "1", None, "broken"),
    ("latest", "6", "TRUE", "1", "filter", "close", "less_equal", "1500", None, "both"), ("months", "6", "TRUE", "1", "filter", "months", "greater_equal", "60", None, None),
]
STEPS = "Filename string, File_id string, Generation string, Step string, Action string, Column string, Condition string, Value string, Logic string, Output_id string"


@Q.add("filter_programs", on_bars(
    "l as (select ticker, date, close, market_cap, sector, exchange from bars join dim using (ticker) qualify row_number() over (partition by ticker order by date desc) = 1)",
    "m as (select ticker, count(distinct date_trunc('month', date)) as months from bars group by ticker)", "g as (select * from l where sector in ('ASIA', 'EUROPE') and close > 1200)",
    "o as (select 'regions' as output, ticker, close, null::bigint as months from g union all select 'listed', ticker, close, null from g where exchange = 'NYSE' "
    "union all select 'latest_f4', ticker, close, null from l where market_cap between 1e10 and 2e11 union all select 'both', l.ticker, close, months from l join m using (ticker) where close <= 1500 and months >= 60)",
    dim=True, select="select output, ticker, round(close, 4) as close, months from o"))
def filter_programs(spark, sf_dir):
    """A program of six outputs: one reads another, one is switched off, one fails, one merges two files."""
    bars = source.daily(spark, sf_dir)
    sources = {
        "latest": lambda: source.latest(bars).join(source.dimension(spark, sf_dir), "ticker").select("ticker", "date", "close", "market_cap", "sector", "exchange"),
        "months": lambda: bars.groupBy("ticker").agg(F.count_distinct(F.date_trunc("month", "date")).alias("months")),
    }
    made = programs.run(spark, programs.read(spark.createDataFrame(PROGRAM, STEPS)), sources)
    return shown(programs.listed(made, ["ticker", "close", "months"]))


FRAMES = {"daily": (5, 22), "weekly": (5, 10)}
CHANGES = "k as (select ticker, cast(date_trunc('week', date) as date) as date, max_by(close, date) as close from bars group by all)"


def _back(name: str, table: str, periods: tuple[int, ...], letter: str) -> str:
    made = ", ".join(f"round((close / nullif(lag(close, {p}) over w, 0) - 1) * 100, 3) as change_{p}{letter}" for p in periods)
    return f"{name} as (select ticker, {made} from {table} {W} qualify row_number() over (partition by ticker order by date desc) = 1)"


@Q.add("master_table", on_bars(CHANGES, _back("d", "bars", FRAMES["daily"], "d"), _back("e", "k", FRAMES["weekly"], "w"), select="select * from d full join e using (ticker)"))
def master_table(spark, sf_dir):
    """Changes over periods of daily and weekly bars, written as a file for each period and put side by side again."""
    bars, top = source.daily(spark, sf_dir), commits.shared_folder(spark)
    for timeframe, periods in FRAMES.items():
        rows = bars if timeframe == "daily" else source.rolled_up(bars, timeframe)
        for p in periods:
            last = source.latest(rows.withColumn(f"change_{p}", F.expr(f"{change('close', p)} * 100")))
            shown(last, "ticker", f"change_{p}", digits=3).write.option("header", True).csv(f"{top}/rs_stocks_{timeframe}_{p}period_20240101.csv")
    names = [f"{top}/rs_stocks_{t}_{p}period_20240101.csv" for t, ps in FRAMES.items() for p in ps]
    return masters.master(spark, masters.period_files(names))


@Q.add("bars_tiers", on_bars(select="select ticker, date, round(open, 4) as open, round(high, 4) as high, round(low, 4) as low, round(close, 4) as close, "
    "round(volume + case when date >= date '1998-07-01' then 1 else 0 end, 4) as volume from bars where isodow(date) < 6"))  # fmt: skip
def bars_tiers(spark, sf_dir):
    """Bars written as a file a ticker in two tiers that overlap, and read by the data source: the current tier's rows win."""
    bars, top = source.daily(spark, sf_dir), commits.shared_folder(spark)
    transforms.canonical_files(bars.where("date < '1999-01-01'"), f"{top}/archive").count()
    transforms.canonical_files(bars.where("date >= '1998-07-01'").withColumn("volume", F.col("volume") + 1), f"{top}/current").count()
    return shown(tiers.tiered(spark, top))


@Q.add("bars_transformed", on_bars(select="select ticker, case when date < date '1998-01-01' then 'early' else 'daily' end as timeframe, date, round(close, 4) as close, volume from bars"))
def bars_transformed(spark, sf_dir):
    """Bars written as a file a ticker, and read from two folders by rules on their names."""
    bars, top = source.daily(spark, sf_dir), commits.shared_folder(spark)
    transforms.canonical_files(bars.where("date < '1998-01-01'"), f"{top}/a").count()
    transforms.canonical_files(bars.where("date >= '1998-01-01'"), f"{top}/b").count()
    table = transforms.files(spark, transforms.rules([f"TRUE,{top}/a,S*,plain,early", f"TRUE,{top}/b,*,plain,daily"]))
    return shown(transforms.transformed(table), "ticker", "timeframe", "date", "close", "volume")


SUMS = (f"p as (select *, (close / nullif(lag(close) over w, 0) - 1) * 100 as move, case when count(close) over r >= 20 then avg(close) over r end as mean from bars window w as (partition by ticker order by date), r as (partition by ticker order by date rows between 19 preceding and current row))",
    "x as (select p.*, case when move is not null then greatest(market_cap, 0) end as cap, sector, industry, exchange from p join dim using (ticker))",
    "g as (select 'all' as kind, 'all' as name, * from x union all select 'sector', sector, * from x union all select 'industry', industry, * from x union all select 'exchange', exchange, * from x)")


@Q.add("dashboard_overview", on_bars(*SUMS, dim=True, select="""select date, kind, name, count(*) as tickers, count(*) filter (move > 0) as advances, count(*) filter (move < 0) as declines,
      round(count(*) filter (move > 0)::double / nullif(count(*) filter (move < 0), 0), 4) as ratio, round(count(*) filter (close > mean) * 100.0::double / count(*), 4) as above_pct,
      round(coalesce(sum(move), 0)::double / count(*), 4) as change, round(coalesce(sum(cap * move), 0) / nullif(sum(cap), 0), 4) as cap_change, round(sum(volume), 4) as volume from g group by date, kind, name"""))
def dashboard_overview(spark, sf_dir):
    """Sums of two halves of the tickers, committed as two batches, added up."""
    bars, dimension, path = source.daily(spark, sf_dir), source.dimension(spark, sf_dir), commits.shared_folder(spark)
    half = F.pmod(F.xxhash64("ticker"), F.lit(2))
    for k in range(2):
        commits.append(dashboards.daily_sums(bars.where(half == k), dimension), path, k)
    return shown(dashboards.overview(dashboards.added(commits.read(spark, path).drop("batch"))))


SECTORS = "i as (select sector as ticker, date, avg(close) as close from bars join dim using (ticker) group by all)"


@Q.add("dashboard_sectors", on_bars(SECTORS, "j as (select *, lag(close) over w as d, lag(close, 6) over w as k, lag(close, 29) over w as m, coalesce(case when count(*) over r = 20 then avg(close) over r end, close) as mean from i window w as (partition by ticker order by date), r as (partition by ticker order by date rows between 19 preceding and current row) qualify row_number() over (partition by ticker order by date desc) = 1)",
    dim=True, select="""select ticker, date, round(close, 4) as close, round((close / d - 1) * 100, 4) as day_pct, round(coalesce((close / k - 1) * 100, 0), 4) as week_pct, round(coalesce((close / m - 1) * 100, 0), 4) as month_pct,
      case when close > mean * 1.02 then 'DARK_GREEN' when close > mean then 'LIGHT_GREEN' when close > mean * 0.98 then 'YELLOW' else 'RED' end as trend, case when close > mean then 'above' else 'below' end as position from j where d is not null"""))  # fmt: skip
def dashboard_sectors(spark, sf_dir):
    series = source.daily(spark, sf_dir).join(source.dimension(spark, sf_dir), "ticker").groupBy(F.col("sector").alias("ticker"), "date").agg(F.avg("close").alias("close"))
    return shown(dashboards.performance(series))


def _means(column: str, name: str) -> str:
    return ", ".join(f"round(case when count({column}) over r{n} >= {n // 2} then avg({column}) over r{n} end, 4) as {name}_mean_{n}" for n in (5, 10, 20))


@Q.add("breadth_trends", f"""select universe, date, bullish_signals, bearish_signals, net_signals, {_means('bullish_signals', 'bullish')}, {_means('bearish_signals', 'bearish')}, {_means('net_signals', 'net')}, bullish_days, bearish_days,
      case when bullish_signals >= 3 and net_signals >= 2 then 'Strong Bullish' when bearish_signals >= 3 and net_signals <= -2 then 'Strong Bearish' when bullish_signals >= 2 and net_signals >= 1 then 'Moderate Bullish'
        when bearish_signals >= 2 and net_signals <= -1 then 'Moderate Bearish' when bullish_signals > 0 or bearish_signals > 0 then 'Weak Signal' else 'Neutral' end as trend
    from ({breadth_queries.Q.sql['breadth_signals']}) window """ + ", ".join(f"r{n} as (partition by universe order by date rows between {n - 1} preceding and current row)" for n in (5, 10, 20)))
def breadth_trends(spark, sf_dir):
    signals = breadth.breadth(source.daily(spark, sf_dir), breadth_queries.members(spark, sf_dir), many=breadth_queries.MANY)
    return shown(breadth.trends(signals))


@Q.add("screen_volume_surge", on_bars("m as (select *, case when count(volume) over a = 5 then avg(volume) over a end as mean_short, case when count(volume) over b = 20 then avg(volume) over b end as mean_long from bars "
    "window a as (partition by ticker order by date rows between 4 preceding and current row), b as (partition by ticker order by date rows between 19 preceding and current row))",
    select="select ticker, date, round(close, 4) as close, round(volume, 4) as volume, round(mean_short / nullif(mean_long, 0), 4) as relative from m where mean_short / nullif(mean_long, 0) > 1.3 and volume > 2 * mean_long"))
def volume_surge(spark, sf_dir):
    return shown(screened(source.daily(spark, sf_dir), volume.surge(lift=1.3, spike=2.0)), "ticker", "date", "close", "volume", "relative")


@Q.add("options_gamma", f"""with {portfolio_queries.CHAIN}, m as (select *, strike / spot as money from der)
    select ticker, strike, days, count(*) as quotes, round(sum(case when money between 0.95 and 1.05 then 0.05 when money between 0.9 and 1.1 then 0.03 else 0.01 end::double * open_interest), 4) as plain,
      round(sum(case when money between 0.95 and 1.05 then 0.05 when money between 0.9 and 1.1 then 0.03 when money between 0.85 and 1.15 then 0.02 else 0.01 end::double * greatest(0.1, days / 365.0::double) * open_interest), 4) as dated
    from m group by ticker, strike, days""")
def options_gamma(spark, sf_dir):
    """Open interest by strike and days left, weighed by two estimates of gamma."""
    chain = options.derived(portfolio_queries.option_chain(spark, sf_dir), "2000-01-01")
    weighed = lambda gamma: F.sum(gamma * F.col("open_interest"))
    return shown(chain.groupBy("ticker", "strike", "days").agg(F.count("*").alias("quotes"), weighed(options.plain_gamma()).alias("plain"), weighed(options.plain_gamma(F.col("days"))).alias("dated")))


def _named(sql: str, *columns: str) -> str:
    return f"select ticker, {', '.join(columns)} from ({sql})"


OVERVIEW = {
    "a": _named(market_queries.Q.sql["pulse_index_scores"], "date", "close", "score", "light"), "b": _named(derived_queries.Q.sql["pulse_requirements"], "score as requirements", "light as requirements_light"),
    "c": _named(market_queries.Q.sql["pulse_market_state"], "ftd", "dd", "state"),
    "d": f"select ticker, cycle, first as since, candles from ({market_queries.Q.sql['pulse_cycles']}) qualify row_number() over (partition by ticker order by last desc) = 1",
}


@Q.add("pulse_overview", f"select * from ({OVERVIEW['b']}) left join ({OVERVIEW['a']}) using (ticker) left join ({OVERVIEW['c']}) using (ticker) left join ({OVERVIEW['d']}) using (ticker)")
def pulse_overview(spark, sf_dir):
    """All parts of the market pulse of three indexes in a row each; the zone has its own query and is left out here."""
    bars = source.daily(spark, sf_dir).where(F.col("ticker").isin(*derived_queries.INDEXES))
    return shown(pulse.overview(bars, derived_queries.breadth_rows(spark, sf_dir), 250).drop("zone"))
