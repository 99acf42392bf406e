"""Relative strength against a benchmark, percentiles within universes, and composites of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import change, rank_share, sma
from ..sources.bars import filled, last_rows, latest

#: Bars of the analysis periods, by timeframe.
PERIODS = {"daily": (1, 3, 5, 7, 14, 22, 44, 66, 132, 252), "weekly": (1, 3, 5, 10, 15), "monthly": (1, 3, 6)}
#: Fewest tickers that make a composite; weight of a ticker without a market cap.
LEAST_GROUP, NO_CAP = 2, 1.0


def market(prices: DataFrame) -> DataFrame:
    """date and close of an equally weighted benchmark over filled prices."""
    return prices.groupBy("date").agg(F.avg("close").alias("close"))


def relative_strength(prices: DataFrame, benchmark: DataFrame, periods: Sequence[int]) -> DataFrame:
    """ticker, date and rs_{p}: (1 + return) / (1 + the benchmark's return) over p dates, on the last date that both have.

    prices: ticker, date, close, filled; benchmark: date, close. Only dates of both count.
    """
    both = prices.join(benchmark.select("date", F.col("close").alias("base")), "date")
    both = both.withColumns({f"rs_{p}": F.expr(f"(1 + {change('close', p)}) / nullif(1 + {change('base', p)}, 0)") for p in periods})
    return latest(both).select("ticker", "date", *(f"rs_{p}" for p in periods))


def average_strength(bars: DataFrame, periods: Sequence[int] = (20, 50)) -> DataFrame:
    """ticker, date and ma_{p}: the close against its average in percent."""
    out = last_rows(bars, max(periods)).withColumns({f"ma_{p}": F.expr(f"(close - {sma('close', p)}) / nullif({sma('close', p)}, 0) * 100") for p in periods})
    return latest(out).select("ticker", "date", *(f"ma_{p}" for p in periods))


def percentiles(values: DataFrame, columns: Sequence[str], scale: str = "ibd", ties: str = "average", within: str | None = None) -> DataFrame:
    """values with per_{column}: ranks within a universe as 1 to 99 (ibd), 0 to 100 (standard) or 0 to 99.9 to one digit (fine); null stays null."""
    made = {}
    for c in columns:
        share = rank_share(c, ties, within)
        text = {"ibd": f"cast(bround({share} * 98 + 1) as int)", "standard": f"cast(bround({share} * 100) as int)", "fine": f"floor(least({share} * 100e0, 99.9e0) * 1e1 + 0.5e0) / 1e1"}[scale]
        made[f"per_{c}"] = F.expr(text)
    return values.withColumns(made)


def percentiles_by_universe(values: DataFrame, members: DataFrame, columns: Sequence[str], **settings) -> DataFrame:
    """Percentiles of each ticker in each of its universes (members: ticker, universe)."""
    return percentiles(values.join(members.select("ticker", "universe").distinct(), "ticker"), columns, within="universe", **settings)


def first_of(by_universe: DataFrame, order: Sequence[str], column: str) -> DataFrame:
    """ticker and the value in the first universe of order that has one."""
    cases = [F.max(F.when(F.col("universe") == u, F.col(column))) for u in order]
    return by_universe.groupBy("ticker").agg(F.coalesce(*cases).alias(column))


def weighted_rating(values: DataFrame, weights: Mapping[str, float], name: str = "rating") -> DataFrame:
    """values with the weighted mean of those columns that aren't null."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return values.withColumn(name, F.try_divide(total, weight))


def composites(prices: DataFrame, dimension: DataFrame, by: str = "sector", weighted: bool = False) -> DataFrame:
    """ticker (the group's name), date and close: the group's mean price by date, equally or by market cap, for groups of two tickers or more."""
    group = dimension.select("ticker", F.col(by).alias("grp"), F.coalesce(F.when(F.col("market_cap") > 0, F.col("market_cap")), F.lit(NO_CAP)).alias("weight")).where("grp is not null")
    rows = prices.join(group, "ticker").where("close is not null")
    sizes = rows.groupBy("grp").agg(F.count_distinct("ticker").alias("n")).where(F.col("n") >= LEAST_GROUP)
    price = F.sum(F.col("close") * F.col("weight")) / F.sum("weight") if weighted else F.avg("close")
    return rows.join(sizes, "grp", "left_semi").groupBy(F.col("grp").alias("ticker"), "date").agg(price.alias("close"))


def strength_of_groups(bars: DataFrame, dimension: DataFrame, periods: Sequence[int], by: str = "sector", weighted: bool = False) -> DataFrame:
    prices = filled(bars, max(periods) + 1)
    return relative_strength(composites(prices, dimension, by, weighted), market(prices), periods)


def mappings(text: str) -> dict[str, list[str]]:
    """"A:X;B:Y;A:Z" as the universes in which each benchmark's strengths are ranked: {A: [X, Z], B: [Y]}; entries without a colon are dropped."""
    found: dict[str, list[str]] = {}
    for entry in text.split(";"):
        benchmark, colon, universe = (x.strip() for x in entry.partition(":"))
        if colon and benchmark and universe and universe not in found.setdefault(benchmark, []):
            found[benchmark].append(universe)
    return found


def strength_against(prices: DataFrame, benchmarks: DataFrame, periods: Sequence[int]) -> DataFrame:
    """ticker, benchmark, date and rs_{p}, in long form. benchmarks: benchmark, date, close; dates of both count, by benchmark."""
    both = prices.join(benchmarks.select("benchmark", "date", F.col("close").alias("base")), "date")
    by = "partition by ticker, benchmark order by date"
    both = both.withColumns({f"rs_{p}": F.expr(f"(1 + {change('close', p, by)}) / nullif(1 + {change('base', p, by)}, 0)") for p in periods})
    last = both.groupBy("ticker", "benchmark").agg(F.max_by(F.struct("date", *(f"rs_{p}" for p in periods)), "date").alias("r"))
    return last.select("ticker", "benchmark", "r.*")


def average_ratio(prices: DataFrame, benchmarks: DataFrame, periods: Sequence[int] = (20, 50)) -> DataFrame:
    """ticker, benchmark, date and mr_{p}: how far the price in units of the benchmark stands from its average, in percent."""
    both = prices.join(benchmarks.select("benchmark", "date", F.col("close").alias("base")), "date").withColumn("ratio", F.try_divide("close", "base"))
    by = "partition by ticker, benchmark order by date"
    both = both.withColumns({f"mr_{p}": F.expr(f"(ratio - {sma('ratio', p, by=by)}) / nullif({sma('ratio', p, by=by)}, 0) * 100") for p in periods})
    last = both.groupBy("ticker", "benchmark").agg(F.max_by(F.struct("date", *(f"mr_{p}" for p in periods)), "date").alias("r"))
    return last.select("ticker", "benchmark", "r.*")


def ranked_against(strengths: DataFrame, members: DataFrame, universes: Mapping[str, Sequence[str]], columns: Sequence[str], **settings) -> DataFrame:
    """strengths with universe and per_{column}: each benchmark's strengths ranked within the universes that universes gives it."""
    pairs = F.array(*(F.struct(F.lit(b).alias("benchmark"), F.lit(u).alias("universe")) for b, us in universes.items() for u in us))
    wanted = strengths.sparkSession.range(1).select(F.explode(pairs).alias("p")).select("p.*")
    own = strengths.join(F.broadcast(wanted), "benchmark").join(members.select("ticker", "universe").distinct(), ["ticker", "universe"])
    return percentiles(own, columns, within="benchmark, universe", **settings)


def side_by_side(strengths: DataFrame, benchmarks: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A row a ticker: {column}_vs_{benchmark} of each, null where a benchmark lacks the ticker, and mean_{column} over the benchmarks that have it."""
    made = [F.max(F.when(F.col("benchmark") == b, F.col(c))).alias(f"{c}_vs_{b}") for c in columns for b in benchmarks]
    return strengths.where(F.col("benchmark").isin(*benchmarks)).groupBy("ticker").agg(*made, *(F.avg(c).alias(f"mean_{c}") for c in columns))


def market_condition(stocks: DataFrame, strong: float = 1.05, consistent: float = 0.6, elite: float = 80.0) -> DataFrame:
    """One row: how many stocks are strong, consistent and elite, their shares in percent, and the condition of the market.

    stocks: composite (strength), consistency (0 to 1) and mean_percentile. No stocks: UNKNOWN.
    """
    out = stocks.agg(F.count("*").alias("stocks"), F.count_if(F.col("composite") > strong).alias("strong"), F.count_if(F.col("consistency") > consistent).alias("consistent"), F.count_if(F.col("mean_percentile") >= elite).alias("elite"))
    out = out.withColumns({f"{c}_pct": F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("stocks")), F.lit(0.0)) for c in ("strong", "consistent", "elite")})
    condition = "case when stocks = 0 then 'UNKNOWN' when strong_pct > 50 and consistent_pct > 30 then 'BROADLY_BULLISH' when strong_pct > 30 and consistent_pct > 20 then 'SELECTIVELY_BULLISH' when strong_pct > 20 then 'MIXED_DEFENSIVE' else 'BEARISH_RISK_OFF' end"
    return out.withColumn("condition", F.expr(condition))


def performance(rs: DataFrame, short: tuple[str, str], middle: tuple[str, str], long: tuple[str, str]) -> DataFrame:
    """rs with momentum ratios of three horizons, the geometric mean of strengths, its quadrant and a class."""
    columns = [*short, *middle, *long]
    ratio = lambda pair: F.try_divide(F.col(pair[0]), F.col(pair[1]))
    logs = [F.when(F.col(c) > 0, F.log(c)) for c in columns]
    n = sum((x.isNotNull().cast("int") for x in logs), F.lit(0))
    total = sum((F.coalesce(x, F.lit(0.0)) for x in logs), F.lit(0.0))
    out = rs.withColumns({"short_momentum": ratio(short), "middle_momentum": ratio(middle), "long_momentum": ratio(long), "composite": F.when(n > 0, F.exp(total / n)).otherwise(1.0)})
    quadrant = "case when composite > 1 and short_momentum > 1 then 'leading' when composite > 1 then 'weakening' when short_momentum > 1 then 'improving' else 'lagging' end"
    kind = "case when composite >= 1.2 then 'elite' when composite >= 1.05 then 'strong' when composite >= 0.95 then 'average' else 'weak' end"
    return out.withColumns({"quadrant": F.expr(quadrant), "class": F.expr(kind)})
