"""What strengths and their percentiles say about stocks and groups: patterns of momentum, consistency, classes, rotation, leaders and laggards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods that strengths are read over, and those that the three momentums compare.
PERIODS = (3, 5, 7, 14, 22, 44, 66, 132, 252)
HORIZONS = {"short": (3, 7), "middle": (14, 44), "long": (66, 252)}
#: Composite strengths from which a stock leads, and below which it lags.
LEADS, LAGS = 1.05, 0.95


def beside(ranks: DataFrame, methods: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """ranks with {column}_{method} of each method's table, and {column} from the first method that has it.

    All tables have a row a ticker. Tickers without ranks are left out, those without a strength keep nulls.
    """
    out = ranks
    for name, table in methods.items():
        out = out.join(table.select("ticker", *(F.col(c).alias(f"{c}_{name}") for c in columns)), "ticker", "left")
    return out.withColumns({c: F.coalesce(*(F.col(f"{c}_{m}") for m in methods)) for c in columns})


def measured(rows: DataFrame, prefix: str = "rs_", ranks: str = "per_rs_", periods: Sequence[int] = PERIODS, horizons: Mapping[str, tuple[int, int]] = HORIZONS) -> DataFrame:
    """rows with momentum_{horizon} in percent, pattern, momentum, composite, consistency (percent of periods above 1) and mean_percentile.

    A missing strength is 1, a missing percentile 50; strengths of 0 or less don't count for the composite, and over 0 a momentum is 0.
    """
    at = lambda p: F.coalesce(F.col(f"{prefix}{p}"), F.lit(1.0))
    n = len(periods)
    logs = [F.when(at(p) > 0, F.log(at(p))) for p in periods]
    positive = sum((x.isNotNull().cast("int") for x in logs), F.lit(0))
    out = rows.withColumns(
        {f"momentum_{h}": F.coalesce((F.try_divide(at(a), at(b)) - 1) * 100, F.lit(0.0)) for h, (a, b) in horizons.items()}
        | {
            "composite": F.when(positive > 0, F.exp(sum((F.coalesce(x, F.lit(0.0)) for x in logs), F.lit(0.0)) / positive)).otherwise(1.0),
            "consistency": sum(((at(p) > 1).cast("int") for p in periods), F.lit(0)) * 100.0 / n,
            "mean_percentile": sum((F.coalesce(F.col(f"{ranks}{p}").cast("double"), F.lit(50.0)) for p in periods), F.lit(0.0)) / n,
        }
    )
    short, middle, long = (f"momentum_{h}" for h in horizons)
    pattern = (
        f"case when {short} > 0 and {middle} > 0 then if({long} > 0, 'ACCELERATING', 'BUILDING') when {short} < 0 and {middle} < 0 then if({long} < 0, 'DECELERATING', 'WEAKENING')"
        f" when greatest(abs({short}), abs({middle}), abs({long})) < 2 then 'CONSOLIDATING' else 'MIXED' end"
    )
    mean = f"({short} + {middle} + {long}) / 3"
    momentum = f"case when {mean} > 5 then 'STRONG_BULLISH' when {mean} > 0 then 'BULLISH' when {mean} > -5 then 'NEUTRAL' else 'BEARISH' end"
    return out.withColumns({"pattern": F.expr(pattern), "momentum": F.expr(momentum)})


def stock_classes(rows: DataFrame) -> DataFrame:
    """measured() rows with the class of a stock."""
    kind = (
        f"case when composite > {LEADS} and consistency > 75 and mean_percentile > 80 then 'ELITE_LEADER' when composite > {LEADS} and consistency > 50 then 'STRONG_PERFORMER'"
        f" when composite > 1 and mean_percentile > 60 then 'ABOVE_AVERAGE' when composite < {LAGS} and consistency < 25 then 'WEAK_LAGGARD' else 'AVERAGE' end"
    )
    return rows.withColumn("class", F.expr(kind))


def group_classes(rows: DataFrame) -> DataFrame:
    """measured() rows with the class, rotation and quadrant of a sector or industry."""
    kind = f"case when composite > {LEADS} and momentum_middle > 0 then 'LEADING' when composite > 1 then 'OUTPERFORMING' when composite < {LAGS} then 'LAGGING' else 'NEUTRAL' end"
    rotation = "case when momentum_short > 0 and momentum_middle > 0 then 'STRONG_IN' when momentum_short < 0 and momentum_middle < 0 then 'ROTATING_OUT' else 'NEUTRAL' end"
    quadrant = "case when composite > 1 and momentum_middle > 0 then 'leading_improving' when composite > 1 and momentum_middle < 0 then 'leading_weakening' when composite < 1 and momentum_middle > 0 then 'lagging_improving' else 'lagging_weakening' end"
    return rows.withColumns({"class": F.expr(kind), "rotation": F.expr(rotation), "quadrant": F.expr(quadrant)})


def leaders_and_laggards(rows: DataFrame, n: int = 10) -> DataFrame:
    """side, place, ticker and composite of the n strongest leaders and weakest laggards, with how many there are of the side and their share of all in percent.

    The first n are found by task before they meet; ties go by ticker. Without rows on a side, the side is absent.
    """
    totals = rows.agg(F.count("*").alias("stocks"), F.count_if(F.col("composite") > LEADS).alias("leader"), F.count_if(F.col("composite") < LAGS).alias("laggard"))
    leads = rows.where(F.col("composite") > LEADS).orderBy(F.col("composite").desc(), "ticker").limit(n)
    lags = rows.where(F.col("composite") < LAGS).orderBy("composite", "ticker").limit(n)
    both = leads.select(F.lit("leader").alias("side"), "ticker", "composite").unionByName(lags.select(F.lit("laggard").alias("side"), "ticker", "composite"))
    placed = both.withColumn("place", F.expr("row_number() over (partition by side order by case when side = 'leader' then -composite else composite end, ticker)"))
    out = placed.crossJoin(F.broadcast(totals)).withColumn("of_side", F.when(F.col("side") == "leader", F.col("leader")).otherwise(F.col("laggard")))
    return out.select("side", "place", "ticker", "composite", "of_side", (F.col("of_side") * 100.0 / F.col("stocks")).alias("share_pct"))
