"""Options: cleaning of chains, exposure by strike, levels, impact and unusual volume.

A chain has ticker, spot, type (call or put), strike, expiration, bid, ask, last, volume, open_interest and
implied_volatility; it may have gamma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of exposure levels, and what a quote must meet.
LEVELS = (("extreme", 1_000_000), ("major", 500_000), ("significant", 100_000), ("minor", 50_000))
LEAST_BID, MOST_SPREAD, LEAST_VOLUME, LEAST_INTEREST, MOST_DAYS, CONTRACT = 0.01, 0.50, 1, 10, 60, 100
#: Gamma by distance of the strike from the spot, where a chain has none.
GAMMA = ((0.02, 0.05), (0.05, 0.03), (0.10, 0.015), (0.20, 0.005))


def estimated_gamma() -> Column:
    away = F.abs(F.try_divide(F.col("strike"), F.col("spot")) - 1)
    out = F.when(away <= GAMMA[0][0], GAMMA[0][1])
    for most, gamma in GAMMA[1:]:
        out = out.when(away <= most, gamma)
    return out.otherwise(0.001)


#: Gamma by distance of the strike from the spot in two plainer estimates: one for a chain without expirations, one that decays with the days left. Fixed values.
PLAIN_GAMMA, DATED_GAMMA = ((0.05, 0.05), (0.10, 0.03)), ((0.05, 0.05), (0.10, 0.03), (0.15, 0.02))


def plain_gamma(days: Column | None = None) -> Column:
    """An estimate from strike and spot; with days to expiry a step finer, and times their share of a year (a tenth at least). A null or zero spot gives null."""
    money = F.try_divide("strike", "spot")
    out = F.when(money.isNull(), None)
    for most, gamma in PLAIN_GAMMA if days is None else DATED_GAMMA:
        out = out.when(money.between(1 - most, 1 + most), gamma)
    out = out.otherwise(0.01)
    return out if days is None else out * F.greatest(F.lit(0.1), days / 365.0)


def derived(chain: DataFrame, as_of: str) -> DataFrame:
    """chain with mid, spread, spread share, moneyness, days to expiry, dollar volume, volume against open interest and gamma."""
    out = chain.withColumns(
        {
            "mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"), "moneyness": F.try_divide("strike", "spot"),
            "days": F.datediff("expiration", F.lit(as_of).cast("date")), "turnover": F.col("volume") * F.col("last") * CONTRACT, "volume_to_interest": F.try_divide(F.col("volume").cast("double"), F.col("open_interest").cast("double")),
        }
    )
    out = out.withColumn("spread_share", F.try_divide("spread", "mid"))
    gamma = estimated_gamma() * F.greatest(F.lit(0.1), F.col("days") / 365)
    return out.withColumn("gamma", F.coalesce(F.col("gamma"), gamma) if "gamma" in chain.columns else gamma)


def cleaned(chain: DataFrame) -> DataFrame:
    """Quotes of a derived() chain that can be relied on."""
    return chain.where((F.col("bid") >= LEAST_BID) & (F.col("spread_share") <= MOST_SPREAD) & (F.col("volume") >= LEAST_VOLUME) & (F.col("open_interest") >= LEAST_INTEREST) & F.col("days").between(0, MOST_DAYS))


def exposure(chain: DataFrame) -> DataFrame:
    """ticker, strike, gamma exposure (calls add, puts take away), open interest, volume, distance from spot in percent, and level."""
    sign = F.when(F.col("type") == "call", 1.0).otherwise(-1.0)
    gex = F.sum(sign * F.col("gamma") * F.col("open_interest") * CONTRACT * F.col("spot"))
    out = chain.groupBy("ticker", "strike").agg(gex.alias("gex"), F.sum("open_interest").alias("open_interest"), F.sum("volume").alias("volume"), F.first("spot").alias("spot"))
    level = F.when(F.abs("gex") >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        level = level.when(F.abs("gex") >= least, name)
    return out.withColumns({"distance_pct": (F.try_divide("strike", "spot") - 1) * 100, "level": level.otherwise("none")})


def impact(levels: DataFrame) -> DataFrame:
    """ticker, net exposure, regime, and the largest support below and resistance above the spot; of equal ones the nearest to it.

    Exposures count as equal, and a net one as 0, to four digits: the last ones depend on the order of sums.
    """
    big = F.col("level") != "none"
    size, nearest = F.round(F.abs("gex"), 4), -F.abs(F.col("strike") - F.col("spot"))
    out = levels.groupBy("ticker").agg(
        F.sum("gex").alias("net_gex"), F.count_if(big).alias("levels"),
        F.max_by("strike", F.when(big & (F.col("strike") < F.col("spot")), F.struct(size, nearest))).alias("support"), F.max_by("strike", F.when(big & (F.col("strike") > F.col("spot")), F.struct(size, nearest))).alias("resistance"),
    )
    net = F.round("net_gex", 4)
    regime = F.when(net > 0, "positive").when(net < 0, "negative").otherwise("neutral")
    return out.withColumns({"regime": regime, "volatility": F.when(regime == "positive", "dampened").when(regime == "negative", "amplified").otherwise("normal")})


def level_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """ticker, new, gone and stable levels (sorted strikes) and the Jaccard similarity of two snapshots of exposure()."""
    strikes = lambda x, name: x.where("level <> 'none'").groupBy("ticker").agg(F.collect_set("strike").alias(name))
    both = strikes(now, "a").join(strikes(before, "b"), "ticker", "full_outer")
    empty = F.array().cast("array<double>")
    both = both.select("ticker", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    return both.select(
        "ticker", F.array_sort(F.array_except("a", "b")).alias("new"), F.array_sort(F.array_except("b", "a")).alias("gone"), F.array_sort(F.array_intersect("a", "b")).alias("stable"),
        F.try_divide(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))).alias("jaccard"),
    )


def unusual(chain: DataFrame, quantile: float = 0.95, ratio: float = 2.0, least: float = 0.7) -> DataFrame:
    """Options in the top of their ticker's volume or turnover, or traded at twice the open interest, with a score of how many hold."""
    tops = chain.groupBy("ticker").agg(F.percentile("volume", F.lit(quantile)).alias("top_volume"), F.percentile("turnover", F.lit(quantile)).alias("top_turnover"))
    flags = {"loud": F.col("volume") >= F.col("top_volume"), "rich": F.col("turnover") >= F.col("top_turnover"), "fresh": F.coalesce(F.col("volume_to_interest") >= ratio, F.lit(False))}
    out = chain.join(tops, "ticker").withColumns({k: v.cast("int") for k, v in flags.items()})
    out = out.withColumn("score", F.col("loud") * 0.4 + F.col("rich") * 0.3 + F.col("fresh") * 0.3)
    return out.where(F.col("score") >= least).drop("top_volume", "top_turnover")


def quality(chain: DataFrame) -> DataFrame:
    """ticker and a score of 0 to 1 for how complete and tight its quotes are."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return chain.groupBy("ticker").agg((share(F.col("bid") > 0) * 0.3 + share(F.col("volume") > 0) * 0.3 + share(F.col("open_interest") > 0) * 0.2 + share(F.col("spread_share") <= MOST_SPREAD) * 0.2).alias("quality"))


def signals(levels: DataFrame, near: float = 2.0) -> DataFrame:
    """ticker, type, signal, confidence and strike: what the regime of impact() and the largest level suggest.

    A positive regime reverts to the mean and a negative one follows breaks; a largest level within `near`
    percent of the spot is tested, as support if its exposure is positive.
    """
    regimes = impact(levels).where("regime <> 'neutral'")
    regime = regimes.select("ticker", F.lit("regime").alias("type"), F.when(F.col("regime") == "positive", "MEAN_REVERSION_SETUP").otherwise("MOMENTUM_BREAKOUT").alias("signal"), F.when(F.col("regime") == "positive", 0.75).otherwise(0.80).alias("confidence"), F.lit(None).cast("double").alias("strike"))
    key = levels.where("level <> 'none'").groupBy("ticker").agg(F.max_by(F.struct("strike", "gex", "distance_pct", "level"), F.struct(F.abs("gex"), -F.col("strike"))).alias("k"))
    key = key.where(F.abs("k.distance_pct") <= near)
    test = key.select("ticker", F.lit("level").alias("type"), F.when(F.col("k.gex") > 0, "SUPPORT_TEST").otherwise("RESISTANCE_TEST").alias("signal"), F.when(F.col("k.level") == "extreme", 0.8).otherwise(0.5).alias("confidence"), F.col("k.strike").alias("strike"))
    return regime.unionByName(test)
