"""Queries on market breadth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breadth
from ..sources import bars as source
from .common import Queries, shown
from .sql import layer, on_bars

Q = Queries()
#: Tickers of the test tables are few; many new highs are taken to be 3.
MANY = 3
KEYS = ("universe", "date")


def _counted(universe: str, source_: str = "t") -> str:
    sums = ", ".join(f"{text} as {name}" for name, text in breadth.SUMS.items())
    return f"c as (select {universe} as universe, date, {sums} from {source_} group by 1, 2)"


ALL = (layer("t", "bars", **breadth.TICKER_COLUMNS), _counted("'all'"), layer("r", "c", **breadth.RATIOS))
SECTORS = (layer("t0", "bars", **breadth.TICKER_COLUMNS), "t as (select * from t0 join dim using (ticker))", _counted("sector"), layer("r", "c", **breadth.RATIOS))
FULL = (layer("h", "r", **breadth.thresholds(MANY)), layer("s", "h", **breadth.SIGNALS), layer("o", "s", **breadth.TOTALS), layer("g", "o", **breadth.RATINGS), layer("u", "g", **breadth.RUNS))


def _picked(columns, whole=(), text=()) -> str:
    return ", ".join(["universe", "date", *(f"round({c}, 4) as {c}" for c in columns), *(f"cast({c} as bigint) as {c}" for c in whole), *text])


def _shown(df, columns, whole=(), text=()):
    return shown(df.select(*KEYS, *columns, *(F.col(c).cast("long").alias(c) for c in whole), *text))


def members(spark, sf_dir):
    return source.dimension(spark, sf_dir).select("ticker", F.col("sector").alias("universe"))


AD = (("ad_ratio", "advance_pct", "decline_pct", "avg_pct_change", "pct_change_std"), ("total_stocks", "advancing", "declining", "unchanged", "net_advances", "ad_line"))


@Q.add("breadth_advance_decline", on_bars(*ALL, select=f"select {_picked(*AD)} from r"))
def advance_decline(spark, sf_dir):
    return _shown(breadth.counts(source.daily(spark, sf_dir)), *AD)


HL = (
    [f"hl_ratio_{k}" for k in breadth.EXTREMES] + [f"{k}_new_highs_pct" for k in breadth.EXTREMES],
    [f"{k}_new_{x}s" for k in breadth.EXTREMES for x in ("high", "low")] + [f"net_hl_line_{k}" for k in breadth.EXTREMES],
)


@Q.add("breadth_new_highs_lows", on_bars(*SECTORS, dim=True, select=f"select {_picked(*HL)} from r"))
def new_highs_lows(spark, sf_dir):
    return _shown(breadth.counts(source.daily(spark, sf_dir), members(spark, sf_dir)), *HL)


MA = ([f"pct_above_ma_{n}" for n in breadth.AVERAGES], [f"above_ma_{n}" for n in breadth.AVERAGES])


@Q.add("breadth_moving_averages", on_bars(*SECTORS, dim=True, select=f"select {_picked(*MA)} from r"))
def moving_average_breadth(spark, sf_dir):
    return _shown(breadth.counts(source.daily(spark, sf_dir), members(spark, sf_dir)), *MA)


TH = ((), list(breadth.thresholds()))


@Q.add("breadth_thresholds", on_bars(*ALL, FULL[0], select=f"select {_picked(*TH)} from h"))
def thresholds(spark, sf_dir):
    return _shown(breadth.breadth(source.daily(spark, sf_dir), many=MANY), *TH)


SG = (
    ["score"] + [f"{x}_momentum_{n}d" for n in (5, 10, 20) for x in ("bullish", "bearish")],
    ["breadth_thrust", "breadth_deterioration", "ad_thrust", "highs_expansion", "lows_expansion", "bullish_signals", "bearish_signals", "net_signals", "bullish_days", "bearish_days"],
    ["rating", "strength", "classification"],
)


@Q.add("breadth_signals", on_bars(*SECTORS, *FULL, dim=True, select=f"select {_picked(*SG)} from u"))
def signals(spark, sf_dir):
    return _shown(breadth.breadth(source.daily(spark, sf_dir), members(spark, sf_dir), many=MANY), *SG)


@Q.add("breadth_combined", on_bars(layer("t0", "bars", **breadth.TICKER_COLUMNS), "t as (select * from t0 semi join (select ticker from dim where sector in ('ASIA', 'EUROPE')) using (ticker))", _counted("'ASIA+EUROPE'"), layer("r", "c", **breadth.RATIOS), dim=True, select=f"select {_picked(*AD)} from r"))
def combined(spark, sf_dir):
    return _shown(breadth.combined(source.daily(spark, sf_dir), members(spark, sf_dir), "ASIA+EUROPE", ["ASIA", "EUROPE"]), *AD)


@Q.add("breadth_weighted", on_bars(*SECTORS, "w as (select *, case universe when 'ASIA' then 0.5 when 'EUROPE' then 0.3 when 'AMERICA' then 0.2 else 0.1 end as w from r where universe in ('ASIA', 'EUROPE', 'AMERICA', 'AFRICA'))", dim=True, select="select date, round(sum(advance_pct * w) / sum(w), 4) as advance_pct from w where advance_pct is not null group by date"))
def weighted(spark, sf_dir):
    return shown(breadth.weighted(breadth.counts(source.daily(spark, sf_dir), members(spark, sf_dir)), ["ASIA", "EUROPE", "AMERICA", "AFRICA"], "advance_pct"))
