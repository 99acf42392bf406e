"""Classes of stocks and groups, stages by timeframe, divergences of lines, recent listings, the base filter and standard signals."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, indicators, leaders, screeners, stage
from tidemark.operators.screens import layered, screened

BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def bars_of(spark, closes: dict[str, list[float]], first=dt.date(2020, 1, 1)):
    rows = [(t, first + dt.timedelta(i), c, c + 1, c - 1, c, 1000.0 + i) for t, cs in closes.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, BARS)


def walk(n: int, seed: int) -> list[float]:
    draw, x = random.Random(seed), 100.0
    return [x := max(5.0, round(x + draw.choice((-2, -1, 0, 1, 2)), 2)) for _ in range(n)]


def strengths(spark, rows):
    columns = ", ".join(f"rs_{p} double, per_rs_{p} int" for p in leaders.PERIODS)
    return spark.createDataFrame([(t, *(x for pair in zip(rs, per) for x in pair)) for t, rs, per in rows], f"ticker string, {columns}")


def test_measures_classes_and_missing_values(spark):
    n = len(leaders.PERIODS)
    rows = [
        ("up", [1.3, 1.2, 1.2, 1.2, 1.1, 1.1, 1.1, 1.1, 1.0], [90] * n), ("none", [None] * n, [None] * n), ("down", [0.7, 0.8, 0.8, 0.8, 0.9, 0.9, 0.9, 0.9, 0.95], [5] * n),
        ("zero", [1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0], [50] * n), ("bad", [-1.0] * n, [1] * n), ("mixed", [1.2, 1.0, 1.0, 0.9, 1.0, 1.0, 1.0, 1.0, 1.0], [70] * n),
    ]
    out = {r.ticker: r for r in leaders.group_classes(leaders.measured(strengths(spark, rows))).collect()}
    stocks = {r.ticker: r["class"] for r in leaders.stock_classes(leaders.measured(strengths(spark, rows))).collect()}
    for name, rs, per in rows:
        value = dict(zip(leaders.PERIODS, (1.0 if x is None else x for x in rs)))
        positive = [x for x in value.values() if x > 0]
        composite = math.exp(sum(map(math.log, positive)) / len(positive)) if positive else 1.0
        assert out[name].composite == pytest.approx(composite) and out[name].consistency == pytest.approx(sum(x > 1 for x in value.values()) * 100 / n)
        assert out[name].mean_percentile == pytest.approx(sum(50 if p is None else p for p in per) / n)
        for horizon, (a, b) in leaders.HORIZONS.items():
            assert out[name][f"momentum_{horizon}"] == pytest.approx((value[a] / value[b] - 1) * 100 if value[b] else 0.0)
    assert {k: v.pattern for k, v in out.items()} == {"up": "ACCELERATING", "none": "CONSOLIDATING", "down": "DECELERATING", "zero": "CONSOLIDATING", "bad": "CONSOLIDATING", "mixed": "MIXED"}
    assert out["up"].momentum == "STRONG_BULLISH" and out["down"].momentum == "BEARISH" and out["none"].momentum == "NEUTRAL"
    assert (out["up"].rotation, out["up"].quadrant, out["up"]["class"]) == ("STRONG_IN", "leading_improving", "LEADING") and (out["down"].rotation, out["down"]["class"]) == ("ROTATING_OUT", "LAGGING")
    assert stocks == {"up": "ELITE_LEADER", "none": "AVERAGE", "down": "WEAK_LAGGARD", "zero": "AVERAGE", "bad": "AVERAGE", "mixed": "ABOVE_AVERAGE"}


def test_strengths_of_two_methods_beside_ranks(spark):
    ranks = spark.createDataFrame([("A", 9), ("B", 5), ("C", 1)], "ticker string, per_rs_3 int")
    first = spark.createDataFrame([("A", 1.5), ("B", None), ("X", 3.0)], "ticker string, rs_3 double")
    second = spark.createDataFrame([("A", 7.0), ("B", 2.0)], "ticker string, rs_3 double")
    out = leaders.beside(ranks, {"ibd": first, "ma": second}, ["rs_3"])
    assert sorted(map(tuple, out.select("ticker", "rs_3", "rs_3_ibd", "rs_3_ma").collect())) == [("A", 1.5, 1.5, 7.0), ("B", 2.0, None, 2.0), ("C", None, None, None)]


def test_leaders_and_laggards_with_ties_and_none(spark):
    rows = spark.createDataFrame([("A", 1.2), ("B", 1.2), ("C", 1.3), ("D", 1.0), ("E", 0.5), ("F", 1.05)], "ticker string, composite double")
    out = leaders.leaders_and_laggards(rows, 2).orderBy("side", "place").collect()
    assert [(r.side, r.place, r.ticker, r.of_side) for r in out] == [("laggard", 1, "E", 1), ("leader", 1, "C", 3), ("leader", 2, "A", 3)] and out[1].share_pct == pytest.approx(50.0)
    assert leaders.leaders_and_laggards(rows.where("ticker = 'D'")).count() == 0 and leaders.leaders_and_laggards(rows.limit(0)).count() == 0


def test_stages_by_timeframe_use_their_own_rules(spark):
    bars = bars_of(spark, {"A": [100.0 + i for i in range(80)], "B": [50.0] * 10})
    rules = {"slow": stage.Rules(close=0.5), "fast": stage.Rules(2, 3, 5, 3, quiet=0.1, wide=0.2, close=0.001)}
    out = {(r.timeframe, r.ticker): r for r in stage.by_timeframe({"slow": bars, "fast": bars, "plain": bars}, rules).collect()}
    assert out["slow", "A"].stage == "LP" and out["fast", "A"].stage == "2C" and out["plain", "A"].stage == "2A"  # all close; a wide range; a quiet one
    assert out["slow", "B"].stage == out["plain", "B"].stage == "??" and out["fast", "B"].stage == "LP" and out["plain", "B"].alignment == "Unknown"
    same = {r.ticker: r.stage for r in stage.overview(bars).collect()}
    assert same == {t: r.stage for (name, t), r in out.items() if name == "plain"}


def test_divergences_of_a_line_against_a_loop(spark):
    n, found = 20, {}
    closes = {f"T{k}": walk(160, k) for k in range(25, 35)} | {name: [round(100 + s * i / 10 + 10 * math.cos(math.pi * i / 10), 3) for i in range(120)] for name, s in (("zig", -1), ("zag", 1))} | {"short": walk(30, 99), "flat": [10.0] * 60}
    bars = bars_of(spark, closes).withColumn("line", F.expr("close + case ticker when 'zig' then 0.2 when 'zag' then -0.2 else 0.0 end * datediff(date, '2020-01-01') + if(ticker like 'z%', 0, pmod(xxhash64(ticker, date), 12L))"))
    got = {(r.ticker, r.date): r.divergence for r in layered(bars, indicators.line_divergence_layers("line", n)).where("divergence <> 0").collect()}
    for ticker, own in bars.toPandas().sort_values("date").groupby("ticker"):
        price, line = own["close"].reset_index(drop=True), own["line"].astype(float).reset_index(drop=True)
        marks = {(x, k): getattr(s.rolling(n, center=True), k)() == s for x, s in (("price", price), ("line", line)) for k in ("max", "min")}
        for i in range(n, len(price) - n):
            for k, sign in (("min", 1), ("max", -1)):
                before = [s[i - n : i][marks[x, k][i - n : i]] for x, s in (("price", price), ("line", line))]
                if marks["price", k][i] and marks["line", k][i] and len(before[0]) and len(before[1]):
                    if (price[i] - before[0].iloc[-1]) * sign < 0 < (line[i] - before[1].iloc[-1]) * sign:
                        found[ticker, own["date"].iloc[i]] = sign
    assert got == found and set(got.values()) == {1, -1}


def test_recent_listings(spark):
    rising = [10.0 + i for i in range(60)]
    bars = bars_of(spark, {"new": rising, "tiny": rising[:49], "old": rising * 4, "falling": rising[::-1]})
    assert [r.ticker for r in screened(bars, screeners.recent_listing()).collect()] == ["new"]
    assert screened(bars.limit(0), screeners.recent_listing()).count() == 0


def test_base_filter_keeps_what_nothing_rules_out(spark):
    bars = bars_of(spark, {t: [20.0] * 50 for t in ("A", "B", "C", "D", "E", "F")} | {"few": [20.0] * 49, "cheap": [4.0] * 50})
    dimension = spark.createDataFrame(
        [("A", "Able Corp", 2e9, "NYSE"), ("B", "Small", 5e8, "NYSE"), ("C", "Far", 2e9, "LSE"), ("D", "World Trust", 2e9, "AMEX"), ("E", None, None, None), ("few", "x", 2e9, "NYSE")],
        "ticker string, description string, market_cap double, exchange string")
    assert sorted(r.ticker for r in screeners.tradable(bars, dimension).collect()) == ["A", "E", "F"]


def test_standard_signals_say_where_they_are_from(spark):
    rows = [("A", "2024-01-02", "Buy", 1.0)] * 2 + [("A", "2024-01-02", "Sell", 1.0), ("B", "2025-01-02", "Buy", 1.0), ("C", "2024-01-02", "Hold", 1.0), ("D", None, "Buy", 1.0), ("E", "2024-01-03", "Buy", -1.0)]
    signals = spark.createDataFrame(rows, "ticker string, signal_date string, signal_type string, signal_price double")
    out = backtest.standard(signals, "s", "2024-12-31", {"screener_type": "x", "source_file": "f.csv", "timeframe": "weekly"})
    assert sorted((r.ticker, r.signal_type, r.screener_type, r.source_file, r.timeframe) for r in out.collect()) == [("A", "Buy", "x", "f.csv", "weekly"), ("A", "Sell", "x", "f.csv", "weekly")]
    assert backtest.between(out, "2024-01-03", "2024-12-31").count() == 0 and "timeframe" not in backtest.standard(signals, "s").columns
