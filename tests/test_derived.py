"""Sources, settings, statistics, benchmarks and market indexes on small tables with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import folds
from tidemark.functions.windows import weighted_average
from tidemark.operators import backtest, machines, pulse, screeners, strength, universes
from tidemark.sources import bars, settings, sinks

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_long_series_are_linear(spark):
    n = 30_000
    one = spark.range(n).selectExpr("'A' as ticker", "date_add(date'1900-01-01', cast(id as int)) as date", "100 + 10 * sin(id / 50) as close", "cast(null as double) as none")
    got = folds.with_series(one, [folds.ema("e", 10), folds.wilder("w", 14, lambda b, _: b["close"]), folds.ema("x", 3, lambda b, _: b["none"])])
    last = got.orderBy(F.desc("date")).first()
    e, w, first = None, None, []
    for i in range(n):
        c = 100 + 10 * math.sin(i / 50)
        e = c if e is None else e + 2 / 11 * (c - e)
        first.append(c)
        w = None if i < 13 else sum(first) / 14 if i == 13 else (w * 13 + c) / 14
    assert got.count() == n and abs(last.e - e) < 1e-9 and abs(last.w - w) < 1e-9 and last.x is None
    cycles = machines.smoothed_cycles(one).groupBy("cycle").count().collect()
    assert {r.cycle for r in cycles} == {None, "Bull", "Bear"}


def test_settings_and_files(spark, tmp_path):
    lines = ["variable,value,description", "# a comment", "", "top,5,how many", "names,a,b,c,the names", "run,TRUE,whether", "plain,x"]
    assert settings.settings(lines, {"top": int, "run": settings.yes}) == {"top": 5, "names": "a;b;c", "run": True, "plain": "x"}
    for bad in (["top,x,y"], ["top"]):
        with pytest.raises(ValueError, match="line 1"):
            settings.settings(bad, {"top": int})
    for name in ("rs_20240101.csv", "rs_20240301.csv", "per_all_20240201.csv", "rs_note.txt"):
        (tmp_path / name).write_text("a\n1\n")
    paths = settings.files(spark, f"file://{tmp_path}")
    assert settings.latest_file(paths, "rs").endswith("rs_20240301.csv") and settings.latest_file(paths, "all", {"all": "per_*"}).endswith("per_all_20240201.csv")
    assert settings.latest_file(paths, "none") is None
    found = {p.rpartition("/")[2]: r for p, r in settings.discovered(paths, {"strength": ["rs_2*"], "rest": ["*.csv"]}).items()}
    assert found == {"rs_20240101.csv": "strength", "rs_20240301.csv": "strength", "per_all_20240201.csv": "rest"}
    assert bars.first_table(spark, f"file://{tmp_path}/no.csv", f"file://{tmp_path}/rs_20240101.csv").columns == ["a"]
    assert bars.first_table(spark, f"file://{tmp_path}/no.csv") is None


def test_lists_exports_and_snapshots(spark, tmp_path):
    assert [r.ticker for r in bars.ticker_list(spark.createDataFrame([("A",), (" A",), (None,), ("",)], "Symbol string")).collect()] == ["A"]
    with pytest.raises(ValueError):
        bars.ticker_list(spark.createDataFrame([("A",)], "other string"))
    rows = [("A", day(0), 1, "1", "2", "0.5", "1.5", "9"), ("A", day(0), 2, "7", "7", "7", "7", "7"), ("B", day(0), 1, "1", "1", "1", "0", "1"), ("B", day(0), 2, "1", "1", "1", "x", "1"), (None, day(0), 1, "1", "1", "1", "1", "1"), ("C", day(1), 1, None, "2", "1", "2", None)]
    shots = bars.snapshots(spark.createDataFrame(rows, "Symbol string, date date, place int, Open string, High string, Low string, Price string, Volume string"))
    assert sorted((r.ticker, r.close, r.open, r.volume) for r in shots.collect()) == [("A", 1.5, 1.0, 9.0), ("C", 2.0, None, None)]
    table = f"file://{tmp_path}/shots"
    bars.add_snapshots(shots.where(F.col("date") == F.lit(day(0))), table)
    for _ in range(2):
        bars.add_snapshots(shots, table)
    assert sorted(r.ticker for r in spark.read.parquet(table).collect()) == ["A", "C"]
    chart = bars.from_chart(spark.createDataFrame([("1704067200", "1", "2", "x", "1.5"), ("2024-01-02T00:00:00Z", "1", "2", "0", "1"), ("odd", "1", "2", "0", "1")], "time string, open string, high string, low string, close string"), "T")
    assert sorted((r.date, r.low, r.volume) for r in chart.collect()) == [(day(1), 0.0, 0.0)] or sorted((r.date, r.low is None) for r in chart.collect()) == [(day(0), True), (day(1), False)]
    sheet = bars.from_sheet(spark.createDataFrame([("1/2/2024 16:00:00", "1", "2", "0", "1", "5"), ("Date", "a", "b", "c", "d", "e")], "d string, o string, h string, l string, c string, v string"), "T")
    assert [(r.date, r.close, r.volume) for r in sheet.collect()] == [(day(1), 1.0, 5.0)]


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([("A", day(0), 1.234), ("B", day(1), 2.0)], "ticker string, date date, x double")
    sinks.partitioned(sinks.dated(df, "daily"), f"file://{tmp_path}/p")
    sinks.partitioned(sinks.dated(df.where("ticker = 'A'"), "daily"), f"file://{tmp_path}/p")
    back = spark.read.parquet(f"file://{tmp_path}/p")
    assert back.count() == 3 and [r.ticker for r in sinks.latest_partition(back).where("ticker = 'B'").collect()] == ["B"]
    sinks.matrix_csv(df, f"file://{tmp_path}/m", ["x", "ticker"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"file://{tmp_path}/m").collect())) == [("1.23", "A"), ("2.0", "B")]
    sinks.json_lines(df, f"file://{tmp_path}/j")
    sinks.text_lines(df.withColumn("line", F.col("ticker")), f"file://{tmp_path}/t")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 2 and sorted(r.value for r in spark.read.text(f"file://{tmp_path}/t").collect()) == ["A", "B"]


def plain_beta(a, b, x, steps=200_000):
    """By the midpoint rule, after a change of variable that takes the poles away (a, b >= 0.5)."""
    f = lambda t: 2 * math.sin(t) ** (2 * a - 1) * math.cos(t) ** (2 * b - 1)
    end = math.asin(math.sqrt(x))
    total = lambda upto: sum(f((i + 0.5) * upto / steps) for i in range(steps)) * upto / steps
    return total(end) / total(math.pi / 2)


@pytest.mark.parametrize(("a", "b", "x"), [(2.5, 0.5, 0.7), (0.5, 0.5, 0.1), (10, 3, 0.8), (1, 1, 0.25)])
def test_incomplete_beta(a, b, x):
    assert abs(backtest.beta_share(a, b, x) - plain_beta(a, b, x)) < 1e-6


def test_significance(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (-1, 1, -1, 1)] + [("c", 7.0)]
    trades = spark.createDataFrame(rows, "strategy string, return_pct double").withColumn("pnl", F.col("return_pct"))
    got = {r.strategy: r for r in backtest.t_test(trades).collect()}
    assert abs(got["a"].p - 0.0132) < 1e-4 and got["a"].significant_5pct and not got["a"].significant_1pct and abs(got["b"].p - 1) < 1e-9 and got["c"].p is None
    two = backtest.variance_test(trades.where("strategy <> 'c'")).first()
    f, n, k = two.f, 9, 2
    assert abs(two.p - plain_beta((n - k) / 2, (k - 1) / 2, (n - k) / (n - k + (k - 1) * f))) < 1e-6
    shares = {r.strategy: r.share_pct for r in backtest.contributions(trades).collect()}
    assert abs(shares["a"] - 1500 / 22) < 1e-9 and abs(sum(shares.values()) - 100) < 1e-9


def test_benchmarks_and_mapping(spark):
    assert strength.mappings("SPY:A; QQQ : B ;bad;SPY:C;SPY:A") == {"SPY": ["A", "C"], "QQQ": ["B"]}
    prices = spark.createDataFrame([("A", day(i), 10.0 + i) for i in range(5)], "ticker string, date date, close double")
    marks = spark.createDataFrame([("X", day(i), 10.0) for i in range(5)] + [("Y", day(i), 10.0 * 2**i) for i in (0, 1, 4)], "benchmark string, date date, close double")
    wide = strength.side_by_side(strength.strength_against(prices, marks, (1,)), ["X", "Y", "Z"], ["rs_1"]).first()
    assert abs(wide.rs_1_vs_X - 14 / 13) < 1e-12 and abs(wide.rs_1_vs_Y - (14 / 11) / 8) < 1e-12 and wide.rs_1_vs_Z is None and abs(wide.mean_rs_1 - (14 / 13 + 14 / 88) / 2) < 1e-12
    none = strength.market_condition(spark.createDataFrame([], "composite double, consistency double, mean_percentile double")).first()
    assert (none.stocks, none.condition, none.strong_pct) == (0, "UNKNOWN", 0.0)


def test_market_indexes(spark):
    index = spark.createDataFrame([("I", day(i), 99.0 + i, 101.0 + i, 99.0 + i, 100.0 + i, 1.0) for i in range(200)], "ticker string, date date, open double, high double, low double, close double, volume double")
    breadth = spark.createDataFrame([(day(150), 1, 200, 5), (day(190), 0, 50, -5)], "date date, long_success int, long_new_highs int, net_advances int")
    got = pulse.index_requirements(index, breadth).first()
    assert [got[f"r{i}"] for i in range(1, 10)] == [0.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0, 0.0] and (got.score, got.light) == (5.0, "GREEN")
    mean = pulse.mean_requirements(pulse.index_requirements(index, breadth)).first()
    assert (mean.indexes, mean.score, mean.light) == (1, 4.0, "NEUTRAL")
    early = pulse.general_market_index(breadth, index, index.where(F.col("date") <= F.lit(day(180))), index).first()  # the date is that of the shortest
    assert (early.date, early.r1, early.r2, early.r3, early.r4, early.r5, early.r6, early.score, early.light) == (day(180), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 6.0, "GREEN")
    late = pulse.general_market_index(breadth, index, index, index).first()
    assert (late.date, late.r1, late.r2, late.score) == (day(190), 0.0, 0.0, 4.0)
    joined = pulse.as_of(spark.createDataFrame([(day(149),), (day(150),), (day(189),)], "date date"), breadth, ["net_advances"])
    assert [r.net_advances for r in joined.orderBy("date").collect()] == [None, 5, 5]


def test_universes_and_averages(spark):
    table = spark.createDataFrame([("A", " Strong Buy", True), ("B", None, False), ("C", "Hold", None)], "ticker string, rating string, sp boolean")
    assert {tuple(r) for r in universes.rated(table).collect()} == {("A", "rating_StrongBuy"), ("C", "rating_Hold")}
    assert [tuple(r) for r in universes.of_flags(table, ["sp"]).collect()] == [("A", "sp")]
    both = universes.together(table.where("ticker = 'A'"), table)
    assert both.columns == table.columns and both.count() == 3
    wide = universes.flagged(table, universes.rated(table), ["rating_Hold", "rating_None"])
    assert {r.ticker: (r.rating_Hold, r.rating_None) for r in wide.collect()}["C"] == (True, False)
    line = spark.createDataFrame([("A", day(i), float(i)) for i in range(5)], "ticker string, date date, close double")
    assert [r.w for r in line.select("date", F.expr(weighted_average("close", 3)).alias("w")).orderBy("date").collect()] == [None, None, *((k * 3 + (k - 1) * 2 + (k - 2)) / 6 for k in (2, 3, 4))]
    ranks = screeners.leaders(spark.createDataFrame([(t, 1.0 + i, None, None) for i, t in enumerate("ABC")], "ticker string, rs_1 double, rs_5 double, rs_22 double"), table.withColumn("industry", F.lit("x")))
    assert [(r.ticker, r.place) for r in ranks.orderBy("place").collect()] == [("C", 1), ("B", 2), ("A", 3)]
