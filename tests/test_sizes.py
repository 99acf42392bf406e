"""Whole results and bounded tasks on tables larger than the ones that the rules came from."""

import datetime as dt
import glob
import math

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import folds, windows
from tidemark.functions.sliding import followed, slid, with_place
from tidemark.operators import adl, backtest, basics, correlation, filters, indicators, options, screeners, strength, volume
from tidemark.operators.screens import every_layered, last_layered, layered, merged, screened, side_by_side
from tidemark.plans import derived_queries, indicator_queries, run_queries, screen_queries
from tidemark.plans.common import shown
from tidemark.sources import bars as bars_
from tidemark.sources import tiers, transforms

DAY = dt.date(2020, 1, 1)


def test_fine_percentiles_round_as_their_sql(spark):
    n = 6000
    values = spark.range(1, n + 1).select(F.col("id").alias("ticker"), F.col("id").cast("double").alias("v"))
    got = {r.ticker: r.per_v for r in strength.percentiles(values, ["v"], "fine").collect()}
    assert got == {r: math.floor(min(r / n * 100, 99.9) * 1e1 + 0.5) / 1e1 for r in range(1, n + 1)}


def test_watchlist_in_one_line(spark):
    signals = spark.range(1500).select(F.lit("daily").alias("timeframe"), F.lit("Asia").alias("signal"), F.lit("N").alias("exchange"), F.concat(F.lit("S"), "id").alias("ticker"))
    [row] = filters.watchlist(signals, most=None).collect()
    assert (row.part, row.line) == (0, ",".join(["###ASIA", *sorted(f"N:S{i}" for i in range(1500))]))
    assert sorted(r.part for r in filters.watchlist(signals).collect()) == [0, 1]


def test_master_table_writes_by_all_tasks(spark, tmp_path, monkeypatch):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    monkeypatch.setattr(run_queries.commits, "shared_folder", lambda _: f"file://{tmp_path}")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = run_queries.Q["master_table"](spark, "/root/testdata/sf0.01").count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert rows == 100 and len(glob.glob(f"{tmp_path}/rs_stocks_daily_5period*/part-*.csv")) > 1


def test_absolute_volume_brings_no_bars_to_one_task(spark):
    rows = [(f"T{t}", DAY + dt.timedelta(d), 10.0, 100.0 + d % 3 + (900.0 if d == 299 and t < 2 else 0.0)) for t in range(5) for d in range(300 - t)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    out = screened(bars, volume.absolute(15, 3, 1.0, 10, 0))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(specifiedwindowframe" not in plan and {(r.ticker, r.age) for r in out.collect()} >= {("T0", 0)}


def test_last_dates_of_filled_prices(spark):
    rows = [(f"T{t}", DAY + dt.timedelta(d), None if (t + d) % 11 == 0 else float(t + d)) for t in range(6) for d in range(3 * t, 60 - t) if (d * 7 + t) % 5 or t == 0]
    rows += [("early", DAY, 5.0), ("late", DAY + dt.timedelta(58), 7.0), ("none", DAY, None)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    every, plan = {(r.ticker, r.date): r.close for r in bars_.filled(bars).collect()}, lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    dates = sorted({d for _, d in every})
    for n in (1, 10, 59, 60, 100):
        assert {(r.ticker, r.date): r.close for r in bars_.filled(bars, n).collect()} == {k: v for k, v in every.items() if k[1] in dates[-n:]}
    assert "slice(" in plan(strength.strength_of_groups(bars, bars.selectExpr("ticker", "'g' as sector", "1e0 as market_cap").distinct(), (5,)))


def test_weighted_leaders_fill_the_dates_that_they_read(spark):
    out = derived_queries.Q["screen_weighted_leaders"](spark, "/root/testdata/sf0.01")
    bars = bars_.daily(spark, "/root/testdata/sf0.01")
    prices = bars_.filled(bars)
    want = screeners.leaders(strength.relative_strength(prices, strength.market(prices), (1, 5, 22)), bars_.dimension(spark, "/root/testdata/sf0.01"))
    assert out.count() > 3 and sorted(out.collect()) == sorted(shown(want).collect())
    assert "slice(" in out._jdf.queryExecution().optimizedPlan().toString()


def test_ledgers_stream_over_their_signals(spark):
    kinds = ("Buy", "Close Buy", "Sell", "Close Sell")
    rows = [(f"s{i % 3}", f"T{i * 7 % 13}", DAY + dt.timedelta(i // 4), kinds[i * 5 % 4 if i % 3 else i // 3 % 4], 10.0 + i * 11 % 17) for i in range(400)]
    signals = spark.createDataFrame(rows, "strategy string, ticker string, signal_date date, signal_type string, signal_price double")
    signals = signals.dropDuplicates(["strategy", "ticker", "signal_date", "signal_type"])
    for made in (backtest.simulated, backtest.portfolio):
        whole = sorted(made(signals).collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        try:
            cut = made(signals)
            assert sorted(cut.collect()) == whole and len(whole) > 20 and not all(t.closed for t in whole)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert "FlatMapGroups" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_make_signals_once(spark):
    rows = [(f"s{i % 4}", f"T{i * 5 % 17}" if i % 20 else None) for i in range(90)] + [("alone", "U"), (None, "T1")]
    signals = spark.createDataFrame(rows, "strategy string, ticker string")
    sets = {}
    for s, t in rows:
        sets.setdefault(s, set()).add(t)
    want = {}
    for a in sets:
        for b in sets:
            if a and b and a < b and (common := len((sets[a] & sets[b]) - {None})):
                want[a, b] = common, common / (len(sets[a]) + len(sets[b]) - common)
    out = backtest.overlaps(signals)
    assert {(r.a, r.b): (r.common, r.jaccard) for r in out.collect()} == want and len(want) == 6
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_merged_makes_each_table_once(spark):
    tables = {n: spark.range(k, 30, k).select(F.col("id").cast("string").alias("ticker"), (F.col("id") * k).alias("v")) for n, k in (("two", 2), ("three", 3))}
    out = filters.merged(tables)
    assert sorted((int(r.ticker), r.v, r.v_three, r.source_two, r.source_three) for r in out.collect()) == [(i, 2 * i, 3 * i, 1, 1) for i in range(6, 30, 6)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2


def test_equal_levels_give_the_nearest(spark):
    rows = [("a", 1400.0, 607808.2), ("a", 1450.0, -607808.2), ("b", 1350.0, 430767.12328767125), ("b", 1250.0, 430767.1232876713), ("b", 1600.0, -486000.0), ("b", 1550.0, 486000.0), ("c", 1400.0, 60000.1), ("c", 1450.0, -60000.100000000006)]
    for order in (rows, rows[::-1]):
        levels = spark.createDataFrame(order, "ticker string, strike double, gex double").selectExpr("*", "1500e0 as spot", "'minor' as level").coalesce(1)
        got = {r.ticker: (r.support, r.resistance, r.regime) for r in options.impact(levels).collect()}
        assert got == {"a": (1450.0, None, "neutral"), "b": (1350.0, 1550.0, "positive"), "c": (1450.0, None, "neutral")}


def test_averages_of_a_flat_line_are_equal(spark):
    """The line stands at one level for the last bars, so that its averages are the same over 20 and 50 of them."""
    rows = [(f"T{t}", DAY + dt.timedelta(d), 10.0 if d < 90 else 9.5, 10.0, 9.0, 1.1 * t + 0.7 if d < 60 else 0.0) for t in range(40) for d in range(120)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")
    bars = bars.withColumn("open", F.col("close"))
    got = screened(bars, adl.averages().relaxed()).collect()
    assert len(got) == 40 and {(r.ma_20 == r.ma_50, r.alignment, r.goldens, r.deaths) for r in got} == {(True, "neutral", 0, 0)}


def test_last_rows_are_those_of_all_rows(spark):
    rows = [(f"T{t}", DAY + dt.timedelta(d), 50.0 + (d * d * 7 + t) % 23, 60.0 + (d * 5 + t) % 17, 30.0 + (d * 3 + t) % 11, None if (d + t) % 29 == 0 else 100.0 + (d * 13 + t) % 31) for t in range(6) for d in range((20, 60, 130, 200, 260, 300)[t])]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double").withColumn("open", F.col("close")).cache()
    for name in ("adl_averages", "adl_monthly", "trend_model", "volatility_model", "guppy_convergence"):
        layers = screen_queries.SCREENS[name].layers
        got, want = last_layered(bars, layers), layered(bars, layers)
        want = bars_.latest(want)
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect()), name
    assert "rows_back" in screened(bars, screen_queries.SCREENS["adl_averages"])._jdf.queryExecution().optimizedPlan().toString()
    bars.unpersist()


def test_all_indicators_read_bars_once(spark):
    out = indicator_queries.Q["indicator_all"](spark, "/root/testdata/sf0.001")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_matrix_reads_bars_three_times_and_adds_up_once_a_ticker(spark):
    bars = spark.createDataFrame([(f"T{t}", DAY + dt.timedelta(d), 50.0, 60.0 + (d * 5 + t) % 17, 30.0, 40.0 + (d * d * 7 + t) % 23, 100.0 + d % 7) for t in range(3) for d in range((40, 120, 280)[t])], "ticker string, date date, open double, high double, low double, close double, volume double").cache()
    out = basics.matrix(bars)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation [") == 3
    got = {r.ticker: r.asDict() for r in out.collect()}
    for block in (basics.technicals, basics.atr):
        for r in bars_.latest(block(bars)).collect():
            assert all(v is None and got[r.ticker][c] is None or v == r.date or abs(v - got[r.ticker][c]) < 0.0051 for c, v in r.asDict().items() if c not in ("ticker", "date"))
    bars.unpersist()


def test_lines_are_dealt_without_what_is_made_of_them(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = bars_.bars_of(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and " / " in plan and " / " not in plan.split("RepartitionByExpression")[1]


def test_pairs_of_a_ticker_follow_each_other(spark):
    rows = [(f"T{t}", DAY + dt.timedelta(d), 50.0 + (d * d * 7 + t * t) % 23) for t in range(40) for d in range(60 - t % 5)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    found = correlation.correlations(bars, 20, tickers=9).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "a", "b", "n").collect()
    found.sort(key=lambda r: r.i)
    assert {(r.a, r.b) for r in found} == {(a, b) for a in {r[0] for r in rows} for b in {r[0] for r in rows} if a < b} and len(found) == 780
    runs = sum((one.p, one.a) != (other.p, other.a) for one, other in zip(found, found[1:])) + 1
    assert runs == len({(r.p, r.a) for r in found}) and all(one.b < other.b for one, other in zip(found, found[1:]) if (one.p, one.a) == (other.p, other.a))


def test_ticker_files_are_written_without_frames_and_read_back(spark, tmp_path):
    rows = [("A", DAY + dt.timedelta(d), 1e7 + d, 0.1 + 0.2, None, float("nan") if d == 3 else 1 / 3, 17.0) for d in range(30)] + [("B", DAY, 1.0, 2.0, 0.5, 1.5, 3.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double").repartition(3)
    out = transforms.canonical_files(bars, f"file://{tmp_path}/archive")
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.path.rsplit("/", 1)[1], r.rows) for r in out.collect()} == {("A.csv", 30), ("B.csv", 1)}
    lines = (tmp_path / "archive/A.csv").read_text().split("\n")
    assert lines[0] == "Date,Open,High,Low,Close,Volume" and len(lines) == 32 and [x[:10] for x in lines[1:31]] == [str(r[1]) for r in rows[:30]]
    want = sorted((*r[:5], None if r[5] != r[5] else r[5], r[6]) for r in rows)
    assert sorted(map(tuple, tiers.tiered(spark, f"file://{tmp_path}", weekdays="false").collect())) == want
    table = transforms.files(spark, transforms.rules([f"TRUE,file://{tmp_path}/archive,*,plain,daily"]))
    assert sorted(map(tuple, transforms.transformed(table).select(*bars.columns).collect())) == want


def test_tiers_cast_columns_at_once(monkeypatch):
    calls = []
    monkeypatch.setattr(tiers, "_number", lambda x, f=tiers._number: calls.append(x) or f(x))
    table = lambda *closes: pa.table({"Date": ["2024-01-02", "2024-01-03 00:00", "2024-01-06"][: len(closes)], " close": list(closes)})
    made = lambda *tables: tiers._bars("A", tables, True).select(["date", "close", "open"]).to_pylist()
    day = lambda d: dt.date(2024, 1, d)
    assert made(table("1.5"), table(" 2e3 ", "nan", "4"), table()) == [{"date": day(2), "close": 2000.0, "open": None}, {"date": day(3), "close": None, "open": None}] and not calls
    assert made(table("1_0", "x", "4")) == [{"date": day(2), "close": 10.0, "open": None}, {"date": day(3), "close": None, "open": None}] and len(calls) == 3


def test_slid_frames_are_those_of_windows(spark):
    rows = [(f"T{t}" if t else None, DAY + dt.timedelta(d), None if (d * t) % 13 == 5 or t == 5 else 50.0 + (d * d * 7 + t) % 23 + 0.1 * t, None if d % 17 == 3 else d + 1) for t in range(7) for d in range((20, 1, 2, 64, 150, 60, 97)[t])]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, bar int")
    made = {f"{kind}_{n}": (kind, "close", n, "bar" if kind == "regr_slope" else None) for kind in ("avg", "count", "stddev_pop", "stddev_samp", "regr_slope") for n in (0, 1, 15, 50)}
    texts = {name: f"cast({kind}(close{f', {along}' if along else ''}) over {windows.rows(n)} as double)" for name, (kind, _, n, along) in made.items()}
    want = {(r.ticker, r.date): r for r in layered(bars, (texts,)).collect()}
    for most in (1, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert {(r.ticker, r.date): r for r in slid(bars, made).collect()} == want and len(want) == len(rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_followed_series_are_those_of_folds(spark):
    rows = [(f"T{t}" if t else None, DAY + dt.timedelta(d), None if (d * t) % 13 == 5 or t == 5 or d < t else 50.0 + (d * d * 7 + t) % 23 + 0.1 * t, d if d % 17 else None) for t in range(7) for d in range((20, 1, 2, 64, 150, 60, 97)[t])]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, n int")
    series = {c: [folds.Smoothed(f"{c}_quick", "ewm", 1, lambda bar, _, c=c: bar[c], 1, weight=0.3), folds.Series(f"{c}_slow", "ewm", 26, lambda bar, _, c=c: bar[c], 9)] for c in ("close", "n")}
    want = {(r.ticker, r.date): r for r in folds.with_series(bars, [s for some in series.values() for s in some]).collect()}
    for most in (1, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            assert {(r.ticker, r.date): r for r in followed(with_place(bars), series, bars.columns).collect()} == want and len(want) == len(rows)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_indicators_make_series_of_all_blocks_at_once(spark):
    out = indicator_queries.Q["indicator_all"](spark, "/root/testdata/sf0.01")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "aggregate(" not in plan  # macd and tsi feed averages, whose own average tsi is
    got = {r.ticker: r.asDict() for r in out.collect()}
    assert len(got) == 100
    for name in ("rsi", "tsi", "mfi", "easy_trade", "crosses", "adline", "momentum"):
        for r in indicator_queries.Q[f"indicator_{name}"](spark, "/root/testdata/sf0.01").collect():
            assert all(v == got[r.ticker][c] for c, v in r.asDict().items()), name


def test_blocks_that_name_different_things_are_made_one_after_another(spark):
    rows = [(f"T{t}", DAY + dt.timedelta(d), 50.0 + (d * d * 7 + t) % 23) for t in range(5) for d in range((20, 60, 90, 2, 45)[t])]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    blocks = [(indicators.macd_layers(), ("macd", "macd_signal")), (indicators.macd_layers(5, 8, 3), ("macd_histogram", "macd")), (indicators.sma_layers(21), ("sma_21",)), (({"close": "close * 2"},), ("close",))]
    assert merged([layers for layers, _ in blocks], ["macd"]) is None
    got = {r.ticker: r for r in side_by_side(bars, blocks).collect()}
    one, other = ({r.ticker: r for r in bars_.latest(layered(bars, layers)).collect()} for layers, _ in blocks[:2])
    for t, r in got.items():
        assert (r.macd, r.macd_signal, r.macd_histogram, r.close) == (one[t].macd, one[t].macd_signal, other[t].macd_histogram, 2 * one[t].close)
    assert len(got) == 5


def test_screens_of_all_dates_slide_long_frames_in_batches(spark):
    rows = [(f"T{t}", DAY + dt.timedelta(d), 20.0 + 0.05 * d * (t % 3) + (d * 7 + t) % 5 * 0.1 if (d + t) % 41 else None, 100.0 + d % 9) for t in range(9) for d in range(40 + 20 * t)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, volume double").withColumn("unread", F.lit("x"))
    screen = screeners.launch_pad(volume=0).every()
    out, every = screened(bars, screen), lambda made: sorted(made.select("ticker", "date", *screen.columns).collect(), key=str)
    assert every(every_layered(bars, screen.layers)) == every(layered(bars, screen.layers))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, -" not in plan and "unread" not in plan and out.count() > 10
