"""Filter programs, panels, universes, back-tests, streams and all registered queries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import backtest, filters, panels, universes
from tidemark.plans import registry
from tidemark.streaming import events

SF = "/root/testdata/sf0.001"


def test_filter_program(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("b", 5.0, False), ("c", None, True), ("d", 9.0, True)], "name string, x double, ok boolean")
    step = filters.Step
    names = lambda *steps: [r.name for r in filters.applied(df, [*steps, step("sort", "name", "desc", order=9)]).collect()]
    assert names(step("filter", "x", "greater_than", "2", order=1)) == ["d", "b"]
    assert names(step("filter", "name", "equals", "a", "OR", 1), step("filter", "x", "between", "8,10", "OR", 2), step("filter", "ok", "equals", "TRUE", "AND", 3)) == ["d", "a"]
    assert names(step("filter", "none", "equals", "a"), step("filter", "x", "odd", "a")) == ["d", "c", "b", "a"]
    assert names(step("filter", "name", "icontains", "^[AB]$")) == ["b", "a"]


@pytest.mark.parametrize("text,kind,tickers,indicator", [
    ("SPY", "price", ("SPY",), ""), ("RSI(14)", "indicator", ("M",), "RSI"), ("PPO(QQQ,12,26,9)", "indicator", ("QQQ",), "PPO"), ("QQQ:SPY", "ratio", ("QQQ", "SPY"), ""),
    ("A_PPO(12,26,9)_for_(SPY)", "indicator", ("SPY",), "PPO"), ("B_CORR(20)_for_(SPY,QQQ)", "correlation", ("SPY", "QQQ"), "CORR"), ("SPY + EMA(20)", "bundle", ("SPY",), ""),
])
def test_panel_language(text, kind, tickers, indicator):
    got = panels.parsed(text, "M")
    assert (got.kind, got.tickers, got.indicator) == (kind, tickers, indicator)


def test_universe_texts():
    assert universes.parsed("A;B + C") == [("A", ["A"]), ("B + C", ["B", "C"])]


def test_ledger_limits_positions_and_closes_leftovers(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("X", day(1), "Buy", 10.0), ("Y", day(2), "Buy", 10.0), ("X", day(3), "Close Buy", 12.0), ("Z", day(4), "Sell", 10.0), ("Z", day(5), "Close Sell", 9.0), ("Q", day(6), "Odd", 1.0), ("X", day(1), "Buy", 10.0)]
    signals = backtest.standard(spark.createDataFrame(rows, "ticker string, signal_date date, signal_type string, signal_price double"), "s")
    trades = {r.ticker: r for r in backtest.simulated(signals, backtest.Money(1000.0, 0.5, 0.0, 1)).collect()}
    assert set(trades) == {"X", "Z"} and trades["X"].shares == 50 and trades["X"].pnl == 100.0
    assert trades["Z"].side == "short" and trades["Z"].pnl == trades["Z"].shares * 1.0
    figures = backtest.performance(backtest.simulated(signals, backtest.Money(1000.0, 0.5, 0.0, 1))).first()
    assert figures.trades == 2 and figures.win_rate_pct == 100.0 and figures.profit_factor is None
    with pytest.raises(ValueError):
        backtest.standard(signals.drop("ticker"), "s")


def test_streamed_windows_equal_batch(spark, tmp_path):
    stream = events.tumbling(events.source(spark, SF), "1 day", "365 days")
    got = events.drained(stream, "tumbling_test", str(tmp_path / "c"))
    want = events.tumbling(events.timed(spark.read.parquet(f"{SF}/events.parquet")), "1 day")
    assert got.select("start", "event_type", "events").exceptAll(want.select("start", "event_type", "events")).count() == 0
    assert got.count() == want.count()


def test_accumulated_bars_take_each_once(spark, tmp_path):
    schema = "ticker string, date date, close double"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for i, rows in enumerate(([("A", dt.date(2024, 1, 1), 1.0), ("A", dt.date(2024, 1, 1), 1.0)], [("A", dt.date(2024, 1, 1), 9.0), ("A", dt.date(2024, 1, 2), 2.0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        events.accumulate(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "c")).awaitTermination()
    assert sorted((str(r.date), r.close) for r in spark.read.parquet(table).collect()) == [("2024-01-01", 1.0), ("2024-01-02", 2.0)]


def test_entry_and_names():
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["stage_overview", "screen_atr_signals", "screen_guppy_alignment", "options_level_changes", "panels", "pulse_general_market", "basic_matrix"])
def test_queries_run_on_the_smallest_tables(spark, name):
    out = registry.queries()[name](spark, SF)
    assert out.columns and out.count() >= 0


def test_empty_tables(spark):
    from tidemark.operators import basics, breadth, stage
    from tidemark.sources import bars

    empty = spark.createDataFrame([], "ticker string, date date, open double, high double, low double, close double, volume double")
    for out in (stage.overview(empty), breadth.breadth(empty), basics.returns(empty), basics.extremes(empty), bars.filled(empty), bars.rolled_up(empty, "weekly")):
        assert out.count() == 0
    assert bars.summary(empty).select(F.col("tickers")).first()[0] == 0
