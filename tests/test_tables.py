"""Programs of outputs, master tables, file transforms, tiers as a data source, and dashboard tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dashboards, masters, programs
from tidemark.sources import bars as source
from tidemark.sources import commits, settings, tiers, transforms

SF = "/root/testdata/sf0.001"
STEPS = "Filename string, File_id string, Generation string, Step string, Action string, Column string, Condition string, Value string, Logic string, Output_id string"


def program(spark):
    rows = [
        ("# a comment", None, None, None, None, None, None, None, None, None),
        (None, "1", "TRUE", "1", "filter", "x", "equals", "1", None, None),
        ("prices", "1", "TRUE", "1", "filter", "x", "greater_than", "2", None, "high"),
        ("prices", "1", None, "2", "sort", "x", "desc", None, None, None),
        ("prices", "2", "FALSE", "1", "filter", "x", "less_than", "2", None, "never"),
        ("high", "3.0", "", "1", "filter", "kind", "equals", "a", None, None),
        ("prices", "4", "TRUE", "1", "filter", "nothing", "equals", "a", None, "broken"),
        ("broken", "5", "TRUE", "1", "filter", "x", "equals", "1", None, "too"),
        ("absent", "6", "TRUE", "1", "filter", "x", "equals", "1", None, None),
        ("prices", "7", "TRUE", "1", "filter", "x", "odd", "1", None, "unknown"),
        ("prices", "8", "TRUE", "1", "filter", "x", "less_equal", "4", None, "both"),
        ("other", "8", "TRUE", "1", "filter", "y", "greater_equal", "20", None, None),
    ]
    return spark.createDataFrame(rows, STEPS)


def test_programs_make_each_output_or_say_why(spark, tmp_path):
    prices = spark.createDataFrame([("A", 1.0, "a"), ("B", 3.0, "b"), ("C", 4.0, "a"), ("D", 5.0, "a")], "ticker string, x double, kind string")
    other = spark.createDataFrame([("A", 10.0), ("B", 20.0), ("C", 30.0), ("E", 40.0)], "ticker string, y double")
    made_of = []
    sources = {"prices": lambda: made_of.append("prices") or prices, "other": other}
    outputs = programs.read(program(spark))
    assert [o.name for o in outputs] == ["high", "high_f3", "broken", "too", "absent_f6", "unknown", "both"]
    made = programs.run(spark, outputs, sources)
    rows = {name: [r.ticker for r in t.collect()] for name, t in made.tables.items()}
    assert rows["high"] == ["D", "C", "B"] and sorted(rows["high_f3"]) == ["C", "D"] and sorted(rows["both"]) == ["B", "C"] and len(rows) == 3
    assert made.failed == {"broken": "prices has no column nothing", "too": "broken failed", "absent_f6": "there is no absent", "unknown": "odd for x of prices"}
    assert made_of == ["prices"]  # read by five outputs, made once
    done = programs.written(made, f"file://{tmp_path}/out")
    assert [r.ticker for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out/high").collect()] == ["D", "C", "B"] and done.failed == made.failed
    long = programs.listed(made, ["ticker", "x", "y"])
    assert {(r.output, r.ticker, r.x, r.y) for r in long.where("output = 'both'").collect()} == {("both", "B", 3.0, 20.0), ("both", "C", 4.0, 30.0)}
    assert programs.listed(programs.Made(), ["ticker"]) is None


def test_programs_that_cannot_be_ordered(spark):
    with pytest.raises(ValueError, match="read each other"):
        programs.in_order([programs.Output("a", {"b": []}), programs.Output("b", {"a": []})])
    with pytest.raises(ValueError, match="one name"):
        programs.in_order([programs.Output("a", {"b": []}), programs.Output("a", {"c": []})])
    with pytest.raises(ValueError, match="Filename"):
        programs.read(spark.createDataFrame([("1",)], "Step string"))
    plain = spark.createDataFrame([("p", "1", "filter", "x"), ("q", "1", "filter", "x"), ("p", "2", "sort", "x")], "Filename string, Step string, Action string, Column string")
    assert [(o.name, len(next(iter(o.steps.values())))) for o in programs.read(plain)] == [("p", 2), ("q", 1)]


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_master_tables_join_all_files(spark, tmp_path):
    top = str(tmp_path)
    put(f"{top}/rs_stocks_daily_5period_20240102.csv", "ticker,date,rs_5,name\nA,2024-01-02,1.5,Alpha\nB,2024-01-02,,\n")
    put(f"{top}/rs_stocks_daily_5period_20240101.csv", "ticker,date,rs_5,name\nA,2024-01-01,9.9,Old\n")
    put(f"{top}/rs_stocks_daily_22period_20240102.csv", "ticker,date,rs_22,extra\nA,2024-01-02,2.5,1\nC,2024-01-02,3.5,2\n")
    put(f"{top}/rs_stocks_weekly_5period_20240105.csv", "ticker,date,rs_5,name\nB,2024-01-05,0.5,Beta\nD,2024-01-05,0.25,\n,2024-01-05,7,x\n")
    put(f"{top}/rs_sectors_daily_5period_20240102.csv", "ticker,date,rs_5\nTech,2024-01-02,1\n")
    put(f"{top}/notes.csv", "ticker\nZ\n")
    found = masters.period_files(settings.files(spark, f"file://{top}"))
    assert [(f.level, f.timeframe, f.period, f.date) for f in found] == [("sectors", "daily", 5, "20240102"), ("stocks", "daily", 5, "20240102"), ("stocks", "daily", 22, "20240102"), ("stocks", "weekly", 5, "20240105")]
    got = masters.master(spark, [f for f in found if f.level == "stocks"])
    assert got.columns == ["ticker", "date", "name_5d", "rs_5d", "extra_22d", "rs_22d", "name_5w", "rs_5w"]
    rows = {r.ticker: tuple(r)[1:] for r in got.collect()}
    assert rows == {
        "A": ("2024-01-02", "Alpha", 1.5, 1.0, 2.5, None, None), "B": ("2024-01-02", None, None, None, None, "Beta", 0.5),
        "C": ("2024-01-02", None, None, 2.0, 3.5, None, None), "D": ("2024-01-05", None, None, None, None, None, 0.25),
    }
    assert masters.master(spark, []) is None
    with pytest.raises(ValueError, match="no column"):
        masters.master(spark, found, key="symbol")


def test_three_forms_become_one_table(spark, tmp_path):
    top = str(tmp_path)
    put(f"{top}/tw/INDEX_ABC, 1D.csv", "﻿time,open,high,low,close,Volume\n1704153600,1,2,0.5,1.5,100\n2024-01-03,1.5,x,1,2,\n\n")
    put(f"{top}/tw/XYZ_1W.csv", "time,open,high,low,close\r\n2024-01-05,9,9,9,9\r\n")
    put(f"{top}/gf/^DJX_daily.csv", "Anything,o,h,l,c,v\n1/2/2024 16:00:00,10,12,9,11,5\n12/29/2023 16:00:00,9,10,8,10,4\nnot a date,1,1,1,1,1\n")
    put(f"{top}/yf/abc.csv", 'Date,Open,High,Low,Close,Volume\n2024-01-02,7,7,7,"7",7\n2024-01-04,8,8,8,8,8\n')
    put(f"{top}/yf/sub/deeper.csv", "Date,Open,High,Low,Close,Volume\n2024-01-02,7,7,7,7,7\n")
    put(f"{top}/tw/bad name!, 1D.csv", "time,open,high,low,close\n2024-01-02,1,1,1,1\n")
    put(f"{top}/tw/EMPTY, 1D.csv", "time,open,high,low,close\n")
    put(f"{top}/tw/LACKS, 1D.csv", "time,open\n2024-01-02,1\n")
    put(f"{top}/tw/none_fits.txt.csv", "x\n1\n")
    lines = ["flag,folder,pattern,form,timeframe", "# comment", f"TRUE,{top}/tw,*1D*,chart,daily", f"TRUE,{top}/tw/,*1W*,chart,weekly", f"TRUE,{top}/gf,*_daily*,sheet,daily", f"FALSE,{top}/gf,*,chart,daily", f"TRUE,{top}/yf,*,plain,daily"]
    table = transforms.files(spark, transforms.rules(lines))
    bars = transforms.transformed(table)
    day = dt.date
    rows = {(r.ticker, r.timeframe, r.date): (r.open, r.high, r.low, r.close, r.volume) for r in bars.collect()}
    assert rows == {
        ("INDEX_ABC", "daily", day(2024, 1, 2)): (1.0, 2.0, 0.5, 1.5, 100.0), ("INDEX_ABC", "daily", day(2024, 1, 3)): (1.5, None, 1.0, 2.0, 0.0), ("XYZ", "weekly", day(2024, 1, 5)): (9.0, 9.0, 9.0, 9.0, 0.0),
        ("^DJX", "daily", day(2024, 1, 2)): (10.0, 12.0, 9.0, 11.0, 5.0), ("^DJX", "daily", day(2023, 12, 29)): (9.0, 10.0, 8.0, 10.0, 4.0),
        ("ABC", "daily", day(2024, 1, 2)): (7.0, 7.0, 7.0, 7.0, 7.0), ("ABC", "daily", day(2024, 1, 4)): (8.0, 8.0, 8.0, 8.0, 8.0), ("LACKS", "daily", day(2024, 1, 2)): (1.0, None, None, None, 0.0),
    }
    told = {r.path.rpartition("/")[2]: (r.rows, r.problem) for r in transforms.report(table, bars).collect()}
    assert told["bad name!, 1D.csv"] == (0, "no ticker in the name") and told["EMPTY, 1D.csv"] == (0, "no rows") and told["LACKS, 1D.csv"] == (1, "no high, low, close") and told["abc.csv"] == (2, None)
    assert len(told) == 7
    out = f"file://{top}/out"
    transforms.canonical(bars, out)
    again = bars.where("ticker = 'ABC'").withColumn("close", F.lit(1.0))
    transforms.canonical(again, out)  # replaces one ticker, leaves the others
    back = transforms.read_canonical(spark, out)
    assert back.count() == len(rows) and {r.close for r in back.where("ticker = 'ABC'").collect()} == {1.0} and back.where("ticker = '^DJX'").count() == 2
    with pytest.raises(ValueError, match="line 1"):
        transforms.rules(["TRUE,a,b,odd,daily"])


def test_a_query_of_few_tickers_opens_their_files(spark, tmp_path):
    top = f"file://{tmp_path}"
    header = "Date,Open,High,Low,Close,Volume\n"
    for t in ("A", "B", "brk.b"):
        put(f"{tmp_path}/archive/{t}.csv", header + "2024-01-01,1,1,1,1,1\n2024-01-02 00:00:00-05:00,2,2,2,2,2\n2024-01-06,9,9,9,9,9\nnever,1,1,1,1,1\n")
    put(f"{tmp_path}/current/A.csv", "date,open,high,low,close,volume\n2024-01-02,5,5,5,,x\n2024-01-03,6,6,6,6,6\n")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    all_rows = tiers.tiered(spark, top)
    want = source.tiered(spark, top)
    assert sorted(map(repr, all_rows.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert all_rows.where("ticker = 'A'").count() == 3 and tiers.tiered(spark, top, weekdays="false").where("ticker = 'B'").count() == 3
    for k in range(30):  # a file that can't be read shows whether it is opened
        os.symlink("/nowhere", f"{tmp_path}/archive/T{k}.csv")
        os.unlink(f"{tmp_path}/archive/T{k}.csv")
        put(f"{tmp_path}/archive/T{k}.csv", 'Date,Open\n"2024-01-01,1\n1,2,3\n')
    assert tiers.tiered(spark, top, tickers=1).where("ticker in ('A', 'BRK-B')").count() == 5
    with pytest.raises(Exception, match="CSV"):
        tiers.tiered(spark, top).count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert tiers.tiered(spark, top, only="A,BRK-B").count() == 5
    reader = tiers.PushedReader({"path": top, "tickers": "1"})
    assert len(reader.partitions()) == 33
    assert list(reader.pushFilters([tiers.EqualTo(("close",), 1.0), tiers.In(("ticker",), ("A", "B")), tiers.EqualTo(("ticker",), "A")])) == [tiers.EqualTo(("close",), 1.0)]
    assert [[(t, len(paths)) for t, paths in p.files] for p in reader.partitions()] == [[("A", 2)]]
    assert tiers.tiered(spark, top, only="absent").count() == 0 and tiers.tiered(spark, f"{top}/none").count() == 0


def test_dashboard_sums_add_up(spark, tmp_path):
    bars, dimension = source.daily(spark, SF), source.dimension(spark, SF)
    universes = dimension.select("ticker", F.when(F.col("market_cap") > 1e11, "large").otherwise("small").alias("universe"))
    whole = dashboards.daily_sums(bars, dimension, universes)
    rows = {(r.date, r.kind, r.name): r for r in whole.collect()}
    one = max(rows)
    plain = {}
    for r in bars.join(dimension, "ticker").collect():
        plain.setdefault(r.ticker, []).append(r)
    n = sum(any(r.date == one[0] for r in v) for v in plain.values())
    assert rows[one[0], "all", "all"].tickers == n
    moves = [(v[i].close / v[i - 1].close - 1) * 100 for v in (sorted(v, key=lambda r: r.date) for v in plain.values()) for i in range(1, len(v)) if v[i].date == one[0]]
    assert rows[one[0], "all", "all"].change_sum == pytest.approx(sum(moves)) and rows[one[0], "all", "all"].advances == sum(m > 0 for m in moves)
    path, tickers = f"file://{tmp_path}/sums", [f"S{k}" for k in range(1, 6)]
    some = F.col("ticker").isin(*tickers)
    for k, part in enumerate((bars.where(some), bars.where(~some))):
        commits.append(dashboards.daily_sums(part, dimension, universes), path, k)
    back = {(r.date, r.kind, r.name): r for r in dashboards.added(commits.read(spark, path).drop("batch")).collect()}
    assert back.keys() == rows.keys() and all(back[k].tickers == rows[k].tickers and back[k].cap_change_sum == pytest.approx(rows[k].cap_change_sum) for k in rows)
    shown = dashboards.overview(whole).where("kind = 'universe'").select("name").distinct().collect()
    assert {r.name for r in shown} <= {"large", "small"}


def test_dashboard_tables(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    series = spark.createDataFrame([("up", day(k), 100.0 + k) for k in range(40)] + [("down", day(k), 100.0 - k) for k in range(25)] + [("new", day(0), 1.0)], "ticker string, date date, close double")
    got = {r.ticker: r for r in dashboards.performance(series).collect()}
    assert set(got) == {"up", "down"} and got["up"].trend == "DARK_GREEN" and got["down"].trend == "RED" and got["down"].position == "below"
    assert got["up"].month_pct == pytest.approx((139 / 110 - 1) * 100) and got["down"].month_pct == 0.0
    signals = spark.createDataFrame([("A", "momentum", 9.0), ("B", "rti_zone", 6.0), ("C", "other", None), ("D", "breakout", 1.0), ("E", "launch_pad", 8.5)], "ticker string, screen string, score double")
    assert {r.ticker: (r.strength, r.stage) for r in dashboards.opportunities(signals).collect()} == {"A": ("STRONG", "Entry"), "B": ("MODERATE", "Watch"), "C": ("MODERATE", "Monitor"), "D": ("WEAK", "Entry"), "E": ("STRONG", "Watch")}
    scores = spark.createDataFrame([("I1", 4.5), ("I2", 1.0), ("I3", 2.0)], "ticker string, score double")
    days = spark.createDataFrame([("I1", 7, None), ("I2", 4, day(3)), ("I3", 0, None)], "ticker string, distribution_days int, follow_through date")
    told = {(r.priority, r.kind, r.subject, r.urgency) for r in dashboards.alerts(scores, days, signals, dashboards.performance(series), most=1).collect()}
    assert told == {("CRITICAL", "DISTRIBUTION", "I1", 95), ("HIGH", "DISTRIBUTION", "I2", 75), ("HIGH", "FOLLOW_THROUGH", "I2 2024-01-04", 85), ("HIGH", "BULLISH", "I1", 80), ("MEDIUM", "BEARISH", "I2", 60), ("HIGH", "SETUP", "A:momentum", 85)}
