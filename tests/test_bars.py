"""Sources: tiers, supplements, cleaning, quality and filling, on hand-made bars."""

import datetime as dt

import pytest

from tidemark.sources import bars

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"
HEAD = "Date,Open,High,Low,Close,Volume\n"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def series(spark, closes, ticker="A"):
    return spark.createDataFrame([(ticker, day(i), c, c, c, c, 10.0) for i, c in enumerate(closes)], SCHEMA)


def test_current_wins_over_archive(spark, tmp_path):
    for tier, rows in (("archive", ["2024-01-02 00:00:00-05:00,1,2,0,1,5", "2024-01-03,1,2,0,1.5,5"]), ("current", ["2024-01-03,1,2,0,9,5", "2024-01-06,1,2,0,9,5", ",1,2,0,9,5"])):
        (tmp_path / tier).mkdir()
        (tmp_path / tier / "AAPL.csv").write_text(HEAD + "\n".join(rows) + "\n")
    got = {(r.ticker, str(r.date)): r.close for r in bars.tiered(spark, str(tmp_path)).collect()}
    assert got == {("AAPL", "2024-01-02"): 1.0, ("AAPL", "2024-01-03"): 9.0}  # the Saturday and the undated row are gone


def batch(folder, date, rows):
    (folder / f"prices_1d_{date}.csv").write_text("Date,Symbol,Open,High,Low,Close,Adj Close,Volume\n" + "\n".join(rows) + "\n")


def test_supplement_after_a_date_with_aliases(spark, tmp_path):
    batch(tmp_path, "2024-01-04", ["2024-01-04,BRK.B,1,1,1,1,1,7"])
    batch(tmp_path, "2024-01-05", ["2024-01-05,brk.b,2,2,2,2,2,", "2024-01-05,aapl,3,3,3,3,3,9"])
    (tmp_path / "prices_1d_bad.csv").write_text("Date,Symbol,Open,High,Low,Close,Volume\n2024-01-08,ZZZ,1,1,1,1,1\n")
    got = {r.ticker: (r.close, r.volume) for r in bars.supplement(spark, str(tmp_path), "prices_", "2024-01-04").collect()}
    assert got == {"BRK-B": (2.0, 0.0), "AAPL": (3.0, 9.0)}


def test_extended_takes_only_later_rows_of_known_tickers(spark):
    have = series(spark, [1.0, 2.0, 3.0])
    more = spark.createDataFrame([("A", day(2), 9.0, 9.0, 9.0, 9.0, 1.0), ("A", day(3), 9.0, 9.0, 9.0, 9.0, 1.0), ("B", day(3), 9.0, 9.0, 9.0, 9.0, 1.0)], SCHEMA)
    got = sorted((r.ticker, r.date, r.close) for r in bars.extended(have, more).collect())
    assert got == [("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(2), 3.0), ("A", day(3), 9.0)]


def test_quality_gate(spark):
    good, short, jumpy = series(spark, [100.0 + i % 3 for i in range(300)], "G"), series(spark, [1.0] * 10, "S"), series(spark, [1.0, 2.0] * 150, "J")
    table = good.unionByName(short).unionByName(jumpy)
    assert {r.ticker: r.valid for r in bars.quality(table).collect()} == {"G": True, "S": False, "J": False}
    assert [r.ticker for r in bars.valid_only(table).select("ticker").distinct().collect()] == ["G"]


def test_filled_carries_the_last_close(spark):
    a = series(spark, [1.0, 2.0, 3.0])
    b = spark.createDataFrame([("B", day(1), 5.0, 5.0, 5.0, 5.0, 1.0)], SCHEMA)
    got = {(r.ticker, r.date): r.close for r in bars.filled(a.unionByName(b)).collect()}
    assert got == {("A", day(0)): 1.0, ("A", day(1)): 2.0, ("A", day(2)): 3.0, ("B", day(1)): 5.0, ("B", day(2)): 5.0}


def test_history_and_latest(spark):
    table = series(spark, [float(i) for i in range(300)])
    assert bars.capped(table, "daily", 1).count() == 252
    assert bars.capped(table, "daily", 0).count() == 300
    assert bars.latest(table).first().close == 299.0


@pytest.mark.parametrize("timeframe,n", [("weekly", 2), ("monthly", 1)])
def test_roll_up(spark, timeframe, n):
    got = bars.rolled_up(series(spark, [float(i) for i in range(10)]), timeframe).orderBy("date").collect()
    assert len(got) == n and got[0].open == 0.0 and got[-1].close == 9.0 and sum(r.volume for r in got) == 100.0
