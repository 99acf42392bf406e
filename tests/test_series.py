"""Recursive series and windows against pandas, and state machines against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.folds import ema, rma, wilder, with_series
from tidemark.functions.windows import rank_share, sma, slope, true_range
from tidemark.operators import machines, stage
from tidemark.sources.bars import numbered

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    out = []
    for ticker in ("A", "B"):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 180)))
        for i, c in enumerate(close):
            high, low = c * (1 + abs(rng.normal(0, 0.02))), c * (1 - abs(rng.normal(0, 0.02)))
            out.append((ticker, dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.uniform(low, high)), float(high), float(low), float(c), float(rng.integers(1, 1000))))
    return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])


@pytest.fixture(scope="module")
def bars(spark, frame):
    return spark.createDataFrame(frame, SCHEMA)


def same(df, column, frame, expected):
    got = df.select("ticker", "date", column).toPandas().sort_values(["ticker", "date"])[column].astype(float).to_numpy()
    want = np.concatenate([np.asarray(expected(g), float) for _, g in frame.groupby("ticker", sort=True)])
    np.testing.assert_allclose(got, want, rtol=1e-9, equal_nan=True)


def test_recursive_series_match_pandas(bars, frame):
    out = with_series(
        bars.withColumn("tr", F.expr(true_range())),
        [ema("a", 10), ema("b", 10, adjusted=True), rma("c", 14, lambda bar, _: bar["close"], adjusted=True, least=14), wilder("d", 14, lambda bar, _: bar["tr"]), ema("e", 9, lambda _, made: made["a"] - made["b"])],
    )
    same(out, "a", frame, lambda g: g.close.ewm(span=10, adjust=False).mean())
    same(out, "b", frame, lambda g: g.close.ewm(span=10).mean())
    same(out, "c", frame, lambda g: g.close.ewm(alpha=1 / 14, min_periods=14).mean())
    tr = lambda g: pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)

    def smoothed(g):
        t, out_ = tr(g).to_numpy(), [np.nan] * 13
        out_.append(t[:14].mean())
        for x in t[14:]:
            out_.append((out_[-1] * 13 + x) / 14)
        return out_

    same(out, "d", frame, smoothed)


def test_guarded_windows_match_pandas(bars, frame):
    out = numbered(bars).withColumns({"s": F.expr(sma("close", 20)), "k": F.expr(slope("close", 10))})
    same(out, "s", frame, lambda g: g.close.rolling(20).mean())
    same(out, "k", frame, lambda g: g.close.rolling(10).apply(lambda x: np.polyfit(np.arange(10), x, 1)[0]))


def test_rank_share_ties(spark):
    values = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,), (5.0,)], "v double")
    got = values.select("v", F.expr(rank_share("v")).alias("a"), F.expr(rank_share("v", "min")).alias("m")).toPandas().sort_values("v")
    want = pd.Series([1.0, 2.0, 2.0, 5.0])
    np.testing.assert_allclose(got.a.dropna(), want.rank(pct=True))
    np.testing.assert_allclose(got.m.dropna(), want.rank(pct=True, method="min"))
    assert got.a.isna().sum() == 1


def test_volatility_stop_matches_a_loop(bars, frame):
    out = machines.volatility_stop(bars, 20, 3.0)

    def loop(g):
        g = g.reset_index(drop=True)
        tr = pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)
        atr = tr.ewm(alpha=1 / 20, min_periods=20).mean()
        top = bottom = g.close[0]
        stop, up, stops = 0.0, True, [0.0]
        for i in range(1, len(g)):
            c, away = g.close[i], tr[i] if np.isnan(atr[i]) else atr[i] * 3.0
            top, bottom = max(top, c), min(bottom, c)
            stop = max(stop, top - away) if up else min(stop, bottom + away)
            now = c - stop >= 0
            if now != up:
                top = bottom = c
                stop = c - away if now else c + away
            up = now
            stops.append(stop)
        return stops

    same(out, "stop", frame, loop)


def test_breakout_positions_match_a_loop(bars, frame):
    out = machines.breakout_positions(bars, 5, 5, 10, 3)
    out = out.withColumn("code", F.expr("case position when 'Buy' then 1 when 'Sell' then 2 when 'Close Buy' then 3 when 'Close Sell' then 4 else 0 end"))

    def loop(g):
        g = g.reset_index(drop=True)
        top, bottom, record, trend = g.high.rolling(5).max(), g.low.rolling(5).min(), g.volume.rolling(5).max(), g.close.rolling(10).mean()
        now, run, codes = "", 0, [0.0]
        for i in range(1, len(g)):
            if not (np.isnan(trend[i]) or np.isnan(top[i - 1])):
                c, loud = g.close[i], g.volume[i] > record[i - 1]
                if c > top[i - 1] and loud and c > trend[i] and now != "Buy":
                    now, run = "Buy", 0
                elif c < bottom[i - 1] and loud and c < trend[i] and now != "Sell":
                    now, run = "Sell", 0
                if now in ("Buy", "Sell"):
                    run = run + 1 if (c < trend[i] if now == "Buy" else c > trend[i]) else 0
                    if run >= 3:
                        now, run = "Close " + now, 0
            codes.append({"Buy": 1, "Sell": 2, "Close Buy": 3, "Close Sell": 4}.get(now, 0))
        return codes

    same(out, "code", frame, loop)


def test_stages_cover_all_and_flat_prices_are_a_launch_pad(spark, bars):
    assert set(r.stage for r in stage.staged(stage.inputs(bars)).select("stage").distinct().collect()) <= set(stage.STAGES)
    flat = spark.createDataFrame([("F", dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(60)], SCHEMA)
    assert stage.overview(flat).first().stage == "LP"
    short = flat.where("date < '2020-01-20'")
    assert stage.overview(short).first().stage == "??"
