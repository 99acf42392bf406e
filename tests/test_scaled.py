"""As-of joins, correlations of all tickers and ranks against pandas, and what their plans hold."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, correlation, movers, ranks

DAY = dt.date(2020, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def no_window_over_all(df):
    plan = plan_of(df)
    assert not re.search(r"windowspecdefinition\((?!\w+#)", plan.split("== Physical Plan ==")[1]), plan
    assert "SinglePartition" not in plan or "Window" not in plan.split("SinglePartition")[0].rsplit("\n\n", 1)[-1]


def table(spark, seed, n, keys=5, nulls=True):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        key = f"k{r.integers(keys)}" if not nulls or r.random() > 0.03 else None
        day = DAY + dt.timedelta(int(r.integers(0, 500))) if not nulls or r.random() > 0.03 else None
        rows.append((key, day, i, None if r.random() < 0.1 else float(r.integers(100))))
    return rows


@pytest.mark.parametrize("settings", [{}, {"exact": False}, {"within_days": 5}, {"days": 1}, {"days": 10_000}])
@pytest.mark.parametrize("keyed", [True, False])
def test_as_of_matches_a_search(spark, keyed, settings):
    left, right = table(spark, 1, 400), table(spark, 2, 120)
    own, other = spark.createDataFrame(left, "k string, date date, i int, x double"), spark.createDataFrame(right, "k string, date date, j int, v double")
    got = asof.as_of(own, other, ["v", "j"], ["k"] if keyed else [], **settings)
    no_window_over_all(got)
    exact, within = settings.get("exact", True), settings.get("within_days", 10**6)
    want = {}
    for k, day, i, _ in left:
        fits = [(d, v is not None, v, j) for q, d, j, v in right if d and day and (not keyed or q is not None and q == k) and (d <= day if exact else d < day) and (day - d).days <= within]
        # keys may be null on either side only if there are none
        fits = [f for f in fits if (day - max(fits)[0]).days <= within]
        want[i] = (max(fits)[2], max(fits)[3]) if fits else (None, None)
    assert {r.i: (r.v, r.j) for r in got.collect()} == want and got.columns == ["k", "date", "i", "x", "v", "j"]


def test_as_of_edges(spark):
    rows = spark.createDataFrame([("a", DAY, 1.0)], "k string, date date, v double")
    with pytest.raises(ValueError):
        asof.as_of(rows, rows, ["v"], ["k"])
    other = rows.withColumnRenamed("v", "w")
    assert asof.as_of(rows.where("1 = 0"), other, ["w"], ["k"]).collect() == []
    assert [r.w for r in asof.as_of(rows, other.where("1 = 0"), ["w"], ["k"]).collect()] == [None]
    twice = rows.unionByName(rows)
    assert [r.w for r in asof.as_of(twice, other, ["w"]).collect()] == [1.0, 1.0]


@pytest.mark.parametrize("settings", [{}, {"tickers": 3, "days": 40}, {"tickers": 1, "days": 7}])
def test_correlations_match_pandas(spark, settings):
    r, rows = np.random.default_rng(4), []
    for t in range(11):
        level = 50.0
        for d in range(t, 200):
            level *= 1 + (r.normal() * 0.02 if t != 7 else 0.0)
            if r.random() < 0.8:
                rows.append((f"T{t}", DAY + dt.timedelta(d), None if r.random() < 0.02 else level))
    rows += [("short", DAY + dt.timedelta(d), 1.0 + d % 3) for d in range(5)] + [(None, DAY, 1.0), ("T0", None, 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    got = {(x.a, x.b): (x.n, x.correlation) for x in correlation.correlations(bars, 20, **settings).collect()}
    moves = {}
    for t, g in pd.DataFrame([x for x in rows if x[0] and x[1]], columns=["t", "d", "c"]).groupby("t"):
        g = g.sort_values("d")
        moves[t] = pd.Series((g.c / g.c.shift() - 1).to_numpy(), g.d).dropna()
    names = sorted(moves)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = pd.concat([moves[a], moves[b]], axis=1, join="inner").to_numpy()
            if len(both) < 20:
                assert (a, b) not in got
                continue
            n, c = got.pop((a, b))
            assert n == len(both)
            if "T7" in (a, b):
                assert c is None
            else:
                assert abs(c - np.corrcoef(both.T)[0, 1]) < 1e-9
    assert not got
    [one] = correlation.model(bars, 20, **settings).collect()
    assert one.assets == 11 and one.pairs == 45 and abs(one.diversification - 1 + abs(one.mean_correlation)) < 1e-12
    assert correlation.model(bars.where("ticker = 'T0'"), 20).collect() == [] and correlation.correlations(bars.where("1 = 0")).collect() == []


def walks(spark, tickers, days=60):
    r = np.random.default_rng(9)
    rows = [(f"T{t:02d}", DAY + dt.timedelta(d), float(50 + r.normal())) for t in range(tickers) for d in range(days) if r.random() < 0.8]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_model_reads_blocks_where_they_lie(spark):
    bars = walks(spark, 12)
    many, one = correlation.model(bars, 20, tickers=2, days=20), correlation.model(bars, 20)
    plan = plan_of(many)
    assert "CartesianProduct" in plan and "Generate" not in plan  # no copy of a return for each block
    a, b = many.first(), one.first()
    assert (a.pairs, a.highest_pair, a.lowest_pair) == (b.pairs, b.highest_pair, b.lowest_pair) == (66, a.highest_pair, a.lowest_pair) and abs(a.mean_correlation - b.mean_correlation) < 1e-12


def test_pairs_shuffle_a_return_once(spark):
    bars = walks(spark, 12)
    pairs = lambda tickers: {(x.a, x.b): (x.n, round(x.correlation, 9)) for x in correlation.correlations(bars, 20, tickers=tickers, days=20).collect()}
    assert len(pairs(2)) == 66 and pairs(2) == pairs(100)
    plan = plan_of(correlation.correlations(bars, 20, tickers=2))
    assert "CartesianProduct" in plan and "Generate" not in plan


def test_figures_of_blocks_are_those_of_their_pairs():
    r = np.random.default_rng(3)
    cells = lambda names: pa.array([{"ticker": t, "days": sorted(r.choice(60, 40, False).tolist()), "rets": (r.normal(size=40) * (t != "flat")).tolist()} for t in names], correlation_cell)
    correlation_cell = pa.struct([("ticker", pa.string()), ("days", pa.list_(pa.int32())), ("rets", pa.list_(pa.float64()))])
    one, other = cells(["c", "a", "flat", "e", "g"]), cells(["d", "b", "f"])
    for left, right in ((one, one), (one, other), (other, one)):
        sums, want = correlation._Sums(), {}
        sums.add(left, right)
        for ones, i, others, j, _, value in sums.pairs(left is right, 25):
            want |= {(a, b): v for a, b, v in zip(ones[i], others[j], value) if v == v}
        got = {}
        for first, value in sums.figures(left is right, 25):
            for i, j in zip(*np.nonzero(~np.isnan(value))):
                got[tuple(sorted((list(sums.names[0])[first + i], list(sums.names[1])[j])))] = value[i, j]
        assert got == want and len(got) > 3 and not any("flat" in pair for pair in got)
        rows = [x for batch in correlation._summed(None, sums, left is right, 25) for x in batch.to_pylist()]
        assert sum(x["pairs"] for x in rows) == len(want) and max(x["highest"] for x in rows) == max(want.values()) and want[rows[0]["lowest_a"], rows[0]["lowest_b"]] == rows[0]["lowest"] == min(want.values())
        assert sums.sums[0].dtype == np.float64 and sums.sums[0].max() <= 40


def test_groups_make_no_row_for_a_pair_and_date(spark):
    bars = walks(spark, 9)
    groups = spark.createDataFrame([(f"T{t:02d}", g) for t in range(9) for g in ("all", "odd" if t % 2 else None)], "ticker string, grp string")
    got = lambda **s: {(x.grp, x.a, x.b): (x.n, round(x.correlation, 9)) for x in correlation.grouped(bars, groups, **s).collect()}
    every = {(x.a, x.b): (x.n, round(x.correlation, 9)) for x in correlation.correlations(bars, 1).collect()}
    odd = {k: v for k, v in every.items() if all(int(t[1:]) % 2 for t in k)}
    assert got() == got(tickers=2, days=20) == {("all", *k): v for k, v in every.items()} | {("odd", *k): v for k, v in odd.items()} and len(odd) == 6
    plan = plan_of(movers.correlations(bars, groups))
    assert "MapInArrow" in plan and "corr(" not in plan


@pytest.mark.parametrize("ties", ["average", "least", "most", "dense"])
@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_ranks_match_pandas(spark, ties, by):
    r = np.random.default_rng(6)
    rows = [(i, [None, "a", "b"][r.integers(3)], int(r.integers(2)), None if r.random() < 0.1 else float(r.choice([r.normal(), 3.0, -0.0, 0.0]))) for i in range(800)]
    data = spark.createDataFrame(rows, "i int, g string, h int, rank double").withColumnRenamed("rank", "v")
    got = ranks.ranked(data, "v", by, ties, ranges=7)
    no_window_over_all(got)
    frame = pd.DataFrame(rows, columns=["i", "g", "h", "v"])
    method = {"average": "average", "least": "min", "most": "max", "dense": "dense"}[ties]
    groups = frame.groupby(by, dropna=False).v if by else frame.v
    want, of = (groups.rank(method=method), groups.transform("count") if by else pd.Series(frame.v.count(), frame.index))
    found = {x.i: (x["rank"], x.rank_of) for x in got.collect()}
    for i in range(800):
        assert found[i] == ((None, None) if np.isnan(frame.v[i]) else (want[i], of[i]))


def test_percentiles_and_edges(spark):
    data = spark.createDataFrame([(i, float(i % 10)) for i in range(1000)] + [(1000, None)], "i int, v double")
    for scale, low, high in (("ibd", 6, 94), ("standard", 5, 95), ("fine", 5.1, 95.1), ("share", 0.0505, 0.9505)):
        got = {x.i: x.percentile for x in ranks.percentile(data, "v", scale=scale).collect()}
        assert got[1000] is None and got[0] == pytest.approx(low) and got[9] == pytest.approx(high)
    assert ranks.ranked(data.where("1 = 0"), "v").collect() == []
    assert {x["rank"] for x in ranks.ranked(data.where("v is null"), "v").collect()} == {None}
    days = spark.createDataFrame([("a", DAY + dt.timedelta(400 * k), float(-k)) for k in range(4)], "ticker string, date date, v double")
    assert sorted((x.date, x.percentile) for x in ranks.trailing_percentile(days, "v", 2).collect()) == [(DAY + dt.timedelta(800), 1.0), (DAY + dt.timedelta(1200), 0.5)]
