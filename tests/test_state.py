"""Tables of batches with commits, and series that go on between runs."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.sources import commits
from tidemark.sources.bars import bars_of
from tidemark.streaming import state

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_are_read_once_and_columns_come_late(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    assert commits.read(spark, path) is None and commits.compacted(spark, path) == -1
    assert commits.append(make([("a", 1)], "k string, v int"), path, 0)
    assert commits.append(make([("b", 2.5, True)], "k string, v double, late boolean"), path, 1)
    assert not commits.append(make([("b", 9.0, True)], "k string, v double, late boolean"), path, 1)  # a repeated batch
    assert commits.append(make([], "k string, v int"), path, 2) and commits.append(make([("a", 3)], "k string, v int"), path, 3)
    want = [("a", 1.0, 0, None), ("a", 3.0, 3, None), ("b", 2.5, 1, True)]
    assert rows_of(commits.read(spark, path).select("k", "v", "batch", "late")) == want
    assert rows_of(commits.current(spark, path, ["k"]).select("k", "v", "late")) == [("a", 3.0, None), ("b", 2.5, True)]
    assert commits.compacted(spark, path) == 3 and not commits.append(make([("z", 1)], "k string, v int"), path, 2)
    assert commits.append(make([("c", 4)], "k string, v int"), path, 4)
    assert rows_of(commits.read(spark, path).select("k", "v", "batch", "late")) == sorted([*want, ("c", 4.0, 4, None)])
    assert commits.compacted(spark, path) == 4 == commits.compacted(spark, path)
    assert rows_of(commits.read(spark, path).select("k", "v", "batch", "late")) == sorted([*want, ("c", 4.0, 4, None)])
    with pytest.raises(ValueError):
        commits.append(make([(1,)], "batch int"), path, 9)


def test_a_crash_between_write_and_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/log"
    one, other = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([(3,)], "y int")

    def crash(*_):
        raise OSError("crashed")

    with monkeypatch.context() as m:
        m.setattr(commits, "_commit", crash)
        with pytest.raises(OSError):
            commits.append({"one": one, "other": other}, path, 7)
    assert commits.read(spark, path, "one") is None
    assert commits.append({"one": one, "other": other}, path, 7)  # the same batch, run again
    assert rows_of(commits.read(spark, path, "one")) == [(1, 7), (2, 7)] and rows_of(commits.read(spark, path, "other")) == [(3, 7)]


@pytest.fixture(scope="module")
def bars(spark):
    return bars_of(spark.read.parquet(f"{SF}/lineitem.parquet")).where("ticker in ('S1', 'S2', 'S3', 'S4')").cache()


def compared(got, want):
    columns = sorted(want.columns)
    got, want = ({(r["ticker"], r["date"]): r for r in df.select(*columns).collect()} for df in (got, want))
    assert got.keys() == want.keys()
    for key, row in want.items():
        for c in columns:
            a, b = got[key][c], row[c]
            assert a == b or math.isclose(a, b, rel_tol=1e-12), (key, c, a, b)


def test_batches_with_late_bars_equal_one_run(spark, bars, tmp_path):
    """Five batches by date, a late bar, a correction in an earlier month, a new ticker, and a batch that is run twice."""
    path, plan = f"file://{tmp_path}/running", state.daily_plan()
    dates = [r.date for r in bars.select("date").distinct().orderBy("date").collect()]
    cuts = [dates[len(dates) * k // 5] for k in range(1, 5)]
    part = F.lit(0)
    for cut in cuts:
        part = part + (F.col("date") >= F.lit(cut)).cast("int")
    dealt = bars.withColumn("part", part)
    late = dealt.where("ticker = 'S1'").orderBy("date").limit(60).orderBy(F.desc("date")).limit(1).drop("part").cache()
    wrong = dealt.where("ticker = 'S2' and part = 2").orderBy("date").limit(3).drop("part").cache()
    for k in range(5):
        batch = dealt.where((F.col("part") == k) & ~((F.col("ticker") == "S4") & (F.col("part") < 3))).drop("part")
        batch = batch.join(late.select("ticker", "date"), ["ticker", "date"], "left_anti")
        if k == 2:
            batch = batch.join(wrong.select("ticker", "date"), ["ticker", "date"], "left_anti").unionByName(wrong.withColumn("close", F.col("close") * 1.5))
        assert state.add(path, plan, batch, k)
    known = bars.where(~((F.col("ticker") == "S4") & (F.col("date") < F.lit(cuts[2]))))
    assert state.add(path, plan, late.unionByName(wrong), 5) and not state.add(path, plan, late, 5)
    compared(state.results(spark, path), state.ran(plan, known).select(*state.BAR, *plan.columns))


def test_a_days_bars_read_no_history(spark, bars, tmp_path, monkeypatch):
    path, plan = f"file://{tmp_path}/running", state.daily_plan()
    last = bars.groupBy("ticker").agg(F.max("date").alias("last"))
    marked = bars.join(last, "ticker")
    state.add(path, plan, marked.where("date < last").drop("last"), 0)
    read = []
    monkeypatch.setattr(commits, "current", lambda spark, path, keys, name="rows", f=commits.current: read.append(name) or f(spark, path, keys, name))
    state.add(path, plan, marked.where("date = last").drop("last"), 1)
    assert read == ["states"]
    assert commits.read(spark, path).where("batch = 1").count() == last.count()
    compared(state.results(spark, path), state.ran(plan, bars).select(*state.BAR, *plan.columns))


def test_a_stream_is_followed(spark, bars, tmp_path):
    path, plan = f"file://{tmp_path}/running", state.daily_plan()
    source = f"file://{tmp_path}/in"
    follow = lambda: state.follow(spark.readStream.schema(bars.schema).parquet(source), path, plan, f"file://{tmp_path}/checkpoint").awaitTermination()
    early = F.col("date") < F.lit("1998-01-01")
    bars.where(early).coalesce(1).write.parquet(source)
    follow()
    bars.where(~early).coalesce(1).write.mode("append").parquet(source)
    follow()
    follow()
    compared(state.results(spark, path), state.ran(plan, bars).select(*state.BAR, *plan.columns))


def test_a_batch_is_made_once_and_rows_are_looked_up_in_doubt_only(spark, bars, tmp_path):
    """Writing a batch makes its bars once; a row before any later batch begins isn't shuffled for the results."""
    path, plan = f"file://{tmp_path}/once", state.daily_plan()
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    n = bars.count()
    state.add(path, plan, bars.mapInArrow(counted, bars.schema), 0)
    assert made.value == n
    late = bars.where("date >= '1998-01-01' and date < '1998-02-01'").withColumn("close", F.col("close") + 1)
    state.add(path, plan, late, 1)
    both = late.unionByName(bars.join(late.select("ticker", "date"), ["ticker", "date"], "left_anti"))
    compared(state.results(spark, path), state.ran(plan, both).select(*state.BAR, *plan.columns))
    assert commits.read(spark, path).where("batch = 0 and date >= '1998-02-01'").count() > 0
    assert "max_by" not in state.results(spark, path, ["ticker", "date", "bar"])._jdf.queryExecution().optimizedPlan().toString()
