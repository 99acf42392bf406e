"""Back-tests: standard signals, the trade ledger of a strategy or portfolio, and figures on its trades.

A strategy's ledger is sequential: what it can buy depends on the cash and positions left by all before.
So each strategy (and each portfolio) is handled in order of its signals by one task; strategies run beside
each other. Spark sorts the signals, and the task streams over them: it holds a batch and the open positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNALS = ("Buy", "Sell", "Close Buy", "Close Sell")
NEEDED = ("ticker", "signal_date", "signal_type", "signal_price")
TRADE = "strategy string, ticker string, side string, entry_date date, entry_price double, exit_date date, exit_price double, shares long, pnl double, return_pct double, days int, closed boolean"


@dataclass(frozen=True)
class Money:
    capital: float = 100_000.0
    share: float = 0.10
    cost: float = 0.001
    positions: int = 10


def standard(signals: DataFrame, strategy: str, as_of: str | None = None, about: Mapping[str, str] | None = None) -> DataFrame:
    """Signals with the standard columns and types: repeated ones once, unknown types, missing values and future dates dropped. Lacking columns are an error.

    about: where they are from (screener_type, source_file, timeframe), as further columns.
    """
    if lacking := [c for c in NEEDED if c not in signals.columns]:
        raise ValueError(f"signals lack {', '.join(lacking)}")
    out = signals.select(F.lit(strategy).alias("strategy"), "ticker", F.col("signal_date").cast("date").alias("signal_date"), "signal_type", F.col("signal_price").cast("double").alias("signal_price"), *(F.lit(v).alias(k) for k, v in (about or {}).items()))
    out = out.where(F.col("signal_type").isin(*SIGNALS) & F.col("ticker").isNotNull() & F.col("signal_date").isNotNull() & (F.col("signal_price") > 0))
    if as_of:
        out = out.where(F.col("signal_date") <= F.lit(as_of).cast("date"))
    return out.dropDuplicates(["strategy", "ticker", "signal_date", "signal_type"])


def between(signals: DataFrame, first: str, last: str) -> DataFrame:
    return signals.where(F.col("signal_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _trade(strategy: str, ticker: str, p: dict, date, price: float, cost: float, closed: bool) -> tuple:
    gain = (price - p["price"]) * (1 if p["side"] == "long" else -1)
    pnl = gain * p["shares"] - (price + p["price"]) * p["shares"] * cost
    return strategy, ticker, p["side"], p["date"], p["price"], date, price, p["shares"], pnl, pnl / (p["price"] * p["shares"]) * 100, (date - p["date"]).days, closed


class _Ledger:
    """Trades of one strategy's signals in order; what is open at the end closes at its entry price."""

    def __init__(self, money: Money) -> None:
        self.money, self.cash, self.held, self.last = money, money.capital, {}, None

    def add(self, s) -> Iterator[tuple]:
        money, held = self.money, self.held
        self.last = s.strategy, s.signal_date
        if s.signal_type in ("Buy", "Sell"):
            side = "long" if s.signal_type == "Buy" else "short"
            shares = int(self.cash * money.share / s.signal_price)
            if s.ticker in held or len(held) >= money.positions or shares < 1:
                return
            held[s.ticker] = {"side": side, "date": s.signal_date, "price": s.signal_price, "shares": shares}
            self.cash -= shares * s.signal_price * (1 + money.cost)
        elif s.ticker in held and (held[s.ticker]["side"] == "long") == (s.signal_type == "Close Buy"):
            p = held.pop(s.ticker)
            trade = _trade(s.strategy, s.ticker, p, s.signal_date, s.signal_price, money.cost, True)
            self.cash += p["shares"] * p["price"] + trade[8] + p["shares"] * p["price"] * money.cost
            yield trade

    def ended(self) -> Iterator[tuple]:
        for ticker, p in sorted(self.held.items()):
            yield _trade(self.last[0], ticker, p, self.last[1], p["price"], self.money.cost, False)


class _Portfolio:
    """Trades of all strategies' signals in order, with a purse for each strategy."""

    def __init__(self, money: Money, shares: Mapping[str, float]) -> None:
        self.money, self.held, self.last = money, {}, None
        self.cash = {k: money.capital * v for k, v in shares.items()}

    def add(self, s) -> Iterator[tuple]:
        money, cash, held = self.money, self.cash, self.held
        self.last, key = s.signal_date, (s.ticker, s.strategy)
        if s.signal_type in ("Buy", "Sell"):
            n = int(cash.get(s.strategy, 0.0) * money.share / s.signal_price)
            if key in held or len(held) >= money.positions or n < 1:
                return
            held[key] = {"side": "long" if s.signal_type == "Buy" else "short", "date": s.signal_date, "price": s.signal_price, "shares": n}
            cash[s.strategy] -= n * s.signal_price
        elif key in held and (held[key]["side"] == "long") == (s.signal_type == "Close Buy"):
            p = held.pop(key)
            trade = _trade(s.strategy, s.ticker, p, s.signal_date, s.signal_price, 0.0, True)
            cash[s.strategy] += p["shares"] * p["price"] + trade[8]
            yield trade

    def ended(self) -> Iterator[tuple]:
        for (ticker, strategy), p in sorted(self.held.items()):
            yield _trade(strategy, ticker, p, self.last, p["price"], 0.0, False)


def _in_order(book: Callable, by: str | None = None):
    """Signals in order -> trades, batch by batch: a new book for each value of `by` (one in all without), which holds open positions only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = lambda trades: pd.DataFrame(trades, columns=[c.split()[0] for c in TRADE.split(", ")])
        now, of = None, None
        for batch in batches:
            trades = []
            for s in batch.itertuples():
                if now is None or by and getattr(s, by) != of:
                    trades += now.ended() if now else ()
                    now, of = book(), getattr(s, by) if by else None
                trades += now.add(s)
            yield table(trades)
        if now:
            yield table(list(now.ended()))

    return run


def simulated(signals: DataFrame, money: Money | None = None) -> DataFrame:
    """The trades of every strategy in standard signals."""
    money = money or Money()
    ordered = signals.repartition("strategy").sortWithinPartitions("strategy", "signal_date", "ticker", "signal_type")
    return ordered.mapInPandas(_in_order(lambda: _Ledger(money), "strategy"), TRADE)


def allocations(signals: DataFrame, by: str = "equal") -> dict[str, float]:
    """Shares of the capital by strategy: equal, or by the number of signals."""
    counted = {r["strategy"]: r["n"] for r in signals.groupBy("strategy").agg(F.count("*").alias("n")).collect()}  # a row for each strategy
    total = sum(counted.values())
    return {k: 1 / len(counted) if by == "equal" else n / total for k, n in counted.items()}


def portfolio(signals: DataFrame, money: Money | None = None, by: str = "equal") -> DataFrame:
    """The trades of all strategies with one limit on positions and a purse for each."""
    money, shares = money or Money(), allocations(signals, by)
    ordered = signals.repartition(1).sortWithinPartitions("signal_date", "strategy", "ticker", "signal_type")
    return ordered.mapInPandas(_in_order(lambda: _Portfolio(money, shares)), TRADE)


def performance(trades: DataFrame) -> DataFrame:
    """strategy, trades, wins, win rate in percent, totals, means, profit factor, Sharpe, Sortino, greatest drawdown and a quality score."""
    pnl, ret = F.col("pnl"), F.col("return_pct")
    running = trades.withColumn("total", F.expr("sum(pnl) over (partition by strategy order by exit_date, entry_date, ticker rows unbounded preceding)"))
    running = running.withColumn("peak", F.expr("greatest(0, max(total) over (partition by strategy order by exit_date, entry_date, ticker rows unbounded preceding))"))
    out = running.groupBy("strategy").agg(
        F.count("*").alias("trades"), F.count_if(pnl > 0).alias("wins"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("mean_pnl"), F.avg(F.when(pnl > 0, pnl)).alias("mean_win"), F.avg(F.when(pnl <= 0, pnl)).alias("mean_loss"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gains"), F.sum(F.when(pnl <= 0, -pnl).otherwise(0.0)).alias("losses"), F.avg("return_pct").alias("mean_return_pct"), F.stddev_samp("return_pct").alias("sd"),
        F.stddev_samp(F.when(ret < 0, ret)).alias("downside"), F.min(F.col("total") - F.col("peak")).alias("drawdown"), F.avg("days").alias("mean_days"),
    )
    return out.withColumns(
        {
            "win_rate_pct": F.col("wins") * 100.0 / F.col("trades"), "profit_factor": F.try_divide("gains", "losses"), "sharpe": F.try_divide("mean_return_pct", "sd") * 252**0.5, "sortino": F.try_divide("mean_return_pct", "downside") * 252**0.5,
            "calmar": F.try_divide("total_pnl", F.abs("drawdown")),
        }
    )


def quality_score(figures: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """figures of performance() with score: returns, Sharpe, win rate and profit factor less drawdown, 0 to 100."""
    text = (
        f"greatest(0, least(100, 0.3 * least(coalesce(total_pnl / {capital} * 100, 0) / 20 * 100, 100) + 0.2 * least(coalesce(sharpe, 0) / 2 * 100, 100) + 0.2 * win_rate_pct"
        f" + 0.15 * least(coalesce(profit_factor, 0) / 3 * 100, 100) - 0.15 * abs(coalesce(drawdown, 0)) / {capital} * 100))"
    )
    return figures.withColumn("score", F.expr(text))


def by_period(trades: DataFrame, period: str = "month") -> DataFrame:
    """strategy, period (month, quarter or weekday of the exit), trades and total."""
    key = {"month": F.date_format("exit_date", "yyyy-MM"), "quarter": F.concat(F.year("exit_date"), F.lit("-Q"), F.quarter("exit_date")), "weekday": F.date_format("exit_date", "EEEE")}[period]
    return trades.groupBy("strategy", key.alias("period")).agg(F.count("*").alias("trades"), F.sum("pnl").alias("total_pnl"))


def risk(trades: DataFrame) -> DataFrame:
    """strategy, skewness, excess kurtosis, 5% value at risk and the mean beyond it, of returns in percent."""
    worst = trades.groupBy("strategy").agg(F.percentile("return_pct", F.lit(0.05)).alias("var_95"))
    joined = trades.join(F.broadcast(worst), "strategy")
    return joined.groupBy("strategy").agg(
        F.skewness("return_pct").alias("skewness"), F.kurtosis("return_pct").alias("kurtosis"), F.first("var_95").alias("var_95"), F.avg(F.when(F.col("return_pct") <= F.col("var_95"), F.col("return_pct"))).alias("cvar_95")
    )


def longest_streaks(trades: DataFrame) -> DataFrame:
    """strategy and its longest rows of wins and of losses."""
    order = "partition by strategy order by exit_date, entry_date, ticker"
    marked = trades.withColumn("won", F.col("pnl") > 0).withColumn("run", F.expr(f"row_number() over ({order}) - row_number() over (partition by strategy, won order by exit_date, entry_date, ticker)"))
    runs = marked.groupBy("strategy", "won", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("strategy").agg(F.coalesce(F.max(F.when(F.col("won"), F.col("n"))), F.lit(0)).alias("wins_in_a_row"), F.coalesce(F.max(F.when(~F.col("won"), F.col("n"))), F.lit(0)).alias("losses_in_a_row"))


def overlaps(signals: DataFrame) -> DataFrame:
    """a, b (a < b), common tickers and the Jaccard similarity of each two strategies' tickers, by counts of common tickers."""
    # Each strategy's signals are made once: a ticker's strategies meet in its own row, each with itself too, which gives the sizes.
    own = signals.groupBy("ticker").agg(F.sort_array(F.collect_set("strategy")).alias("s"))
    met = own.select(F.explode(F.expr("flatten(transform(s, a -> transform(filter(s, b -> a = b or a < b and ticker is not null), b -> struct(a as a, b as b))))")).alias("p"))
    common = met.groupBy("p.a", "p.b").agg(F.count("*").alias("common"))
    common = common.withColumns({f"n_{x}": F.expr(f"max(case when a = b then common end) over (partition by {x})") for x in "ab"})  # a row for each two strategies
    return common.where("a < b").select("a", "b", "common", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))


def t_statistics(trades: DataFrame) -> DataFrame:
    """strategy, n and the t statistic of its mean return against zero."""
    out = trades.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("return_pct").alias("mean"), F.stddev_samp("return_pct").alias("sd"))
    return out.select("strategy", "n", "mean", F.try_divide(F.col("mean"), F.try_divide(F.col("sd"), F.sqrt("n"))).alias("t"))


def analysis_of_variance(trades: DataFrame) -> DataFrame:
    """One row: groups, rows and the F statistic of returns between strategies."""
    groups = trades.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("return_pct").alias("mean"), F.coalesce(F.var_pop("return_pct"), F.lit(0.0)).alias("var"))
    total = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("var")).alias("within"))
    between_ = groups.crossJoin(F.broadcast(total.select(F.col("mean").alias("all")))).agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.col("all"), F.lit(2))).alias("between"))
    both = total.crossJoin(F.broadcast(between_))
    return both.select(F.col("k").alias("groups"), F.col("n").alias("rows"), F.try_divide(F.try_divide(F.col("between"), F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))).alias("f"))


def contributions(trades: DataFrame) -> DataFrame:
    """strategy, trades, total_pnl and its share of all strategies' total in percent (null if that is 0)."""
    own = trades.groupBy("strategy").agg(F.count("*").alias("trades"), F.sum("pnl").alias("total_pnl"))
    return own.withColumn("share_pct", F.try_divide(F.col("total_pnl") * 100, F.expr("sum(total_pnl) over ()")))  # a row a strategy


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + up * d) or tiny), (1 + up / c) or tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a * total


def _tail(of):
    """A column of probabilities from a few columns of figures, a row for each strategy or one in all."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([of(*map(float, row)) if not any(map(pd.isna, row)) else None for row in zip(*columns)], dtype="float64")

    return run


def t_test(trades: DataFrame) -> DataFrame:
    """t_statistics() with the two-sided p value and whether it is below 5% and 1%."""
    p = _tail(lambda t, n: beta_share((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t)))
    out = t_statistics(trades).withColumn("p", F.when(F.col("n") > 1, p("t", F.col("n").cast("double"))))
    return out.withColumns({"significant_5pct": F.col("p") < 0.05, "significant_1pct": F.col("p") < 0.01})


def variance_test(trades: DataFrame) -> DataFrame:
    """analysis_of_variance() with the p value of F and whether it is below 5%."""
    p = _tail(lambda f, k, n: beta_share((n - k) / 2, (k - 1) / 2, (n - k) / (n - k + (k - 1) * f)))
    out = analysis_of_variance(trades)
    out = out.withColumn("p", F.when((F.col("groups") > 1) & (F.col("rows") > F.col("groups")), p("f", F.col("groups").cast("double"), F.col("rows").cast("double"))))
    return out.withColumn("significant_5pct", F.col("p") < 0.05)


def summary(values: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """rows, mean, median, standard deviation, least, greatest and quartiles of a column, in all or by a key."""
    c = F.col(column)
    figures = (F.count(c).alias("rows"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.stddev_samp(c).alias("sd"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.percentile(c, F.lit(0.25)).alias("quartile_1"), F.percentile(c, F.lit(0.75)).alias("quartile_3"))
    return values.groupBy(by).agg(*figures) if by else values.agg(*figures)
