"""Market pulse of an index: risk zones, cycles around an average, follow-through and distribution days, and market indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.windows import highest, island, lag, lowest, rows, sma
from ..sources.bars import latest
from . import asof
from .screens import layered

#: Risk zones, from best to worst.
ZONES = ("DARK_GREEN", "LIGHT_GREEN", "YELLOW", "LIGHT_RED", "DARK_RED")
ZONE_LAYERS = (
    {"fast": sma("close", 10), "slow": sma("close", 20)},
    {"fast_up": f"coalesce(fast > {lag('fast', 5)}, false)", "slow_up": f"coalesce(slow > {lag('slow', 5)}, false)"},
    {"zone": "case when coalesce(fast > slow, false) then case when fast_up and slow_up then 'DARK_GREEN' when fast_up then 'LIGHT_GREEN' else 'YELLOW' end when fast_up then 'LIGHT_RED' else 'DARK_RED' end"},
)
#: A run's reference is its average on the first bar; distances are of highs above it, or of lows below it.
CYCLE_LAYERS = (
    {"average": sma("close", 20)},
    {"cycle": "case when average is null then null when close > average then 'Bull' else 'Bear' end"},
    {"starts": f"case when cycle is not null and cycle <> coalesce({lag('cycle')}, '') then 1 else 0 end"},
    {"number": f"sum(starts) over {rows(None)}"},
)
CYCLE = "partition by ticker, number order by date"
RUN_LAYERS = (
    {"crossing": f"first_value(average) over ({CYCLE})"},
    {"distance_pct": "greatest(0, case when cycle = 'Bull' then high - crossing else crossing - low end / nullif(crossing, 0) * 100)"},
)
#: Change in percent and volume against its 50-bar mean of follow-through and of distribution days.
FOLLOW, DISTRIBUTION = (1.5, 1.25), (-0.2, 1.20)
DAY_LAYERS = (
    {"change_pct": f"(close / nullif({lag('close')}, 0) - 1) * 100", "mean_volume": f"case when count(volume) over {rows(49)} >= 10 then avg(volume) over {rows(49)} end", "back": "row_number() over (partition by ticker order by date desc)"},
    {"volume_ratio": "volume / nullif(mean_volume, 0)"},
    {
        "day": f"case when back <= 50 and volume_ratio >= {FOLLOW[1]} and change_pct >= {FOLLOW[0]} then 'FTD' when back <= 50 and volume_ratio >= {DISTRIBUTION[1]} and change_pct <= {DISTRIBUTION[0]} then 'DD' end"
    },
)
STATE = (
    "case when ftd >= 2 and dd <= 1 then 'Confirmed Uptrend' when ftd >= 1 and dd <= 2 then 'Uptrend' when dd >= 3 and ftd = 0 then 'Under Pressure'"
    " when dd >= 5 then 'Correction' else 'Neutral' end"
)


def zones(bars: DataFrame) -> DataFrame:
    """bars with fast and slow averages, whether each is higher than five bars ago, and the zone."""
    return layered(bars, ZONE_LAYERS)


def zone_statistics(bars: DataFrame) -> DataFrame:
    """ticker, days, days of each zone and the share of the two best and two worst in percent."""
    known = zones(bars)
    days = {f"{z.lower()}_days": F.count_if(F.col("zone") == z) for z in ZONES}
    out = known.groupBy("ticker").agg(F.count("*").alias("days"), *(v.alias(k) for k, v in days.items()))
    return out.withColumns({"bullish_pct": F.expr("(dark_green_days + light_green_days) * 100e0 / days"), "bearish_pct": F.expr("(light_red_days + dark_red_days) * 100e0 / days")})


def cycles(bars: DataFrame) -> DataFrame:
    """A row for each run of closes on one side of the average: its dates, bars, farthest distance in percent, peak and trough."""
    rows_ = layered(layered(bars, CYCLE_LAYERS).where("cycle is not null"), RUN_LAYERS)
    return rows_.groupBy("ticker", "number", "cycle").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("candles"), F.max("distance_pct").alias("farthest_pct"), F.max("high").alias("peak"), F.min("low").alias("trough")
    )


def cycle_statistics(bars: DataFrame) -> DataFrame:
    """ticker, cycle, how many runs, the longest and mean length and the farthest distance."""
    return cycles(bars).groupBy("ticker", "cycle").agg(F.count("*").alias("cycles"), F.max("candles").alias("longest"), F.avg("candles").alias("mean_candles"), F.max("farthest_pct").alias("farthest_pct"))


def special_days(bars: DataFrame) -> DataFrame:
    """Follow-through and distribution days of the last 50 bars."""
    return layered(bars, DAY_LAYERS).where("day is not null").select("ticker", "date", "close", "change_pct", "volume_ratio", "day")


def market_state(bars: DataFrame, recent_days: int = 25) -> DataFrame:
    """ticker, counts of both kinds of days within so many calendar days before the last bar, and the state."""
    days = layered(bars, DAY_LAYERS).join(bars.groupBy("ticker").agg(F.max("date").alias("as_of")), "ticker")
    recent = F.datediff("as_of", "date") <= recent_days
    out = days.groupBy("ticker").agg(F.count_if(recent & (F.col("day") == "FTD")).alias("ftd"), F.count_if(recent & (F.col("day") == "DD")).alias("dd"))
    return out.withColumn("state", F.expr(STATE))


def _flag(c: str) -> str:
    return f"case when {c} then 1 else 0 end"


def _average_score(n: int) -> dict[str, str]:
    return {f"sma_{n}": sma("close", n)}


def _half_points(n: int) -> str:
    """Half a point for a close above an average, half for the average rising."""
    return f"({_flag(f'close > sma_{n}')} + {_flag(f'sma_{n} > {lag(f"sma_{n}")}')}) * 0.5"


INDEX_AVERAGES = (10, 20, 50, 150)
K = "coalesce(100 * (close - {low}) / nullif({high} - {low}, 0), 0)".format(low=lowest("low", 10), high=highest("high", 10))
INDEX_LAYERS = (
    {k: v for n in INDEX_AVERAGES for k, v in _average_score(n).items()} | {"raw_k": K},
    {f"r{i}": _half_points(n) for i, n in enumerate(INDEX_AVERAGES, 1)} | {"slow_k": f"avg(raw_k) over {rows(3)}"},
    {"fast_k": f"avg(slow_k) over {rows(3)}"},
    {"r5": _flag("fast_k > slow_k or fast_k > 80"), "r6": _flag("close > sma_50")},
    {"score": "r1 + r2 + r3 + r4 + r5 + r6"},
)


def index_scores(bars: DataFrame, green: float = 5.0, red: float = 3.0) -> DataFrame:
    """The last bar's points of each index for its averages, its stochastic and its trend, and a light."""
    out = latest(layered(bars, INDEX_LAYERS))
    light = F.when(F.col("score") >= green, "GREEN").when(F.col("score") <= red, "RED").otherwise("YELLOW")
    return out.select("ticker", "date", "close", *(f"r{i}" for i in range(1, 7)), "score", light.alias("light"))


def general_market(breadth: DataFrame, index: DataFrame, threshold: float = 3.0) -> DataFrame:
    """The general market index: breadth success and points of the index's averages, by date, and GREEN from a threshold on.

    breadth: date, long_success, net_long_new_highs. index: bars of one index.
    """
    scored = layered(index, ({"sma_50": sma("close", 50), "sma_150": sma("close", 150)}, {"r3": _half_points(50), "r4": _half_points(150), "r5": _flag("close > sma_50")}))
    joined = scored.join(breadth.select("date", F.col("long_success").cast("double").alias("r1"), F.expr(_flag("net_long_new_highs > 0")).cast("double").alias("r2")), "date")
    out = joined.withColumn("score", F.expr("r1 + r2 + r3 + r4 + r5"))
    return out.select("date", "r1", "r2", "r3", "r4", "r5", "score", F.when(F.col("score") >= threshold, "GREEN").otherwise("RED").alias("light"))


def longest_runs(bars: DataFrame, condition: str, name: str = "longest") -> DataFrame:
    """ticker and the longest run of bars in a row that meet a condition."""
    marked = bars.withColumn("run", F.expr(island(condition)))
    counted = marked.where(F.expr(condition)).groupBy("ticker", "run").agg(F.count("*").alias("n"))
    return bars.select("ticker").distinct().join(counted.groupBy("ticker").agg(F.max("n").alias(name)), "ticker", "left").fillna(0, [name])


def as_of(rows_: DataFrame, other: DataFrame, columns: list[str], date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """rows_ with the columns of other's last row on or before each date, of equal `by` if there are some."""
    return asof.as_of(rows_, other, columns, by, date)


def overview(indexes: DataFrame, breadth: DataFrame, recent_days: int = 25) -> DataFrame:
    """A row for each index with what all parts of the market pulse say of it.

    indexes: bars of the indexes; breadth: date, net_advances. Columns: ticker, date and close of the last bar; score and light of its
    points (index_scores) and of its requirements (index_requirements); follow-through and distribution days and the state (market_state); the
    zone of its averages; the side of its average it is on, since when, and for how many bars. What an index is too short for is null.
    """
    points = index_scores(indexes).select("ticker", "date", "close", F.col("score").cast("double").alias("score"), "light")
    required = index_requirements(indexes, breadth).select("ticker", F.col("score").alias("requirements"), F.col("light").alias("requirements_light"))
    zone = latest(zones(indexes).select("ticker", "date", "zone")).select("ticker", "zone")
    run = cycles(indexes).groupBy("ticker").agg(F.max_by(F.struct("cycle", "first", "candles"), "last").alias("r")).select("ticker", "r.cycle", F.col("r.first").alias("since"), F.col("r.candles").alias("candles"))
    out = points
    for part in (required, market_state(indexes, recent_days), zone, run):
        out = out.join(part, "ticker", "left")
    return out


#: Highs that count as many, for the second requirement.
MANY_HIGHS = 100


def general_market_index(breadth: DataFrame, first: DataFrame, second: DataFrame, growth: DataFrame, threshold: float = 3.0, many: int = MANY_HIGHS) -> DataFrame:
    """One row: date, r1 to r6, score and light of the general market index.

    breadth: date, long_success (ten-day success of many new highs) and long_new_highs. The date is that of
    the last breadth row, but no later than the last bar of any index; breadth and indexes give their last
    row on or before it. r1: success; r2: more than `many` new highs; r3: the first index against its
    50-bar average; r4 and r5: the second against 50 and 150 bars; r6: the growth index above its 50-bar average.
    """
    points = lambda bars, n: layered(bars, ({"average": sma("close", n)}, {"points": _half_points(n).replace(f"sma_{n}", "average")}))
    ends = [bars.agg(F.max("date").alias("end")) for bars in (first, second, growth)]
    target = breadth.agg(F.max("date").alias("end"))
    for end in ends:
        target = target.unionByName(end)
    target = target.agg(F.min("end").alias("target"))

    def last(rows_: DataFrame, *columns) -> DataFrame:
        kept = rows_.join(F.broadcast(target), rows_["date"] <= F.col("target"))
        return kept.agg(*(F.max_by(c, "date").alias(name) for name, c in columns))

    parts = [
        last(breadth, ("r1", F.expr(_flag("long_success > 0")).cast("double")), ("r2", F.expr(_flag(f"long_new_highs > {many}")).cast("double"))),
        last(points(first, 50), ("r3", F.col("points"))), last(points(second, 50), ("r4", F.col("points"))), last(points(second, 150), ("r5", F.col("points"))),
        last(layered(growth, ({"average": sma("close", 50)},)), ("r6", F.expr(_flag("close > average")).cast("double"))),
    ]
    out = target.withColumnRenamed("target", "date")
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    out = out.withColumns({f"r{i}": F.coalesce(f"r{i}", F.lit(0.0)) for i in range(1, 7)}).withColumn("score", F.expr("r1 + r2 + r3 + r4 + r5 + r6"))
    return out.withColumn("light", F.when(F.col("score") >= threshold, "GREEN").otherwise("RED"))


REQUIREMENT_LAYERS = (
    {f"sma_{n}": sma("close", n) for n in INDEX_AVERAGES} | {"raw_k": K},
    {f"slow_k": f"coalesce(case when count(raw_k) over {rows(3)} = 4 then avg(raw_k) over {rows(3)} end, 0)"},
    {"fast_k": f"coalesce(case when count(slow_k) over {rows(3)} = 4 then avg(slow_k) over {rows(3)} end, 0)"},
    {
        "r2": _half_points(50), "r3": _half_points(20), "r4": _half_points(10), "r5": f"{_flag('sma_20 > sma_50 and sma_50 > sma_150')} * 1.0", "r6": f"{_flag('slow_k < 20')} * 1.0", "r7": "0.0",
        "r8": f"{_flag('fast_k > slow_k or fast_k > 80')} * 1.0", "r9": f"{_flag('slow_k <= 20')} * 1.0",
    },
)


def index_requirements(bars: DataFrame, breadth: DataFrame, threshold: float = 5.0) -> DataFrame:
    """ticker, date, r1 to r9, score and light of each index at its last bar.

    breadth: date, net_advances. r1: more advances than declines on the last date of breadth up to the bar's;
    r2 to r4: 50, 20 and 10 bars; r5: averages in line; r6 and r9: an oversold stochastic; r7 is always 0;
    r8: the fast stochastic above the slow one or above 80. NEUTRAL lies between the threshold and two below it.
    """
    last = latest(layered(bars, REQUIREMENT_LAYERS)).select("ticker", "date", *(F.col(f"r{i}").cast("double").alias(f"r{i}") for i in range(2, 10)))
    dated = breadth.select(F.col("date").alias("day"), "net_advances")
    advances = last.select("ticker", "date").join(dated, F.col("day") <= F.col("date")).groupBy("ticker").agg(F.max_by("net_advances", "day").alias("net_advances"))  # a row an index and date
    out = last.join(advances, "ticker", "left").withColumn("r1", F.expr(_flag("net_advances > 0")).cast("double"))
    out = out.withColumn("score", sum((F.col(f"r{i}") for i in range(1, 10)), F.lit(0.0)))
    light = F.when(F.col("score") >= threshold, "GREEN").when(F.col("score") <= threshold - 2, "RED").otherwise("NEUTRAL")
    return out.select("ticker", "date", *(f"r{i}" for i in range(1, 10)), "score", light.alias("light"))


def mean_requirements(requirements: DataFrame, threshold: float = 5.0) -> DataFrame:
    """One row over all indexes: the means of r1 to r5 (the others count only for one index), score and light."""
    out = requirements.agg(F.max("date").alias("date"), F.count("*").alias("indexes"), *(F.avg(f"r{i}").alias(f"r{i}") for i in range(1, 6))).withColumn("score", F.expr("r1 + r2 + r3 + r4 + r5"))
    return out.withColumn("light", F.when(F.col("score") >= threshold, "GREEN").when(F.col("score") <= threshold - 2, "RED").otherwise("NEUTRAL"))
