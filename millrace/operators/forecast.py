"""Exponential smoothing, forecasts and back-tests of which no task walks a series; seasonal decomposition.

Smoothing with a level l and a damped trend b,

    l' = alpha y + (1 - alpha) (l + phi b)
    b' = beta (l' - l) + (1 - beta) phi b,

is an affine map of (l, b) for each observation, and such maps compose. So the
rows of a series are cut into blocks by rank; each block's map is composed in
its own task, the blocks' maps are scanned the same way (in blocks of blocks, if
there are many), and each block then walks its rows from its own start.

A series starts at its first observation without a trend. Rows with a missing
value, time or key are left out; rows of one time go by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.storage import stored
from millrace.operators.ranges import numbered

#: Rows that a block walks.
BLOCK = 256
#: An affine map: (l, b) becomes (ll l + lb b + l0, bl l + bb b + b0).
FIELDS = ("ll", "lb", "bl", "bb", "l0", "b0")


def _map(**values: Column) -> Column:
    return F.struct(*(values[f].alias(f) for f in FIELDS))


def _identity() -> Column:
    return _map(ll=F.lit(1.0), lb=F.lit(0.0), bl=F.lit(0.0), bb=F.lit(1.0), l0=F.lit(0.0), b0=F.lit(0.0))


def _then(m: Column, n: Column) -> Column:
    """m, and then n."""
    row = lambda l, b: {"l": n[l] * m["ll"] + n[b] * m["bl"], "b": n[l] * m["lb"] + n[b] * m["bb"], "0": n[l] * m["l0"] + n[b] * m["b0"]}  # noqa: E741, E731
    level, trend = row("ll", "lb"), row("bl", "bb")
    return _map(ll=level["l"], lb=level["b"], bl=trend["l"], bb=trend["b"], l0=level["0"] + n["l0"], b0=trend["0"] + n["b0"])


def observed(value: Column, alpha: float, beta: float, phi: float) -> Column:
    """The map of one observation."""
    a, ab = alpha, alpha * beta
    return _map(ll=F.lit(1 - a), lb=F.lit((1 - a) * phi), bl=F.lit(-ab), bb=F.lit(phi * (1 - ab)), l0=a * value, b0=ab * value)


def _running(maps: Column) -> Column:
    """For each of an array of maps, the composition of those before it; the last is that of all."""
    start = F.struct(_identity().alias("now"), F.array(_identity()).alias("all"))
    step = lambda s, m: F.struct(_then(s["now"], m).alias("now"), F.concat(s["all"], F.array(_then(s["now"], m))).alias("all"))
    return F.aggregate(maps, start, step, lambda s: s["all"])


def _starts(maps: DataFrame, largest: int, size: int) -> DataFrame:
    """(series, place, start): the composition of the maps (series, place, map) before each place."""
    blocks = maps.groupBy("series", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "map"))).alias("rows"))
    blocks = blocks.withColumn("running", _running(F.transform("rows", lambda r: r["map"])))
    if largest <= size:
        return blocks.select("series", F.inline(F.arrays_zip(F.col("rows.place").alias("place"), F.slice("running", 1, F.size("rows")).alias("start"))))
    blocks = stored(blocks.select("series", "block", F.col("rows.place").alias("places"), "running"))
    upper = blocks.select("series", F.col("block").alias("place"), F.element_at("running", -1).alias("map"))
    starts = _starts(upper, -(-largest // size), size).withColumnsRenamed({"series": "_series", "place": "_block", "start": "_start"})
    joined = blocks.join(starts, F.col("series").eqNullSafe(F.col("_series")) & (F.col("block") == F.col("_block")))
    within = F.transform(F.slice("running", 1, F.size("places")), lambda m: _then(F.col("_start"), m))
    return joined.select("series", F.inline(F.arrays_zip(F.col("places").alias("place"), within.alias("start"))))


def _ranked(df: DataFrame, value: str, time: str, key: str, by: str | None) -> DataFrame:
    """(series, place, time, key, value): the observations of each series in order."""
    series = F.col(by) if by else F.lit(0)
    rows = df.select(series.alias("series"), F.col(time).alias("time"), F.col(key).alias("key"), F.col(value).cast("double").alias("value")).dropna("any", subset=["time", "key", "value"])
    return numbered(rows, ["time", "key"], ["series"]).withColumnRenamed("_rank", "place")


def smoothed(df: DataFrame, value: str, time: str, key: str, by: str | None = None, alpha: float = 0.3, beta: float = 0.1, phi: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(series, place, time, key, value, forecast, level, trend): the forecast made before each observation (null for the first), and the state after it."""
    if not (0 <= alpha <= 1 and 0 <= beta <= 1 and 0 < phi <= 1):
        raise ValueError("alpha and beta are from 0 to 1, phi is above 0 and at most 1")
    rows = F.sort_array(F.collect_list(F.struct("place", "time", "key", "value"))).alias("rows")
    blocks = _ranked(df, value, time, key, by).groupBy("series", F.floor(F.col("place") / block).alias("block")).agg(rows)
    folded = F.aggregate("rows", _identity(), lambda m, r: _then(m, observed(r["value"], alpha, beta, phi)))
    blocks = stored(blocks.withColumn("map", folded))
    largest = (blocks.agg(F.max("block").alias("n")).first()["n"] or 0) + 1
    starts = _starts(blocks.select("series", F.col("block").alias("place"), "map"), largest, block)
    first = blocks.where("block = 0").select(F.col("series").alias("_of"), F.get("rows", F.lit(0))["value"].alias("_first"))
    # The state before a block: what the maps so far make of the first observation, without a trend.
    state = F.struct((F.col("start.ll") * F.col("_first") + F.col("start.l0")).alias("l"), (F.col("start.bl") * F.col("_first") + F.col("start.b0")).alias("b"))
    begun = starts.join(first, F.col("series").eqNullSafe(F.col("_of"))).select(F.col("series").alias("_series"), F.col("place").alias("_block"), state.alias("_state"))
    joined = blocks.join(begun, F.col("series").eqNullSafe(F.col("_series")) & (F.col("block") == F.col("_block")))
    walk = F.aggregate("rows", F.struct(F.col("_state").alias("now"), F.array().cast(WALKED).alias("all")), lambda s, r: _walked(s, r, alpha, beta, phi), lambda s: s["all"])
    zipped = joined.select("series", F.inline(F.arrays_zip(F.col("rows").alias("r"), walk.alias("w"))))
    forecast = F.when(F.col("r.place") > 0, F.col("w.forecast")).alias("forecast")
    return zipped.select("series", "r.place", "r.time", "r.key", "r.value", forecast, "w.level", "w.trend")


WALKED = "array<struct<forecast:double,level:double,trend:double>>"


def _walked(s: Column, r: Column, alpha: float, beta: float, phi: float) -> Column:
    ahead = s["now"]["l"] + phi * s["now"]["b"]
    level = alpha * r["value"] + (1 - alpha) * ahead
    trend = beta * (level - s["now"]["l"]) + (1 - beta) * phi * s["now"]["b"]
    now = F.struct(level.alias("l"), trend.alias("b"))
    return F.struct(now.alias("now"), F.concat(s["all"], F.array(F.struct(ahead.alias("forecast"), level.alias("level"), trend.alias("trend")))).alias("all"))


def _ahead(horizon: int, phi: float) -> Column:
    """(h, forecast) of a state for each number of steps: the trend is damped with every step."""
    sums = [sum(phi**i for i in range(1, h + 1)) for h in range(1, horizon + 1)]
    return F.array(*(F.struct(F.lit(h).alias("h"), (F.col("level") + s * F.col("trend")).alias("forecast")) for h, s in enumerate(sums, 1)))


def forecasts(states: DataFrame, horizon: int, phi: float = 1.0) -> DataFrame:
    """(series, h, forecast) from the last state of each series."""
    last = states.groupBy("series").agg(F.max_by(F.struct("level", "trend"), "place").alias("last")).select("series", "last.*")
    return last.select("series", F.inline(_ahead(horizon, phi)))


def backtest(states: DataFrame, horizon: int, phi: float = 1.0, warm: int = 10) -> DataFrame:
    """(series, h, n, mae, rmse, mape): errors of the forecasts that each state from the ``warm``-th on makes, by steps ahead.

    MAPE is in per cent and leaves out observations of 0. Every observation meets the forecasts of it on its series and place.
    """
    held = stored(states)
    made = held.where(F.col("place") >= warm - 1).select("series", "place", F.inline(_ahead(horizon, phi)))
    made = made.select(F.col("series").alias("_series"), (F.col("place") + F.col("h")).alias("_place"), "h", "forecast")
    both = held.select("series", "place", "value").join(made, F.col("series").eqNullSafe(F.col("_series")) & (F.col("place") == F.col("_place")))
    error = F.abs(F.col("value") - F.col("forecast"))
    return both.groupBy("series", "h").agg(
        F.count("*").alias("n"), F.avg(error).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (100 * F.avg(error / F.abs(F.nullif(F.col("value"), F.lit(0.0))))).alias("mape"),
    )


def decomposed(df: DataFrame, value: str, time: str, key: str, period: int, by: str | None = None, multiplicative: bool = False, block: int = BLOCK) -> DataFrame:
    """(series, place, time, key, value, trend, season, rest): value = trend + season + rest, or their product.

    The trend is a centred mean over one period (an even period's outermost two count half), null where it would reach beyond
    the series. The season is each phase's mean of what is left, centred; with ``multiplicative`` what is left is a ratio.
    Blocks of ranks carry as many neighbours on both sides as the mean reaches, so a series is spread over all tasks.
    """
    if period < 2:
        raise ValueError("a period has at least two observations")
    half, size = period // 2, max(block, period)
    rows = _ranked(df, value, time, key, by)
    home = F.floor(F.col("place") / size)
    seen = F.array_distinct(F.array(F.floor((F.col("place") - half) / size), home, F.floor((F.col("place") + half) / size)))
    dealt = rows.withColumn("_home", home).withColumn("_block", F.explode(F.filter(seen, lambda b: b >= 0)))
    near = W.partitionBy("series", "_block").orderBy("place")
    view = near.rowsBetween(-half, half)
    total = F.sum("value").over(view)
    if period % 2 == 0:
        total = total - (F.lag("value", half).over(near) + F.lead("value", half).over(near)) / 2
    trend = F.when(F.count("value").over(view) == 2 * half + 1, total / period)
    out = dealt.withColumn("trend", trend).where("_block = _home").drop("_block", "_home")
    left = F.try_divide(F.col("value"), F.col("trend")) if multiplicative else F.col("value") - F.col("trend")
    out = stored(out.withColumn("_left", left).withColumn("_phase", F.col("place") % period))
    phases = out.groupBy("series", "_phase").agg(F.avg("_left").alias("m"))
    mean = F.avg("m").over(W.partitionBy("series"))
    season = F.try_divide(F.col("m"), mean) if multiplicative else F.col("m") - mean
    # As many rows as series and phases; stored, so that Spark knows its size when it plans the join.
    phases = stored(phases.select(F.col("series").alias("_series"), F.col("_phase").alias("_p"), season.alias("season")))
    joined = out.join(phases, F.col("series").eqNullSafe(F.col("_series")) & (F.col("_phase") == F.col("_p")))
    rest = F.try_divide(F.col("_left"), F.col("season")) if multiplicative else F.col("_left") - F.col("season")
    return joined.select("series", "place", "time", "key", "value", "trend", "season", rest.alias("rest"))
