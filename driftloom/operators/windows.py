"""Count-based windows, latches and edges over metric streams ``(metric, step, value)``.

Streams are what is left after reduction to steps; one metric's stream is ordered by step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite


def finite_only(stream: DataFrame) -> DataFrame:
    return stream.where(finite(F.col("value")))


def skipped(stream: DataFrame) -> DataFrame:
    """Values that are there but not finite, a row a metric."""
    return stream.groupBy("metric").agg(F.count_if(F.col("value").isNotNull() & ~finite(F.col("value"))).alias("skipped"))


def rolling_mean(stream: DataFrame, window: int) -> DataFrame:
    """Mean of the last ``window`` finite values, partial at the start."""
    w = Window.partitionBy("metric").orderBy("step").rowsBetween(-(window - 1), 0)
    return finite_only(stream).select("metric", "step", F.avg("value").over(w).alias("rolling"))


def tumbling_mean(stream: DataFrame, window: int) -> DataFrame:
    """Means of each ``window`` finite values, at the step that closes them; an unfinished tail gives none."""
    rn = F.row_number().over(Window.partitionBy("metric").orderBy("step"))
    block = finite_only(stream).withColumn("k", F.floor((rn - 1) / window))
    closed = block.groupBy("metric", "k").agg(F.max("step").alias("step"), F.avg("value").alias("value"), F.count("*").alias("n")).where(F.col("n") == window)
    return closed.select("metric", "k", "step", "value")


def hold_last(column: str, partition: Column, order: str) -> Column:
    """The latest value that is not null."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def latch(steps: DataFrame, alarms: DataFrame, window: int, hold: int) -> DataFrame:
    """``metric, step, active``: an alarm holds until ``hold`` boundaries of ``window`` steps have passed.

    Boundaries count steps of the whole stream, not values of a metric.
    """
    grid = steps.select("step").distinct().join(F.broadcast(alarms.select("metric").distinct()))  # metrics are few and named
    fired = grid.join(alarms.select("metric", "step", F.col("step").alias("fired")), ["metric", "step"], "left")
    last = hold_last("fired", F.col("metric"), "step")
    passed = F.floor((F.col("step") + 1) / window) - F.floor((F.col("last") + 1) / window)
    return fired.withColumn("last", last).select("metric", "step", F.coalesce(passed < hold, F.lit(False)).alias("active"))


def detector_state(latched: DataFrame, dim: DataFrame) -> DataFrame:
    """A detector is active while one of its metrics is."""
    own = latched.join(F.broadcast(dim), "metric", "left").withColumn("detector", F.coalesce("detector", "metric"))
    return own.groupBy("detector", "step").agg(F.bool_or("active").alias("active"))


def edges(state: DataFrame) -> DataFrame:
    """Steps where a detector's state changes; before the first step it is off."""
    before = F.lag("active", 1, False).over(Window.partitionBy("detector").orderBy("step"))
    return state.withColumn("before", before).where("active <> before").select("detector", "step", "active")


def counter_delta(counts: DataFrame) -> DataFrame:
    """Increase of a running counter since the step before, not below 0."""
    before = F.lag("total", 1, 0).over(Window.partitionBy("name").orderBy("step"))
    return counts.select("name", "step", F.greatest(F.col("total") - before, F.lit(0)).alias("delta"))


def snapshot(rolling: DataFrame) -> DataFrame:
    """Latest rolling mean of each metric."""
    return rolling.groupBy("metric").agg(F.max_by("rolling", "step").alias("rolling"))


def islands(flags: DataFrame, key: str, order: str) -> DataFrame:
    """Runs of true ``flag``: first, last and length."""
    w = Window.partitionBy(key).orderBy(order)
    run = F.row_number().over(w) - F.sum(F.col("flag").cast("int")).over(w)
    return flags.withColumn("run", run).where("flag").groupBy(key, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def ema(stream: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average that starts at 0, one ordered pass over each metric."""
    from .changepoint import ordered_fold

    def step(state: list, r) -> tuple:
        state[0] += alpha * (r.value - state[0])
        return r.metric, r.step, state[0]

    return ordered_fold(finite_only(stream), "metric", "step", lambda r: [0.0], step, "metric string, step long, ema double")
