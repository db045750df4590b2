"""Alert rules over sampled series ``key, step, value``, calibration, and triage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .changepoint import trace
from .windows import finite_only, islands


def sustained(series: DataFrame, flag: Column, samples: int) -> DataFrame:
    """Runs of at least ``samples`` samples in a row where ``flag`` holds: ``key, first, last, n``."""
    return islands(series.select("key", "step", F.coalesce(flag, F.lit(False)).alias("flag")), "key", "step").where(F.col("n") >= samples)


def increase(series: DataFrame, span: int) -> DataFrame:
    """Growth of a counter over the last ``span`` steps; a fall is a restart from 0. Without an earlier sample there is none."""
    order = Window.partitionBy("key").orderBy("step")
    before = F.lag("value").over(order)
    grown = F.when(before.isNull(), None).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    df = series.withColumn("grown", grown)
    return df.withColumn("increase", F.sum("grown").over(order.rangeBetween(-span + 1, 0)))


def calibrate(windows: DataFrame, method: str, split: float = 0.6, margin: float = 3.0, patience: float = 5.0) -> DataFrame:
    """Slack and threshold of each metric from its clean windows, and alarms on those held out.

    The first share of a metric's windows fits: the slack is what the largest mean has
    over the median, the threshold several times the highest statistic that clean windows
    reach with that slack.
    """
    n = F.count("*").over(Window.partitionBy("metric"))
    k = F.row_number().over(Window.partitionBy("metric").orderBy("step"))
    df = finite_only(windows).withColumns({"k": k, "n": n}).withColumn("fit", F.col("k") <= F.floor(F.col("n") * split))
    fit, held = df.where("fit").select("metric", "step", "value"), df.where("NOT fit").select("metric", "step", "value")
    slack = fit.groupBy("metric").agg((F.max("value") - F.median("value")).alias("delta"))
    gate = slack.select("metric", F.lit(method).alias("method"), F.lit(1e12).alias("threshold"), "delta", F.lit(1).alias("debounce"), F.lit(0).alias("cooldown"))
    peak = trace(fit, gate).groupBy("metric").agg(F.max("statistic").alias("peak"))
    chosen = gate.drop("threshold").join(peak, "metric").withColumn("threshold", F.greatest(F.col("peak") * margin, F.col("delta") * patience))
    alarms = trace(held, chosen.where("threshold > 0").select("metric", "method", "threshold", "delta", "debounce", "cooldown")).groupBy("metric").agg(F.count_if("alarm").alias("alarms"))
    return chosen.join(alarms, "metric", "left").select("metric", "delta", "threshold", F.coalesce("alarms", F.lit(0)).alias("alarms"))


def triage(up: DataFrame) -> DataFrame:
    """What a combination of moved metric families suggests: ``step, entropy, js, embedding`` are -1, 0 or 1.

    ``sharp`` (optional) says that they moved at one timestamp.  One metric that goes up
    alone speaks against the monitor; one that goes down alone says nothing.
    """
    e, j, m = F.col("entropy"), F.col("js"), F.col("embedding")
    sharp = F.coalesce(F.col("sharp"), F.lit(False)) if "sharp" in up.columns else F.lit(False)
    alone = sum(((x > 0).cast("int") for x in (j, m)), (e > 0).cast("int")) == 1
    flat = sum(((x == 0).cast("int") for x in (j, m)), (e == 0).cast("int")) == 2
    says = (
        F.when((m > 0) & (e > 0) & (j > 0) & sharp, "deploy").when((m > 0) & (e > 0) & (j > 0), "everything moved").when((m > 0) & (e > 0), "covariate shift").when((m > 0) & (e == 0) & (j == 0), "input moved")
        .when((j > 0) & (e < 0) & (m == 0), "prediction collapse").when(alone & flat, "suspect the monitor").when((e == 0) & (j == 0) & (m == 0), "quiet")
    )
    return up.withColumn("pattern", F.coalesce(says, F.lit("unclear")))


#: Seconds after which a series without a new sample is gone, and the range of rates. Fixed values.
STALE, RATE = 300, 300


@dataclass(frozen=True)
class Rule:
    """An alert rule: its series, what has to hold, and for how many seconds."""

    metric: str
    seconds: int
    severity: str = "warning"
    kind: str = "level"
    op: str = ">"
    bound: float = 0.0


#: The shipped rules. Fixed values.
RULES = {
    "drift": Rule("drift_alert", 600, op="=", bound=1),
    "multi_detector": Rule("drift_alert", 600, kind="sum", op=">=", bound=2),
    "disabled": Rule("detectors_disabled", 900, "critical"),
    "failing": Rule("detector_failures_total", 600, kind="rate"),
    "summaries": Rule("summaries_dropped_total", 900, kind="rate"),
    "observations": Rule("observations_dropped_total", 600, kind="rate"),
    "not_observing": Rule("steps_observed_total", 900, "critical", "rate", "="),
    "overhead_regression": Rule("monitor_overhead_us", 1800, kind="yesterday", bound=2),
    "overhead_high": Rule("monitor_overhead_us", 1800, bound=250),
    "ring": Rule("ring_utilization", 900, bound=0.9),
}
SERIES = ("instance", "detector")


def rates(series: DataFrame, span: int = RATE) -> DataFrame:
    """``increase`` of counters over the ``span`` seconds before each sample; a fall is a restart; null with one sample only."""
    order = Window.partitionBy(*SERIES).orderBy("ts")
    before = F.lag("value").over(order)
    grown = F.when(before.isNull(), F.lit(0.0)).when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    df = series.withColumn("grown", grown)
    near = order.rangeBetween(-span + 1, 0)
    # the first sample in range has no other to grow from
    return df.withColumn("increase", F.when(F.count("*").over(near) >= 2, F.sum("grown").over(near) - F.first("grown").over(near))).drop("grown")


def holds(samples: DataFrame, rule: Rule) -> DataFrame:
    """``instance, detector, ts, flag`` for each sample of the rule's series in ``name, instance, detector, ts, value``."""
    own = samples.where(F.col("name") == rule.metric)
    if rule.kind == "sum":
        own = own.groupBy("instance", "ts").agg(F.sum("value").alias("x")).withColumn("detector", F.lit(None).cast("string"))
    elif rule.kind == "rate":
        own = rates(own).withColumn("x", F.col("increase"))
    elif rule.kind == "yesterday":
        hour = Window.partitionBy(*SERIES).orderBy("ts").rangeBetween(-86_400 - 3_599, -86_400)
        own = own.withColumn("x", F.col("value") / F.avg("value").over(hour))
    else:
        own = own.withColumn("x", F.col("value"))
    flag = {">": F.col("x") > rule.bound, ">=": F.col("x") >= rule.bound, "=": F.col("x") == rule.bound}[rule.op]
    return own.select(*SERIES, "ts", F.coalesce(flag, F.lit(False)).alias("flag"))


def firing(flags: DataFrame, seconds: int) -> DataFrame:
    """``instance, detector, since, fired, last`` of each run of true flags that lasts: it begins pending and fires after ``seconds``.

    A gap of more than ``STALE`` seconds ends a run.
    """
    order = Window.partitionBy(*SERIES).orderBy("ts")
    new = F.coalesce(~F.lag("flag").over(order) | (F.col("ts") - F.lag("ts").over(order) > STALE), F.lit(True))
    runs = flags.withColumn("new", (new & F.col("flag")).cast("int")).withColumn("run", F.sum("new").over(order)).where("flag")
    since = F.min("ts").over(Window.partitionBy(*SERIES, "run"))
    runs = runs.withColumn("since", since)
    out = runs.groupBy(*SERIES, "run", "since").agg(F.min(F.when(F.col("ts") - F.col("since") >= seconds, F.col("ts"))).alias("fired"), F.max("ts").alias("last"))
    return out.where("fired IS NOT NULL").select(*SERIES, "since", "fired", "last")
