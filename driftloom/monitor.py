"""A monitor from a baseline and a configuration: samples in, metrics, alerts, export rows and its own state out.

Every step of the way is one of the package's operators: detectors reduce samples to
metrics a step, windows smooth and close them, tests run over closed windows, alarms
latch, and edges of the latches and rolling means are what sinks get.  What is left after
the detectors has a row a step and metric, whatever the input.

A detector that fails is counted and left out, the others go on; with the kill switch
off, or ``enabled: false``, nothing is computed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import changepoint, detectors, windows
from .operators.baseline import Baseline
from .safety import Firewall, KillSwitch
from .sinks.export import ALERT, FAILURES, PREFIX, ExporterSink, LoggingSink, NullSink, Sink
from .sources.adapters import validated
from .sources.shared import stored

#: Windows for which an alarm holds its detector's state. Fixed value.
ALERT_HOLD = 10
THRESHOLDS = "metric string, method string, threshold double, delta double, debounce int, cooldown int"
METRICS = "step long, metric string, value double"
#: What a monitor says of itself. Fixed values.
STATS = (
    "enabled", "device", "steps_observed", "observations_dropped", "summaries_dropped", "drains_enqueued", "drains_completed", "rows_dispatched",
    "ring_utilization", "last_enqueue_us", "mean_enqueue_us", "gpu_time_us", "disabled_detectors", "ring_bytes", "pinned_bytes",
)


def drains(steps: DataFrame, every: int, capacity: int | None, done: DataFrame | None = None) -> DataFrame:
    """``step, pending, enqueued`` of the steps that end a block of ``every``: with ``capacity`` blocks pending, a new block is dropped whole.

    ``done`` (``step``, one row each) names steps before which one pending block is
    released.
    """
    ends = steps.where((F.col("step") + 1) % every == 0).select("step", F.lit(1).alias("add"))
    if capacity is None:
        return ends.select("step", F.lit(0).alias("pending"), F.lit(True).alias("enqueued"))
    rows = ends if done is None else ends.union(done.select("step", F.lit(-1)))
    rows = rows.select(F.lit(0).alias("one"), "step", "add", (F.col("step") * 2 + (F.col("add") > 0).cast("int")).alias("at"))

    def step(state: list, r) -> tuple:
        pending = state[0]
        state[0] = max(pending - 1, 0) if r.add < 0 else min(pending + 1, capacity)
        return r.one, r.step, pending, None if r.add < 0 else pending < capacity

    # a row for each block and release, in order: one pass with one number as its state
    folded = changepoint.ordered_fold(rows, "one", "at", lambda r: [0], step, "one int, step long, pending int, enqueued boolean")
    return folded.where("enqueued IS NOT NULL").select("step", "pending", "enqueued")


def ring_bytes(slots: int, max_batch: int, classes: int, dims: int) -> int:
    """Slots of 32-bit outputs and embeddings."""
    return slots * max_batch * (classes + dims) * 4


def pinned_bytes(capacity: int, every: int, metrics: int) -> int:
    return capacity * every * metrics * 4


def in_flight(steps: int, finished: int, slots: int) -> float:
    """Share of slots whose work has not finished."""
    return min(max(steps - finished, 0), slots) / slots


def backlog(progress: dict, limit: int) -> float:
    """The same of a stream: rows that its sources still hold, by ``limit``, 1 at most."""
    behind = 0
    for s in progress.get("sources", []):
        m = s.get("metrics") or {}
        behind += int(m.get("numFilesOutstanding", m.get("maxOffsetsBehindLatest", 0)) or 0)
    return min(1.0, behind / limit)


@dataclass
class Report:
    """What a run gave, as tables."""

    metrics: DataFrame
    rolling: DataFrame
    windows: DataFrame
    alerts: DataFrame
    states: DataFrame
    edges: DataFrame
    export: DataFrame
    stats: DataFrame


@dataclass
class Monitor:
    baseline: Baseline
    config: Config
    max_batch: int = 64
    sink: Sink = field(default_factory=NullSink)
    alert_sink: Sink | None = None
    firewall: Firewall = field(default_factory=Firewall)
    switch: KillSwitch | None = None
    alert_hold: int = ALERT_HOLD
    ring_slots: int = 8
    max_pending: int | None = None

    def __post_init__(self):
        self.layout = detectors.layout(self.config)
        self.detectors = detectors.build_detectors(self.config, self.baseline)
        if not self.detectors:
            raise ValueError("the configuration enables no detector")
        self.switch = self.switch or KillSwitch(flag=self.config.enabled)

    def dim(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.layout, "metric string, detector string")

    def thresholds(self, spark: SparkSession) -> DataFrame:
        rows = [(m, t.method, float(t.threshold), float(t.delta), t.debounce, t.cooldown) for m, t in self.config.thresholds.items()]
        return spark.createDataFrame(rows, THRESHOLDS)

    def measure(self, samples: DataFrame) -> DataFrame:
        """``step, metric, value`` of all detectors; one that fails is left out and counted."""
        spark = samples.sparkSession
        out = spark.createDataFrame([], METRICS)
        for name, detector in self.detectors.items():
            found = self.firewall.call(name, lambda d=detector, n=name: stored(d(samples).select("step", "metric", "value"), f"metrics-{n}"))
            if found is not None:
                out = out.unionByName(found)
        return out

    def watch(self, metrics: DataFrame) -> dict[str, DataFrame]:
        """Windows, tests, latches and edges over ``step, metric, value``."""
        spark, size = metrics.sparkSession, self.config.window_size
        rolling = windows.rolling_mean(metrics, size)
        closed = windows.tumbling_mean(metrics, size)
        limits = self.thresholds(spark)
        fired = changepoint.trace(closed.select("metric", "step", "value"), limits).where("alarm")
        fired = fired.join(F.broadcast(limits), "metric").join(F.broadcast(self.dim(spark)), "metric", "left")  # named metrics
        says = {"detector": F.coalesce("detector", "metric"), "model_version": F.lit(self.baseline.model_version), "baseline_version": F.lit(self.baseline.version), "labels": F.create_map().cast("map<string,string>")}
        alerts = stored(fired.select(*[says.get(c, F.col(c)).alias(c) for c in ALERT]), "alerts", few=True)
        states = windows.detector_state(windows.latch(metrics, alerts.select("metric", "step"), size, self.alert_hold), self.dim(spark))
        return {"rolling": rolling, "windows": closed, "alerts": alerts, "states": states, "edges": windows.edges(states)}

    def run(self, samples: DataFrame) -> Report | None:
        """Everything for ``step, vec_id, z, probs, h``; None while switched off."""
        if not self.switch.enabled:
            return None
        spark = samples.sparkSession
        kept, bad = validated(samples, len(self.baseline.embed_mean), self.max_batch)
        bad = stored(bad, "rejected", few=True)
        failed = dict(self.firewall.failures)
        metrics = self.measure(kept)
        seen = self.watch(metrics)
        steps = kept.select("step").distinct()
        ends = drains(steps, self.config.drain_every_k, self.max_pending)
        stats = self.stats(steps, ends, bad)
        last = F.coalesce(F.max("step"), F.lit(0).cast("long"))
        counts = stats.select(F.explode(F.create_map(*[x for c in ("steps_observed", "observations_dropped", "summaries_dropped", "ring_utilization") for x in (F.lit(c), F.col(c).cast("double"))], F.lit("detectors_disabled"), F.size("disabled_detectors").cast("double"))).alias("key", "value"))
        end = steps.agg(last.alias("step"))
        export = seen["rolling"].select("step", F.col("metric").alias("key"), F.col("rolling").alias("value"))
        export = export.union(seen["edges"].select("step", F.concat(F.lit(PREFIX), "detector"), F.col("active").cast("double")))
        export = export.union(end.join(counts).select("step", "key", "value"))  # one row joins
        if new := [(f"{FAILURES}.{n}", float(k - failed.get(n, 0))) for n, k in self.firewall.failures.items() if k > failed.get(n, 0)]:
            export = export.union(end.join(spark.createDataFrame(new, "key string, value double")).select("step", "key", "value"))
        report = Report(metrics, export=export, stats=stats, **seen)
        self.firewall.call("sink", self.sink.write, export, 0)
        if self.alert_sink is not None:
            self.firewall.call("alerts", self.alert_sink.write, report.alerts, 0)
        return report

    def stats(self, steps: DataFrame, ends: DataFrame, bad: DataFrame) -> DataFrame:
        """One row of ``STATS``; times of the device and of observing are null where no stream runs."""
        c, every, n = self.config, self.config.drain_every_k, len(self.layout)
        pool = self.max_pending or 4
        one = steps.agg(F.count("*").alias("steps_observed")).join(bad.agg(F.count("*").alias("observations_dropped")))
        one = one.join(ends.agg(F.count_if("enqueued").alias("drains_enqueued"), (F.count_if(~F.col("enqueued")) * every).alias("summaries_dropped")))  # one row each
        done = F.col("drains_enqueued") if self.max_pending is None else F.lit(0).cast("long")
        dims = len(self.baseline.embed_mean) if any(d.name == "embedding" for d in c.active()) else 0
        values = {
            "enabled": F.lit(self.switch.enabled), "device": F.lit("spark"), "drains_completed": done, "rows_dispatched": done * every, "ring_utilization": F.lit(0.0),
            "last_enqueue_us": F.lit(None).cast("double"), "mean_enqueue_us": F.lit(None).cast("double"), "gpu_time_us": F.lit(None).cast("double"),
            "disabled_detectors": F.array(*[F.lit(x) for x in self.firewall.disabled]).cast("array<string>"),
            "ring_bytes": F.lit(ring_bytes(self.ring_slots, self.max_batch, len(self.baseline.class_distribution), dims)).cast("long"), "pinned_bytes": F.lit(pinned_bytes(pool, every, n)).cast("long"),
        }
        return one.select(*[values.get(s, F.col(s)).alias(s) for s in STATS])


def reset_edges(states: DataFrame, resets: DataFrame) -> DataFrame:
    """Edges of ``detector, step, active`` when latches are cleared after the steps in ``resets``: what was on goes off there.

    ``resets`` has a row a reset (``step``).  An edge off is at the reset's own step.
    """
    epoch = F.size(F.filter("resets", lambda r: r < F.col("step")))
    table = resets.groupBy().agg(F.array_sort(F.collect_list("step")).alias("resets"))
    own = states.join(F.broadcast(table)).withColumn("epoch", epoch)  # one row joins
    last = own.groupBy("detector", "epoch").agg(F.max_by("active", "step").alias("active"), F.first("resets").alias("resets"))
    off = last.where("active").where(F.col("epoch") < F.size("resets")).select("detector", F.get("resets", F.col("epoch")).alias("step"), F.lit(False).alias("active"))
    per = windows.edges(own.withColumn("detector", F.struct("detector", "epoch"))).select(F.col("detector.detector").alias("detector"), "step", "active")
    return per.union(off)


def build_monitor(baseline: Baseline, config: Config, max_batch: int = 64, sink: Sink | None = None, alert_sink: Sink | None = None, **more) -> Monitor:
    """A wired monitor; without a sink, one as ``config.export`` says.  Alerts carry the baseline's model version and checksum."""
    if sink is None:
        quantiles = [d.params.get("quantile", 0.99) for d in config.active() if d.name == "entropy"]
        # the name says the 99th percentile, so nothing else goes there
        sink = ExporterSink(config.export.namespace, all(abs(q - 0.99) < 1e-9 for q in quantiles)) if config.export.enabled else NullSink()
    return Monitor(baseline, config, max_batch, sink, LoggingSink() if alert_sink is None else alert_sink, **more)


__all__ = ["Monitor", "Report", "build_monitor", "drains", "reset_edges"]
