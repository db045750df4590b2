"""Metrics and alerts as export rows: catalogue, routing, text exposition, alert forms.

An export row is ``step, key, value``; ``key`` is a metric, ``drift_alert.<detector>`` or a
counter.  Values that are not finite are dropped before anything else.
"""

from __future__ import annotations

import json
import logging
import queue
import threading
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import finite

log = logging.getLogger(__name__)
PREFIX = "drift_alert."
#: Names that every build exports. Fixed values.
GAUGES = (
    "entropy_mean", "entropy_quantile", "entropy_p99", "entropy_pop_shift", "kl_divergence", "js_divergence",
    "embedding_mahalanobis_mean", "embedding_mean_shift", "embedding_cov_drift",
)
TELEMETRY = ("monitor_overhead_us", "monitor_gpu_time_us", "ring_utilization", "detectors_disabled")
COUNTERS = ("steps_observed", "observations_dropped", "summaries_dropped")
FAILURES = "detector_failures"
#: What an alert says, in order. Fixed values.
ALERT = ("metric", "detector", "step", "value", "statistic", "threshold", "method", "model_version", "baseline_version", "labels")


def catalogue(spark, namespace: str) -> DataFrame:
    """``name, kind, full_name`` of everything that is always exported."""
    rows = [(n, "gauge") for n in GAUGES + TELEMETRY] + [(n, "counter") for n in COUNTERS]
    return spark.createDataFrame(rows, "name string, kind string").withColumn("full_name", F.concat_ws("_", F.lit(namespace), "name"))


def routed(rows: DataFrame, known_only: bool = False, p99_alias: bool = False) -> DataFrame:
    """``name, detector, kind, value``: gauges keep their latest value, counters add up what is not negative.

    Keys are names, ``drift_alert.<detector>``, or ``detector_failures.<detector>``, a counter for each detector.

    ``known_only`` is the way of telemetry, which ignores names that are not in the
    catalogue; otherwise an unknown name becomes a gauge.
    """
    key = F.col("key")
    failed = key.startswith(FAILURES + ".")
    kind = F.when(key.startswith(PREFIX), "alert").when(key.isin(*COUNTERS) | failed, "counter").otherwise("gauge")
    df = rows.where(finite(F.col("value"))).withColumn("kind", kind)
    if known_only:
        df = df.where(key.isin(*GAUGES, *TELEMETRY, *COUNTERS) | failed)
    if p99_alias:
        df = df.withColumn("key", F.explode(F.when(key == "entropy_quantile", F.array(key, F.lit("entropy_p99"))).otherwise(F.array(key))))
    labelled = (F.col("kind") == "alert") | F.col("key").startswith(FAILURES + ".")
    name = F.when(labelled, F.substring_index("key", ".", 1)).otherwise(F.col("key"))
    detector = F.when(labelled, F.expr("substring(key, locate('.', key) + 1)"))
    value = F.when(F.first("kind") == "counter", F.sum(F.greatest(F.col("value"), F.lit(0.0)))).otherwise(F.max_by("value", "step"))
    return df.withColumns({"name": name, "detector": detector}).groupBy("name", "detector").agg(F.first("kind").alias("kind"), value.alias("value"))


def exported(rows: DataFrame, namespace: str) -> DataFrame:
    """The catalogue with the values that were fed; names beyond it follow."""
    cat = catalogue(rows.sparkSession, namespace)
    got = routed(rows).where("detector IS NULL").select("name", F.col("kind").alias("own"), "value")
    full = cat.join(got, "name", "full").select("name", F.coalesce("kind", "own").alias("kind"), F.coalesce("full_name", F.concat_ws("_", F.lit(namespace), "name")).alias("full_name"), "value")
    return full


def shortest(value: Column, digits: int = 6) -> Column:
    """A number with ``digits`` significant digits as C's %g shows it: no closing zeros, an exponent where it is shorter."""
    size = F.abs(value)
    least = F.floor(F.log10(size))
    # rounding may carry into the next power of ten
    power = F.when(F.round(size / F.pow(F.lit(10.0), least), digits - 1) >= 10, least + 1).otherwise(least)
    sign = F.when(value < 0, "-").otherwise("")
    ten = lambda n: F.pow(F.lit(10.0), n)
    # the power of ten itself may be out of range
    whole = F.round(F.when(power < -280, size * ten(-power) * ten(F.lit(digits - 1))).otherwise(size * ten(digits - 1 - power))).cast("decimal(38,0)")
    plain = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    fixed = F.lpad(whole.cast("string"), 64, "0")
    places = (digits - 1 - power).cast("int")
    fixed = F.concat(F.regexp_replace(F.substring(fixed, F.lit(1), 64 - places), "^0+(?=.)", ""), F.lit("."), F.substring(fixed, 65 - places, places))
    mantissa = whole.cast("string")
    scientific = F.concat(plain(F.concat(F.left(mantissa, F.lit(1)), F.lit("."), F.substring(mantissa, F.lit(2), F.lit(64)))), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    shown = F.when((power < -4) | (power >= digits), scientific).otherwise(plain(fixed))
    special = F.when(F.isnan(value), "nan").when(size == float("inf"), F.concat(sign, F.lit("inf"))).when(size == 0, "0")
    return F.coalesce(special, F.concat(sign, shown))


#: What a name stands for, in the exposition text.
HELP = {
    "entropy_mean": "Mean entropy of class probabilities", "entropy_quantile": "Entropy at the chosen quantile", "entropy_p99": "Entropy at the 99th percentile",
    "entropy_pop_shift": "Total variation of the entropy histogram from the baseline", "kl_divergence": "KL divergence of mean probabilities from the baseline",
    "js_divergence": "JS divergence of mean probabilities from the baseline", "embedding_mahalanobis_mean": "Mean Mahalanobis distance from the baseline",
    "embedding_mean_shift": "Distance of the running mean from the baseline", "embedding_cov_drift": "Drift of the running covariance from the baseline",
    "monitor_overhead_us": "Moving average of the time that observing takes", "monitor_gpu_time_us": "Device time of the last drain", "ring_utilization": "Share of slots still in flight",
    "detectors_disabled": "Detectors that the circuit breaker switched off", "steps_observed": "Batches observed", "observations_dropped": "Batches rejected",
    "summaries_dropped": "Steps whose summaries were dropped", "drift_alert": "1 while a detector is in alarm", FAILURES: "Exceptions of a detector",
}


def text_lines(routed_rows: DataFrame, namespace: str) -> DataFrame:
    """Exposition lines, ``name, at, line``: of each name help, type (``at`` -2, -1), then its samples; counters get the suffix ``_total``."""
    end = F.when(F.col("kind") == "counter", "_total").otherwise("")
    full = F.concat(F.lit(namespace + "_"), F.col("name"), end)
    says = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HELP.items() for x in kv]), F.col("name")), F.concat(F.lit("Metric "), "name"))
    label = F.when(F.col("detector").isNotNull(), F.concat(F.lit('{detector="'), F.col("detector"), F.lit('"}'))).otherwise("")
    shown = F.when(F.col("kind") == "alert", "gauge").otherwise(F.col("kind"))
    heads = routed_rows.select("name", full.alias("full"), says.alias("says"), shown.alias("shown")).distinct()
    heads = heads.select("name", F.inline(F.array(F.struct(F.lit(-2).alias("at"), F.concat(F.lit("# HELP "), "full", F.lit(" "), "says").alias("line")), F.struct(F.lit(-1).alias("at"), F.concat(F.lit("# TYPE "), "full", F.lit(" "), "shown").alias("line")))))
    return heads.union(routed_rows.select("name", F.lit(0).alias("at"), F.concat(full, label, F.lit(" "), shortest(F.col("value"), 12)).alias("line")))


def dotted(routed_rows: DataFrame, namespace: str) -> DataFrame:
    """Names of the other metric protocol: dots, and telemetry counters as gauges."""
    kind = F.when(F.col("kind") == "alert", "gauge").otherwise("gauge")
    return routed_rows.select(F.concat_ws(".", F.lit(namespace), "name").alias("name"), "detector", kind.alias("kind"))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alerts with all that they say; what is missing is empty."""
    empty = {"model_version": F.lit(""), "baseline_version": F.lit(""), "labels": F.create_map().cast("map<string,string>")}
    return alerts.select(*[F.col(c) if c in alerts.columns else empty[c].alias(c) for c in ALERT])


def alert_json(alerts: DataFrame) -> DataFrame:
    return alert_rows(alerts).select("metric", "step", F.to_json(F.struct(*ALERT)).alias("body"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """One line an alert; empty versions read as a question mark."""
    version = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?"))
    parts = [F.lit("drift alert: detector="), F.col("detector"), F.lit(" metric="), F.col("metric")]
    for c in ("value", "statistic", "threshold"):
        parts += [F.lit(f" {c}="), shortest(F.col(c))]
    parts += [F.lit(" method="), F.col("method"), F.lit(" step="), F.col("step").cast("string"), F.lit(" model="), version("model_version"), F.lit(" baseline="), version("baseline_version")]
    return alert_rows(alerts).select("metric", "step", F.concat(*parts).alias("line"))


class Sink:
    """What a stream hands each batch of rows to."""

    def write(self, rows: DataFrame, batch: int) -> None:
        raise NotImplementedError

    def close(self) -> None:
        """Releases what the sink holds."""


class NullSink(Sink):
    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.format("noop").mode("append").save()


class TableSink(Sink):
    """Appends to a Parquet folder."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("append").parquet(self.path)


class LoggingSink(Sink):
    """A warning for each alert; alerts are edges, so few."""

    def write(self, rows: DataFrame, batch: int) -> None:
        for r in rows.toLocalIterator():
            log.warning("%s", json.dumps(r.asDict(), default=str))


class WebhookSink(Sink):
    """Posts each alert as JSON from a worker thread, behind a queue of ``most``.

    What finds the queue full, or can't be posted, is dropped and counted; writing never
    waits for the other side.  ``post`` may replace the HTTP request.
    """

    def __init__(self, url: str | Callable[[dict], None], most: int = 64, timeout: float = 2.0, headers: dict[str, str] | None = None):
        self.url, self.timeout, self.headers = url, timeout, {"Content-Type": "application/json", **(headers or {})}
        self.sent = self.dropped = 0
        self._lock, self._queue = threading.Lock(), queue.Queue(maxsize=most)
        self._worker = threading.Thread(target=self._run, daemon=True)
        self._worker.start()

    def post(self, alert: dict) -> None:
        if callable(self.url):
            self.url(alert)
            return
        body = json.dumps(alert, default=str).encode()
        with urllib.request.urlopen(urllib.request.Request(self.url, body, self.headers), timeout=self.timeout):
            pass

    def write(self, rows: DataFrame, batch: int) -> None:
        for r in rows.toLocalIterator():
            try:
                self._queue.put_nowait(r.asDict(recursive=True))
            except queue.Full:
                with self._lock:
                    self.dropped += 1

    def _run(self) -> None:
        while (alert := self._queue.get()) is not None:
            try:
                self.post(alert)
                with self._lock:
                    self.sent += 1
            except Exception:
                with self._lock:
                    self.dropped += 1
                log.exception("an alert could not be posted")
            finally:
                self._queue.task_done()
        self._queue.task_done()

    def close(self, timeout: float = 5.0) -> None:
        """Posts what is queued, for some seconds at most."""
        self._queue.put(None)
        self._worker.join(timeout)


class MultiSink(Sink):
    """Hands on to several sinks; one that fails does not stop the others."""

    def __init__(self, *sinks: Sink):
        self.sinks, self.failures = sinks, 0

    def write(self, rows: DataFrame, batch: int) -> None:
        for s in self.sinks:
            try:
                s.write(rows, batch)
            except Exception:
                self.failures += 1
                log.exception("%s failed", type(s).__name__)


class ExporterSink(Sink):
    """Keeps the latest gauges and the sums of counters, as rows ``name, detector, kind, value``, for whoever scrapes.

    One value for each name and detector, so it stays small however long a stream runs.
    """

    def __init__(self, namespace: str = "driftloom", p99_alias: bool = True):
        self.namespace, self.p99_alias, self.values = namespace, p99_alias, {}

    def write(self, rows: DataFrame, batch: int) -> None:
        for r in routed(rows, p99_alias=self.p99_alias).collect():
            key = r["name"], r["detector"], r["kind"]
            self.values[key] = r["value"] + (self.values.get(key, 0.0) if r["kind"] == "counter" else 0.0)

    def text(self, spark) -> str:
        table = spark.createDataFrame([(*k, v) for k, v in self.values.items()], "name string, detector string, kind string, value double")
        return "".join(r["line"] + "\n" for r in text_lines(table, self.namespace).orderBy("name", "at", "line").collect())


_DEFAULT = ExporterSink()


def default_exporter() -> ExporterSink:
    """The exporter of the process."""
    return _DEFAULT


def update(rows: DataFrame) -> None:
    """Feeds export rows ``step, key, value`` to the exporter of the process."""
    _DEFAULT.write(rows, 0)
