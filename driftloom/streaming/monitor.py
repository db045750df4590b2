"""Live forms: change-point tests with state, event-time metrics, and guarded sinks.

A stream's test is the same transition as in the batch fold, so both give the same rows
for the same input.  State is a row of numbers a metric.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import ThresholdConfig
from ..operators.changepoint import TRACE, Test
from ..operators.windows import finite_only
from ..safety import Firewall, KillSwitch
from ..sinks.export import Sink

STATE = "n long, mean double, total double, least double, run int, cool int"


def changepoints(stream: DataFrame, thresholds: dict[str, ThresholdConfig], targets: dict[str, float] | None = None) -> DataFrame:
    """Statistic and alarm of every finite value of ``metric, step, value``; metrics without a threshold are left out.

    ``targets`` has levels that CUSUM holds a metric to, in place of its running mean.
    Within a batch values are taken by step; across batches they have to arrive in order,
    else ``watch`` with a ``lag`` is the one to use.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = thresholds[key[0]]
        test = Test(c.threshold, c.delta, c.method, c.debounce, c.cooldown, (targets or {}).get(key[0]))
        if state.exists:
            test.n, test.mean, test.total, test.least, test.run, test.cool = state.get
        pdf = pd.concat(list(batches)).sort_values("step")
        out = [test.update(x) for x in pdf["value"].tolist()]
        state.update(test.state())
        yield pd.DataFrame({"metric": key[0], "step": pdf["step"], "value": pdf["value"], "statistic": [s for _, s in out], "alarm": [a for a, _ in out]})

    own = finite_only(stream).where(F.col("metric").isin(*thresholds)).select("metric", "step", "value")
    return own.groupBy("metric").applyInPandasWithState(update, TRACE, STATE, "append", GroupStateTimeout.NoTimeout)


def tumbling(stream: DataFrame, window: int) -> DataFrame:
    """Means of each ``window`` finite values of a metric; what is unfinished waits in the state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        k, n, s = state.get if state.exists else (0, 0, 0.0)
        out = []
        for step, x in pd.concat(list(batches)).sort_values("step")[["step", "value"]].itertuples(index=False):
            n, s = n + 1, s + x
            if n == window:
                out.append((key[0], k, int(step), s / n))
                k, n, s = k + 1, 0, 0.0
        state.update((k, n, s))
        yield pd.DataFrame(out, columns=["metric", "k", "step", "value"])

    own = finite_only(stream).select("metric", "step", "value")
    return own.groupBy("metric").applyInPandasWithState(update, "metric string, k long, step long, value double", "k long, n long, s double", "append", GroupStateTimeout.NoTimeout)


WATCHED = "metric string, step long, kind string, value double, statistic double"
WATCH_STATE = STATE + ", steps array<long>, values array<double>, released long, high long, recent array<double>, k long, s double, fired long, active boolean"


@dataclass
class Watch:
    """What is known of one metric: a buffer that puts values in order, windows, test and latch."""

    window: int
    hold: int
    lag: int
    test: Test | None
    buffer: list[tuple[int, float]] = field(default_factory=list)
    released: int = -1
    high: int = -1
    recent: list[float] = field(default_factory=list)
    k: int = 0
    s: float = 0.0
    fired: int = -1
    active: bool = False

    def load(self, state: tuple) -> None:
        if self.test is not None:
            self.test.n, self.test.mean, self.test.total, self.test.least, self.test.run, self.test.cool = state[:6]
        steps, values, self.released, self.high, recent, self.k, self.s, self.fired, self.active = state[6:]
        self.buffer, self.recent = list(zip(steps, values, strict=True)), list(recent)

    def dump(self) -> tuple:
        test = self.test.state() if self.test is not None else (0, 0.0, 0.0, 0.0, 0, 0)
        return (*test, [x for x, _ in self.buffer], [v for _, v in self.buffer], self.released, self.high, self.recent, self.k, self.s, self.fired, self.active)

    def feed(self, rows: list[tuple[int, float]]) -> Iterator[tuple[int, str, float | None, float | None]]:
        """Takes values in; what lies ``lag`` steps behind the newest one goes through, by step. Later ones are left out."""
        self.buffer = sorted(self.buffer + [r for r in rows if r[0] > self.released])
        self.high = max([self.high, *(x for x, _ in rows)])
        ready = [r for r in self.buffer if r[0] <= self.high - self.lag]
        self.buffer = self.buffer[len(ready) :]
        for step, x in ready:
            self.released = step
            yield from self.one(step, x)

    def one(self, step: int, x: float) -> Iterator[tuple[int, str, float | None, float | None]]:
        if math.isfinite(x):
            self.recent = [*self.recent, x][-self.window :]
            yield step, "rolling", sum(self.recent) / len(self.recent), None
            self.k, self.s = self.k + 1, self.s + x
            if self.k == self.window:
                mean, self.k, self.s = self.s / self.window, 0, 0.0
                yield step, "window", mean, None
                if self.test is not None:
                    alarm, statistic = self.test.update(mean)
                    if alarm:
                        self.fired = step
                        yield step, "alarm", mean, statistic
        passed = (step + 1) // self.window - (self.fired + 1) // self.window
        active = self.fired >= 0 and passed < self.hold
        if active != self.active:
            self.active = active
            yield step, "on" if active else "off", None, None


def watch(stream: DataFrame, thresholds: dict[str, ThresholdConfig], window: int, hold: int = 10, lag: int = 0, targets: dict[str, float] | None = None) -> DataFrame:
    """``metric, step, kind, value, statistic`` of a live stream ``metric, step, value``: rolling means, closed windows, alarms, edges on and off.

    Values may arrive out of order by up to ``lag`` steps: they wait in the state until
    the metric's newest step is that far ahead.  The state of a metric is a window and a
    buffer of values and a few numbers.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = thresholds.get(key[0])
        test = None if c is None else Test(c.threshold, c.delta, c.method, c.debounce, c.cooldown, (targets or {}).get(key[0]))
        w = Watch(window, hold, lag, test)
        if state.exists:
            w.load(state.get)
        rows = [(int(s), float("nan") if v is None else float(v)) for pdf in batches for s, v in zip(pdf["step"], pdf["value"], strict=True)]
        out = list(w.feed(rows))
        state.update(w.dump())
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["metric", "step", "kind", "value", "statistic"]).astype({"value": "float64", "statistic": "float64"})

    return stream.select("metric", "step", "value").groupBy("metric").applyInPandasWithState(update, WATCHED, WATCH_STATE, "append", GroupStateTimeout.NoTimeout)


def event_metrics(events: DataFrame, ts: str, key: str, value: str, every: str, late: str) -> DataFrame:
    """Mean of ``value`` in event-time windows; rows later than ``late`` are dropped, and counted in the query's progress."""
    w = F.window(ts, every)
    agg = events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(key).alias("metric")).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return agg.select("metric", F.unix_seconds("w.start").alias("step"), "value", "n")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's watermark has dropped so far."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def start(stream: DataFrame, sink: Sink, checkpoint: str, switch: KillSwitch | None = None, firewall: Firewall | None = None, **trigger) -> StreamingQuery:
    """Hands each batch to a sink; a batch that fails there is counted, and the stream goes on."""
    switch, firewall = switch or KillSwitch(), firewall or Firewall()

    def each(rows: DataFrame, batch: int) -> None:
        if switch.enabled:
            firewall.call("sink", sink.write, rows, batch)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
