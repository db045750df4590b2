"""Kill switch, firewall and circuit breaker of monitoring code."""

from __future__ import annotations

import logging
import os
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
TRUE = ("1", "true", "yes", "on")


class KillSwitch:
    """Off while the environment says so, whatever the flag; read anew each time."""

    def __init__(self, variable: str = "DRIFTLOOM_DISABLED", flag: bool = True):
        self.variable, self.flag = variable, flag

    @property
    def enabled(self) -> bool:
        return self.flag and os.environ.get(self.variable, "").strip().lower() not in TRUE


class Firewall:
    """Runs parts so that their exceptions stay inside; a part is disabled after ``max_failures`` in total."""

    def __init__(self, max_failures: int = 3):
        if max_failures < 1:
            raise ValueError("max_failures must be at least 1")
        self.max_failures, self.failures, self.last = max_failures, Counter(), {}

    def is_disabled(self, part: str) -> bool:
        return self.failures[part] >= self.max_failures

    @property
    def disabled(self) -> list[str]:
        return sorted(p for p in self.failures if self.is_disabled(p))

    def call(self, part: str, fn: Callable, *args, default=None):
        if self.is_disabled(part):
            return default
        try:
            return fn(*args)
        except Exception as e:
            self.failures[part] += 1
            self.last[part] = e
            log.exception("%s failed (%d of %d)", part, self.failures[part], self.max_failures)
            return default

    def reset(self, part: str | None = None) -> None:
        for p in [part] if part else list(self.failures):
            self.failures.pop(p, None)
            self.last.pop(p, None)


def firewall_state(failures: DataFrame, max_failures: int) -> DataFrame:
    """``component, failures, disabled, last_error`` from failure rows ``component, step, error``."""
    per = failures.groupBy("component").agg(F.count("*").alias("failures"), F.max_by("error", F.struct("step", "error")).alias("last_error"))
    return per.select("component", "failures", (F.col("failures") >= max_failures).alias("disabled"), "last_error")
