"""Detectors: samples to a few metrics a step, against a baseline.

A detector is a DataFrame transformation ``samples -> (step, metric, value)``.  Baseline
fields are of bounded size and enter as literals or in closures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DETECTORS, Config
from ..functions.vectors import bin_right_closed, js, kl
from ..sources.shared import stored
from .baseline import Baseline
from .windows import hold_last

Detector = Callable[[DataFrame], DataFrame]
#: Baseline fields that each detector reads.
REFERENCE = {"entropy": ["entropy_histogram", "entropy_bin_edges"], "divergence": ["class_distribution"], "embedding": ["embed_mean", "embed_precision"]}
#: Steps that one task of the running moments folds.
CHUNK = 1024


def entropy_steps(samples: DataFrame, quantile: float = 0.99) -> DataFrame:
    """``entropy_mean`` and ``entropy_quantile`` (linear between ranks) a step."""
    return samples.groupBy("step").agg(F.avg("h").alias("entropy_mean"), F.percentile("h", F.lit(quantile)).alias("entropy_quantile"))


def population_shift(samples: DataFrame, base: Baseline) -> DataFrame:
    """Total variation of each step's entropy histogram from the baseline's, over all bins."""
    q = base.entropy_histogram / max(base.entropy_histogram.sum(), 1e-12)
    counts = samples.groupBy("step", bin_right_closed(F.col("h"), base.entropy_bin_edges.tolist()).alias("bin")).agg(F.count("*").alias("n"))
    ref = F.get(F.array(*[F.lit(float(x)) for x in q]), F.col("bin"))
    size = F.sum("n")
    # bins that a step does not hit differ by their whole share: their sum is 1 less what was hit
    per = counts.withColumn("q", ref).groupBy("step").agg(size.alias("size"), F.collect_list(F.struct("n", "q")).alias("hit"), F.sum("q").alias("hit_q"))
    parts = F.aggregate("hit", F.lit(0.0), lambda a, x: a + F.abs(x["n"] / F.col("size") - x["q"]))
    return per.select("step", ((parts + (float(q.sum()) - F.col("hit_q"))) / 2).alias("entropy_pop_shift"))


def mean_softmax(samples: DataFrame) -> DataFrame:
    return samples.select("step", F.posexplode("probs").alias("class", "p")).groupBy("step", "class").agg(F.avg("p").alias("p"))


def divergence_steps(samples: DataFrame, base: Baseline) -> DataFrame:
    """``kl_divergence`` and ``js_divergence`` of a step's mean distribution from the baseline's."""
    vec = F.transform(F.array_sort(F.collect_list(F.struct("class", "p"))), lambda s: s["p"])
    q = F.array(*[F.lit(float(x)) for x in base.class_distribution])
    return mean_softmax(samples).groupBy("step").agg(vec.alias("v")).select("step", kl(F.col("v"), q).alias("kl_divergence"), js(F.col("v"), q).alias("js_divergence"))


def mahalanobis(samples: DataFrame, mean: np.ndarray, prec: np.ndarray) -> DataFrame:
    """``samples`` with ``distance``; matrix products of Arrow batches."""

    @F.pandas_udf("double")
    def distance(zs: pd.Series) -> pd.Series:
        if not len(zs):
            return pd.Series([], dtype="float64")
        d = np.stack(zs.to_numpy()) - mean
        return pd.Series(np.sqrt(np.maximum(0.0, ((d @ prec) * d).sum(1))))

    return samples.withColumn("distance", distance("z"))


def mahalanobis_steps(samples: DataFrame, base: Baseline) -> DataFrame:
    return mahalanobis(samples, base.embed_mean, base.embed_precision).groupBy("step").agg(F.avg("distance").alias("embedding_mahalanobis_mean"))


def step_sums(samples: DataFrame, shift: np.ndarray) -> DataFrame:
    """``step, n, s, ss`` (binary sums of z - shift and its outer product): a row a task and step, then one a step."""
    d = len(shift)

    def fold(pairs: Iterator[tuple[int, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        held: dict[int, list] = {}
        for step, n, s, ss in pairs:
            h = held.setdefault(step, [0, np.zeros(d), np.zeros((d, d))])
            h[0] += n
            h[1] += s
            h[2] += ss
        return pd.DataFrame({"step": list(held), "n": [h[0] for h in held.values()], "s": [h[1].tobytes() for h in held.values()], "ss": [h[2].tobytes() for h in held.values()]})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            def pairs(pdf=pdf):
                for step, g in pdf.groupby("step"):
                    z = np.stack(g["z"].to_numpy()) - shift
                    yield int(step), len(z), z.sum(0), z.T @ z

            yield fold(pairs())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold((int(r.step), int(r.n), np.frombuffer(r.s), np.frombuffer(r.ss).reshape(d, d)) for r in pdf.itertuples())

    schema = "step long, n long, s binary, ss binary"
    return samples.select("step", "z").mapInPandas(partial, schema).groupBy("step").applyInPandas(merge, schema)


def running_embedding(samples: DataFrame, base: Baseline, decay: float = 0.99, cov_every: int = 32) -> DataFrame:
    """``step, running_mean, embedding_mean_shift, embedding_cov_drift`` from moments with weights decay ** (t - i).

    A scan in two levels: chunks of steps are summed with weights, the chunk sums are
    carried forward (a row for each ``CHUNK`` steps), then chunks run on their own from
    what they were handed.  The covariance part is refreshed every ``cov_every`` steps
    and held between.
    """
    mu, prec, d = base.embed_mean, base.embed_precision, len(base.embed_mean)
    width = 1 + d + d * d
    sums = step_sums(samples, mu).withColumn("chunk", F.floor(F.col("step") / CHUNK))

    def unpack(r) -> np.ndarray:
        return np.concatenate([[r.n], np.frombuffer(r.s), np.frombuffer(r.ss)])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        state = np.zeros(width)
        pdf = pdf.sort_values("step")
        for r in pdf.itertuples():
            state = decay * state + unpack(r)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].astype("int64"), "steps": [len(pdf)], "state": [state.tobytes()]})

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = np.zeros(width)
        for pdf in batches:
            for r in pdf.itertuples():
                yield pd.DataFrame({"chunk": [r.chunk], "state": [state.tobytes()]})
                state = decay**r.steps * state + np.frombuffer(r.state)

    def run(pdf: pd.DataFrame, handed: pd.DataFrame) -> pd.DataFrame:
        state, out = np.frombuffer(handed["state"].iloc[0]), []
        for r in pdf.sort_values("step").itertuples():
            state = decay * state + unpack(r)
            n, s, ss = state[0], state[1 : d + 1], state[d + 1 :].reshape(d, d)
            m = s / n
            shift = float(np.sqrt(max(0.0, m @ prec @ m)))
            drift = None
            if cov_every and r.step % cov_every == 0:
                drift = 0.0 if n < 2 else float(np.linalg.norm((ss - n * np.outer(m, m)) / (n - 1) @ prec - np.eye(d)))
            out.append((int(r.chunk), int(r.step), (m + mu).tolist(), shift, drift))
        return pd.DataFrame(out, columns=["chunk", "step", "running_mean", "embedding_mean_shift", "refreshed"])

    totals = sums.groupBy("chunk").applyInPandas(total, "chunk long, steps long, state binary")
    # one row a chunk, in order and one at a time: the task holds one state
    handed = totals.repartition(1).sortWithinPartitions("chunk").mapInPandas(carry, "chunk long, state binary")
    rows = sums.groupBy("chunk").cogroup(handed.groupBy("chunk")).applyInPandas(run, "chunk long, step long, running_mean array<double>, embedding_mean_shift double, refreshed double")
    rows = stored(rows, "running")
    # held within a chunk; what a chunk's first steps have to hold comes from the last one before with a refresh
    own = hold_last("refreshed", F.col("chunk"), "step")
    tails = rows.groupBy("chunk").agg(F.max_by("refreshed", F.when(F.col("refreshed").isNotNull(), F.col("step"))).alias("tail"))
    before = F.last("tail", ignorenulls=True).over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    handed = tails.select("chunk", before.alias("tail"))
    return rows.withColumn("own", own).join(handed, "chunk").select("step", "running_mean", "embedding_mean_shift", F.coalesce("own", "tail").alias("embedding_cov_drift"))


def build_detectors(config: Config, base: Baseline) -> dict[str, Detector]:
    """Enabled detectors by name, in the given order; each gives long rows."""
    made: dict[str, Detector] = {}
    for c in config.active():
        p = c.params
        if c.name == "entropy":
            made[c.name] = lambda df, p=p: long_form(entropy_steps(df, p.get("quantile", 0.99)).join(population_shift(df, base), "step"))
        elif c.name == "divergence":
            made[c.name] = lambda df: long_form(divergence_steps(df, base))
        else:
            made[c.name] = lambda df, p=p: long_form(mahalanobis_steps(df, base).join(running_embedding(df, base, p.get("decay", 0.99), p.get("cov_every", 32)).drop("running_mean"), "step"))
    return made


def long_form(wide: DataFrame) -> DataFrame:
    return wide.unpivot("step", [c for c in wide.columns if c != "step"], "metric", "value")


def layout(config: Config) -> list[tuple[str, str]]:
    """(metric, detector) in order; a metric may come from one detector only."""
    out = [(m, d.name) for d in config.active() for m in DETECTORS[d.name]]
    if len({m for m, _ in out}) < len(out):
        raise ValueError("metric names must be unique")
    return out
