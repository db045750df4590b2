"""Driver tables as observations and metric streams.

Observations have a row a sample: ``step, sample, z`` (embedding) and, after
``with_outputs``, ``probs`` and ``h``.  Metric streams have a row a step and metric, after
reduction, so their size follows the number of steps and not of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import EPS, as_distribution, entropy, softmax

BATCH, CLASSES, SCALE, SPLIT = 25, 10, 100.0, 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as samples, ``BATCH`` ids a step; null vectors are no samples."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return e.select(
        F.floor(F.col("vec_id") / BATCH).alias("step"), F.pmod("vec_id", F.lit(BATCH)).alias("sample"), "vec_id", "label",
        F.col("embedding").cast("array<double>").alias("z"),
    )


def version_of(spark: SparkSession, path: str) -> str:
    """What tells one state of a table from another: the newest change and the number of bytes of its files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    status = files.getFileStatus(place)
    found = list(files.listStatus(place)) if status.isDirectory() else [status]
    return f"{max((f.getModificationTime() for f in found), default=0)}-{sum(f.getLen() for f in found)}"


def split_point(obs: DataFrame) -> float:
    """Ids below it make the baseline."""
    return SPLIT * obs.count()


def per_dimension(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("z").alias("d", "x"))


def centroids(obs: DataFrame, split: float) -> np.ndarray:
    """Mean embedding of each label over the baseline split: labels by dimensions, so it may come to the driver.

    Samples without a label, or with one beyond the classes, belong to no centroid.
    """
    known = F.col("label").between(0, CLASSES - 1)
    rows = per_dimension(obs.where((F.col("vec_id") < split) & known), "label").groupBy("label", "d").agg(F.avg("x").alias("m")).collect()
    out = np.zeros((CLASSES, 1 + max((r["d"] for r in rows), default=0)))
    for r in rows:
        out[r["label"], r["d"]] = r["m"]
    return out


def with_outputs(obs: DataFrame, heads: np.ndarray, with_z: bool = True) -> DataFrame:
    """Class probabilities and entropy of each sample, logits being scaled products with the label centroids.

    One Arrow pass of matrix products; interpreted array functions were several times
    slower.  Embeddings come back from it only ``with_z``.
    """
    schema = f"step long, sample long, vec_id long, label int, {'z array<double>, ' if with_z else ''}probs array<double>, h double"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                z = np.stack(pdf["z"].to_numpy())
                logits = SCALE * z @ heads.T
                e = np.exp(logits - logits.max(1, keepdims=True))
                p = e / e.sum(1, keepdims=True)
                h = np.maximum(0.0, -(p * np.log(np.maximum(p, EPS))).sum(1))
                yield (pdf if with_z else pdf.drop(columns="z")).assign(probs=list(p), h=h)

    return obs.mapInPandas(score, schema)


def samples(df: DataFrame, step: str, embedding: str, logits: str | None = None, probs: str | None = None) -> DataFrame:
    """Any table with model outputs as samples: ``step, sample, z, probs, h``.

    Outputs are given as ``logits`` or as ``probs``; a row without an embedding or without
    outputs is no sample.  ``sample`` tells the rows of a step apart by their content.
    """
    if (logits is None) == (probs is None):
        raise ValueError("give logits or probs")
    z = F.col(embedding).cast("array<double>")
    raw = F.col(logits if probs is None else probs).cast("array<double>")
    p = softmax(raw) if probs is None else as_distribution(raw)
    out = df.where(F.col(embedding).isNotNull() & raw.isNotNull()).select(F.col(step).cast("long").alias("step"), z.alias("z"), p.alias("probs"))
    return out.select("step", F.xxhash64("z", "probs").alias("sample"), "z", "probs", entropy(F.col("probs")).alias("h"))


def event_stream(spark: SparkSession, sf_dir: str, seconds: int = 21_600) -> DataFrame:
    """``metric, step, value``: mean event value of each type in time buckets; every seventeenth event count gives NaN, as a detector that did not report."""
    ev = table(spark, sf_dir, "events")
    at = F.floor(F.unix_seconds(ev["ts"].cast("timestamp")) / seconds)
    means = ev.groupBy(F.col("event_type").alias("metric"), at.alias("bucket")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    first = means.agg(F.min("bucket").alias("b0"))
    value = F.when(F.col("n") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("mean"))
    return means.join(F.broadcast(first)).select("metric", (F.col("bucket") - F.col("b0")).alias("step"), value.alias("value"))  # one row joins


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, instance, detector, ts, value``: a monitor's own series as two instances expose them every 30 seconds.

    Events stand in for scrapes; levels follow the mean of 64 scrapes (of every third one
    for each of three detectors), counters grow in some of these blocks and restart every
    500 scrapes.
    """
    e = table(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(2)).alias("instance"), F.floor(F.col("event_id") / 2).alias("k"), "value").withColumn("b", F.floor(F.col("k") / 64))
    blocks = e.groupBy("instance", "b").agg(F.avg("value").alias("a"))
    own = e.join(blocks, ["instance", "b"])
    third = e.groupBy("instance", "b", F.pmod("k", F.lit(3)).alias("j")).agg(F.avg("value").alias("a"))
    each = e.join(third, ["instance", "b"])
    name = F.concat(F.lit("d"), F.col("j").cast("string"))
    a, v = F.col("a"), F.col("value")
    total = lambda inc: F.sum(inc).over(Window.partitionBy("instance", "detector", F.floor(F.col("k") / 500)).orderBy("k"))
    ts = (F.col("k") * 30).alias("ts")
    one = own.withColumn("detector", F.lit(None).cast("string"))
    levels = {
        "detectors_disabled": F.when(a > 54, 1.0).otherwise(0.0), "monitor_overhead_us": 60 + F.greatest(a - 45, F.lit(0.0)) * 12,
        "ring_utilization": F.least(F.greatest((a - 40) / 15, F.lit(0.0)), F.lit(1.0)),
        "summaries_dropped_total": total(F.when((a > 54) & (v > 30), 8.0).otherwise(0.0)), "observations_dropped_total": total(F.when((a < 46) & (v > 30), 1.0).otherwise(0.0)),
        "steps_observed_total": total(F.when(a.between(44, 48), 0.0).otherwise(F.floor(v) + 1.0)),
    }
    per = {"drift_alert": F.when(a > 55, 1.0).otherwise(0.0), "detector_failures_total": total(F.when((a > 50) & (v > 60) & (F.pmod("k", F.lit(3)) == F.col("j")), 1.0).otherwise(0.0))}
    wide = lambda df, columns: df.select("instance", "detector", ts, *[c.alias(n) for n, c in columns.items()]).unpivot(["instance", "detector", "ts"], list(columns), "name", "value")
    return wide(one, levels).unionByName(wide(each.withColumn("detector", name), per))


def eval_only(df: DataFrame, training: Column) -> DataFrame:
    return df.where(~training)


def validated(obs: DataFrame, dims: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Whole steps kept, and steps dropped: a step falls if one sample has the wrong width, or it has more samples than a batch may hold."""
    per_step = obs.groupBy("step").agg(F.min(F.coalesce((F.size("z") == dims).cast("int"), F.lit(0))).alias("ok"), F.count("*").alias("n"))
    bad = per_step.where((F.col("ok") == 0) | (F.col("n") > most)).select("step", "n")
    return obs.join(bad, "step", "left_anti"), bad


def last_names(df: DataFrame, n: int = 40) -> list[str]:
    return df.columns[-n:]
