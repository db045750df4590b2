"""Reference baselines: aggregates of a clean sample, a one-row artifact, and its checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import bin_left_closed, entropy_edges

FORMAT = "driftloom-baseline-1"
REG = 1e-4


class BaselineError(ValueError):
    """An artifact of another format or model, or with another checksum than its content's."""


@dataclass(frozen=True)
class Baseline:
    model_version: str
    created_at: str
    sample_count: int
    class_distribution: np.ndarray
    entropy_histogram: np.ndarray
    entropy_bin_edges: np.ndarray
    embed_mean: np.ndarray
    embed_precision: np.ndarray
    checksum: str = ""

    @property
    def version(self) -> str:
        return self.checksum[:12]

    def digest(self) -> str:
        parts = [FORMAT, self.model_version, self.created_at, str(self.sample_count)]
        for name in ("class_distribution", "entropy_histogram", "entropy_bin_edges", "embed_mean", "embed_precision"):
            a = np.ascontiguousarray(getattr(self, name), "<f8")
            parts.append(f"{name}:{a.shape}:{a.tobytes().hex()}")
        return hashlib.sha256("|".join(parts).encode()).hexdigest()

    def validate(self) -> Baseline:
        q, h, e, mu, p = self.class_distribution, self.entropy_histogram, self.entropy_bin_edges, self.embed_mean, self.embed_precision
        checks = [
            (q.ndim == 1 and abs(q.sum() - 1) <= 1e-4, "the class distribution does not sum to 1"), ((q >= 0).all(), "the class distribution has negative entries"),
            (len(e) == len(h) + 1, "edges and histogram do not fit"), ((h >= 0).all() and h.sum() > 0, "the entropy histogram is empty or negative"),
            (p.shape == (len(mu), len(mu)), "the precision matrix does not fit the mean"), (np.allclose(p, p.T, atol=1e-4), "the precision matrix is not symmetric"),
        ]
        for ok, what in checks:
            if not ok:
                raise ValueError(what)
        if len(mu) and np.linalg.eigvalsh(p).min() <= 0:
            raise ValueError("the precision matrix is not positive definite")
        return self


def class_distribution(samples: DataFrame) -> DataFrame:
    """Pooled mean of class probabilities: ``class, q``."""
    sums = samples.select(F.posexplode("probs").alias("class", "p")).groupBy("class").agg(F.avg("p").alias("q"))
    whole = sums.agg(F.sum("q").alias("s"))
    return sums.join(F.broadcast(whole)).select("class", (F.col("q") / F.col("s")).alias("q"))  # one row joins


def entropy_histogram(samples: DataFrame, edges: list[float]) -> DataFrame:
    """``bin, n`` for every bin, empty ones too."""
    spark = samples.sparkSession
    counts = samples.groupBy(bin_left_closed(F.col("h"), edges).alias("bin")).count()
    grid = spark.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def merged(parts: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred sum of products of samples that come in parts, by Chan's update."""
    n, mean, m2 = 0, np.zeros(0), np.zeros((0, 0))
    for k, own, products in parts:
        if not n:
            n, mean, m2 = k, own, products
        elif k:
            gap, whole = own - mean, n + k
            m2 = m2 + products + np.outer(gap, gap) * (n * k / whole)
            mean, n = mean + gap * (k / whole), whole
    return n, mean, m2


def moments(samples: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (n - 1) of embeddings.

    Each task centres what it sums, so nothing cancels however far the samples lie from
    the origin; the tasks' rows (d * d numbers each) are merged in two levels.
    """
    schema = "part int, n long, mean binary, m2 binary"

    def row(part: int, found: tuple[int, np.ndarray, np.ndarray]) -> pd.DataFrame:
        n, mean, m2 = found
        return pd.DataFrame({"part": [part], "n": [n], "mean": [mean.tobytes()], "m2": [m2.tobytes()]})

    def of(pdf: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for r in pdf.itertuples():
            mean = np.frombuffer(r.mean)
            yield int(r.n), mean, np.frombuffer(r.m2).reshape(len(mean), len(mean))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def each() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            for pdf in batches:
                if len(pdf):
                    z = np.stack(pdf["z"].to_numpy())
                    mean = z.mean(0)
                    yield len(z), mean, (z - mean).T @ (z - mean)

        found = merged(each())
        if found[0]:
            yield row(TaskContext.get().partitionId() % 64, found)

    parts = samples.select("z").mapInPandas(partial, schema).groupBy("part").applyInPandas(lambda pdf: row(int(pdf["part"].iloc[0]), merged(of(pdf))), schema)
    # at most 64 rows
    rows = sorted(parts.collect(), key=lambda r: r["part"])
    n, mean, m2 = merged(of(pd.DataFrame([r.asDict() for r in rows], columns=["part", "n", "mean", "m2"])))
    cov = m2 / (n - 1) if n > 1 else np.zeros_like(m2)
    return n, mean, (cov + cov.T) / 2


def precision(cov: np.ndarray, reg: float = REG) -> np.ndarray:
    """Inverse of the covariance, its diagonal raised by a share of the largest variance."""
    lam = reg * max(float(np.diag(cov).max(initial=0.0)), 1e-12)
    inv = np.linalg.inv(cov + lam * np.eye(len(cov)))
    return (inv + inv.T) / 2


def build(samples: DataFrame, n_classes: int, model_version: str, created_at: str, n_bins: int = 64) -> Baseline:
    """A validated baseline from samples with ``probs, h, z``; three aggregates, each of bounded size."""
    n, mean, cov = moments(samples)
    if not n:
        raise ValueError("a baseline needs samples")
    q = np.zeros(n_classes)
    for r in class_distribution(samples).collect():
        q[r["class"]] = r["q"]
    edges = entropy_edges(n_classes, n_bins)
    hist = np.zeros(n_bins)
    for r in entropy_histogram(samples, edges).collect():
        hist[r["bin"]] = r["n"]
    made = Baseline(model_version, created_at, n, q, hist, np.array(edges), mean, precision(cov)).validate()
    return replace(made, checksum=made.digest())


FIELDS = "format string, model_version string, created_at string, sample_count long, class_distribution array<double>, entropy_histogram array<double>, entropy_bin_edges array<double>, embed_mean array<double>, embed_precision array<array<double>>, checksum string"


def to_frame(spark: SparkSession, b: Baseline) -> DataFrame:
    b.validate()
    row = (FORMAT, b.model_version, b.created_at, b.sample_count, *(getattr(b, f).tolist() for f in ("class_distribution", "entropy_histogram", "entropy_bin_edges", "embed_mean", "embed_precision")), b.digest())
    return spark.createDataFrame([row], FIELDS)


def save(spark: SparkSession, b: Baseline, path: str) -> str:
    """Writes a new path, never over an old one; the digest."""
    to_frame(spark, b).write.mode("error").parquet(path)
    return b.digest()


def load(spark: SparkSession, path: str, expected_model_version: str | None = None) -> Baseline:
    """Checks format, checksum and model version, then the values."""
    r = spark.read.parquet(path).first()
    if r is None or "format" not in r or r["format"] != FORMAT:
        raise BaselineError("not an artifact of this format")
    b = Baseline(r["model_version"], r["created_at"], r["sample_count"], *(np.array(r[f], float) for f in ("class_distribution", "entropy_histogram", "entropy_bin_edges", "embed_mean", "embed_precision")), r["checksum"])
    if b.digest() != b.checksum:
        raise BaselineError("the content does not have the stored checksum")
    if expected_model_version is not None and expected_model_version != b.model_version:
        raise BaselineError(f"made for {b.model_version}, not for {expected_model_version}")
    return b.validate()
