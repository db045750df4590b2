"""Column builders over arrays of doubles; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest probability that a logarithm sees.
EPS = 1e-12
INF = float("inf")


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite; Spark orders NaN above all numbers, so comparisons need this first."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so that none overflows; single-element transforms bind what would be evaluated again."""
    shifted = F.flatten(F.transform(F.array(F.array_max(logits)), lambda m: F.transform(logits, lambda x: F.exp(x - m))))
    return F.flatten(F.transform(F.array(shifted), lambda e: F.flatten(F.transform(F.array(total(e)), lambda s: F.transform(e, lambda x: x / s)))))


def entropy(p: Column, eps: float = EPS) -> Column:
    """Shannon entropy in nats: the floor is inside the logarithm, and the sum is not below 0."""
    return F.greatest(F.lit(0.0), -total(F.transform(p, lambda x: x * F.ln(F.greatest(x, F.lit(eps))))))


def as_distribution(x: Column, eps: float = EPS) -> Column:
    """Clipped at 0, smoothed, normalised; all zeros become uniform."""
    raised = F.transform(x, lambda v: F.greatest(v, F.lit(0.0)) + eps)
    return F.flatten(F.transform(F.array(raised), lambda r: F.flatten(F.transform(F.array(total(r)), lambda s: F.transform(r, lambda v: v / s)))))


def kl(p: Column, q: Column, eps: float = EPS) -> Column:
    """KL(P || Q) of two non-negative vectors, each made a distribution first."""
    return total(F.zip_with(as_distribution(p, eps), as_distribution(q, eps), lambda a, b: a * (F.ln(a + eps) - F.ln(b + eps))))


def js(p: Column, q: Column, eps: float = EPS) -> Column:
    """Jensen-Shannon divergence, from 0 to ln 2."""
    a, b = as_distribution(p, eps), as_distribution(q, eps)
    mid = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return (kl(a, mid, eps) + kl(b, mid, eps)) / 2


def bin_right_closed(x: Column, edges: list[float]) -> Column:
    """Number of interior edges below ``x``: bins (e_i, e_i+1], outliers in the outer ones."""
    return sum((F.when(x > e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0)) if len(edges) <= 32 else F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[1:-1]]), lambda e: e < x))


def bin_left_closed(x: Column, edges: list[float]) -> Column:
    """Bins [e_i, e_i+1) of equal width after clamping; the last one is closed."""
    n, low, high = len(edges) - 1, edges[0], edges[-1]
    inside = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.least(F.floor((inside - low) / ((high - low) / n)), F.lit(n - 1)).cast("int")


def entropy_edges(n_classes: int, n_bins: int = 64) -> list[float]:
    return [i * math.log(n_classes) / n_bins for i in range(n_bins + 1)]


def total_variation(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def reduce_tokens(tokens: Column, mode: str) -> Column:
    """A per-token matrix to one vector: its first row (cls), the mean of its rows (mean, auto), or all of it (flatten)."""
    if mode == "cls":
        return F.get(tokens, F.lit(0))
    if mode == "flatten":
        return F.flatten(tokens)
    if mode in ("mean", "auto"):
        zero = F.transform(F.get(tokens, F.lit(0)), lambda x: F.lit(0.0))
        return F.aggregate(tokens, zero, lambda a, r: F.zip_with(a, r, lambda x, y: x + y), lambda a: F.transform(a, lambda x: x / F.size(tokens)))
    raise ValueError(f"no such reduction: {mode}")


def first_output(*columns: Column) -> Column:
    """The first output field that a model gave, by order of preference."""
    return F.coalesce(*columns)


def truthy(s: Column) -> Column:
    return F.coalesce(F.lower(F.trim(s)).isin("1", "true", "yes", "on"), F.lit(False))


def percent_change(a: Column, b: Column) -> Column:
    return F.when(a > 0, (b - a) / a * 100)
