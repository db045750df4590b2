"""Exact top-k search by inner product, by no-random-access aggregation.

Vectors are packed into blocks of at most ``BLOCK`` rows.  In a block each component
has a list sorted by value; a query reads all its lists downwards (lists of negative
query components upwards) in steps of equal depth.  After each step every candidate
has a lower bound (what was read, and the list's last value for the rest) and an upper
bound (what was read, and the value at the list's front).  Candidates whose upper bound
is below the k-th lower bound are out for good; reading ends when nothing but the top k
(and ties with it) is left, whose scores are then summed in full.

Queries and candidates meet block by block, the stated query set against all rows.
Candidate blocks stay where they are: query blocks go out to them by broadcasts of at most
``SENT`` bytes, one after another, and a task keeps k rows for each query, so nothing but
those is shuffled afterwards.

Defined results: vectors that are null or hold a null or non-finite component take no
part, neither as query nor as candidate; scaled components have 64 bits, and one or a
returned score beyond raises an error, as in SQL;
only vectors of one length meet; an id that occurs more than once counts once per row, and a row is
never its own candidate (rows that repeat a query's id are left out as its own row);
ties go to the smaller id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, QUERY_BLOCK = 4096, 1024
#: Depths of the sorted reads, as shares of a block; candidates are pruned at each.
STEPS = (1 / 64, 1 / 16, 0.25, 0.5, 0.7, 0.85, 1.0)
#: Queries by which a block finds out from which depth on reading excludes anything.
PROBED = 8
#: Bytes of queries that are broadcast at a time.
SENT = 32 << 20
PACKED = "n int, dim int, ids binary, rows binary"


def _pack(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Blocks of at most ``most`` whole vectors of one length."""
    held: dict[int, list] = {}

    def block(dim: int, rows: list) -> pd.DataFrame:
        ids = np.array([i for i, _ in rows], "<i8")
        values = np.stack([v for _, v in rows]).astype("<i8")
        # 32 bits where they do
        narrow = not values.size or (values.max() < 2**31 and values.min() >= -(2**31))
        return pd.DataFrame({"n": [len(rows)], "dim": [dim], "ids": [ids.tobytes()], "rows": [values.astype("<i4" if narrow else "<i8").tobytes()]})

    for pdf in batches:
        for i, v in zip(pdf["id"], pdf["v"], strict=True):
            rows = held.setdefault(len(v), [])
            rows.append((i, np.asarray(v)))
            if len(rows) == most:
                yield block(len(v), rows)
                held[len(v)] = []
    for dim, rows in held.items():
        if rows:
            yield block(dim, rows)


def _ints(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8" if n * dim and len(raw) == 8 * n * dim else "<i4").reshape(n, dim)


def _largest(queries: np.ndarray, rows: np.ndarray) -> float:
    """No sum of products, nor a part of it, is beyond this."""
    return rows.shape[1] * float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0))


def _products(rows: np.ndarray, queries: np.ndarray, largest: float) -> np.ndarray:
    """Exact scores of pairs: 64-bit integers, or Python's where those could overflow."""
    if largest < 2.0**62:
        return np.einsum("ij,ij->i", rows.astype(np.int64), queries.astype(np.int64))
    return (rows.astype(object) * queries.astype(object)).sum(1)


def survivors(queries: np.ndarray, rows: np.ndarray, skip: np.ndarray, k: int) -> np.ndarray:
    """Which rows of a block may be among the best k of each query: a boolean matrix, rows by queries.

    ``skip`` marks the pairs that take no part.  A row that was read in a list counts with
    its value there, else with the list's last value (lower bound) or the value at the
    list's front (upper bound).  Positive components read downwards and negative ones
    upwards, so both bounds of all pairs are sums over two halves of a query.  Bounds are
    taken first where, for a few queries, they exclude half of the candidates: any depth
    to begin with gives the same rows.
    """
    n = len(rows)
    # sums below 2 ** 53 are exact; beyond, nothing is dropped that rounding could have put below the bar
    largest = _largest(queries, rows)
    slack = 0.0 if largest < 2.0**53 else largest * (rows.shape[1] + 4) * 2.0**-50
    order = rows.argsort(0, kind="stable")
    place = np.empty(rows.shape, np.int32)
    np.put_along_axis(place, order, np.arange(n, dtype=np.int32)[:, None], 0)
    values = np.take_along_axis(rows, order, 0)

    def read(depth: int, up: np.ndarray, down: np.ndarray, skip: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top, bottom = place >= n - depth, place < depth
        low = np.where(top, rows, values[0]) @ up + np.where(bottom, rows, values[-1]) @ down
        low[skip] = -np.inf
        if n > k:
            bar = np.maximum(bar, np.partition(low, n - k, axis=0)[n - k])
        high = low if depth == n else np.where(top, rows, values[n - depth]) @ up + np.where(bottom, rows, values[depth - 1]) @ down
        return (high >= bar - slack) & ~skip, bar

    up, down = np.maximum(queries, 0).T.copy(), np.minimum(queries, 0).T.copy()
    depths = sorted({min(n, max(1, round(n * share))) for share in STEPS})
    none = np.full(len(queries), -np.inf)
    some = slice(None, None, max(1, len(queries) // PROBED))
    first = next(d for d in depths if d == n or 2 * np.count_nonzero(read(d, up[:, some], down[:, some], skip[:, some], none[some])[0]) <= skip[:, some].size)
    bar = none
    for depth in (d for d in depths if d >= first):
        alive, bar = read(depth, up, down, skip, bar)
        if depth == n or np.count_nonzero(alive) <= 4 * k * len(queries):
            break
    return alive


def best_of(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, by query, score downwards and id."""
    parts = (score,) if score.dtype != object else [x.astype(np.int64) for x in (score & 0xFFFFFFFF, score >> 32 & 0xFFFFFFFF, score >> 64)]
    best = np.lexsort((ids, *[-x for x in parts], q))
    q = q[best]
    new = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    first = np.repeat(new, np.diff(np.append(new, len(q))))
    return best[np.arange(len(q)) - first < k]


def _search(asked, k: int):
    """A task's k best rows for each of the queries in ``asked``: (ids, vectors) of blocks."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        blocks = [(np.frombuffer(i, "<i8"), dim, _ints(v, n, dim)) for n, dim, i, v in asked.value]
        for pdf in batches:
            for row in pdf.itertuples():
                ids, rows = np.frombuffer(row.ids, "<i8"), _ints(row.rows, row.n, row.dim)
                for b, (q_ids, dim, queries) in enumerate(blocks):
                    if dim != row.dim:
                        continue
                    alive = survivors(queries.astype(np.float64), rows.astype(np.float64), ids[:, None] == q_ids[None, :], k)
                    q, i = np.nonzero(alive.T)
                    largest = _largest(queries, rows)
                    score = np.concatenate([_products(rows[i[a : a + BLOCK]], queries[q[a : a + BLOCK]], largest) for a in range(0, len(i), BLOCK)] or [np.zeros(0, np.int64)])
                    found = q, ids[i], score
                    if b in held:
                        found = tuple(np.concatenate([x, y]) for x, y in zip(held[b], found, strict=True))
                    keep = best_of(*found, k)
                    held[b] = tuple(x[keep] for x in found)
        for b, (q, ids, score) in held.items():
            # a score beyond 64 bits raises here
            yield pd.DataFrame({"query_id": blocks[b][0][q], "vec_id": ids, "score": score.astype(np.int64)})

    return search


def _parts(asked: DataFrame) -> Iterator[list[tuple]]:
    """Query blocks as lists of at most ``SENT`` bytes (one block at least), fetched one after another."""
    part, size = [], 0
    for r in asked.toLocalIterator():
        if part and size + r["size"] > SENT:
            yield part
            part, size = [], 0
        part.append((r["n"], r["dim"], bytes(r["ids"]), bytes(r["rows"])))
        size += r["size"]
    if part:
        yield part


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's k best candidates: ``query_id, rank, vec_id, score``.

    ``queries`` and ``vectors`` have the same two columns; components are turned into
    ``floor(scale * x)``.  At a third of all rows with one vector nothing changes: rows
    are dealt out by number, never by value.
    """
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector)
        fit = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
        scaled = lambda v: v.cast("double") * scale
        whole = lambda v: F.when(F.abs(scaled(v)) < 2.0**63, F.floor(scaled(v)).cast("long")).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("long"))
        return df.where(fit).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))

    at = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = whole(queries).repartition(max(1, min(at, -(-queries.count() // QUERY_BLOCK))))
    asked = asked.mapInPandas(lambda b: _pack(b, QUERY_BLOCK), PACKED)
    asked = common.stored(asked.withColumn("size", F.length("ids") + F.length("rows")), "queries")
    blocks = common.stored(whole(vectors).mapInPandas(lambda b: _pack(b, BLOCK), PACKED), "vectors")
    path = common.work_path(spark, "found")
    schema = "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in _parts(asked):
        sent = spark.sparkContext.broadcast(part)
        blocks.mapInPandas(_search(sent, k), schema).write.mode("append").parquet(path)
        sent.unpersist()
    found = spark.read.schema(schema).parquet(path)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    # each task gives at most k rows for a query; two levels of merging keep the groups small
    first = found.groupBy("query_id", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(best.alias("best"))
    last = first.select("query_id", F.inline("best")).withColumn("score", -F.col("s"))
    last = last.groupBy("query_id").agg(best.alias("best"))
    return last.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
