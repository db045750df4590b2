"""Queries over observations: functions, baseline aggregates and detectors."""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import baseline as B
from ..operators import detectors as D
from ..sources import adapters as A
from ..sources.shared import shared_dir
from .registry import query, rounded
from .sql import BINS, COV, HIST, OBS, OUT

DIMS = 64


def _obs(spark: SparkSession, d: str) -> DataFrame:
    return A.observations(spark, d)


def _samples(spark: SparkSession, d: str, with_z: bool = False) -> tuple[DataFrame, DataFrame]:
    """Samples with outputs, and the baseline part of them."""
    obs = _obs(spark, d)
    cut = A.split_point(obs)
    out = A.with_outputs(obs, A.centroids(obs, cut), with_z)
    return out, out.where(F.col("vec_id") < cut)


def _baseline(spark: SparkSession, d: str) -> B.Baseline:
    """One small artifact for each state of an input."""
    return _built(spark, d, A.version_of(spark, f"{d}/embeddings.parquet"))


@lru_cache(maxsize=16)
def _built(spark: SparkSession, d: str, version: str) -> B.Baseline:
    return B.build(_samples(spark, d, True)[1], A.CLASSES, "fixture", "2024-01-01T00:00:00+00:00", BINS)


def r6(c, name: str):
    return rounded(c, 6).alias(name)


def _class_rows(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode("probs").alias("class", "p"))


@query("observe_steps", f"WITH {OBS} SELECT step, count(*) AS n_samples FROM e GROUP BY step")
def observe_steps(spark, d):
    return _obs(spark, d).groupBy("step").agg(F.count("*").alias("n_samples"))


_BROKEN = "v AS (SELECT step, vec_id, CASE WHEN vec_id % 97 = 0 THEN z[1:63] ELSE z END AS z FROM e), bad AS (SELECT step, count(*) AS n FROM v GROUP BY step HAVING min(CAST(len(z) = 64 AS INT)) = 0 OR count(*) > 25)"


def _broken(spark, d):
    z = F.when(F.col("vec_id") % 97 == 0, F.slice("z", 1, 63)).otherwise(F.col("z"))
    return A.validated(_obs(spark, d).withColumn("z", z), DIMS, A.BATCH)


@query("observations_validated", f"WITH {OBS}, {_BROKEN} SELECT step, vec_id FROM v WHERE step NOT IN (SELECT step FROM bad)")
def observations_validated(spark, d):
    return _broken(spark, d)[0].select("step", "vec_id")


@query("observations_dropped", f"WITH {OBS}, {_BROKEN} SELECT count(*) AS dropped_batches FROM bad")
def observations_dropped(spark, d):
    return _broken(spark, d)[1].agg(F.count("*").alias("dropped_batches"))


@query("logits_coalesce", "SELECT vec_id, round(CAST(coalesce(CASE WHEN label = 0 THEN embedding[1] END, CASE WHEN label < 4 THEN embedding[2] END, embedding[3]) AS DOUBLE), 6) AS v FROM embeddings")
def logits_coalesce(spark, d):
    e = A.table(spark, d, "embeddings")
    v = V.first_output(F.when(F.col("label") == 0, F.col("embedding")[0]), F.when(F.col("label") < 4, F.col("embedding")[1]), F.col("embedding")[2])
    return e.select("vec_id", r6(v.cast("double"), "v"))


def _reduced(mode):
    def run(spark, d):
        tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("z", i * 16 + 1, F.lit(16)))
        return _obs(spark, d).select("vec_id", F.posexplode(V.reduce_tokens(tokens, mode)).alias("d", "x")).select("vec_id", "d", r6(F.col("x"), "x"))

    return run


_MEAN = f"WITH {OBS} SELECT vec_id, CAST(d AS INTEGER) AS d, round((z[d + 1] + z[d + 17] + z[d + 33] + z[d + 49]) / 4, 6) AS x FROM e, range(0, 16) r(d)"
for _m, _sql in (("cls", f"WITH {OBS} SELECT vec_id, CAST(d AS INTEGER) AS d, round(z[d + 1], 6) AS x FROM e, range(0, 16) r(d)"), ("mean", _MEAN), ("auto", _MEAN), ("flatten", f"WITH {OBS} SELECT vec_id, CAST(d AS INTEGER) AS d, round(z[d + 1], 6) AS x FROM e, range(0, 64) r(d)")):
    query(f"embed_reduce_{_m}", _sql)(_reduced(_m))


@query("last_n_names", "SELECT * FROM (VALUES (0, 'o_totalprice'), (1, 'o_orderdate'), (2, 'o_orderpriority')) t(position, name)")
def last_n_names(spark, d):
    return spark.createDataFrame(list(enumerate(A.last_names(A.table(spark, d, "orders"), 3))), "position int, name string")


@query("eval_only_filter", "SELECT event_id FROM events WHERE NOT (event_id % 3 = 0)")
def eval_only_filter(spark, d):
    return A.eval_only(A.table(spark, d, "events"), F.col("event_id") % 3 == 0).select("event_id")


@query("pair_outputs", f"WITH {OBS} SELECT a.step, count(*) AS pairs FROM e a JOIN e b ON a.step = b.step AND a.sample = b.sample WHERE a.vec_id % 7 <> 0 GROUP BY a.step")
def pair_outputs(spark, d):
    obs = _obs(spark, d)
    left = obs.where(F.col("vec_id") % 7 != 0).select("step", "sample")
    return left.join(obs.select("step", "sample"), ["step", "sample"]).groupBy("step").agg(F.count("*").alias("pairs"))


@query("softmax_probs", f"WITH {OUT} SELECT vec_id, CAST(c AS INTEGER) AS class, round(p[c + 1], 6) AS p FROM pb, range(0, 10) r(c)")
def softmax_probs(spark, d):
    return _class_rows(_samples(spark, d)[0], "vec_id").select("vec_id", "class", r6(F.col("p"), "p"))


@query("softmax_entropy", "WITH l AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: 10 * CAST(x AS DOUBLE)) AS l FROM embeddings), x AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS x FROM l), p AS (SELECT vec_id, list_transform(x, lambda v: v / list_sum(x)) AS p FROM x) SELECT vec_id, round(greatest(0, -list_sum(list_transform(p, lambda v: v * ln(greatest(v, 1e-12))))), 6) AS h FROM p")
def softmax_entropy(spark, d):
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 10)
    p = A.table(spark, d, "embeddings").select("vec_id", V.softmax(logits).alias("p"))
    return p.select("vec_id", r6(V.entropy(F.col("p")), "h"))


_PQ = """WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: greatest(CAST(x AS DOUBLE), 0) + 1e-12) AS a, list_transform(embedding[9:16], lambda x: greatest(CAST(x AS DOUBLE), 0) + 1e-12) AS b FROM embeddings),
d AS (SELECT vec_id, list_transform(a, lambda x: x / list_sum(a)) AS p, list_transform(b, lambda x: x / list_sum(b)) AS q FROM v),
n AS (SELECT vec_id, p, q, list_transform(list_zip(p, q), lambda t: (t[1] + t[2]) / 2) AS m FROM d),
s AS (SELECT vec_id, p, q, list_transform(p, lambda x: (x + 1e-12) / list_sum(list_transform(p, lambda y: y + 1e-12))) AS p2, list_transform(q, lambda x: (x + 1e-12) / list_sum(list_transform(q, lambda y: y + 1e-12))) AS q2, list_transform(m, lambda x: (x + 1e-12) / list_sum(list_transform(m, lambda y: y + 1e-12))) AS m2 FROM n)"""
_KL = "list_sum(list_transform(list_zip({a}, {b}), lambda t: t[1] * (ln(t[1] + 1e-12) - ln(t[2] + 1e-12))))"


def _pq(spark, d):
    part = lambda i: F.transform(F.slice("embedding", i, 8), lambda x: x.cast("double"))
    return A.table(spark, d, "embeddings").select("vec_id", part(1).alias("a"), part(9).alias("b"))


@query("as_distribution", _PQ + " SELECT vec_id, CAST(c AS INTEGER) AS class, round(p[c + 1], 6) AS p FROM d, range(0, 8) r(c)")
def as_distribution(spark, d):
    return _pq(spark, d).select("vec_id", F.posexplode(V.as_distribution(F.col("a"))).alias("class", "p")).select("vec_id", "class", r6(F.col("p"), "p"))


@query("kl_divergence", _PQ + f" SELECT vec_id, round({_KL.format(a='p', b='q')}, 6) AS kl FROM d")
def kl_divergence(spark, d):
    return _pq(spark, d).select("vec_id", r6(V.kl(F.col("a"), F.col("b")), "kl"))


@query("js_divergence", _PQ + f" SELECT vec_id, round(({_KL.format(a='p2', b='m2')} + {_KL.format(a='q2', b='m2')}) / 2, 6) AS js FROM s")
def js_divergence(spark, d):
    return _pq(spark, d).select("vec_id", r6(V.js(F.col("a"), F.col("b")), "js"))


@query("entropy_bin_edges", f"SELECT CAST(i AS INTEGER) AS i, round(i * ln(10) / {BINS}, 6) AS edge FROM range(0, {BINS + 1}) r(i)")
def entropy_bin_edges(spark, d):
    edges = V.entropy_edges(A.CLASSES, BINS)
    return spark.range(len(edges)).select(F.col("id").cast("int").alias("i"), r6(F.get(F.array(*[F.lit(e) for e in edges]), F.col("id").cast("int")), "edge"))


@query("entropy_bucketize", f"WITH {HIST} SELECT vec_id, CAST((SELECT count(*) FROM edge WHERE i BETWEEN 1 AND {BINS - 1} AND e < h) AS INTEGER) AS bin FROM pb")
def entropy_bucketize(spark, d):
    return _samples(spark, d)[0].select("vec_id", V.bin_right_closed(F.col("h"), V.entropy_edges(A.CLASSES, BINS)).cast("int").alias("bin"))


@query("entropy_histogram", f"WITH {HIST} SELECT bin, n FROM hist")
def entropy_histogram(spark, d):
    return B.entropy_histogram(_samples(spark, d)[1], V.entropy_edges(A.CLASSES, BINS))


@query("baseline_class_distribution", f"WITH {OUT} SELECT CAST(class AS INTEGER) AS class, round(q, 6) AS q FROM q")
def baseline_class_distribution(spark, d):
    return B.class_distribution(_samples(spark, d)[1]).select("class", r6(F.col("q"), "q"))


@query("baseline_embed_mean", f"WITH {OBS} SELECT CAST(d AS INTEGER) AS d, round(avg(z[d + 1]), 6) AS m FROM e, range(0, 64) r(d) WHERE vec_id < (SELECT c FROM cut) GROUP BY d")
def baseline_embed_mean(spark, d):
    obs = _obs(spark, d)
    return A.per_dimension(obs.where(F.col("vec_id") < A.split_point(obs))).groupBy("d").agg(r6(F.avg("x"), "m"))


def _matrix(spark, m: np.ndarray, digits: int, name: str) -> DataFrame:
    rows = [(int(i), int(j), float(m[i, j])) for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(rows, f"i int, j int, {name} double").select("i", "j", rounded(name, digits).alias(name))


@query("baseline_covariance", f"WITH RECURSIVE {COV} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(c, 6) AS c FROM cov")
def baseline_covariance(spark, d):
    return _matrix(spark, B.moments(_samples(spark, d, True)[1])[2], 6, "c")


@query("baseline_precision", f"WITH RECURSIVE {COV} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p[i + 1][j + 1], 4) AS p FROM prec, range(0, 64) a(i), range(0, 64) b(j)")
def baseline_precision(spark, d):
    return _matrix(spark, _baseline(spark, d).embed_precision, 4, "p")


@query("baseline_sample_count", f"WITH {OBS} SELECT count(*) AS n FROM e WHERE vec_id < (SELECT c FROM cut)")
def baseline_sample_count(spark, d):
    return spark.createDataFrame([(_baseline(spark, d).sample_count,)], "n long")


@query("baseline_adequacy", f"WITH {OBS}, n AS (SELECT count(*) AS n FROM e WHERE vec_id < (SELECT c FROM cut)) SELECT round(n / 64.0, 6) AS ratio, CASE WHEN n < 20 * 64 THEN 'too small' WHEN n < 50 * 64 THEN 'usable' ELSE 'comfortable' END AS verdict FROM n")
def baseline_adequacy(spark, d):
    b = _baseline(spark, d)
    n = spark.createDataFrame([(b.sample_count, len(b.embed_mean))], "n long, dims int")
    verdict = F.when(F.col("n") < 20 * F.col("dims"), "too small").when(F.col("n") < 50 * F.col("dims"), "usable").otherwise("comfortable")
    return n.select(r6(F.col("n") / F.col("dims"), "ratio"), verdict.alias("verdict"))


def _kept(spark, d) -> str:
    """The baseline as an artifact of its own, in the shared folder."""
    path = f"{shared_dir(spark)}/baseline-{uuid.uuid4().hex}"
    B.save(spark, _baseline(spark, d), path)
    return path


@query("baseline_roundtrip", f"WITH {HIST} SELECT 'fixture' AS model_version, (SELECT count(*) FROM base) AS sample_count, CAST(class AS INTEGER) AS class, round(q, 6) AS q, (SELECT sum(n) FROM hist) AS in_histogram FROM q")
def baseline_roundtrip(spark, d):
    """What ``load`` gives after ``save``: it checks format, checksum and values on the way."""
    b = B.load(spark, _kept(spark, d), "fixture")
    rows = [(b.model_version, b.sample_count, i, float(q), int(b.entropy_histogram.sum())) for i, q in enumerate(b.class_distribution)]
    return spark.createDataFrame(rows, "model_version string, sample_count long, class int, q double, in_histogram long").withColumn("q", r6(F.col("q"), "q"))


@query("detector_reference", "SELECT * FROM (VALUES ('divergence', 'class_distribution'), ('embedding', 'embed_mean'), ('embedding', 'embed_precision'), ('entropy', 'entropy_bin_edges'), ('entropy', 'entropy_histogram')) t(detector, field)")
def detector_reference(spark, d):
    return spark.createDataFrame([(k, f) for k, fs in D.REFERENCE.items() for f in fs], "detector string, field string")


@query("entropy_mean", f"WITH {OUT} SELECT step, round(avg(h), 6) AS entropy_mean FROM pb GROUP BY step")
def entropy_mean(spark, d):
    return D.entropy_steps(_samples(spark, d)[0]).select("step", r6(F.col("entropy_mean"), "entropy_mean"))


@query("entropy_quantile", f"WITH {OUT} SELECT step, round(quantile_cont(h, 0.99), 6) AS entropy_quantile FROM pb GROUP BY step")
def entropy_quantile(spark, d):
    return D.entropy_steps(_samples(spark, d)[0], 0.99).select("step", r6(F.col("entropy_quantile"), "entropy_quantile"))


@query("entropy_pop_shift", f"""WITH {HIST},
b AS (SELECT step, (SELECT count(*) FROM edge WHERE i BETWEEN 1 AND {BINS - 1} AND e < h) AS bin FROM pb),
n AS (SELECT s.step, hist.bin, hist.n / (SELECT sum(n) FROM hist) AS q, count(b.bin) AS k FROM (SELECT DISTINCT step FROM b) s CROSS JOIN hist LEFT JOIN b ON b.step = s.step AND b.bin = hist.bin GROUP BY s.step, hist.bin, hist.n)
SELECT step, round(sum(abs(k / t - q)) / 2, 6) AS entropy_pop_shift FROM (SELECT *, sum(k) OVER (PARTITION BY step) AS t FROM n) GROUP BY step""")
def entropy_pop_shift(spark, d):
    return D.population_shift(_samples(spark, d)[0], _baseline(spark, d)).select("step", r6(F.col("entropy_pop_shift"), "entropy_pop_shift"))


@query("mean_softmax", f"WITH {OUT} SELECT step, CAST(c AS INTEGER) AS class, round(avg(p[c + 1]), 6) AS p FROM pb, range(0, 10) r(c) GROUP BY step, c")
def mean_softmax(spark, d):
    return D.mean_softmax(_samples(spark, d)[0]).select("step", "class", r6(F.col("p"), "p"))


@query("step_kl_js", f"""WITH {OUT}, m AS (SELECT step, c, avg(p[c + 1]) AS p FROM pb, range(0, 10) r(c) GROUP BY step, c)
SELECT step, round(sum(p * (ln(p + 1e-12) - ln(q + 1e-12))), 6) AS kl_divergence,
  round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 6) AS js_divergence
FROM m JOIN q ON m.c = q.class GROUP BY step""")
def step_kl_js(spark, d):
    return D.divergence_steps(_samples(spark, d)[0], _baseline(spark, d)).select("step", r6(F.col("kl_divergence"), "kl_divergence"), r6(F.col("js_divergence"), "js_divergence"))


@query("mahalanobis_distance", f"WITH RECURSIVE {COV} SELECT vec_id, round(distance, 4) AS distance FROM mah")
def mahalanobis_distance(spark, d):
    b = _baseline(spark, d)
    return D.mahalanobis(_obs(spark, d), b.embed_mean, b.embed_precision).select("vec_id", rounded("distance", 4).alias("distance"))


@query("embedding_mahalanobis_mean", f"WITH RECURSIVE {COV} SELECT step, round(avg(distance), 4) AS embedding_mahalanobis_mean FROM mah GROUP BY step")
def embedding_mahalanobis_mean(spark, d):
    return D.mahalanobis_steps(_obs(spark, d), _baseline(spark, d)).select("step", rounded("embedding_mahalanobis_mean", 4).alias("embedding_mahalanobis_mean"))


DECAY, EVERY = 0.99, 4
_STEPS = f"""ss AS MATERIALIZED (SELECT step, d, sum(z[d]) AS s, count(*) AS n FROM e, range(1, 65) r(d) GROUP BY step, d),
rm AS MATERIALIZED (SELECT t.step, a.d, sum(pow({DECAY}, t.step - a.step) * s) / sum(pow({DECAY}, t.step - a.step) * n) AS m, sum(pow({DECAY}, t.step - a.step) * n) AS n FROM (SELECT DISTINCT step FROM e) t JOIN ss a ON a.step <= t.step GROUP BY t.step, a.d),
dm AS (SELECT step, list(m - mu[d] ORDER BY d) AS d FROM rm, mu GROUP BY step),
shift AS (SELECT step, sqrt(greatest(0, list_dot_product(list_transform(prec.p, lambda r: list_dot_product(r, d)), d))) AS v FROM dm, prec),
cc AS MATERIALIZED (SELECT step, i, j, sum(z[i] * z[j]) AS s FROM e, range(1, 65) a(i), range(1, 65) b(j) GROUP BY step, i, j),
rc AS MATERIALIZED (
  SELECT t.step, i, j, (sum(pow({DECAY}, t.step - c.step) * c.s) - any_value(x.n) * any_value(x.m) * any_value(y.m)) / (any_value(x.n) - 1) AS c
  FROM (SELECT DISTINCT step FROM e WHERE step % {EVERY} = 0) t JOIN cc c ON c.step <= t.step
  JOIN rm x ON x.step = t.step AND x.d = i JOIN rm y ON y.step = t.step AND y.d = j GROUP BY t.step, i, j)"""


def _running(spark, d):
    return D.running_embedding(_obs(spark, d), _baseline(spark, d), DECAY, EVERY)


@query("embedding_running_mean", f"WITH RECURSIVE {COV}, {_STEPS} SELECT step, CAST(d - 1 AS INTEGER) AS d, round(m, 6) AS m FROM rm")
def embedding_running_mean(spark, d):
    return _running(spark, d).select("step", F.posexplode("running_mean").alias("d", "m")).select("step", "d", r6(F.col("m"), "m"))


@query("embedding_mean_shift", f"WITH RECURSIVE {COV}, {_STEPS} SELECT step, round(v, 4) AS embedding_mean_shift FROM shift")
def embedding_mean_shift(spark, d):
    return _running(spark, d).select("step", rounded("embedding_mean_shift", 4).alias("embedding_mean_shift"))


@query("embedding_cov_drift", f"""WITH RECURSIVE {COV}, {_STEPS},
row AS (SELECT step, i, list(c ORDER BY j) AS r FROM rc GROUP BY step, i),
cell AS (SELECT step, sqrt(sum(pow(list_dot_product(r, prec.p[j]) - CASE WHEN i = j THEN 1 ELSE 0 END, 2))) AS v FROM row, prec, range(1, 65) b(j) GROUP BY step)
SELECT t.step, round(c.v, 3) AS embedding_cov_drift FROM (SELECT DISTINCT step FROM e) t JOIN cell c ON c.step = t.step - t.step % {EVERY}""")
def embedding_cov_drift(spark, d):
    return _running(spark, d).select("step", rounded("embedding_cov_drift", 3).alias("embedding_cov_drift"))
