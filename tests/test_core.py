import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.config import Config
from driftloom.functions import vectors as V
from driftloom.operators import baseline as B
from driftloom.operators import changepoint as C
from driftloom.operators import detectors as D
from driftloom.operators import rules as R
from driftloom.operators import windows as W
from driftloom.safety import Firewall, KillSwitch
from driftloom.sinks import export as X

STEP = [0.0] * 10 + [4.0] * 40


def first(method, **how):
    test = C.Test(8.0, method=method, **how)
    return [i for i, x in enumerate(STEP) if test.update(x)[0]]


@pytest.mark.parametrize("method", ["page_hinkley", "cusum"])
def test_golden_alarms(method):
    assert first(method)[0] == 12
    assert first(method, delta=1.0)[0] == 13
    assert first(method, debounce=5)[0] == 16


def test_golden_cusum_lists():
    assert first("cusum") == [12, 15, 19, 24, 30, 37, 46]
    assert first("cusum", cooldown=7) == [12, 20, 28, 36, 45]


@pytest.mark.parametrize(("debounce", "cooldown"), [(1, 0), (1, 4), (3, 0), (3, 5)])
def test_gate_when_always_raised(debounce, cooldown):
    test = C.Test(1.0, debounce=debounce, cooldown=cooldown)
    fired = [i for i in range(30) if test.gate(True)]
    assert fired == (list(range(0, 30, cooldown + 1)) if debounce == 1 else list(range(debounce - 1, 30, debounce + cooldown)))


@pytest.mark.parametrize("method", ["page_hinkley", "cusum"])
@pytest.mark.parametrize("seed", range(4))
def test_stationary_is_quiet_and_shift_is_found(method, seed):
    r = np.random.default_rng(seed)
    quiet = C.Test(10.0, 1.0, method)
    assert not any(quiet.update(x)[0] for x in r.normal(size=2000))
    r = np.random.default_rng(seed)
    moved = C.Test(10.0, 1.0, method)
    alarms = [i for i, x in enumerate(np.concatenate([r.normal(size=300), r.normal(4, 1, 300)])) if moved.update(x)[0]]
    assert alarms and 300 <= alarms[0] <= 360


def test_values_that_are_not_finite_touch_nothing():
    test, plain = C.Test(8.0), C.Test(8.0)
    for x in (1.0, 2.0, 7.0):
        plain.update(x)
        test.update(x)
        for bad in (math.nan, math.inf, -math.inf):
            assert test.update(bad)[0] is False
    assert test.state() == plain.state()


def stream(spark, values, metric="m"):
    return spark.createDataFrame([(metric, i, x) for i, x in enumerate(values)], "metric string, step long, value double")


def by_step(df, c):
    return [r[c] for r in df.orderBy("step").collect()]


def test_rolling_and_tumbling(spark):
    s = stream(spark, [float(i) for i in range(1, 9)])
    assert by_step(W.rolling_mean(s, 4), "rolling") == [1, 1.5, 2, 2.5, 3.5, 4.5, 5.5, 6.5]
    assert by_step(W.tumbling_mean(s, 4), "value") == [2.5, 6.5]
    odd = stream(spark, [1.0, math.nan, 2.0, 3.0, math.inf, -math.inf, 4.0])
    assert by_step(W.rolling_mean(odd, 3), "rolling") == [1, 1.5, 2, 3]
    assert by_step(W.tumbling_mean(odd, 3), "value") == [2.0]
    assert W.skipped(odd).first()["skipped"] == 3


def test_latch_and_edges(spark):
    s = stream(spark, [0.0] * 20)
    alarms = s.where("step = 5").select("metric", "step")
    dim = spark.createDataFrame([("m", "det")], "metric string, detector string")
    edges = W.edges(W.detector_state(W.latch(s, alarms, 2, 3), dim)).orderBy("step").collect()
    assert [(r["step"], r["active"]) for r in edges] == [(5, True), (11, False)]  # pushes 6 and 12, counted from 1
    assert not W.latch(s, alarms, 2, 0).where("active").count()


def test_closed_form_equals_the_fold_before_an_alarm(spark):
    values = np.random.default_rng(3).normal(size=60).tolist()
    s = stream(spark, values)
    test = C.Test(1e9, 0.2)
    want = [test.update(x)[1] for x in values]
    assert by_step(C.statistic_before_alarm(s, 0.2), "statistic") == pytest.approx(want, abs=1e-9)


def test_ema(spark):
    values = np.random.default_rng(1).normal(size=300).tolist()
    e, want = 0.0, []
    for x in values:
        e += 0.01 * (x - e)
        want.append(e)
    assert by_step(W.ema(stream(spark, values), 0.01), "ema") == pytest.approx(want, abs=1e-9)


def arrays(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r[0]], [float(x) for x in r[1]]) for i, r in enumerate(rows)], "i int, a array<double>, b array<double>").orderBy("i")


def np_dist(x):
    x = np.maximum(np.array(x, float), 0) + 1e-12
    return x / x.sum()


def np_kl(p, q):
    p, q = np_dist(p), np_dist(q)
    return float((p * (np.log(p + 1e-12) - np.log(q + 1e-12))).sum())


def test_entropy_and_divergences_against_numpy(spark):
    r = np.random.default_rng(0)
    rows = [(r.normal(size=n) * s, r.random(n)) for n in (2, 10, 32) for s in (1, 30, 1000)] + [([1e4, 0, 0], [1, 0, 0]), ([0, 0, 0, 0], [0, 0, 0, 1]), ([1, 0, 0, 0], [0, 0, 0, 1])]
    got = arrays(spark, rows).select(V.entropy(V.softmax(F.col("a"))).alias("h"), V.kl(F.col("a"), F.col("b")).alias("kl"), V.js(F.col("a"), F.col("b")).alias("js")).collect()
    for g, (a, b) in zip(got, rows, strict=True):
        e = np.exp(np.array(a, float) - np.max(a))
        p = e / e.sum()
        m = (np_dist(a) + np_dist(b)) / 2
        assert g["h"] == pytest.approx(max(0.0, -(p * np.log(np.maximum(p, 1e-12))).sum()), abs=1e-9)
        assert g["kl"] == pytest.approx(np_kl(a, b), abs=1e-9)
        assert g["js"] == pytest.approx((np_kl(np_dist(a), m) + np_kl(np_dist(b), m)) / 2, abs=1e-9)
        assert -1e-9 <= g["js"] <= math.log(2) + 1e-9


def test_bins_differ_on_an_edge(spark):
    edges = [0.0, 1.0, 2.0, 3.0]
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 1.5, 2.0, 3.0, 9.0)], "x double").select(V.bin_right_closed(F.col("x"), edges).alias("r"), V.bin_left_closed(F.col("x"), edges).alias("l")).collect()
    assert [g["r"] for g in got] == [0, 0, 0, 1, 1, 2, 2]
    assert [g["l"] for g in got] == [0, 0, 1, 1, 2, 2, 2]


def samples(spark, n=200, dims=6, classes=5, seed=0, shift=0.0):
    r = np.random.default_rng(seed)
    z = r.normal(size=(n, dims)) + shift
    p = r.dirichlet(np.ones(classes), n)
    h = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
    rows = [(i // 10, i % 10, z[i].tolist(), p[i].tolist(), float(h[i])) for i in range(n)]
    return spark.createDataFrame(rows, "step long, sample long, z array<double>, probs array<double>, h double").repartition(3), z, p, h


def test_baseline_against_numpy_and_round_trip(spark, tmp_path):
    df, z, p, h = samples(spark)
    b = B.build(df, 5, "m1", "2024", 8)
    assert b.sample_count == 200 and np.allclose(b.embed_mean, z.mean(0)) and np.allclose(b.class_distribution, p.mean(0))
    cov = np.cov(z.T)
    assert np.allclose(b.embed_precision, np.linalg.inv(cov + 1e-4 * np.diag(cov).max() * np.eye(6)))
    assert np.array_equal(b.entropy_histogram, np.histogram(h, b.entropy_bin_edges)[0])
    digest = B.save(spark, b, f"{tmp_path}/b")
    assert B.load(spark, f"{tmp_path}/b", "m1").checksum == digest == b.checksum
    with pytest.raises(B.BaselineError):
        B.load(spark, f"{tmp_path}/b", "m2")
    spark.read.parquet(f"{tmp_path}/b").withColumn("sample_count", F.lit(7).cast("long")).write.parquet(f"{tmp_path}/c")
    with pytest.raises(B.BaselineError):
        B.load(spark, f"{tmp_path}/c")
    with pytest.raises(ValueError):
        B.build(df.where("false"), 5, "m", "t")


def test_detectors_against_numpy(spark):
    df, *_ = samples(spark)
    b = B.build(df, 5, "m1", "2024", 8)
    live, z, p, h = samples(spark, seed=1, shift=0.5)
    steps = np.arange(200) // 10
    ent = {r["step"]: r for r in D.entropy_steps(live, 0.9).collect()}
    pop = {r["step"]: r[1] for r in D.population_shift(live, b).collect()}
    div = {r["step"]: r for r in D.divergence_steps(live, b).collect()}
    mah = {r["step"]: r[1] for r in D.mahalanobis_steps(live, b).collect()}
    run = {r["step"]: r for r in D.running_embedding(live, b, 0.9, 4).collect()}
    q = b.entropy_histogram / b.entropy_histogram.sum()
    seen = []
    for s in range(20):
        own = steps == s
        assert ent[s]["entropy_mean"] == pytest.approx(h[own].mean()) and ent[s]["entropy_quantile"] == pytest.approx(np.quantile(h[own], 0.9))
        counts = np.bincount(np.searchsorted(b.entropy_bin_edges[1:-1], h[own], side="left"), minlength=8) / own.sum()
        assert pop[s] == pytest.approx(np.abs(counts - q).sum() / 2)
        assert div[s]["kl_divergence"] == pytest.approx(np_kl(p[own].mean(0), b.class_distribution), abs=1e-9)
        d = z[own] - b.embed_mean
        assert mah[s] == pytest.approx(np.sqrt(((d @ b.embed_precision) * d).sum(1)).mean())
        seen.append(z[own])
        w = np.concatenate([np.full(len(x), 0.9 ** (s - i)) for i, x in enumerate(seen)])
        x = np.concatenate(seen)
        m = (w[:, None] * x).sum(0) / w.sum()
        assert run[s]["embedding_mean_shift"] == pytest.approx(np.sqrt((m - b.embed_mean) @ b.embed_precision @ (m - b.embed_mean)))
        if s % 4 == 0:
            c = (w[:, None] * (x - m)).T @ (x - m) / (w.sum() - 1)
            held = np.linalg.norm(c @ b.embed_precision - np.eye(6))
        assert run[s]["embedding_cov_drift"] == pytest.approx(held)


def test_running_moments_do_not_depend_on_chunks(spark, monkeypatch):
    df, *_ = samples(spark)
    b = B.build(df, 5, "m1", "2024", 8)
    want = [tuple(r)[2:] for r in D.running_embedding(df, b, 0.9, 4).orderBy("step").collect()]
    monkeypatch.setattr(D, "CHUNK", 3)
    got = [tuple(r)[2:] for r in D.running_embedding(df, b, 0.9, 4).orderBy("step").collect()]
    assert np.allclose(got, want)


def test_one_sample_has_no_covariance_drift(spark):
    df, *_ = samples(spark)
    b = B.build(df, 5, "m1", "2024", 8)
    assert D.running_embedding(df.where("step = 0 AND sample = 0"), b).first()["embedding_cov_drift"] == 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=60), st.sampled_from(["page_hinkley", "cusum"]), st.integers(1, 3), st.integers(0, 4))
def test_transition_against_a_plain_form(xs, method, debounce, cooldown):
    test = C.Test(5.0, 0.5, method, debounce, cooldown)
    n = m = c = least = 0.0
    run = cool = 0
    for x in xs:
        n += 1
        m += (x - m) / n
        c = c + (x - m - 0.5) if method == "page_hinkley" else max(0.0, c + x - m - 0.5)
        least = min(least, c) if method == "page_hinkley" else 0.0
        alarm = False
        if cool:
            cool, run = cool - 1, 0
        else:
            run = run + 1 if c - least > 5.0 else 0
            if run >= debounce:
                alarm, run, cool = True, 0, cooldown
        assert test.update(x) == (alarm, c - least)
        if alarm:
            c = 0.0
            if method == "page_hinkley":
                n = m = least = 0.0


def test_config():
    c = Config.from_yaml("window_size: 8\ndrain_every_k: 4\ndetectors:\n- name: entropy\n  params: {quantile: 0.9}\n- name: divergence\n  enabled: false\nthresholds:\n  entropy_mean: {threshold: 2.0, method: cusum}\n")
    assert [d.name for d in c.active()] == ["entropy"] and c.thresholds["entropy_mean"].method == "cusum"
    assert Config.from_yaml(c.to_yaml()) == c and c.enabled is True and c.export.enabled
    both = "window_size: 8\ndrain_every_k: 4\n"
    for bad in ("", "[1]", "x: 1", "window_size: 8", "drain_every_k: 4", "window_size: 0\ndrain_every_k: 4", "window_size: 8\ndrain_every_k: 0", *(both + x for x in ("x: 1", "detectors: [{name: adwin}]", "detectors: [{name: entropy}, {name: entropy}]", "thresholds: {a: {threshold: 0}}", "thresholds: {a: {threshold: 1, debounce: 0}}", "export: {port: 0}", "detectors: [{name: entropy, params: {quantile: 1}}]"))):
        with pytest.raises(ValueError):
            Config.from_yaml(bad)


def test_firewall_and_switch(monkeypatch):
    f = Firewall(2)
    for _ in range(3):
        assert f.call("p", lambda: 1 / 0, default=7) == 7
    assert f.failures["p"] == 2 and f.disabled == ["p"]
    f.reset("p")
    assert f.call("p", lambda: 3) == 3
    with pytest.raises(ValueError):
        Firewall(0)
    k = KillSwitch("X_OFF")
    assert k.enabled
    monkeypatch.setenv("X_OFF", " YES ")
    assert not k.enabled


def test_routing_skips_what_is_not_finite(spark):
    rows = spark.createDataFrame([(0, "steps_observed", 2.0), (1, "steps_observed", -5.0), (2, "steps_observed", math.inf), (0, "g", 1.0), (3, "g", math.nan), (1, "drift_alert.e", 1.0)], "step long, key string, value double")
    got = {(r["name"], r["detector"]): r["value"] for r in X.routed(rows).collect()}
    assert got == {("steps_observed", None): 2.0, ("g", None): 1.0, ("drift_alert", "e"): 1.0}


def test_sinks_are_isolated(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)], "metric string, step long")
    sent = []
    hook = X.WebhookSink(sent.append, most=3)

    class Broken(X.Sink):
        def write(self, rows, batch):
            raise RuntimeError

    both = X.MultiSink(Broken(), hook, X.NullSink(), X.LoggingSink())
    both.write(rows, 0)
    hook.close()
    assert (hook.sent, hook.dropped, len(sent), both.failures) == (5, 0, 5, 1)


def test_webhook_never_waits(spark):
    import threading

    rows = spark.createDataFrame([("a", i) for i in range(9)], "metric string, step long")
    gate = threading.Event()

    def slow(alert):
        gate.wait(20)
        if alert["step"] == 0:
            raise RuntimeError

    hook = X.WebhookSink(slow, most=3)
    hook.write(rows, 0)
    assert hook.dropped >= 5  # one with the worker, three in the queue
    gate.set()
    hook.close()
    assert hook.sent + hook.dropped == 9 and hook.sent <= 4


def test_webhook_posts_json(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["X-Key"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    hook = X.WebhookSink(f"http://127.0.0.1:{server.server_port}/", headers={"X-Key": "k"})
    hook.write(spark.createDataFrame([("a", 1, {"pod": "p"})], "metric string, step long, labels map<string,string>"), 0)
    hook.close()
    server.shutdown()
    assert got == [("k", {"metric": "a", "step": 1, "labels": {"pod": "p"}})]


def test_numbers_are_shown_as_c_does(spark):
    xs = [0.0, 1.0, -1.5, 8.0, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234567, 1e22, 1.5e-300, 100.0, 0.1, 47.12345678, -0.00099999999, math.inf, -math.inf, math.nan, 12.5, 1e5, 1e6, 3.0e-4]
    for digits in (6, 12):
        got = [r["s"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").coalesce(1).orderBy("i").select(X.shortest(F.col("x"), digits).alias("s")).collect()]
        assert got == [f"{x:.{digits}g}" for x in xs]


def test_alerts_say_everything(spark):
    alerts = spark.createDataFrame([("js_divergence", "divergence", 7, 0.25, 12.3456789, 10.0, "cusum", "m", "", {"pod": "a"})], "metric string, detector string, step long, value double, statistic double, threshold double, method string, model_version string, baseline_version string, labels map<string,string>")
    import json

    assert json.loads(X.alert_json(alerts).first()["body"]) == {"metric": "js_divergence", "detector": "divergence", "step": 7, "value": 0.25, "statistic": 12.3456789, "threshold": 10.0, "method": "cusum", "model_version": "m", "baseline_version": "", "labels": {"pod": "a"}}
    assert X.alert_summary(alerts).first()["line"] == "drift alert: detector=divergence metric=js_divergence value=0.25 statistic=12.3457 threshold=10 method=cusum step=7 model=m baseline=?"
    bare = alerts.drop("labels", "baseline_version")
    assert json.loads(X.alert_json(bare).first()["body"])["labels"] == {}


def test_exporter_keeps_gauges_and_adds_counters(spark):
    sink = X.ExporterSink("ns", p99_alias=False)
    feed = lambda *rows: spark.createDataFrame(list(rows), "step long, key string, value double")
    sink.write(feed((0, "entropy_mean", 1.5), (0, "steps_observed", 2.0), (0, "drift_alert.entropy", 1.0), (0, "detector_failures.entropy", 1.0)), 0)
    sink.write(feed((1, "entropy_mean", 2.5), (1, "steps_observed", 3.0), (1, "drift_alert.entropy", 0.0), (1, "entropy_quantile", math.nan)), 1)
    text = sink.text(spark)
    assert "# HELP ns_entropy_mean Mean entropy of class probabilities\n# TYPE ns_entropy_mean gauge\nns_entropy_mean 2.5\n" in text
    assert "# TYPE ns_steps_observed_total counter\nns_steps_observed_total 5\n" in text
    assert 'ns_drift_alert{detector="entropy"} 0\n' in text and 'ns_detector_failures_total{detector="entropy"} 1\n' in text and "p99" not in text
    X.update(feed((0, "kl_divergence", 0.5)))
    assert X.default_exporter().values["kl_divergence", None, "gauge"] == 0.5


def test_moments_far_from_the_origin(spark):
    from driftloom.operators import baseline as B

    r = np.random.default_rng(3)
    z = r.normal(size=(600, 4))
    for shift in (0.0, 1e8):
        df = spark.createDataFrame([((x + shift).tolist(),) for x in z], "z array<double>").repartition(5)
        n, mean, cov = B.moments(df)
        assert n == 600 and np.allclose(mean, (z + shift).mean(0), rtol=1e-12) and np.allclose(cov, np.cov((z + shift).T), atol=1e-6)
    assert B.moments(df.where("false"))[0] == 0 and B.moments(df.limit(1))[2].shape == (4, 4)


def test_blocks_are_dropped_beyond_the_pool(spark):
    from driftloom import monitor as M

    steps = spark.range(20).select(F.col("id").alias("step"))
    got = M.drains(steps, 2, 2).orderBy("step").collect()
    assert sum(r["enqueued"] for r in got) == 2 and sum(2 for r in got if not r["enqueued"]) == 16
    released = M.drains(steps, 2, 2, spark.createDataFrame([(6,), (6,), (12,)], "step long")).orderBy("step").collect()
    assert [r["enqueued"] for r in released] == [True, True, False, True, True, False, True, False, False, False]
    assert M.backlog({"sources": [{"metrics": {"numFilesOutstanding": "3"}}]}, 4) == 0.75


def test_rules_fire_after_their_time(spark):
    rule = R.Rule("m", 90, bound=1.0)
    at = [0, 30, 60, 90, 120, 150, 180, 900, 930, 960, 990]
    value = [2, 2, 2, 1, 2, 2, 2, 2, 2, 2, 2]
    s = spark.createDataFrame([("m", 0, None, t, float(v)) for t, v in zip(at, value, strict=True)], "name string, instance long, detector string, ts long, value double")
    assert [(r["since"], r["fired"], r["last"]) for r in R.firing(R.holds(s, rule), rule.seconds).collect()] == [(900, 990, 990)]
    flat = [(t, 5.0 if t < 300 else 2.0) for t in range(0, 1200, 30)]
    c = spark.createDataFrame([("steps_observed_total", 0, None, t, v) for t, v in flat], s.schema)
    got = {r["ts"]: r["increase"] for r in R.rates(c).collect()}
    assert got[0] is None and got[30] == 0.0 and got[300] == got[540] == 2.0 and got[570] == 0.0  # the restart counts from 0


def test_triage_of_one_metric_and_of_a_deploy(spark):
    rows = [(0, 1, 0, 0, False), (1, 0, -1, 0, False), (2, 1, 1, 1, True), (3, 1, 1, 1, False), (4, 0, 0, 0, True)]
    up = spark.createDataFrame(rows, "step long, entropy int, js int, embedding int, sharp boolean")
    assert by_step(R.triage(up), "pattern") == ["suspect the monitor", "unclear", "deploy", "everything moved", "quiet"]
    assert by_step(R.triage(up.drop("sharp")), "pattern")[2] == "everything moved"


def injected(spark, scenario, steps=130, at=40, back=80, batch=48, classes=6, dims=8, seed=0):
    """Clean samples, drifted ones between two steps, clean ones again."""
    r = np.random.default_rng(seed)
    heads = r.normal(size=(classes, dims))
    rows = []
    for step in range(steps):
        bad = at <= step < back
        z = r.normal(size=(batch, dims)) + (2.5 if bad and scenario == "covariate" else 0.0)
        logits = z @ heads.T * (0.15 if bad and scenario == "confidence" else 1.0)
        if bad and scenario == "label":
            logits[:, 0] += 4.0
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
        rows += [(step, step * batch + i, z[i].tolist(), p[i].tolist(), float(h[i])) for i in range(batch)]
    return spark.createDataFrame(rows, "step long, vec_id long, z array<double>, probs array<double>, h double")


@pytest.mark.parametrize(("scenario", "detector"), [("covariate", "embedding"), ("confidence", "entropy"), ("label", "divergence")])
def test_injected_drift_is_found_and_recovers(spark, scenario, detector):
    from driftloom.monitor import build_monitor
    from driftloom.operators import baseline as B

    clean = injected(spark, "none", steps=40, seed=7)
    base = B.build(clean, 6, "m1", "2024-01-01T00:00:00+00:00", 16)
    limits = {m: {"threshold": t, "delta": d, "method": "page_hinkley"} for m, t, d in (("entropy_mean", 0.5, 0.05), ("js_divergence", 0.06, 0.005), ("embedding_mahalanobis_mean", 3.0, 0.25))}
    config = Config.from_dict({"window_size": 4, "drain_every_k": 8, "detectors": [{"name": n} for n in ("entropy", "divergence", "embedding")], "thresholds": limits})
    sent = []
    monitor = build_monitor(base, config, alert_sink=X.WebhookSink(lambda a: sent.append(a)), alert_hold=3)
    report = monitor.run(injected(spark, scenario))
    monitor.alert_sink.close()
    alerts = report.alerts.collect()
    own = [a for a in alerts if a["detector"] == detector]
    assert own and all(a["step"] >= 40 for a in alerts) and 40 <= min(a["step"] for a in own) <= 60
    assert len(sent) == len(alerts) and own[0]["model_version"] == "m1" and own[0]["baseline_version"] == base.checksum[:12]
    states = {(r["detector"], r["step"]): r["active"] for r in report.states.collect()}
    assert not any(v for (_, s), v in states.items() if s < 40) and any(v for (n, s), v in states.items() if n == detector)
    edges = sorted((r["step"], r["active"]) for r in report.edges.where(F.col("detector") == detector).collect())
    assert edges[0][1] and not edges[1][1]
    back = {r["metric"]: r["v"] for r in report.metrics.where("step >= 90 AND metric <> 'embedding_cov_drift'").groupBy("metric").agg(F.avg("value").alias("v")).collect()}
    before = {r["metric"]: r["v"] for r in report.metrics.where("step < 40").groupBy("metric").agg(F.avg("value").alias("v")).collect()}
    assert abs(back["entropy_mean"] - before["entropy_mean"]) < 0.05 and abs(back["embedding_mahalanobis_mean"] - before["embedding_mahalanobis_mean"]) < 0.1
    s = report.stats.first()
    assert (s["steps_observed"], s["drains_enqueued"], s["rows_dispatched"], s["observations_dropped"], s["ring_bytes"]) == (130, 16, 128, 0, 8 * 64 * 14 * 4)
    text = monitor.sink.text(spark)
    assert "driftloom_steps_observed_total 130" in text and f'driftloom_drift_alert{{detector="{detector}"}}' in text


def test_a_failing_detector_is_left_out(spark):
    from driftloom.monitor import build_monitor
    from driftloom.operators import baseline as B

    clean = injected(spark, "none", steps=6)
    base = B.build(clean, 6, "m1", "2024-01-01T00:00:00+00:00", 16)
    monitor = build_monitor(base, Config.from_dict({"window_size": 2, "drain_every_k": 2, "detectors": [{"name": "entropy"}, {"name": "divergence"}]}), max_batch=40)
    assert monitor.run(clean).stats.first()["observations_dropped"] == 6  # 48 samples a step
    monitor.max_batch = 64
    monitor.detectors["entropy"] = lambda df: 1 / 0
    report = monitor.run(clean)
    assert {r["metric"] for r in report.metrics.select("metric").distinct().collect()} == {"kl_divergence", "js_divergence"}
    assert 'driftloom_detector_failures_total{detector="entropy"} 1' in monitor.sink.text(spark)
    off = build_monitor(base, Config.from_dict({"window_size": 2, "drain_every_k": 2, "enabled": False, "detectors": [{"name": "entropy"}]}))
    assert off.run(clean) is None
    with pytest.raises(ValueError):
        build_monitor(base, Config(2, 2))


def test_reset_turns_off_what_was_on(spark):
    from driftloom import monitor as M

    states = spark.createDataFrame([("a", s, s >= 3) for s in range(10)] + [("b", s, s == 7) for s in range(10)], "detector string, step long, active boolean")
    got = sorted(map(tuple, M.reset_edges(states, spark.createDataFrame([(5,)], "step long")).collect()))
    assert got == [("a", 3, True), ("a", 5, False), ("a", 6, True), ("b", 7, True), ("b", 8, False)]


def test_rewritten_tables_give_a_new_baseline(spark, tmp_path):
    from driftloom.plans import metrics

    r = np.random.default_rng(1)
    for shift in (0.0, 1.0):
        rows = [(i, int(i % 11), (r.normal(size=4) + shift).astype(float).tolist()) for i in range(400)] + [(400, None, [0.0] * 4)]
        spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert abs(metrics._baseline(spark, str(tmp_path)).embed_mean.mean() - shift) < 0.3


def test_increase_survives_a_restart(spark):
    s = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate([10, 15, 15, 2, 4])], "key string, step long, value double")
    assert by_step(R.increase(s, 2), "increase") == [None, 5.0, 5.0, 2.0, 4.0]
    assert [tuple(r) for r in R.sustained(s, F.col("value") > 9, 2).collect()] == [("k", 0, 2, 3)]


def drift(seed, recover=True):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=300), r.normal(5, 1, 300), r.normal(0 if recover else 5, 1, 400), r.normal(5, 1, 300)])


@pytest.mark.parametrize("method", ["page_hinkley", "cusum"])
def test_alarms_again_after_recovery_but_not_while_it_lasts(method):
    test, control = C.Test(10.0, 1.0, method, cooldown=20), C.Test(10.0, 1.0, method, cooldown=20)
    fired = [i for i, x in enumerate(drift(0)) if test.update(x)[0]]
    stuck = [i for i, x in enumerate(drift(0, False)) if control.update(x)[0]]
    assert any(300 <= i <= 360 for i in fired)
    if method == "page_hinkley":
        assert any(1000 <= i <= 1060 for i in fired) and not any(i >= 1000 for i in stuck)


def test_streams_equal_batches(spark, tmp_path):
    from driftloom.config import ThresholdConfig
    from driftloom.streaming import monitor as S

    r = random.Random(1)
    rows = [(m, i, math.nan if r.random() < 0.1 else r.gauss(4 if i > 30 else 0, 1)) for m in ("a", "b", "c") for i in range(80)]
    schema = "metric string, step long, value double"
    for k in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 20 == k], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    limits = {m: ThresholdConfig(5.0, "cusum", 0.5, 1, 3) for m in ("a", "b")}
    out, sink = f"{tmp_path}/out", X.TableSink(f"{tmp_path}/out")
    q = S.start(S.changepoints(live, limits), sink, f"{tmp_path}/c1", availableNow=True)
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(out).select("metric", "step", "alarm").collect()))
    table = spark.createDataFrame([(m, "cusum", 5.0, 0.5, 1, 3) for m in ("a", "b")], "metric string, method string, threshold double, delta double, debounce int, cooldown int")
    want = sorted(map(tuple, C.trace(spark.createDataFrame(rows, schema), table).select("metric", "step", "alarm").collect()))
    assert got == want and any(a for *_, a in got)
    q = S.start(S.tumbling(live, 7), X.TableSink(f"{tmp_path}/out2"), f"{tmp_path}/c2", availableNow=True)
    q.awaitTermination(120)
    got = sorted((r["metric"], r["step"], round(r["value"], 9)) for r in spark.read.parquet(f"{tmp_path}/out2").collect())
    assert got == sorted((r["metric"], r["step"], round(r["value"], 9)) for r in W.tumbling_mean(spark.createDataFrame(rows, schema), 7).collect())


def test_watching_live_equals_batches_out_of_order(spark, tmp_path):
    from driftloom.config import ThresholdConfig
    from driftloom.streaming import monitor as S

    r = random.Random(5)
    rows = [(m, i, math.nan if r.random() < 0.05 else r.gauss(6 if 60 < i < 90 else 0, 1)) for m in ("a", "b", "c") for i in range(160)]
    late = sorted(rows, key=lambda x: x[1] + r.randint(0, 6))
    schema = "metric string, step long, value double"
    for k in range(8):
        spark.createDataFrame(late[k * 60 : k * 60 + 60], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    limits = {"a": ThresholdConfig(4.0, "page_hinkley", 0.5, 1, 2), "b": ThresholdConfig(4.0, "cusum", 0.5)}
    live = S.watch(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), limits, 4, 3, lag=7, targets={"b": 0.25})
    S.start(live, X.TableSink(f"{tmp_path}/out"), f"{tmp_path}/c", availableNow=True).awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out")
    end = {m: max(i for n, i, _ in rows if n == m) - 7 for m in "abc"}
    of = lambda kind: sorted((x["metric"], x["step"], x["value"] and round(x["value"], 9)) for x in got.where(F.col("kind") == kind).collect())
    table = spark.createDataFrame([x for x in rows if x[1] <= end[x[0]]], schema)
    same = lambda df, c: sorted((x["metric"], x["step"], round(x[c], 9)) for x in df.collect())
    assert of("rolling") == same(W.rolling_mean(table, 4), "rolling")
    windows = W.tumbling_mean(table, 4)
    assert of("window") == same(windows, "value")
    tests = spark.createDataFrame([("a", "page_hinkley", 4.0, 0.5, 1, 2, None), ("b", "cusum", 4.0, 0.5, 1, 0, 0.25)], "metric string, method string, threshold double, delta double, debounce int, cooldown int, target double")
    alarms = C.trace(windows.select("metric", "step", "value"), tests).where("alarm")
    assert of("alarm") == same(alarms, "value") and len(of("alarm")) > 1
    state = W.latch(table, alarms, 4, 3).select(F.col("metric").alias("detector"), "step", "active")
    want = sorted((x["detector"], x["step"], x["active"]) for x in W.edges(state).collect())
    assert sorted([(m, i, True) for m, i, _ in of("on")] + [(m, i, False) for m, i, _ in of("off")]) == want and want


def test_any_table_as_samples(spark):
    from driftloom.sources import adapters as A

    df = spark.createDataFrame([(1, [1.0, 2.0], [0.0, 1.0, 2.0]), (1, None, [0.0, 0.0, 0.0]), (2, [0.5, 0.5], None), (2, [0.0, 1.0], [3.0, 3.0, 3.0])], "batch int, emb array<float>, out array<float>")
    got = A.samples(df, "batch", "emb", logits="out").orderBy("step").collect()
    assert [r["step"] for r in got] == [1, 2] and np.allclose(got[1]["probs"], 1 / 3) and math.isclose(got[1]["h"], math.log(3), rel_tol=1e-9)
    assert np.allclose(A.samples(df.where("batch = 1"), "batch", "emb", probs="out").first()["probs"], [0, 1 / 3, 2 / 3])
    with pytest.raises(ValueError):
        A.samples(df, "batch", "emb")


def test_every_query_has_sql_or_a_reason():
    import __spark_entry__ as E

    without = set(E.queries()) - set(E.oracle_sql())
    assert without <= {"pipeline", "op1_packing", "op3_ngram_join", "op4_token_files", "op5_toxicity", "op7_line_dedup", "op8_secret_scan"}
