"""Queries over metric streams: windows, change-point tests, alerts, export, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import monitor as M
from ..functions import vectors as V
from ..operators import changepoint as C
from ..operators import rules as R
from ..operators import windows as W
from ..safety import firewall_state as state_of
from ..sinks import export as X
from ..sources import adapters as A
from .registry import ORACLE_SQL, query, rounded
from .sql import fold, stream

WIN, HOLD, BLOCK = 4, 3, 8
DIM = [("click", "engagement"), ("view", "engagement"), ("purchase", "commerce"), ("cart", "commerce")]
_DIM = "dim(metric, detector) AS (VALUES " + ", ".join(f"('{m}', '{d}')" for m, d in DIM) + ")"
#: One threshold a metric; 'gone_metric' names none that exists.
LIMITS = [("click", 8.0), ("view", 12.0), ("purchase", 10.0), ("gone_metric", 1.0)]
_LIMITS = "lim(metric, threshold) AS (VALUES " + ", ".join(f"('{m}', {t}::DOUBLE)" for m, t in LIMITS) + ")"
ST = stream()
_FIN = "fin AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY step) AS rn FROM st WHERE isfinite(value))"
_TUM = f"{_FIN}, tum AS (SELECT metric, (rn - 1) // {WIN} AS k, max(step) AS step, avg(value) AS value FROM fin GROUP BY metric, (rn - 1) // {WIN} HAVING count(*) = {WIN})"
_ROLL = f"roll AS (SELECT metric, step, avg(value) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN {WIN - 1} PRECEDING AND CURRENT ROW) AS rolling FROM fin)"


def r6(c, name: str):
    return rounded(c, 6).alias(name)


def _st(spark, d) -> DataFrame:
    return A.event_stream(spark, d)


def _dim(spark) -> DataFrame:
    return spark.createDataFrame(DIM, "metric string, detector string")


def _limits(spark, d, method="page_hinkley", delta=0.5, debounce=1, cooldown=0, target=None, threshold=8.0) -> DataFrame:
    """The same test for every metric."""
    return _metrics(spark, d).select("metric", F.lit(method).alias("method"), F.lit(float(threshold)).alias("threshold"), F.lit(float(delta)).alias("delta"), F.lit(debounce).alias("debounce"), F.lit(cooldown).alias("cooldown"), F.lit(target).cast("double").alias("target"))


@query("finite_filter", f"WITH {ST} SELECT metric, step, round(value, 6) AS value FROM st WHERE isfinite(value)")
def finite_filter(spark, d):
    return W.finite_only(_st(spark, d)).select("metric", "step", r6(F.col("value"), "value"))


@query("values_skipped", f"WITH {ST} SELECT metric, count(*) FILTER (WHERE NOT isfinite(value)) AS skipped FROM st GROUP BY metric")
def values_skipped(spark, d):
    return W.skipped(_st(spark, d))


@query("rolling_mean", f"WITH {ST}, {_FIN}, {_ROLL} SELECT metric, step, round(rolling, 6) AS rolling FROM roll")
def rolling_mean(spark, d):
    return W.rolling_mean(_st(spark, d), WIN).select("metric", "step", r6(F.col("rolling"), "rolling"))


@query("tumbling_mean", f"WITH {ST}, {_TUM} SELECT metric, k, step, round(value, 6) AS value FROM tum")
def tumbling_mean(spark, d):
    return W.tumbling_mean(_st(spark, d), WIN).select("metric", "k", "step", r6(F.col("value"), "value"))


@query("metric_snapshot", f"WITH {ST}, {_FIN}, {_ROLL} SELECT metric, round(max_by(rolling, step), 6) AS rolling FROM roll GROUP BY metric")
def metric_snapshot(spark, d):
    return W.snapshot(W.rolling_mean(_st(spark, d), WIN)).select("metric", r6(F.col("rolling"), "rolling"))


_CLOSED = f"""WITH {ST}, {_FIN}, a AS (SELECT *, avg(value) OVER w AS mean FROM fin WINDOW w AS (PARTITION BY metric ORDER BY step)),
m AS (SELECT metric, step, sum(value - mean - 0.5) OVER (PARTITION BY metric ORDER BY step) AS m FROM a)
SELECT metric, step, round(m - least(0, min(m) OVER (PARTITION BY metric ORDER BY step)), 4) AS statistic FROM m"""


@query("page_hinkley_statistic", _CLOSED)
def page_hinkley_statistic(spark, d):
    return C.statistic_before_alarm(_st(spark, d), 0.5).select("metric", "step", rounded("statistic", 4).alias("statistic"))


def _alarms(spark, d, **how) -> DataFrame:
    return C.trace(_st(spark, d), _limits(spark, d, **how))


def _test(name: str, columns: str, where: str = "alarm", **how):
    sql = f"WITH RECURSIVE {ST}, {fold(how.get('method', 'page_hinkley'), str(how.get('threshold', 8.0)), str(how.get('delta', 0.5)), how.get('debounce', 1), how.get('cooldown', 0), None if how.get('target') is None else str(how['target']))} SELECT metric, step, {columns} FROM f WHERE k > 0 AND {where}"

    @query(name, sql)
    def run(spark, d):
        out = _alarms(spark, d, **how).where(where.replace("statistic IS NOT NULL", "true"))
        return out.select("metric", "step", rounded("statistic", 4).alias("statistic")) if "statistic" in columns else out.select("metric", "step")

    return run


_test("page_hinkley_alarms", "round(statistic, 4) AS statistic")
_test("cusum_statistic", "round(statistic, 4) AS statistic", "statistic IS NOT NULL", method="cusum")
_test("cusum_alarms", "round(statistic, 4) AS statistic", method="cusum", debounce=2, cooldown=3)
_test("cusum_fixed_target", "round(statistic, 4) AS statistic", method="cusum", target=50.0, threshold=20.0)

_GATE = """
r AS (SELECT metric, step, isfinite(value) AND value > 50 AS raw, row_number() OVER (PARTITION BY metric ORDER BY step) AS k FROM st),
g AS (
  SELECT metric, 0::BIGINT AS k, -1::BIGINT AS step, 0 AS run, 0 AS cool, false AS alarm FROM (SELECT DISTINCT metric FROM r)
  UNION ALL
  SELECT metric, k, step, CASE WHEN fired THEN 0 ELSE run1 END, CASE WHEN fired THEN 3 WHEN cool > 0 THEN cool - 1 ELSE 0 END, fired FROM (
    SELECT *, cool = 0 AND run1 >= 2 AS fired FROM (
      SELECT g.metric, r.k, r.step, g.cool, CASE WHEN g.cool > 0 THEN 0 WHEN r.raw THEN g.run + 1 ELSE 0 END AS run1 FROM g JOIN r ON g.metric = r.metric AND r.k = g.k + 1)))"""


@query("alert_gate", f"WITH RECURSIVE {ST}, {_GATE} SELECT metric, step FROM g WHERE alarm")
def alert_gate(spark, d):
    flags = _st(spark, d).select("metric", "step", (V.finite(F.col("value")) & (F.col("value") > 50)).alias("raw"))
    return C.gate_trace(flags, 2, 3).where("alarm").select("metric", "step")


_LATCH = f"""
steps AS (SELECT DISTINCT step FROM st),
al AS (SELECT metric, step FROM f WHERE alarm),
lat AS (
  SELECT metric, step, coalesce((step + 1) // {WIN} - (last_fire + 1) // {WIN} < {HOLD}, false) AS active FROM (
    SELECT m.metric, s.step, max(al.step) AS last_fire FROM steps s CROSS JOIN (SELECT DISTINCT metric FROM al) m
    LEFT JOIN al ON al.metric = m.metric AND al.step <= s.step GROUP BY m.metric, s.step)),
det AS (SELECT coalesce(detector, lat.metric) AS detector, step, bool_or(active) AS active FROM lat LEFT JOIN dim ON lat.metric = dim.metric GROUP BY ALL)"""
_FOLDED = f"WITH RECURSIVE {ST}, {fold('page_hinkley', '8.0', '0.5')}, {_DIM}, {_LATCH}"


def _latched(spark, d) -> DataFrame:
    st = _st(spark, d)
    return W.latch(st, C.trace(st, _limits(spark, d)).where("alarm"), WIN, HOLD)


@query("alert_latch", _FOLDED + " SELECT metric, step, active FROM lat")
def alert_latch(spark, d):
    return _latched(spark, d)


@query("detector_alert_state", _FOLDED + " SELECT detector, step, active FROM det")
def detector_alert_state(spark, d):
    return W.detector_state(_latched(spark, d), _dim(spark))


@query("alert_edges", _FOLDED + " SELECT detector, step, active FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY detector ORDER BY step) AS b FROM det) WHERE active <> b")
def alert_edges(spark, d):
    return W.edges(W.detector_state(_latched(spark, d), _dim(spark)))


@query("aggregator_counters", f"WITH RECURSIVE {ST}, {fold('page_hinkley', '8.0', '0.5')}, {_TUM} SELECT (SELECT count(DISTINCT step) FROM st) AS steps_seen, (SELECT count(*) FROM tum) AS windows_closed, (SELECT count(*) FROM f WHERE alarm) AS alerts_fired, (SELECT count(*) FROM st WHERE NOT isfinite(value)) AS values_skipped")
def aggregator_counters(spark, d):
    st = _st(spark, d)
    one = lambda df, name, c=None: df.agg((c if c is not None else F.count("*")).alias(name))
    parts = [one(st, "steps_seen", F.countDistinct("step")), one(W.tumbling_mean(st, WIN), "windows_closed"), one(C.trace(st, _limits(spark, d)).where("alarm"), "alerts_fired"), one(W.skipped(st), "values_skipped", F.sum("skipped"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


EPOCH = 40
_RESET = f"""WITH RECURSIVE {ST}, st2 AS (SELECT metric || '#' || (step // {EPOCH}) AS metric, step, value FROM st), {fold('page_hinkley', '8.0', '0.5', source='st2')}, {_DIM},
al AS (SELECT split_part(metric, '#', 1) AS metric, step // {EPOCH} AS ep, step FROM f WHERE alarm),
lat AS (
  SELECT m.metric, m.ep, s.step, coalesce((s.step + 1) // {WIN} - (max(al.step) + 1) // {WIN} < {HOLD}, false) AS active
  FROM (SELECT DISTINCT metric, ep FROM al) m JOIN (SELECT DISTINCT step FROM st) s ON s.step // {EPOCH} = m.ep
  LEFT JOIN al ON al.metric = m.metric AND al.ep = m.ep AND al.step <= s.step GROUP BY m.metric, m.ep, s.step),
det AS (SELECT coalesce(detector, lat.metric) AS detector, ep, step, bool_or(active) AS active FROM lat LEFT JOIN dim ON lat.metric = dim.metric GROUP BY ALL)
SELECT detector, step, active FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY detector, ep ORDER BY step) AS b FROM det) WHERE active <> b
UNION ALL SELECT detector, {EPOCH} * (ep + 1) - 1, false FROM (SELECT detector, ep, max_by(active, step) AS a FROM det GROUP BY ALL) WHERE a AND {EPOCH} * (ep + 1) - 1 <= (SELECT max(step) FROM st)"""


@query("aggregator_reset", _RESET)
def aggregator_reset(spark, d):
    """Edges of the detectors' states when everything is reset every 40 steps: tests and latches start anew, and what was on goes off."""
    st = _st(spark, d)
    epoch = F.floor(F.col("step") / EPOCH)
    own = st.withColumn("metric", F.concat_ws("#", "metric", epoch.cast("string")))
    limits = own.select("metric").distinct().select("metric", F.lit("page_hinkley").alias("method"), F.lit(8.0).alias("threshold"), F.lit(0.5).alias("delta"), F.lit(1).alias("debounce"), F.lit(0).alias("cooldown"))
    latched = W.latch(st, C.trace(own, limits).where("alarm"), WIN, HOLD).where(F.substring_index("metric", "#", -1) == epoch.cast("string"))
    states = W.detector_state(latched.withColumn("metric", F.substring_index("metric", "#", 1)), _dim(spark))
    end = F.floor((F.max("step") + 1) / EPOCH).cast("int")
    resets = st.agg(end.alias("n")).select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n")))).alias("i")).select((F.col("i") * EPOCH - 1).cast("long").alias("step"))
    return M.reset_edges(states, resets)


@query("counter_delta", "WITH t AS (SELECT event_type AS name, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS step, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT name, step, sum(n) OVER (PARTITION BY name ORDER BY step) AS total FROM t) SELECT name, step, CAST(greatest(total - lag(total, 1, 0) OVER (PARTITION BY name ORDER BY step), 0) AS BIGINT) AS delta FROM r")
def counter_delta(spark, d):
    from pyspark.sql import Window

    t = _counts(spark, d).withColumnRenamed("key", "name")
    total = F.sum("value").over(Window.partitionBy("name").orderBy("step"))
    return W.counter_delta(t.select("name", "step", total.alias("total")))


def _counts(spark, d) -> DataFrame:
    ev = A.table(spark, d, "events")
    at = F.floor(F.unix_seconds(ev["ts"].cast("timestamp")) / 21600)
    return ev.groupBy(F.col("event_type").alias("key"), at.alias("step")).agg(F.count("*").alias("value"))


@query("enqueue_ema", f"""WITH RECURSIVE {ST}, {_FIN}, e AS (
  SELECT metric, 0::BIGINT AS rn, -1::BIGINT AS step, 0::DOUBLE AS ema FROM (SELECT DISTINCT metric FROM fin)
  UNION ALL SELECT e.metric, fin.rn, fin.step, e.ema + 0.01 * (fin.value - e.ema) FROM e JOIN fin ON e.metric = fin.metric AND fin.rn = e.rn + 1)
SELECT metric, step, round(ema, 6) AS ema FROM e WHERE rn > 0""")
def enqueue_ema(spark, d):
    return W.ema(_st(spark, d), 0.01).select("metric", "step", r6(F.col("ema"), "ema"))


@query("metrics_unpivot", "SELECT o_orderkey AS step, metric, round(value, 4) AS value FROM (SELECT o_orderkey, o_totalprice AS price, CAST(length(o_orderpriority) AS DOUBLE) AS width FROM orders) UNPIVOT (value FOR metric IN (price, width))")
def metrics_unpivot(spark, d):
    from ..operators.detectors import long_form

    wide = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").cast("double").alias("price"), F.length("o_orderpriority").cast("double").alias("width"))
    return long_form(wide).select("step", "metric", rounded("value", 4).alias("value"))


@query("truthy_parse", "SELECT o_orderkey, coalesce(lower(trim(s)) IN ('1', 'true', 'yes', 'on'), false) AS truthy FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'on' WHEN 2 THEN '0' WHEN 3 THEN NULL WHEN 4 THEN 'Yes' ELSE '1' END AS s FROM orders)")
def truthy_parse(spark, d):
    k = F.pmod("o_orderkey", F.lit(6))
    s = F.when(k == 0, " TRUE ").when(k == 1, "on").when(k == 2, "0").when(k == 4, "Yes").when(k == 5, "1")
    return A.table(spark, d, "orders").select("o_orderkey", V.truthy(s).alias("truthy"))


@query("nearest_rank_percentile", "SELECT l_returnflag, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def nearest_rank_percentile(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").alias("p95"))


_ARMS = "a AS (SELECT l_linestatus AS arm, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99, avg(l_quantity) AS mean, count(*) / sum(l_quantity) AS qps FROM lineitem GROUP BY l_linestatus)"


def _arms(spark, d) -> DataFrame:
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY l_quantity)")
    li = A.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_linestatus").alias("arm")).agg(rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.avg("l_quantity").alias("mean"), (F.count("*") / F.sum("l_quantity")).alias("qps"))


@query("latency_arm_stats", f"WITH {_ARMS} SELECT arm, p50, p95, p99, round(mean, 6) AS mean, round(qps, 6) AS qps FROM a")
def latency_arm_stats(spark, d):
    return _arms(spark, d).select("arm", "p50", "p95", "p99", r6(F.col("mean"), "mean"), r6(F.col("qps"), "qps"))


@query("ab_overhead_pct", f"WITH {_ARMS} SELECT round((max(mean) FILTER (WHERE arm = 'O') - max(mean) FILTER (WHERE arm = 'F')) / max(mean) FILTER (WHERE arm = 'F') * 100, 4) AS mean_pct, round((max(qps) FILTER (WHERE arm = 'O') - max(qps) FILTER (WHERE arm = 'F')) / max(qps) FILTER (WHERE arm = 'F') * 100, 4) AS qps_pct FROM a")
def ab_overhead_pct(spark, d):
    arm = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c)))
    return _arms(spark, d).agg(*[rounded(V.percent_change(arm(c, "F"), arm(c, "O")), 4).alias(f"{c}_pct") for c in ("mean", "qps")])


@query("saturation_worst", "SELECT l_linenumber AS batch, round(v, 6) AS overhead FROM (SELECT l_linenumber, avg(l_discount) AS v FROM lineitem GROUP BY 1) ORDER BY v DESC, l_linenumber LIMIT 1")
def saturation_worst(spark, d):
    per = A.table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.avg("l_discount").alias("v"))
    return per.agg(F.max(F.struct("v", (-F.col("l_linenumber")).alias("b"))).alias("x")).select((-F.col("x.b")).alias("batch"), r6(F.col("x.v"), "overhead"))


@query("firewall_state", "SELECT event_type AS component, count(*) AS failures, count(*) >= 300 AS disabled, max_by(user_id::VARCHAR, event_id) AS last_error FROM events WHERE event_id % 7 = 0 GROUP BY event_type")
def firewall_state(spark, d):
    ev = A.table(spark, d, "events").where(F.col("event_id") % 7 == 0)
    return state_of(ev.select(F.col("event_type").alias("component"), F.col("event_id").alias("step"), F.col("user_id").cast("string").alias("error")), 300)


def _metrics(spark, d) -> DataFrame:
    return _st(spark, d).select("metric").distinct()


@query("metric_detector_join", f"WITH {ST}, {_DIM} SELECT m.metric, coalesce(detector, m.metric) AS detector FROM (SELECT DISTINCT metric FROM st) m LEFT JOIN dim ON m.metric = dim.metric")
def metric_detector_join(spark, d):
    return _metrics(spark, d).join(F.broadcast(_dim(spark)), "metric", "left").select("metric", F.coalesce("detector", "metric").alias("detector"))


def _lim(spark) -> DataFrame:
    return spark.createDataFrame(LIMITS, "metric string, threshold double")


@query("thresholds_applied", f"WITH {ST}, {_LIMITS} SELECT metric, threshold FROM lim WHERE metric IN (SELECT metric FROM st)")
def thresholds_applied(spark, d):
    return _lim(spark).join(_metrics(spark, d), "metric", "left_semi")


@query("thresholds_unmatched", f"WITH {ST}, {_LIMITS} SELECT metric FROM lim WHERE metric NOT IN (SELECT metric FROM st) ORDER BY metric")
def thresholds_unmatched(spark, d):
    return _lim(spark).join(_metrics(spark, d), "metric", "left_anti").select("metric").orderBy("metric")


@query("thresholds_except", f"WITH {ST}, {_LIMITS} SELECT metric FROM lim EXCEPT SELECT metric FROM st")
def thresholds_except(spark, d):
    return _lim(spark).select("metric").subtract(_metrics(spark, d))


@query("metrics_without_threshold", f"WITH {ST}, {_LIMITS} SELECT DISTINCT st.metric, lim.metric IS NULL AS exported_only FROM st LEFT JOIN lim ON st.metric = lim.metric")
def metrics_without_threshold(spark, d):
    lim = _lim(spark).select("metric", F.lit(True).alias("known"))
    return _metrics(spark, d).join(F.broadcast(lim), "metric", "left").select("metric", F.col("known").isNull().alias("exported_only"))


@query("metric_layout", "SELECT * FROM (VALUES (0, 'entropy_mean', 'entropy'), (1, 'entropy_quantile', 'entropy'), (2, 'entropy_pop_shift', 'entropy'), (3, 'kl_divergence', 'divergence'), (4, 'js_divergence', 'divergence')) t(ordinal, metric, detector)")
def metric_layout(spark, d):
    from ..config import Config
    from ..operators.detectors import layout

    made = layout(Config.from_dict({"window_size": 512, "drain_every_k": 16, "detectors": [{"name": "entropy"}, {"name": "divergence"}, {"name": "embedding", "enabled": False}]}))
    return spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(made)], "ordinal int, metric string, detector string")


_STEPS = f"WITH {ST}, s AS (SELECT DISTINCT step FROM st)"


@query("drain_blocks", _STEPS + f" SELECT step // {BLOCK} AS block, count(*) AS n, count(*) = {BLOCK} AS whole FROM s GROUP BY 1")
def drain_blocks(spark, d):
    return _st(spark, d).select("step").distinct().groupBy(F.floor(F.col("step") / BLOCK).alias("block")).agg(F.count("*").alias("n"), (F.count("*") == BLOCK).alias("whole"))


@query("drain_delivered", _STEPS + f" SELECT step FROM s WHERE step < ((SELECT max(step) FROM s) + 1) // {BLOCK} * {BLOCK}")
def drain_delivered(spark, d):
    s = _st(spark, d).select("step").distinct()
    end = s.agg((F.floor((F.max("step") + 1) / BLOCK) * BLOCK).alias("end"))
    return s.join(F.broadcast(end), F.col("step") < F.col("end")).select("step")  # one row joins


@query("drain_prefix", _STEPS + f" SELECT step FROM (SELECT step, min(CAST(step % 50 <> 37 AS INT)) OVER (ORDER BY step) AS done FROM s) WHERE done = 1")
def drain_prefix(spark, d):
    # everything before the first step that is not done: one aggregate, no running window
    s = _st(spark, d).select("step").distinct()
    first = s.where(F.col("step") % 50 == 37).agg(F.min("step").alias("open"))
    return s.join(F.broadcast(first), F.col("open").isNull() | (F.col("step") < F.col("open"))).select("step")  # one row joins


CAPACITY, RELEASE = 2, 24
_DRAINS = f"""evt AS (SELECT *, row_number() OVER (ORDER BY step, add) AS i FROM (SELECT step, 1 AS add FROM s WHERE (step + 1) % {BLOCK} = 0 UNION ALL SELECT step, -1 FROM s WHERE step % {RELEASE} = 7)),
sim AS (
  SELECT 0::BIGINT AS i, -1::BIGINT AS step, 0 AS add, 0 AS before, 0 AS pending
  UNION ALL SELECT evt.i, evt.step, evt.add, sim.pending, CASE WHEN evt.add < 0 THEN greatest(sim.pending - 1, 0) ELSE least(sim.pending + 1, {CAPACITY}) END FROM sim JOIN evt ON evt.i = sim.i + 1),
dr AS (SELECT step, CAST(before AS INTEGER) AS pending, before < {CAPACITY} AS enqueued FROM sim WHERE add > 0)"""


def _drains(spark, d) -> DataFrame:
    """Blocks against a pool of two buffers, one of which is released every 24 steps."""
    steps = _st(spark, d).select("step").distinct()
    return M.drains(steps, BLOCK, CAPACITY, steps.where(F.col("step") % RELEASE == 7))


@query("summaries_dropped", f"WITH RECURSIVE {ST}, s AS (SELECT DISTINCT step FROM st), {_DRAINS} SELECT step, pending, enqueued, CAST(sum(CASE WHEN enqueued THEN 0 ELSE {BLOCK} END) OVER (ORDER BY step) AS BIGINT) AS dropped FROM dr")
def summaries_dropped(spark, d):
    """A block that finds no free buffer is dropped whole; ``dropped`` counts its steps, one row a block."""
    from pyspark.sql import Window

    lost = F.sum(F.when(F.col("enqueued"), 0).otherwise(BLOCK)).over(Window.orderBy("step"))
    return _drains(spark, d).withColumn("dropped", lost.cast("long"))


@query("ring_backlog", f"WITH RECURSIVE {ST}, s AS (SELECT DISTINCT step FROM st), {_DRAINS}, c AS (SELECT step, 8.0 * sum(CASE WHEN step % {RELEASE} = 7 THEN 1 ELSE 0 END) OVER (ORDER BY step) AS finished FROM s) SELECT step, round(least(greatest(step + 1 - finished, 0), 8) / 8, 6) AS utilization FROM c")
def ring_backlog(spark, d):
    """Share of eight slots in flight: steps observed against those that were released."""
    from pyspark.sql import Window

    finished = F.sum(F.when(F.col("step") % RELEASE == 7, 1).otherwise(0)).over(Window.orderBy("step")) * 8
    behind = F.least(F.greatest(F.col("step") + 1 - finished, F.lit(0)), F.lit(8))
    return _st(spark, d).select("step").distinct().select("step", r6(behind / 8, "utilization"))


@query("ring_slot", _STEPS + " SELECT step % 8 AS slot, max(step) AS latest FROM s GROUP BY 1")
def ring_slot(spark, d):
    return _st(spark, d).groupBy(F.pmod("step", F.lit(8)).alias("slot")).agg(F.max("step").alias("latest"))


@query("late_rows", "WITH e AS (SELECT event_id, epoch(ts) - CASE WHEN event_id % 41 = 0 THEN 86400 ELSE 0 END AS t FROM events), h AS (SELECT event_id, t, max(t) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM e) SELECT count(*) AS late FROM h WHERE t < high - 3600")
def late_rows(spark, d):
    """Rows behind the highest time seen before them by more than the allowed hour."""
    from pyspark.sql import Window

    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.when(F.col("event_id") % 41 == 0, 86400).otherwise(0)
    e = A.table(spark, d, "events").select("event_id", t.alias("t"), F.floor(F.col("event_id") / 65_536).alias("part"))
    # the running maximum in two levels, so that no task orders the whole stream
    inner = Window.partitionBy("part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    tops = e.groupBy("part").agg(F.max("t").alias("top"))
    carried = tops.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    high = e.withColumn("own", F.max("t").over(inner)).join(carried, "part").withColumn("high", F.greatest("own", "carry"))
    return high.where(F.col("t") < F.col("high") - 3600).agg(F.count("*").alias("late"))


_FEED = f"WITH {ST}, feed AS (SELECT step, CASE metric WHEN 'click' THEN 'entropy_quantile' WHEN 'view' THEN 'drift_alert.entropy' WHEN 'purchase' THEN 'steps_observed' WHEN 'error' THEN 'detector_failures.embedding' ELSE metric END AS key, value FROM st)"
_ROUTED = ", ok AS (SELECT *, CASE WHEN starts_with(key, 'drift_alert.') THEN 'alert' WHEN key IN ('steps_observed', 'observations_dropped', 'summaries_dropped') OR starts_with(key, 'detector_failures.') THEN 'counter' ELSE 'gauge' END AS kind FROM feed WHERE isfinite(value)), routed AS (SELECT split_part(key, '.', 1) AS name, nullif(split_part(key, '.', 2), '') AS detector, kind, CASE kind WHEN 'counter' THEN sum(greatest(value, 0)) ELSE max_by(value, step) END AS value FROM ok GROUP BY key, kind)"


def _feed(spark, d) -> DataFrame:
    m = F.col("metric")
    key = F.when(m == "click", "entropy_quantile").when(m == "view", "drift_alert.entropy").when(m == "purchase", "steps_observed").when(m == "error", "detector_failures.embedding").otherwise(m)
    return _st(spark, d).select("step", key.alias("key"), "value")


@query("export_routing", _FEED + _ROUTED + " SELECT name, detector, kind, round(value, 4) AS value FROM routed")
def export_routing(spark, d):
    return X.routed(_feed(spark, d)).select("name", "detector", "kind", rounded("value", 4).alias("value"))


@query("export_telemetry", _FEED + _ROUTED + " SELECT name, detector, kind, round(value, 4) AS value FROM routed WHERE name IN ('entropy_quantile', 'steps_observed', 'detector_failures')")
def export_telemetry(spark, d):
    return X.routed(_feed(spark, d), known_only=True).select("name", "detector", "kind", rounded("value", 4).alias("value"))


@query("export_p99_alias", _FEED + _ROUTED + " SELECT CASE k WHEN 1 THEN 'entropy_p99' ELSE name END AS name, round(value, 4) AS value FROM routed, (VALUES (0), (1)) t(k) WHERE k = 0 OR name = 'entropy_quantile'")
def export_p99_alias(spark, d):
    return X.routed(_feed(spark, d), p99_alias=True).select("name", rounded("value", 4).alias("value"))


_HELP = "help(name, says) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in X.HELP.items()) + ")"


@query("export_text", _FEED + _ROUTED + f""", {_HELP}, l AS (SELECT r.name, detector, kind, value, 'driftloom_' || r.name || CASE kind WHEN 'counter' THEN '_total' ELSE '' END AS full_name, coalesce(says, 'Metric ' || r.name) AS says FROM routed r LEFT JOIN help ON r.name = help.name)
SELECT DISTINCT name, -2 AS at, '# HELP ' || full_name || ' ' || says AS line FROM l
UNION ALL SELECT DISTINCT name, -1, '# TYPE ' || full_name || ' ' || CASE kind WHEN 'alert' THEN 'gauge' ELSE kind END FROM l
UNION ALL SELECT name, 0, full_name || CASE WHEN detector IS NOT NULL THEN '{{detector="' || detector || '"}}' ELSE '' END || ' ' || format('{{:.12g}}', value) FROM l""")
def export_text(spark, d):
    return X.text_lines(X.routed(_feed(spark, d)), "driftloom")


@query("export_otel_names", _FEED + _ROUTED + " SELECT 'driftloom.' || name AS name, detector, 'gauge' AS kind FROM routed")
def export_otel_names(spark, d):
    return X.dotted(X.routed(_feed(spark, d)), "driftloom")


_CAT = "cat(name, kind) AS (VALUES " + ", ".join([f"('{n}', 'gauge')" for n in X.GAUGES + X.TELEMETRY] + [f"('{n}', 'counter')" for n in X.COUNTERS]) + ")"


@query("export_catalog", _FEED + _ROUTED + f", {_CAT} SELECT coalesce(cat.name, r.name) AS name, coalesce(cat.kind, r.kind) AS kind, 'driftloom_' || coalesce(cat.name, r.name) AS full_name, round(r.value, 4) AS value FROM cat FULL JOIN (SELECT * FROM routed WHERE detector IS NULL) r ON cat.name = r.name")
def export_catalog(spark, d):
    return X.exported(_feed(spark, d), "driftloom").select("name", "kind", "full_name", rounded("value", 4).alias("value"))


_ALERTS = f"WITH RECURSIVE {ST}, {fold('page_hinkley', '8.0', '0.5')}, {_DIM}, al AS (SELECT f.metric, coalesce(detector, f.metric) AS detector, step, value, statistic FROM f LEFT JOIN dim ON f.metric = dim.metric WHERE alarm)"


def _alerts(spark, d) -> DataFrame:
    """Alerts as they are, but for the roundings' offset: a number that both sides round must not lie on a tie."""
    a = _alarms(spark, d).where("alarm").join(F.broadcast(_dim(spark)), "metric", "left")
    says = {"detector": F.coalesce("detector", "metric"), "threshold": F.lit(8.0), "method": F.lit("page_hinkley"), "model_version": F.lit("m1"), "baseline_version": F.lit(""), "labels": F.create_map(F.lit("site"), F.col("metric"))}
    return a.select(*[says.get(c, F.col(c)).alias(c) for c in X.ALERT])


@query("alert_json", _ALERTS + """ SELECT metric, step, '{"metric":"' || metric || '","detector":"' || detector || '","step":' || step || ',"value":' || round(value, 6) || ',"statistic":' || round(statistic, 6) || ',"threshold":8.0,"method":"page_hinkley","model_version":"m1","baseline_version":"","labels":{"site":"' || metric || '"}}' AS body FROM al""")
def alert_json(spark, d):
    return X.alert_json(_alerts(spark, d).withColumns({c: rounded(c, 6) for c in ("value", "statistic")}))


@query("alert_summary", _ALERTS + " SELECT metric, step, 'drift alert: detector=' || detector || ' metric=' || metric || ' value=' || format('{:.6g}', value + 3.7e-10) || ' statistic=' || format('{:.6g}', statistic + 3.7e-10) || ' threshold=8 method=page_hinkley step=' || step || ' model=m1 baseline=?' AS line FROM al")
def alert_summary(spark, d):
    return X.alert_summary(_alerts(spark, d).withColumns({c: F.col(c) + 3.7e-10 for c in ("value", "statistic")}))


_CALIB = f"""WITH RECURSIVE {ST}, {_TUM}, n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY step) AS i, count(*) OVER (PARTITION BY metric) AS n FROM tum),
fit AS (SELECT * FROM n WHERE i <= floor(n * 0.6)), held AS (SELECT * FROM n WHERE i > floor(n * 0.6)),
sl AS (SELECT metric, max(value) - median(value) AS delta FROM fit GROUP BY metric),
{fold('page_hinkley', '1e12', '(SELECT delta FROM sl WHERE sl.metric = f0.metric)', source='fit').replace('x AS (', 'xa AS (').replace('f AS (', 'fa AS (').replace('FROM x)', 'FROM xa)').replace('SELECT f.metric, x.k AS k1, x.step AS step1, x.value AS x1, n + 1 AS n1, m + (x.value - m) / (n + 1) AS m1, c, mn, run, cool', 'SELECT fa.metric, xa.k AS k1, xa.step AS step1, xa.value AS x1, n + 1 AS n1, m + (xa.value - m) / (n + 1) AS m1, c, mn, run, cool, sl.delta AS dl').replace('FROM f JOIN x ON f.metric = x.metric AND x.k = f.k + 1', 'FROM fa JOIN xa ON fa.metric = xa.metric AND xa.k = fa.k + 1 JOIN sl ON sl.metric = fa.metric').replace('((SELECT delta FROM sl WHERE sl.metric = f0.metric))', 'dl')},
pk AS (SELECT fa.metric, any_value(delta) AS delta, greatest(3 * max(statistic), 5 * any_value(delta)) AS threshold FROM fa JOIN sl ON fa.metric = sl.metric WHERE k > 0 GROUP BY fa.metric),
{fold('page_hinkley', 'th', 'dl', source='held').replace('x AS (', 'xb AS (').replace('f AS (', 'fb AS (').replace('FROM x)', 'FROM xb)').replace('SELECT f.metric, x.k AS k1, x.step AS step1, x.value AS x1, n + 1 AS n1, m + (x.value - m) / (n + 1) AS m1, c, mn, run, cool', 'SELECT fb.metric, xb.k AS k1, xb.step AS step1, xb.value AS x1, n + 1 AS n1, m + (xb.value - m) / (n + 1) AS m1, c, mn, run, cool, pk.delta AS dl, pk.threshold AS th').replace('FROM f JOIN x ON f.metric = x.metric AND x.k = f.k + 1', 'FROM fb JOIN xb ON fb.metric = xb.metric AND xb.k = fb.k + 1 JOIN pk ON pk.metric = fb.metric')}
SELECT pk.metric, round(delta, 4) AS delta, round(threshold, 4) AS threshold, (SELECT count(*) FROM fb WHERE fb.metric = pk.metric AND alarm) AS alarms FROM pk"""


@query("calibrate_thresholds", _CALIB)
def calibrate_thresholds(spark, d):
    windows = W.tumbling_mean(_st(spark, d), WIN).select("metric", "step", "value")
    return R.calibrate(windows, "page_hinkley").select("metric", rounded("delta", 4).alias("delta"), rounded("threshold", 4).alias("threshold"), "alarms")


@query("calibrate_from_clean", f"WITH {ST} SELECT metric, round(0.25 * avg(value), 4) AS delta, round(2 * avg(value), 4) AS threshold FROM st WHERE isfinite(value) AND step < 60 GROUP BY metric")
def calibrate_from_clean(spark, d):
    clean = W.finite_only(_st(spark, d)).where("step < 60").groupBy("metric").agg(F.avg("value").alias("level"))
    return clean.select("metric", rounded(F.col("level") * 0.25, 4).alias("delta"), rounded(F.col("level") * 2, 4).alias("threshold"))


# alert rules over scraped series
_SCRAPED = """e AS (SELECT event_id % 2 AS instance, event_id // 2 AS k, event_id // 128 AS b, value AS v FROM events),
ab AS (SELECT instance, b, avg(v) AS a FROM e GROUP BY ALL),
aj AS (SELECT instance, b, k % 3 AS j, avg(v) AS a FROM e GROUP BY ALL),
own AS (SELECT e.*, a, NULL::VARCHAR AS detector, k * 30 AS ts FROM e JOIN ab USING (instance, b)),
per AS (SELECT e.*, a, j, 'd' || j AS detector, k * 30 AS ts FROM e JOIN aj USING (instance, b))"""
_TOTAL = "sum({inc}) OVER (PARTITION BY instance, detector, k // 500 ORDER BY k)"
_VALUES = {
    "drift_alert": ("per", "CASE WHEN a > 55 THEN 1.0 ELSE 0.0 END"), "detectors_disabled": ("own", "CASE WHEN a > 54 THEN 1.0 ELSE 0.0 END"),
    "monitor_overhead_us": ("own", "60 + greatest(a - 45, 0) * 12"), "ring_utilization": ("own", "least(greatest((a - 40) / 15, 0), 1)"),
    "detector_failures_total": ("per", _TOTAL.format(inc="CASE WHEN a > 50 AND v > 60 AND k % 3 = j THEN 1 ELSE 0 END")),
    "summaries_dropped_total": ("own", _TOTAL.format(inc="CASE WHEN a > 54 AND v > 30 THEN 8 ELSE 0 END")),
    "observations_dropped_total": ("own", _TOTAL.format(inc="CASE WHEN a < 46 AND v > 30 THEN 1 ELSE 0 END")),
    "steps_observed_total": ("own", _TOTAL.format(inc="CASE WHEN a BETWEEN 44 AND 48 THEN 0 ELSE floor(v) + 1 END")),
}
_FLAGS = {
    "level": "SELECT instance, detector, ts, value {op} {bound} AS flag FROM s",
    "sum": "SELECT instance, NULL::VARCHAR AS detector, ts, sum(value) {op} {bound} AS flag FROM s GROUP BY instance, ts",
    "rate": "SELECT instance, detector, ts, CASE WHEN count(*) OVER w >= 2 THEN sum(grown) OVER w - first_value(grown) OVER w END {op} {bound} AS flag FROM (SELECT *, CASE WHEN p IS NULL THEN 0 WHEN value < p THEN value ELSE value - p END AS grown FROM (SELECT *, lag(value) OVER (PARTITION BY instance, detector ORDER BY ts) AS p FROM s)) WINDOW w AS (PARTITION BY instance, detector ORDER BY ts RANGE BETWEEN 299 PRECEDING AND CURRENT ROW)",
    "yesterday": "SELECT instance, detector, ts, value {op} {bound} * avg(value) OVER (PARTITION BY instance, detector ORDER BY ts RANGE BETWEEN 89999 PRECEDING AND 86400 PRECEDING) AS flag FROM s",
}
_FIRING = """n AS (SELECT *, CASE WHEN flag AND coalesce(NOT lag(flag) OVER w OR ts - lag(ts) OVER w > 300, true) THEN 1 ELSE 0 END AS new FROM (SELECT instance, detector, ts, coalesce(flag, false) AS flag FROM fl) WINDOW w AS (PARTITION BY instance, detector ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY instance, detector ORDER BY ts) AS run FROM n),
z AS (SELECT *, min(ts) OVER (PARTITION BY instance, detector, run) AS since FROM r WHERE flag)
SELECT instance, detector, since, min(ts) FILTER (WHERE ts - since >= {seconds}) AS fired, max(ts) AS last FROM z GROUP BY instance, detector, run, since HAVING fired IS NOT NULL"""


def _rule(name: str, rule: R.Rule) -> None:
    source, value = _VALUES[rule.metric]
    flags = _FLAGS[rule.kind].format(op=rule.op, bound=rule.bound)

    @query(f"rule_{name}", f"WITH {_SCRAPED}, s AS (SELECT instance, detector, ts, CAST({value} AS DOUBLE) AS value FROM {source}), fl AS ({flags}), {_FIRING.format(seconds=rule.seconds)}")
    def run(spark, d):
        return R.firing(R.holds(A.scrapes(spark, d), rule), rule.seconds)


for _name, _r in R.RULES.items():
    _rule(_name, _r)


_SER = f"WITH {ST}, s AS (SELECT metric AS key, step, CASE WHEN isfinite(value) THEN value END AS value FROM st)"


def _series(spark, d) -> DataFrame:
    return _st(spark, d).select(F.col("metric").alias("key"), "step", F.when(V.finite(F.col("value")), F.col("value")).alias("value"))


@query("dash_annotations", f"{_SER} SELECT key AS detector, CAST(coalesce(max(CAST(value > 50 AS INT)), 0) AS INTEGER) AS active FROM s GROUP BY key")
def dash_annotations(spark, d):
    return _series(spark, d).groupBy(F.col("key").alias("detector")).agg(F.coalesce(F.max((F.col("value") > 50).cast("int")), F.lit(0)).alias("active"))


@query("triage_pattern", """WITH u AS (SELECT o_orderkey AS step, CAST(o_orderkey % 3 - 1 AS INTEGER) AS entropy, CAST(o_orderkey // 3 % 3 - 1 AS INTEGER) AS js, CAST(o_orderkey // 9 % 3 - 1 AS INTEGER) AS embedding, o_orderkey // 27 % 2 = 1 AS sharp FROM orders)
SELECT *, CASE WHEN embedding > 0 AND entropy > 0 AND js > 0 AND sharp THEN 'deploy' WHEN embedding > 0 AND entropy > 0 AND js > 0 THEN 'everything moved' WHEN embedding > 0 AND entropy > 0 THEN 'covariate shift' WHEN embedding > 0 AND entropy = 0 AND js = 0 THEN 'input moved'
 WHEN js > 0 AND entropy < 0 AND embedding = 0 THEN 'prediction collapse' WHEN (entropy, js, embedding) IN ((1, 0, 0), (0, 1, 0), (0, 0, 1)) THEN 'suspect the monitor' WHEN entropy = 0 AND js = 0 AND embedding = 0 THEN 'quiet' ELSE 'unclear' END AS pattern FROM u""")
def triage_pattern(spark, d):
    k = F.col("o_orderkey")
    third = lambda n: (F.pmod(F.floor(k / n), F.lit(3)) - 1).cast("int")
    return R.triage(A.table(spark, d, "orders").select(k.alias("step"), third(1).alias("entropy"), third(3).alias("js"), third(9).alias("embedding"), (F.pmod(F.floor(k / 27), F.lit(2)) == 1).alias("sharp")))


@query("monitor_stats", f"""WITH RECURSIVE {ST}, s AS (SELECT DISTINCT step FROM st), {_DRAINS}, {_FIN},
em AS (SELECT 0::BIGINT AS rn, 0::DOUBLE AS ema, 0::DOUBLE AS last UNION ALL SELECT fin.rn, em.ema + 0.01 * (fin.value - em.ema), fin.value FROM em JOIN fin ON fin.metric = 'click' AND fin.rn = em.rn + 1),
n AS (SELECT (SELECT count(*) FROM s) AS steps, count(*) FILTER (WHERE enqueued) AS enq, count(*) FILTER (WHERE NOT enqueued) AS lost, least(count(*) FILTER (WHERE enqueued), (SELECT count(*) FROM s WHERE step % {RELEASE} = 7)) AS done FROM dr)
SELECT true AS enabled, 'spark' AS device, steps AS steps_observed, (SELECT count(*) FROM (SELECT step FROM st GROUP BY step HAVING count(*) FILTER (WHERE NOT isfinite(value)) > 0)) AS observations_dropped,
  lost * {BLOCK} AS summaries_dropped, enq AS drains_enqueued, done AS drains_completed, done * {BLOCK} AS rows_dispatched, round(least(greatest(steps - done * {BLOCK}, 0), 8) / 8, 6) AS ring_utilization,
  round((SELECT max_by(last, rn) FROM em), 6) AS last_enqueue_us, round((SELECT max_by(ema, rn) FROM em), 6) AS mean_enqueue_us, CAST(NULL AS DOUBLE) AS gpu_time_us,
  (SELECT coalesce(string_agg(component, ',' ORDER BY component), '') FROM (SELECT event_type AS component FROM events WHERE event_id % 7 = 0 GROUP BY event_type HAVING count(*) >= 280)) AS disabled_detectors,
  CAST(8 * 64 * (10 + 64) * 4 AS BIGINT) AS ring_bytes, CAST({CAPACITY} * {BLOCK} * 5 * 4 AS BIGINT) AS pinned_bytes FROM n""")
def monitor_stats(spark, d):
    """What a monitor says of itself, of the event streams: the click stream stands for the time that observing takes."""
    st, dr = _st(spark, d), _drains(spark, d)
    steps = st.select("step").distinct()
    one = steps.agg(F.count("*").alias("steps_observed"), F.count_if(F.col("step") % RELEASE == 7).alias("released"))
    bad = st.groupBy("step").agg(F.count_if(~V.finite(F.col("value"))).alias("n")).agg(F.count_if(F.col("n") > 0).alias("observations_dropped"))
    blocks = dr.agg(F.count_if("enqueued").alias("drains_enqueued"), (F.count_if(~F.col("enqueued")) * BLOCK).alias("summaries_dropped"))
    click = W.ema(st.where("metric = 'click'"), 0.01).join(W.finite_only(st), ["metric", "step"])
    time = click.agg(F.max_by("value", "step").alias("last_enqueue_us"), F.max_by("ema", "step").alias("mean_enqueue_us"))
    ev = A.table(spark, d, "events").where(F.col("event_id") % 7 == 0)
    off = state_of(ev.select(F.col("event_type").alias("component"), F.col("event_id").alias("step"), F.lit("").alias("error")), 280).where("disabled")
    off = off.agg(F.array_join(F.array_sort(F.collect_list("component")), ",").alias("disabled_detectors"))
    out = one.join(bad).join(blocks).join(time).join(off)  # one row each
    done = F.least("drains_enqueued", "released")
    values = {
        "enabled": F.lit(True), "device": F.lit("spark"), "drains_completed": done, "rows_dispatched": done * BLOCK,
        "ring_utilization": r6(F.least(F.greatest(F.col("steps_observed") - done * BLOCK, F.lit(0)), F.lit(8)) / 8, "x"), "last_enqueue_us": r6(F.col("last_enqueue_us"), "x"), "mean_enqueue_us": r6(F.col("mean_enqueue_us"), "x"),
        "gpu_time_us": F.lit(None).cast("double"), "ring_bytes": F.lit(M.ring_bytes(8, 64, A.CLASSES, 64)).cast("long"), "pinned_bytes": F.lit(M.pinned_bytes(CAPACITY, BLOCK, 5)).cast("long"),
    }
    return out.select(*[values.get(c, F.col(c)).alias(c) for c in M.STATS])


def decayed_covariance(spark, d):
    """Running covariance drift at the steps that refresh it; its value form is ``embedding_cov_drift``."""
    from .metrics import _running

    return _running(spark, d).where("step % 4 = 0").select("step", rounded("embedding_cov_drift", 3).alias("embedding_cov_drift"))


# the SQL is complete as it stands: its roundings are offset already
query("decayed_covariance")(decayed_covariance)
ORACLE_SQL["decayed_covariance"] = ORACLE_SQL["embedding_cov_drift"] + " WHERE t.step % 4 = 0"


@query("baseline_checksum", "SELECT true AS kept_same, true AS changed_differs, true AS other_model_refused, CAST(64 AS BIGINT) AS length")
def baseline_checksum(spark, d):
    """The checksum of a loaded artifact is that of the one saved, any changed number gives another, and another model's is refused."""
    from dataclasses import replace

    from ..operators.baseline import BaselineError, load
    from .metrics import _baseline, _kept

    made, path = _baseline(spark, d), _kept(spark, d)
    again = load(spark, path)
    changed = replace(again, embed_mean=again.embed_mean * (1 + 1e-12) + 1e-300)
    try:
        load(spark, path, "another")
        refused = False
    except BaselineError:
        refused = True
    row = (again.digest() == made.checksum, changed.digest() != made.checksum, refused, len(made.checksum))
    return spark.createDataFrame([row], "kept_same boolean, changed_differs boolean, other_model_refused boolean, length long")
