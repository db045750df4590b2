"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources share a total by weight, none above its cap (water filling: sources in
order of cap / weight are capped while the level stands above them, the rest share what
is left).  Whole epochs of a source come first; the remaining budget goes to documents
in ascending order of an exponential key -ln(u) / w, w being the document's quality
weight, until the running sum of sizes reaches it; the document at the edge is taken in
part, so a source's taken words equal its rounded target.

A source's running sum is not one sorted group: u ** (1 / w) puts documents into
``BUCKETS`` buckets, bucket sums are summed up over each source (a few numbers a bucket),
and only documents within one bucket are sorted together.

Defined results: u comes from a hash of seed, id and size, so reruns agree; null and
empty texts have size 0 and are taken 0 times; null sources are a source of their own,
last in order; repeated rows are rows of their own; a weight that is null or not
positive counts as the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKETS = 65_536
#: Weights of documents whose label says good or bad, and of those without a label.
GOOD, BAD, UNKNOWN = 1.0, 0.25, 0.7
#: Sources are broadcast to the documents up to this many.
BROADCAST_SOURCES = 10_000
#: Documents of a mix (some 40 bytes each) are broadcast to the texts up to this many, else joined by a shuffle.
BROADCAST_TAKEN = 500_000


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``: one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    df = df.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every) * share)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before_cap, before_weight = F.coalesce(F.sum("cap").over(level), F.lit(0.0)), F.coalesce(F.sum("weight").over(level), F.lit(0.0))
    df = df.withColumn("level", (F.col("total") - before_cap) / (F.sum("weight").over(every) - before_weight))
    df = df.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(every)["level"]
    return df.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight")).alias("target"))


def _with_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    side = table.withColumnRenamed("source", "_source")
    few = table.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix_sizes(rows: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """Rows of ``doc_id, source, size, quality`` with ``source_size, target`` and ``taken``."""
    w = F.when(F.col("quality") > 0, F.col("quality")).otherwise(UNKNOWN)
    hexed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    u = (F.conv(F.substring(hexed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    rows = common.stored(rows.withColumn("v", F.pow(u, 1 / w)), "sizes")
    table = common.stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets", few=True)
    df = _with_source(rows, table)
    df = df.withColumn("bucket", F.floor((1 - F.col("v")) * BUCKETS).cast("int"))
    sums = df.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    df = df.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))).drop("_source", "_bucket")
    within = Window.partitionBy("source", "bucket").orderBy(F.col("v").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return df.withColumn("taken", epochs * F.col("size") + part).drop("v", "bucket", "before", "weight")


def quality_weight(labels: DataFrame) -> DataFrame:
    """``doc_id, quality``: weights of labelled documents; the lowest label of an id counts."""
    said = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    return said.select(F.col("doc_id").alias("_id"), F.when(F.col("label") == 1, GOOD).otherwise(BAD).alias("quality"))


def sizes_of(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"))
    return rows.join(quality_weight(labels), F.col("doc_id") == F.col("_id"), "left").drop("_id")


def first_words(text: Column, k: Column) -> Column:
    """The text up to the end of its k-th word, white space as it is, from its beginning."""
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    parts = F.split(text, common.SPACE, (k + 1 + lead).cast("int"))
    rest = F.coalesce(F.get(parts, (k + lead).cast("int")), F.lit(""))
    return F.rtrim(F.left(text, F.char_length(text) - F.char_length(rest)), F.lit(" \t\n\x0b\x0c\r"))


def mix(docs: DataFrame, labels: DataFrame, weights: list[int], share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, a row for each time a document is taken whole, and one with its first words where it is taken in part.

    Documents are found again by id, source and size; rows equal in these three share
    what they take evenly, rounded down.  White space within what is taken stays.
    """
    taken = mix_sizes(sizes_of(docs, labels), weights, share, most, seed)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.floor(F.sum("taken") / F.count("*")).alias("taken")).where("taken > 0")
    taken = common.stored(taken, "taken")
    side = (F.broadcast(taken) if taken.count() <= BROADCAST_TAKEN else taken).alias("t")
    own = docs.select(common.as_row(docs.columns), "doc_id", "source", "text", common.n_words(F.col("text")).alias("n")).alias("d")
    both = own.join(side, F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("n") == F.col("t.size")))
    whole, rest = F.floor(F.col("taken") / F.col("n")), F.col("taken") % F.col("n")
    parts = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    both = both.select("row", "text", F.explode(parts).alias("words"))
    both = both.select("row", F.when(F.col("words") < 0, F.col("text")).otherwise(first_words(F.col("text"), F.col("words"))).alias("text"))
    return both.select(*common.of_row(docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long")))


WEIGHTS = [5, 2, 1]


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = common.read(spark, sf_dir, "labels").select("doc_id", "quality")
    return mix_sizes(sizes_of(docs, labels), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", "source")


OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
q AS (SELECT doc_id, CASE WHEN min(quality) = 1 THEN {GOOD} ELSE {BAD} END AS w FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
r AS (
  SELECT d.*, pow((CAST(CAST('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || size), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0, 1 / coalesce(w, {UNKNOWN})) AS v
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w FROM r GROUP BY source),
l AS (
  SELECT *, 2.0 * source_size AS cap,
    (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN cap <= level * w THEN cap ELSE w *
    (SELECT min_by(level, cap / w) FROM l WHERE NOT cap <= level * w) END AS target FROM l),
p AS (
  SELECT r.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
    CAST(coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY v DESC, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (goal // source_size) * size + least(greatest(goal % source_size - before, 0), size) END AS taken, source
FROM p
"""
