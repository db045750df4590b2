"""Quality rules with risk-controlled thresholds.

Each rule rejects documents whose ratio of two counts is above a cutoff.  Cutoffs come
from fixed lists, lenient to strict.  For each stratum (language) and rule the labelled
good documents that a cutoff would reject are counted; a cutoff is certified if the exact
binomial test rejects "the false-rejection rate is above ``ALPHA``", that is if
P[Bin(n, ALPHA) <= rejected] <= ``DELTA`` / (rules * strata).  Counts grow along a list, so
cutoffs are tested in order until one fails, which needs no further correction; over
rules and strata it is Bonferroni's.  The strictest certified cutoff holds; where a
stratum has too few labels none is certified and the rule rejects nothing there.

Everything is DataFrame expressions.  Defined results: null and empty texts have no words
and fail the base rule; null and empty languages share a stratum; a language without
labels has no cutoffs; of repeated labels of an id the lowest counts; repeated rows stay
repeated.  Words, lines and windows are compared by 64-bit hashes within a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALPHA, DELTA = 0.01, 0.1
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rule: numerator, denominator, cutoffs in thousandths from lenient to strict
RULES = {
    "symbols": ("n_symbols", "n_words", [3000, 1500, 800, 400, 200, 100]),
    "dup_lines": ("n_dup_lines", "n_lines", [900, 700, 500, 300]),
    "repeats": ("n_repeat_words", "n_words", [450, 400, 300, 200]),
    "long_words": ("word_chars", "n_words", [40000, 25000, 15000, 12000]),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Strata are broadcast up to this many.
BROADCAST_STRATA = 10_000


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus the counts that the rules use, over whole texts; columns of their names are replaced."""
    others = [c for c in docs.columns if c != text and c not in COUNTS]
    return _counted(docs.select(common.as_row(others), F.col(text).alias("text"))).select(*common.of_row(others), *COUNTS)


def _counted(docs: DataFrame) -> DataFrame:
    whole = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(whole, F.lit(WHITE))
    blank = lambda line: F.translate(line, WHITE, "") == ""
    df = docs.select(
        "row",
        F.char_length(F.translate(whole, WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length(whole) - F.char_length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.filter(F.split(whole, "\n"), lambda x: ~blank(x)), lambda x: F.xxhash64(x)).alias("_lines"),
        F.when(trimmed == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(trimmed, common.SPACE), lambda w: F.xxhash64(w))).alias("_h"),
    )
    n = F.size("_h")
    pairs = F.zip_with("_h", F.slice("_h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice("_h", F.lit(3), n), lambda ab, c: F.xxhash64(ab, c))
    df = df.select("*", n.cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.slice(triples, F.lit(1), F.greatest(n - 2, F.lit(0))).alias("_g"))
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    # only texts with a repeated window sort theirs
    placed = F.when(repeated, F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    df = df.drop("_h", "_lines").withColumn("_s", placed).drop("_g")
    after = F.zip_with("_s", F.slice("_s", F.lit(2), F.size("_s")), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
    df = df.withColumn("_after", after)
    before = F.concat(F.array(F.lit(False)), F.slice("_after", F.lit(1), F.size("_after") - 1))
    flagged = F.zip_with(F.zip_with("_s", "_after", lambda s, e: F.struct(s["i"].alias("i"), e.alias("e"))), before, lambda s, p: F.when(s["e"] | p, s["i"]))
    df = df.withColumn("_at", F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))).drop("_s", "_after")
    steps = F.zip_with("_at", F.slice("_at", F.lit(2), F.size("_at")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_at")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P[Bin(n, p) <= k], summed term by term from logarithms."""
    first = n.cast("double") * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = F.when(i == 0, acc["t"]).otherwise(acc["t"] + F.log((n - i + 1).cast("double") / F.greatest(i, F.lit(1)).cast("double")) + odds)
        return F.struct(t.alias("t"), F.when(i == 0, acc["s"]).otherwise(acc["s"] + F.exp(t)).alias("s"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step)["s"]


def _above(rule: str, cutoff: Column | int) -> Column:
    over, under, _ = RULES[rule]
    return F.col(over) * 1000 > F.col(under) * cutoff


def certified_cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and a cutoff a rule (null where none is certified) from labelled good rows with ``stratum`` and the counts."""
    hits = [F.count_if(_above(r, c)).alias(f"{r}_{c}") for r, (_, _, cutoffs) in RULES.items() for c in cutoffs]
    table = common.stored(good.groupBy("stratum").agg(F.count("*").alias("n"), *hits), "strata", few=True)
    level = delta / (len(RULES) * max(1, table.count()))
    chosen = []
    for r, (_, _, cutoffs) in RULES.items():
        # beyond n * alpha the tail is above any sensible level, and is not summed
        ok = [F.when(F.col(f"{r}_{c}") <= F.col("n") * alpha, binomial_tail(F.col(f"{r}_{c}"), F.col("n"), alpha) <= level).otherwise(False) for c in cutoffs]
        n_ok = sum((o.cast("int") for o in ok[1:]), ok[0].cast("int"))
        chosen.append(F.get(F.array(*[F.lit(c) for c in cutoffs]), n_ok - 1).alias(f"cut_{r}"))
    return table.select("stratum", *chosen)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs`` (without text) with the counts, ``base_failed``, ``rejected_by`` (rules) and ``kept``."""
    others = [c for c in docs.columns if c != text and c not in (*COUNTS, "base_failed", "rejected_by", "kept")]
    counted = text_counts(docs.select(common.as_row(others), F.col(id_col).alias("id"), F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), F.col(text).alias("text")))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counted = common.stored(counted.withColumn("base_failed", base), "counts")
    said = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    good = counted.where(~F.col("base_failed")).join(said.where("quality = 1"), "id")
    cutoffs = common.stored(certified_cutoffs(good, alpha, delta), "cutoffs", few=True)
    few = cutoffs.count() <= BROADCAST_STRATA
    rows = counted.join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    rules = F.array_compact(F.array(*[F.when(_above(r, F.col(f"cut_{r}")), F.lit(r)) for r in RULES]))
    rows = rows.withColumn("rejected_by", rules)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return rows.select(*common.of_row(others), *COUNTS, "base_failed", "rejected_by", kept.alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = apply_rules(docs, common.read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def _rule_sql() -> tuple[str, str, str]:
    tests = ", ".join(f"('{r}', {i}, {c})" for r, (_, _, cs) in RULES.items() for i, c in enumerate(cs))
    over = " ".join(f"WHEN '{r}' THEN {o} * 1000 > {u} * cutoff" for r, (o, u, _) in RULES.items())
    return tests, f"CASE rule {over} END", str(len(RULES))


_TESTS, _OVER, _N = _rule_sql()
OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
c AS (
  SELECT d.rid, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.rid = cov.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
tests(rule, i, cutoff) AS (VALUES {_TESTS}),
good AS (
  SELECT b.* FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) q
  ON b.doc_id = q.doc_id WHERE q.q = 1 AND NOT base_failed),
k AS (
  SELECT stratum, rule, i, cutoff, count(*) AS n, count(*) FILTER (WHERE {_OVER}) AS k
  FROM good, tests GROUP BY stratum, rule, i, cutoff),
ok AS (
  SELECT *, k <= n * {ALPHA} AND list_sum(list_transform(range(0, k + 1), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))))
    <= {DELTA} / ({_N} * (SELECT count(DISTINCT stratum) FROM good)) AS fine
  FROM k),
cut AS (
  SELECT stratum, rule, max(i) FILTER (WHERE fine) AS i FROM ok GROUP BY stratum, rule),
chosen AS (SELECT cut.stratum, cut.rule, tests.cutoff FROM cut JOIN tests ON cut.rule = tests.rule AND cut.i = tests.i),
bad AS (
  SELECT rid, list(rule ORDER BY {{ORDER}}) AS rules FROM b JOIN chosen USING (stratum) WHERE {_OVER} GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rules IS NULL AS kept, coalesce(array_to_string(rules, ','), '') AS rejected_by
FROM b LEFT JOIN bad ON b.rid = bad.rid
""".replace("{ORDER}", "list_position([" + ", ".join(f"'{r}'" for r in RULES) + "], rule)")
