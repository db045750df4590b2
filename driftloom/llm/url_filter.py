"""URL filters: host and path rules, and a listed set of canonical URLs.

The list is held as a blocked Bloom filter: one row per block of 256 bits, four longs.
A key picks one block and one bit in each long, so one lookup by block tests a key.
Only rows whose key may be listed have a key for the exact join, which removes the false
positives; all others never meet the list itself.  Pages are read once.

Everything is DataFrame expressions.  Defined results: a null URL or one without
``://`` has empty host and path and is never listed; repeated rows stay repeated;
empty lists and empty tables give the rules' verdicts and ``allow``.  Columns of the
input are never looked at apart from the URL column, so other columns may have any
name but those added (``host``, ``path``, ``rule``, ``listed``, ``verdict``), which
are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORDS_PER_BLOCK = 4
#: Bits for each listed key; four probes in one 256-bit block then pass about 1 % of the others.
BITS_PER_KEY = 16
#: The filter is broadcast up to this many blocks (40 bytes each), joined by block beyond.
BROADCAST_BLOCKS = 400_000
#: The list itself (some 100 bytes each) is broadcast to the filter's hits up to this many.
BROADCAST_KEYS = 100_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def site_of(host: Column) -> Column:
    """Host without user, port, a trailing dot and the common front labels."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:\d*)?$", "")
    return F.regexp_replace(bare, r"^((www|m|blog)\.)+(?=.*\.)", "")


def canonical(host: Column, path: Column) -> Column:
    """``site/path`` without file ending and closing slashes; null for an empty host."""
    end = F.regexp_replace(path, r"(/index)?(\.html?)?/*$", "")
    return F.when(host != "", F.concat(site_of(host), F.when(end == "", F.lit("/")).otherwise(end)))


def _probe(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number of a key, and its bit in each long of the block."""
    one, two = F.xxhash64(key), F.xxhash64(key, F.lit(2))
    bits = [F.shiftrightunsigned(two, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS_PER_BLOCK)]
    return F.pmod(one, F.lit(blocks).cast("long")), [F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Blocked Bloom filter of a key column: ``_block`` and its longs ``_w0`` .. ``_w3``."""
    block, bits = _probe(F.col(key), blocks)
    row = keys.select(block.alias("_block"), *[b.alias(f"_w{i}") for i, b in enumerate(bits)])
    return row.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS_PER_BLOCK)])


def _may_hold(rows: DataFrame, filt: DataFrame, key: str, blocks: int, flag: str) -> DataFrame:
    block, bits = _probe(F.col(key), blocks)
    # a null key goes to blocks of its own, so that such rows do not meet in one task
    block = F.coalesce(F.when(F.col(key).isNotNull(), block), -F.lit(1).cast("long") - F.pmod(F.xxhash64("_salt"), F.lit(4096)))
    side = F.broadcast(filt) if blocks <= BROADCAST_BLOCKS else filt
    hit = F.lit(True)
    for i, b in enumerate(bits):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(b) != 0)
    joined = rows.withColumn("_block", block).join(side, "_block", "left")
    return joined.withColumn(flag, F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()).drop("_block", *[f"_w{i}" for i in range(WORDS_PER_BLOCK)])


def _is_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` (row, host, path, _salt) plus boolean ``listed``."""
    entry = listed.select(canonical(host_of(F.col("url")), path_of(F.col("url"))).alias("_key")).where("_key IS NOT NULL").distinct()
    n = entry.count()
    if not n:
        return rows.withColumn("listed", F.lit(False))
    entry = common.stored(entry, "listed", few=True)
    blocks = max(1, -(-n * BITS_PER_KEY // (64 * WORDS_PER_BLOCK)))
    filt = bloom(entry, "_key", blocks)
    for key, value, hit in (("_url", canonical(F.col("host"), F.col("path")), "_hit1"), ("_site", F.when(F.col("host") != "", F.concat(site_of(F.col("host")), F.lit("/"))), "_hit2")):
        rows = _may_hold(rows.withColumn(key, value), filt, key, blocks, "_in")
        # only what the filter passes has a key to join by; the others go to null keys dealt out by the salt
        asked = F.when(F.col("_in"), F.col(key)).otherwise(F.concat(F.lit("\n"), F.pmod(F.xxhash64("_salt"), F.lit(4096)).cast("string")))
        side = entry.select(F.col("_key").alias("_asked"), F.lit(True).alias(hit))
        rows = rows.withColumn("_asked", asked).join(F.broadcast(side) if n <= BROADCAST_KEYS else side, "_asked", "left").drop("_asked", "_in", key)
    return rows.withColumn("listed", F.coalesce(F.col("_hit1"), F.lit(False)) | F.coalesce(F.col("_hit2"), F.lit(False))).drop("_hit1", "_hit2")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest fitting rule and its verdict, null where none fits.

    ``rules`` are (verdict, ``host/path``); a rule fits its host and all subdomains if
    the path starts with the rule's.  Of equally long rules the first given wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])) if rules else []:
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``listed`` and ``verdict`` (allow or block).

    A rule's verdict comes first; where none fits, listed URLs are blocked.  A page is
    listed if its canonical URL or the root of its site is the canonical form of a URL
    in ``listed`` (column ``url``).
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "listed", "verdict")]
    df = pages.select(common.as_row(own), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias("_salt"))
    df = _is_listed(df, listed)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return df.select(*common.of_row(own), "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))


#: The query's rules and its list of unwanted sites.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SITES = ["ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets"]
LISTED = [f"http://{s}.example.{d}/" for s in SITES for d in ("com", "net", "org")]


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


OP6_SQL = rf"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, rule, rhost, rpath) AS (VALUES
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
site AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:\d*)?$', ''), '^((www|m|blog)\.)+', '') AS site FROM p),
j AS (
  SELECT s.*, r.rule, r.verdict,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM site s LEFT JOIN r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN l THEN 'block' ELSE 'allow' END) AS verdict, l AS listed
FROM (SELECT *, site IN ({", ".join(f"'{s}.example.{d}'" for s in SITES for d in ("com", "net", "org"))}) AS l FROM j WHERE k = 1)
"""
