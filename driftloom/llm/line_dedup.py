"""Line dedup: an exact set-similarity join of lines, whose later matches are removed.

A line's set holds its distinct words, lower-cased.  Lines match when the Jaccard
similarity of their sets is at least 0.8, and a line goes if it matches an earlier one,
whether that one stays or not.  Earlier means: smaller document id (null last), then
order of text hash, then line number.  Lines of fewer than ``MIN_WORDS`` distinct words
are left alone, or, with ``short_lines``, go if an earlier line has the same words in the
same order (lower-cased; white space does not count).  Lines without words stay.

1. One scan counts tokens in 2 ** ``CELL_BITS`` cells: a table of fixed size that orders tokens by
   rarity (any order gives the same links).  It is read as a scalar subquery, so that no
   plan holds it.
2. A second scan makes each line's set in that order, its prefix, and a parity word (bit i
   is the parity of the tokens that hash to i; four words for long sets), and keeps those, not the sets.  Of equal
   sets the first line stands for all; its later lines go.
3. Prefix tokens are joined with each other under length, positional and parity filter
   (the latter bounds the symmetric difference from below).  It is a semi-join: a set
   that may have an earlier partner gives one row for a token at most, however large a group is.
4. The lines of such sets, and of those that they may match, are read once more and verified
   with their tokens.  First a set is held against the earlier ones of the rarest token at
   which one may match; the few for which that fails ask at their other such tokens.

Adaptive execution splits frequent tokens.  Everything is DataFrame expressions.

Defined results: null and empty texts stay as they are; rows that repeat both id and
text are one document and stay equal; other columns are handed through unchanged,
whatever their names, those named ``removed`` or ``n_lines`` are replaced; a document may
end up with an empty text and is kept.  Words are told apart by 56-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PERCENT, MIN_WORDS = 80, 5
CELL_BITS = 20
#: From this size on one parity word says little, since too many tokens may differ.
WIDE = 96
#: Ids or removed lines (some 50 bytes each) are broadcast up to this many, else joined by a shuffle.
BROADCAST_LINES = 250_000


def plain(text: Column) -> Column:
    """Lower-cased, with blanks for all white space but line ends."""
    odd = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\x0c"))
    return F.when(odd, F.translate(F.lower(text), "\t\x0b\x0c\r", "    ")).otherwise(F.lower(text))


def cell_of(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - CELL_BITS)


def rarity(docs: DataFrame, text: str) -> DataFrame:
    """One row, ``cells``: for each cell the logarithm of the count of its tokens in quarters of an octave, at most 126; 1 MB whatever the input."""
    spark = docs.sparkSession
    word = docs.select(F.explode(F.split(F.replace(plain(F.col(text)), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = word.groupBy(cell_of(F.xxhash64("w")).alias("cell")).count()
    step = F.least(F.lit(126), F.floor(4 * F.log2("count") + 1)).cast("tinyint")
    every = spark.range(1 << CELL_BITS).join(counts, F.col("id") == F.col("cell"), "left").select(F.col("id").alias("cell"), F.coalesce(step, F.lit(0).cast("tinyint")).alias("step"))
    # parts of 1024 cells, then the parts in order: fixed sizes
    part = every.groupBy(F.shiftright("cell", 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("cell", "step"))).alias("s"))
    part = part.select("part", F.transform("s", lambda x: x["step"]).alias("s"))
    one = part.groupBy().agg(F.array_sort(F.collect_list(F.struct("part", "s"))).alias("parts"))
    return common.stored(one.select(F.flatten(F.transform("parts", lambda x: x["s"])).alias("cells")), "rarity")


def ranked(line: Column, cells: Column) -> Column:
    """A plain line's distinct words, rarest first: the cell's byte and 56 bits of the word's hash in one long."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    byte = lambda t: F.coalesce(F.get(cells, cell_of(t)), F.lit(0).cast("tinyint")).cast("long")
    token = lambda t: F.shiftleft(byte(t), 56).bitwiseOR(F.shiftrightunsigned(t, 8))
    return F.sort_array(F.transform(F.array_except(hashes, F.array(F.xxhash64(F.lit("")))), token))


def prefix_size(n: Column) -> Column:
    return n - F.ceil(n * PERCENT / 100).cast("int") + 1


def parity(tokens: Column) -> Column:
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(bit(t)))


def parities(tokens: Column) -> Column:
    """Four parity words, a token counting in one of them by two more of its bits; null for less than ``WIDE`` tokens."""
    part = lambda i: F.filter(tokens, lambda t: t.bitwiseAND(F.lit(192)) == 64 * i)
    return F.when(F.size(tokens) >= WIDE, F.array(*[parity(part(i)) for i in range(4)]))


def differ(a: str, b: str) -> Column:
    """Tokens that stand in one of two sets only, at least."""
    x, y = F.col(f"{a}.wide"), F.col(f"{b}.wide")
    wide = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(1, 4)), F.bit_count(x[0].bitwiseXOR(y[0])))
    return F.coalesce(wide, F.bit_count(F.col(f"{a}.parity").bitwiseXOR(F.col(f"{b}.parity"))))


def short(token: Column) -> Column:
    """31 bits of a token, enough to meet: what differs in the rest only fails the verification."""
    return token.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def may_match(a: str, b: str) -> Column:
    """Length, positional and parity filter on two postings of one token."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    both = (na + nb) * PERCENT
    # tokens that must be shared: both / (100 + PERCENT), rounded up
    need = F.call_function("div", both + (99 + PERCENT), F.lit(100 + PERCENT))
    rest = F.least(na - F.col(f"{a}.pos"), nb - F.col(f"{b}.pos"))
    return (F.col(f"{a}.token") == F.col(f"{b}.token")) & (na * 100 >= nb * PERCENT) & (nb * 100 >= na * PERCENT) & (rest * (100 + PERCENT) >= both) & (differ(a, b) <= na + nb - 2 * need)


def place() -> Column:
    """Null ids come last."""
    return F.struct(F.col("doc").isNull().alias("null"), F.col("doc"), F.col("hash"), F.col("at"))


def as_written(line: Column) -> Column:
    """Key of a short line: its words in order, apart from the keys of sets."""
    return F.xxhash64(F.regexp_replace(F.btrim(line), " +", " "), F.lit("short"))


def not_after(a: str, b: str) -> Column:
    """The document of ``a`` is not after that of ``b``, null ids coming last."""
    x, y = F.col(f"{a}.doc"), F.col(f"{b}.doc")
    return F.coalesce(x <= y, y.isNull())


def later_matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text", short_lines: bool = False) -> DataFrame:
    """``doc, hash, removed``: numbers of the lines to remove, a row for each document that loses some."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text).alias("text"))
    cells = rarity(docs, "text")
    # hashed and split once a text; an outer explode, since Spark would split once more to filter before an inner one
    rows = docs.select("doc", F.xxhash64("text").alias("hash"), F.split(plain(F.col("text")), "\n").alias("parts"))
    rows = rows.select("doc", "hash", F.posexplode_outer("parts").alias("at", "line"))
    rows = rows.where(F.btrim("line") != "" if short_lines else F.length("line") >= 2 * MIN_WORDS - 1)
    lines = rows.withColumn("cells", cells.scalar()).select("doc", "hash", "at", "line", ranked(F.col("line"), F.col("cells")).alias("r"))
    n = F.size("r")
    key = F.xxhash64("r")
    if short_lines:
        key = F.when(n >= MIN_WORDS, key).otherwise(as_written(F.col("line")))
    # sets of WIDE tokens and more are held against smaller ones by it, which have at most so many tokens less
    narrow = F.when(n * PERCENT < WIDE * 100, parity(F.col("r")))
    prefix = F.transform(F.slice("r", F.lit(1), prefix_size(n)), short)
    lines = lines.select("doc", "hash", "at", key.alias("key"), n.alias("n"), narrow.alias("parity"), parities(F.col("r")).alias("wide"), F.when(n >= MIN_WORDS, prefix).alias("prefix"))
    # filtered as it is read, since a filter before would make every set twice
    lines = common.stored(lines, "lines")
    if not short_lines:
        lines = lines.where(F.col("n") >= MIN_WORDS)
    sets = lines.groupBy("key").agg(F.min(place()).alias("first"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix"))
    # the document as a column of its own: a field would be taken out at different places of the two sides below
    sets = common.stored(sets.withColumn("doc", F.col("first.doc")), "sets")
    gone = _similar(docs, sets, cells)

    # of equal sets, and of equal short lines, the first stays; of a set that matches an earlier one, none
    behind = sets.select("key", "first", "times").join(_small(gone), "key", "left").where("times > 1 OR gone").drop("times")
    marked = lines.select("doc", "hash", "at", "key").join(_small(common.stored(behind, "behind", few=True)), "key")
    drop = marked.where((place() != F.col("first")) | F.coalesce(F.col("gone"), F.lit(False)))
    return drop.groupBy("doc", "hash").agg(F.sort_array(F.collect_set("at")).alias("removed"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_LINES else df


def _similar(docs: DataFrame, sets: DataFrame, cells: DataFrame) -> DataFrame:
    """``key, gone`` of the sets that an earlier set matches."""
    posting = sets.select("key", "n", "parity", "wide", "doc", F.posexplode("prefix").alias("pos", "token"))
    fits = may_match("a", "b") & (F.col("a.key") != F.col("b.key")) & not_after("a", "b")
    # the same columns of both sides, in the order they have anyway, so that one exchange serves the two
    hits = common.stored(posting.alias("b").join(posting.alias("a"), fits, "left_semi"), "hits")
    # a set asks first where its token is rarest, then, if nobody there matches, at its other tokens
    asked = common.stored(hits.groupBy("key").agg(F.min_by(F.struct("doc", "n", "parity", "wide", "pos", "token"), "pos").alias("x")).select("key", "x.*"), "asked", few=True)
    found = common.stored(_matched(docs, sets, posting, asked, cells), "found", few=True)
    more = hits.join(_small(found), "key", "left_anti").join(asked.select("key", "token"), ["key", "token"], "left_anti")
    more = common.stored(more.select(asked.columns), "more", few=True)
    if not more.isEmpty():
        found = common.stored(found.union(_matched(docs, sets, posting, more, cells)).distinct(), "found", few=True)
    return found.withColumn("gone", F.lit(True))


def _matched(docs: DataFrame, sets: DataFrame, posting: DataFrame, asked: DataFrame, cells: DataFrame) -> DataFrame:
    """Keys of the postings ``asked`` whose sets match an earlier set that has the same token."""
    fits = may_match("a", "b") & (F.col("a.key") != F.col("b.key")) & not_after("a", "b")
    asks = asked.select("key", "token", F.lit(True).alias("asks"))
    held = posting.alias("a").join(_small(asked).alias("b"), fits, "left_semi").select("key", "token", F.lit(False).alias("asks"))
    held = common.stored(asks.union(held).groupBy("key", "token").agg(F.max("asks").alias("asks")), "held", few=True)
    n = held.count()
    where = (F.broadcast(held) if n <= BROADCAST_LINES else held).join(sets.select("key", "first"), "key")
    wanted = where.groupBy(F.col("first.doc").alias("_doc"), F.col("first.hash").alias("_hash")).agg(F.collect_list(F.struct("token", "asks", "first")).alias("ats"))
    rows = docs.withColumn("hash", F.xxhash64("text"))
    rows = rows.join(F.broadcast(wanted) if n <= BROADCAST_LINES else wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("hash") == F.col("_hash")))
    # split once a text, not once a line
    parts = rows.select("ats", F.split(plain(F.col("text")), "\n").alias("parts"))
    picked = parts.select(F.explode(F.transform("ats", lambda x: F.struct(x["token"].alias("token"), x["asks"].alias("asks"), x["first"].alias("first"), F.get("parts", x["first"]["at"]).alias("line")))).alias("x")).select("x.*")
    post = picked.withColumn("cells", cells.scalar()).select("token", "asks", "first", ranked(F.col("line"), F.col("cells")).alias("r"))
    same, n = F.size(F.array_intersect("a.r", "b.r")), F.size("a.r") + F.size("b.r")
    # put so that it can't be taken to one side: then one exchange, and one reading of the texts, serves the two
    asks = F.col("b.asks") | (F.col("a.asks") & F.col("a.token").isNull())
    fits = (F.col("a.token") == F.col("b.token")) & asks & (F.col("a.first") < F.col("b.first")) & (same * 100 >= (n - same) * PERCENT)
    found = common.stored(post.alias("b").join(post.alias("a"), fits, "left_semi").select("first").distinct(), "matched", few=True)
    return sets.select("key", "first").join(_small(found), "first", "left_semi").select("key")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", short_lines: bool = False) -> DataFrame:
    """``docs`` without the lines that match earlier ones, plus ``n_lines`` (before) and ``removed`` (their numbers from 0)."""
    with common.scratch(docs.sparkSession):
        gone = common.stored(later_matches(docs, id_col, text, short_lines), "removed_lines", few=True, keep=True)
    few = (gone.agg(F.sum(F.size("removed"))).first()[0] or 0) <= 4 * BROADCAST_LINES
    columns = [c for c in docs.columns if c not in ("removed", "n_lines")]
    rows = docs.select(common.as_row(columns), F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("own"))
    rows = rows.join(F.broadcast(gone) if few else gone, F.col("id").eqNullSafe(F.col("doc")) & (F.col("own") == F.col("hash")), "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col("removed"), i)), "\n")
    new = F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    n_lines = F.coalesce(F.size(parts), F.lit(0)).cast("long")
    return rows.select(*common.of_row(columns, **{text: new}), n_lines.alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.read(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"), "text")
