"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Words, and beginnings of words, that toxic documents favour make a learned lexicon of
log odds, beside a short fixed one.  Labelled documents of the training part are dealt
into ``FOLDS`` by a hash of the id; a document's features for fitting come from the
lexicon of the other folds.  All folds but the last grow the trees, the last calibrates;
the model then scores with the lexicon of all.
Features of a whole text: densities of both lexica, how near their words stand to the
second person, capitals, punctuation, and obfuscated words.  Labels, language, source
and id are never features.

The fit runs in one task over at most ``MAX_ROWS`` labelled documents, those with the
smallest hash of the id, and only the model goes to the driver; scoring reads every
document once and shuffles nothing.

Defined results: null and empty texts get the score of a text without any words; of
repeated labels of an id the highest counts; without any labels of either kind the
score is the share of toxic labels (0 without labels); repeated rows get equal scores.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents that a fit reads at most.
MAX_ROWS = 12_000
STEM = 4
FOLDS = 5
#: Common insults, and second-person words of four languages.
INSULTS = frozenset("loser idiot pathetic scum worthless moron trash clown disgusting stupid dumb fool liar garbage vermin filth freak jerk imbecile hate ugly".split())
YOU = frozenset("you your yours yourself ur u du dein deine dir dich ihr euch tu toi ton ta tes vous votre vos te ti tú usted ustedes vosotros su".split())
EDGE = ".,;:!?\"'()[]{}<>*#$%&|-_~`"
#: Begins where a run of letters does, so that a run is looked at once.
MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0-9@$*!+|]++[^\W\d_]++")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
FEATURES = ("n_words", "insults", "insult_share", "learned", "learned_share", "learned_max", "stems", "stem_share", "stem_max", "near_you", "you_share", "caps", "caps_words", "marks", "double_marks", "mixed", "triple")


@dataclass
class Lexicon:
    """Log odds of words and of word beginnings."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


def words_of(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(EDGE))]


def _held(texts: list[str], toxic: np.ndarray) -> dict:
    """Numbers of toxic and other documents that hold each word and beginning."""
    out: dict = {"n": (int(toxic.sum()), int((~toxic).sum()))}
    for kind, make in (("words", lambda ws: set(ws)), ("stems", lambda ws: {w[:STEM] for w in ws if len(w) > STEM})):
        both = Counter(), Counter()
        for t, y in zip(texts, toxic, strict=True):
            both[not y].update(make(words_of(t)))
        out[kind] = both
    return out


def learn_lexicon(parts: list[dict], odds: float = 2.0) -> Lexicon:
    """Words and beginnings in at least 3 toxic documents (0.4 % of them, if that is more), ``e ** odds`` times as often as elsewhere."""
    out = Lexicon()
    n1, n0 = (sum(p["n"][i] for p in parts) for i in (0, 1))
    least = max(3, 0.004 * n1)
    for kind in ("words", "stems"):
        yes: Counter = Counter()
        for p in parts:
            yes.update(p[kind][0])
        for w, k in yes.items():
            if k >= least:
                no = sum(p[kind][1][w] for p in parts)
                score = math.log((k + 0.5) / (n1 + 1)) - math.log((no + 0.5) / (n0 + 1))
                if score >= odds:
                    getattr(out, kind)[w] = score
    return out


def features(text: str | None, lex: Lexicon) -> list[float]:
    text = text or ""
    ws = words_of(text)
    n = max(1, len(ws))
    known, stems = lex.words, lex.stems
    fixed = [i for i, w in enumerate(ws) if w in INSULTS]
    own = [(i, known[w]) for i, w in enumerate(ws) if w in known]
    begun = [(i, stems[s]) for i, w in enumerate(ws) if (s := w[:STEM]) in stems and len(w) > STEM]
    you = np.array([i for i, w in enumerate(ws) if w in YOU])
    hits = np.array(sorted({*fixed, *(i for i, _ in own), *(i for i, _ in begun)}))
    near = 0
    if len(you) and len(hits):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(at, len(you) - 1)]), np.abs(hits - you[np.maximum(at - 1, 0)]))
        near = int((gap <= 5).sum())
    upper = sum(map(str.isupper, text)) if text else 0
    raw = text.split()
    marks = text.count("!") + text.count("?")
    odd = len(MIXED.findall(text))
    return [
        math.log1p(len(ws)), math.log1p(len(fixed)), len(fixed) / n,
        math.log1p(len(own)), sum(s for _, s in own) / n, max((s for _, s in own), default=0.0),
        math.log1p(len(begun)), sum(s for _, s in begun) / n, max((s for _, s in begun), default=0.0),
        near / n, len(you) / n, upper / max(1, len(text)), sum(map(str.isupper, raw)) / n,
        marks / max(1, len(text)), (text.count("!!") + text.count("?!") + text.count("??")) / n, odd / n, len(TRIPLE.findall(text)) / n,
    ]


@dataclass
class Boosted:
    """Boosted regression trees on log odds, grown level by level over quantile bins."""

    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    least: int = 5
    penalty: float = 1.0
    base: float = 0.0
    grown: list[tuple[list[tuple[int, float] | None], np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 65)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        width = 65
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            splits: list[tuple[int, float] | None] = []
            for level in range(self.depth):
                n_nodes = 1 << level
                best = np.zeros(n_nodes)
                chosen: list[tuple[int, int] | None] = [None] * n_nodes
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    key = node * width + bins[:, f]
                    g, h, c = (np.bincount(key, weights=v, minlength=n_nodes * width).reshape(n_nodes, width) for v in (grad, hess, np.ones(len(y))))
                    gl, hl, cl = g.cumsum(1)[:, : len(e)], h.cumsum(1)[:, : len(e)], c.cumsum(1)[:, : len(e)]
                    gt, ht, ct = g.sum(1)[:, None], h.sum(1)[:, None], c.sum(1)[:, None]
                    gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(cl < self.least) | (ct - cl < self.least)] = 0
                    top = gain.argmax(1)
                    for k in range(n_nodes):
                        if gain[k, top[k]] > best[k] + 1e-9:
                            best[k], chosen[k] = gain[k, top[k]], (f, int(top[k]))
                splits += [None if s is None else (s[0], float(edges[s[0]][s[1]])) for s in chosen]
                right = np.zeros(len(y), bool)
                for k, s in enumerate(chosen):
                    if s is not None:
                        at = node == k
                        right[at] = bins[at, s[0]] > s[1]
                node = node * 2 + right
            g, h = (np.bincount(node, weights=v, minlength=1 << self.depth) for v in (grad, hess))
            leaf = self.rate * g / (h + self.penalty)
            self.grown.append((splits, leaf))
            score = score + leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for splits, leaf in self.grown:
            node, at = np.zeros(len(x), np.int64), 0
            for level in range(self.depth):
                right = np.zeros(len(x), bool)
                for k in range(1 << level):
                    if (s := splits[at + k]) is not None:
                        own = node == k
                        right[own] = x[own, s[0]] > s[1]
                at += 1 << level
                node = node * 2 + right
            score += leaf[node]
        return score


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of a non-decreasing calibration, drawn in by half a case at each end of a pool."""
    at, back = np.unique(raw, return_inverse=True)
    good, n = np.bincount(back, weights=y), np.bincount(back).astype(float)
    pools: list[list[float]] = []
    for x, g, c in zip(at, good, n, strict=True):
        pools.append([x, x, g, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, hi, g2, c2 = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + g2, pools[-1][3] + c2]
    knots = np.array([k for p in pools for k in (p[0], p[1])])
    values = np.repeat([(p[2] + 0.5 * y.mean()) / (p[3] + 0.5) for p in pools], 2)
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    knots: np.ndarray
    values: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.values[0])
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(len(texts), len(FEATURES))
        return np.clip(np.interp(self.trees.raw(x), self.knots, self.values), 0, 1)


def fit_rows(texts: list[str], toxic: np.ndarray, fold: np.ndarray) -> Model:
    """``fold`` from 0 to ``FOLDS`` - 1; the last one calibrates."""
    toxic = np.asarray(toxic, bool)
    share = float(toxic.mean()) if len(toxic) else 0.0
    at = [np.flatnonzero(fold == f) for f in range(FOLDS)]
    parts = [_held([texts[i] for i in a], toxic[a]) for a in at]
    lex = learn_lexicon(parts)
    last = at[-1]
    if not 4 <= toxic.sum() <= len(toxic) - 4 or not 0 < toxic[last].sum() < len(last):
        return Model(lex, None, np.zeros(1), np.array([share]))
    x = np.zeros((len(texts), len(FEATURES)))
    for f, a in enumerate(at):
        own = learn_lexicon(parts[:f] + parts[f + 1 :])
        for i in a:
            x[i] = features(texts[i], own)
    grow = np.concatenate(at[:-1])
    trees = Boosted().fit(x[grow], toxic[grow].astype(float))
    return Model(lex, trees, *isotonic(trees.raw(x[last]), toxic[last].astype(float)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled documents whose crc32 of the id, as text, is not 1 modulo 3."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    said = said.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    chosen = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").alias("_id"), "toxic")
    # at most max_rows ids
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.pmod(F.xxhash64(F.first("doc_id"), F.lit(7)), F.lit(FOLDS)).alias("h"))
    with common.small_batches(docs.sparkSession):
        told = rows.repartition(1).mapInPandas(lambda b: common.tidy(_learn(b)), "model binary").collect()
    return pickle.loads(told[0]["model"]) if told else fit_rows([], np.zeros(0, bool), np.zeros(0, int))


def _learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got = sorted((r for pdf in batches for r in zip(pdf["doc_id"].tolist(), pdf["text"], pdf["toxic"].tolist(), pdf["h"].tolist(), strict=True)), key=lambda r: r[0])
    model = fit_rows([t or "" for _, t, _, _ in got], np.array([y for _, _, y, _ in got], bool), np.array([h for *_, h in got], int))
    yield pd.DataFrame({"model": [pickle.dumps(model)]})


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score, from 0 to 1, in column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in common.tidy(batches):
            yield pd.Series(shared.value.score(texts.tolist()), dtype="float64")

    return docs.withColumn(out, score(F.coalesce(F.col(text), F.lit(""))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    with common.small_batches(spark):  # the setting counts when rows are scored, hence within it
        out = common.stored(score_toxicity(docs, model).select("doc_id", "score"), "scores")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
