import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import ngram_join, shingles, topk, toxicity
from driftloom.llm.components import components

from .fixtures import WORD, docs, rows


def brute_sets(some):
    out = []
    for i, t in some:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(WORD, t or "")]
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute_classes(some):
    sets = brute_sets(some)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            u = sets[a][1] | sets[b][1]
            if u and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(u) and sets[a][1] and sets[b][1]:
                root[find(a)] = find(b)
    groups = {}
    for k in range(len(sets)):
        groups.setdefault(find(k), []).append(k)
    out = []
    for g in groups.values():
        ids = [sets[k][0] for k in g if sets[k][0] is not None]
        out += [(sets[k][0], len(sets[k][1]), min(ids, default=None)) for k in g]
    return out


def test_shingle_sets_of_whole_texts():
    texts = [r[1] for r in rows()] + ["A b C d E f", "a B c D e F", "a b c d", "a b c", "\u00a0 a\u00a0b", "x " * 9]
    got = shingles.shingle_sets(texts)
    want = brute_sets(enumerate(texts))
    assert [len(s) for s in got] == [len(s) for _, s in want]
    for a in range(len(texts)):
        for b in range(max(0, a - 12), a):
            assert len(np.intersect1d(got[a], got[b])) == len(want[a][1] & want[b][1])


def near(seed, n, words=60, edits=6):
    r = random.Random(seed)
    base = [f"w{r.randrange(4000)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(words)] = f"e{r.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize(("run", "block", "ids"), [(ngram_join.RUN, ngram_join.BLOCK, ngram_join.BROADCAST_IDS), (3, 7, -1)])
def test_classes(spark, monkeypatch, run, block, ids):
    monkeypatch.setattr(ngram_join, "RUN", run)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    some = [(r[0], r[1]) for r in rows()] + near(5, 40) + [(5000, "a b"), (4999, "A b"), (5001, "b a")]
    table = docs(spark, [(i, t, "", "", 0, "", "", "", "") for i, t in some])
    got = [tuple(r) for r in ngram_join.jaccard_classes(table).collect()]
    assert sorted(got, key=repr) == sorted(brute_classes(some), key=repr)


def test_a_long_chain_of_near_copies(spark, monkeypatch):
    """Neighbours in the chain link, those further apart don't: blocks and their first one do not connect it at once."""
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    r = random.Random(3)
    ws = [f"w{r.randrange(10**6)}" for _ in range(700)]
    chain = [(i, " ".join(ws[5 * i : 5 * i + 100])) for i in range(80) if i not in (30, 31, 32)]
    got = [tuple(x) for x in ngram_join.jaccard_classes(docs(spark, [(i, t, "", "", 0, "", "", "", "") for i, t in chain])).collect()]
    assert sorted(got) == sorted(brute_classes(chain)) and len({c for *_, c in got}) == 2


def test_links_with_and_without_a_split():
    r = random.Random(9)
    sets = [np.unique(s) for s in shingles.shingle_sets([t for _, t in near(3, 50, 40, 8)])]
    cells = np.zeros(1 << ngram_join.CELL_BITS, np.uint8)
    cells[[int(x) >> 40 for x in r.sample(np.concatenate(sets).tolist(), 60)]] = 5
    want = {(a, b) for a in range(50) for b in range(a + 1, 50) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert {tuple(p) for p in ngram_join.linked(sets, cells, 80).tolist()} == want
    assert {tuple(p) for p in ngram_join.linked(sets, cells, 80, 20).tolist()} == {p for p in want if p[0] < 20 <= p[1]}
    assert len(ngram_join.forest(np.array(sorted(want)), 50)) <= 49


def test_keep_one(spark):
    kept = ngram_join.keep_one(docs(spark)).collect()
    want = {c for _, n, c in brute_classes([(r[0], r[1]) for r in rows()]) if c is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(want)
    assert ngram_join.keep_one(docs(spark, [])).count() == 0


def test_keep_one_with_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    some = [(3, a), (7, a + " end"), (7, b), (9, b + " end"), (None, c), (None, c), (None, c + " end"), (11, a + " fin"), (None, a), (None, None), (None, ""), (5, None), (5, None)]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(spark, [(i, t, "", "", 0, "", "", "", "") for i, t in some])).collect()]
    rest = [k for k in kept if k[0] is None and k[1] and k[1].startswith("c")]
    assert len(rest) == 1 and rest[0][1] in (c, c + " end")
    assert sorted([k for k in kept if k not in rest], key=repr) == sorted([(3, a), (7, b), (None, None), (None, ""), (5, None)], key=repr)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in got} and {x for e in edges[:-2] for x in e if e[0] != e[1]} == set(got)


def brute_top(vectors, queries, k):
    out = set()
    ok = {i: [int(np.floor(256.0 * np.float64(np.float32(x)))) for x in v] for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in queries:
        if q in ok:
            best = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize(("n", "block"), [(3, 4096), (300, 64)])
def test_top_k(spark, monkeypatch, n, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(n)]
    vectors += [(1000 + i, vectors[i % 3][1]) for i in range(20)]  # ties
    vectors += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2050, [float("inf")] * 8), (2100, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string").repartition(3)
    got = {tuple(x) for x in topk.top_k(df, df.where(F.col("vec_id") % 50 == 0), 5).collect()}
    assert got == brute_top(vectors, [i for i, _ in vectors if i % 50 == 0], 5)


def test_top_k_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    r = np.random.default_rng(6)
    vectors = [(i, [float(np.float32(x)) for x in r.normal(size=4)]) for i in range(1, 60)]
    # 256 * x is beyond 32 bits, products beyond 2 ** 53, and terms beyond 64 bits that cancel out
    vectors += [(100, [2.0**23, 0.0, 1.0, 0.0]), (101, [0.0, -(2.0**27), 0.0, 1.0]), (102, [2.0**23, 1.0, 0.0, 0.0]), (103, [2.0**23, 0.99609375, 0.0, 0.0])]
    vectors += [(150, [1.0, 2.0, 2.0**40, 2.0**40]), (151, [0.0, 0.0, 2.0**8, -(2.0**8)]), (152, [3.0, 0.0, 2.0**20, -(2.0**20)])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    got = {tuple(x) for x in topk.top_k(df, df.where(F.col("vec_id") % 50 == 0), 5).collect()}
    assert got == brute_top(vectors, [50, 100, 150], 5)


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(none, none, 5).count() == 0


def test_toxicity_finds_what_it_learned():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    texts, toxic = [], []
    for i in range(800):
        ws = [r.choice(vocab) for _ in range(60)]
        if i % 8 == 0:
            for _ in range(3):
                ws[r.randrange(60)] = "grumf" + r.choice("abcdefg")
        texts.append(" ".join(ws))
        toxic.append(i % 8 == 0)
    model = toxicity.fit_rows(texts, np.array(toxic), np.arange(800) // 7 % 5)
    got = model.score([" ".join(["w1"] * 30 + ["grumfz", "grumfa"]), " ".join(["w1"] * 30), None, "", "word " * 50_000])
    assert got[0] >= 0.7 and (got[1:] < 0.3).all() and ((got >= 0) & (got <= 1)).all()


def test_isotonic_does_not_decrease():
    r = np.random.default_rng(0)
    raw, y = r.normal(size=300), r.random(300)
    knots, values = toxicity.isotonic(raw, (y < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(knots) >= 0).all() and (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1


def test_toxicity_tables(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 3)) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    table = docs(spark)
    model = toxicity.fit(table, labels)
    out = toxicity.score_toxicity(table, model).collect()
    assert len(out) == len(rows()) and all(0 <= r["score"] <= 1 for r in out)
    nothing = toxicity.fit(docs(spark, []), labels.where("false"))
    assert [r["score"] for r in toxicity.score_toxicity(table, nothing).select("score").distinct().collect()] == [0.0]


def test_held_out_accuracy(spark):
    """On the given tables: labels of the held-out third are found, clean documents left alone."""
    from pathlib import Path

    path = Path("/root/testdata/sf0.01")
    if not path.exists():
        pytest.skip("no tables")
    got = toxicity.op5_toxicity(spark, str(path)).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] for r in got if r["toxic"])
    assert hit >= 0.7 * sum(r["toxic"] for r in got) and sum(r["predicted"] for r in got if not r["toxic"]) <= 0.02 * len(got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 3)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == now.columns, name
        now = after
    assert now.count() and {r[0] for r in now.groupBy("sequence_id").agg(F.sum("length") <= 1024).select(F.col("(sum(length) <= 1024)")).distinct().collect()} == {True}


def test_pipeline_loses_no_document(spark, tmp_path):
    """``run`` against plain Python for scores, lines, classes and ids; mixing, with brute force of its own, is taken as it is."""
    from collections import Counter

    import corpus_pipeline
    from driftloom.llm import mixing
    from driftloom.llm.tokens import Encoder, tokenizer_path

    from .fixtures import DOCS
    from .test_filters import brute_with_short

    docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 9 == 3)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    score = toxicity.fit(table, labels.select("doc_id", "toxic")).score([r[1] for r in rows()])
    now = [r for r, s in zip(rows(), score, strict=True) if s < corpus_pipeline.THRESHOLD]
    gone = brute_with_short([r[:2] for r in now])
    now = [(r[0], None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[r[:2]]), *r[2:]) for r in now]
    stay = {c for _, _, c in brute_classes([r[:2] for r in now])}
    now = list({(r[0], r[1]): r for r in now if r[0] in stay}.values())
    want, enc = Counter(), Encoder(tokenizer_path())
    for r in mixing.mix(spark.createDataFrame(now, DOCS), labels.select("doc_id", "quality"), mixing.WEIGHTS).collect():
        want.update((r["doc_id"], t) for t in [*enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0])
    got = Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.update((r["doc_id"], t) for t in np.frombuffer(r["ids"], "<u4").tolist())
    assert got and got == want


def test_pipeline_of_nothing_and_of_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    labels = "doc_id long, quality int, toxic int"
    a, b = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    some = [(1, a, "en", "s", 0, "", "", "", ""), (5, a, "en", "s", 0, "", "", "", ""), (5, b, "en", "s", 0, "", "", "", ""), (None, None, None, None, None, "", "", "", "")]
    for name, table in (("none", []), ("few", some)):
        docs(spark, table).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(len(table))], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = ngram_join.keep_one(docs(spark, some)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["text"]) == [(1, a), (5, b)]
    got = corpus_pipeline.run(spark, f"{tmp_path}/few").collect()
    assert {r["doc_id"] for r in got} >= {1, 5}


def test_shallow_reads_are_enough_for_skewed_vectors(monkeypatch):
    r = np.random.default_rng(2)
    rows = np.rint(np.exp(r.normal(0, 3, (4096, 6)))).astype(float)
    queries = np.abs(r.normal(size=(20, 6)))
    depths, real = [], np.where
    monkeypatch.setattr(topk.np, "where", lambda c, *a: (depths.append(int(np.count_nonzero(c))), real(c, *a))[1] if a else real(c))
    alive = topk.survivors(queries, rows, np.zeros((4096, 20), bool), 5)
    monkeypatch.undo()
    score = rows @ queries.T
    for j in range(20):
        assert alive[np.argsort(-score[:, j], kind="stable")[:5], j].all()
    assert max(depths) < 4096 * 6 / 2  # no list was read to half of its length


def test_queries_are_sent_in_parts(spark, monkeypatch):
    monkeypatch.setattr(topk, "SENT", 1000)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(8)
    rows_ = [(i, r.normal(size=4).tolist()) for i in range(700)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(x) for x in topk.top_k(df, df.where(F.col("vec_id") % 50 == 0), 5).collect())
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows_}
    want = []
    for q in range(0, 700, 50):
        best = sorted((-int(v[q] @ v[i]), i) for i in v if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)


def brute_features(text, lex):
    """Features by plain loops over words and characters."""
    words = [w for w in (x.strip(toxicity.EDGE) for x in text.lower().split()) if w]
    n = max(1, len(words))
    fixed = [i for i, w in enumerate(words) if w in toxicity.INSULTS]
    own = {i: lex.words[w] for i, w in enumerate(words) if w in lex.words}
    begun = {i: lex.stems[w[:4]] for i, w in enumerate(words) if len(w) > 4 and w[:4] in lex.stems}
    you = [i for i, w in enumerate(words) if w in toxicity.YOU]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in {*fixed, *own, *begun})
    letter = lambda c: bool(re.match(r"[^\W\d_]", c))
    mixed = at = 0
    while at < len(text):
        a = at
        while a < len(text) and letter(text[a]):
            a += 1
        b = a
        while b < len(text) and text[b] in "0123456789@$*!+|":
            b += 1
        c = b
        while c < len(text) and letter(text[c]):
            c += 1
        hit = at < a < b < c
        mixed += hit
        at = c if hit else max(a, at + 1)
    triple = at = 0
    while at + 2 < len(text):
        hit = letter(text[at]) and text[at] == text[at + 1] == text[at + 2]
        triple += hit
        at += 3 if hit else 1
    raw, size = text.split(), max(1, len(text))
    return [
        math.log1p(len(words)), math.log1p(len(fixed)), len(fixed) / n, math.log1p(len(own)), sum(own.values()) / n, max(own.values(), default=0.0),
        math.log1p(len(begun)), sum(begun.values()) / n, max(begun.values(), default=0.0), near / n, len(you) / n, sum(c.isupper() for c in text) / size,
        sum(w.isupper() for w in raw) / n, sum(c in "!?" for c in text) / size, (text.count("!!") + text.count("?!") + text.count("??")) / n, mixed / n, triple / n,
    ]


def test_features_by_brute_force():
    r = random.Random(4)
    lex = toxicity.Lexicon({"abc": 1.5, "you": 0.5}, {"loud": 2.0})
    some = ["abc", "You", "LOUDER", "loser", "st00pid", "l0ser!", "aaab", "a1b2c", "x*y!z", "!!", "?!", "ça", "été9été", "", "\n", "Straße", "u", "9", "a_b", "---"]
    for text in ["", " ", *(r.choice(["", " "]).join(r.choice(some) for _ in range(r.randint(1, 30))) for _ in range(500)), *(t or "" for _, t, *_ in rows() if len(t or "") < 5000)]:
        assert np.allclose(toxicity.features(text, lex), brute_features(text, lex)), repr(text)


def test_isotonic_by_brute_force():
    r = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            raw, y = r.integers(0, max(2, n // 2), n).astype(float), r.integers(0, 2, n).astype(float)
            at = np.unique(raw)
            good, count = np.array([y[raw == x].sum() for x in at]), np.array([(raw == x).sum() for x in at])
            mean = lambda a, z: good[a : z + 1].sum() / count[a : z + 1].sum()
            fit = [max(min(mean(a, z) for z in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
            # a pool of equal fits is drawn in by half a case
            pools = [[j for j in range(len(at)) if abs(fit[j] - fit[i]) < 1e-12] for i in range(len(at))]
            want = np.maximum.accumulate([(good[p].sum() + 0.5 * y.mean()) / (count[p].sum() + 0.5) for p in pools])
            knots, values = toxicity.isotonic(raw, y)
            assert np.allclose(np.interp(at, knots, values), want)


def test_queries_run_and_equal_their_sql(spark):
    from pathlib import Path

    import duckdb

    from driftloom.llm import queries

    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, str(path))
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        columns = sorted(got.columns)
        rows_ = lambda found: sorted((tuple(repr(x) for x in r) for r in found))
        assert rows_(tuple(r[c] for c in columns) for r in got.collect()) == rows_(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), name


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_large_family_is_shuffled_once(spark, monkeypatch):
    """However many blocks a family has: copies for each block made the shuffle grow as the square of a family."""
    some = near(11, 300, 300, 8)
    table = docs(spark, [(i, t, "", "", 0, "", "", "", "") for i, t in some]).cache()
    table.count()
    took, got = [], []
    for block in (1000, 10):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        before = shuffled_bytes(spark)
        got.append(sorted(tuple(r) for r in ngram_join.jaccard_classes(table).collect()))
        took.append(shuffled_bytes(spark) - before)
    assert got[0] == got[1] == sorted(brute_classes(some))
    assert took[1] < 2 * took[0]


@pytest.mark.parametrize(("hubs", "tiny"), [(64, 8), (0, 0), (2, 10**6)])
@pytest.mark.parametrize("split", [None, 1, 45, 110])
def test_spanning_links_connect_what_all_links_connect(monkeypatch, hubs, tiny, split):
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    monkeypatch.setattr(ngram_join, "TINY", tiny)
    texts = [t for seed in (3, 4) for _, t in near(seed, 45, 70, 12)] + [t for _, t in near(5, 21, 8, 3)]
    random.Random(2).shuffle(texts)
    sets = shingles.shingle_sets(dict.fromkeys(texts))
    m = len(sets)
    cells = np.zeros(1 << ngram_join.CELL_BITS, np.uint8)
    share = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    links = {(a, b) for a in range(m) for b in range(a + 1, m) if share(a, b) and (split is None or a < split <= b)}
    found = ngram_join.spanning(sets, cells, 80, split)
    assert {(min(p), max(p)) for p in found} <= links
    want = ngram_join.forest(np.array(sorted(links), np.int64).reshape(-1, 2), m)
    assert len(found) == len(want) == len(ngram_join.forest(np.array(found + want, np.int64).reshape(-1, 2), m))


def test_toxicity_is_fitted_by_a_task(spark, monkeypatch):
    """The driver, whose memory other stages have filled, gets the model and no texts."""
    table = docs(spark, [(i, f"you idiot scum {i}" if i % 2 else f"a calm text {i}", "", "", 0, "", "", "", "") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "fit_rows", None)
    model = toxicity.fit(table, labels)
    assert model.trees is not None and model.score(["you idiot"])[0] > model.score(["a calm text"])[0]


def test_tables_go_when_nothing_reads_them(spark, tmp_path, monkeypatch):
    """What stages left in the shared folder added up to a disk's limit on large inputs."""
    from pathlib import Path

    from driftloom.llm import line_dedup, ngram_join

    monkeypatch.setattr("driftloom.sources.shared.shared_dir", lambda s: f"file://{tmp_path}")
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(i, f"{line}\n{line} number {i // 2}") for i in range(12)], "doc_id long, text string")

    def left() -> set[str]:
        return {p.name.rsplit("-", 1)[0] for p in Path(tmp_path).iterdir()}

    out = line_dedup.dedup_lines(docs, short_lines=True)
    assert left() == {"removed_lines"}
    assert sum(len(r["removed"]) for r in out.collect()) > 12
    out = ngram_join.keep_one(docs)
    assert left() == {"removed_lines", "gone", "repeated"}
    assert 0 < out.count() < 12


def test_wide_sets_have_no_second_parity(spark, monkeypatch):
    """A set that no narrow one can match is held against others by its four words alone; links at the border stay."""
    from driftloom.llm import common, line_dedup

    kept = {}
    real = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, *a, **k: kept.setdefault(name, real(df, name, *a, **k)) if name == "lines" else real(df, name, *a, **k))
    words = [f"w{i}" for i in range(400)]
    rows = []
    for n in (76, 80, 90, 95, 96, 118, 119, 120, 121, 149, 150, 151):
        rows.append((len(rows), " ".join(words[:n])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {r["doc"] for r in line_dedup.later_matches(docs, short_lines=True).collect()}
    sizes = [len(t.split()) for _, t in rows]
    assert removed == {i for i, n in enumerate(sizes) if any(100 * min(m, n) >= 80 * max(m, n) for m in sizes[:i])}
    parity = {r["n"]: r["parity"] for r in kept["lines"].collect()}
    assert all((parity[n] is None) == (n >= 120) for n in sizes)


class CountsTexts:
    """A model whose score is the number of texts that it gets at once, in millionths."""

    def score(self, texts):
        return np.full(len(texts), len(texts) / 1e6)


def test_texts_are_scored_in_small_batches(spark, tmp_path, monkeypatch):
    """10,000 whole texts at a time filled an executor's memory."""
    spark.range(0, 2500, 1, 1).selectExpr("id doc_id", "'some text' text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: CountsTexts())
    scores = [r["score"] for r in toxicity.op5_toxicity(spark, str(tmp_path)).collect()]
    assert len(scores) == 2500 and max(scores) <= 1000 / 1e6
