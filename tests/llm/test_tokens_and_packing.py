import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import packing, token_files
from driftloom.llm.tokens import Encoder, tokenizer_path

from .fixtures import docs, rows


@pytest.fixture(scope="module")
def enc():
    return Encoder(tokenizer_path())


def whole(enc, text):
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_parts_give_the_ids_of_whole_texts(enc):
    r = random.Random(3)
    some = ["a", "Bc", " ", "  ", "\n", "\t", "1", ".", "'s", "é", "\u00a0", "<|endoftext|>", " \n", "\x00", "\u3000", "x y", "\x1c", "word" * 80]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(2000)] + [None, ""]
    for t, ids in zip(texts, enc.encode_batch(texts), strict=True):
        assert ids.tolist() == whole(enc, t), repr(t)


def test_full_memory_starts_anew(enc, monkeypatch):
    monkeypatch.setattr("driftloom.llm.tokens.MOST", 5)
    own = Encoder(tokenizer_path())
    texts = [f"word{i} other{i} third" for i in range(40)]
    for t in texts:
        assert own.encode_batch([t])[0].tolist() == whole(own, t)


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [0, 1, 2, 3], [7, 7, 1 << 40], list(range(0, 30000, 7))])
def test_elias_fano(values):
    ef, end = token_files.EliasFano.from_bytes(token_files.EliasFano.of(np.array(values)).to_bytes())
    assert [x for v in ef.decoded() for x in v] == values
    assert [ef.select(i) for i in range(0, len(values), max(1, len(values) // 50))] == values[:: max(1, len(values) // 50)]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert len(token_files.EliasFano.of(ends).to_bytes()) < 10_000 * 13 / 8 + 100


def test_shard_round_trip(tmp_path):
    uri = f"file://{tmp_path}/x/a.tok"
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (3, 1, 0, 5)]
    token_files.write_shard(uri, np.array([-5, 2, 2]), 1, np.array([3, 1, 0, 5]), ids, 2, 2)
    got = [(bool(n), int(i), int(s), t.tolist()) for a, b, c, d in token_files.read_shard(uri, 8) for n, i, s, t in zip(a, b, c, d, strict=True)]
    assert got == [(True, 0, 0, [0, 1, 2]), (False, -5, 3, [0]), (False, 2, 4, []), (False, 2, 4, [0, 1, 2, 3, 4])]


def test_shards_are_read_by_select(tmp_path, monkeypatch):
    r = np.random.default_rng(5)
    sizes = r.integers(0, 40, 3000)
    texts = [r.integers(0, 60000, n).astype("<u2") for n in sizes]
    uri, names = f"file://{tmp_path}/a.tok", np.sort(r.integers(-(2**62), 2**62, 2993))
    token_files.write_shard(uri, names, 7, sizes, [t.tobytes() for t in texts], 2, 2)
    monkeypatch.setattr(token_files.EliasFano, "decoded", None)  # no whole tables
    for block, most in ((100, 1 << 16), (4 << 20, 1 << 16), (4 << 20, 700)):
        monkeypatch.setattr(token_files, "MOST_DOCS", most)
        got = [x for a, b, c, d in token_files.read_shard(uri, block) for x in zip(a.tolist(), b.tolist(), c.tolist(), [t.tolist() for t in d], strict=True)]
        starts = (np.cumsum(sizes) - sizes).tolist()
        assert got == list(zip([True] * 7 + [False] * 2993, [0] * 7 + names.tolist(), starts, [t.tolist() for t in texts], strict=True))
    for i in (0, 6, 7, 511, 512, 513, 2999):
        assert token_files.read_document(uri, i).tolist() == texts[i].tolist()
    with pytest.raises(IndexError):
        token_files.read_document(uri, 3000)


def test_token_files(spark, enc, tmp_path):
    manifest = spark.createDataFrame(token_files.write_tokens(docs(spark), f"file://{tmp_path}/t").collect())
    got = token_files.read_tokens(manifest).withColumn("c", F.crc32("ids")).collect()
    want = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for g, w in zip(sorted(got, key=lambda g: g["start"]), want, strict=True):
        ids = np.array([*whole(enc, w[1]), 2], "<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["c"]) == (w[0], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing_uses_every_id_once(spark, enc):
    pieces = packing.pack(docs(spark), window=256, shard=16).collect()
    seen, sequences = {}, {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        seen.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert sum(sum(n for _, n in s) < 256 for s in sequences.values()) <= 8
    want = {}
    for i, text, *_ in rows():
        ids = [*whole(enc, text), 0]
        want.setdefault((i, len(ids)), []).append(ids)
    assert {k: sorted(x for ids in v for x in ids) for k, v in want.items()} == {k: sorted(x for _, ids in v for x in ids) for k, v in seen.items()}
    for key, all_ids in want.items():
        if len(all_ids) == 1:
            assert [x for _, ids in sorted(seen[key]) for x in ids] == all_ids[0]


def test_neighbours_come_by_score():
    docs_ = [np.array(x) for x in ([1, 2, 3, 4, 5, 6], [7, 8, 9], [1, 2, 3], [7, 8])]
    first = packing.pack_shard(docs_, np.ones(10), 9)[0]
    assert first == [(0, 0, 6), (2, 0, 3)]
    index = packing.Index(docs_, np.arange(10.0))
    brute = [sum(t * d.tolist().count(t) * 2.2 / (d.tolist().count(t) + 1.2 * (0.25 + 0.75 * len(d) / 3.5)) for t in {1, 7}) for d in docs_]
    assert np.allclose(index.scores(np.array([1, 7, 7])), brute)


def test_empty(spark, tmp_path):
    none = docs(spark, [])
    assert packing.pack(none).count() == 0
    assert token_files.write_tokens(none, f"file://{tmp_path}/none").count() == 0


def test_scores_of_a_block_are_exact(monkeypatch):
    r = np.random.default_rng(2)
    docs_ = [r.zipf(1.3, r.integers(1, 60)) % 50 for _ in range(40)]
    queries, idf = docs_[::3], r.random(50) * 9
    size = np.array([len(d) for d in docs_])
    posting = packing.impacts(np.concatenate(docs_), np.repeat(np.arange(40), size), size, size.mean(), idf)
    asks = np.unique(np.concatenate([np.unique(q) * 100 + i for i, q in enumerate(queries)]))
    want = [[sum(np.rint(64 * idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / size.mean()))) for t in set(q.tolist()) & set(d.tolist())) for d in docs_] for q in queries]
    for dense, pairs in ((1024, 1 << 21), (3, 7), (0, 1)):
        monkeypatch.setattr(packing, "DENSE", dense)
        monkeypatch.setattr(packing, "PAIRS", pairs)
        assert packing.score_all(asks // 100, asks % 100, len(queries), *posting, 40).tolist() == want


@pytest.mark.parametrize(("seeds", "most"), [(2048, 64), (3, 1)])
def test_neighbours_are_found_in_the_whole_corpus(spark, enc, monkeypatch, seeds, most):
    monkeypatch.setattr(packing, "SEEDS", seeds)
    monkeypatch.setattr(packing, "LIST", most)
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(900)]
    some = []
    for pair in range(30):  # a long and a short text of the same 25 words, and a word of higher idf each
        own = vocab[25 * pair : 25 * pair + 25]
        some += [(pair, " ".join([*own, *own, *own, f"only{pair} " * 9])), (100 + pair, " ".join([*own, f"other{pair} " * 9]))]
    r.shuffle(some)
    docs_ = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    with_all = packing.pack(docs_, window=512, shard=4).collect()
    at = {}
    for p in with_all:
        at.setdefault(p["doc_id"], []).append((p["offset"], p["sequence_id"]))
    seed_of = {min(at[i])[1]: i for i in range(30) if min(at[i])[0] == 0}
    used_first = {s: min((p["offset"], p["doc_id"]) for p in with_all if p["sequence_id"] == s and p["offset"] > 0)[1] for s in seed_of}
    assert len(seed_of) > 10 and all(used_first[s] == 100 + i for s, i in seed_of.items())
    assert sum(n < 512 for n in [sum(p["length"] for p in with_all if p["sequence_id"] == s) for s in {p["sequence_id"] for p in with_all}]) <= 1


def test_many_rows_of_one_id_are_split(spark, enc, tmp_path):
    some = [(None, f"text {i} of no id", "en", "s", 0, "", "", "", "") for i in range(300)] + [(5, f"text {i} of one id", "en", "s", 0, "", "", "", "") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        manifest = spark.createDataFrame(token_files.write_tokens(docs(spark, some), f"file://{tmp_path}/t").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert manifest.agg(F.max("n_docs")).first()[0] < 300
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 300 + [5] * 300
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in got) == sorted([*whole(enc, t), 2] for _, t, *_ in some)


def test_lists_keep_the_best(monkeypatch):
    r = np.random.default_rng(7)
    monkeypatch.setattr(packing, "WIDE", 4)
    for _ in range(20):
        n_q, most, base, best = 9, 6, 0, None
        seeds, whole = np.sort(r.integers(0, 500, n_q)), []
        for n in (3, 50, 80, 1, 60, 70):
            score = r.integers(0, 12, (n_q, n)).astype(np.float32) * (r.random((n_q, 1)) < 0.8)
            best = packing.bettered(best, score, seeds, base + np.arange(n), most)
            whole.append(score)
            base += n
        score = np.concatenate(whole, 1)
        for q in range(n_q):
            want = sorted(range(base), key=lambda i: (-score[q, i], (i - seeds[q]) % (1 << 32)))[:most]
            got = (seeds[q] + (packing.REST - (-np.sort(-best[q]) & packing.REST))) & packing.REST
            assert got.tolist() == want


def test_asking_needs_no_encoder_and_betters_lists_bit_by_bit(monkeypatch):
    """Workers live on: what they remember of the texts, and keys of all seeds at once, filled an executor's memory."""
    from types import SimpleNamespace

    import pandas as pd

    from driftloom.llm import packing, tokens

    r = np.random.default_rng(4)
    blocks, base = [], {}
    for b in range(3):
        term, owner = np.divmod(np.unique(r.integers(0, 50 * 40, 600)), 40)
        blocks.append({"block": b, "terms": term.astype("<u2").tobytes(), "owners": owner.astype("<u2").tobytes(), "impacts": r.integers(1, 90, len(term)).astype("<u2").tobytes()})
        base[b] = 40 * b
    q_term, q_owner = np.divmod(np.unique(r.integers(0, 50 * 20, 300)), 20)
    live = {b: np.packbits(r.random(40) < 0.8) for b in range(3)}
    state = SimpleNamespace(value={"seeds": np.arange(0, 100, 5), "most": 16, "width": 2, "term": q_term, "owner": q_owner, "live": live, "base": base, "sizes": dict.fromkeys(range(3), 40)})
    found = []
    for together in (1000, 3):
        monkeypatch.setattr(packing, "TOGETHER", together, raising=False)
        tokens.encoder(tokens.tokenizer_path())
        (out,) = list(packing._ask(state)(iter([pd.DataFrame(blocks)])))
        assert not tokens._encoders
        found.append(np.sort(np.frombuffer(out["keys"].iloc[0], np.int64).reshape(-1, out["k"].iloc[0]), axis=1))
    assert found[0].shape == (20, 16) and (found[0] == found[1]).all()


def test_no_block_of_remainders_passes_through_spark(spark, enc, monkeypatch):
    """Rows of megabytes, read in every round, filled the executors' heaps."""
    from pyspark.sql import functions as F

    from driftloom.llm import common, packing

    stored, real = {}, common.stored

    def kept(df, name, *a, **k):
        stored[name] = real(df, name, *a, **k)
        return stored[name]

    monkeypatch.setattr(common, "stored", kept)
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(200))) for i in range(64)], "doc_id long, text string")
    pieces = packing.pack(docs, window=1024, shard=32).collect()
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in enc.encode_batch([r["text"] for r in docs.collect()]))
    for name, df in stored.items():
        binary = [c for c, kind in df.dtypes if kind == "binary"]
        if name != "encoded" and binary:
            assert df.select(F.max(F.greatest(F.lit(0), *[F.length(c) for c in binary]))).first()[0] <= 4 * 32


def test_the_driver_keeps_no_vocabulary_and_no_round(spark, enc, monkeypatch):
    """Its encoder, each round's broadcast and all pieces as tuples filled the driver's memory."""
    import os

    from pyspark import SparkContext

    from driftloom.llm import packing, tokens

    rounds, real = [], SparkContext.broadcast

    def kept(self, value):
        out = real(self, value)
        if isinstance(value, dict) and "seeds" in value:
            rounds.append((out._path, value))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", kept)
    monkeypatch.setattr(packing, "SEEDS", 8)
    monkeypatch.setattr(packing, "REFRESH", 2, raising=False)
    monkeypatch.setattr(packing, "HELD", 20)
    tokens.release_encoders()
    docs_ = spark.createDataFrame([(i, " ".join(f"word{(i * 7 + j) % 50}" for j in range(100))) for i in range(64)], "doc_id long, text string")
    pieces = packing.pack(docs_, window=1024, shard=32).collect()
    assert not tokens._encoders
    assert sum(p["length"] for p in pieces) == sum(len(x) + 1 for x in enc.encode_batch([r["text"] for r in docs_.collect()]))
    assert len(rounds) > 1 and not any(os.path.exists(path) for path, _ in rounds)
    assert all(value[c].dtype.itemsize <= 2 for _, value in rounds for c in ("term", "owner"))


def test_blocks_are_written_without_an_encoder(spark, enc, tmp_path):
    """Workers that write blocks have encoded before, and held their encoders beside them."""
    from types import SimpleNamespace

    import pandas as pd
    import pyspark

    from driftloom.llm import packing, tokens

    tokens.encoder(tokens.tokenizer_path())
    rows = pd.DataFrame({"doc_id": [1, 2], "start": 0, "doc_tokens": 3, "n": 3, "ids": [np.array(x, "<u2").tobytes() for x in ([1, 2, 0], [2, 2, 0])]})
    make = packing._blocks(f"file://{tmp_path}", 2, SimpleNamespace(value=np.ones(3)), 3.0, 2)
    before, pyspark.TaskContext._taskContext = pyspark.TaskContext._taskContext, SimpleNamespace(partitionId=lambda: 0)
    try:
        (out,) = list(make(iter([rows])))
    finally:
        pyspark.TaskContext._taskContext = before
    assert out["block"].tolist() == [0] and not tokens._encoders


def test_blocks_hold_texts_of_one_cluster(spark, enc, monkeypatch):
    """Matrices of a block had the frequent tokens of all languages: now texts of one lie together, and its seeds are scored apart."""
    from driftloom.llm import packing

    r = random.Random(5)
    vocab = [["".join(r.choice(letters) for _ in range(5)) for _ in range(60)] for letters in ("abcdefgh", "qrstuvwxyz")]
    texts = [" ".join(r.choice(vocab[i % 2]) for _ in range(60 + i)) for i in range(64)]
    docs_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    scored, real, monkeypatched = [], packing._blocks, monkeypatch.setattr

    def kept(folder, shard, idf, mean, width):
        scored.append((folder, width))
        return real(folder, shard, idf, mean, width)

    monkeypatched(packing, "_blocks", kept)
    monkeypatched(packing, "CLUSTERS", 2)
    pieces = packing.pack(docs_, window=4096, shard=8)
    assert {r_["doc_id"] for r_ in pieces.select("doc_id").collect()} == set(range(64))
    import glob

    folder, width = scored[0]
    mixed, n = 0, 0
    for path in glob.glob(folder.removeprefix("file:").replace("//", "/") + "/*.docs"):
        docs_of = np.frombuffer(packing._read(f"file://{path}")[2], "<i8")
        mixed, n = mixed + (len(set((docs_of % 2).tolist())) > 1), n + 1
    assert n >= 8 and mixed <= 1


def test_groups_of_seeds_change_no_list(monkeypatch):
    from types import SimpleNamespace

    import pandas as pd

    from driftloom.llm import packing

    r = np.random.default_rng(6)
    blocks, base = [], {}
    for b in range(4):
        term, owner = np.divmod(np.unique(r.integers(0, 50 * 40, 600)), 40)
        blocks.append({"block": b, "terms": term.astype("<u2").tobytes(), "owners": owner.astype("<u2").tobytes(), "impacts": r.integers(1, 90, len(term)).astype("<u2").tobytes()})
        base[b] = 40 * b
    q_term, q_owner = np.divmod(np.unique(r.integers(0, 50 * 20, 300)), 20)
    live = {b: np.packbits(r.random(40) < 0.8) for b in range(4)}
    state = {"seeds": np.arange(0, 100, 5), "most": 16, "width": 2, "term": q_term, "owner": q_owner, "live": live, "base": base, "sizes": dict.fromkeys(range(4), 40)}
    sizes, real = [], packing.score_all
    monkeypatch.setattr(packing, "score_all", lambda *a: sizes.append(a[2]) or real(*a))
    found = []
    for cuts in ([0, 20], [0, 3, 4, 11, 20]):
        order = np.lexsort((q_term, np.searchsorted(cuts, q_owner, side="right")))
        by_group = [(a, b, int((q_owner < a).sum()), int((q_owner < b).sum())) for a, b in zip(cuts, cuts[1:], strict=False)]
        (out,) = list(packing._ask(SimpleNamespace(value=state | {"term": q_term[order], "owner": q_owner[order], "groups": by_group}))(iter([pd.DataFrame(blocks)])))
        found.append(np.sort(np.frombuffer(out["keys"].iloc[0], np.int64).reshape(20, -1), axis=1))
    assert found[0].shape == (20, 16) and (found[0] == found[1]).all()
    assert sizes[:4] == [20] * 4 and sizes[4:] == [3, 1, 7, 9] * 4
