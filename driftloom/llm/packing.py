"""Packing: documents into sequences of at most ``WINDOW`` tokens, by lexical retrieval.

1. Each document is encoded once and an end id added.  Windows that it fills alone are
   sequences of their own; what is left of it, under a window, is its remainder.  The
   ids go to the shared folder, with each task's counts of documents for each token.
2. Document frequencies of the whole corpus (a row for each token id at most) give BM25's
   idf.  Remainders are numbered by cluster and from the longest on, and stored in blocks of
   ``SHARD``, each with its inverted index: files in the shared folder that workers write and
   read themselves, since rows of megabytes, read in every round, fill an executor's heap.
   Clusters (k-means on some ``FITTED`` remainders) only say what lies together: texts of one
   language have fewer frequent tokens than all, so matrices are smaller; every block still
   scores every seed.
3. Packing goes in rounds.  A round's seeds are the longest unused remainders, all tokens
   of a seed are its query, and every block scores every seed, so that a seed's list holds
   the best unused remainders of the whole corpus.  Then seeds are served in order: unused
   neighbours fill the window in order of score, the last one being cut to fit; what is cut
   off stays.  A seed that was cut meanwhile, or whose list others have used up before its
   window was full, waits for the next round.  So at most one sequence of all is not full.

A score is a sum of BM25 impacts in whole 64ths, hence exact in any order; ties go to the
next number after the seed's.  Scoring grows as the number of remainders squared.

Defined results: a null or empty text is a document of the end id alone; repeated rows
are documents of their own; every id lies in exactly one piece; an empty table gives no
pieces.  Sequence ids are unique, not gapless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, release_encoders, tokenizer_path

WINDOW, SHARD = 1024, 2048
K1, B = 1.2, 0.75
#: A round has at most ``SEEDS`` seeds, their lists ``LIST`` entries at first and ``ASKED`` in all; longer lists mean fewer seeds.
SEEDS, LIST, ASKED = 2048, 64, 1 << 17
SLICE, HELD, DENSE, PAIRS = 128, 1 << 17, 4096, 1 << 20
#: After so many rounds the driver gives back what they took: plans and results of finished jobs.
REFRESH = 8
#: Tokens that one pair of ``SPARSE`` shares are scored by a matrix product: a hundred times faster than pair by pair.
SPARSE = 1024
#: Remainders of a block that come into most lists at the same time.
WIDE = 128
#: Seeds whose lists are bettered together, so that what this takes stays small.
TOGETHER = 256
REST = (1 << 32) - 1
#: Clusters, remainders that they are learned from, about, and the smallest number of seeds scored as a group of their own.
CLUSTERS, FITTED, GROUP = 6, 2048, 128
#: Blocks of a task that asks, at most.
BLOCKS = 16
#: kind 0: a full window, 1: a remainder, 2: documents (n) that hold a token (start), 3: bytes of an id (n)
ENCODED = "kind int, doc_id long, start long, doc_tokens long, sequence_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _encode(path: str, end_id: int, window: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype)
        holds = np.zeros(max(enc.tokenizer.get_vocab_size(), end_id + 1), np.int64)
        n_docs, sequence = 0, (1 << 62) | (TaskContext.get().partitionId() << 32)
        for pdf in common.slices(batches):
            rows = []
            for doc, ids in zip(pdf["doc_id"].astype("Int64"), enc.encode_batch(pdf["text"].tolist()), strict=True):
                ids = np.concatenate([ids, end])
                holds[np.unique(ids)] += 1
                n_docs += 1
                full = len(ids) // window * window
                for a in range(0, full, window):
                    rows.append((0, doc, a, len(ids), sequence, window, ids[a : a + window].tobytes()))
                    sequence += 1
                if full < len(ids):
                    rows.append((1, doc, full, len(ids), None, len(ids) - full, ids[full:].tobytes()))
            yield frame(rows)
        at = np.flatnonzero(holds)
        if len(at):
            yield frame([(2, None, int(t), None, None, int(holds[t]), None) for t in at] + [(2, None, -1, None, None, n_docs, None), (3, None, None, None, None, enc.dtype.itemsize, None)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        kinds = (None, "Int64", "Int64", "Int64", "Int64", None, None)
        names = ("kind", "doc_id", "start", "doc_tokens", "sequence_id", "n", "ids")
        # 64-bit ids beside nulls must not pass through floating point
        return pd.DataFrame({name: pd.array(c, dtype=kind) if kind else list(c) for name, kind, c in zip(names, kinds, cols, strict=True)})

    return make


class Index:
    """A BM25 inverted index over token arrays."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, k1: float = K1, b: float = B):
        self.n = len(docs)
        sizes = np.array([len(d) for d in docs], float)
        owner = np.repeat(np.arange(self.n), sizes.astype(int))
        term = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        key, tf = np.unique(term * self.n + owner, return_counts=True)
        self.term, self.doc = np.divmod(key, max(1, self.n))
        norm = k1 * (1 - b + b * sizes / max(1.0, sizes.mean() if self.n else 1.0))
        self.impact = idf[self.term] * tf * (k1 + 1) / (tf + norm[self.doc])
        self.terms, self.first = np.unique(self.term, return_index=True)
        self.last = np.append(self.first[1:], len(key))

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Every document's score for the distinct terms of a query."""
        at = np.searchsorted(self.terms, np.unique(query).astype(np.int64))
        first, size = self.first[at], self.last[at] - self.first[at]
        upto = np.cumsum(size)
        where = np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
        return np.bincount(self.doc[where], weights=self.impact[where], minlength=self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, first token, number of tokens); all tokens are used once."""
    index = Index(docs, idf)
    size = np.array([len(d) for d in docs])
    begin = np.zeros(len(docs), np.int64)  # what was cut off before
    out = []
    while (left := size - begin).any():
        seed = int(left.argmax())
        room = window - int(left[seed])
        pieces = [(seed, int(begin[seed]), int(left[seed]))]
        begin[seed] = size[seed]
        if room:
            score = index.scores(docs[seed])
            for d in np.lexsort((np.arange(len(docs)), -score)):
                if (n := int(min(size[d] - begin[d], room))) > 0:
                    pieces.append((int(d), int(begin[d]), n))
                    begin[d] += n
                    room -= n
                    if not room:
                        break
        out.append(pieces)
    return out


def _blocks(folder: str, shard: int, idf, mean: float, width: int):
    """Remainders in the order of their rows, as two files and one row for each ``shard`` of them: their ids, and their index (token, remainder and impact)."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        release_encoders()
        block, held = TaskContext.get().partitionId() << 32, []
        for pdf in batches:
            held += list(pdf.astype({"doc_id": "Int64"}).itertuples(index=False))
            while len(held) >= shard:
                yield row(held[:shard], block)
                block, held = block + 1, held[shard:]
        if held:
            yield row(held, block)

    def row(rows: list, block: int) -> pd.DataFrame:
        null = np.array([r.doc_id is pd.NA for r in rows])
        known = np.array([0 if r.doc_id is pd.NA else r.doc_id for r in rows], "<i8")
        place = np.array([(r.start, r.doc_tokens) for r in rows], "<i8")
        sizes, ids = np.array([r.n for r in rows], "<i4"), b"".join(r.ids for r in rows)
        term, owner, impact = impacts(np.frombuffer(ids, f"<u{width}"), np.repeat(np.arange(len(rows)), sizes), sizes, mean, idf.value)
        # whole 64ths of an impact stay far below 2**16: at most 64 * 2.2 * idf
        index = (term.astype(f"<u{width}"), owner.astype("<u4" if shard > 1 << 16 else "<u2"), impact.astype("<u2"))
        _write(f"{folder}/{block}.index", [x.tobytes() for x in index])
        _write(f"{folder}/{block}.docs", [sizes.tobytes(), null.tobytes(), known.tobytes(), place.tobytes(), ids])
        return pd.DataFrame({"block": [block], "sizes": [sizes.tobytes()]})

    return make


def _write(uri: str, parts: list[bytes]) -> None:
    """A file of byte strings: their number, their sizes, and themselves."""
    files, path = common.file_system(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{np.random.default_rng().integers(1 << 62):x}"
    with files.open_output_stream(own) as out:
        out.write(np.array([len(parts), *map(len, parts)], "<i8").tobytes())
        for part in parts:
            out.write(part)
    files.move(own, path)


def _read(uri: str) -> list[bytes]:
    files, path = common.file_system(uri)
    with files.open_input_stream(path) as src:
        n = int(np.frombuffer(src.read(8), "<i8")[0])
        return [src.read(size) for size in np.frombuffer(src.read(8 * n), "<i8").tolist()]


def _opened(folder: str, kind: str, of_rows):
    """Batches of rows to frames of one row each, which has the block (named by ``of_rows``) as well."""
    columns = {"index": ("terms", "owners", "impacts"), "docs": ("sizes", "null", "docs", "place", "ids")}[kind]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                block = of_rows(row)
                yield pd.DataFrame([row | {"block": block} | dict(zip(columns, _read(f"{folder}/{block}.{kind}"), strict=True))])

    return make


def impacts(term: np.ndarray, owner: np.ndarray, sizes: np.ndarray, mean: float, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (token, owner), sorted, and each one's BM25 impact in whole 64ths."""
    n = max(1, len(sizes))
    key, tf = np.unique(term.astype(np.int64) * n + owner, return_counts=True)
    term, owner = np.divmod(key, n)
    norm = K1 * (1 - B + B * sizes / max(1.0, mean))
    return term, owner, np.rint(64 * idf[term] * tf * (K1 + 1) / (tf + norm[owner]))


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges ``first .. first + size`` one after another."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def groups(term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, where each begins and how often it stands there."""
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    return term[first], first, np.diff(np.append(first, len(term)))


def score_all(q_term: np.ndarray, q_owner: np.ndarray, n_q: int, term: np.ndarray, owner: np.ndarray, impact: np.ndarray, n: int) -> np.ndarray:
    """Scores of all queries (distinct tokens) against all of a block's remainders; both are sorted by token."""
    terms, first, count = groups(term)
    q_terms, q_first, q_count = groups(q_term)
    both, at, q_at = np.intersect1d(terms, q_terms, assume_unique=True, return_indices=True)
    # tokens of many pairs as a matrix product (whole numbers below 2**24: exact), the others pair by pair
    pairs = count[at] * q_count[q_at]
    dense = np.argsort(-pairs, kind="stable")[:DENSE]
    dense = dense[pairs[dense] * SPARSE > n * n_q]
    rare = np.setdiff1d(np.arange(len(both)), dense)
    left, right = np.zeros((n_q, len(dense)), np.float32), np.zeros((len(dense), n), np.float32)
    where = _spans(q_first[q_at[dense]], q_count[q_at[dense]])
    left[q_owner[where], np.repeat(np.arange(len(dense)), q_count[q_at[dense]])] = 1
    where = _spans(first[at[dense]], count[at[dense]])
    right[np.repeat(np.arange(len(dense)), count[at[dense]]), owner[where]] = impact[where]
    score = (left @ right).ravel()
    upto = np.cumsum(pairs[rare])
    cut = 0
    while cut < len(rare):  # some pairs at a time
        to = max(cut + 1, int(np.searchsorted(upto, (upto[cut - 1] if cut else 0) + PAIRS, side="right")))
        some, cut = rare[cut:to], to
        c, qc = count[at[some]], q_count[q_at[some]]
        posting = _spans(first[at[some]], c)
        each = np.repeat(qc, c)  # a posting meets all queries of its token
        asks = _spans(np.repeat(q_first[q_at[some]], c), each)
        np.add.at(score, q_owner[asks] * n + np.repeat(owner[posting], each), np.repeat(impact[posting], each).astype(np.float32))
    return score.reshape(n_q, n)


def best_keys(keys: np.ndarray, most: int) -> np.ndarray:
    return keys if keys.shape[1] <= most else np.partition(keys, keys.shape[1] - most, axis=1)[:, -most:]


def bettered(best: np.ndarray | None, score: np.ndarray, seeds: np.ndarray, number: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` best keys (score, then place after the seed) of each seed among those held and a block's remainders."""

    def keys(q: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (score[q, i].astype(np.int64) << 32) | (REST - ((number[i] - seeds[q]) & REST))

    n_q, n = score.shape
    least, fits = None, WIDE
    if best is None and n > most:
        least, fits = np.partition(score, n - most, axis=1)[:, n - most], max(WIDE, 2 * most)
    elif best is not None and best.shape[1] == most:
        least = (best.min(1) >> 32).astype(np.float32)
    if least is not None:
        # what can come in: few of a block, once the lists have filled
        q, i = np.divmod(np.flatnonzero(score >= least[:, None]), n)
        size = np.bincount(q, minlength=n_q)
        if len(q) < n_q * n // 8:
            first, found = np.cumsum(size) - size, keys(q, i)
            best = np.zeros((n_q, 0), np.int64) if best is None else best
            wide = size > fits  # seeds that hardly any remainder resembles
            some = ~wide[q]
            more = np.full((n_q, fits), -1, np.int64)
            more[q[some], (np.arange(len(q)) - np.repeat(first, size))[some]] = found[some]
            out = best_keys(np.concatenate([best, more], 1), most)
            for r in np.flatnonzero(wide).tolist():
                out[r] = best_keys(np.concatenate([best[r], found[first[r] : first[r] + size[r]]])[None], most)[0]
            return out
    every = best_keys(keys(np.arange(n_q)[:, None], np.arange(n)[None, :]), most)
    return every if best is None else best_keys(np.concatenate([best, every], 1), most)


def cluster_weights(docs: list[np.ndarray], idf: np.ndarray, n: int = CLUSTERS, rounds: int = 10) -> np.ndarray:
    """Each token's weight in each of ``n`` clusters of texts: spherical k-means on the tokens that are not rare."""
    weights = np.zeros((len(idf), n), np.float32)
    if not docs:
        return weights
    # the longer half: short texts resemble nothing and would be clusters of their own
    middle = np.median([len(d) for d in docs])
    docs = [d for d in docs if len(d) >= middle]
    key = np.unique(np.concatenate(docs).astype(np.int64) * len(docs) + np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
    term, owner = np.divmod(key, len(docs))
    terms, _, count = groups(term)
    terms = terms[count * 50 >= len(docs)]
    own = np.isin(term, terms)
    at = np.searchsorted(terms, term[own])
    x = np.zeros((len(docs), len(terms)), np.float32)
    x[owner[own], at] = idf[terms[at]]
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1))[:, None]
    centre = x[:1]
    near = x @ centre[0]
    for _ in range(n - 1):
        centre = np.concatenate([centre, x[near.argmin()][None]])
        near = np.maximum(near, x @ centre[-1])
    for _ in range(rounds):
        of = (x @ centre.T).argmax(1)
        centre = np.stack([x[of == k].sum(0) if (of == k).any() else centre[k] for k in range(n)])
        centre /= np.maximum(1e-9, np.linalg.norm(centre, axis=1))[:, None]
    weights[terms] = centre.T * idf[terms][:, None]
    return weights


def cluster_of(docs: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The cluster of each token array; none is empty."""
    if not docs:
        return np.zeros(0, np.int32)
    first = np.cumsum([0, *[len(d) for d in docs[:-1]]])
    return np.add.reduceat(weights[np.concatenate(docs)], first, axis=0).argmax(1).astype(np.int32)


def _clustered(weights, width: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_encoders()
        for pdf in common.slices(batches):
            yield pdf.assign(doc_id=pdf["doc_id"].astype("Int64"), cluster=cluster_of([np.frombuffer(x, f"<u{width}") for x in pdf["ids"]], weights.value))

    return make


def seed_groups(cluster: np.ndarray) -> list[np.ndarray]:
    """Places of the seeds that are scored together: those of a cluster, small clusters as one."""
    parts = [np.flatnonzero(cluster == c) for c in np.unique(cluster)]
    large, small = [p for p in parts if len(p) >= GROUP], [p for p in parts if len(p) < GROUP]
    return large + ([np.sort(np.concatenate(small))] if small else [])


def _ask(state):
    """A task's best remainders for each seed: keys of score and place after the seed."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_encoders()
        s = state.value
        seeds, most, width, best = s["seeds"], s["most"], s["width"], None
        q_term, q_owner = s["term"].astype(np.int64), s["owner"].astype(np.int64)
        # a group: its seeds and their tokens, each lying together
        asks = [(range(a, b), q_term[c:d], q_owner[c:d] - a) for a, b, c, d in s.get("groups", [(0, len(seeds), 0, len(q_term))])]
        for pdf in batches:
            for row in pdf.itertuples():
                impact = np.frombuffer(row.impacts, "<u2")
                owner = np.frombuffer(row.owners, f"<u{len(row.owners) // max(1, len(impact))}")
                live = np.unpackbits(s["live"][row.block], count=s["sizes"][row.block]).astype(bool)
                if not live.any():
                    continue
                own = live[owner]
                at = np.cumsum(live) - 1
                term = np.frombuffer(row.terms, f"<u{width}")[own].astype(np.int64)
                owner, impact = at[owner[own]], impact[own].astype(np.float32)
                number = s["base"][row.block] + np.flatnonzero(live)
                found = []
                for rows, a_term, a_owner in asks:
                    score = score_all(a_term, a_owner, len(rows), term, owner, impact, len(number))
                    for a in range(0, len(rows), TOGETHER):
                        some = slice(rows.start + a, min(rows.start + a + TOGETHER, rows.stop))
                        found.append(bettered(None if best is None else best[some], score[a : a + TOGETHER], seeds[some], number, most))
                best = np.concatenate(found)
        if best is not None:
            for a in range(0, len(seeds), SLICE):
                yield pd.DataFrame({"slice": [a], "keys": [best[a : a + SLICE].tobytes()], "k": [best.shape[1]]})

    return make


def _merge(most: int):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = best_keys(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, k) for x, k in zip(pdf["keys"], pdf["k"], strict=True)], 1), most)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "keys": [keys.tobytes()], "k": [keys.shape[1]]})

    return make


def serve(seeds: np.ndarray, lists: list[np.ndarray], whole: bool, size: np.ndarray, begin: np.ndarray, window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (number, first token, number of tokens) of a round; ``begin`` moves on.  ``whole``: the lists name all that is unused."""
    out, at_first = [], begin[seeds].copy()
    for seed, first, names in zip(seeds.tolist(), at_first.tolist(), lists, strict=True):
        left = int(size[seed]) - first
        if begin[seed] != first or not left:
            continue
        room, pieces = window - left, [(seed, first, left)]
        for d in names.tolist():
            if not room:
                break
            if d != seed and (n := min(int(size[d] - begin[d]), room)) > 0:
                pieces.append((d, int(begin[d]), n))
                room -= n
        if room and not whole:
            continue
        for d, _, n in pieces:
            begin[d] += n
        out.append(pieces)
    return out


def _rounds(blocks: DataFrame, folder: str, width: int, window: int, weights: np.ndarray) -> DataFrame:
    """``block, pieces`` (binary: place in the block, first token, number of tokens, sequence, offset), several rows a block."""
    spark = blocks.sparkSession
    path = common.work_path(spark, "sequences")
    found = sorted((r["block"], np.frombuffer(r["sizes"], "<i4")) for r in blocks.collect())
    names = [b for b, _ in found]
    base = np.cumsum([0, *[len(s) for _, s in found]])
    size = np.concatenate([np.zeros(0, np.int32), *[s for _, s in found]])
    begin = np.zeros(len(size), np.int32)
    held: list[np.ndarray] = []  # number, first token, number of tokens, sequence, offset
    sequence, n_rounds, most, written = 0, 0, LIST, False
    parts = min(max(1, len(names)), max(2 * spark.sparkContext.defaultParallelism, -(-len(names) // BLOCKS)))
    of, sizes = dict(zip(names, base.tolist(), strict=False)), {b: len(x) for b, x in found}
    every = _opened(folder, "index", lambda row: names[row["id"]])

    def flush() -> None:
        rows = np.concatenate([np.zeros((0, 5), np.int64), *held])
        block = np.searchsorted(base, rows[:, 0], side="right") - 1
        rows[:, 0] -= base[block]
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        table = [(names[block[part[0]]], rows[part].tobytes()) for part in np.split(order, cuts) if len(part)]
        spark.createDataFrame(table, "block long, pieces binary").coalesce(1).write.mode("append").parquet(path)

    def query(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """The seeds by group, their distinct tokens, sorted within a group, for each the seed's place, and where a group's seeds and tokens begin and end."""
        at = np.searchsorted(base, seeds, side="right") - 1
        wanted = {names[b]: np.sort(seeds[at == b] - base[b]) for b in np.unique(at)}
        own, texts_of = _opened(folder, "docs", lambda row, held=list(wanted): held[row["id"]]), _texts(wanted, width)
        asked, texts = spark.range(0, len(wanted), 1, min(len(wanted), parts)), {}
        for r in asked.mapInPandas(lambda b, f=own, g=texts_of: common.tidy(g(f(b))), "block long, i int, ids binary").collect():
            texts[of[r["block"]] + r["i"]] = np.unique(np.frombuffer(r["ids"], f"<u{width}"))
        apart = seed_groups(cluster_of([texts[s] for s in seeds.tolist()], weights))
        seeds, upto = seeds[np.concatenate(apart)], np.cumsum([0, *map(len, apart)])
        term = np.concatenate([texts[s] for s in seeds.tolist()])
        owner = np.repeat(np.arange(len(seeds), dtype=np.min_scalar_type(len(seeds))), [len(texts[s]) for s in seeds.tolist()])
        order = np.lexsort((term, np.searchsorted(upto, owner, side="right")))
        cuts = np.searchsorted(owner, upto)
        return seeds, term[order], owner[order], [(*upto[k : k + 2].tolist(), *cuts[k : k + 2].tolist()) for k in range(len(apart))]

    def neighbours(wanted: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """Each seed's list: numbers of unused remainders, the best first."""
        seeds, term, owner, by_group = query(wanted)
        live = {b: np.packbits(left[base[k] : base[k + 1]] > 0) for k, b in enumerate(names)}
        state = spark.sparkContext.broadcast({"seeds": seeds, "most": most, "width": width, "term": term, "owner": owner, "groups": by_group, "live": live, "base": of, "sizes": sizes})
        lists = {}
        asked = spark.range(0, len(names), 1, parts).mapInPandas(lambda b, f=_ask(state): common.tidy(f(every(b))), "slice int, keys binary, k int")
        for r in asked.groupBy("slice").applyInPandas(_merge(most), "slice int, keys binary, k int").collect():
            keys = -np.sort(-np.frombuffer(r["keys"], np.int64).reshape(-1, r["k"]), axis=1)
            for i, row in enumerate(keys):
                lists[int(seeds[r["slice"] + i])] = (seeds[r["slice"] + i] + (REST - (row & REST))) & REST
        state.destroy()  # unpersisted alone, it stays with the driver
        return [lists[s] for s in wanted.tolist()]

    while (left := size - begin).any():
        n_live = int((left > 0).sum())
        n_seeds = max(1, min(SEEDS, ASKED // most))
        seeds = np.sort(np.lexsort((np.arange(len(left)), -left))[: min(n_seeds, n_live)])
        seeds = seeds[np.lexsort((seeds, -left[seeds]))]
        done = serve(seeds, neighbours(seeds, left), most >= n_live, size, begin, window)
        rows = np.array([p for pieces in done for p in pieces], np.int64).reshape(-1, 3)
        n_pieces = np.array([len(pieces) for pieces in done], np.int64)
        upto = np.cumsum(rows[:, 2]) - rows[:, 2]
        first = np.cumsum(n_pieces) - n_pieces
        held.append(np.column_stack([rows, np.repeat(sequence + np.arange(len(done)), n_pieces), upto - np.repeat(upto[first], n_pieces)]))
        sequence += len(done)
        n_rounds += 1
        if sum(map(len, held)) >= HELD:
            flush()
            held, written = [], True
        if n_rounds % REFRESH == 0:
            common.refresh(spark)
        if 4 * len(done) < len(seeds):  # lists too short for what seeds have in common
            most *= 2
    if held or not written:
        flush()
    return spark.read.schema("block long, pieces binary").parquet(path)


def _texts(wanted: dict, width: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                end = np.cumsum(np.frombuffer(row.sizes, "<i4").astype(np.int64)) * width
                at = wanted[row.block]
                yield pd.DataFrame({"block": row.block, "i": at, "ids": [row.ids[end[i - 1] if i else 0 : end[i]] for i in at]})

    return make


def _cut(width: int):
    """The pieces of a block's remainders, as rows."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                sizes = np.frombuffer(row.sizes, "<i4").astype(np.int64)
                term, first = np.frombuffer(row.ids, f"<u{width}"), np.cumsum(sizes) - sizes
                d, a, n, sequence, offset = np.frombuffer(row.pieces, np.int64).reshape(-1, 5).T
                docs = pd.Series(np.frombuffer(row.docs, "<i8")[d], dtype="Int64").mask(np.frombuffer(row.null, bool)[d])
                place = np.frombuffer(row.place, "<i8").reshape(-1, 2)[d]
                ids = [term[f : f + k].astype("<u4").tobytes() for f, k in zip((first[d] + a).tolist(), n.tolist(), strict=True)]
                yield from common.slices([pd.DataFrame({"doc_id": docs, "start": place[:, 0] + a, "length": n, "ids": ids, "doc_tokens": place[:, 1], "sequence_id": sequence, "offset": offset})])

    return make


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, window: int = WINDOW, shard: int = SHARD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids`` (binary, 32-bit little-endian), ``doc_tokens, sequence_id, offset``."""
    spark: SparkSession = docs.sparkSession
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    common.trim(spark)
    with common.small_batches(spark):
        encoded = common.stored(rows.mapInPandas(lambda b, f=_encode(path, end_id, window): common.tidy(f(b)), ENCODED), "encoded")
    # a row for each token id: bounded by the vocabulary
    counts = {r[0]: r[1] for r in encoded.where("kind = 2").groupBy("start").agg(F.sum("n")).collect()}
    # by tasks, since the driver needs no vocabulary
    width = encoded.where("kind = 3").agg(F.max("n")).first()[0] or 4
    n = counts.pop(-1, 0)
    holds = np.zeros(max(counts, default=0) + 1)
    holds[list(counts)] = list(counts.values())
    idf = spark.sparkContext.broadcast(np.log1p((n - holds + 0.5) / (holds + 0.5)))
    full = encoded.where("kind = 0").mapInPandas(_widen(width), PIECES)
    rest = encoded.where("kind = 1").select("doc_id", "start", "doc_tokens", "n", "ids")
    mean, n_rest = rest.agg(F.avg("n"), F.count("*")).first()
    some = rest.where(F.pmod(F.xxhash64("ids"), F.lit(max(1, n_rest // FITTED))) == 0).select("ids").distinct().collect()
    weights = cluster_weights([np.frombuffer(r[0], f"<u{width}") for r in sorted(some)], idf.value)
    del some
    to_all = spark.sparkContext.broadcast(weights)
    rest = rest.mapInPandas(lambda b, f=_clustered(to_all, width): common.tidy(f(b)), "doc_id long, start long, doc_tokens long, n long, ids binary, cluster int")
    order = (F.col("cluster"), F.col("n").desc(), F.xxhash64("ids"), F.col("doc_id"), F.col("start"))
    rest = rest.repartitionByRange(*order).sortWithinPartitions(*order)
    folder = common.work_path(spark, "blocks")
    common.trim(spark)
    with common.small_batches(spark):
        blocks = rest.mapInPandas(lambda b, f=_blocks(folder, shard, idf, mean or 1.0, width): common.tidy(f(b)), "block long, sizes binary")
        blocks = common.stored(blocks, "block-sizes")
    found = _rounds(blocks, folder, width, window, weights)
    pieces = found.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-blocks.count() // BLOCKS)), "block")
    common.trim(spark)
    whole = _opened(folder, "docs", lambda row: row["block"])
    return full.union(pieces.mapInPandas(lambda b, f=_cut(width): common.tidy(f(whole(b))), PIECES))


def _widen(width: int):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in common.slices(batches):
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "start": pdf["start"], "length": pdf["n"], "ids": [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in pdf["ids"]],
                "doc_tokens": pdf["doc_tokens"], "sequence_id": pdf["sequence_id"], "offset": 0,
            })

    return make


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
