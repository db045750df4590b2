"""Token-id files: one concatenated id array a shard, with Elias-Fano coded boundaries.

A shard holds a contiguous range of documents in ascending id order.  Its file is

    magic, version, id width, end id; numbers of documents, null ids and tokens; offset of the ids
    document ids   Elias-Fano sequence of (doc_id - first doc_id)
    boundaries     Elias-Fano sequence of each document's end in the id array
    ids            little-endian, 16 bits where the vocabulary allows it

An Elias-Fano sequence of n values below u stores the low l = log2(u / n) bits of each
in a packed array and the high parts in unary, 2 + l bits a value.  ``EliasFano.select``
finds the i-th one bit through a sampled directory (one 32-bit entry for each 512 ones)
and a count of bits in the words behind it, so offsets come straight from the coded form
and no table of 64-bit offsets exists.

Files are written by executors into the shared folder, under a name of their own and
then renamed, so a repeated task replaces its file by an equal one.  Any file system
that ``pyarrow.fs`` opens by URI will do.

Defined results: a null or empty text is a document of one token, the end id; null
document ids come first, in a shard's front; repeated ids keep one entry a row, ordered
by a hash of the text; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path

MAGIC, VERSION = b"DLEF", 1
HEAD = struct.Struct("<4sHHIxxxxqqqqqq")
SAMPLE = 512
#: Documents that are decoded at a time.
MOST_DOCS = 1 << 16
_BYTE_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """A non-decreasing sequence of non-negative integers in coded form."""

    HEAD = struct.Struct("<qqq")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(_BYTE_ONES[high], dtype=np.int64)
        # the directory: the byte of each SAMPLE-th one
        self.directory = np.searchsorted(ones, np.arange(1, n + 1, SAMPLE)).astype(np.uint32)
        self.before = np.where(self.directory > 0, ones[np.maximum(self.directory.astype(np.int64) - 1, 0)], 0).astype(np.uint32) if n else np.zeros(0, np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if int(v[-1]) >= n else 0
        low = np.zeros(-(-n * bits // 8), np.uint8)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            flags = np.zeros((n, bits), np.uint8)
            for b in range(bits):
                flags[:, b] = (part >> np.uint64(b)) & np.uint64(1)
            low = np.packbits(flags.ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1, np.uint8)
        ones[at] = 1
        return cls(n, bits, low, np.packbits(ones, bitorder="little"))

    def _low(self, first: int, n: int) -> np.ndarray:
        if not self.low_bits or not n:
            return np.zeros(n, np.int64)
        a = first * self.low_bits
        z = a + n * self.low_bits
        flags = np.unpackbits(self.low[a // 8 : -(-z // 8)], bitorder="little")[a % 8 : a % 8 + z - a].reshape(n, self.low_bits)
        return (flags.astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i: int) -> int:
        """The i-th value, from the coded form."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, seen = int(self.directory[i // SAMPLE]), int(self.before[i // SAMPLE])
        while True:
            here = _BYTE_ONES[self.high[byte : byte + 64]]
            upto = seen + np.cumsum(here, dtype=np.int64)
            if upto[-1] > i:
                break
            byte, seen = byte + 64, int(upto[-1])
        k = int(np.searchsorted(upto, i, side="right"))
        inside = i - (int(upto[k - 1]) if k else seen)
        place = int(np.flatnonzero(np.unpackbits(self.high[byte + k : byte + k + 1], bitorder="little"))[inside])
        return (((byte + k) * 8 + place - i) << self.low_bits) | int(self._low(i, 1)[0])

    def run(self, i: int, n: int) -> np.ndarray:
        """``n`` values from the i-th on, decoded from the directory's entry before them."""
        if n <= 0:
            return np.zeros(0, np.int64)
        a, last = int(self.directory[i // SAMPLE]), (i + n - 1) // SAMPLE + 1
        z = int(self.directory[last]) + 1 if last < len(self.directory) else len(self.high)
        place = np.flatnonzero(np.unpackbits(self.high[a:z], bitorder="little"))[i - int(self.before[i // SAMPLE]) :][:n] + a * 8
        return ((place - np.arange(i, i + n)) << self.low_bits) | self._low(i, n)

    def decoded(self, most: int = 1 << 16) -> Iterator[np.ndarray]:
        """All values, in runs of bounded length."""
        first = 0
        for b in range(0, len(self.high), most // 8):
            place = np.flatnonzero(np.unpackbits(self.high[b : b + most // 8], bitorder="little")) + b * 8
            n = len(place)
            yield ((place - np.arange(first, first + n)) << self.low_bits) | self._low(first, n)
            first += n

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at a place, and the place behind it."""
        n, bits, high = cls.HEAD.unpack_from(raw, at)
        at += cls.HEAD.size
        low = -(-n * bits // 8)
        return cls(n, bits, np.frombuffer(raw, np.uint8, low, at), np.frombuffer(raw, np.uint8, high, at + low)), at + low + high


def write_shard(uri: str, doc_ids: np.ndarray, n_null: int, sizes: np.ndarray, ids: list[bytes], width: int, end_id: int) -> None:
    """One file: ``doc_ids`` ascending, without the ``n_null`` null ones, that come first in ``sizes`` and ``ids``."""
    files, path = common.file_system(uri)
    base = int(doc_ids[0]) if len(doc_ids) else 0
    # differences of 64-bit ids can need 64 bits, so they are taken unsigned
    known = EliasFano.of(doc_ids.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).to_bytes()
    bounds = EliasFano.of(np.cumsum(sizes)).to_bytes()
    head = HEAD.pack(MAGIC, VERSION, width, end_id, len(sizes), n_null, int(np.sum(sizes)), base, len(known), len(bounds))
    files.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{np.random.default_rng().integers(1 << 62):x}"
    with files.open_output_stream(own) as out:
        for block in (head, known, bounds, *ids):
            out.write(block)
    files.move(own, path)


def read_shard(uri: str, block: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Documents of a shard in file order, some at a time: null flags, ids, starts in the shard, and token ids."""
    files, path = common.file_system(uri)
    with files.open_input_stream(path) as src:
        n, n_null, base, width, names, ends, _ = _front(src, uri)
        at, start = 0, 0
        while at < n:
            # the last document that ends within the block, by its offset in the coded form
            to, most = at + 1, min(n, at + MOST_DOCS)
            while to < most:
                middle = (to + most + 1) // 2
                to, most = (middle, most) if ends.select(middle - 1) <= start + block // width else (to, middle - 1)
            last = ends.run(at, to - at)
            data = np.frombuffer(src.read(int(last[-1] - start) * width), f"<u{width}")
            null = np.arange(at, to) < n_null
            known = names.run(max(0, at - n_null), to - max(at, n_null))
            ids = np.concatenate([np.zeros(int(null.sum()), np.int64), (known.astype(np.uint64) + base).astype(np.int64)])
            yield null, ids, np.concatenate([[start], last[:-1]]), np.split(data, last[:-1] - start)
            at, start = to, int(last[-1])


def read_document(uri: str, i: int) -> np.ndarray:
    """Token ids of a shard's i-th document, found by its offset; no other document is read."""
    files, path = common.file_system(uri)
    with files.open_input_file(path) as src:
        n, _, _, width, _, ends, ids = _front(src, uri)
        if not 0 <= i < n:
            raise IndexError(i)
        start, end = ends.select(i - 1) if i else 0, ends.select(i)
        src.seek(ids + start * width)
        return np.frombuffer(src.read((end - start) * width), f"<u{width}")


def _front(src, uri: str) -> tuple[int, int, np.uint64, int, EliasFano, EliasFano, int]:
    """Numbers of documents and null ids, first id, id width, coded ids and boundaries, and the place of the token ids."""
    magic, version, width, _, n, n_null, _, base, known, bounds = HEAD.unpack(src.read(HEAD.size))
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"{uri} is no token file of version {VERSION}")
    names, _ = EliasFano.from_bytes(src.read(known))
    ends, _ = EliasFano.from_bytes(src.read(bounds))
    return n, n_null, np.uint64(base & (1 << 64) - 1), width, names, ends, HEAD.size + known + bounds


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype)
        names, n_null, sizes, blocks = [], 0, [], []
        for pdf in common.slices(batches):
            found = enc.encode_batch(pdf["text"].tolist())
            names.append(pdf["doc_id"].dropna().to_numpy(np.int64))
            n_null += int(pdf["doc_id"].isna().sum())
            sizes.append(np.array([len(x) + 1 for x in found], np.int64))
            blocks.append(np.concatenate([y for x in found for y in (x, end)]).tobytes())
        if sizes:
            shard = TaskContext.get().partitionId()
            uri, size = f"{folder}/shard-{shard:08d}.tok", np.concatenate(sizes)
            write_shard(uri, np.concatenate(names), n_null, size, blocks, enc.dtype.itemsize, end_id)
            yield pd.DataFrame({"shard": [shard], "uri": [uri], "n_docs": [len(size)], "n_tokens": [int(size.sum())]})

    return write


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as token files into ``folder``; the manifest: ``shard, uri, n_docs, n_tokens``, a row a file.

    Texts are dealt out by ranges of the id and a hash of the text (adaptive execution
    picks their number by size) and sorted in each, so shards are in ascending order and
    many rows of one id, or of none, are split.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    return rows.mapInPandas(_writer(folder, path or tokenizer_path(), end_id), "shard long, uri string, n_docs long, n_tokens long")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """The documents of token files: ``doc_id, start, n_tokens, ids`` (binary, 32-bit little-endian)."""
    # the manifest has a row a file, so one task can sum it up
    rows = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                for null, ids, starts, tokens in read_shard(row.uri):
                    yield pd.DataFrame({
                        "doc_id": pd.array(ids, "Int64").copy() if not null.any() else pd.Series(ids, dtype="Int64").mask(null),
                        "start": starts + row.before, "n_tokens": [len(x) for x in tokens], "ids": [x.astype("<u4").tobytes() for x in tokens],
                    })

    spread = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, "uri").mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = common.stored(write_tokens(docs, common.work_path(spark, "tokens")), "manifest")
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


