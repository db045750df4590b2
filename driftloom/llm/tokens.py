"""Token ids of whole texts by the tokenizers library, each distinct part encoded once.

A byte-level vocabulary of this kind merges nothing across its pre-tokens, and a single
space or line end between two characters that are not white space always ends one.
Texts are cut there; the parts of a batch are hashed together in NumPy, and only parts
not met before go to the library.  Texts with runs of white space, or with other white
space inside a part, are encoded whole.  The ids are those of encoding whole texts.

What is remembered is bounded (``MOST`` parts, about 30 bytes each) and only saves time.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Remembered parts; when full, the memory starts anew.
MOST = 2_000_000
#: Bytes of text that are looked at together.
STRIDE = 1 << 20
#: Parts of more bytes are never remembered.
LONG = 256
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64
MARKS = ".,;:!?"
#: Bytes without a printed form are shown by the letters from U+0100 on, in ascending order.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in PRINTED)}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(n, STRIDE)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, U(base), U)
            p[0] = U(1)
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Encoder:
    """Ids of whole texts as arrays of ``dtype`` (16 bits where the vocabulary allows it)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.by_parts = self.tokenizer.normalizer is None and type(self.pre).__name__ == "ByteLevel"
        self.forget()

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.pieces: dict[str, array] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    @staticmethod
    def mapped(text: str) -> str:
        """A word in the letters that stand for bytes in a byte-level vocabulary."""
        return text.replace(" ", "\u0120") if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)

    def part(self, raw: bytes) -> array | None:
        """Ids of one part; None if it holds white space beyond what begins it."""
        text = raw.decode()
        body = text[1:] if text[0] == " " else text
        if text not in ("\n", " ") and body.split() != [body]:
            return None
        if any(a in text for a in self.added):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids)
        out = array(self.code)
        # letters, with one mark at most behind them, need no pattern
        if body.isalpha():
            pieces = [self.mapped(text)]
        elif body[:-1].isalpha() and body[-1] in MARKS:
            pieces = [self.mapped(text[:-1]), body[-1]]
        else:
            pieces = [p for p, _ in self.pre.pre_tokenize_str(text)]
        for piece in pieces:
            if (ids := self.pieces.get(piece)) is None:
                ids = array(self.code, [t.id for t in self.model.tokenize(piece)])
                if len(self.pieces) < MOST // 16:
                    self.pieces[piece] = ids
            out += ids
        return out

    def learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Remember the parts data[begin:end]; a size of -1 stands for unclean ones."""
        if len(self.hashes) + len(hashes) > MOST:
            self.forget()
        raw, starts, sizes, new, at = data.tobytes(), [], [], array(self.code), self.used
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            ids = self.part(raw[b:e]) if e - b <= LONG else None
            starts.append(at + len(new))
            sizes.append(-1 if ids is None else len(ids))
            if ids is not None:
                new += ids
        if at + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.zeros(max(len(self.pool), len(new)), self.dtype)])
        self.pool[at : at + len(new)] = np.frombuffer(new, self.dtype)
        self.used = at + len(new)
        where = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, where, hashes)
        self.starts = np.insert(self.starts, where, np.array(starts, np.int64))
        self.sizes = np.insert(self.sizes, where, np.array(sizes, np.int32))

    def _together(self, raws: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each of some texts that are not empty; None where a text has to be encoded whole."""
        data = np.frombuffer(b"".join(raws), np.uint8)
        n = len(data)
        ends = np.cumsum([len(r) for r in raws])
        first = np.concatenate([[0], ends[:-1]])
        blank, line = data == 32, data == 10
        cut = blank | line
        cut[1:] |= line[:-1]
        cut[first] = True
        run = np.zeros(n, bool)
        run[1:] = (blank | line)[1:] & (blank | line)[:-1]
        run[first] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], n)
        power, inverse = powers(n)
        total = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * power, out=total[1:])
        h = mixed((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(U))
        h, one, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        if not known.all():
            held = len(self.hashes)
            self.learn(data, begin[one[~known]], end[one[~known]], h[~known])
            if len(self.hashes) < held:  # it has forgotten what was known
                return self._together(raws)
            at = np.searchsorted(self.hashes, h)
        starts, sizes = self.starts[at][back], self.sizes[at][back]
        owner = np.searchsorted(first, begin, side="right") - 1
        bad = np.zeros(len(raws), bool)
        bad[owner[sizes < 0]] = True
        bad[np.searchsorted(first, np.flatnonzero(run), side="right") - 1] = True
        sizes = np.maximum(sizes, 0).astype(np.int64)
        last = np.cumsum(sizes)
        ids = self.pool[np.repeat(starts - (last - sizes), sizes) + np.arange(last[-1])]
        upto = last[np.append(np.searchsorted(begin, first[1:]), len(begin)) - 1]
        return [None if b else x for b, x in zip(bad, np.split(ids, upto[:-1]), strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; none for null and empty texts."""
        out: list = [np.zeros(0, self.dtype)] * len(texts)
        group: list[int] = []
        raws: list[bytes] = []

        def flush() -> None:
            for i, ids in zip(group, self._together(raws) if self.by_parts else [None] * len(group), strict=True):
                out[i] = self.whole(texts[i]) if ids is None else ids
            group.clear()
            raws.clear()

        size = 0
        for i, t in enumerate(texts):
            if t:
                group.append(i)
                raws.append(t.encode())
                size += len(raws[-1])
                if size >= STRIDE:
                    flush()
                    size = 0
        if group:
            flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release_encoders() -> None:
    """A worker that has no more to encode, but lives on, needs none."""
    _encoders.clear()
