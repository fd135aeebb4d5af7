"""Token ids of whole texts by the tokenizers library, with distinct chunks encoded once.

A byte-level BPE never merges across the boundaries of its pre-tokenizer, and a single space
after a non-space character always begins a new pre-token. So a text splits at such spaces
into chunks that can be encoded apart. Chunks are found and looked up by hashes in numpy (64 bits
find a chunk, 64 others must agree, else its text is encoded whole); only chunks not met before reach the library, together. A chunk of Latin letters, with
or without a tail of ASCII signs, is one or two pre-tokens and goes straight to the library's
model; every other chunk, and every text with two white-space characters in a row or with an
added token's literal, goes through the library's whole pipeline.
"""

from __future__ import annotations

import codecs
import os
import re

import numpy as np

from quillstream.llm.common import OTHER_CODE, chunk_sums, mix64

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_RUN = re.compile(r"\s\s")
_OPEN: dict[str, "ChunkEncoder"] = {}


def encoder(path: str) -> "ChunkEncoder":
    """The process-wide encoder for a tokenizer file (Python workers are reused)."""
    if path not in _OPEN:
        _OPEN[path] = ChunkEncoder(path)
    return _OPEN[path]


def _byte_letters() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _classes() -> np.ndarray:
    """Class of each byte: 0 unknown, 1 letter, 2 digit, 3 sign, 4 line feed, 5 space."""
    out = np.zeros(256, np.uint8)
    for low, high in ((65, 91), (97, 123), (0x80, 0xC0), (0xC3, 0xC6)):  # with them U+00C0..U+017F
        out[low:high] = 1
    out[48:58] = 2
    out[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = 3
    out[10], out[32] = 4, 5
    return out


_CLASS = _classes()


class _Table:
    """Open-addressing map of 64-bit hashes to row numbers, looked up by whole arrays."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or the empty place where it would go."""
        mask = np.int64((1 << self.bits) - 1)
        place = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[place]
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            place[left] = (place[left] + 1) & mask
            held = self.keys[place[left]]
            left = left[(held != keys[left]) & (held != 0)]
        return place

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self._probe(keys)
        return np.where(self.keys[place] == keys, self.rows[place], np.int32(-1))

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Add distinct keys that aren't held."""
        if (self.size + len(keys)) * 5 > 2 << self.bits:
            full = np.flatnonzero(self.keys)
            old = self.keys[full], self.rows[full]
            bits = self.bits
            while (self.size + len(keys)) * 5 > 2 << bits:
                bits += 1
            self.__init__(bits)
            self.add(*old)
        self.size += len(keys)
        while len(keys):
            place = self._probe(keys)
            _, won = np.unique(place, return_index=True)  # one key takes each place
            self.keys[place[won]], self.rows[place[won]] = keys[won], rows[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, rows = keys[rest], rows[rest]


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    stop = np.cumsum(count)
    return np.repeat(start - (stop - count), count) + np.arange(stop[-1] if len(stop) else 0)


class ChunkEncoder:
    """Encodes texts to unsigned 32-bit ids, exactly as whole-text encoding does.

    The literal of an added token is that token, as the library has it by default. ``keep``
    bounds the chunks remembered at once and ``step`` the characters handled at once; both
    alter speed, never results.
    """

    def __init__(self, path: str, keep: int = 1_200_000, step: int = 1_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._apart = Tokenizer.from_file(path)
        self._apart.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._apart.encode_special_tokens = True
        if hasattr(self._apart.model, "_resize_cache"):
            self._apart.model._resize_cache(0)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self._width = np.zeros(max(vocab.values()) + 1, np.int64)
        self._width[list(vocab.values())] = [len(x) for x in vocab]
        letters = _byte_letters()
        self._letters = "".join(letters[:255]) + " "  # byte 255 isn't in any text: it parts pre-tokens
        self.keep, self.step = keep, step
        self._forget()

    def _forget(self) -> None:
        self._table, self._held = _Table(), 0
        self._pool, self._start, self._count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self._check = np.zeros(1 << 14, np.uint64)
        self._used = 0

    def one(self, text: str) -> np.ndarray:
        """Ids of a text through the library's whole pipeline."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _plain(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks whose bytes have known classes (laid end to end), and counts of ids."""
        kind = _CLASS[raw]
        begin = np.cumsum(size) - size
        part = np.append(False, (kind[1:] != kind[:-1]) | (kind[1:] == 4))
        part[1:] &= kind[:-1] != 5  # a space goes with what follows it
        part[begin[1:]] = True
        cut = np.flatnonzero(part)
        text = codecs.charmap_decode(np.insert(raw, cut, 255).tobytes(), "strict", self._letters)[0]
        ids = np.array(self._apart.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        ends = np.searchsorted(np.cumsum(self._width[ids]), np.cumsum(size), side="left") + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, keys: np.ndarray, check: np.ndarray, raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Add distinct chunks, byte ranges of ``raw``, under their keys and other hashes."""
        if self._held + len(keys) > self.keep:
            self._forget()
        odd = _CLASS[raw] == 0
        odd[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
        odd = np.append(0, np.cumsum(odd))
        odd = odd[begin + size] > odd[begin]
        order = np.argsort(odd, kind="stable")
        keys, check, begin, size, n = keys[order], check[order], begin[order], size[order], len(odd) - int(odd.sum())
        pools, counts = [], []
        for a in range(0, n, 50_000):
            b = min(n, a + 50_000)
            ids, count = self._plain(raw[_spread(begin[a:b], size[a:b])], size[a:b])
            pools.append(ids)
            counts.append(count)
        for a, k in zip(begin[n:].tolist(), size[n:].tolist()):
            pools.append(self.one(raw[a : a + k].tobytes().decode()))
            counts.append([len(pools[-1])])
        pool, count = np.concatenate(pools), np.concatenate(counts).astype(np.int64)
        base, held = self._used, self._held
        self._used, self._held = base + len(pool), held + len(keys)
        while len(self._pool) < self._used:
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        while len(self._start) < self._held:
            self._start, self._count, self._check = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._count, self._check))
        self._pool[base : self._used] = pool
        self._start[held : self._held] = base + np.cumsum(count) - count
        self._count[held : self._held] = count
        self._check[held : self._held] = check
        self._table.add(keys, np.arange(held, self._held, dtype=np.int32))

    def _chunks(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of non-empty texts without runs of white space."""
        coded = [x.encode() for x in texts]
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        length = np.array([len(x) for x in coded])
        ends_of = np.cumsum(length)
        first = np.zeros(len(raw), dtype=bool)
        first[ends_of - length] = True
        begin = np.flatnonzero((raw == 32) | first)
        end = np.append(begin[1:], len(raw))
        keys = mix64(chunk_sums(raw, begin, end)) | np.uint64(1)
        check = chunk_sums(raw, begin, end, OTHER_CODE)
        row = self._table.find(keys)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            if self._held + len(fresh) > self.keep:  # all that these texts need is learnt anew
                fresh, new = np.unique(keys, return_index=True)
            else:
                new = new[at]
            self._learn(fresh, check[new], raw, begin[new], end[new] - begin[new])
            row = self._table.find(keys)
        count = self._count[row]
        stop = np.cumsum(count)
        ids = self._pool[_spread(self._start[row], count)]
        last = np.searchsorted(begin, ends_of, side="left")  # of each text, one after its last chunk
        out = np.split(ids, stop[last - 1][:-1])
        for k in np.unique(np.searchsorted(last, np.flatnonzero(self._check[row] != check), side="right")).tolist():
            out[k] = self.one(texts[k])  # another chunk holds the same place
        return out

    def encode(self, texts) -> list[np.ndarray]:
        """Ids of each text; a null text counts as empty."""
        out: list = [np.zeros(0, np.uint32)] * len(texts)
        group: list[int] = []
        size = 0
        for k, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            if _RUN.search(text) or any(x in text for x in self._added):
                out[k] = self.one(text)
                continue
            group.append(k)
            size += len(text)
            if size >= self.step:
                self._flush(group, texts, out)
                group, size = [], 0
        if group:
            self._flush(group, texts, out)
        return out

    def _flush(self, group: list[int], texts, out: list) -> None:
        for k, ids in zip(group, self._chunks([texts[k] for k in group])):
            out[k] = ids
