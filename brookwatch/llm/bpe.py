"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is a vocabulary entry is resolved by a minimal perfect hash: one hash, one displacement, one compare,
for all distinct pre-tokens of a batch at once.  The others are merged byte by byte: the live parts form a linked list
over the bytes, and a heap yields the pair of lowest rank, leftmost first.

Defined cases: a null text counts as empty; an empty text has no ids; texts of any length are encoded whole (a single
pre-token of n bytes takes n log n steps); repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Hashable
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, map_batches

# Merged pre-tokens, and words, that a worker remembers in each of two generations.
REMEMBERED = 1 << 18
TWO_BLANKS = re.compile(r"\s\s|^\s|\s\Z")
LOAD = 4  # keys per bucket of the perfect hash
MIX = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary of a rank file, at the place of its rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: hash, then displace each bucket to free slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = max(1, len(keys))
        self.buckets = n // LOAD + 1
        hashes = self.hashed(keys)
        if len(set(hashes.tolist())) != len(keys):
            raise ValueError("keys repeat")
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot_key = np.zeros(n, np.int64)
        taken = np.zeros(n, bool)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            members = order[ends[b] - sizes[b]:ends[b]]
            start = 1
            while True:  # 64 displacements at once; nearly always the first lot holds one that fits
                tries = np.arange(start, start + 64, dtype=np.uint64)
                slots = self._place(hashes[members][None, :], tries[:, None])
                free = ~taken[slots].any(axis=1)
                if len(members) > 1:
                    ranked = np.sort(slots, axis=1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if free.any():
                    at = int(np.argmax(free))
                    self.shift[b], taken[slots[at]], self.slot_key[slots[at]] = tries[at], True, members
                    break
                start += 64

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _place(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (hashes ^ (shift * MIX)) * MIX
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only index that each key can have; the caller compares the key itself."""
        hashes = self.hashed(keys)
        return self.slot_key[self._place(hashes, self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)])]


class Recent:
    """Results of the last calls, in two generations: the older one goes when the younger is full."""

    def __init__(self, compute: Callable[[Hashable], tuple[int, ...]], most: int = REMEMBERED):
        self.compute, self.most, self.young, self.old = compute, most, {}, {}

    def __call__(self, key: Hashable) -> tuple[int, ...]:
        out = self.young.get(key)
        if out is None:
            out = self.old.get(key)
            if out is None:
                out = self.compute(key)
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary.  A few megabytes, bounded by the rank file; sent with the tasks.

    ``blank_starts`` says that in the given pattern a single blank between two non-blanks always begins a pre-token, so
    that words are split and looked up once while a worker remembers them.
    """

    def __init__(self, vocabulary: list[bytes], pattern: str, blank_starts: bool = False):
        self.vocabulary, self.pattern, self.blank_starts = vocabulary, pattern, blank_starts
        self.perfect = PerfectHash(vocabulary)
        self.ready()

    def __reduce__(self) -> tuple:
        return _received, (self.vocabulary, self.pattern, self.blank_starts, self.perfect)

    def ready(self) -> Codec:
        self.rank = {token: i for i, token in enumerate(self.vocabulary)}
        self.split = regex.compile(self.pattern).findall
        self.merged = Recent(self.merge)
        self.words, self.words_before = {}, {}
        self.decimal = list(map(str, range(len(self.vocabulary))))
        return self

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no vocabulary entry."""
        rank, n = self.rank.get, len(piece)
        after = list(range(1, n + 2))  # end of the part that starts here; n where none starts
        after[n] = 0
        before = list(range(-1, n))  # start of the part that ends here
        wide = (n + 1).bit_length()  # an entry of the heap is one number: rank, start, end
        mask = (1 << wide) - 1
        heap = [(r << wide | i) << wide | i + 2 for i in range(n - 1) if (r := rank(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            end = entry & mask
            i = entry >> wide & mask
            mid = after[i]
            if after[mid] != end:  # a part of this pair has been merged
                continue
            after[mid], after[i], before[end] = n, end, i
            if end < n and (r := rank(piece[i:after[end]])) is not None:
                heappush(heap, (r << wide | i) << wide | after[end])
            if (left := before[i]) >= 0 and (r := rank(piece[left:end])) is not None:
                heappush(heap, (r << wide | left) << wide | end)
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i:after[i]]))
            i = after[i]
        return tuple(out)

    def ids_of(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct pre-tokens: the perfect hash first, merging for the rest."""
        raw = [p.encode() for p in pieces]
        vocabulary, merged = self.vocabulary, self.merged
        return [(i,) if vocabulary[i] == piece else merged(piece)
                for piece, i in zip(raw, self.perfect.find(raw).tolist(), strict=True)]

    def ids_of_words(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of words with a blank before them; a dict that holds these words, and others met before."""
        if len(self.words) > REMEMBERED:
            self.words, self.words_before = {}, self.words
        known, before = self.words, self.words_before
        new = []
        for word in words - known.keys():
            if word in before:
                known[word] = before[word]
            else:
                new.append(word)
        # split in one go: the blank before a word begins a pre-token, and a word holds no other
        parts: list[list[str]] = []
        for piece in self.split(" " + " ".join(new)) if new else ():
            if piece[0] == " ":
                parts.append([piece])
            else:
                parts[-1].append(piece)
        pieces = list(dict.fromkeys(chain.from_iterable(parts)))
        look = dict(zip(pieces, self.ids_of(pieces), strict=True)).__getitem__
        for word, p in zip(new, parts, strict=True):
            known[word] = look(p[0]) if len(p) == 1 else tuple(chain.from_iterable(map(look, p)))
        return known

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; each pre-token by itself, without special tokens."""
        # distinct units of the batch: words after a blank where that cannot change a pre-token, else pre-tokens
        words, pieces, split = set(), {}, []
        for text in texts:
            if self.blank_starts and not TWO_BLANKS.search(text):
                first, *rest = text.split(" ")
                units = self.split(first)
                words.update(rest)
            else:
                units, rest = self.split(text), ()
            pieces.update(dict.fromkeys(units))
            split.append((units, rest))
        look = dict(zip(pieces, self.ids_of(list(pieces)), strict=True)).__getitem__
        look_word = self.ids_of_words(words).__getitem__
        return [list(chain(chain.from_iterable(map(look, units)), chain.from_iterable(map(look_word, rest))))
                for units, rest in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


# One codec of each vocabulary for all tasks of a worker, with what it remembers.
_kept: dict[bytes, Codec] = {}


def _received(vocabulary: list[bytes], pattern: str, blank_starts: bool, perfect: PerfectHash) -> Codec:
    name = hashlib.sha256(b"\0".join([*vocabulary, pattern.encode(), b"1" * blank_starts])).digest()
    if name not in _kept:
        made = Codec.__new__(Codec)
        made.vocabulary, made.pattern, made.blank_starts, made.perfect = vocabulary, pattern, blank_starts, perfect
        _kept.clear()
        _kept[name] = made.ready()
    return _kept[name]


def codec(path: str, pattern: str, blank_starts: bool = False) -> Codec:
    return Codec(read_ranks(path), pattern, blank_starts)


def encode_documents(docs: DataFrame, by: Codec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""
    return map_batches(keyed_texts(docs, id_col, text_col),
                       lambda: lambda key, text: {"doc_id": key, "ids": by.encode(text)}, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, by: Codec, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded binary of every list of ids (null: empty).  Binary, as any ids may cut a character."""
    return map_batches(encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")),
                       lambda: lambda key, ids: {"doc_id": key, "decoded": [by.decode(x or []) for x in ids]},
                       "doc_id long, decoded binary")


def round_trip(docs: DataFrame, by: Codec, id_col: str = "doc_id", text_col: str = "text",
               with_ids: bool = False) -> DataFrame:
    """Encode every text and decode its ids in the same task.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, and the ids if asked.
    """
    def work(key: list, text: list[str]) -> dict:
        encoded, decimal = by.encode(text), by.decimal.__getitem__
        out = {"doc_id": key, "n_tokens": list(map(len, encoded)),
               "ids_sha256": [hashlib.sha256(",".join(map(decimal, x)).encode()).hexdigest() for x in encoded],
               "decoded_sha256": [hashlib.sha256(by.decode(x)).hexdigest() for x in encoded]}
        return {**out, "ids": encoded} if with_ids else out

    return map_batches(keyed_texts(docs, id_col, text_col), lambda: work,
                       "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                       + ", ids array<int>" * with_ids)
