"""Benchmark decontamination by greedy string tiling.

Tokens are lower-case words.  Seeds - runs of ``least`` (5) tokens - are joined between documents and benchmark items;
for each pair that shares enough of them, the longest matches that overlap no earlier one are marked again and again
(running Karp-Rabin hashes, long search lengths first), and the marked part of the item is its coverage.  Tiles may lie
in any order, so passages whose sentences were moved around are caught as well as exact ones.

Scale.  The seeds of the benchmark set bits in a filter of fixed size (a megabyte, whatever the benchmark holds), which
goes to all tasks: documents are read once, and only the stretches of text that a filtered seed covers are written out.
Every tile lies within such a stretch, so the tiling needs no second look at the texts.  False positives of the filter
end at the exact join on seeds.

Defined cases: a null text has no tokens; items with fewer than ``least`` tokens are never found; equal items are each
reported; rows of one id are told apart by their text and the best coverage counts; a row with null id is looked at like
any other; an empty benchmark or document table gives no findings.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, map_batches, written
from .rlz import Powers, gram_hashes, word_places

LEAST = 5
COVERAGE = 0.5
TOKEN = re.compile(r"[^\W_]+")
FILTER_BITS = 1 << 23
PRIME, RADIX = (1 << 61) - 1, 1_000_003


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def seed_hashes(words: list[str], least: int, powers: Powers) -> np.ndarray:
    if len(words) < least:
        return np.zeros(0, np.uint64)
    joined, starts, ends = word_places([w.encode() for w in words])
    return gram_hashes(joined, starts, ends, least, powers)


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    """item_id, n_tokens, words of the benchmark, the distinct seeds of an item and how often each stands in it."""
    def make():
        powers = Powers()

        def work(key: list, text: list[str]) -> dict:
            words = [tokens(t) for t in text]
            each = [np.unique(seed_hashes(w, least, powers), return_counts=True) for w in words]
            return {"item_id": key, "n_tokens": [len(w) for w in words], "words": words,
                    "seeds": [s.view(np.int64) for s, _ in each], "times": [n for _, n in each]}
        return work

    return map_batches(items, make, "item_id long, n_tokens int, words array<string>, seeds array<long>, "
                                    "times array<long>")


def filter_bits(seeds: DataFrame) -> np.ndarray:
    """The filter: two bits for each seed.  At most FILTER_BITS / 64 rows reach the driver."""
    places = seeds.select(F.explode(F.array(F.pmod("seed", F.lit(FILTER_BITS)),
                                            F.pmod(F.shiftright("seed", 32), F.lit(FILTER_BITS)))).alias("bit"))
    rows = (places.groupBy(F.shiftright("bit", 6).alias("at"))
            .agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in rows:
        out[at] = bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def stretches(texts: DataFrame, bits: np.ndarray, least: int) -> DataFrame:
    """Documents with a filtered seed: doc_id, version, the seeds, and the stretches of words that they cover."""
    packed = np.packbits(bits)

    def make():
        powers, known = Powers(), np.unpackbits(packed).astype(bool)

        def work(key: list, text: list[str], version: list[int]) -> dict | None:
            out: dict[str, list] = {"doc_id": [], "version": [], "seeds": [], "runs": []}
            for k, t, v in zip(key, text, version, strict=True):
                words = tokens(t)
                hashes = seed_hashes(words, least, powers)
                if not len(hashes):
                    continue
                signed = hashes.view(np.int64)
                hit = np.flatnonzero(known[signed % FILTER_BITS] & known[(signed >> 32) % FILTER_BITS])
                if not len(hit):
                    continue
                breaks = np.flatnonzero(np.diff(hit) > least) + 1
                out["doc_id"].append(k)
                out["version"].append(v)
                out["seeds"].append(np.unique(signed[hit]))
                out["runs"].append([words[part[0]:part[-1] + least] for part in np.split(hit, breaks)])
            return out if out["doc_id"] else None
        return work

    return map_batches(texts, make, "doc_id long, version long, seeds array<long>, runs array<array<string>>")


class Tiling:
    """Marks the tiles of one item in the runs of one document."""

    def __init__(self, item: list[str], runs: list[list[str]], least: int):
        number: dict[str, int] = {w: i for i, w in enumerate(dict.fromkeys(item))}
        self.item, self.least = [number[w] for w in item], least
        self.text: list[int] = []
        for run in runs:  # words that the item lacks, and the ends of runs, match nothing
            self.text += [number.get(w, -1) for w in run] + [-1]
        self.item_free, self.text_free = [True] * len(self.item), [x >= 0 for x in self.text]

    @staticmethod
    def windows(words: list[int], free: list[bool], size: int) -> list[tuple[int, int]]:
        """Hash and start of every run of ``size`` unmarked words, by a running Karp-Rabin hash."""
        out, value, held, top = [], 0, 0, pow(RADIX, size - 1, PRIME)
        for i, (word, usable) in enumerate(zip(words, free, strict=True)):
            if not usable:
                value = held = 0
                continue
            if held == size:
                value = (value - (words[i - size] + 1) * top) % PRIME
                held -= 1
            value = (value * RADIX + word + 1) % PRIME
            held += 1
            if held == size:
                out.append((value, i - size + 1))
        return out

    def matches(self, size: int) -> list[tuple[int, int, int]]:
        """Unmarked matches of at least ``size`` words as (-length, place in item, place in text), longest first."""
        places: dict[int, list[int]] = {}
        for value, at in self.windows(self.text, self.text_free, size):
            places.setdefault(value, []).append(at)
        found = []
        for value, p in self.windows(self.item, self.item_free, size):
            for t in places.get(value, ()):
                if p and t and self.item_free[p - 1] and self.text_free[t - 1] and self.item[p - 1] == self.text[t - 1]:
                    continue  # part of the match that starts one word before
                n = 0
                while (p + n < len(self.item) and t + n < len(self.text) and self.item_free[p + n]
                       and self.text_free[t + n] and self.item[p + n] == self.text[t + n]):
                    n += 1
                if n >= size:
                    found.append((-n, p, t))
        return sorted(found)

    def mark(self) -> list[tuple[int, int, int]]:
        """All tiles (place in item, place in text, length), longest first."""
        tiles, size = [], max(self.least, len(self.item))
        while True:
            found = self.matches(size)
            if not found:
                if size == self.least:
                    return tiles
                size = max(self.least, size // 2)
                continue
            longest = -found[0][0]
            for length, p, t in found:
                if -length < longest:  # shorter ones are searched for again, as these marks may cut them
                    break
                if all(self.item_free[p:p - length]) and all(self.text_free[t:t - length]):
                    self.item_free[p:p - length] = [False] * -length
                    self.text_free[t:t - length] = [False] * -length
                    tiles.append((p, t, -length))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", least: int = LEAST,
                 coverage: float = COVERAGE) -> DataFrame:
    """The pairs found: doc_id, item_id, n_tokens of the item, n_covered, n_tiles, coverage (at least the threshold)."""
    texts = keyed_texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    items = written(item_seeds(keyed_texts(benchmark, item_col, item_text), least), "items")
    seeds = items.select("item_id", "n_tokens", F.explode(F.arrays_zip("seeds", "times")).alias("of")).select(
        "item_id", "n_tokens", F.col("of.seeds").alias("seed"), F.col("of.times").alias("times"))
    found = written(stretches(texts, filter_bits(seeds), least), "stretches")
    # every covered word lies in a shared seed, each as often as it stands in the item: a pair whose shared seeds could not
    # cover enough of the item needs no tiling
    pairs = (found.select("doc_id", "version", F.explode("seeds").alias("seed")).join(seeds, "seed")
             .groupBy("doc_id", "version", "item_id", "n_tokens").agg(F.sum("times").alias("shared"))
             .where(F.col("shared") * least >= F.col("n_tokens") * coverage))
    lists = (pairs.select(F.col("doc_id"), "version", "item_id")
             .join(items.select("item_id", "words"), "item_id")
             .join(found.select(F.col("doc_id").alias("of"), F.col("version").alias("text_of"), "runs"),
                   F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("version") == F.col("text_of")))
             .select("doc_id", "item_id", "words", "runs"))

    def work(key: list, item: list, words: list, runs: list) -> dict:
        tiles = [Tiling(w, r, least).mark() for w, r in zip(words, runs, strict=True)]
        covered = [sum(n for *_, n in t) for t in tiles]
        return {"doc_id": key, "item_id": item, "n_tokens": [len(w) for w in words], "n_covered": covered,
                "n_tiles": [len(t) for t in tiles],
                "coverage": [c / len(w) for c, w in zip(covered, words, strict=True)]}

    measured = map_batches(lists, lambda: work, "doc_id long, item_id long, n_tokens int, n_covered int, n_tiles int, "
                                                "coverage double")
    best = F.max(F.struct("coverage", "n_covered", "n_tiles", "n_tokens")).alias("best")
    return (measured.where(F.col("coverage") >= coverage).groupBy("doc_id", "item_id").agg(best)
            .select("doc_id", "item_id", "best.n_tokens", "best.n_covered", "best.n_tiles", "best.coverage"))
