"""Substring dedup by relative Lempel-Ziv parsing against an index of reference blocks.

Texts are words; what repeats is a run of ``window`` (50) or more words that also stands in a document of smaller id.

Index.  The k-word grams of a text are hashed, and of each window's grams the smallest hash is its anchor (the first of
equals), so equal windows have equal anchors wherever they stand.  A reference block is the run of words under the
consecutive windows of one anchor: every window of the corpus lies in exactly one block, and two equal windows lie in
blocks of the same anchor.  Blocks are keyed by (anchor, hash of the block's words); only blocks whose anchor comes
again are looked at further.

Parse.  A document is factored greedily against every indexed block: a block that an earlier document holds as a whole
continues the running factor.  Where no earlier document holds the whole block the factor ends within it, and the
windows at this boundary are compared one by one with those of all blocks of the anchor.  Factors of at least one window
are the duplicate spans.  The result is exact up to collisions of 128 hashed bits (64 of the anchor, 64 of the words).

Scale.  One row per block (about one for 18 words) is shuffled once as a pre-aggregated count; groups of copies cost one
comparison with their first document, never pairs; windows are only made at boundaries of first occurrences.

Defined cases: a null text counts as empty; texts below one window lose nothing; repeats within one document, or in rows
of equal id, are no repeats; rows of equal id are told apart by their text; a row with null id loses nothing and serves
as no reference; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, map_batches, written

WINDOW = 50
GRAM = 16
BASE = 0x9E3779B97F4A7C15 | 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as far as the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


def gram_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """Hash of the ``gram`` words from each word on, by differences of one running sum over the bytes."""
    codes = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
    up, down = powers.reach(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:len(codes)], out=sums[1:])
    first = starts[:len(starts) - gram + 1]
    x = (sums[ends[gram - 1:]] - sums[first]) * down[first]
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_places(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single blanks, and where each starts and ends."""
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return joined, np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(joined)]))


def blocks_of(text: str, window: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...] | None:
    """First window, number of windows, anchor and block hash of each block of one text."""
    words = text.encode().split()  # bytes split at the six ASCII blanks
    if len(words) < window:
        return None
    joined, starts, ends = word_places(words)
    grams = gram_hashes(joined, starts, ends, gram, powers)
    wide = window - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, wide)
    anchors = np.concatenate([views[i:i + 8192].argmin(axis=1) for i in range(0, len(views), 8192)])
    anchors += np.arange(len(anchors))
    first = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    count = np.diff(np.concatenate((first, [len(anchors)])))
    view = memoryview(joined)
    # the anchor's place within the block is part of the key
    offset = anchors[first] - first
    hashes = [xxhash.xxh3_64_intdigest(view[s:e], seed=o) for s, e, o in
              zip(starts[first].tolist(), ends[first + count + window - 2].tolist(), offset.tolist(), strict=True)]
    return first, count, grams[anchors[first]].view(np.int64), np.array(hashes, np.uint64).view(np.int64)


def reference_blocks(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """One row per block of every text: doc_id, version, pos, windows, anchor, block."""
    def make():
        powers = Powers()

        def work(key: list, text: list[str], version: list[int]) -> dict | None:
            made = [(k, v, b) for k, t, v in zip(key, text, version, strict=True)
                    if k is not None and (b := blocks_of(t, window, gram, powers)) is not None]
            if not made:
                return None
            sizes = [len(b[0]) for *_, b in made]
            columns = [np.concatenate([b[i] for *_, b in made]) for i in range(4)]
            return {"doc_id": np.repeat(np.array([k for k, *_ in made], np.int64), sizes),
                    "version": np.repeat(np.array([v for _, v, _ in made], np.int64), sizes),
                    **dict(zip(("pos", "windows", "anchor", "block"),
                               (columns[0].astype(np.int32), columns[1].astype(np.int32), *columns[2:]), strict=True))}
        return work

    return map_batches(texts, make, "doc_id long, version long, pos int, windows int, anchor long, block long")


def boundary_windows(texts: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """The windows of the given blocks, read from the texts: anchor, win, doc_id, version, pos."""
    need = rows.groupBy("doc_id", "version").agg(F.collect_list(F.struct("pos", "windows", "anchor")).alias("at"))

    def work(key: list, text: list[str], version: list[int], at: list) -> dict:
        out: dict[str, list] = {"anchor": [], "win": [], "doc_id": [], "version": [], "pos": []}
        for k, t, v, blocks in zip(key, text, version, at, strict=True):
            joined, starts, ends = word_places(t.encode().split())
            view, starts, ends = memoryview(joined), starts.tolist(), ends.tolist()
            for b in blocks:
                places = range(b["pos"], b["pos"] + b["windows"])
                out["win"] += [xxhash.xxh3_64_intdigest(view[starts[p]:ends[p + window - 1]]) - (1 << 63) for p in places]
                out["pos"] += places
                out["anchor"] += [b["anchor"]] * len(places)
            n = len(out["pos"]) - len(out["doc_id"])
            out["doc_id"] += [k] * n
            out["version"] += [v] * n
        return out

    joined = texts.join(need.hint("shuffle_hash"), ["doc_id", "version"]).select("doc_id", "text", "version", "at")
    return map_batches(joined, lambda: work,
                       "anchor long, win long, doc_id long, version long, pos int")


def versioned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_texts(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))


def pieces(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """What each text shares with earlier documents, block by block: doc_id, version, pos, windows, ref."""
    blocks = written(reference_blocks(texts, window, gram), "rlz-blocks")
    # counts are written before they are joined, so that Spark can split the partition of a frequent anchor
    again = written(blocks.groupBy("anchor")
                    .agg(F.count(F.lit(1)).alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi"))
                    .where("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("differ")), "rlz-again")
    hits = written(blocks.join(again, "anchor"), "rlz-hits")
    firsts = written(hits.groupBy("anchor", "block").agg(F.min("doc_id").alias("ref")), "rlz-firsts")
    held = written(hits.join(firsts, ["anchor", "block"]).where("doc_id > ref OR differ"), "rlz-held")
    whole = held.where("doc_id > ref").select("doc_id", "version", "pos", "windows", "ref")
    windows = written(boundary_windows(texts, held.where("doc_id = ref AND differ"), window), "rlz-windows")
    earlier = written(windows.groupBy("anchor", "win").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("last"))
                      .where("ref < last").drop("last"), "rlz-earlier")
    part = (windows.join(earlier, ["anchor", "win"]).where("doc_id > ref")
            .select("doc_id", "version", "pos", F.lit(1).alias("windows"), "ref"))
    return whole.unionByName(part)


def factors(found: list, window: int) -> list[tuple[int, int, int]]:
    """Greedy left-to-right factors (first word, end, reference document) out of one text's pieces.

    A factor goes on as long as the next shared windows stand in the same reference document without a gap.
    """
    out: list[tuple[int, int, int]] = []
    for pos, count, ref in sorted(found):
        end = pos + count + window - 1
        if out and out[-1][2] == ref and pos <= out[-1][1] - window + 1:
            out[-1] = (out[-1][0], max(out[-1][1], end), ref)
        else:
            out.append((pos, end, ref))
    return out


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The spans without their overlaps."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM) -> DataFrame:
    """Every text with its factors: doc_id, text, factors array<struct<pos, windows, ref>> (null: none)."""
    texts = versioned(docs, id_col, text_col)
    shared = (pieces(texts, window, gram).groupBy("doc_id", "version")
              .agg(F.collect_list(F.struct("pos", "windows", "ref")).alias("found")))
    return texts.join(shared.hint("shuffle_hash"), ["doc_id", "version"], "left").select("doc_id", "text", "found")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one blank, the factors found, and the
    kept words themselves if asked."""
    def work(key: list, text: list[str], found: list) -> dict:
        out: dict[str, list] = {name: [] for name in ("n_words", "n_removed", "kept_sha256", "factors", "kept")}
        for t, pieces_found in zip(text, found, strict=True):
            words = t.encode().split()
            parse = factors([(p["pos"], p["windows"], p["ref"]) for p in pieces_found or ()], window)
            kept, at = [], 0
            for start, end in covered(parse):
                kept += words[at:start]
                at = end
            kept += words[at:]
            joined = b" ".join(kept)
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept_sha256"].append(hashlib.sha256(joined).hexdigest())
            out["factors"].append([{"start": s, "end": e, "ref": r} for s, e, r in parse])
            out["kept"].append(joined.decode() if with_text else None)
        return {"doc_id": key, **out}

    return map_batches(repeated_spans(docs, id_col, text_col, window, gram), lambda: work,
                       "doc_id long, n_words long, n_removed long, kept_sha256 string, "
                       "factors array<struct<start: int, end: int, ref: long>>, kept string")
