"""Near-duplicate groups by similarity hashes that are compared bit-sliced.

A document's shingles (consecutive words, repeats included) are hashed to 64 bits; a bit of its fingerprint is set if it
is set in more than half of the hashes.  Fingerprints that differ in at most ``radius`` bits are linked.

Comparison.  Of a block of fingerprints the bit planes are stored: plane b holds bit b of all of them.  A fingerprint is
compared with the whole block at once: planes with its bit inverted mark who differs there, three planes at a time go
through a full adder into binary counters (carry-save), one counter bit for all members to a machine word, and the run
is abandoned once everybody exceeds the radius.

Blocks.  Equal fingerprints are one class.  Of ``radius + 1`` bands of bits two linked fingerprints share one, so a class
stands in one block for each band.  A block of more than ``LIMIT`` classes is split by bands of the bits still open, and
so on: no block can exceed what its open bits allow, and no link is lost.  A block reports as many links as connect its
members, not all pairs.

Defined cases: null, empty and blank texts have fingerprint 0, linked like any other; a text of fewer words than a
shingle has the whole sequence as its only one; rows are linked by their fingerprints, so rows of one id with different
texts may lie apart; a row with null id takes the smallest id reachable, null if there is none; an empty table gives an
empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keyed_texts, map_batches, written
from .components import components
from .rlz import word_places

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
LIMIT = 4096  # classes of a block
CHUNK = 1 << 16  # hashes whose bits are counted at once
ALL = (1 << BITS) - 1


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; 0 without words."""
    words = text.encode().lower().split()  # of bytes: only A-Z, and the six ASCII blanks
    if not words:
        return 0
    joined, starts, ends = word_places(words)
    size = min(shingle, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1:].tolist(), strict=True)),
                         np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id, bits (the fingerprint as a signed long)."""
    def work(key: list, text: list[str]) -> dict:
        return {"doc_id": key, "bits": [signed(fingerprint(t, shingle)) for t in text]}

    return map_batches(keyed_texts(docs, id_col, text_col), lambda: work, "doc_id long, bits long")


# ---- comparison within one block ----------------------------------------

def bit_planes(values: list[int], places: list[int]) -> list[int]:
    """For each place the set of members (as bits of a number) whose bit is set there."""
    rows = np.array([v & ALL for v in values], np.uint64)
    at = np.array(places, np.uint64)[:, None]
    packed = np.packbits(((rows[None, :] >> at) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little")
    return [int.from_bytes(p.tobytes(), "little") for p in packed]


def within(planes: list[int], bits: list[int], every: int, skipped: int, radius: int) -> int:
    """Set of members, but the skipped ones, that differ from these bits in at most ``radius`` of the planes."""
    counters = [0] * max(2, radius.bit_length() + 1)
    beyond = skipped
    for at in range(0, len(planes), 3):
        a, b, c = ((p ^ every if bit else p) for p, bit in zip((planes[at:at + 3] + [0, 0])[:3], (bits[at:at + 3] + [0, 0])[:3], strict=True))
        either = a ^ b
        adds = (either ^ c, (a & b) | (either & c))  # weights 1 and 2
        carry = 0
        for i, held in enumerate(counters):
            add = adds[i] if i < 2 else 0
            either = held ^ add
            counters[i] = either ^ carry
            carry = (held & add) | (either & carry)
        more, equal = carry, every  # a carry out of the last counter is beyond the radius too
        for i in range(len(counters) - 1, -1, -1):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                more |= equal & counters[i]
                equal &= ~counters[i]
        beyond |= more
        if beyond == every:
            return 0
    return every & ~beyond


def links_in_block(values: list[int], places: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Places of members within the radius, as many pairs as connect them; they are equal at all other bits."""
    planes, every = bit_planes(values, places), (1 << len(values)) - 1
    parent = list(range(len(values)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for j, value in enumerate(values):
        near = within(planes, [value >> b & 1 for b in places], every, (2 << j) - 1, radius)
        while near:
            low = near & -near
            k = low.bit_length() - 1
            near ^= low
            a, b = top(j), top(k)
            if a != b:
                parent[b] = a
                yield j, k


# ---- blocks -------------------------------------------------------------

def open_places(mask: int) -> list[int]:
    return [b for b in range(BITS) if not mask >> b & 1]


def narrower(mask: int, radius: int) -> list[int]:
    """The masks that fix one of radius + 1 bands of the open bits as well."""
    places, parts = open_places(mask), radius + 1
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in places[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def blocks(classes: DataFrame, radius: int, limit: int) -> DataFrame:
    """bits, mask, key of blocks of at most ``limit`` classes, which agree in the bits of the mask."""
    level, masks, done = classes.select("bits", F.lit(0).cast("long").alias("mask")), [0], None
    while True:
        finer = {m: narrower(m, radius) for m in masks}
        parts = F.create_map(*(x for m, to in finer.items() for x in (F.lit(signed(m)), F.array(*(F.lit(signed(t)) for t in to)))))
        level = level.select("bits", F.explode(parts[F.col("mask")]).alias("mask"))
        level = level.withColumn("key", F.xxhash64("mask", F.col("bits").bitwiseAND(F.col("mask"))))
        masks = sorted({t for to in finer.values() for t in to})
        # fewer open bits than this and no block can be larger
        splits = BITS - masks[0].bit_count() >= max(limit.bit_length(), radius + 2)
        hot = written(level.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit).select("key"), "hot-blocks")
        last = not splits or hot.isEmpty()
        small = level if last else level.join(hot, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        level = written(level.join(hot, "key", "left_semi").drop("key"), "split-blocks")


def near_classes(classes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """a, b: links that connect all classes within the radius."""
    target = arrow_schema("a long, b long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        a, b = [], []
        for (_, mask), held in groupby(rows, key=lambda r: r[:2]):
            values = [bits for _, _, bits in held]
            if len(values) > 1:
                for j, k in links_in_block(values, open_places(mask & ALL), radius):
                    # members of one key may differ at the mask's bits, as keys are hashes
                    if ((values[j] ^ values[k]) & ALL).bit_count() <= radius:
                        a.append(values[j])
                        b.append(values[k])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=target)

    dealt = blocks(classes, radius, limit).select("key", "mask", "bits")
    return dealt.repartition("key").sortWithinPartitions("key", "mask").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links)."""
    rows = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "classes")
    links = written(near_classes(classes, radius, limit), "links")
    if not links.isEmpty():
        labels = written(classes.join(components(links).withColumnRenamed("node", "bits"), "bits", "left"), "labelled")
        least = labels.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("smallest"))
        classes = (labels.join(least, "component", "left")
                   .select("bits", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("least")))
    return (rows.join(classes, "bits", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")))
