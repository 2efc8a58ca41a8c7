"""Hard negatives by exact inner products from subset-sum tables (the method of the Four Russians).

Vectors become whole numbers, ``floor(scale * x)``.  For every eight dimensions of an anchor a table holds the sum of its
components over each of the 256 subsets.  A candidate is kept as bit planes, eight dimensions to a byte, in two's
complement; a byte names the subset whose components have that bit set.  Its score is the sum of the tables' entries
plane by plane, doubled from one plane to the next, the sign plane counted negative: whole scores of whole vectors,
without a product.

Two passes.  The first finds every anchor's best rows of its own label, its positives.  The second keeps, for each
anchor and positive, the best rows of other labels with a score between ``low`` and ``high`` percent of the positive's.

Scale.  The anchors are a stated set of queries against all rows.  Both sides are cut into blocks of fixed size by a hash
of the id, and each task scores one block of anchors against one of candidates and passes on only the best of each
anchor (and positive); a ranking over the blocks' best follows.  Neither side is broadcast; a frequent label or vector
does not matter to the blocks.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; of rows of one
id only that with the smallest label, then vector, counts; vectors of fewer dimensions than others end in zeros;
components beyond the range of a long count as its ends, and scores beyond it wrap around; ties go to the smaller id; an
anchor without another row of its label has no positives; a positive without a row in its window gives no row; an empty
table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, written

GROUP = 8  # dimensions of a table
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
ANCHORS, CANDIDATES = 1024, 8192  # rows of a block
STRIPE = 64  # anchors scored at once
ROWS = 2048  # candidates scored at once

ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, parts array<long> of the rows that take part, one for each id."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
            .where(finite).groupBy(F.col(id_col).cast("long").alias("vec_id"))
            .agg(F.min(F.struct(F.col(label_col).cast("long").alias("label"), whole.alias("parts"))).alias("row"))
            .select("vec_id", "row.*"))


def packed_planes(parts: np.ndarray, planes: int) -> np.ndarray:
    """Rows of bytes [plane, group of eight dimensions] of whole numbers [row, dimension]."""
    return np.stack([np.packbits(((parts >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], 1)


def padded(parts: list, dims: int) -> np.ndarray:
    out = np.zeros((len(parts), dims), np.int64)
    for i, p in enumerate(parts):
        out[i, :len(p)] = p
    return out


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """Tables [group, byte, anchor]: the sum of the anchor's components whose bits the byte has."""
    groups = anchors.shape[1] // GROUP
    sums = np.zeros((groups, 1 << GROUP, len(anchors)), dtype)
    for g in range(groups):
        for i in range(GROUP):
            sums[g, 1 << i:2 << i] = sums[g, :1 << i] + anchors[:, g * GROUP + i].astype(dtype)
    return sums


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor] of packed candidates [row, plane, group], highest plane first."""
    out = np.zeros((len(planes), sums.shape[2]), sums.dtype)
    top = planes.shape[1] - 1
    for p in range(top, -1, -1):
        out += out
        for g in range(planes.shape[2]):
            looked_up = sums[g].take(planes[:, p, g], axis=0)
            if p == top:
                out -= looked_up
            else:
                out += looked_up
    return out


def stripes(anchors: pd.DataFrame, held: pd.DataFrame, dims: int, planes: int, dtype: type) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each anchor and its scores with all candidates."""
    parts = padded(anchors["parts"].to_list(), dims)
    packed = np.frombuffer(b"".join(held["planes"]), np.uint8).reshape(len(held), planes, dims // GROUP)
    for at in range(0, len(anchors), STRIPE):
        sums = subset_sums(parts[at:at + STRIPE], dtype)
        both = np.concatenate([scores(sums, packed[i:i + ROWS]) for i in range(0, len(packed), ROWS)])
        for i, of_anchor in enumerate(np.ascontiguousarray(both.T)):
            yield at + i, of_anchor


def best(places: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """Up to k of the places with the highest scores; of equal ones the first."""
    if len(places) > k:
        values = of[places]
        places = places[values >= np.partition(values, len(values) - k)[len(values) - k]]
    return places[np.argsort(~of[places], kind="stable")][:k]  # the complement falls as the score rises


def scored(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], pick: Callable, schema: str) -> DataFrame:
    """``pick`` applied to each block of anchors and block of candidates."""
    n_anchors, n_rows = (max(1, -(-n // size)) for n, size in zip(sizes, (ANCHORS, CANDIDATES), strict=True))

    def block(n: int):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.select("*", block(n_anchors).alias("a"), every(n_rows).alias("b"))
    right = rows.select("vec_id", "label", "planes", every(n_anchors).alias("a"), block(n_rows).alias("b"))
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(pick, schema)


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         scale: int = SCALE, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH) -> DataFrame:
    """Per anchor (id divisible by ``every``) and positive: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score of the first negatives."""
    whole = written(whole_vectors(vectors, id_col, vector_col, label_col, scale), "whole-vectors")
    about = whole.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("anchors"),
                      F.max(F.size("parts")).alias("dims"), F.min(F.array_min("parts")).alias("lo"),
                      F.max(F.array_max("parts")).alias("hi")).first()
    sizes = (about["anchors"], about["n"])
    dims = -(-max(1, about["dims"] or 0) // GROUP) * GROUP
    planes = max((about["hi"] or 0).bit_length(), (~(about["lo"] or 0)).bit_length()) + 1
    # every partial sum, before doubling or after, is below this
    dtype = np.int32 if dims << (2 * planes) < 1 << 31 else np.int64

    def pack(vec_id: list[int], label: list[int], parts: list) -> dict:
        return {"vec_id": vec_id, "label": label, "planes": [r.tobytes() for r in packed_planes(padded(parts, dims), planes)]}

    rows = written(map_batches(whole, lambda: pack, "vec_id long, label long, planes binary"), "bit-planes")
    anchors = whole.where(F.col("vec_id") % every == 0)

    def prepared(held: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        held = held.sort_values("vec_id", ignore_index=True)
        return held, held["vec_id"].to_numpy(np.int64), held["label"].to_numpy(np.int64)

    def own_label(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held, ids, labels = prepared(held)
        out: dict[str, list] = {"anchor_id": [], "positive_id": [], "positive_score": []}
        if len(held):
            for i, of in stripes(asked, held, dims, planes, dtype):
                anchor = asked["vec_id"].iat[i]
                first = best(np.flatnonzero((labels == asked["label"].iat[i]) & (ids != anchor)), of, positives)
                out["anchor_id"] += [anchor] * len(first)
                out["positive_id"] += ids[first].tolist()
                out["positive_score"] += of[first].tolist()
        return pd.DataFrame(out)

    def other_label(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held, ids, labels = prepared(held)
        out: dict[str, list] = {c: [] for c in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")}
        if len(held):
            for i, of in stripes(asked, held, dims, planes, dtype):
                others = np.flatnonzero(labels != asked["label"].iat[i])
                values = of[others]
                for p in asked["found"].iat[i]:
                    least, most = -(-low * int(p["positive_score"]) // 100), high * int(p["positive_score"]) // 100
                    if least > most:
                        continue
                    fits = others[(values >= least) & (values <= most)]
                    first = best(fits, of, negatives)
                    out["anchor_id"] += [asked["vec_id"].iat[i]] * len(first)
                    out["positive_id"] += [p["positive_id"]] * len(first)
                    out["positive_score"] += [p["positive_score"]] * len(first)
                    out["negative_id"] += ids[first].tolist()
                    out["negative_score"] += of[first].tolist()
        return pd.DataFrame(out)

    def top(found: DataFrame, keys: Any, order: list, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)

    near = scored(anchors, rows, sizes, own_label, "anchor_id long, positive_id long, positive_score long")
    near = top(near, ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives)
    found = (near.groupBy(F.col("anchor_id").alias("vec_id"))
             .agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found")))
    asked = written(anchors.join(found, "vec_id"), "anchors")
    far = scored(asked, rows, sizes, other_label,
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    far = top(far, ["anchor_id", "positive_id"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", every: int = RELABEL_EVERY,
               labels: int = LABELS) -> DataFrame:
    """Every so many ids move to the next label."""
    moved = (F.col(label_col) + 1) % labels
    return vectors.withColumn(label_col, F.when(F.col(id_col) % every == 0, moved).otherwise(F.col(label_col)))
