"""Near-duplicate groups by bottom-k sketches of one hash function.

A document's set is its distinct shingles (consecutive words), hashed to 64 bits by one function; its sketch is the k
smallest values.  Equal sets are one class, handled once.  Inverted lists of the retained values generate overlaps, the
estimate on the sketch of the union filters, and the exact Jaccard similarity of the full sets decides.

Which lists.  A list belongs to a run of three retained values that follow each other in hash order.  In the union of two
sets at 0.8 every fifth value or fewer is not shared, so complete sketches always have such a run in common (sets of at
most five shingles use runs of two), and two sketches of 96 values have fewer than ten with a chance of about 1e-6.  Runs keep
frequent shingles from listing unrelated documents together.  Sets whose sizes differ too much are never compared.

Without all pairs.  Copies fill lists with one large group.  So each list first compares its members with one leader per
size class, twice with different leaders, first the member that shares most; the links found so far make components.
Lists with the same first member then form a family, and members of one family in different components are compared with
each other: in small families as rows, in large ones block by block inside tasks, of which only similar pairs leave.  No
list, candidate or partner is capped.

Defined cases: a null or blank text has an empty set and links with nothing; a text with fewer words than a shingle has
the whole sequence as its only shingle; rows of one id are one document, whose rows may hold different texts; a row with
null id joins the component of its set and is kept only if no other id is in it; other columns are left alone.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, keyed_texts, map_batches, written
from .components import components
from .rlz import Powers, gram_hashes, word_places

K = 96
MARGIN = 0.3  # of the estimate below the threshold; seven standard deviations for k = 96
LEADERS = 2
FAMILY = 32  # sets of a family whose pairs are made as rows; larger families are compared in blocks
BLOCK = 512
LEAST_RUNS = 10  # that two cut sketches at the threshold share but for a chance of about 1e-6


def shingle_set(text: str, size: int, powers: Powers) -> np.ndarray:
    """Distinct shingle hashes in ascending order; as signed numbers in the order of their size."""
    words = text.translate(LOWER_ASCII).encode().split()
    if not words:
        return np.zeros(0, np.int64)
    joined, starts, ends = word_places(words)
    found = np.unique(gram_hashes(joined, starts, ends, min(size, len(words)), powers))
    return (found ^ np.uint64(1 << 63)).view(np.int64)


def sketches(texts: DataFrame, size: int, k: int) -> DataFrame:
    """Per row: doc_id, n_shingles, a 128-bit digest of the set (d1, d2) and the sketch."""
    def make():
        powers = Powers()

        def work(key: list, text: list[str]) -> dict:
            sets = [shingle_set(t, size, powers) for t in text]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            return {"doc_id": key, "n_shingles": [len(s) for s in sets], "d1": digests[:, 0], "d2": digests[:, 1],
                    "sketch": [s[:k] for s in sets]}
        return work

    return map_batches(texts, make, "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>")


def full_sets(texts: DataFrame, size: int, k: int) -> DataFrame:
    def make():
        powers = Powers()

        def work(node: list[int], text: list[str]) -> dict:
            sets = [shingle_set(t, size, powers) for t in text]
            return {"node": node, "sketch": [s[:k] for s in sets], "members": sets}
        return work

    return map_batches(texts, make, "node long, sketch array<long>, members array<long>")


def run_lengths(percent: int) -> tuple[int, int]:
    """Length of the runs, and the largest set for which only runs shorter by one are sure to be shared.

    Of u values of a union at least p * u are shared, in at most (1 - p) * u + 1 runs.
    """
    p = percent / 100
    length = max(1, int(p / (1 - p) + 1e-9) - 1) if p < 1 else 8
    rest = p - (length - 1) * (1 - p)
    return length, math.ceil((length - 1) / rest)


def lists(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """The inverted lists to compare, those of more than one set: value, node, n_shingles, size_class."""
    length, small = run_lengths(percent)
    p = percent / 100

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size("sketch") - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get("sketch", i - 1 + j) for j in range(n))))

    keys = F.when(F.size("sketch") <= small, F.concat(runs(length), runs(max(1, length - 1)))).otherwise(runs(length))
    # runs that a similar set shares at least: of u values p * u in (1 - p) * u + 1 stretches; fewer for cut sketches
    sure = F.greatest(F.floor(F.col("n_shingles") * (p - (length - 1) * (1 - p))) - (length - 1), F.lit(1))
    least = F.when(F.col("n_shingles") <= small, 1).when(F.col("n_shingles") <= k * p, sure).otherwise(
        F.least(sure, F.lit(LEAST_RUNS)))
    posted = classes.select("node", "d1", "n_shingles", keys.alias("keys")).withColumn("held", F.size("keys")).select(
        "node", "d1", "n_shingles", "held", least.cast("int").alias("least"), F.explode("keys").alias("value"))
    common = posted.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # the rarest first, beginning with those that no other set has: of the others as many as are left to fill
    rest = (posted.join(common, "value").groupBy("node", "d1", "n_shingles", "held", "least")
            .agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("shared"))
            .withColumn("room", F.col("held") - F.col("least") + 1 - (F.col("held") - F.size("shared"))).where("room > 0"))
    step = math.log(100 / percent) if percent < 100 else 1.0
    weight = F.aggregate("shared", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["df"])
    return (rest.select("node", "n_shingles", weight.alias("weight"), F.floor(F.log(F.col("n_shingles").cast("double")) / step).cast("int").alias("size_class"),
                        F.explode(F.expr("slice(shared, 1, room)")).alias("at"))
            .select("node", "n_shingles", "size_class", "weight", F.col("at.value").alias("value")))


def sizes_fit(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: first by the union's sketch, then by the full sets."""
    sketch, sets = sets.select("node", "sketch"), sets.select("node", "members")
    side = lambda df, name, col: df.withColumnRenamed("node", name).withColumnRenamed(col, f"{col}_{name}")
    both = pairs.join(side(sketch, "a", "sketch"), "a").join(side(sketch, "b", "sketch"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    likely = both.where(shared >= F.size(union) * (percent / 100 - MARGIN)).select("a", "b").distinct()
    whole = likely.join(side(sets, "a", "members"), "a").join(side(sets, "b", "members"), "b")
    common = F.size(F.array_intersect("members_a", "members_b"))
    union_size = F.size("members_a") + F.size("members_b") - common
    return whole.where(common * 100 >= union_size * percent).select("a", "b").distinct()


def with_component(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def leader_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each member of a list with the list's leader of this turn, unless a component holds both.

    The first leader is the member that shares most with others - of edited copies the original -, later ones are drawn.
    """
    drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20))
    rank = drawn if turn else F.col("weight") * (1 << 20) + drawn
    leader = (rows.groupBy("value", "size_class")
              .agg(F.max_by("node", rank).alias("a"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").drop("n"))
    about = rows.select(F.col("node").alias("a"), F.col("component").alias("component_a"),
                        F.col("n_shingles").alias("n_a")).distinct()
    met = (rows.join(leader, ["value", "size_class"]).where("a <> node")
           .select("a", F.col("node").alias("b"), "component", "n_shingles").distinct())
    return (met.join(about, "a").where(F.col("component") != F.col("component_a"))
            .where(sizes_fit("n_shingles", "n_a", percent)).select("a", "b").distinct())


def families(rows: DataFrame) -> DataFrame:
    """family, node, component, n_shingles, n: lists with the same first member joined, so that two sets that share many
    lists meet once.  Only families of more than one component are left."""
    first = written(rows.groupBy("value").agg(F.max_by("node", F.col("weight") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20)))
                                              .alias("family")), "firsts")
    members = rows.join(first, "value").select("family", "node", "component", "n_shingles").distinct()
    mixed = (members.groupBy("family").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where("lo < hi").select("family", "n"))
    return members.join(mixed, "family")


def crossing_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Members of one small family that lie in different components; at most FAMILY candidates for each."""
    left = members.select("family", F.col("node").alias("a"), F.col("component").alias("component_a"), F.col("n_shingles").alias("n_a"))
    return (left.join(members, "family").where(F.col("a") < F.col("node")).where(F.col("component_a") != F.col("component"))
            .where(sizes_fit("n_shingles", "n_a", percent)).select("a", F.col("node").alias("b")).distinct())


def similar_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Similar pairs of different components in large families.

    A family is cut into blocks of about BLOCK sets by a hash; each task compares two blocks by counting shared shingles
    in one product of matrices, and only similar pairs leave it.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = (members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "component")
             .join(sets.select("node", "members"), "node"))

    def compare(key: tuple[Any, ...], held: pd.DataFrame) -> pd.DataFrame:
        _, lo, hi = key
        sizes = np.array([len(m) for m in held["members"]], np.int64)
        values, place, count = np.unique(np.concatenate(held["members"].to_list()), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        column = np.cumsum(count > 1) - 1
        useful = count[place] > 1
        row, column = row[useful], column[place[useful]]
        own = held["own"].to_numpy()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, 4096):
            here = (column >= at) & (column < at + 4096)
            marks = np.zeros((len(sizes), 4096), np.float32)
            marks[row[here], column[here] - at] = 1
            shared += marks[left] @ marks[right].T
        both = shared.astype(np.int64)
        node, component = held["node"].to_numpy(), held["component"].to_numpy()
        near = both * 100 >= (sizes[left][:, None] + sizes[right][None, :] - both) * percent
        near &= component[left][:, None] != component[right][None, :]
        if lo == hi:
            near &= node[left][:, None] < node[right][None, :]
        i, j = np.nonzero(near)
        return pd.DataFrame({"a": node[left[i]], "b": node[right[j]]})

    return dealt.groupBy("family", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, k: int = K) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable over links) and kept.

    Links hold between sets with 100 * intersection >= percent * union.
    """
    texts = keyed_texts(docs, id_col, text_col)
    rows = written(sketches(texts, shingle, k), "sketches")
    digest = ["d1", "d2", "n_shingles"]
    named = rows.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    names = written(named, "classes")
    # one row per class: that of its smallest id (equal rows of one id give one row)
    classes = written(rows.join(names.withColumnRenamed("node", "doc_id"), [*digest, "doc_id"], "leftsemi")
                      .withColumnRenamed("doc_id", "node").dropDuplicates(["node", "d1", "d2"]), "class-sketches")
    found = written(lists(classes, percent, k), "lists")
    active = found.select(F.col("node").alias("doc_id")).distinct()
    sets = written(full_sets(texts.join(active.hint("shuffle_hash"), "doc_id", "leftsemi"), shingle, k), "sets")
    links, labels = None, None
    for turn in range(LEADERS + 2):
        if turn < LEADERS:
            similar = verified(leader_pairs(with_component(found, labels), turn, percent), sets, percent, k)
        elif turn == LEADERS:
            met = written(families(with_component(found, labels)), "families")
            similar = verified(crossing_pairs(met.where(F.col("n") <= FAMILY), percent), sets, percent, k)
        else:
            similar = similar_in_blocks(met.where(F.col("n") > FAMILY), sets, percent)
        new = written(similar, "similar")
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        if turn != LEADERS:  # the last two turns compare within the components of before
            labels = components(links)
    labels = components(links) if links is not None else None
    named = with_component(names, labels).drop("node")
    return (rows.join(named, digest, "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))
