"""Spelling variants grouped through a bit-sliced position index.

Two words are near if one inserted, deleted or replaced code point makes one of the other.  The form of a word is its
most frequent near word, where that is ``ratio`` times as frequent; forms are followed to the root.

Index.  Within a block of words there is a bitset for every (position, letter): bit j says that word j has the letter
there.  A word runs over its letters once, and all words of the block move on together, a machine word at a time: one
set holds the words without an error so far, others those with one, a replaced letter (same position) or an added one
(position shifted by one).  A missing letter is an added one seen from the longer word.  A run ends as soon as only the
word itself is left.

Blocks.  Of two near words of length L, or L and L + 1, the first or the last half of the L letters is equal, so a word
stands in the blocks (L, first half) and (L, last half) of its length and of one less.  A block of more than ``LIMIT``
words is split again: half of the letters still open is equal too, so the loop ends with all pairs kept, at the latest
when one letter is open and a block holds no more than the alphabet allows.  A pair that lies in several blocks is
reported by the first.

Scale.  Texts are reduced to (word, count) inside tasks before the one shuffle over the corpus; all else grows with the
vocabulary.  Only the number of hot blocks left reaches the driver.

Defined cases: null and empty texts have no words; a null id counts as an empty one; repeated rows count again; words
that tie in count are taken in code-point order; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, arrow_schema, keyed_texts, small_batches, written

LIMIT = 4096  # words of a block
HELD = 300_000  # words that a task counts before it passes them on
RATIO = 10
LEAST_LENGTH, LEAST_COUNT, SPOILT = 7, 2, 31

COUNTS = "word string, n long"
NEAR = "word string, n long, near string, near_n long"


def spelled(key: str, run: str, spoilt: int | None) -> str:
    """The run, without one of its letters where a hash of the document and the run says so."""
    if spoilt:
        h = zlib.crc32(f"{key}:{run}".encode())
        if h % spoilt == 0:
            at = h % len(run)
            return run[:at] + run[at + 1:]
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, spoilt: int | None = None) -> DataFrame:
    """word, n of all runs of letters of at least that length and count; ``spoilt`` plants misspellings in one run of
    that many."""
    texts = keyed_texts(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), "text")
    small_batches(docs.sparkSession)
    target = arrow_schema(COUNTS)
    letters = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def rows(counts: Counter) -> Iterator[pa.RecordBatch]:
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], schema=target)
            counts.clear()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here: Counter = Counter()
                for run, n in Counter(letters.findall(text)).items():
                    here[run.lower() if run.isascii() else run.translate(LOWER_ASCII)] += n
                for run, n in here.items():
                    word = spelled(key, run, spoilt)
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > HELD:
                    yield from rows(counts)
        yield from rows(counts)

    return (texts.mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_count))


# ---- the index of one block ---------------------------------------------

def position_index(words: list[str]) -> tuple[dict[tuple[int, str], int], dict[int, int]]:
    """Bitsets of the words by (position, letter) and by length."""
    at: dict[tuple[int, str], int] = defaultdict(int)
    lengths: dict[int, int] = defaultdict(int)
    for j, word in enumerate(words):
        bit = 1 << j
        lengths[len(word)] |= bit
        for place in enumerate(word):
            at[place] |= bit
    return at, lengths


def one_error(at: dict[tuple[int, str], int], word: str, every: int, own: int) -> tuple[int, int]:
    """Bitsets of the words that have this one's letters but for one replaced, and but for one added.

    The first holds words of its length or more, the second of its length and one or more."""
    same, replaced, added = every, 0, 0
    for i, letter in enumerate(word):
        here, next_ = at.get((i, letter), 0), at.get((i + 1, letter), 0)
        added = (added | same) & next_
        replaced = (replaced & here) | (same & ~here)
        same &= here
        if same == own and not replaced and not added:
            return 0, 0
    return replaced, added | same


def members(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def near_in_block(words: list[str], length: int, barred: int) -> Iterator[tuple[int, int]]:
    """Pairs of places of near words, the first of them of this length; a pair of one length comes both ways.

    Pairs with the first ``barred`` letters in common are another block's."""
    at, lengths = position_index(words)
    equal, longer = lengths.get(length, 0), lengths.get(length + 1, 0)
    every = (1 << len(words)) - 1
    for j in members(equal):
        word = words[j]
        replaced, added = one_error(at, word, every, 1 << j)
        for k in members((replaced & equal) | (added & longer)):
            if not barred or words[k][:barred] != word[:barred]:
                yield j, k


# ---- blocks -------------------------------------------------------------

def halved(rows: DataFrame) -> DataFrame:
    """Rows word, n, length, head, tail, barred: each stands for the words with these first and last letters in common;
    the letters between are split in two, one half of which near words share."""
    open_ = F.col("length") - F.col("head") - F.col("tail")
    half = F.floor(open_ / 2).cast("int")
    least: Column = F.when(F.col("barred") == 0, F.col("head") + half).otherwise(F.least("barred", F.col("head") + half))
    parts = F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("barred").alias("barred")),
                    F.struct(F.col("head").alias("head"), (F.col("tail") + open_ - half).alias("tail"), least.alias("barred")))
    return rows.select("word", "n", "length", F.explode(parts).alias("part")).select("word", "n", "length", "part.*")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.xxhash64("length", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)")))


def blocks(words: DataFrame, limit: int) -> DataFrame:
    """Rows word, n, length, head, tail, barred, key of blocks of at most ``limit`` words, or with one letter open."""
    size = F.char_length("word")
    zero = [F.lit(0).alias(c) for c in ("head", "tail", "barred")]
    level = (words.select("word", "n", F.explode(F.array(size, size - 1)).alias("length"), *zero).where("length > 0"))
    done = None
    while True:
        splits = F.col("length") - F.col("head") - F.col("tail") > 1
        level = keyed(halved(level.where(splits)).unionByName(level.where(~splits)))
        hot = written(level.where(splits).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
                      .select("key"), "hot-blocks")
        last = hot.isEmpty()
        small = level if last else level.join(hot, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        level = written(level.join(hot, "key", "left_semi").drop("key"), "split-blocks")


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, n, near, near_n: every two near words of word, n, both ways."""
    target = arrow_schema(NEAR)

    def block_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, rows in groupby(block_rows(batches), key=lambda r: r[0]):
            exact = defaultdict(list)  # keys are hashes
            for _, word, n, length, head, tail, barred in rows:
                exact[length, barred, word[:head], word[len(word) - tail:], head].append((word, n))
            for (length, barred, *_), held in exact.items():
                if len(held) < 2:
                    continue
                for j, k in near_in_block([w for w, _ in held], length, barred):
                    out.append((*held[j], *held[k]))
                    if len(held[k][0]) > length:
                        out.append((*held[k], *held[j]))
                if len(out) > 10_000:
                    yield batch_of(out, target)
                    out.clear()
        if out:
            yield batch_of(out, target)

    dealt = blocks(words, limit).select("key", "word", "n", "length", "head", "tail", "barred")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, NEAR)


def batch_of(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the links word, form.  Counts grow along links, so they end; every round doubles what is followed."""
    found = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = written(found.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                                 F.col("beyond").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        found = new.drop("moved")


def group_spellings(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """Per word of word, n: word, form, root, n, n_near, form_n."""
    words = written(words, "vocabulary")
    near = written(near_words(words, limit), "near-words")
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"),
                                         F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * ratio
    best = written(best.select("word", "n_near", F.when(fits, F.col("best.form")).alias("form"),
                               F.when(fits, -F.col("best.less")).alias("form_n")), "best-forms")
    followed = roots(best.where("form IS NOT NULL"))
    found = best.join(followed, "word", "left")
    return (words.join(found, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                    "form_n"))
