"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is the set of the digests of its paragraphs (lines, cut at sentence ends and after 64 characters).  Its sketch has
three subtables of cells; each digest is hashed to one cell of each, where a cell keeps the count of its digests, their
xor, and the xor of their check hashes.  Subtracting the sketches of two versions cancels what they share.  What is left
is peeled: a cell with one digest (count 1 or -1 and a check that fits) gives the digest, which is then taken from its
other cells, and so on.  When cells are left over, the pair is tried again with sketches eight times as large.  The
recovered digests are the differing paragraphs, so likeness = 1 - differing / (paragraphs of both).

Plan.  Built-in expressions only.  Cells are rows, so large and mostly empty sketches cost only what they hold; each
subtable is peeled in turn, as a digest has one cell there and cannot be taken twice.  All steps group by document on
one bucketed table, so peeling shuffles nothing.  The order of documents comes from a range partitioning of the ids
alone, with the first id of each range joined to the last of the one before.

Defined cases: a null text counts as empty and has no paragraphs; two texts without paragraphs have likeness 1, one with
and one without 0; rows equal in id and text give one row; where several texts share the next id, the edit takes the
smallest of their first characters and near_next the text of the smallest hash; a row with null id has no place in the
order and is left out; a single document is its own successor; other columns are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_texts, shared_path, written

PARAGRAPH = r"[^.!?\n]{1,64}[.!?\n]*|[.!?\n]+"
TABLES = 3
PRINT_CELLS = 4  # of each subtable of the fingerprint
LEAST_CELLS = 8  # of each subtable when sketches are subtracted
SPARE = 4  # cells of each subtable for each digest of the larger side, so that nearly all pairs peel at once
GROWTH = 8
TURNS = 6
CHECK = 97  # seeds the check hash


def digests(text: Column | str) -> Column:
    """Distinct paragraph digests of a text."""
    found = F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def place(key: Column | str, table: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(table)), cells.cast("long"))


def cell(table: int, at: Column, count: Column, key: Column, check: Column) -> Column:
    return F.struct(F.lit(table).alias("tab"), at.alias("at"), count.cast("long").alias("n"), key.alias("key"),
                    check.alias("check"))


def summed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells of equal place added up; empty ones vanish."""
    return (cells.groupBy(*by, "tab", "at").agg(F.sum("n").alias("n"), F.expr("bit_xor(key)").alias("key"),
                                                F.expr("bit_xor(check)").alias("check"))
            .where("n <> 0 OR key <> 0 OR check <> 0"))


def sketched(rows: DataFrame, by: list[str], sides: list[tuple[str, int]], cells: Column) -> DataFrame:
    """Sketch cells of the digests in array columns, with their signs, as rows."""
    def with_sign(name: str, sign: int) -> Column:
        return F.transform(F.col(name), lambda x: F.struct(x.alias("key"), F.lit(sign).alias("sign")))

    signed = F.concat(*(with_sign(name, sign) for name, sign in sides))
    each = (rows.select(*by, cells.cast("long").alias("cells"), F.explode(signed).alias("d"))
            .select(*by, "cells", "d.key", "d.sign").withColumn("check", F.xxhash64("key", F.lit(CHECK))))
    three = F.array(*(cell(t, place("key", t, F.col("cells")), F.col("sign"), F.col("key"), F.col("check"))
                      for t in range(TABLES)))
    return summed(each.select(*by, "cells", F.explode(three).alias("c")).select(*by, "cells", "c.*"), [*by, "cells"])


def peeled(cells: DataFrame, by: list[str], table: int) -> DataFrame:
    """One turn: what the pure cells of one subtable hold is recovered, as rows of the table after the last."""
    pure = ((F.col("tab") == table) & (F.abs("n") == 1) & (F.xxhash64("key", F.lit(CHECK)) == F.col("check"))
            & (place("key", table, F.col("cells")) == F.col("at")))
    less = [cell(t, place("key", t, F.col("cells")), -F.col("n"), F.col("key"), F.col("check"))
            for t in range(TABLES) if t != table]
    found = cell(TABLES, F.col("key"), F.col("n"), F.col("key"), F.col("check"))
    same = F.struct("tab", "at", "n", "key", "check")
    out = F.when(pure, F.array(*less, found)).otherwise(F.array(same))
    return summed(cells.select(*by, "cells", F.explode(out).alias("c")).select(*by, "cells", "c.*"), [*by, "cells"])


def differences(pairs: DataFrame, by: list[str], a: str, b: str, level: int) -> DataFrame:
    """One attempt for every pair of digest arrays: by, recovered (digests with their side), failed.

    The sketches have four cells in each subtable for each digest of the larger side, times 8 for each retry.
    """
    cells = sketched(pairs, by, [(a, 1), (b, -1)],
                     F.greatest(F.size(a), F.size(b), F.lit(LEAST_CELLS)).cast("long") * F.lit(SPARE * GROWTH ** level))
    for turn in range(TURNS):
        cells = peeled(cells, by, turn % TABLES)
    done = F.col("tab") == TABLES
    return cells.groupBy(*by).agg(F.count(F.when(done, 1)).alias("recovered"), F.count(F.when(~done, 1)).alias("left"))


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by a key, so that grouping by it needs no shuffle.

    Rows that a join has partitioned by the key already lie as the buckets do, so they are written without a shuffle.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sketch_{uuid.uuid4().hex}"
    (df.write.bucketBy(n, key).option("path", shared_path(spark, "bucketed"))
     .format("parquet").saveAsTable(name))
    return spark.table(name)


def likeness(pairs: DataFrame, by: list[str], a: str, b: str, name: str) -> DataFrame:
    """by, likeness of the two digest arrays; attempts go on, with larger sketches, until every pair is peeled."""
    out, level, todo = None, 0, pairs
    while True:
        tried = written(differences(todo, by, a, b, level), "peeled")
        ready = tried.where("left = 0").drop("left")
        out = ready if out is None else out.unionByName(ready)
        # a table of its own, whose size Spark knows: few pairs are looked up without shuffling the digests
        failed = written(tried.where("left > 0").select(*by), "unpeeled")
        if failed.isEmpty():
            break
        todo, level = pairs.join(failed, by, "leftsemi"), level + 1
    # pairs without differing digests leave no cells at all; only sizes are shuffled
    both = pairs.select(*by, (F.size(a) + F.size(b)).alias("both"))
    return (both.join(out.hint("shuffle_hash"), by, "left")
            .select(*by, F.when(F.col("both") == 0, 1.0).otherwise(1 - F.coalesce("recovered", F.lit(0)) / F.col("both")).alias(name)))


def successors(texts: DataFrame) -> DataFrame:
    """doc_id, next_id (the next larger id; after the last the first) and quarter, a fourth of the characters."""
    spark: SparkSession = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    ranged = written(ids.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    # as many rows as range partitions
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(Window.partitionBy())).alias("follow"))
    inside = Window.partitionBy("part").orderBy("doc_id")
    return (ranged.withColumn("next_id", F.lead("doc_id").over(inside)).join(after, "part")
            .select("doc_id", F.coalesce("next_id", "follow").alias("next_id"), F.floor(F.col("n") / 4).cast("int").alias("quarter")))


def edited_texts(texts: DataFrame, chain: DataFrame) -> DataFrame:
    """Every text with its edit: the last fourth replaced by as many first characters of the next document."""
    heads = (chain.select(F.col("doc_id").alias("of"), F.col("next_id").alias("doc_id"), "quarter").join(texts, "doc_id")
             .select(F.col("of").alias("doc_id"), F.expr("substring(text, 1, quarter)").alias("head"))
             .groupBy("doc_id").agg(F.min("head").alias("head")))
    cut = F.floor(F.length("text") / 4).cast("int")
    return (texts.join(heads, "doc_id").withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", cut)
            .withColumn("edited", F.expr("concat(substring(text, 1, n_chars - cut), substring(head, 1, cut))"))
            .drop("head", "cut"))


def fingerprints(rows: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    """The sketch of fixed size as a string: place, count, xor and check of each cell in use."""
    cells = sketched(rows, by, [(col, 1)], F.lit(PRINT_CELLS))
    held = F.struct("tab", "at", "n", "key", "check")
    listed = cells.select(*by, held.alias("cell")).groupBy(*by).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    # numbers are shuffled, and written out as text afterwards
    text = F.transform("cells", lambda c: F.format_string("%d.%d:%d:%x:%x", c["tab"], c["at"], c["n"], c["key"], c["check"]))
    return (rows.select(*by).join(listed.hint("shuffle_hash"), by, "left")
            .select(*by, F.coalesce(F.array_join(text, ","), F.lit("")).alias(name)))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    texts = keyed_texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    chain = written(successors(texts), "chain")
    by = ["doc_id", "version"]
    own = (edited_texts(texts, chain)
           .select("doc_id", F.xxhash64("text").alias("version"), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                   digests("text").alias("own"), digests("edited").alias("changed")))
    rows = bucketed(own.dropDuplicates(by), "doc_id")
    first = rows.groupBy("doc_id").agg(F.min("version").alias("version"))
    follow = (rows.join(first, by, "leftsemi").select(F.col("doc_id").alias("next_id"), F.col("own").alias("follow"))
              .join(chain, "next_id").select("doc_id", "follow"))
    pairs = bucketed(rows.select(*by, "own").join(follow, "doc_id"), "doc_id")
    out = rows.select(*by, "n_chars", "edited_sha256")
    for part in (fingerprints(rows, by, "own", "fingerprint"), fingerprints(rows, by, "changed", "edited_fingerprint"),
                 likeness(rows.select(*by, "own", "changed"), by, "own", "changed", "near_edited"),
                 likeness(pairs, by, "own", "follow", "near_next")):
        out = out.join(part.hint("shuffle_hash"), by)
    return out.drop("version")
