"""Interval merges, first occurrences, sliding totals and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY_SECONDS, HOUR_SECONDS, SLOT_SECONDS

SUMMED = ["flows", "pkts", "bytes", "peers"]


def _sums(df: DataFrame):
    return [F.sum(c).alias(c) for c in SUMMED if c in df.columns]


def merge_gaps(features: DataFrame, key, gap: int = HOUR_SECONDS) -> DataFrame:
    """Merge rows of a key whose intervals touch or lie at most ``gap`` apart.

    Rows that start in the same ``gap``-wide bucket always belong together, so
    they are combined first (map side); a key then has at most one row per
    bucket of the time range in the window step, however many rows it had.
    """
    key = list(key)
    bucket = F.floor(F.col("first") / gap)
    pre = features.groupBy(*key, bucket.alias("_bucket")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *_sums(features))
    order = Window.partitionBy(*key).orderBy("first", "_bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    islands = (pre.withColumn("_reach", F.max("last").over(before))
               .withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("first") > F.col("_reach") + gap), 1)
                           .otherwise(0))
               .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return (islands.groupBy(*key, "_island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *_sums(features)).drop("_island"))


def merge_all(features: DataFrame, key) -> DataFrame:
    """Merge all rows of a key: earliest first, latest last, summed counters."""
    return features.groupBy(*key).agg(F.min("first").alias("first"), F.max("last").alias("last"), *_sums(features))


def first_seen(flows: DataFrame, name: str, run=()) -> DataFrame:
    """The earliest flow of every value in a run, as one mergeable aggregate.

    Ties go to the lowest addresses and ports, then to the remaining columns.
    """
    lead = [c for c in ("first", "msec_first", "srcaddr", "dstaddr", "srcport") if c in flows.columns]
    rest = [c for c in flows.columns if c not in lead and c != name and c not in run]
    return (flows.groupBy(*run, name).agg(F.min(F.struct(*lead, *rest)).alias("_f"))
            .select(*run, name, *[F.col(f"_f.{c}").alias(c) for c in lead + rest]))


def sliding_port_stats(port_table: DataFrame, width: int = DAY_SECONDS, clear_after: int = 1800) -> DataFrame:
    """Running totals of the last ``width`` seconds per (protocol, port).

    Totals restart after a gap in the slot sequence longer than
    ``clear_after``.  A row is given for every slot the port was seen in; a
    port has one row per slot, so its window is bounded by the slots in range.
    """
    slots = port_table.select("slot").distinct()
    # slots of a year are at most 105,120 rows
    one = Window.orderBy("slot")
    eras = (slots.withColumn("_gap", F.col("slot") - F.lag("slot").over(one))
            .withColumn("_era", F.sum(F.when(F.col("_gap") > clear_after, 1).otherwise(0)).over(one))
            .select("slot", "_era"))
    w = (Window.partitionBy("prot", "dstport", "_era").orderBy("slot")
         .rangeBetween(-(width - SLOT_SECONDS), 0))
    return (port_table.join(eras, "slot")
            .select("slot", "prot", "dstport",
                    *[F.sum(c).over(w).alias(c) for c in ("flows", "pkts", "bytes")]))


def new_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct rows of ``new`` not present in ``existing`` (all columns, nulls equal)."""
    return new.subtract(existing.select(*new.columns))


def splice_steps(cached: DataFrame, fresh: DataFrame, start: int, end: int) -> DataFrame:
    """Cached step rows outside the recomputed range, plus the fresh rows."""
    return cached.where((F.col("time") < start) | (F.col("time") >= end)).unionByName(fresh)
