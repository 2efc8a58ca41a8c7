"""The partitioned flow table: one Parquet folder per device and day.

Rows are clustered by slot inside a file, so a slot range prunes days by
partition and row groups by their ``slot`` statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefn import local_ts, slot
from ..schema import SLOT_SECONDS


def with_partitions(flows: DataFrame) -> DataFrame:
    """Add ``slot`` and the UTC day ``dt`` of the flow's start."""
    return flows.withColumns({"slot": slot(), "dt": F.to_date(local_ts("first"))})


def write_flows(flows: DataFrame, path: str, mode: str = "append", files_per_day: int = 32) -> None:
    """Write flows as a table partitioned by device and day.

    Rows of a day are spread over ``files_per_day`` slot ranges before the
    write.  The rebalance splits a range that is still too large and joins
    small ones at run time, so one busy device, day or hour is no single task.
    """
    per_file = max(86400 // files_per_day // SLOT_SECONDS, 1) * SLOT_SECONDS
    parted = with_partitions(flows).withColumn("_part", F.floor((F.col("slot") % 86400) / per_file))
    (parted.hint("rebalance", "devid", "dt", "_part").drop("_part").sortWithinPartitions("devid", "dt", "slot")
     .write.mode(mode).partitionBy("devid", "dt").parquet(path))


def read_flows(spark: SparkSession, path: str, devid: int | None = None, start: int | None = None,
               end: int | None = None, devids: Sequence[int] | None = None,
               window: tuple[int, int] | None = None) -> DataFrame:
    """Flows of the slots ``start .. end`` (inclusive) of one or more devices.

    ``window`` also keeps only flows lying wholly inside ``(a, b)``.
    """
    df = spark.read.parquet(path)
    wanted = list(devids) if devids else ([devid] if devid is not None else [])
    if wanted:
        df = df.where(F.col("devid").isin(*wanted))
    for bound, low in ((start, True), (end, False)):
        if bound is not None:
            df = df.where(_day_bound(bound, low) & ((F.col("slot") >= bound) if low else (F.col("slot") <= bound)))
    if window:
        a, b = window
        df = df.where(_day_bound(a, True) & _day_bound(b, False) & (F.col("slot") >= a - a % SLOT_SECONDS)
                      & (F.col("first") >= a) & (F.col("last") <= b))
    return df


def _day_bound(ts: int, low: bool) -> Column:
    import datetime
    day = datetime.datetime.fromtimestamp(ts, datetime.timezone.utc).date()
    return F.col("dt") >= F.lit(day) if low else F.col("dt") <= F.lit(day)


def clamp_range(flows: DataFrame, start: int, end: int) -> tuple[int, int] | None:
    """First and last existing slot inside ``start .. end``; None without any."""
    row = (flows.where(F.col("slot").between(start, end))
           .agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")).first())
    return None if row.lo is None else (row.lo, row.hi)


def profile_split(flows: DataFrame, channels: dict[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """One row per flow and matching channel.

    A channel is a source list (empty for all) and a filter.
    """
    hits = []
    for name, (idents, cond) in sorted(channels.items()):
        if idents:
            cond = cond & F.col("ident").isin(*idents)
        hits.append(F.when(cond, F.lit(name)))
    return flows.withColumn("channel", F.explode(F.array(*hits))).where(F.col("channel").isNotNull())


def write_channels(flows: DataFrame, channels, path: str, mode: str = "append") -> None:
    """Write every channel's flows to its own partition in one pass."""
    parted = with_partitions(profile_split(flows, channels))
    parted.write.mode(mode).partitionBy("channel", "dt").parquet(path)


def channel_stats(flows: DataFrame, channels) -> DataFrame:
    """Slot statistics per channel."""
    from ..operators.aggregate import slot_stats
    return slot_stats(profile_split(flows, channels), by=("channel", "slot"))
