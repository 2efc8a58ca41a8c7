"""Streams of flow slots.

Every transform takes a streaming frame and returns one, and gives the same
rows on a batch frame.  ``run_available`` drives a query over all files present
and leaves its updates in a table in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import is_request
from ..session import shared_dir

LATENESS = "10 minutes"


def event_time(flows: DataFrame, column: str = "first", lateness: str = LATENESS) -> DataFrame:
    """Add ``ts`` from an epoch column and set the watermark on it."""
    return flows.withColumn("ts", F.timestamp_seconds(column)).withWatermark("ts", lateness)


def read_flow_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None,
                     glob: str | None = None) -> DataFrame:
    """File stream of flow slots."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _counters() -> list[Column]:
    return [F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("flows"),
            F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")]


def window_start(name: str = "window") -> Column:
    return F.unix_seconds(F.col(f"{name}.start").cast("timestamp"))


def slot_counters(flows: DataFrame, key: Sequence[str], width: str = "5 minutes") -> DataFrame:
    """Counters per tumbling window and key; ``time`` is the window start."""
    agg = flows.groupBy(F.window("ts", width), *key).agg(*_counters())
    return agg.withColumn("time", window_start()).drop("window")


def slot_peers(flows: DataFrame, key: Sequence[str], peer: str, width: str = "5 minutes") -> DataFrame:
    """Counters and exact distinct peers per slot and key, given out when the slot has closed (append mode).

    The state is a row per slot, key and peer, kept until the watermark has passed the slot, so it does not matter over
    how many batches, or restarts, the flows of a slot arrive.  A second aggregation counts the peers of closed slots; both
    are spread over (key, peer) and key.  ``time`` is the slot's start.
    """
    pairs = flows.groupBy(F.window("ts", width), *key, peer).agg(*_counters())
    closed = pairs.withColumn("slot_ts", F.window_time("window")).drop("window")
    agg = closed.groupBy(F.window("slot_ts", width), *key).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("flows").alias("flows"), F.sum("pkts").alias("pkts"),
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("peers"))
    return agg.withColumn("time", window_start()).drop("window")


def hourly_features(flows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counters per hour and key, the streaming form of the hourly merge."""
    return slot_counters(flows, key, "1 hour").withColumnRenamed("time", "hour")


def sessions(flows: DataFrame, key: Sequence[str], gap: int = 3600) -> DataFrame:
    """Counters per key and session.

    A flow reaches to its end plus the gap (touching windows merge), so sessions merge the same rows as
    the batch interval merge.
    """
    reach = (F.col("last") - F.col("first") + F.lit(gap)).cast("string")
    width = F.concat(reach, F.lit(" seconds"))
    agg = flows.groupBy(*key, F.session_window("ts", width)).agg(*_counters())
    return agg.drop("session_window")


def sliding_ports(flows: DataFrame, width: str = "24 hours", slide: str = "5 minutes") -> DataFrame:
    """Port totals of the sliding window ending with each slot (append mode).

    Flows are first summed per slot, so only slot rows are spread over the
    windows that hold them.
    """
    slots = (flows.where(F.col("prot").isin(6, 17)).groupBy(F.window("ts", slide), "prot", "dstport")
             .agg(F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")))
    timed = slots.withColumn("slot_ts", F.window_time("window")).drop("window")
    agg = (timed.groupBy(F.window("slot_ts", width, slide), "prot", "dstport")
           .agg(F.sum("flows").alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")))
    last_slot = F.unix_seconds(F.col("window.end").cast("timestamp")) - 300
    return agg.withColumn("slot", last_slot).drop("window")


def dedup_events(events: DataFrame, columns: Sequence[str], horizon: str = "24 hours") -> DataFrame:
    """Exact repeats inside the horizon dropped (streaming state expires with it)."""
    timed = events.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", horizon)
    if events.isStreaming:
        return timed.dropDuplicatesWithinWatermark(list(columns)).drop("ts")
    return timed.dropDuplicates(list(columns)).drop("ts")


def _digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 of the values; each stands with its length before it, or a mark if it is null, so no two rows read alike."""
    texts = [F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (T.ArrayType, T.StructType)) else F.col(c).cast("string")
             for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def drop_repeats(flows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of every flow, repeated deliveries dropped: rows that are alike in all columns.

    What is shuffled and held as state until the watermark has passed is a digest of a flow, whatever its columns.
    """
    return (flows.select(*keep, "ts", _digest(flows, [c for c in flows.columns if c != "ts"]).alias("_digest"))
            .dropDuplicates(["ts", "_digest"]).select(*keep))


PAIR_KEY = ["sip", "dip", "sport", "dport", "code"]


def _slot_sides(flows: DataFrame, request: bool, name: str, lateness: str) -> DataFrame:
    """Distinct (endpoints, return code, slot) of one direction, from the
    requester's point of view."""
    a, b = ("src", "dst") if request else ("dst", "src")
    side = flows.where((F.col("prot") == 6) & (is_request() if request else ~is_request())).select(
        F.col(f"{a}addr").alias("sip"), F.col(f"{b}addr").alias("dip"), F.col(f"{a}port").alias("sport"),
        F.col(f"{b}port").alias("dport"), F.col("http_ret_code").alias("code"),
        F.timestamp_seconds(F.col("first") - F.col("first") % 300).alias(name))
    return side.withWatermark(name, lateness).dropDuplicates([*PAIR_KEY, name])


def pair_slots(requests: DataFrame, responses: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Requests per slot joined with responses of the same or the next slot.

    Both sides hold one row per endpoints and slot, so a request meets at most
    two responses; unanswered requests come out with a null ``res_slot``.
    """
    req = _slot_sides(requests, True, "req_slot", lateness)
    res = _slot_sides(responses, False, "res_slot", lateness)
    res = res.select(*[F.col(k).alias(f"_{k}") for k in PAIR_KEY], "res_slot")
    cond = (F.col("res_slot") >= F.col("req_slot")) & (
        F.col("res_slot") <= F.col("req_slot") + F.expr("INTERVAL 5 MINUTES"))
    for k in PAIR_KEY:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return req.join(res, cond, "left").drop(*[f"_{k}" for k in PAIR_KEY])


def split_late(flows: DataFrame, arrived: Column, lateness_seconds: int = 600) -> tuple[DataFrame, DataFrame]:
    """(on-time, late) flows by arrival against the start of the flow's slot end."""
    due = F.col("first") - F.col("first") % 300 + 300 + lateness_seconds
    late = arrived > due
    return flows.where(~late), flows.where(late)


def split_arrivals(stream: DataFrame, deliveries: Iterable[Callable[[], None]], due: Column | None = None,
                   lateness_seconds: int = 600, handle: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                   base: str | None = None) -> DataFrame:
    """Every flow of a stream with ``late``: whether its slot (or ``due``) was over when it arrived.

    A batch holds late what is due no later than the largest start of all batches before, less the lateness: the rule by
    which the watermark drops rows.  Each batch writes its rows, split by ``late``, and the largest start so far under its
    own id, so a batch that is repeated after a failure decides and overwrites the same.  ``deliveries`` are called in
    turn, and the stream is run to its end after each.  ``handle`` makes the rows to keep of those of a batch; a call with
    the ``base`` folder of an earlier one goes on where that ended and returns the rows of both.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    due = F.col("first") - F.col("first") % 300 + 300 if due is None else due

    def mark(batch_id: int) -> int | None:
        return spark.read.parquet(f"{base}/marks/batch={batch_id}").first().reached if batch_id >= 0 else None

    def save(batch: DataFrame, batch_id: int) -> None:
        before = mark(batch_id - 1)
        late = F.lit(False) if before is None else due <= before - lateness_seconds
        rows = handle(batch.withColumn("late", late))
        rows.write.mode("overwrite").partitionBy("late").parquet(f"{base}/rows/batch={batch_id}")
        reached = F.greatest(F.max("first"), F.lit(before).cast("bigint")).alias("reached")
        batch.agg(reached).write.mode("overwrite").parquet(f"{base}/marks/batch={batch_id}")

    for deliver in deliveries:
        deliver()
        (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
         .foreachBatch(save).start().awaitTermination())
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())])
    return spark.read.schema(schema).parquet(f"{base}/rows").drop("batch")


def run_deliveries(stream: DataFrame, deliveries: Iterable[Callable[[], None]],
                   handle: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, int]:
    """The rows an append-mode stream gives out over a number of runs, and how many rows its watermark dropped.

    ``handle`` makes the rows to keep of those that a batch gives out, such as the events of the slots that it closed.
    Before each run one delivery of files is made; every run goes on from the checkpoint of the one before.  The dropped
    rows are those that the state operators report in the progress of the runs.
    """
    spark = stream.sparkSession
    base, dropped = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", 0

    def save(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    for deliver in deliveries:
        deliver()
        query = (stream.writeStream.outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", f"{base}/checkpoint").foreachBatch(save).start())
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.parquet(f"{base}/rows").drop("batch"), dropped


def run_available(stream: DataFrame, key: Sequence[str] = (), mode: str = "update") -> DataFrame:
    """Process everything available and return the result rows: the latest per
    key in update mode, all in append mode, the last batch in complete mode.

    Each batch writes its updates under its own batch id (a repeated batch
    overwrites itself), and checkpoint and table live in the shared folder.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    (stream.writeStream.outputMode(mode).trigger(availableNow=True)
     .option("checkpointLocation", f"{base}/checkpoint").foreachBatch(save).start().awaitTermination())
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{base}/rows")
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("b")).first().b
        return rows.where(F.col("batch") == last).drop("batch")
    rest = [c for c in stream.columns if c not in key]
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return latest.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch to ``handle`` until all files are processed."""
    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
     .foreachBatch(handle).start().awaitTermination())
