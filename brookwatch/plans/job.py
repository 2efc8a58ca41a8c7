"""Detection runs as jobs that write their results, and the requests that read them.

A run of one slot writes below its folder

    events/slot=<s>     events that no other slot has
    features/kind=<k>/slot=<s>, details/kind=<k>/slot=<s>     the rows of each detector
    topn/slot=<s>       the rows of the requests that are answered beforehand

Every part is written whole under its own slot, so a run that is repeated, or was cut off half way, leaves the same tables.
The flows of the slot are read from the flow table once and written beside the job; all detectors read that copy.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merges import new_rows
from ..rules import Window
from ..schema import DAY_SECONDS, EVENT_COLUMNS, EVENT_SCHEMA
from ..session import shared_dir
from .lifecycle import FEATURE_KEYS, expire_events, merge_features, query_event_details, query_features
from .requests import TopnRequest, build_topn_cache
from .run import KINDS, Config, all_events, run_detectors

PARTS = ("events", "features", "details", "topn")


def _put(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def run_slot(flows: DataFrame, cfg: Config, window: Window, out: str, requests: Sequence[TopnRequest] = (),
             parts: Sequence[str] = PARTS, only: Sequence[str] | None = None) -> None:
    """Run every enabled detector (or ``only`` some) over the window and write its results for the slot it starts."""
    spark, slot = flows.sparkSession, f"slot={window.start}"
    copy = f"{shared_dir(spark).rstrip('/')}/slot-{uuid.uuid4().hex}"
    window.clip(flows).drop("time").write.parquet(copy)
    held = spark.read.schema(flows.schema).parquet(copy)
    if only is not None:
        cfg = replace(cfg, enabled={k: k in only and cfg.enabled.get(k, True) for k in KINDS})
    found = run_detectors(held, cfg, window)
    for kind, detection in found.items():
        for part, rows in (("features", detection.features if "features" in parts else None),
                           ("details", detection.details if "details" in parts else None)):
            if rows is not None:
                _put(rows, f"{out}/{part}/kind={kind}/{slot}")
    if "events" in parts:
        events = all_events(found)
        fresh = spark.createDataFrame([], EVENT_SCHEMA) if events is None else events.select(*EVENT_COLUMNS)
        # what other slots have already reported is not reported again
        known = _events(spark, out).where(F.col("slot") != window.start).select(*EVENT_COLUMNS)
        _put(new_rows(known, fresh), f"{out}/events/{slot}")
    if "topn" in parts and requests:
        _put(build_topn_cache(held, requests), f"{out}/topn/{slot}")


def _events(spark: SparkSession, out: str) -> DataFrame:
    # the table is there, empty, before the first run
    spark.createDataFrame([], EVENT_SCHEMA).write.mode("ignore").parquet(f"{out}/events/slot=0")
    return spark.read.schema(f"{_ddl()}, slot bigint").parquet(f"{out}/events")


def _ddl() -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA)


def read_events(spark: SparkSession, out: str, now: int | None = None, ttl: int = DAY_SECONDS) -> DataFrame:
    """Events of all runs, with ``now`` those that have not expired; the slots of expired ones are not read."""
    events = _events(spark, out)
    if now is not None:
        events = expire_events(events.where(F.col("slot") >= now - ttl), now, ttl)
    return events.select(*EVENT_COLUMNS)


def drop_expired(spark: SparkSession, out: str, now: int, ttl: int = DAY_SECONDS) -> int:
    """Empty the slots of events that have expired; the number of slots."""
    old = [r.slot for r in _events(spark, out).where((F.col("slot") > 0) & (F.col("slot") < now - ttl)).select("slot").distinct().collect()]
    for slot in old:
        _put(spark.createDataFrame([], EVENT_SCHEMA), f"{out}/events/slot={slot}")
    return len(old)


def _of_kind(spark: SparkSession, out: str, part: str, kind: str) -> DataFrame:
    if kind not in FEATURE_KEYS and part == "features":
        raise ValueError(f"not a feature kind: {kind!r}")
    return spark.read.parquet(f"{out}/{part}/kind={kind}").drop("slot")


def hourly_features(spark: SparkSession, out: str, kind: str) -> DataFrame:
    """Features of one kind merged to hours."""
    return merge_features(None, _of_kind(spark, out, "features", kind), FEATURE_KEYS[kind])


def request_features(spark: SparkSession, out: str, kind: str, start: int, end: int, **fields) -> DataFrame:
    """Answer a feature request: the kind decides the key, the fields and how rows merge."""
    return query_features(hourly_features(spark, out, kind), kind, None, start, end, **fields)


def request_evidence(spark: SparkSession, out: str, kind: str, start: int, end: int, obj: str | None = None,
                     type_id: int | None = None) -> DataFrame:
    """Answer an evidence request of one kind of event."""
    return query_event_details(_of_kind(spark, out, "details", kind), start, end, obj, type_id)


def read_topn(spark: SparkSession, out: str, request: TopnRequest, start: int, end: int) -> DataFrame:
    """Rows of a request that was answered beforehand, of the runs that start in the range."""
    rows = spark.read.parquet(f"{out}/topn").where((F.col("slot") >= start) & (F.col("slot") < end))
    return rows.where(F.col("request") == request.key()).drop("request", "slot")
