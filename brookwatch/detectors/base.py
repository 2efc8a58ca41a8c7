"""Shared pieces of the detectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import truncate
from ..operators.joins import is_request  # noqa: F401  (shared by the detectors)
from ..schema import EVENT_COLUMNS, FIVE_TUPLE, HOUR_SECONDS

RUN = ["time", "devid"]


Part = DataFrame | Callable[[], DataFrame] | None


class Detection:
    """Outputs of one detector; parts it does not have are None.

    A part is given as a frame or as a function that plans it, so asking for
    the events alone plans neither features nor evidence.
    """

    def __init__(self, events: Part = None, features: Part = None, details: Part = None):
        self._parts = {"events": events, "features": features, "details": details}

    def _get(self, name: str) -> DataFrame | None:
        part = self._parts[name]
        return part() if callable(part) else part

    @cached_property
    def events(self) -> DataFrame | None:
        return self._get("events")

    @cached_property
    def features(self) -> DataFrame | None:
        return self._get("features")

    @cached_property
    def details(self) -> DataFrame | None:
        return self._get("details")


def counters() -> list[Column]:
    return [F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("flows"),
            F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")]


def recount() -> list[Column]:
    """Counters of rows that already carry counters."""
    return [F.min("first").alias("first"), F.max("last").alias("last"), F.sum("flows").alias("flows"),
            F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")]


def joined(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def events_of(hits: DataFrame, obj: Column, model_id, keep=()) -> DataFrame:
    """Event rows of hits that carry rule ids and values; ``keep`` retains key
    columns for evidence joins."""
    model = F.lit(model_id) if isinstance(model_id, int) else model_id
    return hits.select(
        F.col("time").cast("bigint").alias("time"), F.col("type_id").cast("int").alias("type_id"),
        F.col("config_id").cast("int").alias("config_id"), F.col("devid").cast("int").alias("devid"),
        obj.alias("obj"), F.col("thres_value").cast("bigint").alias("thres_value"),
        F.col("alarm_value").cast("bigint").alias("alarm_value"), F.col("value_type"),
        model.cast("int").alias("model_id"), *[F.col(k).alias(f"_{k}") for k in keep])


def rule_values(hits: DataFrame, measure: str, value_type: str) -> DataFrame:
    """Event values of hits matched by ``best_rule``."""
    return hits.select("*", F.col("rule.config_id").alias("config_id"), F.col("rule.type_id").alias("type_id"),
                       F.col("rule.min").alias("thres_value"), F.col(measure).alias("alarm_value"),
                       F.lit(value_type).alias("value_type"))


def only_events(tagged: DataFrame) -> DataFrame:
    return tagged.select(*EVENT_COLUMNS)


def details_of(flows: DataFrame, tagged: DataFrame, key, extra=()) -> DataFrame:
    """Evidence: five-tuple counters of the flows behind each event.

    ``flows`` carries the detector key columns; ``tagged`` are events with the
    key kept under a leading underscore.
    """
    key = list(key)
    tuples = [c for c in FIVE_TUPLE if c not in key]
    grouped = flows.groupBy(*key, *tuples, *[c for c in extra if c not in key]).agg(*counters())
    hits = tagged.select(*[F.col(f"_{k}").alias(f"_k_{k}") for k in key],
                         *[F.col(c).alias(f"event_{c}") for c in ("time", "type_id", "model_id", "obj")]).distinct()
    cond = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}")) if k.startswith("coin") else F.col(k) == F.col(f"_k_{k}")
        cond = c if cond is None else cond & c
    rows = grouped.join(hits, cond)
    return rows.select(F.col("event_time").alias("time"), F.col("event_type_id").alias("type_id"),
                       F.col("event_model_id").alias("model_id"), F.col("event_obj").alias("obj"),
                       *FIVE_TUPLE, *extra, "first", "last", "flows", "pkts", "bytes")


def with_hour(features: DataFrame) -> DataFrame:
    return features.withColumn("hour", truncate("first", HOUR_SECONDS))
