"""Traffic requests: Top-N queries, their result table and popularity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import request_filter
from ..operators.joins import filter_labels
from ..operators.topn import topn_by_step


@dataclass(frozen=True)
class TopnRequest:
    sortby: str = "ALL"
    orderby: str = "Bytes"
    srcdst: str = ""
    step: int = 300
    limit: int = 10
    ip: str = ""
    ip1: str = ""
    ip2: str = ""
    proto: int | None = None
    port: int | None = None
    port1: int | None = None
    port2: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def key(self) -> str:
        """Hash identifying the request in the result table."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def predicate(self, base: Column | None = None) -> Column:
        return request_filter(base, self.ip, self.ip1, self.ip2, self.proto, self.port, self.port1, self.port2)


def answer(flows: DataFrame, request: TopnRequest, labels: dict[str, Column] | None = None,
           base: Column | None = None) -> DataFrame:
    """Result rows of one request.  ``labels`` maps label names to predicates."""
    labels = labels or {}
    kept = filter_labels(flows.where(request.predicate(base)),
                         [labels[n] for n in request.include if n in labels],
                         [labels[n] for n in request.exclude if n in labels])
    return topn_by_step(kept, request.sortby, request.orderby, request.srcdst, request.step, request.limit)


def build_topn_cache(flows: DataFrame, requests: Sequence[TopnRequest],
                     labels: dict[str, Column] | None = None) -> DataFrame:
    """Rows of all requests, tagged with the request hash."""
    out = None
    for r in requests:
        rows = answer(flows, r, labels).withColumn("request", F.lit(r.key()))
        out = rows if out is None else out.unionByName(rows)
    return out


def lookup(cache: DataFrame, request: TopnRequest, start: int, end: int) -> DataFrame:
    return (cache.where((F.col("request") == request.key()) & (F.col("time") >= start) & (F.col("time") < end))
            .drop("request"))


def log_requests(log: DataFrame) -> DataFrame:
    """Request counts and latest request time per (request, slot).

    ``log`` has columns request, slot and at; repeats at the same second count once.
    """
    return log.groupBy("request", "slot").agg(F.count_distinct("at").alias("count"), F.max("at").alias("latest"))
