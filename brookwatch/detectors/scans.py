"""Port scan (one port, many hosts) and IP scan (one pair, many ports)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import addr_text
from ..functions.names import proto_name
from ..operators.rulematch import Rules, Selectors, best_rule, network, on_schedule, passes, pattern_rules, words
from ..rules import Pattern, Window, rule_table
from ..streaming.flowstreams import slot_peers
from .base import (RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, rule_values,
                   with_hour)


def _scan(flows: DataFrame, key, peer: str) -> DataFrame:
    """Counters and exact distinct peers per key.

    The distinct count is planned as two aggregations, first on (key, peer),
    so the peers of one busy key are spread over all tasks.
    """
    return flows.groupBy(*key).agg(*counters(), F.count_distinct(F.col(peer)).alias("peers"))


def _judge(scans, key, rules, selectors, obj, value_type, window) -> DataFrame:
    """Events of the scans whose rule is passed, with their key."""
    hits = best_rule(scans, rules, selectors).where(F.col("rule").isNotNull() & passes("peers") & on_schedule(window))
    return events_of(rule_values(hits, "peers", value_type), obj, 0, keep=key)


def _detect(flows, scans, key, rules, patterns, kind, selectors, obj, value_type, window) -> Detection:
    tagged = _judge(scans, key, rules, selectors, obj, value_type, window)

    def features() -> DataFrame:
        best = best_rule(scans, pattern_rules(patterns, kind, "peers"), selectors)
        return with_hour(best.where((F.col("peers") >= F.col("rule.min")) & (F.col("flows") >= F.col("rule.qcount")))
                         .drop("rule", "time"))

    return Detection(lambda: only_events(tagged), features, lambda: details_of(flows, tagged, key))


def _probes() -> Column:
    return (F.col("srcport") != 0) & (F.col("dstport") != 0) & ((F.col("prot") != 6) | is_request())


def _port_scan_terms(scans: DataFrame) -> tuple[Selectors, Column]:
    """Selectors and the printed object of port scans."""
    selectors = {"sip": network("srcaddr"),
                 "port": words(F.col("dstport"), normal=lambda text: text.cast("int").cast("string")),
                 "protocol": words(proto_name())}
    return selectors, joined(addr_text(scans, "srcaddr"), ":>:", F.col("dstport"), " ", proto_name(), " ")


def _by_source(rules: Rules) -> Rules:
    """Port-scan rules may name the source as ``ip``."""
    if isinstance(rules, DataFrame):
        table = rule_table(rules.sparkSession, rules)
        return table.withColumn("sip", F.when(F.col("sip") == "", F.col("ip")).otherwise(F.col("sip")))
    return [replace(r, sip=r.sip or r.ip) for r in rules]


def detect_port_scan(flows: DataFrame, rules: Rules, patterns: Sequence[Pattern],
                     window: Window) -> Detection:
    f = window.clip(flows).where(_probes())
    key = [*RUN, "srcaddr", "prot", "dstport"]
    selectors, obj = _port_scan_terms(f)
    return _detect(f, _scan(f, key, "dstaddr"), key, _by_source(rules), patterns, "PORT_SCAN", selectors, obj, "peerips", window)


def closing_port_scans(flows: DataFrame) -> DataFrame:
    """The scans of each slot of a stream of flows with event time, when the slot has closed."""
    return slot_peers(flows.where(_probes()), ["devid", "srcaddr", "prot", "dstport"], "dstaddr")


def port_scan_events(scans: DataFrame, rules: Rules, window: Window) -> DataFrame:
    """Events of the scans of closed slots."""
    selectors, obj = _port_scan_terms(scans)
    return only_events(_judge(scans, [], _by_source(rules), selectors, obj, "peerips", window))


def detect_ip_scan(flows: DataFrame, rules: Rules, patterns: Sequence[Pattern],
                   window: Window) -> Detection:
    f = window.clip(flows).where((F.col("srcport") != 0) & (F.col("dstport") != 0) & (F.col("prot") != 17)
                                 & ((F.col("prot") != 6) | is_request()))
    key = [*RUN, "srcaddr", "dstaddr", "prot"]
    scans = _scan(f, key, "dstport")
    selectors = {"sip": network("srcaddr"), "dip": network("dstaddr"), "protocol": words(proto_name())}
    obj = joined(addr_text(f, "srcaddr"), ":>", addr_text(f, "dstaddr"), ": ", proto_name(), " ")
    return _detect(f, scans, key, rules, patterns, "IP_SCAN", selectors, obj, "peerports", window)
