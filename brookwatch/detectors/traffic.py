"""Server outreach, listed addresses and monitored-object thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import addr_text
from ..functions.names import proto_name
from ..functions.timefn import slot, truncate
from ..operators.joins import match_ip_list, match_mo
from ..operators.ranges import mark_nets
from ..operators.rulematch import Rules, each_rule, network, on_schedule, with_values, words
from ..rules import MonitoredObject, Window, rule_table
from ..schema import HOUR_SECONDS
from .base import (RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, recount,
                   with_hour)


def detect_outreach(flows: DataFrame, rules: Rules, assets: DataFrame, window: Window) -> Detection:
    """Internal hosts sending at least ``min`` bytes outward.

    A rule without a source list uses the asset networks (column cidr); one
    without a destination list takes any destination.
    """
    f = window.clip(flows).where((F.col("prot") == 6) & is_request())
    key = [*RUN, "srcaddr", "dstaddr", "dstport"]
    agg = f.groupBy(*key).agg(*counters())
    inside = F.col("_asset") | (F.trim("rule.sip") != "")
    hits = each_rule(mark_nets(agg, "srcaddr", assets, "_asset"), rules, inside & (F.col("bytes") >= F.col("rule.min")),
                     F.col("rule.min"), F.col("bytes"), F.col("rule.data_type"), window,
                     {"sip": network("srcaddr", listed=True), "dip": network("dstaddr", listed=True)})
    obj = joined(addr_text(f, "srcaddr"), ":>", addr_text(f, "dstaddr"), ":", F.col("dstport"), " TCP ")
    tagged = events_of(hits, obj, 0, keep=key)
    return Detection(lambda: only_events(tagged), None, lambda: details_of(f.withColumn("prot", F.lit(6)), tagged, key))


def rate(measure: str, window: Window) -> Column:
    """Whole units per second of a counter over the run interval."""
    return F.col(measure) / F.lit(float(window.interval))


def unit_rate(units: dict[str, str], window: Window) -> Column:
    """The rate in the unit of ``rule``; null for a unit it does not know."""
    out = F.lit(None).cast("double")
    for unit, measure in units.items():
        out = F.when(F.col("rule.data_type") == unit, rate(measure, window)).otherwise(out)
    return out


def listed_traffic(flows: DataFrame, ips: DataFrame, window: Window) -> DataFrame:
    """Counters per (listed address, peer, protocol, ti_mark).

    Flows are combined per address pair before the list lookup, so the lookup
    handles pairs instead of flows.
    """
    f = window.clip(flows)
    pairs = (f.where((F.col("prot") != 6) | is_request())
             .groupBy(*RUN, "srcaddr", "dstaddr", "prot").agg(*counters()).withColumn("tos", F.lit(1)))
    hits = match_ip_list(pairs, ips)
    return hits.groupBy(*RUN, "sip", "dip", "prot", "ti_mark", "class").agg(*recount())


def listed_features(flows: DataFrame, ips: DataFrame, window: Window) -> Detection:
    """Features of the traffic of listed addresses, such as popular or white-listed ones, which make no events."""
    return Detection(features=lambda: with_hour(listed_traffic(flows, ips, window).drop("time")))


def _listed(flows, ips, rules: Rules, window, units, with_class) -> Detection:
    agg = listed_traffic(flows, ips, window)

    v = unit_rate(units, window)
    # rules without a unit, or with another one, match nothing
    over = F.col("ti_mark") & (v >= F.col("rule.min")) & ((F.col("rule.max") == 0) | (v < F.col("rule.max")))
    hits = each_rule(agg, rules, over, F.col("rule.min"), F.floor(v), F.col("rule.data_type"), window,
                     {"data_type": words(*map(F.lit, units))})
    parts = [addr_text(agg, "sip"), ":>", addr_text(agg, "dip"), ": ", proto_name(), " "]
    obj = joined(*parts, *([F.col("class")] if with_class else []))
    key = [*RUN, "sip", "dip", "prot", "ti_mark"]
    tagged = events_of(hits, obj, 2, keep=key)
    return Detection(lambda: only_events(tagged), lambda: with_hour(agg.drop("time")),
                     lambda: details_of(match_ip_list(window.clip(flows), ips), tagged, key))


def detect_suspicious(flows: DataFrame, ips: DataFrame, rules: Rules, window: Window) -> Detection:
    """Traffic from listed suspicious addresses; rates in Bps, pps or fps."""
    return _listed(flows, ips, rules, window, {"Bps": "bytes", "pps": "pkts", "fps": "flows"}, True)


def detect_black_list(flows: DataFrame, ips: DataFrame, rules: Rules, window: Window) -> Detection:
    """Traffic from black-listed addresses; rates in bps (bytes), pps or sps."""
    return _listed(flows, ips, rules, window, {"bps": "bytes", "pps": "pkts", "sps": "flows"}, False)


def detect_object_thresholds(flows: DataFrame, mos: Sequence[MonitoredObject], rules: Rules,
                             window: Window) -> Detection:
    """Rate thresholds on monitored objects.

    IN objects report (source, destination, destination port), OUT objects the
    reverse; ALL objects report nothing.  ``max`` is tried first, then ``min``;
    zero means unset.
    """
    f = match_mo(window.clip(flows), [m for m in mos if m.direction in ("IN", "OUT")])
    inward = F.col("direction") == "IN"
    f = f.withColumns({"lip": F.when(inward, F.col("srcaddr")).otherwise(F.col("dstaddr")),
                       "tip": F.when(inward, F.col("dstaddr")).otherwise(F.col("srcaddr")),
                       "tport": F.when(inward, F.col("dstport")).otherwise(F.col("srcport"))})
    key = [*RUN, "moid", "lip", "tip", "tport", "prot"]
    table = rule_table(flows.sparkSession, rules)
    limits = table.select("moid", F.struct("*").alias("rule"))
    # only flows of objects that have a rule
    agg = f.join(table.select("moid").distinct(), "moid", "left_semi").groupBy(*key).agg(*counters()).join(limits, "moid")
    v = unit_rate({"Bps": "bytes", "pps": "pkts", "fps": "flows"}, window)
    high = (F.col("rule.max") != 0) & (v >= F.col("rule.max"))
    hit = high | ((F.col("rule.min") != 0) & (v >= F.col("rule.min")))
    hits = with_values(agg.where(hit & on_schedule(window)), F.when(high, F.col("rule.max")).otherwise(F.col("rule.min")),
                       F.floor(v), F.col("rule.data_type"))
    obj = joined(addr_text(f, "tip"), ":", F.col("tport"), ">", addr_text(f, "lip"), ": ", proto_name(), " ",
                 F.col("moid"))
    tagged = events_of(hits, obj, 3, keep=key)
    return Detection(lambda: only_events(tagged), None, lambda: details_of(f, tagged, key))


def object_traffic(flows: DataFrame, mos: Sequence[MonitoredObject]) -> DataFrame:
    """Hourly counters per monitored object with the peaks of its slots."""
    f = match_mo(flows.withColumn("slot", slot()), mos)
    slots = f.groupBy("devid", "moid", "slot").agg(*counters())
    return (slots.groupBy("devid", "moid", truncate("slot", HOUR_SECONDS).alias("hour"))
            .agg(*recount(), F.max("flows").alias("peak_flows"), F.max("pkts").alias("peak_pkts"),
                 F.max("bytes").alias("peak_bytes")))
