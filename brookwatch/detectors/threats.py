"""Mining and packet-fingerprint threats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import addr_text
from ..functions.names import proto_name
from ..operators.joins import match_domain_intel
from ..operators.rulematch import Rules, each_rule
from ..rules import Window
from .base import RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, with_hour


def mining_flows(flows: DataFrame, domains: DataFrame, ips: DataFrame) -> DataFrame:
    """Flows tied to mining by fingerprint (model 3), name or address intel
    (model 2), oriented towards the pool, with coin and domain.

    ``domains`` has columns md5 and coin, ``ips`` columns ip and coin.
    """
    f = flows.where(F.col("prot").isin(6, 17))
    src, dst = F.col("srcaddr"), F.col("dstaddr")
    marked = f.where((F.upper("threat_type") == "MINING") & is_request()).withColumns(
        {"sip": src, "dip": dst, "coin": F.col("threat_name"), "domain": F.lit(""), "model": F.lit(3)})
    named = match_domain_intel(f.where(F.col("qname") != ""), domains.select("md5", "coin")).withColumns(
        {"sip": F.when(is_request(), src).otherwise(dst), "dip": F.when(is_request(), dst).otherwise(src),
         "domain": F.col("qname"), "model": F.lit(2)})
    pools = ips.groupBy("ip").agg(F.max("coin").alias("coin"))
    by_dst = pools.select(F.col("ip").alias("_d"), F.col("coin").alias("_dc"))
    by_src = pools.select(F.col("ip").alias("_s"), F.col("coin").alias("_sc"))
    listed = f.join(by_dst, dst == F.col("_d"), "left").join(by_src, src == F.col("_s"), "left")
    listed = listed.where(F.col("_d").isNotNull() | F.col("_s").isNotNull())
    to_dst = F.col("_d").isNotNull()
    listed = listed.withColumns(
        {"sip": F.when(to_dst, src).otherwise(dst), "dip": F.when(to_dst, dst).otherwise(src),
         "coin": F.when(to_dst, F.col("_dc")).otherwise(F.col("_sc")), "domain": F.lit(""),
         "model": F.lit(2)}).drop("_d", "_s", "_dc", "_sc")
    return marked.unionByName(named).unionByName(listed)


def detect_mining(flows: DataFrame, rules: Rules, domains: DataFrame, ips: DataFrame,
                  window: Window) -> Detection:
    f = mining_flows(window.clip(flows), domains, ips)
    key = [*RUN, "sip", "dip", "prot", "coin", "domain", "model"]
    agg = f.groupBy(*key).agg(*counters())
    hits = each_rule(agg, rules, F.lit(True), F.col("rule.qcount"), F.col("flows"), F.col("rule.data_type"), window)
    obj = joined(addr_text(f, "sip"), ":>", addr_text(f, "dip"), ": ", proto_name(), " ", F.col("coin"), " ",
                 F.col("domain"))
    tagged = events_of(hits, obj, F.col("model"), keep=key)
    return Detection(lambda: only_events(tagged), lambda: with_hour(agg.drop("time")),
                     lambda: details_of(f, tagged, key, extra=["domain"]))


def detect_threats(flows: DataFrame, rules: Rules, window: Window) -> Detection:
    """Fingerprinted threats from the initiator; mining swaps the ends of the
    printed object, the pool first."""
    f = window.clip(flows).where((F.col("threat_type") != "") & is_request()).withColumns(
        {"fp_type": F.lower("threat_type"), "fp_name": F.lower("threat_name")})
    key = [*RUN, "srcaddr", "prot", "dstaddr", "dstport", "fp_type", "fp_name"]
    agg = f.groupBy(*key).agg(*counters())
    hits = each_rule(agg, rules, F.lit(True), F.lit(0), F.col("flows"), F.lit("fps"), window)
    mining = F.col("fp_type") == "mining"
    a, b = addr_text(f, "srcaddr"), addr_text(f, "dstaddr")
    obj = joined(F.when(mining, b).otherwise(a), ":>", F.when(mining, a).otherwise(b), ":", F.col("dstport"), " ",
                 proto_name(), " ", F.col("fp_type"), " ", F.col("fp_name"))
    tagged = events_of(hits, obj, 3, keep=key)
    return Detection(lambda: only_events(tagged), lambda: with_hour(agg.drop("time")),
                     lambda: details_of(f, tagged, key, extra=["threat_version", "threat_time"]
                                if {"threat_version", "threat_time"} <= set(f.columns) else []))
