"""DNS detectors: intel hits, generated names, tunnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import addr_text
from ..functions.text import base_domain, char_entropy, is_domain, sub_label, top_label
from ..operators.joins import drop_whitelisted, match_domain_intel
from ..operators.merges import first_seen
from ..operators.rulematch import Rules, each_rule, first_rule, network, on_schedule, with_values, words
from ..rules import Window, rule_table
from .base import RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, recount, with_hour
from .scoring import Scorer, default_name_scorer

# Query types a tunnel may use (A, CNAME, NULL, MX, TXT), shortest
# name considered, and the label of a known tunnel tool.
TUNNEL_QTYPES = (1, 5, 10, 15, 16)
TUNNEL_MIN_LENGTH = 20
TOOL_LABEL = "dnscat"


def detect_dns_intel(flows: DataFrame, rules: Rules, intel: DataFrame, window: Window) -> Detection:
    """Requested names per (source, server, name, type), classed by intel.

    ``intel`` has columns md5 and class.
    """
    f = window.clip(flows).where(is_request() & (F.col("qname") != "") & is_domain())
    key = [*RUN, "srcaddr", "dstaddr", "qname", "qtype"]
    agg = match_domain_intel(f.groupBy(*key).agg(*counters()), intel.select("md5", F.col("class").alias("_class")),
                             "left")
    agg = agg.withColumn("known", F.col("_class").isNotNull()).withColumn(
        "class", F.coalesce("_class", F.lit(""))).drop("_class")

    # a rule names domains, or takes the known ones
    named = F.col("known") | (F.trim("rule.qname") != "")
    hits = each_rule(agg, rules, (F.col("flows") > F.col("rule.qcount")) & named, F.col("rule.qcount"), F.col("flows"),
                     F.col("rule.data_type"), window,
                     {"ip": network("srcaddr", listed=True), "qname": words(F.col("qname"), listed=True)})
    obj = joined(addr_text(f, "srcaddr"), ":>", addr_text(f, "dstaddr"), ": ", F.col("class"), " ", F.col("qname"))
    tagged = events_of(hits, obj, 2, keep=key)
    return Detection(lambda: only_events(tagged), lambda: with_hour(agg.drop("known", "time")),
                     lambda: details_of(f, tagged, key, extra=["qname", "qtype"]))


def _scored(f, rules: Rules, white, scorer, window, floor_count: Column, thres: Column) -> Detection:
    """Per-name scores; the first rule (in id order) a name satisfies takes it."""
    key = [*RUN, "srcaddr", "dstaddr", "qname"]
    names = f.groupBy(*key).agg(*counters())
    if white is not None:
        names = drop_whitelisted(names, white, F.col("qname"), top_label())
    scored = scorer(names, "qname")
    lowest = rule_table(f.sparkSession, rules).agg(F.min("min")).scalar()
    above = F.coalesce(F.col("score") > lowest, F.lit(False))
    picked = first_rule(scored, rules, F.col("score") > F.col("rule.min"),
                        {"sip": network("srcaddr", listed=True), "dip": network("dstaddr", listed=True)})
    pair = [*RUN, "srcaddr", "dstaddr", "rule"]
    sums = picked.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("names"), F.max_by("score", "qname").alias("last_score"), *recount())
    due = sums.where(on_schedule(window) & (F.col("names") > floor_count))
    hits = with_values(due, thres, F.col("last_score"), F.col("rule.data_type")).withColumn("_rule", F.col("config_id"))
    obj = joined(addr_text(f, "srcaddr"), ":>", addr_text(f, "dstaddr"), ":  ")
    tagged = events_of(hits, obj, 1, keep=[*RUN, "srcaddr", "dstaddr", "_rule"])

    def details() -> DataFrame:
        behind = f.join(picked.select(*key, F.col("rule.config_id").alias("_rule")), key)
        return details_of(behind, tagged, [*RUN, "srcaddr", "dstaddr", "_rule"], extra=["qname"])

    return Detection(lambda: only_events(tagged), lambda: with_hour(scored.where(above).drop("time")), details)


def detect_dga(flows: DataFrame, rules: Rules, white: DataFrame, window: Window,
               scorer: Scorer = default_name_scorer) -> Detection:
    """Machine-generated names: more than ``qcount`` high-score names per pair."""
    f = window.clip(flows).where((F.col("prot") == 17) & is_request() & (F.col("qname") != "") & is_domain())
    return _scored(f, rules, white, scorer, window, F.col("rule.qcount"), F.col("rule.min"))


def detect_dns_tunnel_scored(flows: DataFrame, rules: Rules, window: Window,
                             scorer: Scorer = default_name_scorer) -> Detection:
    """Tunnel names by score: any high-score name per pair and rule."""
    f = window.clip(flows).where((F.col("prot") == 17) & is_request() & (F.col("qname") != "") & is_domain())
    return _scored(f, rules, None, scorer, window, F.lit(0), F.col("rule.qcount"))


def detect_dns_tunnel(flows: DataFrame, rules: Rules, white: DataFrame, window: Window) -> Detection:
    """Tunnel names by entropy of names seen once per run."""
    f = window.clip(flows).where((F.col("prot") == 17) & (F.col("dstport") == 53)
                                 & F.col("qtype").isin(*TUNNEL_QTYPES)
                                 & (F.octet_length("qname") >= TUNNEL_MIN_LENGTH))
    cols = [*RUN, "qname", "first", "msec_first", "srcaddr", "dstaddr", "srcport", "last", "pkts", "bytes",
            "qtype", "dstport", "prot"]
    seen = first_seen(f.select(*cols), "qname", run=RUN)
    named = drop_whitelisted(seen, white, sub_label(), base_domain())
    named = named.withColumns({
        "domain": F.when(sub_label() == TOOL_LABEL, TOOL_LABEL).otherwise(base_domain()),
        "entropy": char_entropy()})
    key = [*RUN, "srcaddr", "dstaddr", "domain"]
    # entropies are compared with whole numbers: names are counted by the largest whole number below theirs
    level = F.ceil("entropy") - 1
    agg = (named.groupBy(*key, level.alias("_level")).agg(*counters()).groupBy(*key)
           .agg(*recount(), F.collect_list(F.struct("_level", "flows")).alias("_levels")))
    above = F.aggregate("_levels", F.lit(0).cast("bigint"),
                        lambda n, x: n + F.when(x["_level"] >= F.col("rule.detvalue"), x["flows"]).otherwise(0))
    tool = F.col("domain") == TOOL_LABEL
    hits = each_rule(agg, rules, tool | (above > F.col("rule.fqcount")), F.col("rule.detvalue"),
                     F.when(tool, F.col("flows")).otherwise(above), F.col("rule.data_type"), window,
                     {"ip": network("srcaddr", listed=True)})
    obj = joined(addr_text(f, "srcaddr"), ":>", addr_text(f, "dstaddr"), ": TUN ", F.col("domain"))
    tagged = events_of(hits, obj, 0, keep=key)
    features = agg.drop("time", "_levels")
    return Detection(lambda: only_events(tagged), lambda: with_hour(features),
                     lambda: details_of(named, tagged, key, extra=["qname", "qtype"]))
