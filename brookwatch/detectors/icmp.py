"""ICMP tunnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import addr_text
from ..functions.names import icmp_type
from ..operators.rulematch import Rules, each_rule, network
from ..rules import Window
from .base import RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, with_hour

# Payloads ordinary ping tools send.
PING_ALPHABETS = ("abcdefghijklmnopqrstuvw", "!\"#$%&'()+,-./01234567", "ABCDEFGHIJKLMNOPQRSTUVW")


def tunnel_flows(flows: DataFrame) -> DataFrame:
    """ICMP flows with an unusual payload, oriented from the requester."""
    data = F.col("icmp_data")
    size = F.length(data)
    dots = size - F.length(F.replace(data, F.lit("."), F.lit("")))
    f = flows.where((F.col("prot") == 1) & ~data.rlike("^A*$") & (dots < size - 2))
    for alphabet in PING_ALPHABETS:
        f = f.where(~F.contains(data, F.lit(alphabet)))
    return f.withColumns({
        "sip": F.when(is_request(), F.col("srcaddr")).otherwise(F.col("dstaddr")),
        "dip": F.when(is_request(), F.col("dstaddr")).otherwise(F.col("srcaddr")),
        "icmp_type": icmp_type()})


def detect_icmp_tunnel(flows: DataFrame, rules: Rules, window: Window) -> Detection:
    """Event when abnormal types carry more than ``if1`` payloads, or some
    sequence number has more replies than requests or more than ``if2``
    payloads, or more than ``if3`` payload lengths occur."""
    f = tunnel_flows(window.clip(flows))
    key = [*RUN, "sip", "dip"]
    abnormal = ~F.col("icmp_type").isin(0, 8)
    agg = f.groupBy(*key).agg(
        *counters(), F.count_distinct(F.when(abnormal, F.col("icmp_data"))).alias("odd_payloads"),
        F.count_distinct("icmp_payload_len").alias("lengths"))
    per_seq = f.groupBy(*key, "icmp_seq_num").agg(
        F.sum(F.when(is_request(), 1).otherwise(0)).alias("req"),
        F.sum(F.when(is_request(), 0).otherwise(1)).alias("rep"),
        F.count_distinct("icmp_data").alias("payloads"))
    both = (F.col("req") > 0) & (F.col("rep") > 0)
    seqs = per_seq.groupBy(*key).agg(
        F.max(F.when(both & (F.col("req") < F.col("rep")), 1).otherwise(0)).alias("more_replies"),
        F.max(F.when(both, F.col("payloads")).otherwise(0)).alias("seq_payloads"))
    agg = agg.join(seqs, key)

    tunnel = ((F.col("odd_payloads") > F.col("rule.if1")) | (F.col("more_replies") == 1)
              | (F.col("seq_payloads") > F.col("rule.if2")) | (F.col("lengths") > F.col("rule.if3")))
    hits = each_rule(agg, rules, tunnel, F.col("rule.min"), F.col("lengths"), F.col("rule.data_type"), window,
                     {"sip": network("sip", listed=True), "dip": network("dip", listed=True)})
    obj = joined(addr_text(f, "sip"), ":>", addr_text(f, "dip"), ":  ")
    tagged = events_of(hits, obj, 0, keep=key)
    features = with_hour(agg.select("devid", "sip", "dip", "first", "last", "flows", "pkts", "bytes"))
    return Detection(lambda: only_events(tagged), lambda: features,
                     lambda: details_of(f, tagged, key, extra=["icmp_type", "icmp_data"]))
