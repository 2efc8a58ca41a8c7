"""Flow aggregation, direction handling, slot statistics and histograms."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import mask_v4
from ..functions.numeric import idiv, mpls_label
from ..functions.timefn import slot
from ..schema import FIVE_TUPLE

# Aggregation field names and the columns they group by.
FIELDS = {
    "srcip": "srcaddr", "dstip": "dstaddr", "srcport": "srcport", "dstport": "dstport",
    "next": "ip_nexthop", "bgpnext": "bgp_nexthop", "router": "ip_router",
    "insrcmac": "in_src_mac", "outdstmac": "out_dst_mac", "indstmac": "in_dst_mac",
    "outsrcmac": "out_src_mac", "srcas": "srcas", "dstas": "dstas", "nextas": "next_as",
    "prevas": "prev_as", "inif": "input", "outif": "output", "srcvlan": "src_vlan",
    "dstvlan": "dst_vlan", "srcmask": "src_mask", "dstmask": "dst_mask", "proto": "prot",
    "tos": "tos", "srctos": "tos", "dsttos": "dst_tos",
}


def ms(sec: str, msec: str) -> Column:
    return (F.col(sec) * 1000 + F.col(msec)).cast("bigint")


def group_key(df: DataFrame, name: str) -> Column:
    """Grouping column of an aggregation field name or a plain column name."""
    if name in FIELDS:
        return F.col(FIELDS[name]).alias(name)
    if name in ("srcnet", "dstnet"):
        side = name[:3]
        return mask_v4(f"{side}addr", F.col(f"{side}_mask")).alias(name)
    m = re.fullmatch(r"(src|dst)ip4/(\d+)", name)
    if m:
        return mask_v4(f"{m[1]}addr", int(m[2])).alias(f"{m[1]}ip4")
    m = re.fullmatch(r"(src|dst)ip6/(\d+)", name)
    if m:
        from .ranges import mask_v6
        return mask_v6(f"{m[1]}addr", int(m[2])).alias(f"{m[1]}ip6")
    m = re.fullmatch(r"mpls(\d+)", name)
    if m:
        return mpls_label(int(m[1])).alias(name)
    return F.col(name)


def _span() -> list[Column]:
    return [F.min(ms("first", "msec_first")).alias("first_ms"), F.max(ms("last", "msec_last")).alias("last_ms")]


def _flow_count(df: DataFrame) -> Column:
    """Flows of a record: its own aggregate count, or one."""
    if "aggr_flows" not in df.columns:
        return F.lit(1).cast("bigint")
    return F.when(F.col("aggr_flows") > 0, F.col("aggr_flows")).otherwise(F.lit(1))


def _out(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(0).cast("bigint")


def aggregate_flows(flows: DataFrame, by=None, bidir: bool = False) -> DataFrame:
    """Aggregate flows by the five-tuple, by any fields, or bidirectionally."""
    if bidir:
        return bidir_flows(flows)
    keys = [group_key(flows, k) for k in (by or FIVE_TUPLE)]
    return flows.groupBy(*keys).agg(
        *_span(),
        F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"),
        F.sum(_out(flows, "out_pkts")).alias("out_pkts"), F.sum(_out(flows, "out_bytes")).alias("out_bytes"),
        F.sum(_flow_count(flows)).alias("flows"), F.bit_or("tcp_flags").alias("tcp_flags"))


def bidir_flows(flows: DataFrame) -> DataFrame:
    """Merge a TCP/UDP flow with its reverse into in/out counters.

    One aggregation on the ordered endpoint pair; the earliest flow of a pair
    gives the row its direction.  Other protocols keep their direction.
    """
    a = F.struct(F.col("srcaddr").alias("addr"), F.col("srcport").alias("port"))
    b = F.struct(F.col("dstaddr").alias("addr"), F.col("dstport").alias("port"))
    back = F.col("prot").isin(6, 17) & (a > b)
    out_pkts, out_bytes = _out(flows, "out_pkts"), _out(flows, "out_bytes")

    def when_back(x, y):
        return F.when(F.col("_back"), x).otherwise(y)

    paired = flows.withColumns({"_back": back, "_lo": F.when(back, b).otherwise(a),
                                "_hi": F.when(back, a).otherwise(b)})
    grouped = paired.groupBy("_lo", "_hi", "prot").agg(
        # start time and direction in one number, which hash aggregation can hold
        F.min(ms("first", "msec_first") * 2 + F.col("_back").cast("int")).alias("_lead"),
        *_span(),
        F.sum(when_back(out_pkts, F.col("pkts"))).alias("_fp"),
        F.sum(when_back(out_bytes, F.col("bytes"))).alias("_fb"),
        F.sum(when_back(F.col("pkts"), out_pkts)).alias("_rp"),
        F.sum(when_back(F.col("bytes"), out_bytes)).alias("_rb"),
        F.sum(_flow_count(flows)).alias("flows"), F.bit_or("tcp_flags").alias("tcp_flags"))
    lead_back = F.col("_lead") % 2 == 1

    def pick(x, y):
        return F.when(lead_back, F.col(x)).otherwise(F.col(y))

    return grouped.select(
        pick("_hi.addr", "_lo.addr").alias("srcaddr"), pick("_hi.port", "_lo.port").alias("srcport"),
        pick("_lo.addr", "_hi.addr").alias("dstaddr"), pick("_lo.port", "_hi.port").alias("dstport"), "prot",
        "first_ms", "last_ms", pick("_rp", "_fp").alias("pkts"), pick("_rb", "_fb").alias("bytes"),
        pick("_fp", "_rp").alias("out_pkts"), pick("_fb", "_rb").alias("out_bytes"), "flows", "tcp_flags")


_SWAP_PAIRS = [("srcaddr", "dstaddr"), ("srcport", "dstport"), ("srcas", "dstas"), ("input", "output"),
               ("pkts", "out_pkts"), ("bytes", "out_bytes")]


def guess_direction(flows: DataFrame) -> DataFrame:
    """Swap both ends of flows that run from a low port to a high port."""
    swap = (F.col("srcport") < 1024) & (F.col("dstport") > 1024)
    changes = {}
    for a, b in _SWAP_PAIRS:
        if a in flows.columns and b in flows.columns:
            changes[a] = F.when(swap, F.col(b)).otherwise(F.col(a))
            changes[b] = F.when(swap, F.col(a)).otherwise(F.col(b))
    return flows.withColumns(changes)


def with_rates(agg: DataFrame) -> DataFrame:
    """pps, bps and bpp of a group over its own first..last span."""
    span = F.col("last_ms") - F.col("first_ms")
    return agg.withColumns({"pps": idiv(F.lit(1000) * F.col("pkts"), span),
                            "bps": idiv(F.lit(8000) * F.col("bytes"), span),
                            "bpp": idiv(F.col("bytes"), F.col("pkts"))})


def totals(agg: DataFrame) -> DataFrame:
    return agg.agg(F.sum("flows").alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"))


def with_percent(agg: DataFrame, flows: DataFrame) -> DataFrame:
    """Share of all flows, packets and bytes in hundredths of a percent.

    The one-row totals of ``flows`` are attached as scalar subqueries.
    """
    spark = agg.sparkSession
    total = flows.agg(F.count(F.lit(1)).alias("tf"), F.sum("pkts").alias("tp"), F.sum("bytes").alias("tb"))
    return spark.sql(
        """SELECT a.*,
             coalesce((a.flows * 10000) div nullif((SELECT tf FROM {t}), 0), 0) AS flows_pct,
             coalesce((a.pkts * 10000) div nullif((SELECT tp FROM {t}), 0), 0) AS pkts_pct,
             coalesce((a.bytes * 10000) div nullif((SELECT tb FROM {t}), 0), 0) AS bytes_pct
           FROM {a} a""", a=agg, t=total)


def summary(flows: DataFrame) -> DataFrame:
    """One row: totals and average rates over the whole span."""
    one = flows.agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"), F.sum("pkts").alias("pkts"),
                    *_span())
    return with_rates(one).select("flows", "bytes", "pkts", F.col("bps").alias("avg_bps"),
                                  F.col("pps").alias("avg_pps"), F.col("bpp").alias("avg_bpp"))


def slot_stats(flows: DataFrame, by=("devid", "slot")) -> DataFrame:
    """Totals per slot, split into TCP, UDP, ICMP (1, 58) and other."""
    prot = F.col("prot")
    classes = {"tcp": prot == 6, "udp": prot == 17, "icmp": prot.isin(1, 58), "other": ~prot.isin(1, 6, 17, 58)}
    one = F.lit(1).cast("bigint")
    cols = [F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")]
    for name, cond in classes.items():
        for metric, value in (("flows", one), ("pkts", F.col("pkts")), ("bytes", F.col("bytes"))):
            cols.append(F.sum(F.when(cond, value).otherwise(F.lit(0).cast("bigint"))).alias(f"{metric}_{name}"))
    return flows.withColumn("slot", slot()).groupBy(*by).agg(*_span(), *cols)


def merge_stats(stats: DataFrame, by=("devid",)) -> DataFrame:
    """Merge slot statistics: sums, earliest first, latest last."""
    keys = set(by) | {"slot"}
    cols = []
    for name in stats.columns:
        if name == "first_ms":
            cols.append(F.min(name).alias(name))
        elif name == "last_ms":
            cols.append(F.max(name).alias(name))
        elif name not in keys and name != "devid":
            cols.append(F.sum(name).alias(name))
    return stats.groupBy(*by).agg(*cols)


def port_histogram(flows: DataFrame) -> DataFrame:
    """Flow counts per (protocol, side, port) for TCP and UDP."""
    sides = F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("srcport").alias("bucket")),
                              F.struct(F.lit("dst").alias("side"), F.col("dstport").alias("bucket"))))
    return (flows.where(F.col("prot").isin(6, 17)).select("prot", sides.alias("s")).select("prot", "s.*")
            .groupBy("prot", "side", "bucket").agg(F.count(F.lit(1)).alias("flows")))


def bpp_histogram(flows: DataFrame, cap: int = 9000) -> DataFrame:
    """Flow counts per (protocol, bytes per packet), the last bucket open."""
    bucket = F.least(idiv(F.col("bytes"), F.col("pkts")), F.lit(cap)).alias("bucket")
    return (flows.where(F.col("prot").isin(6, 17)).groupBy("prot", bucket)
            .agg(F.count(F.lit(1)).alias("flows")))


def port_table(flows: DataFrame) -> DataFrame:
    """Flows, packets and bytes per (slot, protocol, destination port)."""
    return (flows.where(F.col("prot").isin(6, 17))
            .groupBy(slot().alias("slot"), "prot", "dstport")
            .agg(F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")))


def exporter_stats(flows: DataFrame) -> DataFrame:
    """Flows, packets and bytes per exporter; sequence failures are the
    records whose sequence number is not the expected one, where known."""
    failures = (F.sum(F.when(F.col("sequence") != F.col("expected_sequence"), 1).otherwise(0))
                if {"sequence", "expected_sequence"} <= set(flows.columns) else F.lit(0)).cast("bigint")
    return flows.groupBy("exporter_sysid").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"),
        failures.alias("sequence_failures"))


def peer_counts(flows: DataFrame, key, peer: str, approx: bool = False) -> DataFrame:
    """Distinct peers per key, exact by default."""
    count = F.approx_count_distinct(peer) if approx else F.count_distinct(F.col(peer))
    return flows.groupBy(*key).agg(count.alias("peers"))


ATTRIBUTE_GROUPS = {
    "service": ["service_type", "service_name", "service_version", "service_time"],
    "dev": ["dev_type", "dev_name", "dev_vendor", "dev_model", "dev_time"],
    "os": ["os_type", "os_name", "os_version", "os_time"],
    "midware": ["midware_type", "midware_name", "midware_version", "midware_time"],
}


def latest_attrs(flows: DataFrame, key, base: DataFrame | None = None) -> DataFrame:
    """Latest non-empty service, device, OS and middleware attributes per key.

    Each group is aggregated from the flows that carry it (few flows do) and
    joined to ``base`` (by default all keys), so the wide text columns stay
    out of the main pass.
    """
    out = flows.select(*key).distinct() if base is None else base
    for cols in ATTRIBUTE_GROUPS.values():
        if set(cols) <= set(flows.columns):
            packed = F.max(F.struct("last", *cols)).alias("_a")
            group = flows.where(F.col(cols[0]) != "").groupBy(*key).agg(packed)
            out = out.join(group.select(*key, *[F.col(f"_a.{c}").alias(c) for c in cols]), list(key), "left")
    return out


# Buckets of a sketch as a power of two: a standard error of 0.65 %, and exact for small numbers.
SKETCH_BITS = 14


def peer_features(flows: DataFrame, key: Sequence[str], peer: str) -> DataFrame:
    """Counters per key with the exact number of distinct peers, and a sketch of them that merges across slots.

    ``peers`` of several slots can only be added; sketches are merged by ``merge_features`` and give the distinct number.
    """
    return flows.groupBy(*key).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"),
        F.sum("bytes").alias("bytes"), F.count_distinct(peer).alias("peers"), F.hll_sketch_agg(peer, F.lit(SKETCH_BITS)).alias("peers_sketch"))


def distinct_peers(sketch: str = "peers_sketch") -> Column:
    """Estimated number of distinct peers of a sketch."""
    return F.hll_sketch_estimate(sketch)
