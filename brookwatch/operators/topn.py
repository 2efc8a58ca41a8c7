"""Element statistics, ordering, Top-N and Top-N per time step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import idiv, mpls_label
from ..functions.timefn import truncate
from ..schema import FIVE_TUPLE
from .aggregate import aggregate_flows, ms, with_rates

# Statistic elements and their columns.  Two columns mean a flow
# counts once for each distinct side value.
ELEMENTS = {
    "srcip": ["srcaddr"], "dstip": ["dstaddr"], "ip": ["srcaddr", "dstaddr"],
    "nhip": ["ip_nexthop"], "nhbip": ["bgp_nexthop"], "router": ["ip_router"],
    "srcport": ["srcport"], "dstport": ["dstport"], "port": ["srcport", "dstport"],
    "proto": ["prot"], "tos": ["tos"], "srctos": ["tos"], "dsttos": ["dst_tos"], "dir": ["dir"],
    "srcas": ["srcas"], "dstas": ["dstas"], "prevas": ["prev_as"], "nextas": ["next_as"],
    "as": ["srcas", "dstas"], "inif": ["input"], "outif": ["output"], "if": ["input", "output"],
    "srcmask": ["src_mask"], "dstmask": ["dst_mask"], "mask": ["src_mask", "dst_mask"],
    "srcvlan": ["src_vlan"], "dstvlan": ["dst_vlan"], "vlan": ["src_vlan", "dst_vlan"],
    "insrcmac": ["in_src_mac"], "outdstmac": ["out_dst_mac"], "indstmac": ["in_dst_mac"],
    "outsrcmac": ["out_src_mac"], "srcmac": ["in_src_mac", "out_src_mac"],
    "dstmac": ["in_dst_mac", "out_dst_mac"], "inmac": ["in_src_mac", "in_dst_mac"],
    "outmac": ["out_src_mac", "out_dst_mac"],
    "cl": ["client_latency"], "sl": ["server_latency"], "al": ["app_latency"],
}
ORDERS = {"flows": True, "packets": True, "bytes": True, "pps": True, "bps": True, "bpp": True,
          "tstart": False, "tend": False}
_ORDER_COLUMN = {"packets": "pkts", "tstart": "first_ms", "tend": "last_ms"}

# Ranking a group with Spark's partial limit is planned up to this many rows
# (spark.sql.optimizer.windowGroupLimitThreshold).
RANK_LIMIT = 1000


def element_values(element: str) -> Column:
    """Array of the element's values in a flow, each once."""
    if element.startswith("mpls"):
        return F.array(mpls_label(int(element[4:])))
    cols = [F.col(c) for c in ELEMENTS[element]]
    return F.array(*cols) if len(cols) == 1 else F.array_distinct(F.array(*cols))


def element_stat(flows: DataFrame, element: str, by_proto: bool = False, by=()) -> DataFrame:
    """Flows, packets, bytes, span and rates per element value."""
    cols = ELEMENTS.get(element, [])
    value = F.col(cols[0]) if len(cols) == 1 else F.explode(element_values(element))
    keys = [*by, "value"] + (["prot"] if by_proto else [])
    narrow = flows.select(*by, value.alias("value"), "prot", "pkts", "bytes",
                          ms("first", "msec_first").alias("_first"), ms("last", "msec_last").alias("_last"))
    agg = narrow.groupBy(*keys).agg(
        F.min("_first").alias("first_ms"), F.max("_last").alias("last_ms"),
        F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"))
    return with_rates(agg)


def order_columns(df: DataFrame, order: str = "flows") -> list[Column]:
    """Order column plus the remaining columns as tie-break."""
    name = _ORDER_COLUMN.get(order, order)
    lead = F.col(name).desc() if ORDERS[order] else F.col(name).asc()
    measures = {"flows", "pkts", "bytes", "pps", "bps", "bpp", "first_ms", "last_ms"}
    keys = [c for c in df.columns if c not in measures]
    return [lead] + [F.col(c) for c in keys]


def order_flows(df: DataFrame, order: str = "flows") -> DataFrame:
    return df.orderBy(*order_columns(df, order))


def top_n(flows: DataFrame, element: str, order: str = "flows", n: int = 10, by_proto: bool = False) -> DataFrame:
    """Top element values; ``n=0`` keeps all of them in order."""
    ordered = order_flows(element_stat(flows, element, by_proto), order)
    return ordered.limit(n) if n else ordered


def top_flows(flows: DataFrame, order: str = "flows", n: int = 10, by=None) -> DataFrame:
    """Top aggregated flow records."""
    ordered = order_flows(with_rates(aggregate_flows(flows, by)), order)
    return ordered.limit(n) if n else ordered


FLOW_ORDER = ["first", "msec_first", "srcaddr", "srcport", "dstaddr", "dstport", "prot"]


def _all_columns(flows: DataFrame) -> list[str]:
    return FLOW_ORDER + [c for c in flows.columns if c not in FLOW_ORDER]


def sort_flows(flows: DataFrame) -> DataFrame:
    return flows.orderBy(*_all_columns(flows))


def limit_flows(flows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` flows by start time."""
    return sort_flows(flows).limit(n) if n else flows


def top_per_group(df: DataFrame, group, order, n: int) -> DataFrame:
    """First ``n`` rows of every group.

    Up to ``RANK_LIMIT`` rows Spark limits each task's share of a group before
    the shuffle.  Beyond that, rows are ranked inside hashed parts of a group
    first, so a hot group is spread over many tasks.  ``n=0`` keeps all rows.
    """
    if not n:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    if n > RANK_LIMIT:
        part = F.pmod(F.xxhash64(*df.columns), F.lit(256))
        inner = Window.partitionBy(*group, "_part").orderBy(*order)
        df = (df.withColumn("_part", part).withColumn("_rank", F.row_number().over(inner))
              .where(F.col("_rank") <= n).drop("_part", "_rank"))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


# Sort dimensions of a traffic request, per side.
_TYPES = {
    "IP": {"src": ("SIP", "srcip", "sip"), "dst": ("DIP", "dstip", "dip"), "either": ("IP", "ip", "ip")},
    "AS": {"src": ("SAS", "srcas", "sas"), "dst": ("DAS", "dstas", "das"), "either": ("AS", "as", "asn")},
    "PORT": {"src": ("SPORT", "srcport", "sport"), "dst": ("DPORT", "dstport", "dport"),
             "either": ("PORT", "port", "port")},
    "PROTO": {"either": ("PROTO", "proto", "protocol")},
    "INIF": {"either": ("INIF", "inif", "inif")},
    "OUTIF": {"either": ("OUTIF", "outif", "outif")},
}
TOPN_COLUMNS = {"ip": "bigint", "sip": "bigint", "dip": "bigint", "asn": "bigint", "sas": "bigint", "das": "bigint",
                "port": "int", "sport": "int", "dport": "int", "protocol": "int", "inif": "bigint", "outif": "bigint"}
_ORDERBY = {"Bytes": "bytes", "Packets": "pkts", "Flows": "flows"}


def _records(agg: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """Uniform result row: time, type, the key columns, the counters."""
    keys = [(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in TOPN_COLUMNS.items()]
    return agg.select("time", F.lit(kind).alias("type"), *keys, "flows", "pkts", "bytes")


def _totals(agg: DataFrame) -> DataFrame:
    """``ALL`` rows per step.  Where every flow is in one group only, they are
    summed from the ranked groups, whose shuffle Spark then reuses."""
    sums = agg.groupBy("time").agg(*[F.sum(c).alias(c) for c in ("flows", "pkts", "bytes")])
    return _records(sums, "ALL", {})


def topn_by_step(flows: DataFrame, sortby: str = "ALL", orderby: str = "Bytes", srcdst: str = "",
                 step: int = 300, limit: int = 10) -> DataFrame:
    """Top-N per time step, with an ``ALL`` totals row for every step."""
    metric = _ORDERBY.get(orderby, "bytes")
    stepped = flows.withColumn("time", truncate("first", step))
    counters = [F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes")]
    result = None
    if sortby in _TYPES:
        sides = _TYPES[sortby]
        wanted = {"src": ["src"], "dst": ["dst"], "srcdst": ["src", "dst"]}.get(srcdst, ["either"])
        for side in wanted if "src" in sides else ["either"]:
            kind, element, column = sides[side]
            agg = element_stat(stepped, element, by_proto=sortby == "PORT", by=["time"])
            columns = {column: "value"}
            if sortby == "PORT":
                columns["protocol"] = "prot"
            keys = [F.col("value")] + ([F.col("prot")] if sortby == "PORT" else [])
            top = top_per_group(agg, ["time"], [F.col(metric).desc(), *keys], limit)
            if result is None and not (side == "either" and len(ELEMENTS[element]) > 1):
                result = _totals(agg)
            elif result is None:
                result = _totals(stepped.groupBy("time").agg(*counters))
            result = result.unionByName(_records(top, kind, columns))
    elif sortby == "CONV":
        agg = stepped.groupBy("time", *FIVE_TUPLE).agg(*counters)
        result = _totals(agg)
        top = top_per_group(agg, ["time"], [F.col(metric).desc(), *map(F.col, FIVE_TUPLE)], limit)
        result = result.unionByName(_records(top, "CONV", {
            "sip": "srcaddr", "sport": "srcport", "dip": "dstaddr", "dport": "dstport", "protocol": "prot"}))
    elif sortby in ("RAW", "NONE"):
        order = [F.col(c) for c in FLOW_ORDER + ["last", "pkts", "bytes"]]
        raw = stepped.select("time", *FLOW_ORDER, "last", "pkts", "bytes")
        top = top_per_group(raw, ["time"], order, limit).withColumn("flows", F.lit(1).cast("bigint"))
        result = _totals(stepped.groupBy("time").agg(*counters))
        result = result.unionByName(_records(top, "RAW", {
            "sip": "srcaddr", "sport": "srcport", "dip": "dstaddr", "dport": "dstport", "protocol": "prot"}))
    return _totals(stepped.groupBy("time").agg(*counters)) if result is None else result


def top_ports(port_table: DataFrame, n: int = 10, scale: bool = False) -> DataFrame:
    """Top ports per (protocol, metric); ``scale`` divides by the slot count."""
    agg = port_table.groupBy("prot", "dstport").agg(*[F.sum(c).alias(c) for c in ("flows", "pkts", "bytes")])
    metrics = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("count"))
                                  for c in ("flows", "pkts", "bytes")]))
    long = agg.select("prot", "dstport", metrics.alias("m")).select("prot", "dstport", "m.*")
    if scale:
        slots = port_table.agg(F.count_distinct("slot").alias("slots"))
        long = (long.sparkSession.sql("SELECT l.*, (SELECT slots FROM {s}) AS slots FROM {l} l", l=long, s=slots)
                .withColumn("count", idiv("count", "slots")).drop("slots"))
    return top_per_group(long, ["prot", "metric"], [F.col("count").desc(), F.col("dstport")], n)
