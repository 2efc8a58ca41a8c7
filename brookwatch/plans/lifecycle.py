"""Hourly features, events, evidence, baselines and retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import idiv
from ..functions.timefn import truncate
from ..operators.merges import merge_all, merge_gaps, new_rows
from ..schema import DAY_SECONDS, EVENT_COLUMNS, HOUR_SECONDS

_SUMS = ("flows", "pkts", "bytes", "peers")
_MAXES = ("peak_flows", "peak_pkts", "peak_bytes")


def merge_features(old: DataFrame | None, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Merge slot features into the hourly table.

    Earliest first, latest last, summed counters (``peers`` adds across
    slots), highest peaks, merged sketches (``*_sketch``); other columns keep the latest value.
    """
    rows = new if old is None else old.unionByName(new)
    keys = [*key, "hour"]
    cols = []
    for c in rows.columns:
        if c in keys:
            continue
        if c == "first":
            cols.append(F.min(c).alias(c))
        elif c == "last":
            cols.append(F.max(c).alias(c))
        elif c in _SUMS:
            cols.append(F.sum(c).alias(c))
        elif c in _MAXES:
            cols.append(F.max(c).alias(c))
        elif c.endswith("_sketch"):
            cols.append(F.hll_union_agg(c).alias(c))
        else:
            cols.append(F.max(F.struct("last", c))[c].alias(c))
    return rows.groupBy(*keys).agg(*cols).select(*rows.columns)


# Feature kinds by the names that the run gives its detectors: whether rows merge over gaps, or all of a key.
MERGED_OVER_GAPS = {**dict.fromkeys(("port_scan", "ip_scan", "service", "assetsrv", "mo", "ip_set", "bw", "popular", "white",
                                     "icmptunnel"), True),
                    **dict.fromkeys(("dns", "dnstunnel", "dnstunnel_scored", "dga", "url_content", "malicious_url",
                                     "threshold", "frn_trip", "tcpinit", "threat", "mining"), False)}

_ENDS, _LISTED, _SERVICE = "devid srcaddr dstaddr", "devid sip dip prot ti_mark class", "devid addr port prot srv_mark"
# The columns that make a feature row of each kind.
FEATURE_KEYS = {kind: key.split() for kind, key in {
    "port_scan": "devid srcaddr prot dstport", "ip_scan": f"{_ENDS} prot", "service": _SERVICE, "assetsrv": _SERVICE,
    "mo": "devid moid", "ip_set": _LISTED, "bw": _LISTED, "popular": _LISTED, "white": _LISTED, "icmptunnel": "devid sip dip",
    "dns": f"{_ENDS} qname qtype", "dnstunnel": f"{_ENDS} domain", "dnstunnel_scored": f"{_ENDS} qname", "dga": f"{_ENDS} qname",
    "malicious_url": f"{_ENDS} dstport http_url", "tcpinit": "devid sip dip dport http_ret_code srv_mark",
    "threat": "devid srcaddr prot dstaddr dstport fp_type fp_name", "mining": "devid sip dip prot coin domain model"}.items()}


def feature_filter(df: DataFrame, start: int, end: int, ip=None, sip=None, dip=None, port=None, proto=None,
                   flows: int | None = None, peers: int | None = None, qname: str | None = None,
                   qname_part: bool = False, qtype: int | None = None, ti_mark: bool | None = None,
                   srv_mark: int | str | None = None) -> Column:
    """Time overlap and the optional fields of a feature request, ANDed."""
    src = next((c for c in ("sip", "addr", "srcaddr") if c in df.columns), "srcaddr")
    dst = "dip" if "dip" in df.columns else "dstaddr"
    cond = (F.col("last") >= start) & (F.col("first") <= end)
    if ip is not None:
        side = F.col(src) == ip
        cond = cond & (side | (F.col(dst) == ip) if dst in df.columns else side)
    tests = [(sip, src), (dip, dst), (port, "dstport" if "dstport" in df.columns else "port"), (proto, "prot"),
             (qtype, "qtype"), (ti_mark, "ti_mark"), (srv_mark, "srv_mark")]
    for value, column in tests:
        if value is not None:
            cond = cond & (F.col(column) == value)
    if flows is not None:
        cond = cond & (F.col("flows") >= flows)
    if peers is not None:
        cond = cond & (F.col("peers") >= peers)
    if qname is not None:
        hit = F.contains(F.col("qname"), F.lit(qname)) if qname_part else F.col("qname") == qname
        cond = cond & hit
    return cond


def query_features(features: DataFrame, kind: str, key: Sequence[str] | None, start: int, end: int, **fields) -> DataFrame:
    """Feature rows of a range, filtered and merged for display, by the given key or that of the kind.

    Whole hours are scanned; the hour column prunes the partitions.  An unknown kind raises.
    """
    if kind not in MERGED_OVER_GAPS:
        raise ValueError(f"not a feature kind: {kind!r}")
    scanned = features.where((F.col("hour") >= start - start % HOUR_SECONDS) & (F.col("hour") <= end))
    rows = scanned.where(feature_filter(features, start, end, qname_part=kind == "dns", **fields))
    key = key or FEATURE_KEYS[kind]
    merged = merge_gaps(rows, key) if MERGED_OVER_GAPS[kind] else merge_all(rows, key)
    return merged.withColumn("duration", F.col("last") - F.col("first"))


def feature_size(features: DataFrame, start: int, end: int) -> DataFrame:
    """Feature rows per hour of a range."""
    return (features.where((F.col("hour") >= start - start % HOUR_SECONDS) & (F.col("hour") <= end))
            .groupBy("hour").agg(F.count(F.lit(1)).alias("rows")))


def query_events(events: DataFrame, start: int, end: int, type_id: int | None = None,
                 config_ids: Sequence[int] = ()) -> DataFrame:
    """Events with ``start <= time < end``, of one type and any of the rules."""
    out = events.where((F.col("time") >= start) & (F.col("time") < end))
    if type_id is not None:
        out = out.where(F.col("type_id") == type_id)
    return out.where(F.col("config_id").isin(*config_ids)) if config_ids else out


def query_event_details(details: DataFrame, start: int, end: int, obj: str | None = None,
                        type_id: int | None = None) -> DataFrame:
    """Evidence with ``start <= time <= end``, of one object."""
    out = details.where(F.col("time").between(start, end))
    if obj is not None:
        out = out.where(F.col("obj") == obj)
    return out.where(F.col("type_id") == type_id) if type_id is not None else out


def packet_evidence(packets: DataFrame, sec: int, usec: int) -> DataFrame:
    """Packets captured at an exact second and microsecond."""
    return packets.where((F.col("time_sec") == sec) & (F.col("time_usec") == usec))


def expire_events(events: DataFrame, now: int, ttl: int = DAY_SECONDS) -> DataFrame:
    return events.where(F.col("time") >= now - ttl)


def upsert_events(existing: DataFrame, new: DataFrame, now: int, ttl: int = DAY_SECONDS) -> DataFrame:
    """Unexpired events plus the new ones not already there (all fields equal)."""
    kept = existing.select(*EVENT_COLUMNS)
    return expire_events(kept.unionByName(new_rows(kept, new.select(*EVENT_COLUMNS))), now, ttl)


# Baseline intervals and units.
BASELINE_INTERVALS = (300, 3600, 86400)
BASELINE_UNITS = {"bps": ("bytes", 8), "pps": ("pkts", 1), "fps": ("flows", 1)}


def baselines(flows: DataFrame, interfaces: bool = True) -> DataFrame:
    """Average rates per device and interface side, for every interval and unit.

    ``value`` is the mean rate of the intervals that hold traffic, in whole
    units per second.  Flows are summed per scope and 300 s slot first; the
    longer intervals are built from those sums.
    """
    scopes = [F.concat(F.lit("dev:"), F.col("devid").cast("string"))]
    if interfaces:
        for column, way in (("input", "in"), ("output", "out")):
            scopes.append(F.concat(F.lit("dev:"), F.col("devid").cast("string"), F.lit("|if:"),
                                   F.col(column).cast("string"), F.lit(f" {way}")))
    slots = (flows.select(F.explode(F.array(*scopes)).alias("name"), truncate("first", 300).alias("slot"),
                          "pkts", "bytes")
             .groupBy("name", "slot").agg(F.count(F.lit(1)).alias("flows"), F.sum("pkts").alias("pkts"),
                                          F.sum("bytes").alias("bytes")))
    intervals = F.explode(F.array(*[F.lit(i) for i in BASELINE_INTERVALS]))
    spans = slots.withColumn("interval", intervals)
    per = spans.groupBy("name", "interval", (F.col("slot") - F.col("slot") % F.col("interval")).alias("start")).agg(
        *[F.sum(c).alias(c) for c in ("flows", "pkts", "bytes")])
    means = per.groupBy("name", "interval").agg(
        F.count(F.lit(1)).alias("intervals"), *[F.sum(c).alias(c) for c in ("flows", "pkts", "bytes")])
    units = F.explode(F.array(*[
        F.struct(F.lit(u).alias("unit"),
                 idiv(F.col(c) * factor, F.col("intervals") * F.col("interval")).alias("value"))
        for u, (c, factor) in BASELINE_UNITS.items()]))
    return means.select("name", "interval", "intervals", units.alias("_u")).select(
        "name", "interval", "intervals", "_u.unit", "_u.value")


def retention_plan(slot_sizes: DataFrame, now: int, max_life: int = 0, max_size: int = 0,
                   low_water: int = 95) -> DataFrame:
    """Slots to delete, oldest first, to meet the size and age limits.

    A limit acts only once it is exceeded, and then down to its low-water
    mark.  Sizes are pre-summed per day, so the running sum over all slots is
    one short sort of days plus one per day.
    """
    low_water = low_water or 95
    day = F.col("slot") - F.col("slot") % DAY_SECONDS
    slots = slot_sizes.groupBy("slot").agg(F.sum("bytes").alias("bytes")).withColumn("_day", day)
    days = slots.groupBy("_day").agg(F.sum("bytes").alias("_bytes"))
    newer_days = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = days.select("_day", F.coalesce(F.sum("_bytes").over(newer_days), F.lit(0)).alias("_after"))
    newer = Window.partitionBy("_day").orderBy(F.col("slot").desc())
    kept = slots.join(after, "_day").withColumn("_kept", F.sum("bytes").over(newer) + F.col("_after"))
    plan = kept.sparkSession.sql(
        "SELECT k.*, (SELECT sum(bytes) FROM {s}) AS _total, (SELECT min(slot) FROM {s}) AS _oldest FROM {k} k",
        k=kept, s=slots)
    by_size = F.lit(False)
    if max_size:
        limit = low_water * max_size // 100
        # a slot goes while the size before deleting it is above the mark
        by_size = (F.col("_total") >= max_size) & (F.col("_kept") > limit)
    by_age = F.lit(False)
    if max_life:
        mark = now - max_life * low_water // 100
        by_age = (F.lit(now) - F.col("_oldest") >= max_life) & (F.col("slot") < mark)
    return plan.where(by_size | by_age).select(
        "slot", "bytes", F.when(by_size, "size").otherwise("age").alias("reason"))
