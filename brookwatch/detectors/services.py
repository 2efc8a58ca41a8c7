"""Service discovery, asset services, TCP initiation, popular services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import addr_text
from ..functions.names import UDP_SERVICE_PORTS, proto_name
from ..functions.text import app_proto
from ..functions.timefn import truncate
from ..operators.aggregate import ATTRIBUTE_GROUPS, latest_attrs
from ..operators.joins import pair_requests, pair_services, service_roles
from ..operators.ranges import in_nets
from ..operators.rulematch import Rules, Selectors, best_rule, network, on_schedule, passes, pattern_rules, words
from ..rules import Pattern, Window
from ..schema import DAY_SECONDS, HOUR_SECONDS
from .base import (RUN, Detection, counters, details_of, events_of, is_request, joined, only_events, recount,
                   rule_values, with_hour)

# Fixed value: TCP ports of asset services lie below this one.
MAX_TCP_PORT = 65535

ENDPOINT = [*RUN, "addr", "port", "prot"]


def service_flows(flows: DataFrame) -> DataFrame:
    """TCP flows, and UDP flows with a known service port, that have ports."""
    udp = F.col("srcport").isin(*UDP_SERVICE_PORTS) | F.col("dstport").isin(*UDP_SERVICE_PORTS)
    return flows.where(F.col("prot").isin(6, 17) & ((F.col("prot") == 6) | udp)
                       & (F.col("srcport") != 0) & (F.col("dstport") != 0))


def with_latest_app(rows: DataFrame, key, app: Column) -> DataFrame:
    """Counters per key and the latest non-empty protocol name.

    Rows are first counted per (key, name), a plain hash aggregation; the name
    is then picked from the few rows left per key.
    """
    named = rows.groupBy(*key, app.alias("_app")).agg(*counters())
    return named.groupBy(*key).agg(
        *recount(), F.max(F.when(F.col("_app") != "", F.struct("last", "_app")))["_app"].alias("app_proto"))


def paired_services(f: DataFrame, app: Column) -> DataFrame:
    """Paired endpoints; UDP ones only on known service ports."""
    known = F.col("port").isin(*UDP_SERVICE_PORTS) | (F.col("prot") == 6)
    return pair_services(f, app, run=RUN).where(known)


def _selectors() -> Selectors:
    """A rule's port is a number or the name of the protocol spoken there."""
    return {"ip": network("addr"), "port": words(F.col("port"), F.upper("app_proto"), normal=F.upper),
            "protocol": words(proto_name())}


def _service_features(services: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    limits = pattern_rules(patterns, "SRV", "flows")
    return with_hour(best_rule(services, limits, _selectors()).where(F.col("flows") >= F.col("rule.min"))
                     .drop("rule"))


def detect_services(flows: DataFrame, patterns: Sequence[Pattern], window: Window) -> Detection:
    """Services that answer requests, above the pattern's flow count."""
    f = service_flows(window.clip(flows))
    app = F.col("pname") if "pname" in f.columns else F.lit("")
    return Detection(None, _service_features(paired_services(f, app), patterns).drop("time"), None)


def detect_asset_services(flows: DataFrame, assets: DataFrame, rules: Rules,
                          patterns: Sequence[Pattern], window: Window) -> Detection:
    """Services of asset networks with their attributes, and exposure events."""
    low = (F.col("srcport") < MAX_TCP_PORT) & (F.col("dstport") < MAX_TCP_PORT)
    f = service_flows(window.clip(flows)).where((F.col("tcp_flags") != 20) & ((F.col("prot") == 17) | low))
    services = in_nets(pair_services(f, app_proto() if "pname" in f.columns else F.lit(""), run=RUN), "addr", assets)
    hits = best_rule(services.where(F.col("srv_mark") == 1), rules, _selectors()).where(
        F.col("rule").isNotNull() & passes("flows") & on_schedule(window))
    obj = joined(":>", addr_text(services, "addr"), ":", F.col("port"), " ", proto_name(), " ")
    tagged = events_of(rule_values(hits, "flows", "flow_count"), obj, 0, keep=ENDPOINT)

    def features() -> DataFrame:
        rows = _service_features(services, patterns)
        groups = [c for cols in ATTRIBUTE_GROUPS.values() for c in cols if c in f.columns]
        if groups:
            rows = latest_attrs(service_roles(f), [*ENDPOINT, "srv_mark"], rows).withColumns(
                {c: F.coalesce(F.col(c), F.lit(0) if c.endswith("_time") else F.lit("")) for c in groups})
        return rows.drop("time")

    def details() -> DataFrame:
        sided = f.withColumns({"addr": F.col("srcaddr"), "port": F.col("srcport")})
        return details_of(sided, tagged, ENDPOINT)

    return Detection(lambda: only_events(tagged), features, details)


def detect_tcp_init(flows: DataFrame, window: Window) -> Detection:
    """TCP requests with whether they were answered."""
    f = window.clip(flows).where((F.col("prot") == 6) & (F.col("tcp_flags") != 20))
    app = app_proto() if "pname" in f.columns else F.lit("")
    key = [*RUN, "sip", "dip", "dport", "http_ret_code"]

    def side(rows: DataFrame, a: str, b: str, port: str) -> DataFrame:
        named = rows.withColumns({"sip": F.col(a), "dip": F.col(b), "dport": F.col(port)})
        return with_latest_app(named, key, app)

    req = side(f.where(is_request()), "srcaddr", "dstaddr", "dstport")
    res = side(f.where(~is_request()), "dstaddr", "srcaddr", "srcport")
    paired = pair_requests(req, res, key).join(
        res.select(*key, F.col("app_proto").alias("_app")), key, "left")
    out = paired.withColumns({
        "app_proto": F.coalesce("app_proto", "_app", F.lit("")),
        "srv_mark": F.when(F.col("has_res"), "res").otherwise("req")}).drop("_app", "has_res", "time")
    return Detection(None, with_hour(out), None)


def popular_services(flows: DataFrame, end: int, days: int, percent: int) -> DataFrame:
    """Services used by at least ``percent`` percent of the distinct source
    addresses of the last ``days`` days (whole hours); 0 gives nothing."""
    start = end - days * DAY_SECONDS
    f = flows.where((truncate("first", HOUR_SECONDS) >= start - start % HOUR_SECONDS) & (F.col("first") < end))
    clients = (f.where(F.col("prot").isin(6, 17) & is_request()).groupBy("dstaddr", "prot", "dstport")
               .agg(F.count_distinct("srcaddr").alias("clients")))
    total = f.agg(F.count_distinct("srcaddr").alias("n"))
    return flows.sparkSession.sql(
        f"""SELECT c.*, (SELECT n FROM {{t}}) AS addresses FROM {{c}} c
            WHERE {int(percent)} > 0 AND c.clients * 100 >= (SELECT n FROM {{t}}) * {int(percent)}""",
        c=clients, t=total)
