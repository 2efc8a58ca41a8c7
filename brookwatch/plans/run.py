"""Run the enabled detectors over a flow set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .. import detectors as d
from ..detectors.base import Detection
from ..rules import MonitoredObject, Pattern, Rule, Window


@dataclass
class Config:
    """Rules per detector, lists and switches.  A detector runs when it is
    enabled and the tables it needs are given."""

    rules: dict[str, list[Rule]] = field(default_factory=dict)
    patterns: list[Pattern] = field(default_factory=list)
    objects: list[MonitoredObject] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    enabled: dict[str, bool] = field(default_factory=dict)


def read_switches(lines) -> dict[str, bool]:
    """``name = enable`` lines as switches."""
    out = {}
    for line in lines:
        text = line.strip()
        if text and not text.startswith("#") and "=" in text:
            name, _, value = text.partition("=")
            out[name.strip()] = value.strip() == "enable"
    return out


def _registry(flows: DataFrame, cfg: Config, w: Window) -> dict[str, tuple[list[str], Callable[[], Detection]]]:
    rules, t = cfg.rules, cfg.tables

    def r(name):
        return rules.get(name, [])

    return {
        "port_scan": ([], lambda: d.detect_port_scan(flows, r("port_scan"), cfg.patterns, w)),
        "ip_scan": ([], lambda: d.detect_ip_scan(flows, r("ip_scan"), cfg.patterns, w)),
        "assetsrv": (["assets"], lambda: d.detect_asset_services(flows, t["assets"], r("assetsrv"), cfg.patterns, w)),
        "dns": (["domain_intel"], lambda: d.detect_dns_intel(flows, r("dns"), t["domain_intel"], w)),
        "dnstunnel": (["white_domains"], lambda: d.detect_dns_tunnel(flows, r("dnstunnel"), t["white_domains"], w)),
        "dnstunnel_scored": ([], lambda: d.detect_dns_tunnel_scored(flows, r("dnstunnel_scored"), w)),
        "dga": (["white_domains"], lambda: d.detect_dga(flows, r("dga"), t["white_domains"], w)),
        "ip_set": (["suspicious"], lambda: d.detect_suspicious(flows, t["suspicious"], r("ip_set"), w)),
        "popular": (["popular"], lambda: d.listed_features(flows, t["popular"], w)),
        "white": (["white"], lambda: d.listed_features(flows, t["white"], w)),
        "bw": (["black"], lambda: d.detect_black_list(flows, t["black"], r("bw"), w)),
        "url_content": ([], lambda: d.detect_url_attacks(flows, r("url_content"), w)),
        "malicious_url": ([], lambda: d.detect_malicious_url(flows, r("malicious_url"), w)),
        "icmptunnel": ([], lambda: d.detect_icmp_tunnel(flows, r("icmptunnel"), w)),
        "threshold": ([], lambda: d.detect_object_thresholds(flows, cfg.objects, r("threshold"), w)),
        "frn_trip": (["assets"], lambda: d.detect_outreach(flows, r("frn_trip"), t["assets"], w)),
        "mo": ([], lambda: Detection(None, d.object_traffic(w.clip(flows), cfg.objects), None)),
        "tcpinit": ([], lambda: d.detect_tcp_init(flows, w)),
        "service": ([], lambda: d.detect_services(flows, cfg.patterns, w)),
        "threat": ([], lambda: d.detect_threats(flows, r("threat"), w)),
        "mining": (["mining_domains", "mining_ips"],
                   lambda: d.detect_mining(flows, r("mining"), t["mining_domains"], t["mining_ips"], w)),
    }


KINDS = ("port_scan ip_scan assetsrv dns dnstunnel dnstunnel_scored dga ip_set popular white bw url_content malicious_url icmptunnel "
         "threshold frn_trip mo tcpinit service threat mining").split()

# Detectors whose events and evidence come from rules; their features do not.
_RULED = {"port_scan", "ip_scan", "dnstunnel", "dnstunnel_scored", "dga", "ip_set", "bw", "url_content",
          "malicious_url", "icmptunnel", "threshold", "frn_trip", "threat", "mining", "dns", "assetsrv"}


def _without_events(found: Detection) -> Detection:
    return Detection(features=lambda: found.features)


def run_detectors(flows: DataFrame, cfg: Config, window: Window) -> dict[str, Detection]:
    """Lazy outputs of every enabled detector.

    Without rules a detector makes no events, but its features all the same.  Each plan reads only the columns it needs; nothing is cached here.  A
    caller that runs many detectors over one slot may ``persist`` the flows.
    """
    out = {}
    for name, (needs, build) in _registry(flows, cfg, window).items():
        if not cfg.enabled.get(name, True) or any(n not in cfg.tables for n in needs):
            continue
        if name in ("threshold", "mo") and not cfg.objects:
            continue
        ruled = name not in _RULED or bool(cfg.rules.get(name))
        out[name] = build() if ruled else _without_events(build())
    return out


def all_events(detections: dict[str, Detection]) -> DataFrame | None:
    """Union of all events."""
    out = None
    for det in detections.values():
        if det.events is not None:
            out = det.events if out is None else out.unionByName(det.events)
    return out
