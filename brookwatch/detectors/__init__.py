"""Threat detectors: flows and rules in; events, features and evidence out."""

from .base import Detection
from .dns import detect_dga, detect_dns_intel, detect_dns_tunnel, detect_dns_tunnel_scored
from .icmp import detect_icmp_tunnel
from .scans import detect_ip_scan, detect_port_scan
from .services import (detect_asset_services, detect_services, detect_tcp_init, popular_services)
from .threats import detect_mining, detect_threats
from .traffic import (detect_black_list, detect_object_thresholds, detect_outreach, detect_suspicious,
                      listed_features, object_traffic)
from .web import detect_malicious_url, detect_url_attacks

__all__ = ["Detection", "detect_asset_services", "detect_black_list", "detect_dga", "detect_dns_intel",
           "detect_dns_tunnel", "detect_dns_tunnel_scored", "detect_icmp_tunnel", "detect_ip_scan",
           "detect_malicious_url", "detect_mining", "detect_object_thresholds", "detect_outreach",
           "detect_port_scan", "detect_services", "detect_suspicious", "detect_tcp_init", "detect_threats",
           "detect_url_attacks", "listed_features", "object_traffic", "popular_services"]
