"""Formatted text lines of flows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import numeric
from .address import addr_text, dst_net, ipv4_str, src_net
from .names import flags_str, proto_name
from .timefn import local_ts

# The named line formats.
FORMATS = {
    "line": "%ts %td %pr %sap -> %dap %pkt %byt %fl",
    "long": "%ts %td %pr %sap -> %dap %flg %tos %pkt %byt %fl",
    "extended": "%ts %td %pr %sap -> %dap %flg %tos %pkt %byt %pps %bps %bpp %fl",
    "biline": "%ts %td %pr %sap <-> %dap %opkt %ipkt %obyt %ibyt %fl",
    "bilong": "%ts %td %pr %sap <-> %dap %flg %tos %opkt %ipkt %obyt %ibyt %fl",
}


def clock(sec: Column, msec: Column, zone: str = "UTC") -> Column:
    """``yyyy-MM-dd HH:mm:ss.SSS`` of epoch seconds and milliseconds."""
    t = local_ts(sec, zone)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.concat_ws("-", F.lpad(F.year(t).cast("string"), 4, "0"), two(F.month(t)), two(F.dayofmonth(t)))
    time = F.concat_ws(":", two(F.hour(t)), two(F.minute(t)), two(F.second(t)))
    return F.concat(day, F.lit(" "), time, F.lit("."), F.lpad(msec.cast("string"), 3, "0"))


def mac_text(mac) -> Column:
    mac = F.col(mac) if isinstance(mac, str) else mac
    h = F.lpad(F.lower(F.hex(mac)), 12, "0")
    return F.concat_ws(":", *[h.substr(i, 2) for i in range(1, 13, 2)])


def mpls_text(n: int) -> Column:
    """``label-exp-eos`` of one stack entry."""
    entry = F.coalesce(F.get("mpls", F.lit(n - 1)), F.lit(0))
    return F.concat_ws("-", F.call_function("shiftright", entry, F.lit(4)).cast("string"),
                       F.call_function("shiftright", entry, F.lit(1)).bitwiseAND(F.lit(7)).cast("string"),
                       entry.bitwiseAND(F.lit(1)).cast("string"))


def _port_text(name: str) -> Column:
    """Port number, or ``type.code`` for the destination of an ICMP flow."""
    if name == "srcport":
        return F.col(name).cast("string")
    icmp = F.concat_ws(".", F.call_function("shiftright", F.col(name), F.lit(8)).cast("string"),
                       F.col(name).bitwiseAND(F.lit(255)).cast("string"))
    return F.when(F.col("prot").isin(1, 58), icmp).otherwise(F.col(name).cast("string"))


def _duration_text() -> Column:
    ms = numeric.duration_ms()
    return F.concat(numeric.idiv(ms, F.lit(1000)).cast("string"), F.lit("."),
                    F.lpad((ms % 1000).cast("string"), 3, "0"))


def tags(df: DataFrame, zone: str = "UTC") -> dict[str, Column]:
    """Column of every format tag."""
    sa, da = addr_text(df, "srcaddr", bracket=False), addr_text(df, "dstaddr", bracket=False)

    def plain(name):
        return F.col(name).cast("string")

    def scaled(name):
        return numeric.scale_number(F.col(name))

    out = {
        "ts": clock(F.col("first"), F.col("msec_first"), zone),
        "te": clock(F.col("last"), F.col("msec_last"), zone),
        "td": _duration_text(), "pr": proto_name(), "sa": sa, "da": da,
        "sap": F.concat(sa, F.lit(":"), _port_text("srcport")),
        "dap": F.concat(da, F.lit(":"), _port_text("dstport")),
        "sp": _port_text("srcport"), "dp": _port_text("dstport"),
        "pkt": scaled("pkts"), "ipkt": scaled("pkts"), "byt": scaled("bytes"), "ibyt": scaled("bytes"),
        "flg": flags_str(), "tos": plain("tos"), "stos": plain("tos"),
        "pps": numeric.scale_number(numeric.pps()), "bps": numeric.scale_number(numeric.bps()),
        "bpp": numeric.bpp().cast("string"),
    }
    received = numeric.idiv(F.col("received"), F.lit(1000))
    optional = {
        "tr": (["received"], lambda: clock(received, (F.col("received") % 1000).cast("int"), zone)),
        "fl": (["aggr_flows"], lambda: plain("aggr_flows")),
        "exp": (["exporter_sysid"], lambda: plain("exporter_sysid")),
        "sn": (["src_mask"], lambda: F.concat(ipv4_str(src_net()), F.lit("/"), plain("src_mask"))),
        "dn": (["dst_mask"], lambda: F.concat(ipv4_str(dst_net()), F.lit("/"), plain("dst_mask"))),
        "nh": (["ip_nexthop"], lambda: ipv4_str("ip_nexthop")),
        "nhb": (["bgp_nexthop"], lambda: ipv4_str("bgp_nexthop")),
        "ra": (["ip_router"], lambda: ipv4_str("ip_router")),
        "sas": (["srcas"], lambda: plain("srcas")), "das": (["dstas"], lambda: plain("dstas")),
        "nas": (["next_as"], lambda: plain("next_as")), "pas": (["prev_as"], lambda: plain("prev_as")),
        "in": (["input"], lambda: plain("input")), "out": (["output"], lambda: plain("output")),
        "opkt": (["out_pkts"], lambda: scaled("out_pkts")), "obyt": (["out_bytes"], lambda: scaled("out_bytes")),
        "dtos": (["dst_tos"], lambda: plain("dst_tos")),
        "dir": (["dir"], lambda: F.when(F.col("dir") == 1, "E").otherwise("I")),
        "smk": (["src_mask"], lambda: plain("src_mask")), "dmk": (["dst_mask"], lambda: plain("dst_mask")),
        "fwd": (["fwd_status"], lambda: plain("fwd_status")),
        "svln": (["src_vlan"], lambda: plain("src_vlan")), "dvln": (["dst_vlan"], lambda: plain("dst_vlan")),
        "ismc": (["in_src_mac"], lambda: mac_text("in_src_mac")),
        "odmc": (["out_dst_mac"], lambda: mac_text("out_dst_mac")),
        "idmc": (["in_dst_mac"], lambda: mac_text("in_dst_mac")),
        "osmc": (["out_src_mac"], lambda: mac_text("out_src_mac")),
        "eng": (["engine_type", "engine_id"], lambda: F.concat_ws("/", plain("engine_type"), plain("engine_id"))),
        "cl": (["client_latency"], lambda: F.format_string("%.3f", F.col("client_latency") / 1000)),
        "sl": (["server_latency"], lambda: F.format_string("%.3f", F.col("server_latency") / 1000)),
        "al": (["app_latency"], lambda: F.format_string("%.3f", F.col("app_latency") / 1000)),
        "mpls": (["mpls"], lambda: F.concat_ws(" ", *[mpls_text(i) for i in range(1, 11)])),
    }
    for i in range(1, 11):
        optional[f"mpls{i}"] = (["mpls"], lambda i=i: mpls_text(i))
    for tag, (needs, build) in optional.items():
        if all(c in df.columns for c in needs):
            out[tag] = build()
    out.setdefault("fl", F.lit("1"))
    return out


def format_flows(df: DataFrame, fmt: str, zone: str = "UTC") -> Column:
    """Text line of a named format or of a ``fmt:%tag ...`` text."""
    template = fmt[4:] if fmt.startswith("fmt:") else FORMATS[fmt]
    known = tags(df, zone)
    names = "|".join(sorted(known, key=len, reverse=True))
    pieces = []
    at = 0
    for m in re.finditer(rf"%({names})(?![a-z0-9])", template):
        if m.start() > at:
            pieces.append(F.lit(template[at:m.start()]))
        pieces.append(known[m.group(1)])
        at = m.end()
    if at < len(template):
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)
