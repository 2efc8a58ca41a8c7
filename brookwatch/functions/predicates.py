"""Composable flow predicates.

Every ``w_*`` function returns a boolean Column.  ``side`` is ``src``, ``dst``,
``either`` (default) or ``both``; ``cmp`` is ``=``, ``<`` or ``>``.  Combine
them with ``&``, ``|`` and ``~``.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric
from .address import in_cidr, in_prefix6, ipv4_num
from .names import flag_mask, icmp_code, icmp_type, proto_number

_SUFFIX = {"k": 1000, "m": 1000 ** 2, "g": 1000 ** 3}


def number(value) -> int:
    """Number with an optional k, m or g (powers of 1000)."""
    if isinstance(value, str):
        text = value.strip().lower()
        return int(text[:-1]) * _SUFFIX[text[-1]] if text[-1] in _SUFFIX else int(text)
    return int(value)


def compare(col: Column, value, cmp: str = "=") -> Column:
    value = number(value)
    return {"=": col == value, "<": col < value, ">": col > value}[cmp]


def sided(src: str, dst: str, side: str, test) -> Column:
    if side == "src":
        return test(F.col(src))
    if side == "dst":
        return test(F.col(dst))
    a, b = test(F.col(src)), test(F.col(dst))
    return (a & b) if side == "both" else (a | b)


def w_any() -> Column:
    return F.lit(True)


def w_all(*preds: Column) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def w_or(*preds: Column) -> Column:
    return reduce(lambda a, b: a | b, preds, F.lit(False))


def w_ident(name: str) -> Column:
    return F.col("ident") == name


def w_family(version: int) -> Column:
    return F.col("af") == (2 if version == 4 else 10)


def w_proto(proto) -> Column:
    return F.col("prot") == (proto if isinstance(proto, int) else proto_number(proto))


def w_packets(n, cmp: str = "=", way: str = "in") -> Column:
    return compare(F.col("pkts" if way == "in" else "out_pkts"), n, cmp)


def w_bytes(n, cmp: str = "=", way: str = "in") -> Column:
    return compare(F.col("bytes" if way == "in" else "out_bytes"), n, cmp)


def w_flows(n, cmp: str = "=") -> Column:
    return compare(F.col("aggr_flows"), n, cmp)


def w_duration(n, cmp: str = "=") -> Column:
    return compare(numeric.duration_ms(), n, cmp)


def w_pps(n, cmp: str = "=") -> Column:
    return compare(numeric.pps(), n, cmp)


def w_bps(n, cmp: str = "=") -> Column:
    return compare(numeric.bps(), n, cmp)


def w_bpp(n, cmp: str = "=") -> Column:
    return compare(numeric.bpp(), n, cmp)


def w_tos(n, side: str = "src", cmp: str = "=") -> Column:
    return sided("tos", "dst_tos", side, lambda c: compare(c, n, cmp))


def w_flags(flags, cmp: str = "=", negate: bool = False) -> Column:
    """Numeric compare, or a letter set: all bits set (negated: none set)."""
    if isinstance(flags, int):
        return compare(F.col("tcp_flags"), flags, cmp)
    mask = flag_mask(flags)
    hit = F.col("tcp_flags").bitwiseAND(F.lit(mask))
    return hit == 0 if negate else hit == mask


def either_family(column: Column, texts: Sequence[str]) -> Column:
    """Whether an address is one of, or in one of, some addresses and networks of either family.

    Numeric columns hold IPv4 addresses, which no IPv6 text matches; text columns may hold both, each tested by its own
    family.  Which of the two it is Catalyst decides from the column's type.
    """
    four = [t for t in texts if ":" not in t]
    singles = [t.strip() for t in four if "/" not in t]
    nets = [t for t in four if "/" in t]
    # of the two casts one changes nothing, the other stands in the branch that the type decides against
    text, value = column.cast("string"), column.try_cast("bigint")

    def any_of(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def one_of(c: Column, members: list) -> list[Column]:
        return [c.isin(*members) if len(members) > 1 else c == members[0]] if members else []

    numeric = one_of(value, [int(ipaddress.IPv4Address(t)) for t in singles]) + [in_cidr(value, n) for n in nets]
    texts_of = one_of(text, singles)
    texts_of += [(F.instr(text, ":") == 0) & in_cidr(ipv4_num(text), n) for n in nets]
    texts_of += [(F.instr(text, ":") > 0) & in_prefix6(text, t) for t in texts if ":" in t]
    return F.when(F.typeof(column) == "string", any_of(texts_of)).otherwise(any_of(numeric))


def w_ip(*addresses: str, side: str = "either") -> Column:
    """Address equality or list membership, of either family; CIDR members allowed."""
    return sided("srcaddr", "dstaddr", side, lambda c: either_family(c, addresses))


def w_ip6(*addresses: str, side: str = "either") -> Column:
    return sided("srcaddr", "dstaddr", side,
                 lambda c: reduce(lambda a, b: a | b, [in_prefix6(c, t) for t in addresses]))


def net_text(net: str, mask: str | None) -> str:
    base, _, bits = net.partition("/")
    if ":" in base:
        return f"{base}/{bits}"
    parts = base.rstrip(".").split(".")
    if mask is not None:
        bits = bin(int(ipaddress.IPv4Address(mask))).count("1")
    base = ".".join(parts + ["0"] * (4 - len(parts)))
    return str(ipaddress.IPv4Network(f"{base}/{bits}", strict=False))


def w_net(net: str, mask: str | None = None, side: str = "either") -> Column:
    """``net a.b.c.d mask`` or ``net x/len``; the network is masked, and an
    IPv4 network may be abbreviated (``172.16/16``)."""
    return w_ip(net_text(net, mask), side=side)


def _single(column: str, addresses) -> Column:
    return either_family(F.col(column), addresses)


def w_next_ip(*addresses: str) -> Column:
    return _single("ip_nexthop", addresses)


def w_bgpnext_ip(*addresses: str) -> Column:
    return _single("bgp_nexthop", addresses)


def w_router_ip(*addresses: str) -> Column:
    return _single("ip_router", addresses)


def w_latency(kind: str, n, cmp: str = "=") -> Column:
    return compare(F.col({"client": "client_latency", "server": "server_latency",
                          "app": "app_latency"}[kind]), n, cmp)


def w_sysid(n: int) -> Column:
    return F.col("exporter_sysid") == n


def w_engine(kind: str, n: int, cmp: str = "=") -> Column:
    return compare(F.col("engine_type" if kind == "type" else "engine_id"), n, cmp)


def w_port(*ports, side: str = "either", cmp: str = "=") -> Column:
    """Port comparison, or membership when several ports are given."""
    if len(ports) > 1:
        return sided("srcport", "dstport", side, lambda c: c.isin(*[int(p) for p in ports]))
    return sided("srcport", "dstport", side, lambda c: compare(c, ports[0], cmp))


def w_icmp_type(n: int) -> Column:
    return (F.col("prot") == 1) & (icmp_type() == n)


def w_icmp_code(n: int) -> Column:
    return (F.col("prot") == 1) & (icmp_code() == n)


def w_as(*numbers, side: str = "either", cmp: str = "=") -> Column:
    def test(c):
        return c.isin(*numbers) if len(numbers) > 1 else compare(c, numbers[0], cmp)

    if side in ("prev", "next"):
        return test(F.col(f"{side}_as"))
    return sided("srcas", "dstas", side, test)


def w_mask(bits: int, side: str = "either") -> Column:
    return sided("src_mask", "dst_mask", side, lambda c: c == bits)


def w_if(n: int, side: str = "either") -> Column:
    side = {"in": "src", "out": "dst"}.get(side, side)
    return sided("input", "output", side, lambda c: c == n)


def w_vlan(n: int, side: str = "either") -> Column:
    return sided("src_vlan", "dst_vlan", side, lambda c: c == n)


def mac_number(mac) -> int:
    return mac if isinstance(mac, int) else int(mac.replace(":", ""), 16)


def w_mac(mac, side: str = "any") -> Column:
    """``side`` names one or more of in_src, out_dst, in_dst, out_src, or
    ``src``, ``dst``, ``in``, ``out``, ``any``."""
    cols = {"in_src": ["in_src_mac"], "out_dst": ["out_dst_mac"], "in_dst": ["in_dst_mac"],
            "out_src": ["out_src_mac"], "src": ["in_src_mac", "out_src_mac"],
            "dst": ["in_dst_mac", "out_dst_mac"], "in": ["in_src_mac", "in_dst_mac"],
            "out": ["out_src_mac", "out_dst_mac"],
            "any": ["in_src_mac", "out_dst_mac", "in_dst_mac", "out_src_mac"]}[side]
    n = mac_number(mac)
    return reduce(lambda a, b: a | b, [F.col(c) == n for c in cols])


def w_mpls_label(position: int, n, cmp: str = "=") -> Column:
    return F.coalesce(compare(numeric.mpls_label(position), n, cmp), F.lit(False))


def w_mpls_exp(position: int, n, cmp: str = "=") -> Column:
    return F.coalesce(compare(numeric.mpls_exp(position), n, cmp), F.lit(False))


def w_mpls_eos(n, cmp: str = "=") -> Column:
    """End-of-stack label value compared with ``n``."""
    value = F.call_function("shiftright", numeric.mpls_eos(), F.lit(4))
    return F.coalesce(compare(value, n, cmp), F.lit(False))


def w_mpls_any(n) -> Column:
    """Any label of the stack equals ``n``."""
    return F.coalesce(F.exists("mpls", lambda x: F.call_function("shiftright", x, F.lit(4)) == number(n)),
                      F.lit(False))


# Names of forwarding states and flow directions.
FORWARD_STATES = {"ukwn": 0, "forw": 1, "frag": 2, "drop": 16, "dacld": 17, "daclp": 18, "noroute": 19,
                  "dadj": 20, "dfrag": 21, "dbadh": 22, "dbadtlen": 23, "dbadhlen": 24, "dbadttl": 25,
                  "dpolicy": 26, "dwred": 27, "drpf": 28, "dforus": 29, "dbadof": 30, "dhw": 31,
                  "term": 128, "tadj": 129, "tincadj": 130, "tforus": 131}
DIRECTIONS = {"ingress": 0, "egress": 1}


def w_fwdstat(state) -> Column:
    return F.col("fwd_status") == (state if isinstance(state, int) else FORWARD_STATES[state.lower()])


def w_dir(direction) -> Column:
    return F.col("dir") == (direction if isinstance(direction, int) else DIRECTIONS[direction.lower()])


def w_l7(pname: str | None = None, qname: str | None = None, qtype: int | None = None) -> Column:
    """Exact L7 protocol, or exact DNS name and/or type.

    Name and type take precedence; a protocol given beside them must be
    ``dns``, else nothing matches.
    """
    if qname is None and qtype is None:
        return F.lit(True) if pname is None else F.col("pname") == pname
    if pname is not None and pname != "dns":
        return F.lit(False)
    cond = F.lit(True)
    if qname is not None:
        cond = cond & (F.col("qname") == qname)
    if qtype is not None:
        cond = cond & (F.col("qtype") == qtype)
    return cond


def stat_limit(column: str, expr: str) -> Column:
    """Row limit such as ``+100k`` (above) or ``-2m`` (below); strict."""
    return compare(F.col(column), expr[1:], ">" if expr[0] == "+" else "<")


def request_filter(base: Column | None = None, ip=None, ip1=None, ip2=None, proto=None,
                   port=None, port1=None, port2=None) -> Column:
    """A base predicate AND the single-value fields of a traffic request."""
    preds = [base if base is not None else w_any()]
    preds += [w_ip(a) for a in (ip, ip1, ip2) if a]
    preds += [w_proto(proto)] if proto is not None else []
    preds += [w_port(p) for p in (port, port1, port2) if p is not None]
    return w_all(*preds)


def _port_term(text: str, column: str) -> Column:
    negate, text = text.startswith("!"), text.lstrip("!")
    cmp = text[0] if text[0] in "<>" else "="
    cond = compare(F.col(column), text.lstrip("<>"), cmp)
    return ~cond if negate else cond


def _ip_term(text: str, column: str) -> Column:
    negate, text = text.startswith("!"), text.lstrip("!")
    cond = either_family(F.col(column), [net_text(text, None) if "/" in text else text])
    return ~cond if negate else cond


def _either(term, text: str, src: str, dst: str) -> Column:
    negate, bare = text.startswith("!"), text.lstrip("!")
    cond = term(bare, src) | term(bare, dst)
    return ~cond if negate else cond


def object_filter(mo) -> Column:
    """Predicate of a monitored object: IN puts the object on the destination
    side, OUT on the source side, ALL on either side."""
    preds = []
    if mo.direction == "ALL":
        for text, term, src, dst in ((mo.moip, _ip_term, "srcaddr", "dstaddr"),
                                     (mo.moport, _port_term, "srcport", "dstport"),
                                     (mo.pip, _ip_term, "srcaddr", "dstaddr"),
                                     (mo.pport, _port_term, "srcport", "dstport")):
            if text:
                preds.append(_either(term, text, src, dst))
    else:
        own, peer = ("dst", "src") if mo.direction == "IN" else ("src", "dst")
        for text, term, column in ((mo.moip, _ip_term, f"{own}addr"), (mo.moport, _port_term, f"{own}port"),
                                   (mo.pip, _ip_term, f"{peer}addr"), (mo.pport, _port_term, f"{peer}port")):
            if text:
                preds.append(term(text, column))
    if mo.protocol:
        preds.append(w_proto(mo.protocol))
    return w_all(*preds)
