"""IPv4 and IPv6 addresses as column expressions.

IPv4 addresses are bigint columns; IPv6 addresses are text columns.  Every
function here is a built-in expression, so nothing leaves the JVM.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shr(x, n) -> Column:
    return F.call_function("shiftright", _c(x), n if isinstance(n, Column) else F.lit(n))


def shl(x, n) -> Column:
    return F.call_function("shiftleft", _c(x), n if isinstance(n, Column) else F.lit(n))


# ---- IPv4 -------------------------------------------------------------

def ipv4_str(n) -> Column:
    n = _c(n)
    octets = [shr(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.concat_ws(".", *octets)


def ipv4_num(s) -> Column:
    """Address number; 0 for text that is not an IPv4 address."""
    s = F.trim(_c(s))
    p = F.split(s, r"\.")
    n = sum((F.try_to_number(p[i], F.lit("999")).cast("bigint") * (1 << sh)
             for i, sh in ((1, 16), (2, 8), (3, 0))),
            F.try_to_number(p[0], F.lit("999")).cast("bigint") * (1 << 24))
    return F.when(is_ipv4_text(s), n).otherwise(F.lit(0).cast("bigint"))


_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
IPV4_CIDR_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}/(3[0-2]|[12]?[0-9])$"


def is_ipv4_text(s) -> Column:
    return _c(s).rlike(IPV4_PATTERN)


def is_ipv4_cidr_text(s) -> Column:
    return _c(s).rlike(IPV4_CIDR_PATTERN)


def is_private(n) -> Column:
    n = _c(n)
    return (n.between(0x0A000000, 0x0AFFFFFF) | n.between(0xAC100000, 0xAC1FFFFF)
            | n.between(0xC0A80000, 0xC0A8FFFF))


def mask_v4(n, bits) -> Column:
    """Address with all but its first ``bits`` bits cleared."""
    host = F.lit(32) - (bits if isinstance(bits, Column) else F.lit(bits))
    return shl(shr(n, host), host)


def src_net() -> Column:
    return mask_v4("srcaddr", F.col("src_mask"))


def dst_net() -> Column:
    return mask_v4("dstaddr", F.col("dst_mask"))


def parse_cidr(text: str) -> tuple[int, int]:
    """Bounds ``[base, base + 2^(32-len) - 1]``; the base is taken as written."""
    base, _, bits = text.strip().partition("/")
    lo = int(ipaddress.IPv4Address(base))
    return lo, lo + (1 << (32 - int(bits or 32))) - 1


def in_cidr(n, text: str) -> Column:
    lo, hi = parse_cidr(text)
    n = _c(n)
    return n == lo if lo == hi else n.between(lo, hi)


def cidr_bounds(text) -> tuple[Column, Column]:
    """Bounds of a CIDR or single-address text column."""
    text = F.trim(_c(text))
    lo = ipv4_num(F.substring_index(text, "/", 1))
    bits = F.when(F.instr(text, "/") > 0, F.substring_index(text, "/", -1)).otherwise("32").cast("int")
    return lo, lo + shl(F.lit(1).cast("bigint"), F.lit(32) - bits) - 1


# ---- IPv6 -------------------------------------------------------------

def bind(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` (keeps expressions small)."""
    return F.transform(F.array(value), fn)[0]


def v6_groups(s) -> Column:
    """The eight 16-bit groups of an IPv6 text as an array<bigint>."""
    return bind(_undotted(F.lower(F.trim(_c(s)))), lambda t: bind(F.split(t, "::"), _fill_groups))


def _undotted(s: Column) -> Column:
    """Text with a dotted IPv4 tail rewritten as two groups."""
    def rewrite(q):
        return F.concat(F.lower(F.hex(q[0] * 256 + q[1])), F.lit(":"), F.lower(F.hex(q[2] * 256 + q[3])))

    tail = F.substring_index(s, ":", -1)
    octets = F.transform(F.split(tail, r"\."), lambda x: x.cast("int"))
    return F.when(F.instr(s, ".") > 0, F.concat(s.substr(F.lit(1), F.length(s) - F.length(tail)),
                                                bind(octets, rewrite))).otherwise(s)


def _fill_groups(halves: Column) -> Column:
    def groups(text):
        return F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda g: g != "")

    def fill(p):
        missing = F.greatest(F.lit(8) - F.size(p["left"]) - F.size(p["right"]), F.lit(0))
        every = F.concat(p["left"], F.array_repeat(F.lit("0"), missing), p["right"])
        return F.transform(every, lambda g: F.conv(g, 16, 10).cast("bigint"))

    return bind(F.struct(groups(F.get(halves, F.lit(0))).alias("left"),
                         groups(F.get(halves, F.lit(1))).alias("right")), fill)


def v6_halves(s) -> Column:
    """Struct of the high and low 64 bits."""
    return bind(v6_groups(s), lambda g: F.struct(_half(g, 0).alias("high"), _half(g, 4).alias("low")))


def _half(groups: Column, start: int) -> Column:
    return (shl(groups[start], 48).bitwiseOR(shl(groups[start + 1], 32))
            .bitwiseOR(shl(groups[start + 2], 16)).bitwiseOR(groups[start + 3]))


def v6_text(groups: Column) -> Column:
    """Shortest text of eight groups: the longest run of zero groups (two or
    more, leftmost) becomes ``::``; mapped IPv4 tails are dotted."""
    return bind(groups, _v6_text)


def _v6_text(groups: Column) -> Column:
    hexed = F.concat(F.lit(":"), F.concat_ws(":", F.transform(groups, lambda g: F.lower(F.hex(g)))), F.lit(":"))
    dotted = F.concat_ws(".", shr(groups[6], 8).cast("string"), groups[6].bitwiseAND(F.lit(255)).cast("string"),
                         shr(groups[7], 8).cast("string"), groups[7].bitwiseAND(F.lit(255)).cast("string"))
    zero5 = F.forall(F.slice(groups, 1, 5), lambda g: g == 0)
    return (F.when(zero5 & (groups[5] == 0xFFFF), F.concat(F.lit("::ffff:"), dotted))
            .when(zero5 & (groups[5] == 0) & (groups[6] != 0), F.concat(F.lit("::"), dotted))
            .otherwise(bind(hexed, _compress)))


def _compress(body: Column) -> Column:
    out = None
    for n in range(8, 1, -1):
        run = ":0" * n + ":"
        at = F.instr(body, run)
        prefix = body.substr(F.lit(1), at - 1)
        suffix = body.substr(at + len(run), F.lit(64))
        text = F.concat(prefix.substr(2, 64), F.lit("::"), F.regexp_replace(suffix, ":$", ""))
        out = F.when(at > 0, text) if out is None else out.when(at > 0, text)
    return out.otherwise(F.regexp_replace(body, "^:|:$", ""))


def ipv6_norm(s) -> Column:
    return v6_text(v6_groups(s))


IPV6_PATTERN = (r"^(?=.*:.*:)(?!.*:::)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)"
                r"(?:[0-9A-Fa-f]{0,4}:){0,7}(?:[0-9A-Fa-f]{0,4}|" + _OCTET + r"(?:\." + _OCTET + r"){3})$")


def is_ipv6_text(s) -> Column:
    """True for well-formed IPv6 text (group count checked with and without ``::``)."""
    s = _c(s)
    groups = F.size(F.filter(F.split(s, ":"), lambda g: g != "")) + F.when(F.instr(s, ".") > 0, 1).otherwise(0)
    count_ok = F.when(F.instr(s, "::") > 0, groups <= 7).otherwise(groups == 8)
    return s.rlike(IPV6_PATTERN) & count_ok


def in_prefix6(s, prefix: str) -> Column:
    """True prefix match of IPv6 text against ``net/len`` (or one address)."""
    net = ipaddress.IPv6Network(prefix.strip(), strict=False)
    value, bits = int(net.network_address), net.prefixlen

    high_mask = ((1 << 64) - 1) ^ ((1 << max(64 - bits, 0)) - 1)
    low_mask = ((1 << 64) - 1) ^ ((1 << min(128 - bits, 64)) - 1)
    return bind(v6_halves(s), lambda halves: _prefix_cond(halves, value, bits, high_mask, low_mask))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _prefix_cond(halves: Column, value: int, bits: int, high_mask: int, low_mask: int) -> Column:
    cond = halves["high"].bitwiseAND(F.lit(_signed(high_mask))) == F.lit(_signed((value >> 64) & high_mask))
    if bits > 64:
        cond = cond & (halves["low"].bitwiseAND(F.lit(_signed(low_mask)))
                       == F.lit(_signed(value & low_mask & ((1 << 64) - 1))))
    return cond


# ---- either family ----------------------------------------------------

def is_v6(df: DataFrame, name: str = "srcaddr") -> bool:
    """Whether addresses are texts, of IPv6 or of both families, and not numbers of IPv4."""
    return isinstance(df.schema[name].dataType, T.StringType)


def in_network(df: DataFrame, name: str, text: str) -> Column:
    """Membership of an address column in one CIDR, by the column's family."""
    if ":" in text:
        return in_prefix6(name, text) if is_v6(df, name) else F.lit(False)
    return F.lit(False) if is_v6(df, name) else in_cidr(name, text)


def in_networks(df: DataFrame, name: str, texts) -> Column:
    cond = F.lit(False)
    for text in texts:
        cond = cond | in_network(df, name, text)
    return cond


def addr_text(df: DataFrame, name: str, bracket: bool = True) -> Column:
    """Printable address: dotted IPv4, or bracketed IPv6 text; a text column may hold both."""
    if is_v6(df, name):
        six = F.concat(F.lit("["), F.col(name), F.lit("]"))
        return F.when(F.instr(F.col(name), ":") > 0, six).otherwise(F.col(name)) if bracket else F.col(name)
    return ipv4_str(name)


def condense_v6(s) -> Column:
    s = _c(s)
    return F.when(F.length(s) > 16, F.concat(s.substr(1, 7), F.lit(".."), F.right(s, F.lit(7)))).otherwise(s)
