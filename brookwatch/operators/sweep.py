"""Ranges that the driver holds, swept into disjoint intervals and looked up by an expression.

The ends of overlapping ranges cut the line into intervals, each covered by a known set of ranges.  A value finds its
interval by a binary search over the cut points, an expression without a join: one read of the rows, however many ranges
there are.  For ranges that come as a table see ``ranges``.
"""

from __future__ import annotations

import ipaddress
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.address import ipv4_num, parse_cidr, v6_groups


def sweep(ranges: Sequence[tuple]) -> tuple[list, list[tuple[int, int]]]:
    """Cut points of ranges (first, first beyond), and a pair (rank, index of the range) for each range of each interval.

    An interval's rank is the number of cut points not above it.
    """
    starts, ends = defaultdict(list), defaultdict(list)
    for i, (lo, beyond) in enumerate(ranges):
        if lo < beyond:
            starts[lo].append(i)
            ends[beyond].append(i)
    cuts, covering, cover = sorted({*starts, *ends}), set(), []
    for rank, at in enumerate(cuts, 1):
        covering.difference_update(ends.get(at, ()))
        covering.update(starts.get(at, ()))
        cover += [(rank, i) for i in sorted(covering)]
    return cuts, cover


def rank_of(value: Column, cuts: Sequence) -> Column:
    """Number of the sorted cut points that are not above the value, by binary search."""
    if not cuts:
        return F.lit(0)
    kind = "string" if isinstance(cuts[0], str) else "bigint"
    # one literal, folded to an array constant by Catalyst
    points = F.split(F.lit(",".join(map(str, cuts))), ",").cast(f"array<{kind}>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(points, at + step - 1) <= value, at + step).otherwise(at))


# ---- addresses of either family as one ordered key ----------------------

def order_key(address: Column | str) -> Column:
    """Text that orders addresses: IPv4 ones by number, then IPv6 ones."""
    c = F.col(address) if isinstance(address, str) else address
    six = F.concat_ws("", F.transform(v6_groups(c), lambda g: F.lpad(F.hex(g), 4, "0")))
    return F.when(F.instr(c, ":") > 0, F.concat(F.lit("6"), six)).otherwise(
        F.concat(F.lit("4"), F.lpad(F.hex(ipv4_num(c)), 8, "0")))


def bounds(network: str, text_keys: bool) -> tuple | None:
    """First and last key of a network or address; None for an IPv6 one where keys are IPv4 numbers.

    IPv4 bases are taken as written, IPv6 ones are masked.
    """
    if ":" in network:
        if not text_keys:
            return None
        net = ipaddress.IPv6Network(network.strip(), strict=False)
        return f"6{int(net.network_address):032X}", f"6{int(net.broadcast_address):032X}"
    lo, hi = parse_cidr(network)
    return (f"4{lo:08X}", f"4{hi:08X}") if text_keys else (lo, hi)


def beyond(last):
    """The first key after a range's last."""
    return last + "~" if isinstance(last, str) else last + 1
