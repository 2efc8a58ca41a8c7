"""Lookups and joins of flows with lists, intel, objects and features.

No side is hinted: Catalyst broadcasts a list only when its size estimate is
under the threshold, and otherwise shuffles with AQE splitting skewed keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import is_v6
from ..functions.names import proto_number
from ..functions.predicates import net_text
from ..functions.timefn import truncate
from ..rules import MonitoredObject
from ..schema import HOUR_SECONDS
from ..session import held_rows
from .ranges import net_hits, range_join
from .sweep import beyond, bounds, order_key, rank_of, sweep


def is_request() -> Column:
    return F.col("tos").bitwiseAND(F.lit(1)) == 1


def match_ip_list(flows: DataFrame, ips: DataFrame) -> DataFrame:
    """Flows touching a listed address, oriented so that it becomes ``sip``.

    TCP needs the initiator side and a listed destination; other protocols
    prefer a listed source (``ti_mark`` false) over a listed destination
    (true).  ``ips`` has columns ip and class.
    """
    one = ips.groupBy("ip").agg(F.max("class").alias("class"))
    src = one.select(F.col("ip").alias("_sip"), F.col("class").alias("_sclass"))
    dst = one.select(F.col("ip").alias("_dip"), F.col("class").alias("_dclass"))
    tcp = F.col("prot") == 6
    relevant = flows.where(~tcp | is_request())
    joined = (relevant.join(dst, F.col("dstaddr") == F.col("_dip"), "left")
              .join(src, ~tcp & (F.col("srcaddr") == F.col("_sip")), "left"))
    by_src = F.col("_sip").isNotNull()
    hit = joined.where(by_src | F.col("_dip").isNotNull())
    return hit.withColumns({
        "sip": F.when(by_src, F.col("srcaddr")).otherwise(F.col("dstaddr")),
        "dip": F.when(by_src, F.col("dstaddr")).otherwise(F.col("srcaddr")),
        "ti_mark": ~by_src,
        "class": F.when(by_src, F.col("_sclass")).otherwise(F.col("_dclass")),
    }).drop("_sip", "_dip", "_sclass", "_dclass")


def match_domain_intel(flows: DataFrame, intel: DataFrame, how: str = "inner", name: str = "qname") -> DataFrame:
    """Join rows with domain intel keyed by the md5 of the name."""
    one = intel.groupBy(F.col("md5").alias("_md5")).agg(*[F.max(c).alias(c) for c in intel.columns if c != "md5"])
    keyed = flows.withColumn("_h", F.when(F.col(name) != "", F.md5(F.col(name).cast("binary"))))
    return keyed.join(one, F.col("_h") == F.col("_md5"), how).drop("_h", "_md5")


def drop_whitelisted(flows: DataFrame, white: DataFrame, *keys: Column) -> DataFrame:
    """Drop rows any of whose keys (names, labels) is in the white list."""
    names = white.select(F.col(white.columns[0]).alias("_w")).distinct()
    for key in keys:
        flows = flows.join(names, key == F.col("_w"), "left_anti")
    return flows


def filter_labels(flows: DataFrame, include: Sequence[Column] = (), exclude: Sequence[Column] = ()) -> DataFrame:
    """Drop on any exclude label; keep on any include label, or all without one."""
    kept = F.lit(not include)
    for c in include:
        kept = kept | F.coalesce(c, F.lit(False))
    dropped = F.lit(False)
    for c in exclude:
        dropped = dropped | F.coalesce(c, F.lit(False))
    return flows.where(~dropped & kept)


def _mark(flows: DataFrame, features: DataFrame, on: dict[str, str], flag: str) -> DataFrame:
    keys = features.select(F.col("hour").alias("_hour"), *[F.col(f).alias(f"_k_{f}") for f in on.values()]).distinct()
    keys = keys.withColumn(flag, F.lit(True))
    cond = F.col("_fh") == F.col("_hour")
    for mine, theirs in on.items():
        cond = cond & (F.col(mine) == F.col(f"_k_{theirs}"))
    return flows.join(keys, cond, "left").drop("_hour", *[f"_k_{f}" for f in on.values()])


def tag_flows(flows: DataFrame, port_scans: DataFrame | None = None, ip_scans: DataFrame | None = None,
              services: DataFrame | None = None, popular: DataFrame | None = None) -> DataFrame:
    """Tags from the features of the flow's hour.

    ``scanner`` 1 for a scanning source on the port or a scanned pair,
    ``service`` 2 for a known service at the destination, ``popular_service``
    bit 1 for a popular source, bit 2 for a popular destination.
    """
    out = flows.withColumn("_fh", truncate("first", HOUR_SECONDS))
    none = F.lit(None).cast("boolean")
    out = (_mark(out, port_scans, {"srcaddr": "srcaddr", "prot": "prot", "dstport": "dstport"}, "_ps")
           if port_scans is not None else out.withColumn("_ps", none))
    out = (_mark(out, ip_scans, {"srcaddr": "srcaddr", "dstaddr": "dstaddr", "prot": "prot"}, "_is")
           if ip_scans is not None else out.withColumn("_is", none))
    out = (_mark(out, services, {"dstaddr": "addr", "prot": "prot", "dstport": "port"}, "_sv")
           if services is not None else out.withColumn("_sv", none))
    if popular is not None:
        out = _mark(out, popular, {"srcaddr": "sip"}, "_p1")
        out = _mark(out, popular, {"dstaddr": "sip"}, "_p2")
    else:
        out = out.withColumns({"_p1": none, "_p2": none})
    return out.withColumns({
        "scanner": F.when(F.col("_ps") | F.col("_is"), 1).otherwise(0),
        "service": F.when(F.col("_sv"), 2).otherwise(0),
        "popular_service": F.when(F.col("_p1"), 1).otherwise(0) + F.when(F.col("_p2"), 2).otherwise(0),
    }).drop("_fh", "_ps", "_is", "_sv", "_p1", "_p2")


def tag_list(flows: DataFrame, ips: DataFrame, tag: str) -> DataFrame:
    """Tag 1 for a listed source, plus 2 for a listed destination."""
    one = ips.select(F.col("ip")).distinct()
    return (flows.join(one.select(F.col("ip").alias("_s")), F.col("srcaddr") == F.col("_s"), "left")
            .join(one.select(F.col("ip").alias("_d")), F.col("dstaddr") == F.col("_d"), "left")
            .withColumn(tag, F.when(F.col("_s").isNotNull(), 1).otherwise(0)
                        + F.when(F.col("_d").isNotNull(), 2).otherwise(0))
            .drop("_s", "_d"))


def tag_bw(flows: DataFrame, black: DataFrame, white: DataFrame) -> DataFrame:
    return tag_list(tag_list(flows, black, "blacklist"), white, "whitelist")


_OBJECT_FIELDS = ("_side int, _rank int, moid int, direction string, _at_src boolean, _at_dst boolean, "
                  "_lo {0}, _hi {0}, _not boolean, _plo {0}, _phi {0}, _pnot boolean, "
                  "_port_lo int, _port_hi int, _port_not boolean, _pport_lo int, _pport_hi int, _pport_not boolean, "
                  "_proto_lo int, _proto_hi int")
SRC, DST, ANY = 0, 1, 2  # the side by whose address an object is found; ANY: by none
_LEAST, _MOST = -(1 << 31), (1 << 31) - 1


def _port_range(text: str) -> tuple[int, int, bool]:
    """First and last port of a port selector, and whether it is negated."""
    bare = text.lstrip("!")
    if not bare:
        return _LEAST, _MOST, False
    value = int(bare.lstrip("<>"))
    lo, hi = {"<": (_LEAST, value - 1), ">": (value + 1, _MOST)}.get(bare[0], (value, value))
    return lo, hi, text.startswith("!")


def _object_row(m: MonitoredObject, text_keys: bool) -> tuple[str, tuple, list[str], tuple] | None:
    """An object's own network, its bounds, the networks it names and its row; None for one that nothing matches.

    The network is empty for an object that no side finds: one without an own address, or with an excluded one.  An object
    of the other address family matches nothing, unless that address is excluded.
    """
    every = ("", "~") if text_keys else (-(1 << 63), (1 << 63) - 1)

    def net(text: str) -> tuple | None:
        """An address selector's network, its bounds and whether they are excluded; None for one that nothing matches."""
        bare = text.lstrip("!")
        if not bare:
            return ("", *every, False)
        bare = net_text(bare, None) if "/" in bare else bare.strip()
        known = bounds(bare, text_keys)
        if known is None:
            return ("", *every, False) if text.startswith("!") else None
        return (bare, *known, text.startswith("!"))

    own, peer = net(m.moip), net(m.pip)
    if own is None or peer is None:
        return None
    proto = (proto_number(m.protocol),) * 2 if m.protocol else (_LEAST, _MOST)
    row = (m.id, m.direction, m.direction != "IN", m.direction != "OUT", *own[1:], *peer[1:], *_port_range(m.moport),
           *_port_range(m.pport), *proto)
    return "" if own[3] else own[0], own[1:3], [n for n in (own[0], peer[0]) if n], row


def _object_table(mos: Sequence[MonitoredObject], text_keys: bool) -> tuple[list, list[tuple]]:
    """Cut points of the objects' own addresses, and a row per object, side and interval."""
    keyed, fixed = [], []
    for m in mos:
        if (known := _object_row(m, text_keys)) is None:
            continue
        net, own, _, row = known
        if not net:
            fixed.append((ANY, 0, *row))
        else:
            keyed += [(side, own, row) for side in {"IN": [DST], "OUT": [SRC]}.get(m.direction, [SRC, DST])]
    cuts, cover = sweep([(own[0], beyond(own[1])) for _, own, _ in keyed])
    return cuts, [(keyed[i][0], rank, *keyed[i][2]) for rank, i in cover] + fixed


def _object_rows(objects: DataFrame, text_keys: bool) -> DataFrame:
    """The rows of a table of objects, of any size, with the own network as ``_net`` and all named ones as ``_nets``.

    Fields that are missing or null are empty; objects without an id are left out.
    """
    names = [f.name for f in fields(MonitoredObject) if f.name in objects.columns]
    ddl = "_net string, _nets array<string>, " + _OBJECT_FIELDS.format("string" if text_keys else "bigint").split(", ", 2)[2]
    columns = [c.split()[0] for c in ddl.split(", ")]

    def rows(batches):
        for batch in batches:
            out = []
            for values in zip(*(batch[c].tolist() for c in names), strict=True):
                m = MonitoredObject(**{k: v for k, v in zip(names, values, strict=True) if v is not None and v == v})
                if (known := _object_row(m, text_keys)) is not None:
                    net, _, nets, row = known
                    out.append((net, nets, *row))
            yield pd.DataFrame(out, columns=columns)

    cores = objects.sparkSession.sparkContext.defaultParallelism
    return objects.where("id IS NOT NULL").select(*names).repartition(cores).mapInPandas(rows, ddl)


def _found_in_table(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Keys with the objects of a table that are found by one of their addresses, or by none."""
    ends = keys.select(F.explode(F.array("srcaddr", "dstaddr")).alias("_end")).distinct()
    nets = rows.where("_net <> ''").select(F.col("_net").alias("_named")).distinct()
    hits = net_hits(ends, "_end", nets, "_named").select("_address", F.col("_named").alias("_net"))
    sides = F.array(F.struct(F.lit(SRC).alias("_side"), F.col("srcaddr").alias("_end")),
                    F.struct(F.lit(DST).alias("_side"), F.col("dstaddr").alias("_end")))
    by_end = keys.withColumn("_probe", F.explode(sides)).select("*", "_probe.*").drop("_probe").join(
        hits, F.col("_end") == F.col("_address")).drop("_end", "_address")
    by_none = keys.withColumns({"_side": F.lit(ANY), "_net": F.lit("")})
    of_side = F.filter(F.array(F.when(F.col("_at_src"), SRC), F.when(F.col("_at_dst"), DST)), lambda x: x.isNotNull())
    objects = rows.withColumn("_side", F.explode(F.when(F.col("_net") == "", F.array(F.lit(ANY))).otherwise(of_side)))
    return by_end.unionByName(by_none).join(objects.drop("_nets"), ["_side", "_net"])


def combine_for(flows: DataFrame, objects: DataFrame) -> DataFrame:
    """Flows combined where no object of a table tells them apart: counters per class, with the key of one of its flows.

    Ports and protocols fall into the intervals that the selectors cut, addresses lie in the same named networks; the
    smallest value stands for each class.  The objects that match a row of the result match all flows it counts.
    """
    rows = _object_rows(objects, is_v6(flows, "srcaddr"))

    def cuts(*ranges: tuple[str, str]) -> list[int]:
        """Where the ranges begin and end, no more of them than there are ports or protocols."""
        ends = [x for lo, hi in ranges for x in (F.col(lo).cast("bigint"), F.col(hi).cast("bigint") + 1)]
        return sorted(r.at for r in rows.select(F.explode(F.array(*ends)).alias("at")).distinct().collect())

    ports = cuts(("_port_lo", "_port_hi"), ("_pport_lo", "_pport_hi"))
    classes = {"srcport": ports, "dstport": ports, "prot": cuts(("_proto_lo", "_proto_hi"))}
    ranks = [F.when(F.col(c).isNotNull(), rank_of(F.col(c), at)).alias(f"_{c}") for c, at in classes.items()]
    some = flows.groupBy("srcaddr", "dstaddr", *ranks).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("flows"),
        F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"), *[F.min(c).alias(c) for c in classes])
    ends = some.select(F.explode(F.array("srcaddr", "dstaddr")).alias("_end")).where("_end IS NOT NULL").distinct()
    nets = rows.select(F.explode("_nets").alias("_named")).distinct()
    held = net_hits(ends, "_end", nets, "_named").groupBy("_address").agg(F.sort_array(F.collect_set("_named")).alias("_held"))
    held = ends.join(held, F.col("_end") == F.col("_address"), "left").select(
        "_end", F.coalesce("_held", F.array().cast("array<string>")).alias("_held"))
    alike = held.join(held.groupBy("_held").agg(F.min("_end").alias("_one")), "_held").select("_end", "_one")
    for c in ("srcaddr", "dstaddr"):
        some = some.join(alike, F.col(c) == F.col("_end"), "left").drop(c, "_end").withColumnRenamed("_one", c)
    return some.groupBy("srcaddr", "dstaddr", *[f"_{c}" for c in classes]).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("flows").alias("flows"), F.sum("pkts").alias("pkts"),
        F.sum("bytes").alias("bytes"), *[F.min(c).alias(c) for c in classes]).drop(*[f"_{c}" for c in classes])


def match_mo(flows: DataFrame, mos: Sequence[MonitoredObject] | DataFrame) -> DataFrame:
    """One row per flow and matching object, with ``moid`` and ``direction``.

    The objects' addresses are swept into disjoint intervals; a flow finds the intervals of its two addresses by binary
    search and is joined with the objects of those, whatever their number, in one read.  Numeric addresses are IPv4, texts
    may be of either family.  Objects may come as a table of any size: distinct addresses are then looked up by a sweep.
    """
    text_keys = is_v6(flows, "srcaddr")
    key = order_key if text_keys else F.col
    keys = flows.withColumns({"_src": key("srcaddr"), "_dst": key("dstaddr")})
    if isinstance(mos, DataFrame):
        return _fitting(_found_in_table(keys, _object_rows(mos, text_keys)), flows.columns)
    mos = sorted(mos, key=lambda m: m.id)
    cuts, rows = _object_table(mos, text_keys)
    if not rows:
        return flows.limit(0).withColumns({"moid": F.lit(0), "direction": F.lit("")})
    objects = held_rows(flows.sparkSession, rows, _OBJECT_FIELDS.format("string" if text_keys else "bigint"))
    sides = {r[0] for r in rows}
    probes = [F.struct(F.lit(side).alias("_side"), rank.alias("_rank")) for side, rank in (
        (SRC, rank_of(F.col("_src"), cuts)), (DST, rank_of(F.col("_dst"), cuts)), (ANY, F.lit(0))) if side in sides]
    found = keys.withColumn("_probe", F.explode(F.array(*probes))).select("*", "_probe.*").join(objects, ["_side", "_rank"])
    return _fitting(found, flows.columns)


def _fitting(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Of flows with the objects found by their addresses those that fit all selectors, once each."""
    def fits(lo: str, hi: str, negated: str, at_src: str, at_dst: str) -> Column:
        """Whether the value on the object's side, or on either for an object of both, is in the range, or out of it."""
        return ((F.col("_at_src") & F.col(at_src).between(F.col(lo), F.col(hi)))
                | (F.col("_at_dst") & F.col(at_dst).between(F.col(lo), F.col(hi)))) != F.col(negated)

    # an object of both directions that holds both addresses is found twice
    again = (F.col("_side") == DST) & F.col("_at_src") & F.col("_src").between(F.col("_lo"), F.col("_hi"))
    hit = found.where(~again & fits("_lo", "_hi", "_not", "_src", "_dst") & fits("_plo", "_phi", "_pnot", "_dst", "_src")
                      & fits("_port_lo", "_port_hi", "_port_not", "srcport", "dstport")
                      & fits("_pport_lo", "_pport_hi", "_pport_not", "dstport", "srcport")
                      & F.col("prot").between(F.col("_proto_lo"), F.col("_proto_hi")))
    return hit.select(*columns, "moid", "direction")


def pair_requests(req: DataFrame, res: DataFrame, key) -> DataFrame:
    """Requests with ``has_res``: a response on the same key, or a return code."""
    answered = res.select(*key).distinct().withColumn("_res", F.lit(True))
    return (req.join(answered, list(key), "left")
            .withColumn("has_res", F.coalesce(F.col("_res"), F.col("http_ret_code") != 0)).drop("_res"))


def service_roles(flows: DataFrame) -> DataFrame:
    """One row per flow and endpoint role, with ``addr``, ``port``, ``srv_mark``.

    Mark 0 is a requested destination (any UDP, initiating TCP), mark 1 a
    responding source; ``client`` is 1 where that source is an initiating TCP
    client.
    """
    tcp_req = (F.col("prot") == 6) & is_request()

    def role(mark, side, client):
        return F.struct(F.lit(mark).alias("srv_mark"), F.col(f"{side}addr").alias("addr"),
                        F.col(f"{side}port").alias("port"), client.cast("int").alias("client"))

    roles = F.array(role(0, "dst", F.lit(0)), role(1, "src", tcp_req))
    both = flows.withColumn("_r", F.explode(roles)).select("*", "_r.*").drop("_r")
    return both.where((F.col("srv_mark") == 1) | (F.col("prot") == 17) | tcp_req)


def pair_services(flows: DataFrame, app: Column, run=("devid",)) -> DataFrame:
    """Services whose responding and requested endpoints answer each other.

    A responder must have requests and must not act as a client.  Flows are
    counted per (endpoint, role, protocol name), and a second aggregation over
    those few rows puts the roles of an endpoint side by side with their latest
    protocol name: one pass over the flows and no join.  The result has one row
    per endpoint and ``srv_mark``.
    """
    key = [*run, "addr", "port", "prot"]
    named = service_roles(flows).groupBy(*key, "srv_mark", app.alias("_app")).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("flows"),
        F.sum("pkts").alias("pkts"), F.sum("bytes").alias("bytes"), F.max("client").alias("client"))

    def of(mark, c):
        return F.when(F.col("srv_mark") == mark, F.col(c))

    cols = [F.max(of(1, "client")).alias("_client")]
    for m in (0, 1):
        cols += [F.min(of(m, "first")).alias(f"_first{m}"), F.max(of(m, "last")).alias(f"_last{m}")]
        cols += [F.sum(of(m, c)).alias(f"_{c}{m}") for c in ("flows", "pkts", "bytes")]
        cols.append(F.max(F.when((F.col("srv_mark") == m) & (F.col("_app") != ""), F.struct("last", "_app")))
                    .alias(f"_app{m}"))
    both = named.groupBy(*key).agg(*cols).where(
        (F.col("_client") == 0) & (F.col("_flows0") > 0) & (F.col("_flows1") > 0))
    sides = F.explode(F.array(*[F.struct(
        F.lit(m).alias("srv_mark"), *[F.col(f"_{c}{m}").alias(c) for c in ("first", "last", "flows", "pkts", "bytes")],
        F.coalesce(F.col(f"_app{m}._app"), F.lit("")).alias("app_proto")) for m in (1, 0)]))
    return both.select(*key, sides.alias("_s")).select(*key, "_s.*")


def ip_location(df: DataFrame, address: str, ranges: DataFrame) -> DataFrame:
    """Left join of each address with the location of its narrowest range.

    Distinct addresses are looked up once; the per-address result is joined back.
    """
    ips = df.select(F.col(address).alias("_ip")).distinct()
    hits = range_join(ips, "_ip", ranges.select("lo", "hi", "location"))
    best = hits.groupBy("_ip").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo", "location")).alias("_b"))
    return (df.join(best.select("_ip", F.col("_b.location").alias("location")), F.col(address) == F.col("_ip"), "left")
            .drop("_ip"))


def policy_labels(labels: Sequence[str], policies: Sequence[dict], mos: Sequence[MonitoredObject], devid: int,
                  groupid: int | None = None) -> list[str]:
    """Expand a label list: ``mo`` becomes ``mo_<id>`` of the device (and group);
    unknown labels are dropped."""
    known = {p["label"] for p in policies}
    out = []
    for label in labels:
        if label == "mo":
            out += [f"mo_{m.id}" for m in mos
                    if m.devid == devid and (groupid is None or m.groupid == groupid)]
        elif label in known:
            out.append(label)
    return out


def event_evidence(events: DataFrame, details: DataFrame) -> DataFrame:
    """Evidence rows of events, joined on (time, type, object)."""
    d = details.select(F.col("time").alias("_t"), F.col("type_id").alias("_ty"), F.col("obj").alias("_o"),
                       *[c for c in details.columns if c not in ("time", "type_id", "obj", "model_id", "config_id")])
    d = d.distinct()
    clash = [c for c in d.columns if c in events.columns]
    for c in clash:
        d = d.withColumnRenamed(c, f"detail_{c}")
    return (events.join(d, (F.col("time") == F.col("_t")) & (F.col("type_id") == F.col("_ty"))
                        & (F.col("obj") == F.col("_o"))).drop("_t", "_ty", "_o"))
