"""Rule matching by tuple-space search.

Rules are a table of any size.  A rule's selectors are texts, empty where it takes anything.  A key answers to a selector
with the texts it satisfies - the networks its address lies in, its port, its protocol - and with the empty text, so each
combination of one answer per selector is a probe into the space of one group of rules, those with the same selectors set.
All groups are searched by one equi join, and the deciding rule is the smallest (class, id) of a key: one aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import is_v6
from ..functions.timefn import schedule_ok
from ..rules import Pattern, Rule, Window, rule_table, split_list
from ..session import held_rows
from .ranges import net_hits
from .sweep import beyond, bounds, order_key, rank_of, sweep

Rules = Sequence[Rule] | DataFrame

# Selector presence per specificity class, most specific first.
CLASSES = [(1, 1, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


@dataclass(frozen=True, eq=False)
class Selector:
    """How keys answer to one selector of the rules.

    Either ``address``, a column looked up in the rules' networks, or ``answers``, the texts a key satisfies, to which
    the rules' texts are made equal by ``normal``.  ``listed`` selectors hold several texts between commas, of which one
    is enough.
    """

    address: str | None = None
    answers: Column | None = None
    normal: Callable[[Column], Column] = lambda text: text
    listed: bool = False


def network(address: str, listed: bool = False) -> Selector:
    return Selector(address=address, listed=listed)


def words(*answers: Column, normal: Callable[[Column], Column] = lambda text: text, listed: bool = False) -> Selector:
    return Selector(answers=F.array(*[a.cast("string") for a in answers]), normal=normal, listed=listed)


Selectors = dict[str, Selector]


def pattern_rules(patterns: Sequence[Pattern], kind: str, measure: str) -> list[Rule]:
    """Feature patterns of one type as rules; ``measure`` is peers or flows."""
    out = []
    for p in patterns:
        if p.type == kind and getattr(p, measure) is not None:
            out.append(Rule(config_id=len(out) + 1, sip=p.sip, dip=p.dip, ip=p.dip, port=p.dport,
                            protocol=p.protocol, min=getattr(p, measure), qcount=p.flows or 0))
    return out


def _texts(table: DataFrame, selectors: Selectors) -> DataFrame:
    """The rules' ids with a column ``_t<i>`` of their texts per selector, empty for none; a row for each listed text."""
    out = table.select("config_id", *[F.trim(F.col(name)).alias(f"_t{i}") for i, name in enumerate(selectors)])
    for i, sel in enumerate(selectors.values()):
        if sel.listed:
            some = F.filter(F.transform(F.split(F.col(f"_t{i}"), ","), lambda t: F.trim(t)), lambda t: t != "")
            out = out.withColumn(f"_t{i}", F.explode(F.when(F.size(some) > 0, some).otherwise(F.array(F.lit("")))))
        out = out.withColumn(f"_t{i}", F.when(F.col(f"_t{i}") == "", "").otherwise(sel.normal(F.col(f"_t{i}"))))
    return out


def _held_networks(keys: DataFrame, address: str, texts: list[str], name: str) -> DataFrame:
    """The networks of each key's address as an array, for networks that the driver holds: looked up by an expression."""
    by_text = is_v6(keys, address)
    known = [(t, b) for t in texts if (b := bounds(t, by_text)) is not None]
    cuts, cover = sweep([(lo, beyond(hi)) for _, (lo, hi) in known])
    of_rank: dict[int, list[str]] = {}
    for rank, i in cover:
        of_rank.setdefault(rank, []).append(known[i][0])
    table = held_rows(keys.sparkSession, list(of_rank.items()), f"_rank int, {name} array<string>")
    value = order_key(address) if by_text else F.col(address)
    return keys.withColumn("_rank", rank_of(value, cuts)).join(table, "_rank", "left").drop("_rank")


def _networks(keys: DataFrame, address: str, nets: DataFrame, name: str) -> DataFrame:
    """The same for a table of networks: distinct addresses are looked up by a sweep."""
    hits = net_hits(keys, address, nets, "_net").groupBy("_address").agg(F.collect_set("_net").alias(name))
    return keys.join(hits, F.col(address) == F.col("_address"), "left").drop("_address")


def _probes(keys: DataFrame, rules: Rules, texts: DataFrame, selectors: Selectors) -> DataFrame:
    """Keys, once for each combination of one answer, or none, per selector."""
    for i, (name, sel) in enumerate(selectors.items()):
        answers = sel.answers
        if sel.address is not None:
            if isinstance(rules, DataFrame):
                nets = texts.select(F.col(f"_t{i}").alias("_net")).where("_net <> ''").distinct()
                keys = _networks(keys, sel.address, nets, f"_m{i}")
            else:
                given = {t for r in rules for t in (split_list(getattr(r, name)) if sel.listed else [getattr(r, name).strip()]) if t}
                keys = _held_networks(keys, sel.address, sorted(given), f"_m{i}")
            answers = F.coalesce(F.col(f"_m{i}"), F.array().cast("array<string>"))
        keys = keys.withColumn(f"_t{i}", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), answers)))).drop(f"_m{i}")
    return keys


def _values(table: DataFrame) -> DataFrame:
    return table.select(F.col("config_id").alias("_id"), F.struct("*").alias("rule"))


def best_rule(keys: DataFrame, rules: Rules, selectors: Selectors) -> DataFrame:
    """Attach the deciding rule as ``rule`` (null where none matches) to distinct keys.

    There are three selectors, in order of weight.  The first class holding a matching rule decides, whether or not its
    threshold is met; equal selectors, and equal classes, are decided by the lowest id.
    """
    table = rule_table(keys.sparkSession, rules)
    texts, at = _texts(table, selectors), [f"_t{i}" for i in range(len(selectors))]
    present = F.concat(*[F.when(F.col(t) == "", "0").otherwise("1") for t in at])
    order = F.lit(None).cast("int")
    for i, c in enumerate(CLASSES):
        order = F.when(present == "".join(map(str, c)), i).otherwise(order)
    ranked = texts.groupBy(*at).agg(F.min("config_id").alias("_id")).withColumn("_order", F.struct(order.alias("class"), "_id"))
    ranked = ranked.select(*at, (F.col("_order.class").cast("bigint") * (1 << 32) + F.col("_id")).alias("_order"))
    found = _probes(keys, rules, texts, selectors).join(ranked, at, "left").groupBy(*keys.columns).agg(F.min("_order").alias("_order"))
    return (found.withColumn("_id", (F.col("_order") % (1 << 32)).cast("int")).drop("_order")
            .join(_values(table), "_id", "left").drop("_id"))


def matching_rules(keys: DataFrame, rules: Rules, selectors: Selectors | None = None) -> DataFrame:
    """One row per key and rule whose selectors it satisfies, with the rule as ``rule``."""
    table = rule_table(keys.sparkSession, rules)
    if not selectors:
        every = table.agg(F.sort_array(F.collect_list(F.struct("*")))).scalar()
        return keys.withColumn("rule", F.explode(every))
    texts, at = _texts(table, selectors), [f"_t{i}" for i in range(len(selectors))]
    found = _probes(keys, rules, texts, selectors).join(texts, at).drop(*at)
    if any(s.listed for s in selectors.values()):  # several texts of one list may fit
        found = found.distinct()
    return found.withColumnRenamed("config_id", "_id").join(_values(table), "_id").drop("_id")


def first_rule(keys: DataFrame, rules: Rules, cond: Column, selectors: Selectors | None = None) -> DataFrame:
    """Distinct keys with the rule of lowest id that they satisfy, as ``rule``; keys without one are dropped.

    ``cond`` may refer to the fields of ``rule``."""
    table = rule_table(keys.sparkSession, rules)
    hits = matching_rules(keys, rules, selectors).where(cond).select(*keys.columns, F.col("rule.config_id").alias("_id"))
    return hits.groupBy(*keys.columns).agg(F.min("_id").alias("_id")).join(_values(table), "_id").drop("_id")


def on_schedule(window: Window) -> Column:
    """Whether the attached rule's schedule covers the run start ``time``."""
    return schedule_ok("time", F.col("rule"), window.zone, window.exact_schedule)


def passes(measure: str) -> Column:
    """Threshold of the attached rule: ``min <= v`` and ``v < max`` if set."""
    v = F.col(measure)
    return (v >= F.col("rule.min")) & ((F.col("rule.max") == 0) | (v < F.col("rule.max")))


def with_values(hits: DataFrame, thres: Column, value: Column, value_type: Column) -> DataFrame:
    """Event values of hits with their rule as ``rule``."""
    return hits.select("*", F.col("rule.config_id").alias("config_id"), F.col("rule.type_id").alias("type_id"),
                       thres.cast("bigint").alias("thres_value"), value.cast("bigint").alias("alarm_value"),
                       value_type.alias("value_type"))


def each_rule(keys: DataFrame, rules: Rules, cond: Column, thres: Column, value: Column, value_type: Column, window: Window,
              selectors: Selectors | None = None) -> DataFrame:
    """One row per key and matching rule on schedule, with its event values attached; conditions and values may refer to
    the fields of ``rule``."""
    hits = matching_rules(keys, rules, selectors).where(cond & on_schedule(window))
    return with_values(hits, thres, value, value_type).drop("rule")
