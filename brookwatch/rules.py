"""Configuration objects: detection rules, feature patterns, monitored objects."""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import URL_ATTACKS
from .session import held_rows

ALL_WEEK = (0, 1, 2, 3, 4, 5, 6)


@dataclass(frozen=True)
class Rule:
    """One detection rule.  Empty selectors match anything."""

    config_id: int
    type_id: int = 0
    min: int = 0
    max: int = 0
    ip: str = ""
    sip: str = ""
    dip: str = ""
    port: str = ""
    protocol: str = ""
    data_type: str = ""
    qcount: int = 0
    qname: str = ""
    detvalue: int = 0
    fqcount: int = 0
    if1: int = 0
    if2: int = 0
    if3: int = 0
    pat: str = ""
    sub_type: int = 0
    moid: int = 0
    weekday: tuple[int, ...] = ALL_WEEK
    stime: tuple[int, int, int] = (0, 0, 0)
    etime: tuple[int, int, int] = (23, 59, 59)
    coverrange: str = "WITHIN"

    @property
    def attack(self) -> str:
        return URL_ATTACKS.get(self.sub_type, "")


@dataclass(frozen=True)
class Pattern:
    """Feature threshold of one traffic pattern."""

    type: str
    sip: str = ""
    sport: str = ""
    dip: str = ""
    dport: str = ""
    protocol: str = ""
    peers: int | None = None
    flows: int | None = None


@dataclass(frozen=True)
class MonitoredObject:
    """Address, port and peer selectors of a watched object; ``!`` negates."""

    id: int
    moip: str = ""
    moport: str = ""
    protocol: str = ""
    pip: str = ""
    pport: str = ""
    direction: str = "ALL"
    groupid: int = 0
    devid: int = 1
    label: str = field(default="", compare=False)


def split_list(text: str) -> list[str]:
    return [t.strip() for t in (text or "").split(",") if t.strip()]


_SQL_TYPES = {"int": "bigint", "str": "string", "tuple[int, ...]": "array<int>", "tuple[int, int, int]": "array<int>"}
_SMALL = {"config_id", "type_id", "detvalue", "sub_type", "moid"}
RULE_TYPES = {f.name: "int" if f.name in _SMALL else _SQL_TYPES[f.type] for f in fields(Rule)}


def rule_table(spark: SparkSession, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """Rules as a table with all fields; a given table may lack fields or leave them null, and be of any size."""
    if not isinstance(rules, DataFrame):
        rows = [tuple(getattr(r, c) for c in RULE_TYPES) for r in rules]
        rows = [tuple(list(v) if isinstance(v, tuple) else v for v in row) for row in rows]
        return held_rows(spark, rows, ", ".join(f"{c} {t}" for c, t in RULE_TYPES.items()))
    defaults = {f.name: f.default for f in fields(Rule)}
    return rules.select(*[_field(rules, c, t, defaults[c]) for c, t in RULE_TYPES.items()])


def _field(rules: DataFrame, name: str, kind: str, default) -> Column:
    if default is MISSING:
        return F.col(name).cast(kind).alias(name)
    value = (F.array(*map(F.lit, default)) if isinstance(default, tuple) else F.lit(default)).cast(kind)
    return (F.coalesce(F.col(name).cast(kind), value) if name in rules.columns else value).alias(name)


def read_rules(df: DataFrame) -> DataFrame:
    """Rules of a configuration table, of any size."""
    return rule_table(df.sparkSession, df)


def _load(cls, df: DataFrame) -> list:
    """Objects of a table that is configuration, which the driver holds as it holds a list given to it."""
    names = {f.name for f in fields(cls)}
    return [cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.asDict().items() if k in names and v is not None})
            for row in df.collect()]


def read_objects(df: DataFrame) -> list[MonitoredObject]:
    return sorted(_load(MonitoredObject, df), key=lambda m: m.id)


def read_pattern_rows(df: DataFrame) -> list[Pattern]:
    return _load(Pattern, df)


@dataclass(frozen=True)
class Window:
    """Run window ``[start, end)``; with ``step`` every step is its own run."""

    start: int
    end: int
    step: int | None = None
    zone: str = "UTC"
    exact_schedule: bool = False

    @property
    def interval(self) -> int:
        return self.step or self.end - self.start

    def time(self) -> Column:
        """Start of the run a flow belongs to."""
        if self.step is None:
            return F.lit(self.start).cast("bigint")
        first = F.col("first")
        return (first - (first - F.lit(self.start)) % self.step).cast("bigint")

    def clip(self, flows: DataFrame) -> DataFrame:
        """Flows that start inside the window, with their run start as ``time``.

        On a stored flow table the days and slots are bounded too, so that other days' files are not opened.
        """
        inside = (F.col("first") >= self.start) & (F.col("first") < self.end)
        if "slot" in flows.columns:
            inside = inside & F.col("slot").between(self.start - self.start % 300, self.end - 1)
        if "dt" in flows.columns:
            days = [datetime.datetime.fromtimestamp(t, datetime.timezone.utc).date() for t in (self.start, self.end - 1)]
            inside = inside & F.col("dt").between(*map(F.lit, days))
        return flows.where(inside).withColumn("time", self.time())
