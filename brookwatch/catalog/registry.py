"""Registration of queries and shared SQL fragments."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..rules import Window
from ..session import shared_dir, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = Window(fixtures.DAY_START, fixtures.DAY_END)
DAY_SLOTS = Window(fixtures.DAY_START, fixtures.DAY_END, step=300)
START, END = fixtures.DAY_START, fixtures.DAY_END

FLOWS_CTE = f"flows AS MATERIALIZED ({fixtures.FLOWS_SQL})"
WIDE_CTE = (f"raw_flows AS MATERIALIZED ({fixtures.FLOWS_SQL}), "
            f"flows AS MATERIALIZED ({fixtures.WIDE_SQL.replace('FROM flows f', 'FROM raw_flows f')})")


def with_flows(select: str, ctes: str = "", wide: bool = False) -> str:
    """SQL text over the derived flows, with further common tables."""
    head = WIDE_CTE if wide else FLOWS_CTE
    return f"WITH {head}{', ' + ctes if ctes else ''} {select}"


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    if name in QUERIES:
        raise ValueError(name)
    QUERIES[name] = lambda spark, sf: build(tune(spark), sf)
    if sql is not None:
        ORACLES[name] = sql


def on_flows(name: str, build: Callable[[DataFrame], DataFrame], select: str | None, ctes: str = "",
             wide: bool = False) -> None:
    """Register a query that takes the derived flows frame."""
    source = fixtures.wide_flows if wide else fixtures.flows
    register(name, lambda spark, sf: build(source(spark, sf)),
             None if select is None else with_flows(select, ctes, wide))


def value_counts(name: str, cols: dict[str, tuple[Callable[[], Column] | Column, str]], wide: bool = False,
                 where: tuple[Column, str] | None = None) -> None:
    """Register a query counting flows per value of computed columns.

    ``cols`` maps the output name to (column builder, SQL expression).
    """
    def build(flows: DataFrame) -> DataFrame:
        if where is not None:
            flows = flows.where(where[0]())
        out = [c[0]().alias(n) for n, c in cols.items()]
        return flows.select(*out).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))

    exprs = ", ".join(f"{sql} AS {n}" for n, (_, sql) in cols.items())
    cond = f" WHERE {where[1]}" if where is not None else ""
    select = f"SELECT {', '.join(cols)}, count(*) AS n FROM (SELECT {exprs} FROM flows{cond}) v GROUP BY ALL"
    on_flows(name, build, select, wide=wide)


def folder(df_or_spark) -> str:
    """A fresh folder in the shared working area."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    return f"{shared_dir(spark)}/out-{uuid.uuid4().hex}"


# ---- SQL fragments ------------------------------------------------------

def ip_sql(c: str) -> str:
    return f"concat(({c} >> 24) & 255, '.', ({c} >> 16) & 255, '.', ({c} >> 8) & 255, '.', {c} & 255)"


PROTO = "CASE prot WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE concat('PROTO_', prot) END"
COUNTERS = ("min(first) AS first, max(last) AS last, count(*) AS flows, "
            "CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes")
RECOUNT = ("min(first) AS first, max(last) AS last, CAST(sum(flows) AS BIGINT) AS flows, "
           "CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes")
SPAN = "min(first * 1000 + msec_first) AS first_ms, max(last * 1000 + msec_last) AS last_ms"
REQ = "(tos & 1) = 1"
DOMAIN = r"regexp_full_match(qname, '[a-zA-Z0-9][-a-zA-Z0-9]{0,62}(\.[a-zA-Z0-9][-a-zA-Z0-9]{0,62})+\.?')"


def event_sql(obj: str, thres: str, alarm: str, kind: str, model: str, type_id: str = "type_id",
              config_id: str = "config_id", time: str = str(START), devid: str = "devid") -> str:
    return (f"CAST({time} AS BIGINT) AS time, CAST({type_id} AS INTEGER) AS type_id, "
            f"CAST({config_id} AS INTEGER) AS config_id, CAST({devid} AS INTEGER) AS devid, {obj} AS obj, "
            f"CAST({thres} AS BIGINT) AS thres_value, CAST({alarm} AS BIGINT) AS alarm_value, "
            f"{kind} AS value_type, CAST({model} AS INTEGER) AS model_id")
