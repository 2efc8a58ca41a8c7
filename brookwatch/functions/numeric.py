"""Integer rate formulas and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a, b) -> Column:
    """Integer quotient; 0 where the divisor is 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.coalesce(F.call_function("div", a, F.nullif(b, F.lit(0))), F.lit(0).cast("bigint"))


def duration_ms() -> Column:
    return (F.lit(1000) * (F.col("last") - F.col("first"))
            + F.col("msec_last") - F.col("msec_first")).cast("bigint")


def pps() -> Column:
    return idiv(F.lit(1000) * F.col("pkts"), duration_ms())


def bps() -> Column:
    return idiv(F.lit(8000) * F.col("bytes"), duration_ms())


def bpp() -> Column:
    return idiv(F.col("bytes"), F.col("pkts"))


def scale_number(n: Column) -> Column:
    """One-decimal text with T/G/M from a million up, else the plain number."""
    n = F.col(n) if isinstance(n, str) else n
    f = n.cast("double")
    return (F.when(f >= 1e12, F.format_string("%.1f T", f / 1e12))
            .when(f >= 1e9, F.format_string("%.1f G", f / 1e9))
            .when(f >= 1e6, F.format_string("%.1f M", f / 1e6))
            .otherwise(n.cast("bigint").cast("string")))


def mpls_eos(labels="mpls") -> Column:
    """Label value of the first stack entry whose end-of-stack bit is set."""
    last = F.filter(F.col(labels) if isinstance(labels, str) else labels,
                    lambda x: x.bitwiseAND(F.lit(1)) == 1)
    return F.when(F.size(last) > 0, last[0].bitwiseAND(F.lit(0xFFFFF0)))


def mpls_label(n: int, labels="mpls") -> Column:
    return F.call_function("shiftright", F.get(F.col(labels), F.lit(n - 1)), F.lit(4))


def mpls_exp(n: int, labels="mpls") -> Column:
    return F.call_function("shiftright", F.get(F.col(labels), F.lit(n - 1)), F.lit(1)).bitwiseAND(F.lit(7))


def apply_sampling(flows, samplers):
    """Scale in/out packets and bytes by the exporter's sampling interval."""
    s = samplers.select(F.col("exporter_sysid"), F.col("interval").alias("_interval"))
    factor = F.coalesce(F.col("_interval"), F.lit(1)).cast("bigint")
    scaled = [c for c in ("pkts", "bytes", "out_pkts", "out_bytes") if c in flows.columns]
    return (flows.join(s, "exporter_sysid", "left")
            .withColumns({c: F.col(c) * factor for c in scaled})
            .drop("_interval"))
