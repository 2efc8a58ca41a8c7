"""Address and name lists, intel files and feature patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.address import ipv4_num, is_ipv4_cidr_text, is_ipv4_text, is_ipv6_text

PATTERN_SCHEMA = ("type string, sip string, sport string, dip string, dport string, protocol string, "
                  "peers string, flows string, x1 string, x2 string, x3 string")


def parse_list(lines: DataFrame) -> DataFrame:
    """(key, class) rows of list lines: ``#`` comments and blanks skipped."""
    text = F.trim("value")
    kept = lines.select(text.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return kept.select(F.trim(F.substring_index("value", ",", 1)).alias("key"),
                       F.when(F.instr("value", ",") > 0,
                              F.trim(F.expr("substring(value, instr(value, ',') + 1)"))).otherwise("").alias("class"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_list(spark.read.text(path))


def parse_networks(lines: DataFrame) -> DataFrame:
    """(cidr, class, family, ip, reason) of the lines of an address list.

    ``family`` is 4 or 6; ``ip`` is the number of a single IPv4 address.  A line that is neither address nor network has
    a ``reason`` and no family.
    """
    key = F.col("key")
    base, bits = F.substring_index(key, "/", 1), F.substring_index(key, "/", -1).try_cast("int")
    bare = F.instr(key, "/") == 0
    six = is_ipv6_text(base) & (bare | (key.rlike(r"/\d{1,3}$") & bits.between(0, 128)))
    family = F.when(F.when(bare, is_ipv4_text(key)).otherwise(is_ipv4_cidr_text(key)), 4).when(six, 6)
    reason = F.when(bare, "no address").when(~(is_ipv4_text(base) | is_ipv6_text(base)), "no network address").otherwise(
        "no prefix length")
    return parse_list(lines).select(key.alias("cidr"), "class", family.cast("int").alias("family"),
                                    F.when(bare & is_ipv4_text(key), ipv4_num(key)).alias("ip"),
                                    F.when(family.isNull(), reason).alias("reason"))


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """(cidr, class) of all addresses and networks of a list file, of either family."""
    return parse_networks(spark.read.text(path)).where("reason IS NULL").select("cidr", "class")


def refused_networks(spark: SparkSession, path: str) -> DataFrame:
    """(cidr, reason) of the lines that are neither."""
    return parse_networks(spark.read.text(path)).where("reason IS NOT NULL").select("cidr", "reason")


def read_ip_list(spark: SparkSession, path: str) -> DataFrame:
    """(ip, class) of the single IPv4 addresses of a list file, as numbers; ``read_networks`` gives all of it."""
    return parse_networks(spark.read.text(path)).where("ip IS NOT NULL").select("ip", "class")


def read_intel(spark: SparkSession, path: str, columns=("key", "source", "coin")) -> DataFrame:
    """Comma-separated intel rows (backslash escapes), keyed by column 0."""
    schema = ", ".join(f"{c} string" for c in columns)
    rows = spark.read.csv(path, schema=schema, escape="\\", comment="#", ignoreLeadingWhiteSpace=True,
                          ignoreTrailingWhiteSpace=True)
    key, rest = columns[0], list(columns[1:])
    one = rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max(F.struct(*rest)).alias("_r"))
    return one.select(key, *[F.coalesce(F.col(f"_r.{c}"), F.lit("")).alias(c) for c in rest])


def parse_patterns(rows: DataFrame, kind: str | None = None) -> DataFrame:
    out = rows.where(F.col("type").isNotNull())
    if kind:
        out = out.where(F.col("type") == kind)
    text = [F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("type", "sip", "sport", "dip", "dport", "protocol")]
    return out.select(*text, F.expr("try_cast(trim(peers) AS int)").alias("peers"),
                      F.expr("try_cast(trim(flows) AS int)").alias("flows"))


def read_patterns(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Feature thresholds, one row per pattern; optionally of one type."""
    return parse_patterns(spark.read.csv(path, schema=PATTERN_SCHEMA, comment="#",
                                         ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True), kind)
