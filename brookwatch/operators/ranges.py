"""Tables of address ranges, joined by a sweep.

The ends of all ranges cut the line of addresses into disjoint intervals, numbered in order, and each range is replaced by
the numbers of its intervals.  Distinct addresses are sorted in between the ends and take the number of the interval they
fall into: what is left is an equi join on that number.  Rows are never multiplied before they are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import bind, cidr_bounds, ipv4_num, is_v6, shl, shr, v6_groups, v6_halves, v6_text


def networks(df: DataFrame, column: str = "cidr") -> DataFrame:
    """Add ``lo`` and ``hi`` bounds of a CIDR text column."""
    lo, hi = cidr_bounds(column)
    return df.withColumn("lo", lo).withColumn("hi", hi)


# ---- IPv4: sweep and lookup ----------------------------------------------

# Bits of an address inside one bucket; with the end of the last range there are at most 2^16 + 1 buckets.
SPAN = 16


def _cut_points(ranges: DataFrame) -> DataFrame:
    """Where ranges (lo, hi) begin, and where they have ended."""
    return ranges.select(F.explode(F.array("lo", F.col("hi") + 1)).alias("at")).distinct()


def _ranks(values: DataFrame, cuts: DataFrame) -> DataFrame:
    """value, rank: the number of cut points that are not above each of some distinct values.

    Values and cut points are sorted together bucket by bucket, and what lies before a bucket is carried over from a table
    of at most 65,537 rows.
    """
    counts = cuts.groupBy(shr("at", SPAN).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    buckets = cuts.sparkSession.range((1 << (32 - SPAN)) + 1).withColumnRenamed("id", "bucket")
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.join(F.broadcast(counts), "bucket", "left").select(
        "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    marks = values.select(F.col("value").cast("bigint").alias("value"), F.lit(0).alias("cut")).unionByName(
        cuts.select(F.col("at").alias("value"), F.lit(1).alias("cut"))).withColumn("bucket", shr("value", SPAN))
    upto = Window.partitionBy("bucket").orderBy("value", F.desc("cut")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (marks.withColumn("within", F.sum("cut").over(upto)).where("cut = 0").join(F.broadcast(carried), "bucket")
            .select("value", (F.col("before") + F.col("within")).cast("int").alias("rank")))


def _intervals(ranges: DataFrame, cuts: DataFrame) -> DataFrame:
    """The ranges with the ranks of the disjoint intervals that they are cut into: a row for each."""
    at = _ranks(cuts.select(F.col("at").alias("value")), cuts)
    begin = at.select(F.col("value").alias("lo"), F.col("rank").alias("_from"))
    end = at.select((F.col("value") - 1).alias("hi"), F.col("rank").alias("_to"))
    return (ranges.join(begin, "lo").join(end, "hi")
            .withColumn("rank", F.explode(F.sequence("_from", F.col("_to") - 1))).drop("_from", "_to"))


def _located(addresses: DataFrame, address: str, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct addresses (value) with the rank of their interval, and the ranges by rank."""
    ranges = ranges.where("lo <= hi")
    cuts = _cut_points(ranges)
    values = addresses.select(F.col(address).alias("value")).where("value IS NOT NULL").distinct()
    return _ranks(values, cuts), _intervals(ranges, cuts)


def _range_hits(df: DataFrame, address: str, ranges: DataFrame) -> DataFrame:
    """Distinct addresses as ``_address`` with each range that holds them."""
    values, intervals = _located(df, address, ranges)
    return values.join(intervals, "rank").drop("rank").withColumnRenamed("value", "_address")


def range_join(df: DataFrame, address: str, ranges: DataFrame) -> DataFrame:
    """Inner join: one row per range (columns lo, hi, ...) holding the address.

    Distinct addresses are looked up, the rows joined with what was found.
    """
    hits = _range_hits(df, address, ranges)
    return df.join(hits, F.col(address) == F.col("_address")).drop("_address")


def in_ranges(df: DataFrame, address: str, ranges: DataFrame, anti: bool = False) -> DataFrame:
    """Keep (or with ``anti`` drop) rows whose address lies in any range."""
    values, intervals = _located(df, address, ranges)
    inside = values.join(intervals.select("rank"), "rank", "left_semi").select(F.col("value").alias("_address"))
    return df.join(inside, F.col(address) == F.col("_address"), "left_anti" if anti else "left_semi")


# ---- networks of either family -------------------------------------------

def _of_family(nets: DataFrame, column: str, v6: bool) -> DataFrame:
    has_colon = F.instr(F.col(column), ":") > 0
    return nets.where(has_colon if v6 else ~has_colon)


def net_hits(df: DataFrame, address: str, nets: DataFrame, column: str = "cidr") -> DataFrame:
    """Distinct addresses as ``_address`` with each network of a CIDR text column that holds them.

    Numeric addresses are IPv4; texts may be of either family, and meet the networks of their own.
    """
    four = networks(_of_family(nets, column, False), column)
    if not is_v6(df, address):
        return _range_hits(df, address, four).drop("lo", "hi")
    texts = df.select(F.col(address).alias("_address")).where("_address IS NOT NULL").distinct()
    six = prefix_hits6(texts.where(F.instr("_address", ":") > 0), _of_family(nets, column, True), column)
    dotted = texts.where(F.instr("_address", ":") == 0).withColumn("_number", ipv4_num("_address"))
    by_number = _range_hits(dotted, "_number", four).withColumnRenamed("_address", "_number").drop("lo", "hi")
    return six.unionByName(dotted.join(by_number, "_number").drop("_number"))


def cidr_join(df: DataFrame, address: str, nets: DataFrame, column: str = "cidr") -> DataFrame:
    """Inner join of rows with the networks of a CIDR text column."""
    return df.join(net_hits(df, address, nets, column), F.col(address) == F.col("_address")).drop("_address")


def mark_nets(df: DataFrame, address: str, nets: DataFrame, flag: str, column: str = "cidr") -> DataFrame:
    """Add a boolean: whether the address lies in any network of a CIDR text column."""
    hits = net_hits(df, address, nets.select(column), column).select("_address").distinct()
    return (df.join(hits, F.col(address) == F.col("_address"), "left")
            .withColumn(flag, F.col("_address").isNotNull()).drop("_address"))


def in_nets(df: DataFrame, address: str, nets: DataFrame, column: str = "cidr") -> DataFrame:
    """Keep rows whose address lies in any network of a CIDR text column."""
    hits = net_hits(df, address, nets.select(column), column)
    return df.join(hits, F.col(address) == F.col("_address"), "left_semi")


# ---- IPv6 -------------------------------------------------------------

def mask_v6(address: str, bits: int) -> Column:
    """IPv6 text with all but its first ``bits`` bits cleared."""
    def masked(groups):
        parts = []
        for i in range(8):
            keep = min(max(bits - 16 * i, 0), 16)
            parts.append(groups[i].bitwiseAND(F.lit((0xFFFF << (16 - keep)) & 0xFFFF)))
        return v6_text(F.array(*parts))
    return bind(v6_groups(address), masked)


def _masked6(halves: Column, bits: Column) -> Column:
    """High and low half of an address with all but its first bits cleared."""
    ones = F.lit(-1).cast("bigint")
    high = F.when(bits >= 64, ones).when(bits <= 0, 0).otherwise(shl(ones, F.lit(64) - bits))
    low = F.when(bits >= 128, ones).when(bits <= 64, 0).otherwise(shl(ones, F.lit(128) - bits))
    return F.struct(halves["high"].bitwiseAND(high).alias("high"), halves["low"].bitwiseAND(low).alias("low"))


def prefix_hits6(texts: DataFrame, nets: DataFrame, column: str = "cidr") -> DataFrame:
    """Distinct IPv6 texts (_address) with the networks of a prefix text column that hold them.

    The texts are compared at each prefix length that occurs, at most 129, which the plan itself finds out.
    """
    text = F.trim(F.col(column))
    bits = F.when(F.instr(text, "/") > 0, F.substring_index(text, "/", -1)).otherwise("128").cast("int")
    side = nets.withColumn("_bits", bits).withColumn(
        "_net", _masked6(v6_halves(F.substring_index(text, "/", 1)), F.col("_bits")))
    lengths = side.agg(F.collect_set("_bits")).scalar()
    probes = (texts.withColumn("_halves", v6_halves("_address")).withColumn("_bits", F.explode(lengths))
              .withColumn("_net", _masked6(F.col("_halves"), F.col("_bits"))).drop("_halves"))
    return probes.join(side, ["_bits", "_net"]).drop("_bits", "_net")
