"""Prefix-preserving address anonymisation.

The published scheme flips each address bit by the first bit of a block-cipher
output over the preceding bits padded with a secret block.  The cipher is
Spark's built-in AES, so the whole mapping stays in the JVM; it is computed once
per distinct address and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import is_v6, v6_groups, v6_text

ADDRESS_COLUMNS = ("srcaddr", "dstaddr", "ip_nexthop", "bgp_nexthop", "ip_router")
AS_COLUMNS = ("srcas", "dstas", "next_as", "prev_as")


def _aes(block: Column, key: Column) -> Column:
    """One AES block (hex in, hex out): the first block of the padded output."""
    out = F.aes_encrypt(F.unhex(block), F.unhex(key), F.lit("ECB"), F.lit("PKCS"))
    return F.substring(F.hex(out), 1, 32)


def _bits(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 2)


def pad_block(spark, key: bytes) -> str:
    """The secret padding: the second key half under the first."""
    k, p = key[:16].hex().upper(), key[16:].hex().upper()
    return spark.range(1).select(_aes(F.lit(p), F.lit(k)).alias("p")).first().p


def _flip(bits: Column, width: int, key_hex: str, pad_bits: str) -> Column:
    """Anonymised bit text of an address bit text."""
    key = F.lit(key_hex)

    def block_hex(text: Column) -> Column:
        # 128 bits as 32 hex digits, sixteen bits at a time
        parts = [F.lpad(F.conv(F.substring(text, 1 + 16 * i, 16), 2, 16), 4, "0") for i in range(8)]
        return F.concat(*parts)

    def bit(i: Column) -> Column:
        text = F.concat(F.substring(bits, F.lit(1), i), F.substring(F.lit(pad_bits), i + 1, F.lit(128)))
        first = F.conv(F.substring(_aes(block_hex(text), key), 1, 1), 16, 10).cast("int") >= 8
        own = F.substring(bits, i + 1, F.lit(1)) == "1"
        return F.when(first != own, "1").otherwise("0")

    return F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bit))


def anonymous_addresses(addresses: DataFrame, name: str, key: bytes) -> DataFrame:
    """(address, anonymised address) of distinct addresses; ``key`` is 32 bytes."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    pad = pad_block(addresses.sparkSession, key)
    pad_bits = bin(int(pad, 16))[2:].zfill(128)
    key_hex = key[:16].hex().upper()
    if is_v6(addresses, name):
        bits = F.concat_ws("", F.transform(v6_groups(name), lambda g: F.lpad(F.bin(g), 16, "0")))
        flipped = addresses.withColumn("_bits", _flip(bits, 128, key_hex, pad_bits))
        groups = F.array(*[F.conv(F.substring("_bits", 1 + 16 * i, 16), 2, 10).cast("bigint") for i in range(8)])
        return flipped.select(name, v6_text(groups).alias("anon"))
    bits = F.lpad(F.bin(F.col(name)), 32, "0")
    return addresses.select(name, F.conv(_flip(bits, 32, key_hex, pad_bits), 2, 10).cast("bigint").alias("anon"))


def anonymize(flows: DataFrame, key: bytes) -> DataFrame:
    """Replace all addresses and zero the AS numbers."""
    columns = [c for c in ADDRESS_COLUMNS if c in flows.columns]
    families = {is_v6(flows, c) for c in columns}
    out = flows
    for v6 in families:
        mine = [c for c in columns if is_v6(flows, c) == v6]
        every = flows.select(F.explode(F.array_distinct(F.array(*mine))).alias("_a")).distinct()
        mapping = anonymous_addresses(every, "_a", key)
        for c in mine:
            out = out.join(mapping.select(F.col("_a").alias("_k"), F.col("anon").alias("_v")),
                           F.col(c) == F.col("_k"), "left").withColumn(c, F.col("_v")).drop("_k", "_v")
    zeros = {c: F.lit(0).cast("bigint") for c in AS_COLUMNS if c in out.columns}
    return (out.withColumns(zeros) if zeros else out).select(*flows.columns)


