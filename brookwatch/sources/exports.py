"""Feature and evidence rows as JSON documents and CSV exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.address import ipv4_str
from ..functions.text import clean_text, printable


def _present(df: DataFrame, name: str) -> Column:
    """Field value, null (so omitted) where it is empty text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.nullif(clean_text(name), F.lit("")).alias(name)
    return F.col(name).alias(name)


def features_to_json(df: DataFrame) -> DataFrame:
    """One ``json`` document per feature row; absent fields are omitted."""
    cols = []
    for name in df.columns:
        if name in ("srcaddr", "dstaddr", "addr", "sip", "dip") and isinstance(df.schema[name].dataType, T.LongType):
            cols.append(ipv4_str(name).alias({"srcaddr": "sip", "dstaddr": "dip", "addr": "ip"}.get(name, name)))
        else:
            cols.append(_present(df, name))
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def evidence_to_json(packets: DataFrame) -> DataFrame:
    """One ``json`` document per packet: addresses as text, the payload both
    printable and as hex."""
    cols = []
    for name in packets.columns:
        if name in ("sip", "dip") and isinstance(packets.schema[name].dataType, T.LongType):
            cols.append(ipv4_str(name).alias(name))
        elif name == "payload":
            cols += [printable("payload").alias("payload"), F.hex(F.encode("payload", "UTF-8")).alias("payload_hex")]
        else:
            cols.append(F.col(name))
    return packets.select(F.to_json(F.struct(*cols)).alias("json"))


def asset_rows(features: DataFrame, start: int, end: int) -> DataFrame:
    """Hourly asset features of ``start <= hour < end``."""
    return features.where((F.col("hour") >= start - start % 3600) & (F.col("hour") < end))


def export_assets(features: DataFrame, path: str, start: int, end: int, mode: str = "error") -> None:
    asset_rows(features, start, end).write.mode(mode).csv(path, header=True)
