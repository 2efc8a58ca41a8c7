"""Pipe-separated and CSV flow texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from ..functions.address import addr_text, bind, ipv4_num, ipv4_str, is_ipv4_text, is_v6, v6_groups, v6_text
from ..functions.names import flags_str, proto_name
from ..functions.numeric import duration_ms, idiv
from ..functions.render import clock, mac_text, mpls_text

# Order of the pipe fields.  Addresses are four 32-bit words.
PIPE_FIELDS = (
    "af first msec_first last msec_last prot sa0 sa1 sa2 sa3 srcport da0 da1 da2 da3 dstport "
    "srcas dstas input output tcp_flags tos pkts bytes aggr_flows "
    "popular_service service scanner whitelist blacklist qtype qclass qname pname "
    "http_url http_host http_method http_mime http_user_agent http_cookie http_ret_code "
    "service_type service_name service_version icmp_data icmp_seq_num icmp_payload_len "
    "dev_type dev_name dev_vendor dev_model os_type os_name os_version "
    "midware_type midware_name midware_version threat_type threat_name threat_version "
    "service_time dev_time os_time midware_time threat_time").split()

_TEXT_FIELDS = {f for f in PIPE_FIELDS if f.endswith(("_type", "_name", "_version", "_vendor", "_model"))} | {
    "qname", "pname", "http_url", "http_host", "http_method", "http_mime", "http_user_agent", "http_cookie",
    "icmp_data"}
_LONG_FIELDS = {"first", "last", "pkts", "bytes", "aggr_flows", "srcas", "dstas", "input", "output",
                "icmp_payload_len"} | {f for f in PIPE_FIELDS if f.endswith("_time")}
AF_INET, AF_INET6 = 2, 10

# A flow takes several times as many bytes as text as it does in a table, so texts are written compressed.  One task reads such a
# file whole: no file gets more lines than this.
FILE_LINES = 500_000


def _words(df: DataFrame, name: str) -> Column:
    """The four 32-bit words of an address; IPv4 lies in the last one."""
    zero = F.lit(0).cast("bigint")
    if not is_v6(df, name):
        return F.array(zero, zero, zero, F.col(name).cast("bigint"))
    six = bind(v6_groups(name), lambda g: F.array(*[g[2 * i] * 65536 + g[2 * i + 1] for i in range(4)]))
    return F.when(F.instr(F.col(name), ":") > 0, six).otherwise(F.array(zero, zero, zero, ipv4_num(name)))


def _no_separator(c: Column) -> Column:
    """Field text without the separator and line breaks."""
    return F.translate(F.coalesce(c, F.lit("")), "|\n\r", "   ")


def pipe_lines(df: DataFrame) -> DataFrame:
    """One ``value`` line of 65 fields per flow; absent columns are 0 or empty."""
    df = df.withColumns({"_sa": _words(df, "srcaddr"), "_da": _words(df, "dstaddr")})
    special = {f"{c}{i}": F.col(f"_{c}")[i] for c in ("sa", "da") for i in range(4)}
    special["af"] = (F.when(F.instr(F.col("srcaddr"), ":") > 0, AF_INET6).otherwise(AF_INET) if is_v6(df, "srcaddr")
                     else F.lit(AF_INET))
    cols = []
    for f in PIPE_FIELDS:
        if f in special:
            cols.append(special[f].cast("string"))
        elif f in _TEXT_FIELDS:
            cols.append(_no_separator(F.col(f)) if f in df.columns else F.lit(""))
        elif f == "aggr_flows" and f not in df.columns:
            cols.append(F.lit("1"))
        else:
            cols.append(F.coalesce(F.col(f), F.lit(0)).cast("string") if f in df.columns else F.lit("0"))
    return df.select(F.concat_ws("|", *cols).alias("value"))


def _text_writer(df: DataFrame, mode: str, compression: str) -> DataFrameWriter:
    return df.write.mode(mode).options(compression=compression, maxRecordsPerFile=FILE_LINES)


def write_lines(lines: DataFrame, path: str, mode: str = "error", compression: str = "gzip") -> None:
    """Lines (column ``value``) as text files, ``compression="none"`` for plain ones."""
    _text_writer(lines, mode, compression).text(path)


def write_pipe(df: DataFrame, path: str, mode: str = "error", compression: str = "gzip") -> None:
    write_lines(pipe_lines(df), path, mode, compression)


def _kind(field: str) -> str:
    return "string" if field in _TEXT_FIELDS else "bigint" if field in _LONG_FIELDS or field[:2] in ("sa", "da") else "int"


def _fields(lines: DataFrame) -> DataFrame:
    """The lines with their fields as ``_p``, split once: a generated row is not split again by what refers to it."""
    return lines.withColumn("_p", F.explode(F.array(F.split("value", r"\|"))))


def _refusal(p: Column) -> Column:
    """Why the fields of a line are no flow; null if they are one."""
    wrong = [F.when(F.get(p, F.lit(i)).try_cast(_kind(f)).isNull(), F.lit(f"{f} is no number"))
             for i, f in enumerate(PIPE_FIELDS) if _kind(f) != "string"]
    return F.when(F.size(p) != len(PIPE_FIELDS), F.concat(F.size(p).cast("string"), F.lit(" fields"))).otherwise(F.coalesce(*wrong))


def refused_lines(lines: DataFrame) -> DataFrame:
    """The pipe lines (column ``value``) that ``parse_pipe`` leaves out, with the reason."""
    return _fields(lines).select("value", _refusal(F.col("_p")).alias("reason")).where("reason IS NOT NULL")


def parse_pipe(lines: DataFrame, text_addresses: bool = False) -> DataFrame:
    """Flows of pipe lines (column ``value``); the others are given by ``refused_lines``.

    ``sip`` and ``dip`` are texts of either family.  ``srcaddr`` and ``dstaddr`` are numbers, null for IPv6, or with
    ``text_addresses`` the same texts, as a table of both families has them.
    """
    p = F.col("_p")
    parts = _fields(lines).where(_refusal(p).isNull())
    raw = {}
    for i, f in enumerate(PIPE_FIELDS):
        raw[f] = p[i].cast(_kind(f))

    def address(side):
        words = [p[PIPE_FIELDS.index(f"{side}{i}")].cast("bigint") for i in range(4)]
        halves = [h for w in words for h in (F.call_function("shiftright", w, F.lit(16)),
                                             w.bitwiseAND(F.lit(0xFFFF)))]
        return words[3], v6_text(F.array(*halves))

    (s4, s6), (d4, d6) = address("sa"), address("da")
    v6 = raw["af"] == AF_INET6
    sip, dip = F.when(v6, s6).otherwise(ipv4_str(s4)), F.when(v6, d6).otherwise(ipv4_str(d4))
    ends = (sip, dip) if text_addresses else (F.when(~v6, s4), F.when(~v6, d4))
    out = [raw["af"].alias("af"), ends[0].alias("srcaddr"), ends[1].alias("dstaddr"), sip.alias("sip"), dip.alias("dip")]
    out += [c.alias(f) for f, c in raw.items() if f not in ("af",) and f[:2] not in ("sa", "da")]
    return parts.select(*out)


def read_pipe_flows(spark: SparkSession, path: str, text_addresses: bool = False) -> DataFrame:
    return parse_pipe(spark.read.text(path), text_addresses)


# Short CSV column names.
CSV_COLUMNS = ("ts te td sa da sp dp pr flg fwd stos ipkt ibyt opkt obyt in out sas das smk dmk dtos dir nh nhb "
               "svln dvln ismc odmc idmc osmc mpls1 mpls2 mpls3 mpls4 mpls5 mpls6 mpls7 mpls8 mpls9 mpls10 "
               "cl sl al ra eng exid").split()


def csv_frame(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Flows under the short CSV column names, all as text."""
    def number(name):
        return F.coalesce(F.col(name), F.lit(0)).cast("string") if name in df.columns else F.lit("0")

    def mac(name):
        return mac_text(name) if name in df.columns else F.lit("00:00:00:00:00:00")

    def addr(name):
        return addr_text(df, name, False) if name in df.columns else F.lit("0.0.0.0")

    def latency(name):
        return (F.format_string("%.3f", F.col(name) / 1000) if name in df.columns else F.lit("0.000"))

    td = F.concat(idiv(duration_ms(), F.lit(1000)).cast("string"), F.lit("."),
                  F.lpad((duration_ms() % 1000).cast("string"), 3, "0"))
    cols = {
        "ts": clock(F.col("first"), F.col("msec_first"), zone), "te": clock(F.col("last"), F.col("msec_last"), zone),
        "td": td, "sa": addr_text(df, "srcaddr", False), "da": addr_text(df, "dstaddr", False),
        "sp": number("srcport"), "dp": number("dstport"), "pr": proto_name(), "flg": flags_str(),
        "fwd": number("fwd_status"), "stos": number("tos"), "ipkt": number("pkts"), "ibyt": number("bytes"),
        "opkt": number("out_pkts"), "obyt": number("out_bytes"), "in": number("input"), "out": number("output"),
        "sas": number("srcas"), "das": number("dstas"), "smk": number("src_mask"), "dmk": number("dst_mask"),
        "dtos": number("dst_tos"), "dir": number("dir"), "nh": addr("ip_nexthop"), "nhb": addr("bgp_nexthop"),
        "svln": number("src_vlan"), "dvln": number("dst_vlan"), "ismc": mac("in_src_mac"),
        "odmc": mac("out_dst_mac"), "idmc": mac("in_dst_mac"), "osmc": mac("out_src_mac"),
        "cl": latency("client_latency"), "sl": latency("server_latency"), "al": latency("app_latency"),
        "ra": addr("ip_router"), "eng": F.concat_ws("/", number("engine_type"), number("engine_id")),
        "exid": number("exporter_sysid"),
    }
    for i in range(1, 11):
        cols[f"mpls{i}"] = mpls_text(i) if "mpls" in df.columns else F.lit("0-0-0")
    return df.select(*[cols[c].alias(c) for c in CSV_COLUMNS])


def to_csv(df: DataFrame, path: str, zone: str = "UTC", mode: str = "error", compression: str = "gzip") -> None:
    """CSV files with a header each, ``compression="none"`` for plain ones."""
    _text_writer(csv_frame(df, zone), mode, compression).csv(path, header=True)


def read_flow_csv(spark: SparkSession, path: str, zone: str = "UTC", text_addresses: bool = False) -> DataFrame:
    """CSV rows back as a flow frame; the header names the fields."""
    header = spark.read.csv(path, header=True).columns
    df = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in header))
    return parse_csv_frame(df, zone, text_addresses)


def parse_csv_frame(df: DataFrame, zone: str = "UTC", text_addresses: bool = False) -> DataFrame:
    """Typed flow columns of text columns named as in the CSV header.

    Addresses are numbers, null where they are not IPv4, or with ``text_addresses`` texts of either family.
    """
    from ..functions.names import PROTOCOLS
    names = F.split(F.lit(" ".join(PROTOCOLS)), " ")

    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def ms(name):
        local = F.col(name).cast("timestamp_ntz")
        utc = local if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
        return F.timestamp_diff("MILLISECOND", epoch, utc)

    direct = {"sp": ("srcport", "int"), "dp": ("dstport", "int"), "fwd": ("fwd_status", "int"),
              "stos": ("tos", "int"), "ipkt": ("pkts", "bigint"), "ibyt": ("bytes", "bigint"),
              "opkt": ("out_pkts", "bigint"), "obyt": ("out_bytes", "bigint"), "in": ("input", "bigint"),
              "out": ("output", "bigint"), "sas": ("srcas", "bigint"), "das": ("dstas", "bigint"),
              "smk": ("src_mask", "int"), "dmk": ("dst_mask", "int"), "dtos": ("dst_tos", "int"),
              "dir": ("dir", "int"), "svln": ("src_vlan", "int"), "dvln": ("dst_vlan", "int"),
              "exid": ("exporter_sysid", "int")}
    out = []
    for name, short in (("first", "ts"), ("last", "te")):
        if short in df.columns:
            out += [idiv(ms(short), F.lit(1000)).alias(name), (ms(short) % 1000).cast("int").alias(f"msec_{name}")]
    for short, name in (("sa", "srcaddr"), ("da", "dstaddr"), ("nh", "ip_nexthop"), ("nhb", "bgp_nexthop"),
                        ("ra", "ip_router")):
        if short in df.columns:
            number = F.when(is_ipv4_text(F.trim(short)), ipv4_num(short))
            out.append((F.trim(short) if text_addresses else number).alias(name))
    if "pr" in df.columns:
        at = F.array_position(names, F.col("pr")).cast("int")
        out.append(F.when(at > 0, at - 1).otherwise(
            F.regexp_extract("pr", r"(\d+)$", 1).try_cast("int")).alias("prot"))
    if "flg" in df.columns:
        bits = [F.when(F.instr("flg", m) > 0, b).otherwise(0)
                for m, b in (("U", 32), ("A", 16), ("P", 8), ("R", 4), ("S", 2), ("F", 1))]
        hexed = F.conv(F.substring_index("flg", "x", -1), 16, 10).cast("int")
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        out.append(F.when(F.col("flg").startswith("0x"), hexed).otherwise(total).alias("tcp_flags"))
    out += [F.col(s).cast(t).alias(n) for s, (n, t) in direct.items() if s in df.columns]
    for short, name in (("ismc", "in_src_mac"), ("odmc", "out_dst_mac"), ("idmc", "in_dst_mac"),
                        ("osmc", "out_src_mac")):
        if short in df.columns:
            out.append(F.conv(F.translate(F.col(short), ":", ""), 16, 10).cast("bigint").alias(name))
    return df.select(*out)
