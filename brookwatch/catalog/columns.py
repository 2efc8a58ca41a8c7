"""Computed columns (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..functions import address, names, numeric, text, timefn
from ..functions.render import format_flows
from ..operators.joins import tag_flows
from .registry import PROTO, ip_sql, on_flows, register, value_counts

DURATION = "(1000 * (last - first) + msec_last - msec_first)"

value_counts("p1_duration_ms", {"duration_ms": (numeric.duration_ms, f"CAST({DURATION} AS BIGINT)")})
value_counts("p2_pps", {"pps": (numeric.pps, f"coalesce(1000 * pkts // nullif({DURATION}, 0), 0)")})
value_counts("p3_bps", {"bps": (numeric.bps, f"coalesce(8000 * bytes // nullif({DURATION}, 0), 0)")})
value_counts("p4_bpp", {"bpp": (numeric.bpp, "coalesce(bytes // nullif(pkts, 0), 0)")})
value_counts("p5_icmp", {"icmp_type": (names.icmp_type, "dstport >> 8"),
                         "icmp_code": (names.icmp_code, "dstport & 255")},
             where=(lambda: F.col("prot") == 1, "prot = 1"))

_FLAGS = " || ".join(f"CASE WHEN (tcp_flags & {b}) <> 0 THEN '{m}' ELSE '.' END"
                     for m, b in (("U", 32), ("A", 16), ("P", 8), ("R", 4), ("S", 2), ("F", 1)))
value_counts("p6_flags_str", {
    "flags": (names.flags_str, _FLAGS),
    "high": (lambda: names.flags_str(F.col("tcp_flags") + 64), "concat('0x', lower(to_hex(tcp_flags + 64)))")})
value_counts("p7_ipv4", {"text": (lambda: address.ipv4_str("srcaddr"), ip_sql("srcaddr")),
                         "number": (lambda: address.ipv4_num(address.ipv4_str("srcaddr")), "srcaddr")})


def _v6_raw():
    hi, lo = address.shr("dstaddr", 16), F.col("dstaddr").bitwiseAND(F.lit(65535))
    return F.concat(F.lit("2001:0DB8:0000:0:0:0:"), F.lpad(F.hex(hi), 4, "0"), F.lit(":"), F.hex(lo))


_V6_SQL = "concat('2001:db8::', lower(to_hex(dstaddr >> 16)), ':', lower(to_hex(dstaddr & 65535)))"


def _v6_counts(convert):
    """Texts of the distinct addresses, with their flow counts."""
    def build(f):
        per = f.groupBy("dstaddr").agg(F.count(F.lit(1)).alias("n"))
        return per.select(convert().alias("text"), "n").groupBy("text").agg(F.sum("n").alias("n"))
    return build


def _v6_select(expr: str) -> str:
    return f"SELECT {expr} AS text, count(*) AS n FROM flows GROUP BY ALL"


on_flows("p8_ipv6_norm", _v6_counts(lambda: address.ipv6_norm(_v6_raw())), _v6_select(_V6_SQL))
value_counts("p9_is_private", {
    "src_private": (lambda: address.is_private("srcaddr"),
                    "(srcaddr BETWEEN 167772160 AND 184549375 OR srcaddr BETWEEN 2886729728 AND 2887778303 "
                    "OR srcaddr BETWEEN 3232235520 AND 3232301055)"),
    "hop_private": (lambda: address.is_private(F.col("ip_nexthop") + 1048576),
                    "(ip_nexthop + 1048576 BETWEEN 2886729728 AND 2887778303)")}, wide=True)
value_counts("p10_proto_name", {
    "name": (names.proto_name, PROTO),
    "other": (lambda: names.proto_name(F.col("prot") + 130),
              "CASE prot WHEN 1 THEN 'PIPE' ELSE concat('PROTO_', prot + 130) END")})
value_counts("p11_qtype_name", {
    "name": (names.qtype_name, "CASE qtype WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' WHEN 16 THEN 'TXT' WHEN 15 THEN 'MX' "
                               "ELSE concat('QTYPE_', qtype) END")})
value_counts("p12_networks", {
    "src_net": (address.src_net, "(srcaddr >> (32 - src_mask)) << (32 - src_mask)"),
    "dst_net": (address.dst_net, "(dstaddr >> (32 - dst_mask)) << (32 - dst_mask)")}, wide=True)
value_counts("p13_scale_number", {
    "scaled": (lambda: numeric.scale_number(F.col("bytes") * 1000 + 1),
               "CASE WHEN bytes * 1000 + 1 >= 1000000 THEN printf('%.1f M', (bytes * 1000 + 1) / 1000000.0) "
               "ELSE CAST(bytes * 1000 + 1 AS VARCHAR) END"),
    "large": (lambda: numeric.scale_number(F.col("bytes") * 100000001 + 1),
              "CASE WHEN bytes * 100000001 + 1 >= 1000000000000 "
              "THEN printf('%.1f T', CAST(bytes * 100000001 + 1 AS DOUBLE) / 1000000000000.0) "
              "ELSE printf('%.1f G', CAST(bytes * 100000001 + 1 AS DOUBLE) / 1000000000.0) END")})
on_flows("p14_condense_v6", _v6_counts(lambda: address.condense_v6(address.ipv6_norm(_v6_raw()))),
         _v6_select(f"CASE WHEN length({_V6_SQL}) > 16 THEN concat(substr({_V6_SQL}, 1, 7), '..', right({_V6_SQL}, 7)) "
                    f"ELSE {_V6_SQL} END"))

_CLOCK = ("concat(strftime(make_timestamp({s} * 1000000), '%Y-%m-%d %H:%M:%S'), '.', "
          "lpad(CAST({m} AS VARCHAR), 3, '0'))")
_TS = _CLOCK.format(s="first", m="msec_first")
_TD = f"concat({DURATION} // 1000, '.', lpad(CAST({DURATION} % 1000 AS VARCHAR), 3, '0'))"
_DP = "CASE WHEN prot = 1 THEN concat(dstport >> 8, '.', dstport & 255) ELSE CAST(dstport AS VARCHAR) END"
_ENDS = f"{ip_sql('srcaddr')}, ':', srcport, ' -> ', {ip_sql('dstaddr')}, ':', {_DP}"
_LINE = f"concat({_TS}, ' ', {_TD}, ' ', {PROTO}, ' ', {_ENDS}, ' ', pkts, ' ', bytes, ' ', aggr_flows)"
_EXT = (f"concat({_TS}, ' ', {_TD}, ' ', {PROTO}, ' ', {_ENDS}, ' ', {_FLAGS}, ' ', tos, ' ', pkts, ' ', bytes, ' ', "
        f"coalesce(1000 * pkts // nullif({DURATION}, 0), 0), ' ', "
        f"CASE WHEN coalesce(8000 * bytes // nullif({DURATION}, 0), 0) < 1000000 "
        f"THEN CAST(coalesce(8000 * bytes // nullif({DURATION}, 0), 0) AS VARCHAR) ELSE 'scaled' END, ' ', "
        f"coalesce(bytes // nullif(pkts, 0), 0), ' ', aggr_flows)")


def _lines(flows):
    return flows.select(format_flows(flows, "line").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


on_flows("p15_format_line", _lines, f"SELECT line, count(*) AS n FROM (SELECT {_LINE} AS line FROM flows) t GROUP BY ALL",
         wide=True)
on_flows("p15_format_extended",
         lambda f: f.select(format_flows(f, "extended").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n")),
         f"SELECT line, count(*) AS n FROM (SELECT {_EXT} AS line FROM flows) t GROUP BY ALL", wide=True)
on_flows("p15_format_custom",
         lambda f: (f.select(format_flows(f, "fmt:%te|%sn|%nh|%opkt/%obyt|%ismc|%mpls2|%eng|%cl").alias("line"))
                    .groupBy("line").agg(F.count(F.lit(1)).alias("n"))),
         "SELECT line, count(*) AS n FROM (SELECT concat(" + _CLOCK.format(s="last", m="msec_last") + ", '|', "
         + ip_sql("((srcaddr >> (32 - src_mask)) << (32 - src_mask))") + ", '/', src_mask, '|', " + ip_sql("ip_nexthop")
         + ", '|', out_pkts, '/', out_bytes, '|', regexp_replace(lpad(lower(to_hex(in_src_mac)), 12, '0'), "
           "'(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6'), '|', mpls2 >> 4, '-', (mpls2 >> 1) & 7, '-', "
           "mpls2 & 1, '|', engine_type, '/', engine_id, '|', printf('%.3f', client_latency / 1000.0)) AS line "
           "FROM flows) t GROUP BY ALL", wide=True)
value_counts("p16_slot_key", {
    "key": (lambda: timefn.slot_key(timefn.slot()),
            "strftime(make_timestamp((first - first % 300) * 1000000), '%Y%m%d%H%M')"),
    "epoch": (lambda: timefn.slot_epoch(timefn.slot_key(timefn.slot())), "first - first % 300"),
    "east": (lambda: timefn.slot_key(timefn.slot(), "Asia/Shanghai"),
             "strftime(make_timestamp((first - first % 300 + 28800) * 1000000), '%Y%m%d%H%M')")})


def _docs(name, expr, sql):
    register(name, lambda spark, sf: table(spark, sf, "documents").select("doc_id", expr().alias("out")),
             f"SELECT doc_id, {sql} AS out FROM documents")


_docs("p17_escape_text", lambda: F.md5(text.escape_text("text")),
      r"""md5(replace(replace(replace(replace(replace(replace(replace(regexp_replace(text,
         '[\x01-\x07\x0e-\x1f"]', '', 'g'), chr(92), chr(92) || chr(92)),
         chr(10), chr(92) || chr(92) || 'n'), chr(13), chr(92) || chr(92) || 'r'), chr(8), chr(92) || chr(92) || 'b'),
         chr(11), chr(92) || chr(92) || 'v'), chr(9), chr(92) || chr(92) || 't'),
         chr(12), chr(92) || chr(92) || 'f'))""")
_docs("p18_percent_encode", lambda: F.md5(text.percent_encode("text")),
      "md5(replace(replace(replace(replace(replace(url_encode(text), '%2F', '/'), '%2B', '+'), '%40', '@'), "
      "'%2A', '*'), '~', '%7E'))")
_docs("p19_printable", lambda: F.md5(text.printable("text")),
      r"""md5(replace(replace(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'),
          lambda h: CASE WHEN h >= '20' AND h <= '7E' THEN decode(unhex(h)) ELSE '.' END), ''),
          chr(92), chr(92) || chr(92)), '"', chr(92) || '"'))""")
_docs("p20_hex", lambda: F.md5(text.hex_text("text")), "md5(hex(encode(text)))")
_docs("p21_clean_text", lambda: F.md5(text.clean_text("text")),
      r"md5(CASE WHEN regexp_matches(text, '[^\x00-\x7f\x{4e00}-\x{9fff}]') THEN 'abnormal character' ELSE text END)")
value_counts("p22_app_context", {"context": (text.app_context, """CASE
    WHEN http_url <> '' THEN concat(http_url, ',', http_host, ',', http_method, ',', http_mime, ',', http_user_agent,
      ',', http_cookie, ',', http_ret_code)
    WHEN qname <> '' THEN concat(qname, ',', CASE qtype WHEN 1 THEN 'A' WHEN 28 THEN 'AAAA' WHEN 16 THEN 'TXT'
      WHEN 15 THEN 'MX' END) ELSE '' END""")}, wide=True)
value_counts("p23_app_proto", {"app": (text.app_proto, "CASE WHEN pname <> '' THEN pname ELSE service_name END")},
             wide=True)
value_counts("p24_domain_split", {
    "sub": (text.sub_label, "CASE WHEN contains(qname, '.') THEN split_part(qname, '.', 1) ELSE '' END"),
    "base": (text.base_domain, "CASE WHEN contains(qname, '.') THEN "
                               "regexp_extract(qname, '([^.]*\\.[^.]*)$', 1) ELSE '' END"),
    "dotted": (lambda: text.base_domain(F.concat("qname", F.lit("."))),
               "CASE WHEN qname = '' THEN '.' ELSE regexp_extract(qname, '([^.]*\\.[^.]*)$', 1) || '.' END")})
value_counts("p25_entropy", {
    "qname": (lambda: F.col("qname"), "qname"),
    "entropy": (lambda: F.round(text.char_entropy("qname"), 6),
                "round(coalesce(list_sum(list_transform(list_distinct(string_split(qname, '')), "
                "lambda c: -log2((length(qname) - length(replace(qname, c, ''))) / CAST(length(qname) AS DOUBLE)) "
                "* ((length(qname) - length(replace(qname, c, ''))) / CAST(length(qname) AS DOUBLE)))), 0), 6)")},
             where=(lambda: F.col("qname") != "", "qname <> ''"))


def _encode_sql(column: str, alphabet: str, width: int) -> str:
    quoted = alphabet.replace("'", "''")
    return (f"md5(array_to_string(list_resize(list_transform(string_split({column}, '')[1:{width}], "
            f"lambda c: CASE WHEN instr('{quoted}', c) > 0 THEN instr('{quoted}', c) + 1 ELSE 1 END), {width}, 0), ','))")


value_counts("p26_encode_domain", {
    "qname": (lambda: F.col("qname"), "qname"),
    "codes": (lambda: F.md5(F.array_join(text.encode_domain("qname"), ",")),
              _encode_sql("qname", "-_.0123456789abcdefghijklmnopqrstuvwxyz", 128))},
             where=(lambda: F.col("qname") != "", "qname <> ''"))
value_counts("p27_encode_url", {
    "url": (lambda: F.col("http_url"), "http_url"),
    "codes": (lambda: F.md5(F.array_join(text.encode_url("http_url"), ",")),
              _encode_sql("http_url", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
                          "!\"#$%&'()*+,-./ÿ;<=>?@[\\]^_`{|}~", 256))},
             where=(lambda: F.col("http_url") != "", "http_url <> ''"))


def _sampled(flows):
    samplers = flows.sparkSession.sql("SELECT * FROM VALUES (1, 100), (2, 10) AS t(exporter_sysid, interval)")
    return numeric.apply_sampling(flows, samplers).groupBy("exporter_sysid").agg(
        F.count(F.lit(1)).alias("flows"), *[F.sum(c).alias(c) for c in ("pkts", "bytes", "out_pkts", "out_bytes")])


_F = "CASE exporter_sysid WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 1 END"
on_flows("p28_sampling", _sampled, "SELECT exporter_sysid, count(*) AS flows, " + ", ".join(
    f"CAST(sum({c} * {_F}) AS BIGINT) AS {c}" for c in ("pkts", "bytes", "out_pkts", "out_bytes"))
    + " FROM flows GROUP BY ALL", wide=True)
on_flows("p29_default_tags",
         lambda f: tag_flows(f).groupBy("scanner", "service", "popular_service").agg(F.count(F.lit(1)).alias("n")),
         "SELECT 0 AS scanner, 0 AS service, 0 AS popular_service, count(*) AS n FROM flows")
value_counts("p30_mpls_eos", {
    "eos": (numeric.mpls_eos, "CASE WHEN (mpls1 & 1) = 1 THEN mpls1 & 16777200 WHEN (mpls2 & 1) = 1 "
                              "THEN mpls2 & 16777200 ELSE mpls3 & 16777200 END"),
    "label1": (lambda: numeric.mpls_label(1), "mpls1 >> 4"),
    "exp2": (lambda: numeric.mpls_exp(2), "(mpls2 >> 1) & 7")}, wide=True)
