"""Detectors (D): events, and features where the detector makes no events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import detectors as d
from .. import fixtures
from ..rules import Pattern, Rule, read_rules
from .lookups import (CLASS_CTE, CLASS_RULES, INTEL_CTE, IPS_CTE, LISTED, MO_SQL, MOS, asset_sql, assets, domain_intel,
                      ip_list, service_ctes)
from .registry import COUNTERS, DAY, DAY_SLOTS, DOMAIN, PROTO, RECOUNT, REQ, START, event_sql, ip_sql, on_flows, register, with_flows

PATTERNS = [
    Pattern("PORT_SCAN", dport="80", protocol="TCP", peers=20, flows=25),
    Pattern("PORT_SCAN", dport="22", protocol="TCP", peers=4, flows=5),
    Pattern("PORT_SCAN", dport="23", protocol="TCP", peers=10, flows=15),
    Pattern("PORT_SCAN", protocol="TCP", peers=8, flows=10),
    Pattern("PORT_SCAN", protocol="UDP", peers=6, flows=8),
    Pattern("PORT_SCAN", peers=3),
    Pattern("IP_SCAN", sip="10.0.0.0/29", protocol="TCP", peers=3, flows=20),
    Pattern("IP_SCAN", peers=4, flows=5),
    Pattern("SRV", dport="ssh", flows=5),
    Pattern("SRV", dport="rdp", flows=40),
    Pattern("SRV", flows=20),
]
SIP, DIP = ip_sql("srcaddr"), ip_sql("dstaddr")

# ---- D1 port scan, D2 IP scan -------------------------------------------

D1_RULES = [Rule(1, 2, min=12, port="22", protocol="TCP"), Rule(2, 2, min=10, max=14, ip="10.0.0.0/28", protocol="TCP"),
            Rule(3, 2, min=9, port="443"), Rule(4, 2, min=13, protocol="TCP"), Rule(5, 2, min=5, sip="10.0.0.40"),
            Rule(6, 2, min=11)]
_SCANS = (f"scans AS (SELECT devid, srcaddr, prot, dstport, {COUNTERS}, count(DISTINCT dstaddr) AS peers FROM flows "
          f"WHERE srcport <> 0 AND dstport <> 0 AND (prot <> 6 OR {REQ}) GROUP BY devid, srcaddr, prot, dstport)")
_D1_VALUES = """rules(config_id, rmin, rmax, slo, shi, port, proto, class) AS (VALUES
    (1, 12, 0, 0, 4294967295, 22, 'TCP', 3), (2, 10, 14, 167772160, 167772175, 0, 'TCP', 2), (3, 9, 0, 0, 4294967295, 443, '', 5),
    (4, 13, 0, 0, 4294967295, 0, 'TCP', 6), (5, 5, 0, 167772200, 167772200, 0, '', 4), (6, 11, 0, 0, 4294967295, 0, '', 7))"""
_D1_PICK = f"""picked AS (SELECT * FROM (SELECT s.*, r.*, row_number() OVER (PARTITION BY devid, srcaddr, prot, dstport
    ORDER BY class, config_id) AS rn FROM scans s JOIN rules r ON srcaddr BETWEEN slo AND shi
    AND (r.port = 0 OR r.port = dstport) AND (proto = '' OR proto = {PROTO})) t WHERE rn = 1)"""
on_flows("d1_port_scan", lambda f: d.detect_port_scan(f, D1_RULES, [], DAY).events,
         f"SELECT {event_sql(f'''concat({SIP}, ':>:', dstport, ' ', {PROTO}, ' ')''', 'rmin', 'peers', chr(39) + 'peerips' + chr(39), '0', '2')} "
         "FROM picked WHERE peers >= rmin AND (rmax = 0 OR peers < rmax)", f"{_SCANS}, {_D1_VALUES}, {_D1_PICK}")
_D1_PATTERNS = """rules(config_id, rmin, rflows, port, proto, class) AS (VALUES (1, 20, 25, 80, 'TCP', 3), (2, 4, 5, 22, 'TCP', 3),
    (3, 10, 15, 23, 'TCP', 3), (4, 8, 10, 0, 'TCP', 6), (5, 6, 8, 0, 'UDP', 6), (6, 3, 0, 0, '', 7))"""
on_flows("d1_port_scan_features", lambda f: d.detect_port_scan(f, D1_RULES, PATTERNS, DAY).features,
         """SELECT devid, srcaddr, prot, dstport, first, last, flows, pkts, bytes, peers, first - first % 3600 AS hour
         FROM picked WHERE peers >= rmin AND flows >= rflows""",
         f"{_SCANS}, {_D1_PATTERNS}, " + _D1_PICK.replace("srcaddr BETWEEN slo AND shi\n    AND ", ""))
_SLOT_SCANS = _SCANS.replace("SELECT devid,", "SELECT first - first % 300 AS slot, devid,").replace(
    "GROUP BY devid,", "GROUP BY first - first % 300, devid,")
on_flows("d1_port_scan_slots", lambda f: d.detect_port_scan(f, [Rule(6, 2, min=2)], [], DAY_SLOTS).events,
         f"SELECT {event_sql(f'''concat({SIP}, ':>:', dstport, ' ', {PROTO}, ' ')''', '2', 'peers', chr(39) + 'peerips' + chr(39), '0', '2', '6', 'slot')} "
         "FROM scans WHERE peers >= 2", _SLOT_SCANS)

_PAIRS = (f"pairs AS (SELECT devid, srcaddr, dstaddr, prot, {COUNTERS}, count(DISTINCT dstport) AS peers FROM flows "
          f"WHERE srcport <> 0 AND dstport <> 0 AND prot <> 17 AND (prot <> 6 OR {REQ}) GROUP BY devid, srcaddr, dstaddr, prot)")
_D2_PICK = f"""picked AS (SELECT * FROM (SELECT p.*, r.*, row_number() OVER (PARTITION BY devid, srcaddr, dstaddr, prot
    ORDER BY class, config_id) AS rn FROM pairs p JOIN rules r ON srcaddr BETWEEN slo AND shi AND dstaddr BETWEEN dlo AND dhi
    AND (proto = '' OR proto = {PROTO})) t WHERE rn = 1)"""
_D2_OBJ = f"concat({SIP}, ':>', {DIP}, ': ', {PROTO}, ' ')"
on_flows("d2_ip_scan", lambda f: d.detect_ip_scan(f, CLASS_RULES, [], DAY).events,
         f"SELECT {event_sql(_D2_OBJ, 'rmin', 'peers', chr(39) + 'peerports' + chr(39), '0', '8')} FROM picked "
         "WHERE peers >= rmin AND (rmax = 0 OR peers < rmax)", f"{_PAIRS}, {CLASS_CTE}, {_D2_PICK}")
_D2_PATTERNS = ("rules(config_id, rmin, rflows, slo, shi, dlo, dhi, proto, class) AS (VALUES "
                "(1, 3, 20, 167772160, 167772167, 0, 4294967295, 'TCP', 2), (2, 4, 5, 0, 4294967295, 0, 4294967295, '', 7))")
on_flows("d2_ip_scan_features", lambda f: d.detect_ip_scan(f, CLASS_RULES, PATTERNS, DAY).features,
         """SELECT devid, srcaddr, dstaddr, prot, first, last, flows, pkts, bytes, peers, first - first % 3600 AS hour
         FROM picked WHERE peers >= rmin AND flows >= rflows""", f"{_PAIRS}, {_D2_PATTERNS}, {_D2_PICK}")


def v6(f: DataFrame) -> DataFrame:
    """The same flows under IPv6 addresses."""
    from .predicates import _v6
    pairs = {c: _v6(c) for c in ("srcaddr", "dstaddr")}
    return f.withColumns(pairs)


def _v6_sql(c: str) -> str:
    return f"concat('[2001:db8::', lower(to_hex({c} >> 16)), ':', lower(to_hex({c} & 65535)), ']')"


on_flows("d2_ip_scan_v6",
         lambda f: d.detect_ip_scan(v6(f), [Rule(1, 8, min=4, sip="2001:db8::a00:0/124"), Rule(2, 8, min=6)], [], DAY).events,
         f"SELECT {event_sql(f'''concat({_v6_sql('srcaddr')}, ':>', {_v6_sql('dstaddr')}, ': ', {PROTO}, ' ')''', 'rmin', 'peers', chr(39) + 'peerports' + chr(39), '0', '8')} "
         "FROM (SELECT *, CASE WHEN srcaddr BETWEEN 167772160 AND 167772175 THEN 1 ELSE 2 END AS config_id, "
         "CASE WHEN srcaddr BETWEEN 167772160 AND 167772175 THEN 4 ELSE 6 END AS rmin FROM pairs) p WHERE peers >= rmin",
         _PAIRS)

# ---- D3 DNS intel, D4 generated names, D5/D6 tunnels --------------------

D3_RULES = [Rule(1, 4, qcount=1, data_type="dns"), Rule(2, 4, qcount=0, ip="10.0.0.0/29, 10.0.0.40", data_type="dns"),
            Rule(3, 4, qcount=0, qname="6d9c547cf146054a5a720606.gamma.org, ab817c9349cf9c4f687.alpha.com", data_type="name")]
_D3 = (f"asked AS (SELECT devid, srcaddr, dstaddr, qname, qtype, {COUNTERS} FROM flows WHERE {REQ} AND qname <> '' AND {DOMAIN} "
       "GROUP BY devid, srcaddr, dstaddr, qname, qtype), classed AS (SELECT a.*, coalesce(i.class, '') AS class, i.md5 IS NOT NULL "
       "AS known FROM asked a LEFT JOIN intel i ON md5(a.qname) = i.md5)")
_D3_OBJ = f"concat({SIP}, ':>', {DIP}, ': ', class, ' ', qname)"
_Q = chr(39)
on_flows("d3_dns_intel", lambda f: d.detect_dns_intel(f, D3_RULES, domain_intel(f), DAY).events,
         f"SELECT {event_sql(_D3_OBJ, '1', 'flows', _Q + 'dns' + _Q, '2', '4', '1')} FROM classed WHERE known AND flows > 1 UNION ALL "
         f"SELECT {event_sql(_D3_OBJ, '0', 'flows', _Q + 'dns' + _Q, '2', '4', '2')} FROM classed WHERE known AND flows > 0 AND "
         "(srcaddr BETWEEN 167772160 AND 167772167 OR srcaddr = 167772200) UNION ALL "
         f"SELECT {event_sql(_D3_OBJ, '0', 'flows', _Q + 'name' + _Q, '2', '4', '3')} FROM classed WHERE qname IN "
         "('6d9c547cf146054a5a720606.gamma.org', 'ab817c9349cf9c4f687.alpha.com')", f"{INTEL_CTE}, {_D3}")
on_flows("d3_dns_features", lambda f: d.detect_dns_intel(f, D3_RULES, domain_intel(f), DAY).features,
         "SELECT devid, srcaddr, dstaddr, qname, qtype, first, last, flows, pkts, bytes, class, first - first % 3600 AS hour "
         "FROM classed", f"{INTEL_CTE}, {_D3}")

_LABEL = "split_part(lower(qname), '.', 1)"
_SCORE = (f"least(greatest(3 * len(list_distinct(string_split({_LABEL}, ''))) + 2 * length(regexp_replace({_LABEL}, '[^0-9]', '', 'g')) "
          f"+ length({_LABEL}) - 12, 0), 100)")
_NAMES = (f"named AS (SELECT devid, srcaddr, dstaddr, qname, CAST({_SCORE} AS INTEGER) AS score, {COUNTERS} FROM flows "
          f"WHERE prot = 17 AND {REQ} AND qname <> '' AND {DOMAIN} GROUP BY devid, srcaddr, dstaddr, qname)")
D4_RULES = [Rule(1, 12, min=90, qcount=0, sip="10.0.0.0/28", data_type="dga"),
            Rule(2, 12, min=70, qcount=1, dip="192.168.0.0/28", data_type="dga"), Rule(3, 12, min=50, qcount=2, data_type="dga")]


def white_names(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql("SELECT * FROM VALUES ('net') AS t(name)")


_D4_PICK = """picked AS (SELECT *, CASE WHEN score > 90 AND srcaddr BETWEEN 167772160 AND 167772175 THEN 1
    WHEN score > 70 AND dstaddr BETWEEN 3232235520 AND 3232235535 THEN 2 WHEN score > 50 THEN 3 END AS config_id
    FROM named WHERE NOT ends_with(qname, '.net')),
  counted AS (SELECT devid, srcaddr, dstaddr, config_id, count(*) AS names, arg_max(score, qname) AS last_score FROM picked
    WHERE config_id IS NOT NULL GROUP BY devid, srcaddr, dstaddr, config_id)"""
_PAIR_OBJ = f"concat({SIP}, ':>', {DIP}, ':  ')"
on_flows("d4_dga", lambda f: d.detect_dga(f, D4_RULES, white_names(f), DAY).events,
         f"SELECT {event_sql(_PAIR_OBJ, 'CASE config_id WHEN 1 THEN 90 WHEN 2 THEN 70 ELSE 50 END', 'last_score', _Q + 'dga' + _Q, '1', '12')} "
         "FROM counted WHERE names > config_id - 1", f"{_NAMES}, {_D4_PICK}")
on_flows("d4_dga_features", lambda f: d.detect_dga(f, D4_RULES, white_names(f), DAY).features,
         "SELECT devid, srcaddr, dstaddr, qname, first, last, flows, pkts, bytes, score, first - first % 3600 AS hour FROM named "
         "WHERE score > 50 AND NOT ends_with(qname, '.net')", _NAMES)


def _trained(f: DataFrame) -> DataFrame:
    """Generated names by a bigram model trained on the names themselves, the
    expression score giving the labels."""
    from ..detectors.scoring import model_scorer, name_score, train_scorer
    names = f.where(F.col("qname") != "").select("qname").distinct()
    rows = names.select(F.col("qname").alias("text"), (name_score(F.col("qname")) > 60).cast("int").alias("label"))
    return d.detect_dga(f, D4_RULES, white_names(f), DAY, model_scorer(train_scorer(rows))).events


on_flows("d4_dga_trained", _trained, None)

_ENTROPY = ("list_sum(list_transform(list_distinct(string_split(qname, '')), lambda c: -log2((length(qname) - "
            "length(replace(qname, c, ''))) / CAST(length(qname) AS DOUBLE)) * ((length(qname) - length(replace(qname, c, ''))) "
            "/ CAST(length(qname) AS DOUBLE))))")
D5_RULES = [Rule(1, 7, detvalue=3, fqcount=2, data_type="tunnel"), Rule(2, 7, detvalue=4, fqcount=0, ip="10.0.0.0/27", data_type="t4")]


def white_sub(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql("SELECT * FROM VALUES ('beta.net'), ('www') AS t(name)")


_D5 = f"""seen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY devid, qname ORDER BY first, msec_first, srcaddr,
    dstaddr, srcport, last, pkts, bytes) AS rn FROM flows WHERE prot = 17 AND dstport = 53 AND qtype IN (1, 5, 10, 15, 16)
    AND length(qname) >= 20) t WHERE rn = 1),
  tunnels AS (SELECT devid, srcaddr, dstaddr, regexp_extract(qname, '([^.]*\\.[^.]*)$', 1) AS domain, {COUNTERS},
    count(CASE WHEN {_ENTROPY} > 3 THEN 1 END) AS above_3, count(CASE WHEN {_ENTROPY} > 4 THEN 1 END) AS above_4
    FROM seen WHERE NOT ends_with(qname, '.beta.net') GROUP BY devid, srcaddr, dstaddr, domain)"""
_D5_OBJ = f"concat({SIP}, ':>', {DIP}, ': TUN ', domain)"
on_flows("d5_dns_tunnel", lambda f: d.detect_dns_tunnel(f, D5_RULES, white_sub(f), DAY).events,
         f"SELECT {event_sql(_D5_OBJ, '3', 'above_3', _Q + 'tunnel' + _Q, '0', '7', '1')} FROM tunnels WHERE above_3 > 2 UNION ALL "
         f"SELECT {event_sql(_D5_OBJ, '4', 'above_4', _Q + 't4' + _Q, '0', '7', '2')} FROM tunnels WHERE above_4 > 0 "
         "AND srcaddr BETWEEN 167772160 AND 167772191", _D5)
D6_RULES = [Rule(1, 14, min=95, qcount=3, sip="10.0.0.0/28", data_type="ai"), Rule(2, 14, min=80, qcount=5, data_type="ai")]
on_flows("d6_dns_tunnel_scored", lambda f: d.detect_dns_tunnel_scored(f, D6_RULES, DAY).events,
         f"SELECT {event_sql(_PAIR_OBJ, 'CASE config_id WHEN 1 THEN 3 ELSE 5 END', 'last_score', _Q + 'ai' + _Q, '1', '14')} FROM "
         "(SELECT devid, srcaddr, dstaddr, config_id, arg_max(score, qname) AS last_score FROM (SELECT *, CASE WHEN score > 95 "
         "AND srcaddr BETWEEN 167772160 AND 167772175 THEN 1 WHEN score > 80 THEN 2 END AS config_id FROM named) p "
         "WHERE config_id IS NOT NULL GROUP BY ALL) c", _NAMES)

# ---- D7 ICMP tunnel ------------------------------------------------------

D7_RULES = [Rule(1, 11, min=5, if1=2, if2=3, if3=20, data_type="icmp"),
            Rule(2, 11, min=1, if1=100, if2=100, if3=4, sip="10.0.0.0/28", dip="192.168.0.0/28", data_type="icmp")]
_D7 = f"""icmp AS (SELECT *, CASE WHEN {REQ} THEN srcaddr ELSE dstaddr END AS sip, CASE WHEN {REQ} THEN dstaddr ELSE srcaddr END AS dip
    FROM flows WHERE prot = 1 AND NOT regexp_full_match(icmp_data, 'A*') AND length(icmp_data) - length(replace(icmp_data, '.', ''))
      < length(icmp_data) - 2 AND NOT contains(icmp_data, 'abcdefghijklmnopqrstuvw') AND NOT contains(icmp_data,
      'ABCDEFGHIJKLMNOPQRSTUVW')),
  keys AS (SELECT devid, sip, dip, count(DISTINCT CASE WHEN dstport >> 8 NOT IN (0, 8) THEN icmp_data END) AS odd,
    count(DISTINCT icmp_payload_len) AS lens FROM icmp GROUP BY ALL),
  seqs AS (SELECT devid, sip, dip, max(CASE WHEN q > 0 AND p > 0 AND q < p THEN 1 ELSE 0 END) AS more,
    max(CASE WHEN q > 0 AND p > 0 THEN n ELSE 0 END) AS payloads FROM (SELECT devid, sip, dip, icmp_seq_num,
      count(CASE WHEN {REQ} THEN 1 END) AS q, count(CASE WHEN NOT {REQ} THEN 1 END) AS p, count(DISTINCT icmp_data) AS n
      FROM icmp GROUP BY ALL) s GROUP BY ALL)"""
_D7_OBJ = f"concat({ip_sql('sip')}, ':>', {ip_sql('dip')}, ':  ')"
on_flows("d7_icmp_tunnel", lambda f: d.detect_icmp_tunnel(f, D7_RULES, DAY).events,
         f"SELECT {event_sql(_D7_OBJ, '5', 'lens', _Q + 'icmp' + _Q, '0', '11', '1')} FROM keys JOIN seqs USING (devid, sip, dip) "
         "WHERE odd > 2 OR more = 1 OR payloads > 3 OR lens > 20 UNION ALL "
         f"SELECT {event_sql(_D7_OBJ, '1', 'lens', _Q + 'icmp' + _Q, '0', '11', '2')} FROM keys JOIN seqs USING (devid, sip, dip) "
         "WHERE (odd > 100 OR more = 1 OR payloads > 100 OR lens > 4) AND sip BETWEEN 167772160 AND 167772175 "
         "AND dip BETWEEN 3232235520 AND 3232235535", _D7)

# ---- D8 URL attacks, D19 malicious URLs ----------------------------------

D8_RULES = [Rule(1, 9, min=0, sub_type=1, pat=r".*union\s+select.*"), Rule(2, 9, min=1, sub_type=4, pat=r"/p/\d+/admin"),
            Rule(3, 9, min=60000, sub_type=5, pat=r"/p/\d*0/index\.html"), Rule(4, 9, min=0, sub_type=3, pat=r"/p/1\d\d/.*")]
_D8 = f"""urls AS (SELECT devid, srcaddr, srcport, dstaddr, dstport, http_url, {COUNTERS} FROM flows WHERE prot = 6 AND http_url <> ''
    AND http_ret_code <> 0 GROUP BY devid, srcaddr, srcport, dstaddr, dstport, http_url),
  hit AS (SELECT *, CASE WHEN regexp_full_match(http_url, '/p/1\\d\\d/.*') THEN 4
    WHEN regexp_full_match(http_url, '/p/\\d*0/index\\.html') THEN 3 WHEN regexp_full_match(http_url, '/p/\\d+/admin') THEN 2
    WHEN regexp_full_match(http_url, '.*union\\s+select.*') THEN 1 END AS config_id FROM urls)"""
_D8_OBJ = (f"concat({SIP}, ':', srcport, '>', {DIP}, ':', dstport, ' TCP ', CASE config_id WHEN 1 THEN 'SQL_INJECT' "
           "WHEN 2 THEN 'VISIT_ADMIN' WHEN 3 THEN 'PULL_DB' ELSE 'RESO_EXPLORE' END)")
on_flows("d8_url_attacks", lambda f: d.detect_url_attacks(f, D8_RULES, DAY).events,
         f"SELECT {event_sql(_D8_OBJ, 'CASE config_id WHEN 2 THEN 1 WHEN 3 THEN 60000 ELSE 0 END', 'flows', _Q + _Q, '3', '9')} "
         "FROM hit WHERE config_id IN (1, 4) OR (config_id = 2 AND flows > 1) OR (config_id = 3 AND bytes > 60000)", _D8)
D19_RULES = [Rule(1, 16, min=60, sip="10.0.0.0/27", data_type="url"), Rule(2, 16, min=20, dip="192.168.0.0/28", data_type="url")]
_URL_SCORE = ("least(10 * length(regexp_replace(http_url, '[^''\"<>;()=]', '', 'g')) + 30 * len(regexp_extract_all(lower(http_url), "
              "'(select|union|script|passwd|exec|\\.\\./)')) + length(http_url) // 10, 100)")
_D19 = (f"scored AS (SELECT devid, srcaddr, dstaddr, dstport, http_url, CAST({_URL_SCORE} AS INTEGER) AS score, {COUNTERS} FROM flows "
        f"WHERE {REQ} AND http_url <> '' GROUP BY devid, srcaddr, dstaddr, dstport, http_url)")
# Patterns as many as parts; a third of them have no plain text outside of groups.
PART_RULES = r"""SELECT CAST(p_partkey AS INT) AS config_id, CAST(9 AS INT) AS type_id, CAST(p_partkey % 2 AS BIGINT) AS min,
  CAST(1 + p_partkey % 8 AS INT) AS sub_type, CASE p_partkey % 3 WHEN 0 THEN concat('/p/', CAST(p_partkey AS STRING), '(/admin|[?]id=1.*)')
    WHEN 1 THEN concat('.*[/]', CAST(p_partkey AS STRING), '[?]id=1 union sel+ect') ELSE concat('(.p.', CAST(p_partkey % 50 AS STRING), '/index.html)') END AS pat
FROM {part} p"""


def _many_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """URL attacks by as many patterns as there are parts."""
    rules = read_rules(spark.sql(PART_RULES, part=fixtures.table(spark, sf, "part")))
    return d.detect_url_attacks(fixtures.flows(spark, sf), rules, DAY).events


register("d8_url_attacks_table", _many_patterns, with_flows(
    f"""SELECT {event_sql(f"concat({SIP}, ':', srcport, '>', {DIP}, ':', dstport, ' TCP ', attack)", 'rmin', 'flows', _Q + _Q, '3', '9')}
    FROM asked JOIN best USING (http_url) WHERE CASE WHEN kind = 5 THEN bytes ELSE flows END > rmin""",
    f"""asked AS (SELECT devid, srcaddr, srcport, dstaddr, dstport, http_url, {COUNTERS} FROM flows WHERE prot = 6 AND http_url <> ''
          AND http_ret_code <> 0 GROUP BY devid, srcaddr, srcport, dstaddr, dstport, http_url),
        patterns AS (SELECT CAST(p_partkey AS INTEGER) AS config_id, p_partkey % 2 AS rmin, 1 + p_partkey % 8 AS kind,
          ['SQL_INJECT', 'XSS', 'RESO_EXPLORE', 'VISIT_ADMIN', 'PULL_DB', 'CMD_EXEC', 'CODE_EXEC', 'XML_ENTITY'][1 + p_partkey % 8] AS attack,
          CASE p_partkey % 3 WHEN 0 THEN concat('/p/', p_partkey, '(/admin|[?]id=1.*)') WHEN 1 THEN concat('.*[/]', p_partkey, '[?]id=1 union sel+ect')
            ELSE concat('(.p.', p_partkey % 50, '/index.html)') END AS pat FROM part),
        best AS (SELECT http_url, arg_max(rmin, config_id) AS rmin, arg_max(kind, config_id) AS kind, arg_max(attack, config_id) AS attack,
            max(config_id) AS config_id FROM (SELECT DISTINCT http_url FROM asked) u JOIN patterns ON regexp_full_match(http_url, pat)
          GROUP BY http_url)"""))
on_flows("d19_malicious_url", lambda f: d.detect_malicious_url(f, D19_RULES, DAY).events,
         f"SELECT {event_sql(f'''concat({SIP}, ':>', {DIP}, ':', dstport, ' ')''', 'CASE config_id WHEN 1 THEN 60 ELSE 20 END', 'score', _Q + 'url' + _Q, '1', '16')} "
         "FROM (SELECT *, CASE WHEN score > 60 AND srcaddr BETWEEN 167772160 AND 167772191 THEN 1 WHEN score > 20 AND dstaddr "
         "BETWEEN 3232235520 AND 3232235535 THEN 2 END AS config_id FROM scored) s WHERE config_id IS NOT NULL", _D19)

# ---- D9 outreach, D10 mining, D11 threats --------------------------------

D9_RULES = [Rule(1, 10, min=90000, data_type="bytes"), Rule(2, 10, min=60000, sip="10.0.0.0/28", dip="192.168.0.0/30", data_type="bytes")]
_D9 = (f"trips AS (SELECT devid, srcaddr, dstaddr, dstport, {COUNTERS} FROM flows WHERE prot = 6 AND {REQ} "
       "GROUP BY devid, srcaddr, dstaddr, dstport)")
_D9_OBJ = f"concat({SIP}, ':>', {DIP}, ':', dstport, ' TCP ')"
on_flows("d9_outreach", lambda f: d.detect_outreach(f, D9_RULES, assets(f), DAY).events,
         f"SELECT {event_sql(_D9_OBJ, '90000', 'bytes', _Q + 'bytes' + _Q, '0', '10', '1')} FROM trips WHERE bytes >= 90000 AND "
         f"{asset_sql('srcaddr')} UNION ALL SELECT {event_sql(_D9_OBJ, '60000', 'bytes', _Q + 'bytes' + _Q, '0', '10', '2')} FROM trips "
         "WHERE bytes >= 60000 AND srcaddr BETWEEN 167772160 AND 167772175 AND dstaddr BETWEEN 3232235520 AND 3232235523", _D9)


def mining_domains(f: DataFrame) -> DataFrame:
    return domain_intel(f).select("md5", F.concat(F.lit("coin-"), "class").alias("coin")).where(
        F.substring("md5", 2, 1) == "0")


def mining_ips(f: DataFrame) -> DataFrame:
    return f.sparkSession.sql("SELECT CAST(ip AS BIGINT) AS ip, coin FROM VALUES (3232235523, 'xmr'), (167772190, 'eth') AS t(ip, coin)")


_D10 = f"""coins AS (SELECT md5, concat('coin-', class) AS coin FROM intel WHERE substr(md5, 2, 1) = '0'),
  mined AS (SELECT devid, srcaddr AS sip, dstaddr AS dip, prot, threat_name AS coin, '' AS domain, 3 AS model, first, last, pkts, bytes
      FROM flows WHERE prot IN (6, 17) AND upper(threat_type) = 'MINING' AND {REQ}
    UNION ALL SELECT devid, CASE WHEN {REQ} THEN srcaddr ELSE dstaddr END, CASE WHEN {REQ} THEN dstaddr ELSE srcaddr END, prot, coin,
      qname, 2, first, last, pkts, bytes FROM flows JOIN coins ON md5(qname) = md5 WHERE qname <> '' AND prot IN (6, 17)
    UNION ALL SELECT devid, CASE WHEN dstaddr IN (3232235523, 167772190) THEN srcaddr ELSE dstaddr END,
      CASE WHEN dstaddr IN (3232235523, 167772190) THEN dstaddr ELSE srcaddr END, prot,
      CASE CASE WHEN dstaddr IN (3232235523, 167772190) THEN dstaddr ELSE srcaddr END WHEN 3232235523 THEN 'xmr' ELSE 'eth' END,
      '', 2, first, last, pkts, bytes FROM flows WHERE prot IN (6, 17) AND (dstaddr IN (3232235523, 167772190)
      OR srcaddr IN (3232235523, 167772190))),
  groups AS (SELECT devid, sip, dip, prot, coin, domain, model, {COUNTERS} FROM mined GROUP BY devid, sip, dip, prot, coin, domain, model)"""
_D10_OBJ = f"concat({ip_sql('sip')}, ':>', {ip_sql('dip')}, ': ', {PROTO}, ' ', coin, ' ', domain)"
on_flows("d10_mining", lambda f: d.detect_mining(f, [Rule(5, 15, qcount=2, data_type="mining")], mining_domains(f), mining_ips(f), DAY).events,
         f"SELECT {event_sql(_D10_OBJ, '2', 'flows', _Q + 'mining' + _Q, 'model', '15', '5')} FROM groups", f"{INTEL_CTE}, {_D10}")
_D11 = (f"marked AS (SELECT devid, srcaddr, prot, dstaddr, dstport, lower(threat_type) AS fp_type, lower(threat_name) AS fp_name, {COUNTERS} "
        f"FROM flows WHERE threat_type <> '' AND {REQ} GROUP BY devid, srcaddr, prot, dstaddr, dstport, fp_type, fp_name)")
_D11_OBJ = (f"concat(CASE WHEN fp_type = 'mining' THEN {DIP} ELSE {SIP} END, ':>', CASE WHEN fp_type = 'mining' THEN {SIP} ELSE {DIP} END, "
            f"':', dstport, ' ', {PROTO}, ' ', fp_type, ' ', fp_name)")
on_flows("d11_threats", lambda f: d.detect_threats(f, [Rule(1, 13), Rule(4, 13, weekday=(2, 3))], DAY).events,
         f"SELECT {event_sql(_D11_OBJ, '0', 'flows', _Q + 'fps' + _Q, '3', '13', '1')} FROM marked", _D11)

# ---- D12-D14 services ----------------------------------------------------

_SRV_PICK = """picked AS (SELECT *, CASE WHEN upper(app_proto) = 'SSH' THEN 5 WHEN upper(app_proto) = 'RDP' THEN 40 ELSE 20 END AS rmin
    FROM (SELECT *, 1 AS srv_mark FROM servers UNION ALL SELECT *, 0 FROM asked) b)"""
on_flows("d12_services", lambda f: d.detect_services(f, PATTERNS, DAY).features,
         "SELECT devid, addr, port, prot, srv_mark, first, last, flows, pkts, bytes, app_proto, first - first % 3600 AS hour "
         "FROM picked WHERE flows >= rmin", service_ctes().replace("app", "pname").replace("pname_proto", "app_proto") + ", " + _SRV_PICK,
         wide=True)
D13_RULES = [Rule(1, 3, min=30, ip="192.168.0.0/28", port="22", protocol="TCP"), Rule(2, 3, min=20, max=60, port="80"),
             Rule(3, 3, min=50, protocol="UDP"), Rule(4, 3, min=25)]
_D13_CTES = service_ctes("tcp_flags <> 20 AND (prot = 17 OR (srcport < 65535 AND dstport < 65535))").replace(
    "split_part(max(CASE WHEN app <> '' THEN concat(CAST(last AS VARCHAR), '|', app) END), '|', 2)",
    "split_part(max(CASE WHEN pname <> '' OR service_name <> '' THEN concat(CAST(last AS VARCHAR), '|', "
    "CASE WHEN pname <> '' THEN pname ELSE service_name END) END), '|', 2)")
_D13_PICK = f"""exposed AS (SELECT *, CASE WHEN addr BETWEEN 3232235520 AND 3232235535 AND port = 22 AND prot = 6 THEN 1
    WHEN port = 80 THEN 2 WHEN prot = 17 THEN 3 ELSE 4 END AS config_id FROM servers WHERE {asset_sql('addr')})"""
on_flows("d13_asset_events", lambda f: d.detect_asset_services(f, assets(f), D13_RULES, PATTERNS, DAY).events,
         f"SELECT {event_sql(f'''concat(':>', {ip_sql('addr')}, ':', port, ' ', {PROTO}, ' ')''', 'CASE config_id WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 50 ELSE 25 END', 'flows', _Q + 'flow_count' + _Q, '0', '3')} "
         "FROM exposed WHERE (config_id = 1 AND flows >= 30) OR (config_id = 2 AND flows >= 20 AND flows < 60) "
         "OR (config_id = 3 AND flows >= 50) OR (config_id = 4 AND flows >= 25)", f"{_D13_CTES}, {_D13_PICK}", wide=True)


def _asset_features(f: DataFrame) -> DataFrame:
    return d.detect_asset_services(f, assets(f), D13_RULES, PATTERNS, DAY).features.select(
        "addr", "port", "prot", "srv_mark", "first", "last", "flows", "pkts", "bytes", "app_proto", "service_name",
        "service_version", "dev_type", "dev_vendor", "os_name", "midware_name")


def _attr(col: str, group: list[str]) -> str:
    order = ", ".join(["last DESC"] + [f"{c} DESC" for c in group])
    return f"coalesce(first({col} ORDER BY {order}) FILTER (WHERE {group[0]} <> ''), '') AS {col}"


def _attr_sql() -> str:
    from ..operators.aggregate import ATTRIBUTE_GROUPS as g
    return ", ".join([_attr("service_name", g["service"]), _attr("service_version", g["service"]), _attr("dev_type", g["dev"]),
                      _attr("dev_vendor", g["dev"]), _attr("os_name", g["os"]), _attr("midware_name", g["midware"])])


on_flows("d13_asset_features", _asset_features,
         f"""SELECT p.addr, p.port, p.prot, srv_mark, first, last, flows, pkts, bytes, app_proto, service_name, service_version, dev_type,
           dev_vendor, os_name, midware_name FROM picked p JOIN attrs a ON a.mark = p.srv_mark AND a.addr = p.addr AND a.port = p.port
           AND a.prot = p.prot WHERE flows >= rmin AND {asset_sql('p.addr')}""",
         f"""{_D13_CTES}, {_SRV_PICK}, attrs AS (SELECT 1 AS mark, srcaddr AS addr, srcport AS port, prot, {_attr_sql()} FROM sf GROUP BY ALL
           UNION ALL SELECT 0, dstaddr, dstport, prot, {_attr_sql()} FROM sf WHERE prot = 17 OR {REQ} GROUP BY ALL)""", wide=True)
_APP = ("coalesce(split_part(max(CASE WHEN pname <> '' OR service_name <> '' THEN concat(CAST(last AS VARCHAR), '|', "
        "CASE WHEN pname <> '' THEN pname ELSE service_name END) END), '|', 2), '')")
on_flows("d14_tcp_init", lambda f: d.detect_tcp_init(f, DAY).features,
         f"""SELECT q.devid, q.sip, q.dip, q.dport, q.http_ret_code, q.first, q.last, q.flows, q.pkts, q.bytes,
           CASE WHEN q.app <> '' THEN q.app ELSE coalesce(r.app, '') END AS app_proto,
           CASE WHEN r.sip IS NOT NULL OR q.http_ret_code <> 0 THEN 'res' ELSE 'req' END AS srv_mark,
           q.first - q.first % 3600 AS hour
         FROM (SELECT devid, srcaddr AS sip, dstaddr AS dip, dstport AS dport, http_ret_code, {COUNTERS}, {_APP} AS app FROM flows
             WHERE prot = 6 AND tcp_flags <> 20 AND {REQ} GROUP BY ALL) q
         LEFT JOIN (SELECT devid, dstaddr AS sip, srcaddr AS dip, srcport AS dport, http_ret_code, {_APP} AS app FROM flows
             WHERE prot = 6 AND tcp_flags <> 20 AND NOT {REQ} GROUP BY ALL) r
           ON q.devid = r.devid AND q.sip = r.sip AND q.dip = r.dip AND q.dport = r.dport AND q.http_ret_code = r.http_ret_code""",
         wide=True)

# ---- D15-D18 lists and monitored objects ---------------------------------

D15_RULES = [Rule(1, 6, min=1, data_type="Bps"), Rule(2, 6, min=0, max=1, data_type="pps"), Rule(3, 6, min=9, data_type="other")]
_LIST_SUMS = f"sums AS (SELECT devid, sip, dip, prot, ti_mark, class, {COUNTERS} FROM listed GROUP BY devid, sip, dip, prot, ti_mark, class)"
_D15_OBJ = f"concat({ip_sql('sip')}, ':>', {ip_sql('dip')}, ': ', {PROTO}, ' ', class)"
on_flows("d15_suspicious", lambda f: d.detect_suspicious(f, ip_list(f), D15_RULES, DAY).events,
         f"SELECT {event_sql(_D15_OBJ, '1', 'bytes // 86400', _Q + 'Bps' + _Q, '2', '6', '1')} FROM sums WHERE ti_mark AND bytes / 86400.0 >= 1 "
         f"UNION ALL SELECT {event_sql(_D15_OBJ, '0', 'pkts // 86400', _Q + 'pps' + _Q, '2', '6', '2')} FROM sums WHERE ti_mark "
         "AND pkts / 86400.0 < 1", f"{IPS_CTE}, {LISTED}, {_LIST_SUMS}")
on_flows("d15_popular_features", lambda f: d.detect_suspicious(f, ip_list(f), [], DAY).features,
         "SELECT devid, sip, dip, prot, ti_mark, class, first, last, flows, pkts, bytes, first - first % 3600 AS hour FROM sums",
         f"{IPS_CTE}, {LISTED}, {_LIST_SUMS}")
_SLOT_LISTED = _LIST_SUMS.replace("SELECT devid,", "SELECT first - first % 300 AS slot, devid,").replace(
    "GROUP BY devid,", "GROUP BY first - first % 300, devid,")
on_flows("d16_black_list", lambda f: d.detect_black_list(f, ip_list(f), [Rule(8, 5, min=100, max=250, data_type="bps")], DAY_SLOTS).events,
         f"SELECT {event_sql(_D15_OBJ.replace(', class)', ')'), '100', 'bytes // 300', _Q + 'bps' + _Q, '2', '5', '8', 'slot')} FROM sums "
         "WHERE ti_mark AND bytes / 300.0 >= 100 AND bytes / 300.0 < 250", f"{IPS_CTE}, {LISTED}, {_SLOT_LISTED}")
D17_RULES = [Rule(1, 1, min=100, max=200, moid=1, data_type="Bps"), Rule(2, 1, max=220, moid=2, data_type="Bps"),
             Rule(3, 1, min=1, moid=3, data_type="fps"), Rule(4, 1, min=150, moid=4, data_type="Bps")]
_D17 = f"""watched AS (SELECT 1 AS moid, srcaddr AS lip, dstaddr AS tip, dstport AS tport, * FROM flows WHERE {MO_SQL[1]}
    UNION ALL SELECT 2, dstaddr, srcaddr, srcport, * FROM flows WHERE {MO_SQL[2]}
    UNION ALL SELECT 4, srcaddr, dstaddr, dstport, * FROM flows WHERE {MO_SQL[4]}),
  rates AS (SELECT devid, first - first % 300 AS slot, moid, lip, tip, tport, prot, {COUNTERS} FROM watched
    GROUP BY devid, first - first % 300, moid, lip, tip, tport, prot)"""
_D17_OBJ = f"concat({ip_sql('tip')}, ':', tport, '>', {ip_sql('lip')}, ': ', {PROTO}, ' ', moid)"
_LIMITS = "(VALUES (1, 1, 200, 100), (2, 2, 220, NULL), (4, 4, NULL, 150)) r(config_id, mo, rmax, rmin)"
on_flows("d17_object_thresholds", lambda f: d.detect_object_thresholds(f, MOS, D17_RULES, DAY_SLOTS).events,
         f"SELECT {event_sql(_D17_OBJ, 'CASE WHEN bytes / 300.0 >= rmax THEN rmax ELSE rmin END', 'bytes // 300', _Q + 'Bps' + _Q, '3', '1', time='slot')} "
         f"FROM rates JOIN {_LIMITS} ON mo = moid WHERE coalesce(bytes / 300.0 >= rmax, FALSE) OR coalesce(bytes / 300.0 >= rmin, FALSE)",
         _D17)
_MO_ALL = " UNION ALL ".join(f"SELECT {i} AS moid, * FROM flows WHERE {c}" for i, c in MO_SQL.items())
on_flows("d18_object_traffic", lambda f: d.object_traffic(f, MOS),
         f"SELECT devid, moid, slot - slot % 3600 AS hour, {RECOUNT}, max(flows) AS peak_flows, max(pkts) AS peak_pkts, "
         "max(bytes) AS peak_bytes FROM slots GROUP BY ALL",
         f"mo AS ({_MO_ALL}), slots AS (SELECT devid, moid, first - first % 300 AS slot, {COUNTERS} FROM mo "
         "GROUP BY devid, moid, first - first % 300)")
on_flows("d20_popular_services", lambda f: d.popular_services(f, START + 86400, 1, 30),
         f"""SELECT * FROM (SELECT dstaddr, prot, dstport, count(DISTINCT srcaddr) AS clients, (SELECT count(DISTINCT srcaddr) FROM flows)
           AS addresses FROM flows WHERE prot IN (6, 17) AND {REQ} GROUP BY ALL) t WHERE clients * 100 >= addresses * 30""")
