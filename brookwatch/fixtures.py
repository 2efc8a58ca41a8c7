"""Flow table derived from the given ``lineitem`` table.

The given data holds no flow table.  One SQL text derives it with integer
arithmetic, so any SQL engine computes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DAY_START = 1704067200
DAY_END = DAY_START + 86400

BASE_COLUMNS = ("devid first last msec_first msec_last prot tos tcp_flags srcaddr dstaddr srcport dstport pkts bytes "
                "qname qtype http_url http_ret_code icmp_data icmp_seq_num icmp_payload_len threat_type threat_name").split()

FLOWS_SQL = """
SELECT
  CAST(1 AS INT) AS devid,
  CAST(1704067200 + (l_orderkey * 37 + l_linenumber * 11) % 86400 AS BIGINT) AS first,
  CAST(1704067200 + (l_orderkey * 37 + l_linenumber * 11) % 86400 + q % 40 AS BIGINT) AS last,
  CAST((l_partkey * 7) % 1000 AS INT) AS msec_first,
  CAST((l_partkey * 7) % 1000 AS INT) AS msec_last,
  CAST(prot AS INT) AS prot,
  CAST(req AS INT) AS tos,
  CAST(CASE WHEN prot <> 6 THEN 0 WHEN l_partkey % 11 = 0 THEN 20 ELSE 27 END AS INT) AS tcp_flags,
  CAST(CASE WHEN req = 1 THEN cli ELSE srv END AS BIGINT) AS srcaddr,
  CAST(CASE WHEN req = 1 THEN srv ELSE cli END AS BIGINT) AS dstaddr,
  CAST(CASE WHEN prot = 1 THEN 0 WHEN req = 1 THEN cport ELSE sport END AS INT) AS srcport,
  CAST(CASE WHEN prot = 1 THEN itype * 256 WHEN req = 1 THEN sport ELSE cport END AS INT) AS dstport,
  CAST(q AS BIGINT) AS pkts,
  CAST(price AS BIGINT) AS bytes,
  CAST(CASE WHEN prot = 17 AND sport = 53 THEN
    concat(substr(md5(CAST(l_partkey AS STRING)), 1, CAST(8 + l_partkey % 24 AS INT)), '.',
           CASE l_suppkey % 3 WHEN 0 THEN 'alpha.com' WHEN 1 THEN 'beta.net' ELSE 'gamma.org' END)
    ELSE '' END AS STRING) AS qname,
  CAST(CASE WHEN prot = 17 AND sport = 53 THEN CASE l_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 28 WHEN 2 THEN 16 ELSE 15 END ELSE 0 END AS INT) AS qtype,
  CAST(CASE WHEN prot = 6 AND sport IN (80, 8080) THEN
    concat('/p/', CAST(l_partkey AS STRING), CASE l_partkey % 5 WHEN 0 THEN '?id=1 union select' WHEN 1 THEN '/admin' ELSE '/index.html' END)
    ELSE '' END AS STRING) AS http_url,
  CAST(CASE WHEN prot = 6 AND sport IN (80, 8080) THEN CASE l_partkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 0 END ELSE 0 END AS INT) AS http_ret_code,
  CAST(CASE WHEN prot = 1 THEN CASE WHEN l_partkey % 3 = 0 THEN 'abcdefghijklmnopqrstuvwabcd' ELSE md5(CAST(l_orderkey AS STRING)) END ELSE '' END AS STRING) AS icmp_data,
  CAST(CASE WHEN prot = 1 THEN l_orderkey % 16 ELSE 0 END AS INT) AS icmp_seq_num,
  CAST(CASE WHEN prot = 1 THEN 32 + l_partkey % 7 ELSE 0 END AS BIGINT) AS icmp_payload_len,
  CAST(CASE WHEN prot = 6 THEN CASE l_partkey % 97 WHEN 0 THEN 'MINING' WHEN 1 THEN 'Backdoor' ELSE '' END ELSE '' END AS STRING) AS threat_type,
  CAST(CASE WHEN prot = 6 THEN CASE l_partkey % 97 WHEN 0 THEN 'xmr' WHEN 1 THEN 'ratX' ELSE '' END ELSE '' END AS STRING) AS threat_name
FROM (
  SELECT l.*, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS price,
    CASE l_linenumber % 4 WHEN 0 THEN 17 WHEN 3 THEN 1 ELSE 6 END AS prot,
    l_orderkey % 2 AS req,
    167772160 + l_suppkey % 50 AS cli,
    3232235520 + l_partkey % 32 AS srv,
    20000 + (l_orderkey * 13) % 30000 AS cport,
    CASE WHEN l_linenumber % 4 = 0 THEN CASE l_partkey % 5 WHEN 0 THEN 123 WHEN 1 THEN 9999 ELSE 53 END
         ELSE CASE CAST((l_partkey - l_partkey % 32) / 32 AS BIGINT) % 8 WHEN 0 THEN 22 WHEN 1 THEN 23 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 445 WHEN 5 THEN 3389 WHEN 6 THEN 8080 ELSE 21 END END AS sport,
    CASE l_partkey % 9 WHEN 0 THEN 13 WHEN 1 THEN 0 ELSE 8 END AS itype
  FROM lineitem l) t
"""

# Remaining columns of the flow layout, from the base columns.
WIDE_SQL = """
SELECT f.*,
  CAST(2 AS INT) AS af,
  CASE CAST(srcaddr % 3 AS INT) WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'none' END AS ident,
  CAST(64500 + srcaddr % 7 AS BIGINT) AS srcas,
  CAST(64500 + dstaddr % 5 AS BIGINT) AS dstas,
  CAST(64600 + srcaddr % 3 AS BIGINT) AS next_as,
  CAST(64700 + dstaddr % 3 AS BIGINT) AS prev_as,
  CAST(1 + srcport % 4 AS BIGINT) AS input,
  CAST(1 + dstport % 4 AS BIGINT) AS output,
  CAST(20 + srcaddr % 9 AS INT) AS src_mask,
  CAST(20 + dstaddr % 9 AS INT) AS dst_mask,
  CAST(100 + srcaddr % 10 AS INT) AS src_vlan,
  CAST(100 + dstaddr % 10 AS INT) AS dst_vlan,
  CAST(2886729728 + dstaddr % 8 AS BIGINT) AS ip_nexthop,
  CAST(2886730240 + srcaddr % 6 AS BIGINT) AS bgp_nexthop,
  CAST(2886730496 + srcaddr % 4 AS BIGINT) AS ip_router,
  CAST(pkts % 7 AS BIGINT) AS out_pkts,
  CAST(bytes % 1009 AS BIGINT) AS out_bytes,
  CAST(1 + pkts % 3 AS BIGINT) AS aggr_flows,
  CAST(1 + srcaddr % 3 AS INT) AS exporter_sysid,
  CAST(srcaddr % 2 AS INT) AS engine_type,
  CAST(srcaddr % 5 AS INT) AS engine_id,
  CAST(CASE bytes % 4 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 128 ELSE 0 END AS INT) AS fwd_status,
  CAST(pkts % 2 AS INT) AS dir,
  CAST((bytes % 4) * 8 AS INT) AS dst_tos,
  CAST(bytes % 5000 AS BIGINT) AS client_latency,
  CAST(bytes % 7000 AS BIGINT) AS server_latency,
  CAST(bytes % 11000 AS BIGINT) AS app_latency,
  CAST(last * 1000 + msec_last + 250 AS BIGINT) AS received,
  CAST(44444 + srcaddr % 16 AS BIGINT) AS in_src_mac,
  CAST(55555 + dstaddr % 16 AS BIGINT) AS out_dst_mac,
  CAST(44444 + dstaddr % 16 AS BIGINT) AS in_dst_mac,
  CAST(55555 + srcaddr % 16 AS BIGINT) AS out_src_mac,
  CAST((1000 + srcaddr % 40) * 16 + (pkts % 8) * 2 AS INT) AS mpls1,
  CAST((2000 + dstaddr % 40) * 16 + (bytes % 8) * 2 + (CASE WHEN pkts % 4 = 0 THEN 1 ELSE 0 END) AS INT) AS mpls2,
  CAST((3000 + pkts % 40) * 16 + 1 AS INT) AS mpls3,
  CASE WHEN qname <> '' THEN 'dns' WHEN http_url <> '' THEN 'http'
       WHEN 22 IN (srcport, dstport) THEN 'ssh' ELSE '' END AS pname,
  CASE WHEN 3389 IN (srcport, dstport) THEN 'rdp' WHEN 445 IN (srcport, dstport) THEN 'smb' ELSE '' END AS service_name,
  CASE WHEN 3389 IN (srcport, dstport) OR 445 IN (srcport, dstport) THEN 'remote' ELSE '' END AS service_type,
  CASE WHEN 3389 IN (srcport, dstport) THEN concat('v', CAST(bytes % 3 AS STRING)) ELSE '' END AS service_version,
  CAST(last * 1000000 + bytes AS BIGINT) AS service_time,
  CASE WHEN bytes % 97 = 0 THEN 'router' WHEN bytes % 97 = 1 THEN 'camera' ELSE '' END AS dev_type,
  CASE WHEN bytes % 97 < 2 THEN concat('d', CAST(pkts AS STRING)) ELSE '' END AS dev_name,
  CASE WHEN bytes % 97 < 2 THEN concat('vendor', CAST(pkts % 5 AS STRING)) ELSE '' END AS dev_vendor,
  CASE WHEN bytes % 97 < 2 THEN 'm1' ELSE '' END AS dev_model,
  CAST(last * 1000000 + bytes AS BIGINT) AS dev_time,
  CASE WHEN bytes % 89 = 0 THEN 'linux' WHEN bytes % 89 = 1 THEN 'windows' ELSE '' END AS os_type,
  CASE WHEN bytes % 89 < 2 THEN concat('os', CAST(pkts % 9 AS STRING)) ELSE '' END AS os_name,
  CASE WHEN bytes % 89 < 2 THEN '1.0' ELSE '' END AS os_version,
  CAST(last * 1000000 + bytes AS BIGINT) AS os_time,
  CASE WHEN bytes % 83 = 0 THEN 'web' ELSE '' END AS midware_type,
  CASE WHEN bytes % 83 = 0 THEN concat('mw', CAST(pkts % 4 AS STRING)) ELSE '' END AS midware_name,
  CASE WHEN bytes % 83 = 0 THEN '2.0' ELSE '' END AS midware_version,
  CAST(last * 1000000 + bytes AS BIGINT) AS midware_time,
  CASE WHEN threat_type <> '' THEN '1' ELSE '' END AS threat_version,
  CAST(last * 1000000 + bytes AS BIGINT) AS threat_time,
  CAST(CASE WHEN qname <> '' THEN 1 ELSE 0 END AS INT) AS qclass,
  CASE WHEN http_url <> '' THEN concat('h', CAST(dstaddr % 4 AS STRING), '.example') ELSE '' END AS http_host,
  CASE WHEN http_url <> '' THEN 'GET' ELSE '' END AS http_method,
  CASE WHEN http_url <> '' THEN 'text/html' ELSE '' END AS http_mime,
  CASE WHEN http_url <> '' THEN concat('agent "', CAST(pkts % 3 AS STRING), '"') ELSE '' END AS http_user_agent,
  CASE WHEN http_url <> '' THEN 'sid=1' ELSE '' END AS http_cookie
FROM flows f
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that is read in fewer splits than there are cores over all cores.

    The derivation is CPU work per row; a table of many splits, in whatever number of files, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def flows_from(lineitem: DataFrame) -> DataFrame:
    """Flow rows of a ``lineitem`` frame (batch or streaming)."""
    text = FLOWS_SQL.replace("FROM lineitem l", "FROM {lineitem} l")
    return lineitem.sparkSession.sql(text, lineitem=lineitem)


def widen(flows: DataFrame) -> DataFrame:
    """Add the optional columns of the flow layout, the label stack as an array."""
    wide = flows.sparkSession.sql(WIDE_SQL.replace("FROM flows f", "FROM {flows} f"), flows=flows)
    return wide.selectExpr("*", "array(mpls1, mpls2, mpls3) AS mpls").drop("mpls1", "mpls2", "mpls3")


def wide_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow table of a data folder, derived as it is read.

    Each reader computes the columns it uses from those of ``lineitem`` that they need: the wide rows are neither
    shuffled nor stored, so nothing is spilled or written that grows with them.
    """
    return widen(flows_from(spread(table(spark, sf_dir, "lineitem"))))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow table with the base columns only."""
    return flows_from(spread(table(spark, sf_dir, "lineitem"))).select(*BASE_COLUMNS)
