"""Feature, event, request and retention queries (F, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures
from ..detectors.base import counters
from ..functions.address import shr
from ..functions.predicates import w_net, w_port
from ..functions.timefn import slot, truncate
from ..operators import joins
from ..operators.aggregate import distinct_peers, peer_features
from ..plans import job
from ..plans import lifecycle as lc
from ..plans import requests as rq
from ..plans.anonymize import anonymize
from ..plans.run import Config, all_events, run_detectors
from ..rules import Rule, Window
from . import detections as dt
from .detections import D5_RULES, D9_RULES, D15_RULES, DIP, PATTERNS, SIP, mining_domains, mining_ips, white_sub
from .lookups import CLASS_RULES, IPS_CTE, MOS, assets, domain_intel, ip_list, service_ctes
from .predicates import THREAT_EVENTS, threat_events
from .ranking import _ISLANDS, _PAIRS, _pairs, _topn_sql
from .registry import COUNTERS, DAY, DOMAIN, END, ORACLES, PROTO, RECOUNT, REQ, START, folder, on_flows, register

_KEY = ["srcaddr", "dstaddr", "prot"]


def slot_features(f: DataFrame) -> DataFrame:
    """Per-slot rows of a pair, as one detector run writes them."""
    per = f.groupBy(slot().alias("slot"), *_KEY).agg(*counters(), F.count_distinct("dstport").alias("peers"))
    return per.withColumn("hour", truncate("slot", 3600)).drop("slot")


_SLOTS = (f"slots AS (SELECT first - first % 300 AS slot, srcaddr, dstaddr, prot, {COUNTERS}, count(DISTINCT dstport) AS peers "
          "FROM flows GROUP BY first - first % 300, srcaddr, dstaddr, prot)")
_PEERS = f"{RECOUNT}, CAST(sum(peers) AS BIGINT) AS peers"


def _merged(f: DataFrame) -> DataFrame:
    feats = slot_features(f)
    return lc.merge_features(feats.where(F.col("first") % 600 < 300), feats.where(F.col("first") % 600 >= 300), _KEY)


_HOURS_SQL = f"SELECT srcaddr, dstaddr, prot, {_PEERS}, slot - slot % 3600 AS hour FROM slots GROUP BY srcaddr, dstaddr, prot, slot - slot % 3600"
on_flows("f1_merge_features", _merged, _HOURS_SQL, _SLOTS)
on_flows("f2_query_features_gaps",
         lambda f: (lc.query_features(_pairs(f).withColumn("hour", truncate("slot", 3600)).drop("slot"), "ip_scan", _KEY,
                                      START, END, proto=6, flows=1).drop("duration")),
         f"SELECT srcaddr, dstaddr, prot, {RECOUNT} FROM islands WHERE prot = 6 GROUP BY srcaddr, dstaddr, prot, island",
         f"{_PAIRS}, {_ISLANDS}")
on_flows("f2_query_features_all",
         lambda f: lc.query_features(f.where(F.col("qname") != "").groupBy(truncate("first", 3600).alias("hour"), "srcaddr",
                                     "dstaddr", "qname", "qtype").agg(*counters()), "dns",
                                     ["srcaddr", "dstaddr", "qname", "qtype"], START + 3600, START + 40000, qname="alpha"),
         f"""SELECT srcaddr, dstaddr, qname, qtype, {RECOUNT}, max(last) - min(first) AS duration FROM
         (SELECT first - first % 3600 AS hour, srcaddr, dstaddr, qname, qtype, {COUNTERS} FROM flows WHERE qname <> ''
            GROUP BY first - first % 3600, srcaddr, dstaddr, qname, qtype) h
         WHERE hour >= {START + 3600} AND hour <= {START + 40000} AND last >= {START + 3600} AND first <= {START + 40000}
           AND contains(qname, 'alpha') GROUP BY srcaddr, dstaddr, qname, qtype""")
on_flows("f3_feature_size", lambda f: lc.feature_size(lc.merge_features(None, slot_features(f), _KEY), START, START + 36000),
         f"SELECT hour, count(*) AS rows FROM ({_HOURS_SQL}) h WHERE hour <= {START + 36000} GROUP BY hour", _SLOTS)


def config(f: DataFrame) -> Config:
    """Every detector with a rule or two."""
    rules = {
        "port_scan": [Rule(1, 2, min=12)], "ip_scan": [Rule(2, 8, min=5)], "dns": [Rule(3, 4, qcount=1)],
        "dnstunnel": D5_RULES, "dga": [Rule(5, 12, min=80)], "dnstunnel_scored": [Rule(6, 14, min=95)], "ip_set": D15_RULES,
        "bw": [Rule(8, 5, min=1, data_type="bps")], "url_content": [Rule(9, 9, sub_type=1, pat=r".*union\s+select.*")],
        "malicious_url": [Rule(10, 16, min=60)], "icmptunnel": [Rule(11, 11, if1=2, if2=3, if3=20)],
        "threshold": [Rule(12, 1, min=1, moid=1, data_type="Bps")], "frn_trip": D9_RULES, "threat": [Rule(14, 13)],
        "mining": [Rule(15, 15)], "assetsrv": [Rule(16, 3, min=30)]}
    tables = {"assets": assets(f), "domain_intel": domain_intel(f), "white_domains": white_sub(f), "suspicious": ip_list(f),
              "black": ip_list(f), "mining_domains": mining_domains(f), "mining_ips": mining_ips(f)}
    return Config(rules, PATTERNS, MOS, tables)


def _run_all(f: DataFrame) -> DataFrame:
    events = all_events(run_detectors(f, config(f), DAY))
    return events.groupBy("type_id").agg(F.count(F.lit(1)).alias("events"), F.sum("alarm_value").alias("alarms"))


# the parts are compared one by one by the detector queries
on_flows("e1_run_detectors", _run_all, None)

# Detectors of the job with the rules of their own queries; their events are those queries' rows.
JOB_PARTS = {"port_scan": "d1_port_scan", "ip_scan": "d2_ip_scan", "dns": "d3_dns_intel", "dnstunnel": "d5_dns_tunnel",
             "dnstunnel_scored": "d6_dns_tunnel_scored", "icmptunnel": "d7_icmp_tunnel", "url_content": "d8_url_attacks",
             "frn_trip": "d9_outreach", "mining": "d10_mining", "threat": "d11_threats", "assetsrv": "d13_asset_events",
             "ip_set": "d15_suspicious", "malicious_url": "d19_malicious_url"}


def job_config(f: DataFrame) -> Config:
    rules = {"port_scan": dt.D1_RULES, "ip_scan": CLASS_RULES, "dns": dt.D3_RULES, "dnstunnel": D5_RULES, "dnstunnel_scored": dt.D6_RULES,
             "icmptunnel": dt.D7_RULES, "url_content": dt.D8_RULES, "frn_trip": D9_RULES, "malicious_url": dt.D19_RULES,
             "mining": [Rule(5, 15, qcount=2, data_type="mining")], "threat": [Rule(1, 13), Rule(4, 13, weekday=(2, 3))],
             "assetsrv": dt.D13_RULES, "ip_set": D15_RULES}
    tables = {"assets": assets(f), "domain_intel": domain_intel(f), "white_domains": white_sub(f), "suspicious": ip_list(f),
              "popular": ip_list(f), "white": ip_list(f).where("class = 'c2'"), "mining_domains": mining_domains(f),
              "mining_ips": mining_ips(f)}
    return Config(rules, PATTERNS, MOS, tables)


def _job_events(f: DataFrame) -> DataFrame:
    """Events that the job has written for the day, after the day was run twice."""
    out = folder(f)
    for _ in range(2):
        job.run_slot(f, job_config(f), DAY, out, parts=["events"], only=list(JOB_PARTS))
    return job.read_events(f.sparkSession, out, now=END)


on_flows("e1_run_job", _job_events, None)
ORACLES["e1_run_job"] = " UNION BY NAME ".join(f"SELECT * FROM ({ORACLES[q]}) p{i}" for i, q in enumerate(JOB_PARTS.values()))


def _hours_as_slots(f: DataFrame, kind: str, parts: list[str]) -> str:
    """The folder of a job that ran two halves of the day, the second one twice."""
    out = folder(f)
    halves = [Window(START, START + 43_200), Window(START + 43_200, END)]
    for window in (halves[0], halves[1], halves[1]):
        job.run_slot(f, job_config(f), window, out, parts=parts, only=[kind])
    return out


def _requested_features(f: DataFrame) -> DataFrame:
    out = _hours_as_slots(f, "dns", ["features"])
    return job.request_features(f.sparkSession, out, "dns", START + 3600, START + 60000, qname="alpha").drop("class")


on_flows("f2_request_features", _requested_features,
         f"""SELECT devid, srcaddr, dstaddr, qname, qtype, {RECOUNT}, max(last) - min(first) AS duration FROM
         (SELECT min(first) - min(first) % 3600 AS hour, devid, srcaddr, dstaddr, qname, qtype, {COUNTERS} FROM flows WHERE {REQ} AND qname <> '' AND {DOMAIN}
            GROUP BY devid, srcaddr, dstaddr, qname, qtype, first < {START + 43200}) h
         WHERE hour >= {START + 3600} AND hour <= {START + 60000} AND last >= {START + 3600} AND first <= {START + 60000}
           AND contains(qname, 'alpha') GROUP BY devid, srcaddr, dstaddr, qname, qtype""")


def _requested_services(f: DataFrame) -> DataFrame:
    """Answering sides of the services, by their mark."""
    out = _hours_as_slots(f, "service", ["features"])
    return job.request_features(f.sparkSession, out, "service", START, END, srv_mark=1, proto=6).groupBy("addr", "port").agg(
        F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"))


def _halves_sql() -> str:
    parts = []
    for i, where in enumerate((f"first < {START + 43200}", f"first >= {START + 43200}")):
        names = service_ctes(where).replace("app <> ''", "'' <> ''").replace("'|', app", "'|', ''")
        parts.append(f"SELECT * FROM (WITH {names} SELECT devid, addr, port, prot, flows, bytes FROM servers) s{i} "
                     "WHERE prot = 6 AND flows >= 20")
    return " UNION ALL ".join(parts)


on_flows("w41_service_mark", _requested_services,
         f"SELECT addr, port, CAST(sum(flows) AS BIGINT) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({_halves_sql()}) h GROUP BY addr, port")


def _requested_evidence(f: DataFrame) -> DataFrame:
    out = _hours_as_slots(f, "threat", ["details"])
    return job.request_evidence(f.sparkSession, out, "threat", START, END, type_id=13).select(
        "time", "obj", "srcaddr", "srcport", "dstaddr", "dstport", "prot", "first", "last", "flows", "pkts", "bytes")


_THREAT_OBJ = f"concat(CASE WHEN lower(threat_type) = 'mining' THEN {DIP} ELSE {SIP} END, ':>', CASE WHEN lower(threat_type) = 'mining' THEN {SIP} ELSE {DIP} END, ':', dstport, ' ', {PROTO}, ' ', lower(threat_type), ' ', lower(threat_name))"
on_flows("e5_request_evidence", _requested_evidence,
         f"""SELECT CAST({START} + CASE WHEN first >= {START + 43200} THEN 43200 ELSE 0 END AS BIGINT) AS time, {_THREAT_OBJ} AS obj, srcaddr, srcport,
           dstaddr, dstport, prot, {COUNTERS} FROM flows WHERE threat_type <> '' AND {REQ}
         GROUP BY 1, 2, srcaddr, srcport, dstaddr, dstport, prot""")
on_flows("e2_query_events", lambda f: lc.query_events(threat_events(f), START, START + 43200, 13, [7]),
         f"SELECT * FROM threat_events WHERE time >= {START} AND time < {START + 43200} AND config_id = 7", THREAT_EVENTS)


def _upserted(f: DataFrame) -> DataFrame:
    events = threat_events(f)
    old = events.where(F.col("time") < START + 50000)
    return lc.upsert_events(old, events.where(F.col("time") >= START + 40000), START + 86400, ttl=70000)


on_flows("e3_upsert_events", _upserted, f"SELECT DISTINCT * FROM threat_events WHERE time >= {START + 16400}", THREAT_EVENTS)
on_flows("e4_expire_events", lambda f: lc.expire_events(threat_events(f), START + 86400, ttl=3600),
         f"SELECT * FROM threat_events WHERE time >= {START + 82800}", THREAT_EVENTS)


def _obj_details(f: DataFrame) -> DataFrame:
    from ..detectors import detect_dns_tunnel
    from .registry import DAY as day
    det = detect_dns_tunnel(f, D5_RULES[:1], white_sub(f), day)
    return lc.query_event_details(det.details, START, END, type_id=7).groupBy("obj").agg(
        F.count(F.lit(1)).alias("n"), F.sum("flows").alias("flows"))


def _tunnel_sql() -> str:
    from .detections import _D5, _D5_OBJ
    return _D5, f"SELECT {_D5_OBJ} AS obj, flows AS n, flows FROM tunnels WHERE above_3 > 2"


on_flows("e5_event_details", _obj_details, _tunnel_sql()[1], _tunnel_sql()[0])

_REQUESTS = [rq.TopnRequest("IP", "Bytes", "src", 3600, 5), rq.TopnRequest("ALL", step=300, proto=17),
             rq.TopnRequest("PORT", "Flows", "dst", 3600, 3, ip="192.168.0.3"),
             rq.TopnRequest("CONV", "Packets", step=7200, limit=4, include=("black",), exclude=("web",))]


def _labels(f: DataFrame) -> tuple[DataFrame, dict]:
    tagged = joins.tag_list(f, ip_list(f), "blacklist")
    return tagged, {"black": F.col("blacklist") > 0, "web": w_port(80) & w_net("192.168/16")}


def _cache(f: DataFrame) -> DataFrame:
    tagged, labels = _labels(f)
    return rq.build_topn_cache(tagged, _REQUESTS, labels).select("request", "time", "type", "sip", "dport", "protocol",
                                                                "flows", "pkts", "bytes")


def _cache_sql() -> str:
    parts = [
        ("flows", 3600, "bytes", 5, [("SIP", "value", {"sip": "value"}, "(SELECT srcaddr AS value, * FROM {s}) v")]),
        ("(SELECT * FROM flows WHERE prot = 17)", 300, "bytes", 1, []),
        ("(SELECT * FROM flows WHERE 3232235523 IN (srcaddr, dstaddr))", 3600, "flows", 3,
         [("DPORT", "value, prot", {"dport": "value", "protocol": "prot"}, "(SELECT dstport AS value, * FROM {s}) v")]),
        ("(SELECT * FROM flows WHERE (srcaddr IN (SELECT ip FROM ips) OR dstaddr IN (SELECT ip FROM ips)) "
         "AND NOT 80 IN (srcport, dstport))", 7200, "pkts", 4,
         [("CONV", "srcaddr, srcport, dstaddr, dstport, prot",
           {"sip": "srcaddr", "sport": "srcport", "dip": "dstaddr", "dport": "dstport", "protocol": "prot"}, "{s}")]),
    ]
    out = []
    for i, (source, step, metric, limit, ranked) in enumerate(parts):
        ranked = [(k, cols, names, src.format(s=f"r{i}")) for k, cols, names, src in ranked]
        sql = _topn_sql(step, metric, limit, ranked).replace("FROM flows GROUP BY ALL", f"FROM r{i} GROUP BY ALL")
        out.append(f"SELECT '{_REQUESTS[i].key()}' AS request, time, type, sip, dport, protocol, flows, pkts, bytes FROM "
                   f"(WITH r{i} AS (SELECT * FROM {source} q) {sql}) u{i}")
    return " UNION ALL ".join(out)


on_flows("e6_topn_cache", _cache, _cache_sql(), IPS_CTE)


def _request_log(spark, sf: str) -> DataFrame:
    ev = fixtures.table(spark, sf, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    log = ev.select(F.col("event_type").alias("request"), (at - at % 3600).alias("slot"),
                    (at - at % 60).alias("at"))
    return rq.log_requests(log)


register("e7_request_log", _request_log,
         """SELECT request, slot, count(DISTINCT t) AS count, max(t) AS latest FROM (SELECT event_type AS request,
           epoch_us(ts) // 1000000 // 3600 * 3600 AS slot, epoch_us(ts) // 1000000 // 60 * 60 AS t FROM events) e GROUP BY ALL""")

_SCOPES = ("scoped AS (SELECT concat('dev:', devid) AS name, * FROM flows UNION ALL SELECT concat('dev:', devid, '|if:', input, ' in'), * "
           "FROM flows UNION ALL SELECT concat('dev:', devid, '|if:', output, ' out'), * FROM flows)")
on_flows("e8_baselines", lc.baselines,
         """SELECT name, interval, intervals, unit, CASE unit WHEN 'bps' THEN bytes * 8 WHEN 'pps' THEN pkts ELSE flows END
           // (intervals * interval) AS value FROM (SELECT name, i AS interval, count(DISTINCT first - first % i) AS intervals,
             count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes
             FROM scoped, (VALUES (300), (3600), (86400)) t(i) GROUP BY name, i) s, (VALUES ('bps'), ('pps'), ('fps')) u(unit)""",
         _SCOPES, wide=True)


def _sizes(f: DataFrame) -> DataFrame:
    return f.groupBy(slot().alias("slot")).agg(F.sum("bytes").alias("bytes"))


_SIZE_CTE = ("sizes AS (SELECT first - first % 300 AS slot, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY ALL), "
             "kept AS (SELECT *, sum(bytes) OVER (ORDER BY slot DESC) AS held FROM sizes)")
on_flows("e9_retention_by_size", lambda f: lc.retention_plan(_sizes(f), END, max_size=200_000_000, low_water=90),
         "SELECT slot, bytes, 'size' AS reason FROM kept WHERE (SELECT sum(bytes) FROM sizes) >= 200000000 AND held > 180000000",
         _SIZE_CTE)
on_flows("e9_retention_by_age", lambda f: lc.retention_plan(_sizes(f), END, max_life=36000),
         f"SELECT slot, bytes, 'age' AS reason FROM kept WHERE slot < {END} - 34200", _SIZE_CTE)

_ANON_KEY = bytes(range(1, 33))


def _anonymous(f: DataFrame) -> DataFrame:
    return anonymize(f.select("srcaddr", "dstaddr", "prot", "bytes"), _ANON_KEY).groupBy("srcaddr", "dstaddr", "prot").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"))


# the block cipher is not available in the other engine; tests compare with published vectors
on_flows("e10_anonymize", _anonymous, None)

_ADDRESSES = ["srcaddr", "dstaddr", "ip_nexthop", "bgp_nexthop", "ip_router"]


def _anonymous_prefixes(f: DataFrame) -> DataFrame:
    """Distinct prefixes of every length among all anonymous addresses: as many as among the original ones."""
    every = anonymize(f.select(*_ADDRESSES), _ANON_KEY).select(F.explode(F.array(*_ADDRESSES)).alias("a")).distinct()
    cut = every.withColumn("bits", F.explode(F.sequence(F.lit(1), F.lit(32))))
    return cut.groupBy("bits").agg(F.count_distinct(shr("a", F.lit(32) - F.col("bits"))).alias("prefixes"))


on_flows("e10_prefix_property", _anonymous_prefixes,
         """SELECT CAST(b AS INTEGER) AS bits, count(DISTINCT a >> CAST(32 - b AS BIGINT)) AS prefixes FROM
           (SELECT DISTINCT unnest([srcaddr, dstaddr, ip_nexthop, bgp_nexthop, ip_router]) AS a FROM flows) d, generate_series(1, 32) s(b)
         GROUP BY b""", wide=True)


def _anonymous_counters(f: DataFrame) -> DataFrame:
    """Counters of the flows with the same five addresses, without them: those of the original flows, AS numbers zeroed."""
    numbers = ["srcas", "dstas", "next_as", "prev_as"]
    hidden = anonymize(f.select(*_ADDRESSES, *numbers, "prot", "first", "last", "pkts", "bytes"), _ANON_KEY)
    return hidden.groupBy(*_ADDRESSES, "prot").agg(*counters(), *[F.sum(c).alias(c) for c in numbers]).drop(*_ADDRESSES)


on_flows("e10_pair_counters", _anonymous_counters,
         f"SELECT prot, {COUNTERS}, CAST(0 AS BIGINT) AS srcas, CAST(0 AS BIGINT) AS dstas, CAST(0 AS BIGINT) AS next_as, "
         f"CAST(0 AS BIGINT) AS prev_as FROM flows GROUP BY {', '.join(_ADDRESSES)}, prot", wide=True)


def _sketched_peers(f: DataFrame) -> DataFrame:
    """Hourly features merged from slots: the distinct ports of a source within 5 % of their exact number."""
    per = peer_features(f.withColumn("slot", slot()), ["slot", "srcaddr", "prot"], "dstport").withColumn("hour", truncate("slot", 3600))
    hours = lc.merge_features(None, per.drop("slot"), ["srcaddr", "prot"])
    exact = f.groupBy("srcaddr", "prot", truncate("first", 3600).alias("hour")).agg(F.count_distinct("dstport").alias("ports"))
    close = F.abs(distinct_peers() - F.col("ports")) <= F.col("ports") * 0.05
    return hours.join(exact, ["srcaddr", "prot", "hour"]).select("srcaddr", "prot", "hour", "flows", "peers", "ports", close.alias("close"))


on_flows("f1_peer_sketches", _sketched_peers,
         """SELECT srcaddr, prot, hour, CAST(sum(flows) AS BIGINT) AS flows, CAST(sum(peers) AS BIGINT) AS peers,
           (SELECT count(DISTINCT dstport) FROM flows x WHERE x.srcaddr = s.srcaddr AND x.prot = s.prot AND x.first - x.first % 3600 = s.hour)
             AS ports, TRUE AS close
         FROM (SELECT srcaddr, prot, first - first % 3600 AS hour, first - first % 300 AS slot, count(*) AS flows,
             count(DISTINCT dstport) AS peers FROM flows GROUP BY srcaddr, prot, first - first % 3600, first - first % 300) s
         GROUP BY srcaddr, prot, hour""")
