"""Streams (R): the flows read as a file stream and run to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures
from ..detectors.scans import closing_port_scans, port_scan_events
from ..rules import Rule
from ..streaming import flowstreams as st
from .detections import _SLOT_SCANS, PROTO, SIP
from .predicates import THREAT_EVENTS, threat_events
from .registry import COUNTERS, DAY_SLOTS, END, ORACLES, REQ, START, event_sql, folder, on_flows, register, with_flows


def flow_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The derived flows as a stream over the ``lineitem`` file."""
    schema = fixtures.table(spark, sf, "lineitem").schema
    return fixtures.flows_from(st.read_flow_stream(spark, sf, schema, glob="lineitem.parquet"))


def on_stream(name: str, build, select: str | None, ctes: str = "") -> None:
    register(name, lambda spark, sf: build(flow_stream(spark, sf)), None if select is None else with_flows(select, ctes))


on_stream("r1_file_stream",
          lambda s: st.run_available(s.groupBy("prot").agg(F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes")),
                                     ["prot"]),
          "SELECT prot, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows GROUP BY prot")
on_stream("r2_slot_counters",
          lambda s: st.run_available(st.slot_counters(st.event_time(s), ["srcaddr", "prot"]), ["time", "srcaddr", "prot"]),
          f"SELECT first - first % 300 AS time, srcaddr, prot, {COUNTERS} FROM flows GROUP BY first - first % 300, srcaddr, prot")


# ---- deliveries: the table arrives as several files, cut within slots ----

CUTS = (START + 28_950, START + 57_750)  # both in the middle of a slot
CLOSING = 5 * 86_400
JITTER = "CASE WHEN bytes % 50 = 0 THEN 400 ELSE 0 END"
# beyond that, some flows come in hours later
DELAY = "CASE WHEN bytes % 53 = 0 THEN 9000 WHEN bytes % 50 = 0 THEN 400 ELSE 0 END"


def deliveries(spark: SparkSession, sf: str, delay: str) -> tuple[DataFrame, list]:
    """The flows as a stream, and the steps that deliver its files: three parts by time of arrival, then a flow of a later
    day, which closes what is open."""
    path = folder(spark)
    flows = fixtures.flows(spark, sf)
    flows.limit(0).write.parquet(path)  # a stream's folder must be there
    arrived = F.col("first") + F.expr(delay)
    bounds = [None, *CUTS, None]

    def part(i: int) -> None:
        lo, hi = bounds[i], bounds[i + 1]
        late = arrived >= lo if lo else F.lit(True)
        flows.where(late if hi is None else late & (arrived < hi)).write.mode("append").parquet(path)

    def close() -> None:
        top = flows.agg(F.max("first").alias("top"))
        last = flows.join(top, flows["first"] == F.col("top")).drop("top").withColumns(
            {"first": F.col("first") + CLOSING, "last": F.col("last") + CLOSING, "prot": F.lit(6), "srcport": F.lit(1), "dstport": F.lit(1)})
        both = last.withColumn("tos", F.lit(1)).unionByName(last.withColumn("tos", F.lit(0)))
        both.write.mode("append").parquet(path)

    steps = [lambda i=i: part(i) for i in range(3)] + [close]
    return st.read_flow_stream(spark, path, flows.schema), steps


def kept_sql(due: str, where: str = "TRUE") -> str:
    """The rows that come before the watermark of their delivery, as table ``kept``, the others as ``tardy``."""
    part = f"CASE WHEN first + {DELAY} < {CUTS[0]} THEN 0 WHEN first + {DELAY} < {CUTS[1]} THEN 1 ELSE 2 END"
    return f"""arriving AS (SELECT *, {part} AS part FROM flows WHERE {where}),
      reached AS (SELECT p, (SELECT max(first) FROM arriving WHERE part < p) - 600 AS mark FROM (VALUES (0), (1), (2)) t(p)),
      judged AS (SELECT a.*, coalesce({due} <= mark, FALSE) AS late FROM arriving a JOIN reached ON part = p),
      kept AS (SELECT * EXCLUDE (part, late) FROM judged WHERE NOT late), tardy AS (SELECT * FROM judged WHERE late)"""


def _slot_detector(spark: SparkSession, sf: str) -> DataFrame:
    """Port scans of every slot, judged when the slot has closed, of flows that arrive in several runs, some too late."""
    stream, steps = deliveries(spark, sf, DELAY)
    closed = closing_port_scans(st.event_time(stream))
    return st.run_deliveries(closed, steps, lambda scans: port_scan_events(scans, [Rule(6, 2, min=2)], DAY_SLOTS))[0].where(
        F.col("time") < END)


_PROBES = f"srcport <> 0 AND dstport <> 0 AND (prot <> 6 OR {REQ})"
register("r2_slot_detector", _slot_detector, with_flows(
    f"SELECT {event_sql(f'''concat({SIP}, ':>:', dstport, ' ', {PROTO}, ' ')''', '2', 'peers', chr(39) + 'peerips' + chr(39), '0', '2', '6', 'slot')} "
    "FROM scans WHERE peers >= 2",
    f"{kept_sql('first - first % 300 + 300', _PROBES)}, {_SLOT_SCANS.replace('FROM flows', 'FROM kept')}"))
on_stream("r3_hourly_features",
          lambda s: st.run_available(st.hourly_features(st.event_time(s), ["srcaddr", "dstaddr", "prot"]),
                                     ["hour", "srcaddr", "dstaddr", "prot"]),
          f"SELECT first - first % 3600 AS hour, srcaddr, dstaddr, prot, {COUNTERS} FROM flows "
          "GROUP BY first - first % 3600, srcaddr, dstaddr, prot")
on_stream("r4_sessions",
          lambda s: st.run_available(st.sessions(st.event_time(s), ["srcaddr", "dstaddr", "prot"]), mode="complete"),
          f"""SELECT srcaddr, dstaddr, prot, {COUNTERS} FROM (SELECT *, sum(fresh) OVER (PARTITION BY srcaddr, dstaddr, prot
              ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN max(last) OVER
              (PARTITION BY srcaddr, dstaddr, prot ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3600
              >= first THEN 0 ELSE 1 END AS fresh FROM flows) a) b GROUP BY srcaddr, dstaddr, prot, island""")


def _closed_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that come out when the watermark has passed them, over several runs; their state goes with them."""
    stream, steps = deliveries(spark, sf, JITTER)
    return st.run_deliveries(st.sessions(st.event_time(stream), ["srcaddr", "dstaddr", "prot"]), steps)[0].where(F.col("first") < END)


register("r4_sessions_closed", _closed_sessions, ORACLES["r4_sessions"])


on_stream("r5_sliding_ports",
          lambda s: st.run_available(st.sliding_ports(st.event_time(s), "2 hours"), mode="append"),
          """SELECT CAST(e AS BIGINT) AS slot, prot, dstport, count(*) AS flows, CAST(sum(pkts) AS BIGINT) AS pkts,
            CAST(sum(bytes) AS BIGINT) AS bytes FROM flows, (SELECT unnest(generate_series(0, 23)) * 300 AS o) w,
            LATERAL (SELECT first - first % 300 + o AS e) x
          WHERE prot IN (6, 17) AND e + 300 <= (SELECT max(first) FROM flows WHERE prot IN (6, 17)) - 600 GROUP BY ALL""")


def _repeated_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events written twice as files and streamed through the de-duplication."""
    path = folder(spark)
    events = threat_events(fixtures.flows(spark, sf))
    both = events.unionByName(events.withColumn("alarm_value", F.col("alarm_value") + 0))
    both.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    return st.run_available(st.dedup_events(stream, events.columns), mode="append")


register("r6_event_dedup", _repeated_events, with_flows("SELECT DISTINCT * FROM threat_events", THREAT_EVENTS))


def _turned(f: DataFrame) -> DataFrame:
    """The flows answered: their ends turned round, a slot later for some."""
    return f.withColumns({"first": F.col("first") + 300 * (F.col("bytes") % 3),
                          "srcaddr": F.col("dstaddr"), "dstaddr": F.col("srcaddr"),
                          "srcport": F.col("dstport"), "dstport": F.col("srcport"), "tos": 1 - F.col("tos")})


def _slot_seconds(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.unix_seconds(c) for c in ("req_slot", "res_slot")})


def _crossing(f: DataFrame) -> DataFrame:
    """Requests paired with the flows of the same endpoints turned round, a slot later for some."""
    return _slot_seconds(st.pair_slots(f, _turned(f)))


on_flows("r7_request_pairs", _crossing,
         f"""SELECT a.*, p AS res_slot FROM (SELECT DISTINCT srcaddr AS sip, dstaddr AS dip, srcport AS sport, dstport AS dport,
             http_ret_code AS code, first - first % 300 AS req_slot FROM flows WHERE prot = 6 AND {REQ}) a LEFT JOIN
           (SELECT DISTINCT srcaddr AS sip, dstaddr AS dip, srcport AS sport, dstport AS dport, http_ret_code AS code,
             (first + 300 * (bytes % 3)) // 300 * 300 AS p FROM flows WHERE prot = 6 AND {REQ}) b
           ON a.sip = b.sip AND a.dip = b.dip AND a.sport = b.sport AND a.dport = b.dport AND a.code = b.code
             AND p >= req_slot AND p <= req_slot + 300""")


def _crossing_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same pairs from a stream joined with a stream; unanswered requests come out once their time is over."""
    stream, steps = deliveries(spark, sf, JITTER)
    return _slot_seconds(st.run_deliveries(st.pair_slots(stream, _turned(stream)), steps)[0]).where(F.col("req_slot") < END)


register("r7_stream_pairs", _crossing_stream, ORACLES["r7_request_pairs"])


def _late(f: DataFrame) -> DataFrame:
    """Counts of flows that arrive on time and late, per slot."""
    arrived = F.col("last") + F.col("bytes") % 2000
    on_time, late = st.split_late(f, arrived)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy((F.col("first") - F.col("first") % 300).alias("slot"), "late").agg(F.count(F.lit(1)).alias("flows"))


on_flows("r8_late_flows", _late,
         "SELECT first - first % 300 AS slot, last + bytes % 2000 > first - first % 300 + 900 AS late, count(*) AS flows "
         "FROM flows GROUP BY ALL")


def _late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Flows per slot, those on time as a stream without repeated deliveries keeps them and the late ones as set aside;
    ``dropped`` is the number of rows that the stream itself reports to have dropped."""
    stream, steps = deliveries(spark, sf, DELAY)
    base = folder(spark)

    def judged(steps: list) -> DataFrame:
        return st.split_arrivals(stream, steps, F.col("first"), handle=lambda rows: rows.where("late"), base=base)

    fresh, dropped = st.run_deliveries(st.drop_repeats(st.event_time(stream), ["first"]), [lambda s=s: judged([s]) for s in steps[:3]])
    aside = judged([])
    both = fresh.select("first", F.lit(False).alias("late")).unionByName(aside.select("first", "late"))
    return (both.groupBy((F.col("first") - F.col("first") % 300).alias("slot"), "late").agg(F.count(F.lit(1)).alias("flows"))
            .withColumn("dropped", F.lit(dropped).cast("bigint")))


register("r8_stream_late_flows", _late_stream, with_flows(
    """SELECT slot, late, count(*) AS flows, (SELECT count(*) FROM tardy) AS dropped FROM
         (SELECT first - first % 300 AS slot, FALSE AS late FROM (SELECT DISTINCT * FROM kept) k
          UNION ALL SELECT first - first % 300, TRUE FROM tardy) t GROUP BY slot, late""", kept_sql("first")))
