"""Headline queries at one scale, as one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

QUERIES = """t2_top_srcip t6_topn_conv a1_five_tuple a5_bidirectional j12_best_rule v2_gap_merge
d1_port_scan d2_ip_scan d3_dns_intel d4_dga d5_dns_tunnel d6_dns_tunnel_scored d7_icmp_tunnel d8_url_attacks
d9_outreach d10_mining d11_threats d12_services d13_asset_events d14_tcp_init d15_suspicious d16_black_list
d17_object_thresholds d18_object_traffic""".split()


def main() -> None:
    from brookwatch.catalog import QUERIES as registered
    from brookwatch.fixtures import wide_flows
    from brookwatch.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # a first read of the flow table, which every query derives as it reads it; its time is reported by itself
    start = time.perf_counter()
    wide_flows(spark, sf_dir).count()
    load = round(time.perf_counter() - start, 3)
    times = {}
    for name in QUERIES:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "load_sec": load, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
