import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from brookwatch.session import local_session
    session = local_session("8", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def flows(spark):
    from brookwatch import fixtures
    return fixtures.flows(spark, SF_DIR).cache()


@pytest.fixture(scope="session")
def wide(spark):
    from brookwatch import fixtures
    # a plan of its own: else what is kept here would stand in for every later wide_flows of this folder
    return fixtures.wide_flows(spark, SF_DIR).where("true").cache()


BASE = dict(devid=1, first=1704067200, last=1704067210, msec_first=0, msec_last=0, prot=6, tos=1, tcp_flags=27,
            srcaddr=167772161, dstaddr=3232235521, srcport=40000, dstport=80, pkts=10, bytes=1000, qname="", qtype=0,
            http_url="", http_ret_code=0, icmp_data="", icmp_seq_num=0, icmp_payload_len=0, threat_type="", threat_name="")

FLOW_TYPES = ("devid int, first bigint, last bigint, msec_first int, msec_last int, prot int, tos int, tcp_flags int, "
              "srcaddr bigint, dstaddr bigint, srcport int, dstport int, pkts bigint, bytes bigint, qname string, qtype int, "
              "http_url string, http_ret_code int, icmp_data string, icmp_seq_num int, icmp_payload_len bigint, "
              "threat_type string, threat_name string")


@pytest.fixture
def make_flows(spark):
    """Frame of hand-written flows; unnamed fields take the base values."""
    def make(*rows, types=FLOW_TYPES):
        names = [f.split()[0] for f in types.split(", ")]
        return spark.createDataFrame([tuple({**BASE, **r}[n] for n in names) for r in rows], types)
    return make
