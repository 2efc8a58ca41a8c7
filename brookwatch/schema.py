"""Column layouts of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

SLOT_SECONDS = 300
HOUR_SECONDS = 3600
DAY_SECONDS = 86400
BACKTRACK_DAYS = 365


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "str": T.StringType(),
             "labels": T.ArrayType(T.IntegerType())}
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        out.append(T.StructField(name, kinds[kind], True))
    return out


FLOW_SCHEMA = T.StructType(_fields("""
    devid:int ident:str af:int
    first:long last:long msec_first:int msec_last:int received:long
    prot:int tos:int dst_tos:int tcp_flags:int fwd_status:int dir:int
    srcaddr:long dstaddr:long srcport:int dstport:int
    pkts:long bytes:long out_pkts:long out_bytes:long aggr_flows:long
    srcas:long dstas:long next_as:long prev_as:long
    input:long output:long src_mask:int dst_mask:int src_vlan:int dst_vlan:int
    ip_nexthop:long bgp_nexthop:long ip_router:long
    in_src_mac:long out_dst_mac:long in_dst_mac:long out_src_mac:long
    mpls:labels engine_type:int engine_id:int exporter_sysid:int
    client_latency:long server_latency:long app_latency:long
    pname:str qname:str qtype:int qclass:int
    http_url:str http_host:str http_method:str http_mime:str http_user_agent:str
    http_cookie:str http_ret_code:int
    icmp_data:str icmp_seq_num:int icmp_payload_len:long
    service_type:str service_name:str service_version:str service_time:long
    dev_type:str dev_name:str dev_vendor:str dev_model:str dev_time:long
    os_type:str os_name:str os_version:str os_time:long
    midware_type:str midware_name:str midware_version:str midware_time:long
    threat_type:str threat_name:str threat_version:str threat_time:long
"""))

EVENT_COLUMNS = ["time", "type_id", "config_id", "devid", "obj",
                 "thres_value", "alarm_value", "value_type", "model_id"]

EVENT_SCHEMA = T.StructType(_fields("""
    time:long type_id:int config_id:int devid:int obj:str
    thres_value:long alarm_value:long value_type:str model_id:int
"""))

COUNTER_COLUMNS = ["first", "last", "flows", "pkts", "bytes"]

FIVE_TUPLE = ["srcaddr", "srcport", "dstaddr", "dstport", "prot"]
