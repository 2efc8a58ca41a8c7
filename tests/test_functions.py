import ipaddress
import math
import random

import pytest
from pyspark.sql import functions as F

from brookwatch.functions import address, names, numeric, text, timefn
from brookwatch.rules import Rule


def values(spark, rows, expr, types="s string"):
    df = spark.createDataFrame([(r,) for r in rows], types)
    return [r[0] for r in df.select(expr).collect()]


def test_ipv6_text_matches_library(spark):
    rnd = random.Random(7)
    addresses = [ipaddress.IPv6Address(rnd.getrandbits(128) & rnd.getrandbits(128) & rnd.getrandbits(128)) for _ in range(60)]
    addresses += [ipaddress.IPv6Address(x << s) for x in (1, 0xFFFF) for s in range(32, 128, 16)]
    got = values(spark, [a.exploded for a in addresses], address.ipv6_norm("s"))
    assert got == [a.compressed for a in addresses]


def test_ipv6_special_forms(spark):
    cases = {"::ffff:1.2.3.4": "::ffff:1.2.3.4", "::": "::", "1::": "1::", "FE80::0:1": "fe80::1", "::0102:0304": "::1.2.3.4"}
    assert values(spark, list(cases), address.ipv6_norm("s")) == list(cases.values())


def test_address_validation(spark):
    good6 = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "2001:db8::1"]
    bad6 = ["1.2.3.4", "1:::2", "12345::", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1", "1:", ""]
    assert values(spark, good6 + bad6, address.is_ipv6_text("s")) == [True] * len(good6) + [False] * len(bad6)
    texts = ["0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "01.2.3.4"]
    assert values(spark, texts, address.is_ipv4_text("s")) == [True, True, False, False, False]


def test_cidr_bounds_keep_the_base(spark):
    df = spark.createDataFrame([("10.0.0.5/29",), ("1.2.3.4",), ("0.0.0.0/0",)], "c string")
    lo, hi = address.cidr_bounds("c")
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got == [(167772165, 167772172), (16909060, 16909060), (0, 4294967295)]


def test_entropy_counts_bytes(spark):
    def entropy(s):
        raw = s.encode()
        return -sum((n := raw.count(b)) / len(raw) * math.log2(n / len(raw)) for b in set(raw)) if raw else 0.0
    words = ["", "aaaa", "abcd", "example.com", "ünïcode", "中文域名"]
    for got, word in zip(values(spark, words, text.char_entropy("s")), words, strict=True):
        assert got == pytest.approx(entropy(word))


def test_text_transforms(spark):
    assert values(spark, ['a"b\\c\n\x01\t'], text.escape_text("s")) == ["ab\\\\c\\\\n\\\\t"]
    assert values(spark, ["a b/é~*"], text.percent_encode("s")) == ["a%20b/%C3%A9%7E*"]
    assert values(spark, ['q"\\é\n', "plain"], text.printable("s")) == ['q\\"\\\\...', "plain"]
    assert values(spark, ["ok 中", "né"], text.clean_text("s")) == ["ok 中", "abnormal character"]


def test_domain_parts(spark):
    q = ["a.b.example.com", "example.com.", "x.example.com.", "local", ""]
    assert values(spark, q, text.base_domain("s")) == ["example.com", "example.com.", "example.com.", "", ""]
    assert values(spark, q, text.sub_label("s")) == ["a", "example", "x", "", ""]
    assert values(spark, q, text.top_label("s")) == ["com", "com", "com", "", ""]


def test_encodings(spark):
    codes = values(spark, ["-z.A" + "a" * 200], text.encode_domain("s"))[0]
    assert codes[:5] == [2, 40, 4, 1, 15] and len(codes) == 128 and codes[-1] == 15
    url = values(spark, ["0aA!,;~:"], text.encode_url("s"))[0]
    assert url[:9] == [2, 12, 38, 64, 75, 80, 95, 1, 0] and len(url) == 256


def test_name_tables(spark):
    assert len(names.PROTOCOLS) == 133
    assert values(spark, [0, 6, 132, 133, 255], names.proto_name("s"), "s int") == ["HOPOPT", "TCP", "SCTP", "PROTO_133", "PROTO_255"]
    assert values(spark, [1, 32769, 7], names.qtype_name("s"), "s int") == ["A", "DLV", "QTYPE_7"]
    assert values(spark, [6, 17], names.proto_is("UDP", "s"), "s int") == [False, True]


def test_scaled_numbers(spark):
    n = [999999, 1000000, 1234567890, 2 * 10**12]
    assert values(spark, n, numeric.scale_number("s"), "s bigint") == ["999999", "1.0 M", "1.2 G", "2.0 T"]


def test_windows():
    assert timefn.parse_window("2024") == (1704067200, None, 0)  # a single date has no end
    assert timefn.parse_window("2024/02-2024/02/29.13:05") == (1706745600, 1709211900, 0)  # ends with a first second
    assert timefn.parse_window("-7200") == (None, None, -7200)
    with pytest.raises(ValueError):
        timefn.parse_window("24/1")


def test_align_range():
    assert timefn.align_range(1234, 2000, 100) == (1200, 1800, 300)
    assert timefn.align_range(0, 10**9, 1000, latest=10**8 + 7) == (10**8 - 10**8 % 300 - 365 * 86400, 10**8 - 10**8 % 300, 900)


def test_schedule(spark):
    monday = 1704067200  # 2024-01-01 00:00 UTC
    at = [monday + 9 * 3600, monday + 9 * 3600 + 1800, monday + 8 * 3600, monday + 86400 + 9 * 3600 + 900]
    rule = Rule(1, weekday=(1,), stime=(9, 0, 0), etime=(9, 20, 0))
    assert values(spark, at, timefn.schedule_ok("s", rule), "s bigint") == [True, False, False, False]
    without = Rule(1, weekday=(1,), stime=(9, 0, 0), etime=(9, 20, 0), coverrange="WITHOUT")
    assert values(spark, at, timefn.schedule_ok("s", without), "s bigint") == [False, True, True, True]
    # 01:00 UTC is 09:00 in the east
    assert values(spark, [monday + 3600], timefn.schedule_ok("s", rule, "Asia/Shanghai"), "s bigint") == [True]


def test_sampling(spark, wide):
    one = wide.limit(5).withColumn("exporter_sysid", F.lit(9))
    s = spark.createDataFrame([(9, 50)], "exporter_sysid int, interval int")
    a = one.agg(F.sum("bytes"), F.sum("aggr_flows")).first()
    b = numeric.apply_sampling(one, s).agg(F.sum("bytes"), F.sum("aggr_flows")).first()
    assert (b[0], b[1]) == (a[0] * 50, a[1])
