"""Work that must not grow faster than its input: same rows as the plain way, and what the plans must not hold."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brookwatch import fixtures
from brookwatch.catalog import QUERIES
from brookwatch.detectors.base import counters, recount
from brookwatch.detectors.web import factors, matched_urls
from brookwatch.operators import joins
from brookwatch.rules import Rule, read_objects
from brookwatch.session import shared_dir
from brookwatch.sources import textflows

from .conftest import SF_DIR


def test_flows_are_derived_as_they_are_read(spark, capsys):
    for source in (fixtures.wide_flows, fixtures.flows):
        flows = source(spark, SF_DIR)
        assert [f.rsplit("/", 1)[-1] for f in flows.inputFiles()] == ["lineitem.parquet"]
    flows.select(F.sum("bytes")).explain()
    assert "l_extendedprice" in (plan := capsys.readouterr().out) and "l_orderkey" not in plan


def test_one_file_of_many_splits_is_left_alone(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        table = fixtures.table(spark, SF_DIR, "lineitem")
        assert fixtures.spread(table) is table
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pipe_lines_are_split_once(spark, make_flows, capsys):
    lines = textflows.pipe_lines(make_flows({}))
    textflows.parse_pipe(lines).explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_pipe_texts_are_compressed_files_of_bounded_length(spark, make_flows, tmp_path, monkeypatch):
    monkeypatch.setattr(textflows, "FILE_LINES", 100)
    path = tmp_path / "pipe"
    flows = make_flows(*[dict(bytes=i, qname=f"n{i}", threat_type=None if i % 2 else "") for i in range(250)]).coalesce(1)
    textflows.write_pipe(flows, str(path))
    lines, files = textflows.pipe_lines(flows), list(path.glob("part-*"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < sum(len(r.value) for r in lines.collect()) / 4
    assert sorted(spark.read.text(str(path)).collect()) == sorted(lines.collect())
    assert sorted(r.bytes for r in textflows.read_pipe_flows(spark, str(path)).collect()) == list(range(250))
    textflows.write_pipe(flows, str(tmp_path / "plain"), compression="none")
    assert next((tmp_path / "plain").glob("part-*")).read_text().startswith("2|1704067200|")


def test_broken_pipe_lines_are_written_compressed(spark):
    before = set(Path(shared_dir(spark)).glob("out-*"))
    got = {r.reason: r.n for r in QUERIES["s6_refused_lines"](spark, SF_DIR).collect()}
    files = [f for folder in set(Path(shared_dir(spark)).glob("out-*")) - before for f in folder.glob("part-*")]
    assert len({f.parent for f in files}) == 2 and all(f.suffix == ".gz" for f in files)
    assert set(got) == {"", "64 fields", "af is no number"} and sum(got.values()) == fixtures.table(spark, SF_DIR, "lineitem").count()


def test_csv_texts_are_compressed_files_of_bounded_length(spark, make_flows, tmp_path, monkeypatch):
    monkeypatch.setattr(textflows, "FILE_LINES", 100)
    path = tmp_path / "csv"
    flows = make_flows(*[dict(bytes=i, srcport=i % 7, dstaddr=None if i == 9 else 3232235521) for i in range(250)]).coalesce(1)
    textflows.to_csv(flows, str(path))
    lines = sum(len(",".join(v or "" for v in r)) for r in textflows.csv_frame(flows).collect())
    files = list(path.glob("part-*"))
    assert len(files) == 3 and sum(f.stat().st_size for f in files) < lines / 4
    back = textflows.read_flow_csv(spark, str(path)).select("first", "srcaddr", "srcport", "bytes").collect()
    assert sorted(map(tuple, back)) == sorted((1704067200, 167772161, i % 7, i) for i in range(250))
    textflows.to_csv(flows, str(tmp_path / "plain"), compression="none")
    assert next((tmp_path / "plain").glob("part-*")).read_text().startswith("ts,te,td,")


def test_csv_of_both_families_is_written_compressed(spark):
    before = set(Path(shared_dir(spark)).glob("out-*"))
    got = QUERIES["s9_csv_both_families"](spark, SF_DIR).groupBy(F.instr("srcaddr", ":") > 0).count().collect()
    files = [f for folder in set(Path(shared_dir(spark)).glob("out-*")) - before for f in folder.glob("part-*")]
    assert files and all(f.name.endswith(".csv.gz") for f in files)
    assert len(got) == 2 and sum(r["count"] for r in got) == fixtures.table(spark, SF_DIR, "lineitem").count()


@pytest.mark.parametrize("pattern, texts", [
    ("(.p.37/index.html)", ["37/index", "html"]), (".*[/]12[?]id=1 union sel+ect", ["/12?id=1 union sel"]), ("a(bcde)?fghi", ["fghi"]),
    ("((abcd)+efgh)ijkl", ["efgh", "ijkl"]), ("(abcd|efgh)(ijkl)", ["ijkl"]), ("[^]abcd]wxyz", ["wxyz"]), ("[?]*abcd", ["abcd"]), ("(abcd", [])])
def test_plain_texts_of_a_pattern(pattern, texts):
    assert factors(pattern) == texts


def test_urls_of_many_patterns(spark):
    urls = ["/p/12/admin", "/p/123/admin", "/p/12?id=1 union select", "zwxyz", "awxyz", "/a", "/p/3/index.html"]
    rules = [Rule(1, pat="/p/12(/admin|[?]id=1.*)"), Rule(2, pat=".*[/]12[?]id=1 union sel+ect"), Rule(3, pat="[^]abcd]wxyz"),
             Rule(4, pat="(.p.3/index.html)"), Rule(6, pat="(.p.3/index.html)"), Rule(5, pat="/."), Rule(7, pat="/p/999/admin")]
    df = spark.createDataFrame([(u,) for u in urls], "http_url string")
    want = {"/p/12/admin": 1, "/p/12?id=1 union select": 2, "zwxyz": 3, "/p/3/index.html": 6, "/a": 5}
    table = spark.createDataFrame([(r.config_id, r.pat) for r in rules], "config_id int, pat string")
    for given in (rules, table):
        assert {r.http_url: r.rule.config_id for r in matched_urls(df, given).collect()} == want


@pytest.mark.parametrize("texts", [False, True])
def test_objects_as_a_table(spark, make_flows, texts):
    rnd = random.Random(7)
    rows = [dict(srcaddr=rnd.choice([167772160 + rnd.randrange(8), None]), dstaddr=3232235520 + rnd.randrange(8), bytes=rnd.randrange(99),
                 srcport=rnd.choice([80, 443, 5000]), dstport=rnd.choice([79, 80, 81, None]), prot=rnd.choice([6, 17])) for _ in range(40)]
    flows = make_flows(*rows)
    flows = flows.coalesce(1)
    if texts:
        flows = flows.withColumns({"srcaddr": F.concat(F.lit("2001:db8::"), (F.col("srcaddr") % 8).cast("string")),
                                   "dstaddr": F.concat(F.lit("192.168.0."), (F.col("dstaddr") % 8).cast("string"))})
    nets = ["", "10.0.0.0/30", "10.0.0.5", "!10.0.0.0/29", "192.168.0.0/24", "!192.168.0.3", "192.168.0.4/31", "2001:db8::/126", "!2001:db8::3"]
    ports, ways = ["", "80", "<80", "!443", ">80"], ["IN", "OUT", "ALL"]
    table = spark.createDataFrame([(i // 2, rnd.choice(nets), rnd.choice(ports), rnd.choice(["", "TCP"]), rnd.choice(nets[:1] * 5 + nets),
                                    rnd.choice(ports[:1] * 3 + ports), rnd.choice(ways)) for i in range(40)] + [(None,) + ("",) * 5 + ("IN",)],
                                  "id int, moip string, moport string, protocol string, pip string, pport string, direction string").coalesce(1).cache()

    def counted(f, objects, measures):
        return sorted(map(tuple, joins.match_mo(f, objects).groupBy("moid", "direction").agg(*measures).collect()))

    want = counted(flows, read_objects(table.where("id IS NOT NULL")), counters())
    assert want and counted(flows, table, counters()) == want
    alike = joins.combine_for(flows, table).cache()
    assert counted(alike, table, recount()) == want and alike.count() < flows.count()
