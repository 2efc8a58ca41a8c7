"""The pipeline against its operators' single-machine forms, and the registered SQL."""

import hashlib

import duckdb
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from brookwatch.llm import secrets, tiling, toxicity
from brookwatch.llm.queries import ORACLES, QUERIES

from .test_corpus_operators import SF, brute_groups


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if scores[r["doc_id"]] < 0.5}
    groups = brute_groups(list(texts.items()), 5, 80)
    texts = {k: t for k, t in texts.items() if groups[k][2]}
    items = [tiling.tokens(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = tiling.tokens(text)
        return any(sum(n for *_, n in tiling.Tiling(i, [words], 5).mark()) >= 0.5 * len(i) for i in items
                   if len(set(i) & set(words)) >= 0.3 * len(set(i)))
    texts = {k: t for k, t in texts.items() if not leaks(t)}
    texts = {k: secrets.mask(t, secrets.scan(t)[1]) for k, t in texts.items()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    ranks = corpus_pipeline.bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks={t: i for i, t in enumerate(ranks)})
    for k, t in texts.items():
        assert got[k]["ids"] == known.encode_ordinary(t)
        assert got[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_columns_nulls_and_clean_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "clean words only here", "en", "s", 21),
            (4, "token = abcdefgh12345", "en", "s", 21), (None, "no id at all", None, "s", 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    assert got == {1: (None, None), 2: ("", 0), 3: ("clean words only here", 21), 4: ("[secret]", 8), None: ("no id at all", 12)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    known = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).select(*known.columns).toPandas()
    order = list(known.columns[:3])
    for a, b in zip(got.sort_values(order).itertuples(index=False), known.sort_values(order).itertuples(index=False), strict=True):
        assert [None if x != x else x for x in a] == [None if x is None or str(x) == "<NA>" else x for x in b]


def test_every_operator_is_registered():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names
