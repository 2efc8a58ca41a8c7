"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from . import (bottomk, bpe, hard_negatives, iblt, lang_id, license_scan, rlz, secrets, simhash, spelling, tiling, toxicity,
               warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf: build(tune(spark), sf)
        if sql:
            ORACLES[name] = sql
        return build
    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every page, by a text model of the documents and what pages, hosts and addresses add."""
    return lang_id.identify(table(spark, sf, "pages"), lang_id.train(table(spark, sf, "documents")))


BASE32 = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"


@query("op2_warc", f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
    n AS (SELECT page_id, octet_length(payload) AS bytes, hex, CAST(unhex(hex) AS BIT)::VARCHAR AS bits,
                 min(page_id) OVER (PARTITION BY payload) AS first FROM p)
    SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr({BASE32}, 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER)
               + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER)
               + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '')
               AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
    FROM n""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """A record per page, written and read back, with its digests verified."""
    return warc.warc_round_trip(table(spark, sf, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_license_scan")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """License notices of every document."""
    return license_scan.find_licenses(table(spark, sf, "documents"))


@query("op4_substring_dedup", """
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    v AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50) q),
    f AS (SELECT win, min(doc_id) AS first FROM v GROUP BY win HAVING min(doc_id) < max(doc_id)),
    c AS (SELECT DISTINCT v.doc_id, i + unnest(range(0, 50)) AS i FROM v JOIN f USING (win) WHERE v.doc_id > first),
    k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept, count(*) AS n
          FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) w
          ANTI JOIN c ON w.doc_id = c.doc_id AND w.i = c.i GROUP BY w.doc_id)
    SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Words under windows that an earlier document holds are removed."""
    return rlz.remove_repeats(table(spark, sf, "documents"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_minhash_dedup", """
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
              ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle)
          WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
    l AS (SELECT a, b FROM i JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
          WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
    c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id,
           coalesce(c.root, w.doc_id) = w.doc_id AS kept
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents linked by similar sets of word pairs."""
    return bottomk.near_duplicates(table(spark, sf, "documents"), shingle=2)


@query("op6_decontamination")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item, in any order."""
    return tiling.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_secrets")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of every document, with those that only count together."""
    return secrets.find_secrets(table(spark, sf, "documents")).drop("findings")


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every document by a machine fitted on the labelled rows that are not held out."""
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf, "labels")))


@query("op9_bpe")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document and back."""
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)
    return bpe.round_trip(table(spark, sf, "documents"), codec)


@query("op10_fingerprints")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of every document and of its edit, and how alike they and the next document's are."""
    return iblt.document_fingerprints(table(spark, sf, "documents"))


@query("op11_spelling", """
    WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i)
        UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
    crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
    r AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
    l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k,
                 translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
          FROM r WHERE length(run) >= 7 GROUP BY ALL),
    h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
              regexp_extract_all(hex(encode(k || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
              lambda a, b: xor(a >> 8, steps[1 + (xor(a, b) & 255)]))) AS h FROM l, crc),
    s AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                      ELSE run END AS word, n FROM h),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
    d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM p),
    m AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS open FROM p),
    pairs AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM m x JOIN m y USING (open) WHERE x.word <> y.word
              UNION ALL SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON d.cut = w.word
              UNION ALL SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON d.cut = w.word),
    b AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM pairs GROUP BY word),
    f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN near END AS form,
                 CASE WHEN top >= 10 * n THEN top END AS form_n FROM w LEFT JOIN b USING (word)),
    t AS (SELECT word, word AS at, form AS to_ FROM f UNION ALL SELECT t.word, t.to_, f.form FROM t JOIN f ON f.word = t.to_)
    SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.to_ IS NULL""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of the words of all documents, with one run in 31 misspelled."""
    words = spelling.word_counts(table(spark, sf, "documents"), spoilt=spelling.SPOILT)
    return spelling.group_spellings(words)


@query("op12_hard_negatives", """
    WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                 CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
          FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    n AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of other labels that come close to an anchor's nearest rows of its own."""
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf, "embeddings")))


@query("op13_simhash_dedup")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents whose similarity hashes differ in two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf, "documents"))
