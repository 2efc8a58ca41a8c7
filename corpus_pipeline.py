"""The corpus pipeline: documents in, clean token ids out.

Each stage applies one operator to all that its predecessor kept; ``run`` writes every stage's rows to the shared folder
and reads them again as the next one's documents.

Defined cases: rows with null text are kept as empty documents by every filter that finds nothing in them; rows of one id
stay or go together; an empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brookwatch.llm import bottomk, bpe, secrets, tiling, toxicity
from brookwatch.llm.common import map_batches, written
from brookwatch.session import tune

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed; a null id never is."""
    return docs.join(ids.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    tune(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, toxicity.score(docs, machine).where("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the smallest id stays."""
    tune(spark)
    return _without(docs, bottomk.near_duplicates(docs, shingle=5).where("NOT kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    tune(spark)
    return _without(docs, tiling.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; the documents stay, with their new number of characters."""
    tune(spark)

    def work(key: list, text: list, lang: list, source: list, n_chars: list) -> dict:
        spans = [secrets.scan(t)[1] if t is not None else [] for t in text]
        masked = [secrets.mask(t, s) if s else t for t, s in zip(text, spans, strict=True)]
        sizes = [len(m) if s else n for m, s, n in zip(masked, spans, n_chars, strict=True)]
        return {"doc_id": key, "text": masked, "lang": lang, "source": source, "n_chars": sizes}

    return map_batches(docs.select(*COLUMNS), lambda: work,
                       "doc_id long, text string, lang string, source string, n_chars long")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of what they decode to."""
    tune(spark)
    codec = bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, blank_starts=True)
    return bpe.round_trip(docs, codec, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scan", mask_secrets),
    ("byte-level bpe", encode),
]

# No SQL: the first stage fits a model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
