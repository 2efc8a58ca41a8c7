"""What the operators of this folder share: written tables, batches of rows, words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir

# Rows of an Arrow batch: some documents hold over 100,000 characters, so few rows keep a batch small.
BATCH_ROWS = "512"

# Words are runs of anything but the six ASCII blanks.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_batches(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: later steps read it and need none of the steps before, so a lost
    executor costs only the running step."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str) -> DataFrame:
    """Batch-wise map without a shuffle.

    ``make`` is called once per task and returns a function from the input columns (Python lists) to a dict of output
    lists, or None for no rows.
    """
    small_batches(df.sparkSession)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                out = work(*(c.to_pylist() for c in batch.columns))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id as a whole number and the text, null texts as empty ones; other columns are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
