"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Runtime settings the operators are planned for.  AQE splits skewed join
# partitions and coalesces small ones; the window-group limit keeps only the
# first n rows of a group per task before a ranking shuffle.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
}

# On one machine small files keep all cores busy; a cluster keeps Spark's size.
LOCAL_CONF = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}

CHECKPOINT_CONF = "spark.checkpoint.dir"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    local = LOCAL_CONF if spark.sparkContext.master.startswith("local") else {}
    for key, value in {**RUNTIME_CONF, **local}.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "brookwatch") -> SparkSession:
    """Session for tests and the local bench."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g")
               .config("spark.sql.shuffle.partitions", "8"))
    for key, value in {**RUNTIME_CONF, **LOCAL_CONF}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def held_rows(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """Rows that the driver holds as a local relation: Catalyst knows its size, and broadcasts it while it is small."""
    schema = StructType.fromDDL(ddl)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    kinds = to_arrow_schema(schema)
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
    return spark.createDataFrame(table, schema)


# Folders of sessions on one machine that name none, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a session on one machine, as in tests, may leave it unset; such a session gets a folder of its own.
    """
    context = spark.sparkContext
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
        path = _own_dirs.get(context.applicationId) or tempfile.mkdtemp(prefix="brookwatch-")
        _own_dirs[context.applicationId] = path
    return path
