"""Pieces shared by the training-data operators: table access, Arrow batch maps and checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship

#: Arrow batches of long documents must stay small beside a Python worker's memory.
MAX_RECORDS_PER_BATCH = 1000
MAX_BYTES_PER_BATCH = 16 << 20
#: Caches that a Python worker keeps between tasks (each of them is bounded where it is used).
WORKER: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone, so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Bound the size of Arrow batches and make the package importable on executors. The bounds are
    settings of the session: results are lazy, so they must still hold when the caller runs them.
    Smaller ones that the caller has set stay."""
    for name, most in (("maxRecordsPerBatch", MAX_RECORDS_PER_BATCH), ("maxBytesPerBatch", MAX_BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where spark.checkpoint.dir is unset, and all runs on one
    machine (tests), a local one is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: set[str] = set()


def written(df: DataFrame) -> DataFrame:
    """df as a compressed Parquet table in the shared checkpoint folder, read from there. Results are
    lazy and may read it at any time, so it goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        jvm = spark.sparkContext._jvm
        atexit.register(lambda: [_delete(jvm, p) for p in _TABLES])
    _TABLES.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(jvm, path: str) -> None:  # noqa: ANN001
    try:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: BLE001, S110  the machine behind it may have ended before
        pass


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A record batch of the columns named in the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def ddl(schema: pa.Schema) -> str:
    """The Spark schema string of an Arrow schema of plain columns."""
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double"}

    def kind(t: pa.DataType) -> str:
        return f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else names[t]

    return ", ".join(f"`{f.name}` {kind(f.type)}" for f in schema)


def need(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads; others of any name stay out of its way."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the table has no column {', '.join(missing)}")
    return df.select(*[f"`{c}`" for c in columns])
