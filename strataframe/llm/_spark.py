"""Session helpers shared by the training-data operators.

Everything that has to outlive one stage goes through :func:`materialize`,
which writes Parquet under the folder the cluster names in
``spark.checkpoint.dir``.  A table written there survives lost executors and
cuts the lineage, which ``localCheckpoint`` would not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from strataframe.operators._workers import ship_package  # noqa: F401  (the operators take it from here)

#: Used only by a local session that names no shared folder (tests).
LOCAL_DIR = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of an Arrow batch after which it is handed on.
BATCH_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this session.

    A cluster has to name one: a folder of one machine is not seen by others.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DIR


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that ``df`` doesn't have (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_written: list[str] = []


@contextmanager
def cleanup(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of an action within as soon as it is done; else
    they stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strataframe/{tag}-{uuid.uuid4().hex}"
    with cleanup(spark):
        df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._path)
        _written.remove(df._path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession) -> None:
    """Delete the tables that :func:`materialize` wrote in this process, once their results are stored."""
    while _written:
        _delete(spark, _written.pop())


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small, in rows and in bytes: texts can be very long.

    The session keeps the setting, as results are lazy and need it later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
