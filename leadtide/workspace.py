"""Where intermediate tables are written.

A cluster names a shared folder in ``spark.checkpoint.dir``; a table written there
outlives the executors that computed it. Only a local session may go without one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from leadtide import remote

#: Folders made for local sessions without a setting, by application.
_MADE: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder of the session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _MADE:
        _MADE[application] = tempfile.mkdtemp(prefix="leadtide-")
        spark.sparkContext.setCheckpointDir(_MADE[application])
    return _MADE[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{folder(spark)}/leadtide/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def drop(*tables: DataFrame) -> None:
    """Delete tables given by ``store`` whose readers are done: what was made from them is
    itself written. Shuffle files that nothing refers to any more go as well."""
    for table in tables:
        remote.delete(table.sparkSession, table.stored_at)
    if tables:
        release(tables[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to any more: Spark removes them when the
    driver collects its garbage, which may otherwise be long in coming."""
    spark.sparkContext._jvm.System.gc()
