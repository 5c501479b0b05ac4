"""Scoring of arriving records with Structured Streaming.

The records carry ready, scaled features, so the stream keeps no history. Each batch looks up
the current version of the model, so a retrained model takes effect at the next batch border.
Batches write to folders of their own, which a repeated batch overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadtide import remote
from leadtide.operators import models
from leadtide.plans.trainer import score_records
from leadtide.schema import QUOTE
from leadtide.sources.files import QUOTE_HEADER, SCORING_SCHEMA

#: Increments after which the latest scores are folded into a snapshot.
FOLD_EVERY = 10


def read_records(
    spark: SparkSession, folder: str, schema: T.StructType = SCORING_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """JSON-lines files as they arrive in ``folder``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(folder).withColumnRenamed(QUOTE_HEADER, QUOTE)


def _start(
    records: DataFrame, checkpoint: str, write_batch: Callable[[DataFrame, int], None], forever: bool
) -> StreamingQuery:
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    return (writer if forever else writer.trigger(availableNow=True)).start()


def score_stream(
    records: DataFrame,
    root: str,
    target: str,
    checkpoint: str,
    forever: bool = False,
    score: Callable[[DataFrame, PipelineModel], DataFrame] = score_records,
) -> StreamingQuery:
    """Quote, score and model version of each record, until the input is used up or, with
    ``forever``, until it is stopped. ``read_scores`` gives them, each record once.

    ``root`` holds the versions of the model; see ``models.save_version``. ``score`` turns
    records and model into scored rows; with a model that holds its scaling, raw records can
    be scored.
    """
    loaded: dict[str, PipelineModel] = {}

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        version = models.current_version(batch.sparkSession, root)
        if version not in loaded:
            loaded.clear()
            loaded[version] = models.load_version(root, version)
        scored = score(batch, loaded[version]).withColumn("model", F.lit(version))
        scored.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _start(records, checkpoint, write_batch, forever)


def read_scores(spark: SparkSession, target: str) -> DataFrame:
    """Scored records of all batches written so far."""
    return spark.read.option("basePath", target).parquet(f"{target}/batch=*").drop("batch")


# ---- Latest score per quote


def _numbered(spark: SparkSession, target: str, kind: str) -> list[int]:
    """Numbers of the complete tables ``<kind>=<number>`` of a folder, rising."""
    found = [n.partition("=")[2] for n in remote.names(spark, target) if n.startswith(f"{kind}=")]
    return sorted(int(n) for n in found if remote.exists(spark, f"{target}/{kind}={n}/_SUCCESS"))


def _latest(rows: DataFrame, score: str, arrival: str) -> DataFrame:
    return rows.groupBy(QUOTE).agg(F.max_by(score, arrival).alias(score), F.max(arrival).alias(arrival))


def _parts(spark: SparkSession, target: str, upto: int | None = None) -> list[str]:
    """The newest snapshot and the increments after it."""
    keep = lambda n: upto is None or n <= upto
    snapshots = [n for n in _numbered(spark, target, "snapshot") if keep(n)]
    base = snapshots[-1] if snapshots else -1
    parts = [f"{target}/batch={n}" for n in _numbered(spark, target, "batch") if n > base and keep(n)]
    return [f"{target}/snapshot={base}", *parts] if snapshots else parts


def fold(spark: SparkSession, target: str, upto: int, score: str, arrival: str) -> None:
    """Fold all increments up to batch ``upto`` into a snapshot of that number.

    It replaces what it was made from only when it is complete, and repeating it gives the
    same. The snapshot before and the increments since then stay, for readers that have begun
    with them; what is older goes.
    """
    if upto not in _numbered(spark, target, "snapshot"):
        rows = spark.read.parquet(*_parts(spark, target, upto))
        _latest(rows, score, arrival).write.mode("overwrite").parquet(f"{target}/snapshot={upto}")
    older = [n for n in _numbered(spark, target, "snapshot") if n < upto]
    if not older:
        return
    for n in older[:-1]:
        remote.delete(spark, f"{target}/snapshot={n}")
    for n in _numbered(spark, target, "batch"):
        if n <= older[-1]:
            remote.delete(spark, f"{target}/batch={n}")


def latest_score_stream(
    scores: DataFrame,
    score: str,
    arrival: str,
    target: str,
    checkpoint: str,
    fold_every: int = FOLD_EVERY,
    forever: bool = False,
) -> StreamingQuery:
    """Keep the latest score of each quote, until the input is used up.

    A batch writes the latest of its own scores, combined before their shuffle; the stream
    itself holds no state. Every ``fold_every`` batches the increments are folded into a
    snapshot, so a reader meets at most that many increments. A batch that is repeated
    overwrites its increment, which is passed over if it is folded already.
    ``read_latest_scores`` gives the current state.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _latest(batch, score, arrival).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        folded = _numbered(spark, target, "snapshot")
        if batch_id - (folded[-1] if folded else -1) >= fold_every:
            fold(spark, target, batch_id, score, arrival)

    return _start(scores, checkpoint, write_batch, forever)


def read_latest_scores(spark: SparkSession, target: str, score: str, arrival: str) -> DataFrame:
    """The latest score of each quote: the newest snapshot and the increments after it."""
    return _latest(spark.read.parquet(*_parts(spark, target)), score, arrival).drop(arrival)
