"""Predictions next to the rows they belong to."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.operators.prep import Scaling
from leadtide.schema import QUOTE, QUOTE_COLUMNS, SEQ


def attach_predictions(
    raw: DataFrame, scored: DataFrame, predictions: Iterable[str], row_id: str = SEQ
) -> DataFrame:
    """Prediction columns of ``scored`` next to the raw row they were made from.

    For predictions that were made elsewhere; a model of this library scores the raw rows
    themselves, see ``models.with_scaling``. Rows are matched by their id, and a raw row stays
    one row: of an id that has several predictions, one is taken for all columns. Matching all
    shared columns instead, as one must without an id, would pair every copy with every other.
    """
    predictions = list(predictions)
    one = scored.groupBy(row_id).agg(F.max(F.struct(*predictions)).alias("one"))
    return raw.join(one.select(row_id, *[F.col(f"one.{c}").alias(c) for c in predictions]), row_id, "left")


def raw_and_scaled(raw: DataFrame, scaling: Scaling, more: Iterable[str] = (), row_id: str = SEQ) -> DataFrame:
    """Both forms of every feature side by side, as ``<name>_raw`` and ``<name>_scaled``, with
    the quote columns once, further columns of ``raw`` as ``<name>_raw``, and ``more`` as they are.

    The scaled form is worked out in the same row: nothing is joined, so rows that repeat stay
    as many as they are.
    """
    once = [row_id, *[c for c in QUOTE_COLUMNS if c in raw.columns], *more]
    scaled = scaling.expressions()
    rest = [c for c in raw.columns if c not in once]
    return raw.selectExpr(*once, *[f"{c} AS {c}_raw" for c in rest], *[f"{e} AS {c}_scaled" for c, e in scaled.items()])


def rows_of(df: DataFrame, subset: DataFrame, row_id: str = SEQ) -> DataFrame:
    """The rows of ``df`` whose id is in ``subset``."""
    return df.join(subset.select(row_id), row_id, "left_semi")


def latest_scores(scores: DataFrame, score: str, arrival: str) -> DataFrame:
    """The last score of each quote. Combined before the shuffle, so a quote may have
    any number of scores."""
    return scores.groupBy(QUOTE).agg(F.max_by(score, arrival).alias(score))
