"""What is a quote worth?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.functions import columns as fx
from leadtide.operators import metrics, models, prep
from leadtide.operators.cleaning import clean_quotes
from leadtide.operators.history import history_features, lag_columns
from leadtide.operators.metrics import LABEL, PREDICTION
from leadtide.operators.ordering import CHUNK, POS, TASK_ROWS, beside
from leadtide.operators.scoring import raw_and_scaled
from leadtide.schema import AMOUNT, VALUE_FEATURES
from leadtide.workspace import store

PREDICTED = "predicted_amount"


def value_table(
    report: DataFrame,
    enrich: DataFrame,
    partitions: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Clean quotes with the 21 features without sales cycles, unscaled, zeros for missing
    numbers."""
    clean = clean_quotes(report, enrich, partitions, task_rows)
    clean = clean.with_rows(clean.rows.drop("close_3d", "close_2w"))
    features = history_features(clean, cycles=False).drop("sales_cycle")
    return prep.fill_all_zero(prep.drop_auxiliary(features))


def value_frame(
    report: DataFrame,
    enrich: DataFrame,
    partitions: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``value_table`` with the lag columns of amounts and orders, as the notebook keeps them:
    16 of the groupings and two over all rows. No model uses them."""
    clean = clean_quotes(report, enrich, partitions, task_rows)
    lagged = beside(clean, lag_columns(clean, ["amt", "order"]))
    clean = clean.with_rows(lagged.drop("close_3d", "close_2w"))
    features = history_features(clean, cycles=False).drop("sales_cycle", POS, CHUNK, *prep.AUXILIARY)
    return prep.fill_all_zero(features.select(*sorted(features.columns)))


def scaled_table(features: DataFrame) -> tuple[DataFrame, DataFrame, prep.Scaling]:
    raw = store(features, "value-features")
    scaling = prep.fit_scaling(raw, VALUE_FEATURES)
    return raw, scaling.apply(raw), scaling


def tested_values(scaled: DataFrame, rounds: int = 200) -> DataFrame:
    """Actual and predicted values of the test rows."""
    train, test = prep.split(scaled)
    model = models.fit(models.boosted_regressor(rounds=rounds), train, AMOUNT)
    predicted = models.predict_value(model, prep.neutralize_rep(test), PREDICTED)
    return predicted.select(
        F.col(AMOUNT).cast("double").alias(LABEL), F.col(PREDICTED).alias(PREDICTION)
    )


def test_error(scaled: DataFrame, rounds: int = 200) -> DataFrame:
    return metrics.mean_squared_error(tested_values(scaled, rounds))


def full_values(raw: DataFrame, scaling: prep.Scaling, rounds: int = 400) -> DataFrame:
    """The model for all rows: clipped predictions next to raw and scaled columns."""
    pipeline = models.with_scaling(scaling, models.full_value_regressor(rounds=rounds))
    predicted = models.predict_value(models.fit(pipeline, raw, AMOUNT), raw, PREDICTED)
    clipped = predicted.withColumn(PREDICTED, fx.clip_small(F.col(PREDICTED)))
    return raw_and_scaled(clipped, scaling, [PREDICTED])
