"""Will a quote close within three days or two weeks?"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.operators import metrics, models, prep
from leadtide.operators.cleaning import clean_quotes
from leadtide.operators.history import history_features
from leadtide.operators.metrics import LABEL, PREDICTION, SCORE
from leadtide.operators.ordering import TASK_ROWS
from leadtide.schema import FEATURES, LABELS
from leadtide.workspace import release, store

HORIZON = {"close_3d": "3 Days", "close_2w": "2 Weeks"}


def feature_table(
    report: DataFrame,
    enrich: DataFrame,
    partitions: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Clean quotes with labels and all 30 history features, unscaled."""
    return history_features(clean_quotes(report, enrich, partitions, task_rows))


def scaled_table(features: DataFrame) -> tuple[DataFrame, DataFrame, prep.Scaling]:
    """The feature table and its scaled form, both over one stored copy, and the scaling.

    Training reads the rows many times, so they are written first.
    """
    raw = store(prep.drop_auxiliary(features), "features")
    release(raw.sparkSession)
    scaling = prep.fit_scaling(raw, FEATURES)
    return raw, scaling.apply(raw), scaling


def train_and_test(scaled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three quarters to train on; the rest without knowledge of the sales rep."""
    train, test = prep.split(scaled)
    return train, prep.neutralize_rep(test)


def report_rows(
    model: PipelineModel, test: DataFrame, label: str, name: str, new_customers: str | None = None
) -> DataFrame:
    """Label, predicted class and score of each test row, under the name of the report.

    ``new_customers`` names a second report on the rows of new customers; the model runs once
    for both.
    """
    scored = models.predict_class(model, test, "closes")
    reports = [F.lit(f"{name}, {HORIZON[label]}")]
    if new_customers:
        reports.append(F.when(F.col("whether_new") == 1, F.lit(f"{new_customers}, {HORIZON[label]}")))
    return scored.select(
        F.explode(F.array_compact(F.array(*reports))).alias("report"),
        F.col(label).alias(LABEL),
        F.col("closes").alias(PREDICTION),
        F.col("closes_prob").alias(SCORE),
    )


def model_reports(
    scaled: DataFrame, rounds: int = 200, net_rounds: int = 200, partitions: int | None = None
) -> DataFrame:
    """Accuracy, AUC and confusion counts of both model types on the test rows, and of the
    boosted trees on the new customers among them, for both labels."""
    train, test = train_and_test(scaled)
    nets, boosted = models.neural_net(rounds=net_rounds), models.boosted_classifier(rounds=rounds)
    fitted = models.fit_all((kind, train, label) for kind in (nets, boosted) for label in LABELS)
    parts = []
    for label, net in zip(LABELS, fitted):
        parts.append(report_rows(net, test, label, "MLP"))
    for label, trees in zip(LABELS, fitted[len(LABELS) :]):
        parts.append(report_rows(trees, test, label, "GBT", "GBT for New Customer"))
    scored = reduce(DataFrame.unionByName, parts)
    return metrics.classification_report(scored, partitions=partitions)


def _on_raw(scaling: prep.Scaling, rounds: int) -> Pipeline:
    return models.with_scaling(scaling, models.boosted_classifier(rounds=rounds))


def fit_on_raw(raw: DataFrame, scaling: prep.Scaling, label: str, rounds: int = 200) -> PipelineModel:
    """The boosted classifier as a model of raw rows, with the scaling inside."""
    return models.fit(_on_raw(scaling, rounds), raw, label)


def full_predictions(raw: DataFrame, scaling: prep.Scaling, rounds: int = 200) -> DataFrame:
    """Models refitted on all rows, and their predictions next to the raw quotes."""
    scored = raw
    fitted = models.fit_all((_on_raw(scaling, rounds), raw, label) for label in LABELS)
    for label, model in zip(LABELS, fitted):
        scored = models.predict_class(model, scored, f"pred_{label}")
    return scored


def new_customer_test_scores(
    raw: DataFrame, scaling: prep.Scaling, rounds: int = 200, label: str = "close_2w"
) -> DataFrame:
    """The raw test rows of new customers with the class and score of the test model.

    Raw and scaled features are columns of one row; the sales rep is made neutral among the
    scaled ones.
    """
    train, test = prep.split(raw)
    model = models.on_scaled(fit_on_raw(train, scaling, label, rounds))
    chosen = prep.neutralize_rep(scaling.apply(prep.new_customers(test), models.SUFFIX), models.SUFFIX)
    return models.without_scaled(models.predict_class(model, chosen, "pred"))
