"""Preparation of features for the models: scaling, split, subsets, order of columns."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.functions import columns as fx
from leadtide.schema import FEATURES, GLOBAL_METRICS, SEQ

# Executors need not have this package: the functions that run there travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

AUXILIARY = ["whether_order", "order_grp", "quotes_since"]
IS_TEST = "is_test"


def drop_auxiliary(df: DataFrame, auxiliary: Iterable[str] = tuple(AUXILIARY)) -> DataFrame:
    """Columns in name order, without helpers and ``_lag`` columns."""
    names = sorted(set(df.columns) - set(auxiliary))
    return df.select(*[c for c in names if not c.endswith("_lag")])


def fill_all_zero(df: DataFrame) -> DataFrame:
    """0 for every missing number and the text ``0`` for every missing text; dates keep their
    nulls."""
    return df.na.fill(0).na.fill("0")


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation of each feature."""

    mean: dict[str, float]
    deviation: dict[str, float]

    def expressions(self) -> dict[str, str]:
        """Each scaled feature as SQL; a constant feature becomes 0."""
        return {c: f"(double({c}) - {m!r}D) / {self.deviation[c] or 1.0!r}D" for c, m in self.mean.items()}

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Scaled features under their names, or next to the raw ones with a suffix."""
        scaled = self.expressions()
        if suffix:
            return df.selectExpr("*", *[f"{e} AS {c}{suffix}" for c, e in scaled.items()])
        return df.selectExpr(
            *[f"{scaled[c]} AS {c}" if c in scaled else f"`{c}`" for c in df.columns]
        )

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, self.mean[c], self.deviation[c]) for c in self.mean]
        table = spark.createDataFrame(rows, "feature string, mean double, deviation double")
        table.coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scaling:
        """One row per feature."""
        rows = spark.read.parquet(path).collect()
        return Scaling(
            {r["feature"]: r["mean"] for r in rows},
            {r["feature"]: r["deviation"] for r in rows},
        )


#: Bits of a feature's whole numbers, relative to its largest value; two halves make one.
BITS, HALF = 60, 30


def _largest(batches):
    """Per task and feature, by its place, the largest magnitude; NaN is the largest of all."""
    top = {}
    for batch in batches:
        for i, column in enumerate(batch.columns):
            values = np.abs(column.drop_null().to_numpy(zero_copy_only=False))
            if len(values):
                top[i] = max(top.get(i, 0.0), np.where(np.isnan(values), np.inf, values).max())
    yield pa.RecordBatch.from_pydict({"i": pa.array([*top], pa.int32()), "top": pa.array([*top.values()], pa.float64())})


def _exact_sums(factors: list[tuple[float, float]]):
    """Per task and feature the count, the sum of the whole numbers, and those of the products
    of their halves. Within a batch they are sums of long halves, which cannot overflow."""
    mask = (1 << HALF) - 1

    def run(batches):
        sums = [[0] * 5 for _ in factors]
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 16):
                for i, column in enumerate(whole.slice(at, 1 << 16).columns):
                    values = column.drop_null().to_numpy(zero_copy_only=False)
                    number = np.rint(values * factors[i][0] * factors[i][1]).astype(np.int64)
                    high, low = number >> HALF, number & mask
                    found = [len(number), (int(high.sum()) << HALF) + int(low.sum())]
                    for product in (high * high, high * low, low * low):
                        found.append((int((product >> HALF).sum()) << HALF) + int((product & mask).sum()))
                    sums[i] = [x + y for x, y in zip(sums[i], found)]
        names = ["n", "s", "hh", "hl", "ll"]
        columns = [pa.array([Decimal(x) for x in part], pa.decimal128(38, 0)) for part in zip(*sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), *columns], ["i", *names])

    return run


def fit_scaling(df: DataFrame, features: Iterable[str] = tuple(FEATURES)) -> Scaling:
    """Mean and population deviation of all features over all rows given, nulls left out.

    They do not depend on how the rows are spread. A first aggregation finds the largest
    magnitude of each feature. In the second a value is the whole number of steps nearest to
    it, with ``BITS`` bits for the largest, more than a double holds; sums of these and of the
    products of their halves are exact, and so is all that follows on the driver. Tasks sum
    whole batches of columns; what they give is added by Spark.

    The reference scales before it splits; pass the training rows to avoid that leak. Values
    that are not finite raise.
    """
    features = list(features)
    numbers = df.selectExpr(*[f"double({c}) AS c{i}" for i, c in enumerate(features)])
    tops = numbers.mapInArrow(_largest, "i int, top double").groupBy("i").agg(F.max("top").alias("top"))
    top = {r["i"]: r["top"] for r in tops.collect()}
    steps, factors = [], []
    for i, c in enumerate(features):
        largest = top.get(i, 0.0)
        if not math.isfinite(largest):
            raise ValueError(f"{c} has values that are not finite")
        steps.append(BITS - math.frexp(largest)[1] if largest else 0)
        # Two factors: one alone may leave the range of a double.
        half = steps[i] // 2
        factors.append((2.0**half, 2.0 ** (steps[i] - half)))
    kinds = ["n", "s", "hh", "hl", "ll"]
    parts = numbers.mapInArrow(_exact_sums(factors), "i int, " + ", ".join(f"{k} decimal(38,0)" for k in kinds))
    sums = {r["i"]: r for r in parts.groupBy("i").agg(*[F.sum(k).alias(k) for k in kinds]).collect()}
    mean, deviation = {}, {}
    for i, c in enumerate(features):
        n, total, hh, hl, ll = (int(sums[i][k]) if i in sums else 0 for k in kinds)
        squares = (hh << 2 * HALF) + (hl << HALF + 1) + ll
        mean[c] = float(Fraction(total, n) / Fraction(2) ** steps[i]) if n else 0.0
        spread = math.sqrt(Fraction(n * squares - total * total, n * n)) if n else 0.0
        deviation[c] = math.ldexp(spread, -steps[i])
    return Scaling(mean, deviation)


def mark_test_rows(df: DataFrame, seed: int = fx.SPLIT_SEED) -> DataFrame:
    return df.withColumn(IS_TEST, fx.is_test_row(F.col(SEQ), seed))


def split(df: DataFrame, seed: int = fx.SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """Training rows (three quarters) and test rows."""
    chosen = fx.is_test_row(F.col(SEQ), seed)
    return df.filter(~chosen), df.filter(chosen)


def neutralize_rep(df: DataFrame, suffix: str = "") -> DataFrame:
    """The figures over all quotes in place of those of the sales rep."""
    present = {k: g for k, g in GLOBAL_METRICS.items() if f"sales_rep_{k}{suffix}" in df.columns}
    return df.withColumns({f"sales_rep_{k}{suffix}": F.col(f"{g}{suffix}") for k, g in present.items()})


def new_customers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("whether_new") == 1)


def as_float32(df: DataFrame, features: Iterable[str] = tuple(FEATURES)) -> DataFrame:
    features = set(features)
    return df.selectExpr(
        *[f"float({c}) AS {c}" if c in features else f"`{c}`" for c in df.columns]
    )


def numbered_features(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Features renamed to ``f0``, ``f1``, ... in name order."""
    keep = list(keep)
    names = sorted(set(df.columns) - set(keep))
    return df.selectExpr(*keep, *[f"{c} AS f{i}" for i, c in enumerate(names)])
