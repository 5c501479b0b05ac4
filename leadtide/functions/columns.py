"""Column expressions of the cleaning, label and feature rules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadtide.schema import TIMESTAMP_FORMAT

SECONDS_PER_DAY = 86400
#: Text in ``TIMESTAMP_FORMAT``.
TIMESTAMP_SHAPE = r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"
# What is cut off order numbers and products, the days below which a quote counts
# as closed, the smallest value that is no 0, and the seed of the split.
ORDER_TAIL = "[^0-9]+$"
PRODUCT_HEAD = "^Custom "
CLOSED_WITHIN = {"close_3d": 4, "close_2w": 15}
SMALLEST_VALUE = 20
SPLIT_SEED = 31


def missing_to_null(col: Column, tokens: Iterable[str]) -> Column:
    return F.when(~col.isin(*tokens), col)


def parse_timestamp(col: Column) -> Column:
    """Text to timestamp; text of another shape raises under ANSI mode."""
    return F.to_timestamp_ntz(col, F.lit(TIMESTAMP_FORMAT))


def clean_order_number(col: Column) -> Column:
    """Drop everything after the last digit."""
    return F.regexp_replace(col, ORDER_TAIL, "")


def clean_product(col: Column) -> Column:
    return F.regexp_replace(col, PRODUCT_HEAD, "")


def floored_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods from start to end, rounded down (-25 hours are -2 days)."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.floor(seconds / F.lit(float(SECONDS_PER_DAY))).cast("int")


def closed_flag(days: Column, below: int) -> Column:
    """1 if closed in fewer than ``below`` days; a missing date counts as open."""
    return F.when(days < below, 1).otherwise(0)


def order_flag(amount: Column) -> Column:
    """Any amount but zero is an order, a refund too."""
    return F.when(amount == 0, 0).otherwise(1)


def clip_small(value: Column, smallest: float = SMALLEST_VALUE) -> Column:
    return F.when(value < smallest, F.lit(0.0)).otherwise(value)


def is_test_row(row_id: Column, seed: int = SPLIT_SEED) -> Column:
    """A quarter of the rows, chosen by a hash of the row id.

    The choice hangs on the id alone, so it survives retries and repartitioning.
    """
    digest = F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.substring(digest, 1, 2) < "40"
