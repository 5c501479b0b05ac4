"""Small hand-made inputs for the rule tests."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

REPORT = (
    "src_seq bigint, quote_no string, request_ts timestamp_ntz, accept_ts timestamp_ntz,"
    " product string, order_number string, customer_no bigint, paid_amount decimal(18,2),"
    " sales_rep string"
)
ENRICH = (
    "customer_no bigint, industry_category string, industry_sub_category string,"
    " range_employees string, range_revenue string"
)


def at(day: int, hour: int = 0) -> datetime:
    return datetime(2017, 1, day, hour)


def quote(seq, **cells):
    """One report row; cells not named take plain values."""
    row = {
        "quote": str(seq),
        "request": at(1),
        "accept": None,
        "product": "Custom Box",
        "order": None,
        "customer": 1,
        "amount": None,
        "rep": "Ann",
        **cells,
    }
    amount = None if row["amount"] is None else Decimal(str(row["amount"]))
    return (
        seq, row["quote"], row["request"], row["accept"], row["product"], row["order"],
        row["customer"], amount, row["rep"],
    )


def report(spark, *rows):
    return spark.createDataFrame(list(rows), REPORT)


def enrich(spark, *rows):
    return spark.createDataFrame(list(rows), ENRICH)


def by_seq(df, *columns):
    return {r["src_seq"]: tuple(r[c] for c in columns) for r in df.collect()}
