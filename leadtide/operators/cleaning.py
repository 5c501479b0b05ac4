"""From the raw report to one clean row per order and per open quote."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.functions import columns as fx
from leadtide.operators.ordering import (
    CHUNK,
    POS,
    TASK_ROWS,
    Ordered,
    beside,
    member_figures,
    number_rows,
    place_chunks,
)
from leadtide.schema import (
    ACCEPT,
    AMOUNT,
    CUSTOMER,
    INDUSTRY,
    NEVER_ACCEPTED,
    NO_INDUSTRY,
    NO_ORDER,
    ORDER,
    PRODUCT,
    QUOTE,
    QUOTE_COLUMNS,
    REQUEST,
    SEQ,
)
from leadtide.workspace import drop, store


def enrich_quotes(report: DataFrame, enrich: DataFrame) -> DataFrame:
    """Left join of the customer attributes; a missing customer matches a missing one.

    No broadcast hint: Spark broadcasts the attributes when their size is below its
    threshold, and otherwise joins by shuffle, where AQE splits the partition of a
    customer with very many quotes. ``enrich`` holds one row per customer.
    """
    right = enrich.select(F.col(CUSTOMER).alias("enrich_customer"), *INDUSTRY)
    return report.join(
        right, report[CUSTOMER].eqNullSafe(right["enrich_customer"]), "left"
    ).drop("enrich_customer")


def valid_quotes(df: DataFrame) -> DataFrame:
    return df.filter(F.col(QUOTE).isNotNull())


def fill_missing(df: DataFrame) -> DataFrame:
    """Constants for missing dates, orders, amounts and industry columns.

    The order number is stripped before it is filled: a text-only number becomes empty,
    which is not a missing order.
    """
    fills = {
        ACCEPT: F.coalesce(ACCEPT, F.lit(NEVER_ACCEPTED).cast("timestamp_ntz")),
        ORDER: F.coalesce(fx.clean_order_number(F.col(ORDER)), F.lit(NO_ORDER)),
        PRODUCT: fx.clean_product(F.col(PRODUCT)),
        AMOUNT: F.coalesce(AMOUNT, F.lit(0).cast("decimal(18,2)")),
        **{c: F.coalesce(c, F.lit(NO_INDUSTRY)) for c in INDUSTRY},
    }
    return df.withColumns({c: v for c, v in fills.items() if c in df.columns})


def quote_order() -> list[Column]:
    """Request, then accept time, then the row's place in the file."""
    return [F.col(REQUEST).asc_nulls_last(), F.col(ACCEPT).asc(), F.col(SEQ).asc()]


def order_quotes(
    report: DataFrame,
    enrich: DataFrame,
    partitions: int | None = None,
    task_rows: int = TASK_ROWS,
) -> Ordered:
    """Enriched, filled and valid quotes, numbered by ``quote_order``."""
    quotes = fill_missing(enrich_quotes(valid_quotes(report), enrich))
    return number_rows(quotes, quote_order(), "quotes", partitions, task_rows)


def flag_new_customers(quotes: Ordered) -> Ordered:
    """``whether_new`` is 0 only where the customer's previous row has an amount."""
    lagged = member_figures(quotes, CUSTOMER, CUSTOMER, previous={"amount_before": AMOUNT})
    old = F.coalesce(F.col("amount_before") != 0, F.lit(False))
    return quotes.with_rows(
        beside(quotes, lagged).select(*quotes.rows.columns, F.when(old, 0).otherwise(1).alias("whether_new"))
    )


def amount_by_quote_order(rows: DataFrame) -> DataFrame:
    return rows.groupBy(QUOTE, ORDER).agg(F.sum(AMOUNT).alias(AMOUNT))


def kept_rows(rows: DataFrame) -> DataFrame:
    """Positions of the rows that stay, each with the amount of its (quote, order).

    An order number stays once, at its earliest row. Every open row stays. Both sides
    are aggregated before they move, so that an order number or a quote may hold any
    share of the rows: first rows are found by ``min``, and the total of an open quote
    is handed back per chunk, never to the quote as a whole.
    """
    narrow = rows.select(QUOTE, ORDER, AMOUNT, POS, CHUNK)
    closed = (
        narrow.filter(F.col(ORDER) != NO_ORDER)
        .groupBy(ORDER, QUOTE)
        .agg(
            F.sum(AMOUNT).alias("total"),
            F.min_by(CHUNK, POS).alias(CHUNK),
            F.min(POS).alias(POS),
        )
        .groupBy(ORDER)
        .agg(
            F.min_by("total", POS).alias("total"),
            F.min_by(CHUNK, POS).alias(CHUNK),
            F.min(POS).alias(POS),
        )
        .select(CHUNK, POS, "total")
    )
    open_rows = narrow.filter(F.col(ORDER) == NO_ORDER)
    totals = (
        open_rows.groupBy(QUOTE, CHUNK)
        .agg(F.sum(AMOUNT).alias("in_chunk"))
        .select(
            QUOTE,
            CHUNK,
            F.sum("in_chunk").over(Window.partitionBy(QUOTE)).alias("total"),
        )
    )
    opened = open_rows.join(totals, [QUOTE, CHUNK]).select(CHUNK, POS, "total")
    return closed.unionByName(opened)


def dedupe_orders(quotes: Ordered, source: DataFrame | None = None) -> Ordered:
    """One row per order and all open rows, with amounts summed per (quote, order).

    The kept positions are unique and both sides are placed by chunk, so the join is even
    and leaves the rows where later steps want them. Positions are worked out from
    ``source``, the same rows in a form that is cheap to read twice.
    """
    rows = quotes.rows
    total = F.col("total").cast("decimal(28,2)").alias(AMOUNT)
    totals = place_chunks(quotes, kept_rows(rows if source is None else source))
    kept = beside(quotes.with_rows(rows.drop(AMOUNT)), totals)
    return quotes.with_rows(
        kept.select(*[total if c == AMOUNT else F.col(c) for c in rows.columns])
    )


def add_labels(df: DataFrame) -> DataFrame:
    """Close flags, order flag and sales cycle of each row."""
    days = fx.floored_days(F.col(REQUEST), F.col(ACCEPT))
    return df.withColumns(
        {
            **{c: fx.closed_flag(days, below) for c, below in fx.CLOSED_WITHIN.items()},
            "whether_order": fx.order_flag(F.col(AMOUNT)),
            "sales_cycle": days * fx.order_flag(F.col(AMOUNT)),
        }
    )


def select_quote_columns(df: DataFrame, *more: str) -> DataFrame:
    return df.select(SEQ, *QUOTE_COLUMNS, *more)


def clean_quotes(
    report: DataFrame,
    enrich: DataFrame,
    partitions: int | None = None,
    task_rows: int = TASK_ROWS,
) -> Ordered:
    """The cleaned quote table with labels, stored.

    ``whether_new`` is set on all valid quotes, before orders are deduplicated. The table of
    ordered quotes is dropped when the clean one is written.
    """
    quotes = order_quotes(report, enrich, partitions, task_rows)
    deduped = dedupe_orders(flag_new_customers(quotes), source=quotes.rows)
    clean = store(add_labels(deduped.rows), "clean")
    drop(quotes.stored)
    return replace(quotes, rows=clean, stored=clean)
