"""Column names, file schemas and the feature catalogue."""

from __future__ import annotations

from pyspark.sql import types as T

QUOTE = "quote_no"
REQUEST = "request_ts"
ACCEPT = "accept_ts"
PRODUCT = "product"
ORDER = "order_number"
CUSTOMER = "customer_no"
AMOUNT = "paid_amount"
REP = "sales_rep"
SEQ = "src_seq"

INDUSTRY = [
    "industry_category",
    "industry_sub_category",
    "range_employees",
    "range_revenue",
]

MONEY = T.DecimalType(18, 2)
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Fills for missing cells.
NEVER_ACCEPTED = "2100-01-01 00:00:00"
NO_ORDER = "no_order"
NO_INDUSTRY = "personal"

# Cell texts read as missing. The first list applies to every file.
DEFAULT_MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]
REPORT_MISSING = ["", "null", "Not quoted yet", "NA", "<NA>", "No"]
ENRICH_MISSING = ["", "NA"]

# File header -> our column, in file order.
REPORT_HEADER = {
    "Quote.No": QUOTE,
    "Request.Date": REQUEST,
    "Invoice.Accept.Date": ACCEPT,
    "Product": PRODUCT,
    "Order.Number": ORDER,
    "Customer.No": CUSTOMER,
    "Paid.Amount": AMOUNT,
    "Sales.Rep": REP,
}
ENRICH_HEADER = {"Customer.No": CUSTOMER, **{c: c for c in INDUSTRY}}

REPORT_TYPES = {
    QUOTE: "string",
    REQUEST: "timestamp_ntz",
    ACCEPT: "timestamp_ntz",
    PRODUCT: "string",
    ORDER: "string",
    CUSTOMER: "bigint",
    AMOUNT: "decimal(18,2)",
    REP: "string",
    SEQ: "bigint",
}

QUOTE_COLUMNS = [
    QUOTE, REQUEST, ACCEPT, PRODUCT, ORDER, CUSTOMER, AMOUNT, *INDUSTRY,
    "whether_new", REP,
]

# History groups: feature prefix -> grouping column.
CUSTOMER_PREFIX = "cust"
SHARED_GROUPS = {
    "product": PRODUCT,
    "industry_category": "industry_category",
    "industry_sub_category": "industry_sub_category",
    "range_employees": "range_employees",
    "range_revenue": "range_revenue",
    "whether_new": "whether_new",
    "sales_rep": REP,
}
GROUPS = {**SHARED_GROUPS, CUSTOMER_PREFIX: CUSTOMER}

GLOBAL_METRICS = {"aov": "aov", "close_rate": "avg_close_rate", "asc": "avg_sales_cycle"}
LABELS = ["close_3d", "close_2w"]


def feature_columns(cycles: bool = True) -> list[str]:
    """Feature names in sorted order: 30 with sales cycles, 21 without."""
    kinds = [k for k in GLOBAL_METRICS if cycles or k != "asc"]
    names = [GLOBAL_METRICS[k] for k in kinds]
    names += [f"{g}_{k}" for g in GROUPS for k in kinds]
    names += ["cust_tot_spend", "cust_tot_orders", "quotes_since_last_order"]
    return sorted(names)


FEATURES = feature_columns()
VALUE_FEATURES = feature_columns(cycles=False)


def _group(name: str) -> list[str]:
    return [f"{name}_{k}" for k in GLOBAL_METRICS]


# Column order of the exported training file.
EXPORT_FEATURES = [
    *GLOBAL_METRICS.values(),
    *_group("whether_new"),
    "cust_tot_spend",
    "cust_tot_orders",
    *_group("cust"),
    "quotes_since_last_order",
    *[c for g in SHARED_GROUPS if g != "whether_new" for c in _group(g)],
]
