"""History features: figures over the quotes requested earlier."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.operators.ordering import (
    CHUNK,
    POS,
    Ordered,
    add_shared_previous,
    add_shared_prior,
    beside,
    member_figures,
    number_rows,
    prior_name,
)
from leadtide.schema import (
    AMOUNT,
    CUSTOMER,
    CUSTOMER_PREFIX,
    GLOBAL_METRICS,
    GROUPS,
    SHARED_GROUPS,
)

SPENT = "spent"
ORDERS = "orders"
CYCLE = "cycle_days"
QUOTES = "quotes"
MEASURES = [SPENT, ORDERS, CYCLE, QUOTES]
EVERYTHING = "all"

# What each metric divides by what.
METRICS = {"aov": (SPENT, ORDERS), "close_rate": (ORDERS, QUOTES), "asc": (CYCLE, ORDERS)}


def with_measures(clean: DataFrame) -> DataFrame:
    """The summed columns of the history. Money stays decimal, so sums do not depend on
    the order of addition."""
    return clean.withColumns(
        {
            SPENT: F.col(AMOUNT).cast("decimal(28,2)"),
            ORDERS: F.col("whether_order").cast("bigint"),
            CYCLE: F.coalesce(F.col("sales_cycle"), F.lit(0)).cast("bigint"),
            QUOTES: F.lit(1).cast("bigint"),
        }
    )


def metric(group: str, kind: str, name: str, instead: str = "0D") -> str:
    """A ratio of two prior sums as an SQL expression; ``instead`` if it is zero."""
    part, whole = (prior_name(group, m) for m in METRICS[kind])
    return f"coalesce(nullif(try_divide(double({part}), double({whole})), 0D), {instead}) AS {name}"


def _measures_of(kinds: list[str]) -> list[str]:
    used = {m for k in kinds for m in METRICS[k]}
    return [m for m in MEASURES if m in used]


def shared_figures(
    clean: Ordered,
    groups: dict[str, str],
    kinds: list[str],
    everything: bool = False,
    fallback: bool = False,
) -> DataFrame:
    """``<group>_<metric>`` for several groupings, by position.

    With ``everything`` also the metrics over all quotes; with ``fallback`` these replace
    a group metric of 0, a true zero too.

    The windows run over keys and measures alone; see ``beside`` for the other columns.
    """
    measures = _measures_of(kinds)
    narrow = with_measures(clean.rows).select(POS, CHUNK, *groups.values(), *measures)

    def figures(group: str) -> list[str]:
        if group == EVERYTHING:
            return [metric(group, k, GLOBAL_METRICS[k]) for k in kinds]
        instead = GLOBAL_METRICS if fallback else {}
        return [metric(group, k, f"{group}_{k}", instead.get(k, "0D")) for k in kinds]

    prior = add_shared_prior(
        clean.with_rows(narrow),
        groups,
        measures,
        EVERYTHING if everything else None,
        figures=figures,
    )
    return prior.rows.drop(*measures)


def _customers(clean: Ordered, measures: list[str]) -> DataFrame:
    narrow = with_measures(clean.rows).select(POS, CHUNK, CUSTOMER, *MEASURES)
    return member_figures(clean.with_rows(narrow), CUSTOMER_PREFIX, CUSTOMER, measures, mark=ORDERS)


def customer_figures(clean: Ordered, kinds: list[str]) -> DataFrame:
    """Totals, metrics and quotes since the last order of each customer, by position, placed
    by chunk. ``quotes_since_last_order`` is null without a customer; see ``without_customer``.
    """
    figures = _customers(clean, _measures_of([*kinds, "aov"]))
    return figures.selectExpr(
        POS,
        CHUNK,
        *[metric(CUSTOMER_PREFIX, k, f"{CUSTOMER_PREFIX}_{k}") for k in kinds],
        f"double({prior_name(CUSTOMER_PREFIX, SPENT)}) AS cust_tot_spend",
        f"bigint({prior_name(CUSTOMER_PREFIX, ORDERS)}) AS cust_tot_orders",
        f"{prior_name(CUSTOMER_PREFIX, 'since')} AS quotes_since_last_order",
    )


def without_customer(rows: DataFrame) -> DataFrame:
    """Quotes since the last order where there is no customer: 1 for an order, else 0."""
    since = F.coalesce("quotes_since_last_order", F.col("whether_order").cast("bigint"))
    return rows.withColumn("quotes_since_last_order", since)


def order_epochs(clean: Ordered) -> DataFrame:
    """Per customer the orders so far (``order_grp``) and the row's place after the last
    of them, from 0 (``quotes_since``). Without a customer both are 0."""
    orders, since = prior_name(CUSTOMER_PREFIX, ORDERS), prior_name(CUSTOMER_PREFIX, "since")
    rows = beside(clean, _customers(clean, [ORDERS]))
    return rows.selectExpr(
        *clean.rows.columns,
        f"CASE WHEN {CUSTOMER} IS NULL THEN 0L ELSE {orders} + whether_order END AS order_grp",
        # An order begins its own epoch; before the first order places count from 0 as well.
        f"CASE WHEN {CUSTOMER} IS NULL OR whether_order = 1 THEN 0L WHEN {orders} = 0 THEN {since} - 1"
        f" ELSE {since} END AS quotes_since",
    )


LAGGED = {"amt": AMOUNT, "order": "whether_order", "sc": "sales_cycle"}
LAGGED_OVERALL = {"amt": "amt_lag", "order": "whether_order_lag", "sc": "sales_cycle_lag"}


def lag_columns(
    clean: Ordered, kinds: Iterable[str] = tuple(LAGGED), groups: dict[str, str] | None = None, everything: bool = True
) -> DataFrame:
    """``<group>_<kind>_lag``: amount, order flag and sales cycle of the group's previous row, by
    position, for all eight groupings; with ``everything`` also those of the row before.

    One exchange of narrow rows serves all groupings, customers among them.
    """
    kinds, groups = list(kinds), dict(GROUPS if groups is None else groups)
    columns = [LAGGED[k] for k in kinds]
    narrow = clean.rows.select(POS, CHUNK, *groups.values(), *columns)
    lagged = add_shared_previous(clean.with_rows(narrow), groups, columns, EVERYTHING if everything else None)
    overall = [f"{prior_name(EVERYTHING, LAGGED[k])} AS {LAGGED_OVERALL[k]}" for k in kinds if everything]
    return lagged.rows.selectExpr(
        POS, CHUNK, *overall, *[f"{prior_name(g, LAGGED[k])} AS {g}_{k}_lag" for g in groups for k in kinds]
    )


def history_features(clean: Ordered, cycles: bool = True) -> DataFrame:
    """Clean quotes with all 30 features (21 without sales cycles).

    The customer windows take one exchange, all others share one; both move keys and
    measures only. The wide rows move once, to meet the figures.
    """
    kinds = [k for k in METRICS if cycles or k != "asc"]
    customers = customer_figures(clean, kinds)
    shared = shared_figures(clean, SHARED_GROUPS, kinds, everything=True, fallback=True)
    rows = without_customer(beside(clean, customers, shared)).drop(POS, CHUNK)
    # The customer's metrics meet those over all quotes only here.
    instead = {f"{CUSTOMER_PREFIX}_{k}": GLOBAL_METRICS[k] for k in kinds}
    return rows.selectExpr(
        *[
            f"CASE WHEN {c} = 0 THEN {instead[c]} ELSE {c} END AS {c}" if c in instead else c
            for c in rows.columns
        ]
    )


def running_totals(
    df: DataFrame, keys: list[str], amount: str, totals: dict[str, str], partitions: int | None = None
) -> DataFrame:
    """Sum ``amount`` per ``keys``, then running totals in the order of ``keys``.

    ``totals`` maps a new column to the key it runs over. Rows with a missing key are
    left out, as in any grouping of the reference.
    """
    summed = df.na.drop(subset=keys).groupBy(*keys).agg(F.sum(amount).alias(amount))
    ordered = number_rows(summed, [F.col(k) for k in keys], "totals", partitions)
    prior = add_shared_prior(ordered, totals, [amount])
    return prior.rows.selectExpr(
        *keys, amount, *[f"{prior_name(t, amount)} + {amount} AS {t}" for t in totals]
    )
