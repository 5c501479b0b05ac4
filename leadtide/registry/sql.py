"""The steps of the pipeline as plain DuckDB SQL, to check the Spark results against."""

from __future__ import annotations

from leadtide.schema import FEATURES, GROUPS, VALUE_FEATURES

REPORT = """report AS (
  SELECT o_orderkey * 10 + part_no AS src_seq,
    CASE WHEN o_orderkey % 211 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS quote_no,
    o_orderdate AS request_ts,
    CASE WHEN o_orderstatus <> 'P'
      THEN o_orderdate + to_hours(CAST((o_orderkey * 37) % 720 AS INTEGER)) END AS accept_ts,
    'Custom ' || p_name AS product,
    CASE WHEN o_orderstatus <> 'P'
      THEN CAST(o_orderkey - o_orderkey % 2 AS VARCHAR)
        || CASE WHEN o_orderkey % 3 = 0 THEN '-A' ELSE '' END END AS order_number,
    CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS customer_no,
    CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS paid_amount,
    CASE WHEN o_orderkey % 11 <> 0 THEN s_name END AS sales_rep
  FROM orders
  JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
  JOIN supplier ON s_suppkey = o_orderkey % (SELECT count(*) FROM supplier)
  JOIN (VALUES (0), (1)) AS payments(part_no) ON part_no = 0 OR o_orderkey % 7 = 0)"""

ENRICH = """enrich AS (
  SELECT c_custkey AS customer_no, c_mktsegment AS industry_category,
    n_name AS industry_sub_category,
    CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS range_employees,
    r_name AS range_revenue
  FROM customer
  JOIN nation ON n_nationkey = c_nationkey
  JOIN region ON r_regionkey = n_regionkey
  WHERE c_custkey % 5 <> 0)"""

JOINED = """joined AS (
  SELECT r.*, e.industry_category, e.industry_sub_category, e.range_employees, e.range_revenue
  FROM report r LEFT JOIN enrich e ON r.customer_no IS NOT DISTINCT FROM e.customer_no)"""

QUOTES = """quotes AS (
  SELECT src_seq, quote_no, request_ts,
    coalesce(accept_ts, TIMESTAMP '2100-01-01 00:00:00') AS accept_ts,
    regexp_replace(product, '^Custom ', '') AS product,
    coalesce(regexp_replace(order_number, '[^0-9]+$', ''), 'no_order') AS order_number,
    customer_no, coalesce(paid_amount, 0) AS paid_amount,
    coalesce(industry_category, 'personal') AS industry_category,
    coalesce(industry_sub_category, 'personal') AS industry_sub_category,
    coalesce(range_employees, 'personal') AS range_employees,
    coalesce(range_revenue, 'personal') AS range_revenue,
    sales_rep
  FROM joined WHERE quote_no IS NOT NULL)"""

ORD = "ORDER BY request_ts ASC NULLS LAST, accept_ts, src_seq"

FLAGGED = f"""flagged AS (
  SELECT *, CASE WHEN customer_no IS NOT NULL
      AND coalesce(lag(paid_amount) OVER (PARTITION BY customer_no {ORD}), 0) <> 0
    THEN 0 ELSE 1 END AS whether_new
  FROM quotes)"""

DEDUPED = f"""deduped AS (
  SELECT * EXCLUDE (paid_amount, total, place),
    CAST(total AS DECIMAL(28,2)) AS paid_amount
  FROM (
    SELECT *, sum(paid_amount) OVER (PARTITION BY quote_no, order_number) AS total,
      row_number() OVER (PARTITION BY order_number {ORD}) AS place
    FROM flagged)
  WHERE place = 1 OR order_number = 'no_order')"""

DAYS = "CAST(floor(date_diff('second', request_ts, accept_ts) / 86400.0) AS INTEGER)"
CLEAN = f"""clean AS MATERIALIZED (
  SELECT *,
    CASE WHEN days < 4 THEN 1 ELSE 0 END AS close_3d,
    CASE WHEN days < 15 THEN 1 ELSE 0 END AS close_2w,
    CASE WHEN paid_amount = 0 THEN 0 ELSE 1 END AS whether_order,
    days * CASE WHEN paid_amount = 0 THEN 0 ELSE 1 END AS sales_cycle
  FROM (SELECT *, {DAYS} AS days FROM deduped))"""

PRIOR = f"{ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _ratio(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 0)"


def _metrics(window: str, names: dict[str, str], key: str | None = None) -> list[str]:
    amount, orders, cycle, rows = (
        f"sum({c}) OVER {window}"
        for c in ("paid_amount", "whether_order", "coalesce(sales_cycle, 0)", "1")
    )
    ratios = {
        "aov": _ratio(amount, orders),
        "close_rate": _ratio(orders, rows),
        "asc": _ratio(cycle, orders),
    }
    guard = f"CASE WHEN {key} IS NULL THEN 0 ELSE {{}} END" if key else "{}"
    return [f"{guard.format(ratios[k])} AS {n}" for k, n in names.items()]


def _history() -> str:
    columns = _metrics("w_all", {"aov": "aov", "close_rate": "avg_close_rate", "asc": "avg_sales_cycle"})
    windows = [f"w_all AS ({PRIOR})"]
    for group, key in GROUPS.items():
        columns += _metrics(f"w_{group}", {k: f"{group}_{k}" for k in ("aov", "close_rate", "asc")}, key)
        windows.append(f"w_{group} AS (PARTITION BY {key} {PRIOR})")
    for name, c, kind in (
        ("cust_tot_spend", "paid_amount", "DOUBLE"),
        ("cust_tot_orders", "whether_order", "BIGINT"),
    ):
        columns.append(
            f"CAST(CASE WHEN customer_no IS NULL THEN 0 ELSE coalesce(sum({c}) OVER w_cust, 0) END"
            f" AS {kind}) AS {name}"
        )
    return (
        "history AS (SELECT *, " + ",\n".join(columns)
        + ",\nCASE WHEN customer_no IS NULL THEN 0 ELSE"
        f" sum(whether_order) OVER (PARTITION BY customer_no {ORD}) END AS order_grp"
        + "\nFROM clean WINDOW " + ", ".join(windows) + ")"
    )


HISTORY = _history()

# Quotes since the last order, step by step.
SINCE = f"""epochs AS (
  SELECT *, CASE WHEN customer_no IS NULL THEN 0 ELSE
    row_number() OVER (PARTITION BY customer_no, order_grp {ORD}) - 1 END AS quotes_since
  FROM history),
since AS (
  SELECT * EXCLUDE (q), CAST(CASE
    WHEN customer_no IS NULL THEN whether_order
    WHEN whether_order = 1 THEN coalesce(lag(q) OVER (PARTITION BY customer_no {ORD}), 0) + 1
    ELSE q END AS BIGINT) AS quotes_since_last_order
  FROM (SELECT *, CASE WHEN order_grp = 0 THEN quotes_since + 1 ELSE quotes_since END AS q
    FROM epochs))"""


def _fallback() -> str:
    replaced = [
        f"CASE WHEN {g}_{k} = 0 THEN {o} ELSE {g}_{k} END AS {g}_{k}"
        for g in GROUPS
        for k, o in (("aov", "aov"), ("close_rate", "avg_close_rate"), ("asc", "avg_sales_cycle"))
    ]
    return f"feat AS MATERIALIZED (SELECT * REPLACE ({', '.join(replaced)}) FROM since)"


FALLBACK = _fallback()


def scaled_step(features: list[str], name: str) -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in features)
    columns = ", ".join(
        f"({c} - m_{c}) / CASE WHEN d_{c} = 0 THEN 1 ELSE d_{c} END AS {c}" for c in features
    )
    return (
        f"{name}_stats AS (SELECT {stats} FROM feat),\n"
        f"{name} AS (SELECT feat.* REPLACE ({columns}) FROM feat, {name}_stats)"
    )


SCALED = scaled_step(FEATURES, "scaled")
SCALED_VALUE = scaled_step(VALUE_FEATURES, "scaled_value")
IS_TEST = "substr(md5(CAST(src_seq AS VARCHAR) || ':31'), 1, 2) < '40'"

STEPS = [REPORT, ENRICH, JOINED, QUOTES, FLAGGED, DEDUPED, CLEAN, HISTORY, SINCE, FALLBACK, SCALED, SCALED_VALUE]


def after(last: str, select: str) -> str:
    """``select`` on top of the steps up to ``last``."""
    steps = STEPS[: STEPS.index(last) + 1]
    return "WITH " + ",\n".join(steps) + "\n" + select
