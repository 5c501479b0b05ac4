"""One small case per semantic rule."""

from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small import at, by_seq, enrich, quote, report

from leadtide.functions import columns as fx
from leadtide.operators import cleaning, history, prep


def clean(spark, *rows, customers=()):
    return cleaning.clean_quotes(report(spark, *rows), enrich(spark, *customers))


def features(spark, *rows, customers=()):
    return history.history_features(clean(spark, *rows, customers=customers))


def test_missing_customers_match_each_other(spark):
    rows = report(spark, quote(1, customer=None), quote(2, customer=5))
    attributes = enrich(spark, (None, "a", "b", "c", "d"))
    joined = by_seq(cleaning.enrich_quotes(rows, attributes), "industry_category")
    assert joined == {1: ("a",), 2: (None,)}


def test_order_has_missing_requests_last_and_ties_by_place(spark):
    ordered = cleaning.order_quotes(
        report(
            spark,
            quote(1, request=None),
            quote(2, request=at(2)),
            quote(4, request=at(1), accept=at(3), order="7"),
            quote(3, request=at(1), accept=at(3), order="8"),
            quote(5, request=at(1), accept=at(2), order="9"),
        ),
        enrich(spark),
    )
    assert [r["src_seq"] for r in ordered.rows.orderBy("pos").collect()] == [5, 3, 4, 2, 1]


def test_new_customer_looks_one_row_back_before_the_dedupe(spark):
    rows = clean(
        spark,
        quote(1, request=at(1), amount=10, order="1"),
        quote(2, request=at(2)),
        quote(3, request=at(3)),
        quote(4, request=at(4), amount=5, order="1"),
        quote(5, request=at(5)),
        quote(6, request=at(6), customer=None, amount=9, order="2"),
        quote(7, request=at(7), customer=None),
    ).rows
    flags = by_seq(rows, "whether_new")
    # Row 4 repeats order 1 and is dropped, yet row 5 has seen its amount.
    assert flags == {1: (1,), 2: (0,), 3: (1,), 5: (0,), 6: (1,), 7: (1,)}


def test_days_are_floored_day_lengths(spark):
    rows = spark.createDataFrame(
        [(1, at(10), at(8, 23)), (2, at(10), at(10, 23)), (3, at(10), at(11)), (4, None, at(1))],
        "src_seq int, a timestamp_ntz, b timestamp_ntz",
    )
    days = rows.select("src_seq", fx.floored_days(F.col("a"), F.col("b")).alias("days"))
    assert by_seq(days, "days") == {1: (-2,), 2: (0,), 3: (1,), 4: (None,)}


def test_close_flags_and_order_flag(spark):
    rows = clean(
        spark,
        quote(1, request=at(1), accept=at(4, 23), order="1"),
        quote(2, request=at(1), accept=at(5), order="2", amount=-3),
        quote(3, request=at(9), accept=at(5), order="3", amount=1),
        quote(4, request=at(1), accept=at(15, 23), order="4", amount=2),
        quote(5, request=at(1), accept=at(16), order="5", amount=2),
        quote(6, request=at(1)),
        quote(7, request=None, accept=at(1), order="6", amount=2),
    ).rows
    assert by_seq(rows, "close_3d", "close_2w", "whether_order", "sales_cycle") == {
        1: (1, 1, 0, 0),
        2: (0, 1, 1, 4),
        3: (1, 1, 1, -4),
        4: (0, 1, 1, 14),
        5: (0, 0, 1, 15),
        6: (0, 0, 0, 0),
        7: (0, 0, 1, None),
    }


def test_history_excludes_the_row_and_looks_ahead_of_acceptance(spark):
    rows = features(
        spark,
        quote(1, request=at(1), accept=at(30), order="1", amount=100),
        quote(2, request=at(2)),
        quote(3, request=at(3)),
    )
    got = by_seq(rows, "aov", "avg_close_rate", "avg_sales_cycle", "cust_tot_spend")
    # The order of quote 1 is accepted after quote 2 was requested, and still counts.
    assert got == {1: (0, 0, 0, 0), 2: (100, 1, 29, 100), 3: (100, 0.5, 29, 100)}


def test_a_zero_metric_falls_back_to_all_quotes(spark):
    rows = features(
        spark,
        quote(1, request=at(1), order="1", accept=at(2), amount=50, product="Bag"),
        quote(2, request=at(2), product="Box", customer=2),
        quote(3, request=at(3), product="Box", customer=2),
    )
    got = by_seq(rows, "product_aov", "product_close_rate", "cust_close_rate")
    # Quote 3 has an earlier Box quote without an order: a true zero is replaced too.
    assert got[3] == (50, 0.5, 0.5)


def test_missing_keys_are_no_group(spark):
    rows = features(
        spark,
        quote(1, request=at(1), order="1", accept=at(2), amount=50, rep=None, customer=None),
        quote(2, request=at(2), rep=None, customer=None),
        quote(3, request=at(3), order="2", accept=at(4), amount=70, rep=None, customer=None),
    )
    columns = ("sales_rep_aov", "cust_tot_spend", "cust_tot_orders", "quotes_since_last_order")
    # The rep's figures are those of all quotes.
    assert by_seq(rows, *columns) == {1: (0, 0, 0, 1), 2: (50, 0, 0, 0), 3: (50, 0, 0, 1)}


def test_dedupe_keeps_the_first_row_with_its_own_quotes_sum(spark):
    rows = clean(
        spark,
        quote(1, quote="A", request=at(1), order="77-X", amount=10),
        quote(2, quote="A", request=at(2), order="77", amount=5),
        quote(3, quote="B", request=at(3), order="77", amount=1000),
        quote(4, quote="C", request=at(4), amount=2),
        quote(5, quote="C", request=at(5), amount=3),
    ).rows
    assert by_seq(rows, "paid_amount", "order_number") == {
        1: (Decimal("15.00"), "77"),
        4: (Decimal("5.00"), "no_order"),
        5: (Decimal("5.00"), "no_order"),
    }


def test_text_only_order_numbers_become_one_order(spark):
    rows = clean(
        spark,
        quote(1, request=at(1), order="pending", amount=1),
        quote(2, request=at(2), order="void", amount=1),
        quote(3, request=at(3), order="12ab", amount=1),
    ).rows
    assert by_seq(rows, "order_number") == {1: ("",), 3: ("12",)}


def test_quotes_since_last_order(spark):
    paid = {"amount": 5}
    rows = features(
        spark,
        quote(1, request=at(1)),
        quote(2, request=at(2)),
        quote(3, request=at(3), order="1", **paid),
        quote(4, request=at(4)),
        quote(5, request=at(5), order="2", **paid),
        quote(6, request=at(6), order="3", **paid),
        quote(7, request=at(7)),
    )
    since = by_seq(rows, "quotes_since_last_order")
    assert [since[i][0] for i in range(1, 8)] == [1, 2, 3, 1, 2, 1, 1]


def test_scaling_uses_the_population_and_keeps_constants_at_zero(spark):
    rows = spark.createDataFrame([(1, 1.0, 7.0), (2, 3.0, 7.0)], "src_seq int, x double, y double")
    scaling = prep.fit_scaling(rows, ["x", "y"])
    assert by_seq(scaling.apply(rows), "x", "y") == {1: (-1, 0), 2: (1, 0)}
    assert by_seq(scaling.apply(rows, "_z"), "x", "x_z") == {1: (1, -1), 2: (3, 1)}


def test_scaling_is_saved_and_loaded(spark, tmp_path):
    scaling = prep.Scaling({"x": 1.5, "y": -2e-9}, {"x": 0.25, "y": 0.0})
    scaling.save(spark, str(tmp_path / "scaling"))
    assert prep.Scaling.load(spark, str(tmp_path / "scaling")) == scaling


def test_rep_is_neutralized_with_scaled_figures(spark):
    rows = spark.createDataFrame([(1, 0.5, 9.0)], "src_seq int, aov double, sales_rep_aov double")
    assert by_seq(prep.neutralize_rep(rows), "sales_rep_aov") == {1: (0.5,)}


def test_small_values_are_clipped(spark):
    rows = spark.createDataFrame([(1, 19.9), (2, 20.0), (3, -4.0)], "src_seq int, v double")
    clipped = rows.select("src_seq", fx.clip_small(F.col("v")).alias("v"))
    assert by_seq(clipped, "v") == {1: (0.0,), 2: (20.0,), 3: (0.0,)}


def test_the_split_is_stable_and_near_a_quarter(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "src_seq")
    once = {r[0] for r in prep.split(rows)[1].collect()}
    again = {r[0] for r in prep.split(rows.repartition(13))[1].collect()}
    assert once == again
    assert len(once) / 20_000 == pytest.approx(0.25, abs=0.01)


def test_features_are_numbered_by_name(spark):
    rows = spark.createDataFrame([(1, 3.0, 2.0)], "src_seq int, b double, a double")
    assert prep.numbered_features(rows, keep=["src_seq"]).first().asDict() == {
        "src_seq": 1, "f0": 2.0, "f1": 3.0,
    }


def test_helper_columns_are_dropped(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "b int, x_lag int, a int, whether_order int")
    assert prep.drop_auxiliary(rows).columns == ["a", "b"]


def test_scaling_sums_are_exact_in_batches_of_columns():
    """Nulls left out, negative numbers, and sums beyond a long."""
    values = [None, *[(-1) ** i * (2.0**59 + i) for i in range(70_000)]]
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.float64())], ["c0"])
    found = next(prep._exact_sums([(1.0, 1.0)])(iter([batch]))).to_pylist()[0]
    whole = [int(v) for v in values[1:]]
    assert found["n"] == len(whole) and found["s"] == sum(whole)
    squares = (int(found["hh"]) << 2 * prep.HALF) + (int(found["hl"]) << prep.HALF + 1) + int(found["ll"])
    assert squares == sum(w * w for w in whole)
