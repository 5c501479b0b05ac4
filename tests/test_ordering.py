"""Prior sums, lags and totals against brute force, with hot and missing keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from small import by_seq

from leadtide.operators import history, metrics
from leadtide.operators.cleaning import clean_quotes, dedupe_orders, order_quotes
from leadtide.operators.ordering import (
    CHUNKS,
    TASK_ROWS,
    add_shared_previous,
    add_shared_prior,
    beside,
    chunk_size,
    member_figures,
    number_rows,
)
from leadtide.sources import testdata

N = 600
SCHEMA = "src_seq bigint, day int, who bigint, kind string, n bigint"
# One task for all, several chunks, and chunks far smaller than the hot groups.
SHAPES = [(1, 10_000), (5, 10_000), (5, 20), (3, 7)]


def skewed(seed=7):
    """A third of the rows share one key, a third one day, a tenth have no key."""
    rng = random.Random(seed)
    rows = []
    for seq in range(N):
        who = 0 if rng.random() < 0.33 else rng.randrange(1, 200)
        rows.append((
            seq,
            3 if rng.random() < 0.33 else rng.choice([None, *range(10)]),
            None if rng.random() < 0.1 else who,
            rng.choice(["a", "a", "a", "b", "c", None]),
            rng.randrange(-5, 50),
        ))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))


def numbered(spark, rows, shape):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    partitions, task_rows = shape
    order = [F.col("day").asc_nulls_last(), F.col("src_seq")]
    return number_rows(df, order, "test", partitions, task_rows)


def brute_prior(rows, key):
    sums, result = defaultdict(int), {}
    for r in in_order(rows):
        group = key(r)
        result[r[0]] = 0 if group is None else sums[group]
        if group is not None:
            sums[group] += r[4]
    return result


@pytest.mark.parametrize("shape", SHAPES)
def test_numbering_is_the_order_and_chunks_are_bounded(spark, shape):
    rows = skewed()
    ordered = numbered(spark, rows, shape)
    got = [r["src_seq"] for r in ordered.rows.orderBy("pos").collect()]
    assert got == [r[0] for r in in_order(rows)]
    sizes = [r["count"] for r in ordered.rows.groupBy("chunk").count().collect()]
    assert sum(sizes) == ordered.n_rows == N
    assert max(sizes) <= shape[1]
    assert ordered.rows.agg(F.max("chunk")).first()[0] < ordered.n_chunks


@pytest.mark.parametrize("shape", SHAPES)
def test_shared_prior_sums(spark, shape):
    rows = skewed()
    prior = add_shared_prior(
        numbered(spark, rows, shape), {"who": "who", "kind": "kind"}, ["n"], everything="all"
    )
    got = by_seq(prior.rows, "who__n", "kind__n", "all__n")
    who, kind = brute_prior(rows, lambda r: r[2]), brute_prior(rows, lambda r: r[3])
    everything = brute_prior(rows, lambda r: 1)
    assert got == {s: (who[s], kind[s], everything[s]) for s in who}


@pytest.mark.parametrize("shape", SHAPES)
def test_member_figures(spark, shape):
    rows = skewed()
    ordered = numbered(spark, rows, shape)
    marked = ordered.with_rows(ordered.rows.withColumn("mark", F.when(F.col("n") % 9 == 0, 1).otherwise(0)))
    figures = member_figures(marked, "who", "who", ["n", "mark"], "mark", {"before": "n", "kind_before": "kind"})
    got = by_seq(beside(marked, figures), "who__n", "who__mark", "who__since", "before", "kind_before")
    sums, marks, since, last, want = defaultdict(int), defaultdict(int), defaultdict(int), {}, {}
    for seq, _, who, kind, n in in_order(rows):
        if who is None:
            want[seq] = (0, 0, None, None, None)
            continue
        want[seq] = (sums[who], marks[who], since[who] + 1, *last.get(who, (None, None)))
        sums[who] += n
        marks[who] += n % 9 == 0
        since[who] = 0 if n % 9 == 0 else since[who] + 1
        last[who] = n, kind
    assert got == want


@pytest.mark.parametrize("shape", SHAPES)
def test_shared_previous_rows(spark, shape):
    rows = skewed()
    ordered = numbered(spark, rows, shape)
    lagged = add_shared_previous(ordered, {"who": "who", "kind": "kind"}, ["n", "day"], everything="all")
    got = by_seq(lagged.rows, "who__n", "who__day", "kind__n", "all__n")
    last, want = {}, {}
    for seq, day, who, kind, n in in_order(rows):
        old = [last.get(("who", who), (0, 0)), last.get(("kind", kind), (0, 0)), last.get("all", (0, 0))]
        want[seq] = (old[0][0], old[0][1] or 0, old[1][0], old[2][0])
        last["all"] = n, day
        last |= {(name, key): (n, day) for name, key in (("who", who), ("kind", kind)) if key is not None}
    assert got == want


def test_customer_figures_need_one_exchange_of_the_rows(spark):
    """The rows move once and are read once; states and what they give move narrow."""
    ordered = numbered(spark, skewed(), (4, 20))
    marked = ordered.with_rows(ordered.rows.withColumn("mark", F.when(F.col("n") % 9 == 0, 1).otherwise(0)))
    figures = member_figures(marked, "who", "who", ["n"], "mark", {"before": "n"})
    figures.collect()
    plan = figures._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = [line for line in plan.splitlines() if "Exchange " in line and "Broadcast" not in line]
    # The rows and what they get by chunk, the states by member; the rows' exchange serves twice.
    assert sum("ReusedExchange" in line for line in lines) == 1 and len(lines) == 4
    assert plan.count("FileScan") == 1 and "SinglePartition" not in plan


def test_lag_columns_need_one_exchange_of_the_rows(spark, folder):
    report, enrich = testdata.report(spark, folder), testdata.enrichment(spark, folder)
    clean = clean_quotes(report, enrich, 4, task_rows=50)
    lagged = history.lag_columns(clean)
    assert len([c for c in lagged.columns if c.endswith("_lag")]) == 27
    lines = exchanges(lagged)
    assert sum("passthrough" in line for line in lines) == 1 and len(lines) == 3
    whole = history.lag_columns(clean_quotes(report, enrich, 1)).drop("pos", "chunk")
    assert whole.exceptAll(lagged.drop("pos", "chunk")).count() == 0 and lagged.count() == whole.count() > 0


def test_input_partitioning_does_not_matter(spark, folder):
    report, enrich = testdata.report(spark, folder), testdata.enrichment(spark, folder)
    one = history.history_features(clean_quotes(report, enrich, 1))
    many = history.history_features(clean_quotes(report.repartition(7), enrich, 6, task_rows=40))
    assert one.count() > 0
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_features_do_not_see_later_rows(spark, folder):
    report, enrich = testdata.report(spark, folder), testdata.enrichment(spark, folder)
    clean = clean_quotes(report, enrich, 4)
    whole = history.history_features(clean)
    some = history.history_features(
        clean.with_rows(clean.rows.filter("request_ts < timestamp_ntz'1997-01-01'"))
    )
    assert 0 < some.count() < whole.count()
    assert some.exceptAll(whole).count() == 0


def test_hot_customer_order_and_quote(spark):
    """A third of all rows share a customer and an order; another third one open quote."""
    n = 300
    report = spark.range(n).selectExpr(
        "id AS src_seq",
        "CASE WHEN id % 3 = 1 THEN 'open' ELSE string(id) END AS quote_no",
        "timestamp_ntz'2017-01-01' AS request_ts",
        "CASE WHEN id % 3 <> 1 THEN timestamp_ntz'2017-01-05' END AS accept_ts",
        "'Custom Box' AS product",
        "CASE id % 3 WHEN 0 THEN '500' WHEN 2 THEN string(id) END AS order_number",
        "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS customer_no",
        "cast(1 + id % 5 AS decimal(18,2)) AS paid_amount",
        "'Ann' AS sales_rep",
    )
    columns = "customer_no bigint, industry_category string, industry_sub_category string,"
    enrich = spark.createDataFrame([], columns + "range_employees string, range_revenue string")
    quotes = order_quotes(report, enrich, 3, task_rows=10)
    amounts = by_seq(dedupe_orders(quotes).rows, "paid_amount")
    opened = sum(1 + i % 5 for i in range(n) if i % 3 == 1)
    assert len(amounts) == 1 + n // 3 + n // 3
    assert {float(v[0]) for s, v in amounts.items() if s % 3 == 1} == {float(opened)}
    assert float(amounts[0][0]) == 1.0


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_shared_windows_need_one_exchange_of_the_rows(spark):
    ordered = numbered(spark, skewed(), (4, 10_000))
    lines = exchanges(add_shared_prior(ordered, {"who": "who", "kind": "kind"}, ["n"], "all").rows)
    # The rows' own exchange, and two of the chunk totals.
    assert sum("passthrough" in line for line in lines) == 1
    assert len(lines) == 3
    assert not any("SinglePartition" in line for line in lines)


def test_row_level_plans_have_no_single_partition(spark, folder):
    report, enrich = testdata.report(spark, folder), testdata.enrichment(spark, folder)
    features = history.history_features(clean_quotes(report, enrich, 4, task_rows=50))
    assert not any("SinglePartition" in line for line in exchanges(features))


@pytest.mark.parametrize("partitions", [1, 4])
def test_auc_equals_pair_counting(spark, partitions):
    rng = random.Random(3)
    rows = [(f"m{i % 2}", rng.randrange(2), 0.0, rng.randrange(12) / 12) for i in range(400)]
    scored = spark.createDataFrame(rows, "report string, label int, prediction double, score double")
    got = {r["report"]: r["auc"] for r in metrics.auc(scored, "report", partitions).collect()}
    for name in ("m0", "m1"):
        ones = [r[3] for r in rows if r[0] == name and r[1] == 1]
        zeros = [r[3] for r in rows if r[0] == name and r[1] == 0]
        won = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
        assert got[name] == pytest.approx(won / len(ones) / len(zeros), abs=1e-12)


def test_running_totals_toy(spark):
    rows = [
        ("x", "2010-05-01", "x1", "a", 1), ("x", "2010-05-01", "x1", "a", 2),
        ("x", "2010-01-02", "x2", "b", 3), ("y", "2010-02-04", "y1", "a", 4),
        ("y", "2010-04-05", "y2", "b", 5), ("y", "2010-04-05", "y2", "b", 6),
    ]
    df = spark.createDataFrame(rows, "id string, date string, order string, type string, amt int")
    totals = history.running_totals(
        df, ["id", "date", "order", "type"], "amt", {"cust_tot": "id", "type_tot": "type"}, 3
    )
    assert sorted(tuple(r) for r in totals.collect()) == [
        ("x", "2010-01-02", "x2", "b", 3, 3, 3),
        ("x", "2010-05-01", "x1", "a", 3, 6, 3),
        ("y", "2010-02-04", "y1", "a", 4, 4, 7),
        ("y", "2010-04-05", "y2", "b", 11, 15, 14),
    ]


def test_chunks_do_not_grow_with_the_table(spark):
    df = spark.range(3000).withColumn("n", F.col("id") % 7).repartition(4)
    ordered = number_rows(df, [F.col("id")], "test", 2, task_rows=2)
    assert ordered.n_chunks <= 2 * CHUNKS
    assert chunk_size(3000, 2) == -(-3000 // CHUNKS)
    assert chunk_size(600, 7) == 7 and chunk_size(10**12, 7) == TASK_ROWS
    prior = add_shared_prior(ordered, {"n": "n"}, ["id"]).rows
    got = {r["id"]: r["n__id"] for r in prior.collect()}
    assert got == {i: sum(range(i % 7, i, 7)) for i in range(3000)}
