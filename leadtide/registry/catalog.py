"""All queries over the test tables, each next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.functions import columns as fx
from leadtide.operators import cleaning, history, metrics, models, ordering, prep, scoring
from leadtide.operators.metrics import LABEL, PREDICTION, SCORE
from leadtide.plans import close_rate, lead_value, trainer
from leadtide.registry import sql
from leadtide.schema import (
    ACCEPT,
    AMOUNT,
    CUSTOMER,
    DEFAULT_MISSING,
    EXPORT_FEATURES,
    FEATURES,
    GROUPS,
    INDUSTRY,
    LABELS,
    ORDER,
    PRODUCT,
    QUOTE,
    QUOTE_COLUMNS,
    REP,
    REPORT_MISSING,
    REQUEST,
    SEQ,
    SHARED_GROUPS,
    TIMESTAMP_FORMAT,
    VALUE_FEATURES,
)
from leadtide.sources import files, testdata
from leadtide.streaming import scores as streams
from leadtide.workspace import fresh_path, release

#: Rows of a chunk here: few, so that the small test tables go through several chunks.
CHUNK_ROWS = 5_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The queries as functions of ``Tables``.
BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}


@dataclass
class Tables:
    """The test tables of one folder and the pipeline steps over them."""

    spark: SparkSession
    folder: str
    #: Fewer boosting rounds and net iterations than the models' own, for quick runs.
    rounds: int | None = None

    @property
    def limit(self) -> dict[str, int]:
        return {"rounds": self.rounds} if self.rounds else {}

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.folder, name)

    @property
    def report(self) -> DataFrame:
        return testdata.report(self.spark, self.folder)

    @property
    def enrich(self) -> DataFrame:
        return testdata.enrichment(self.spark, self.folder)

    @cached_property
    def filled(self) -> DataFrame:
        valid = cleaning.valid_quotes(self.report)
        return cleaning.fill_missing(cleaning.enrich_quotes(valid, self.enrich))

    @cached_property
    def quotes(self) -> ordering.Ordered:
        return cleaning.order_quotes(self.report, self.enrich, task_rows=CHUNK_ROWS)

    @cached_property
    def clean(self) -> ordering.Ordered:
        return cleaning.clean_quotes(self.report, self.enrich, task_rows=CHUNK_ROWS)

    @cached_property
    def features(self) -> DataFrame:
        return history.history_features(self.clean)

    @cached_property
    def _scaled(self) -> tuple[DataFrame, DataFrame, prep.Scaling]:
        return close_rate.scaled_table(self.features)

    @property
    def both(self) -> tuple[DataFrame, DataFrame]:
        return self._scaled[:2]

    @property
    def raw_and_scaling(self) -> tuple[DataFrame, prep.Scaling]:
        return self._scaled[0], self._scaled[2]

    @cached_property
    def _scaled_values(self) -> tuple[DataFrame, DataFrame, prep.Scaling]:
        return lead_value.scaled_table(lead_value.value_table(self.report, self.enrich, task_rows=CHUNK_ROWS))

    @property
    def both_values(self) -> tuple[DataFrame, DataFrame]:
        return self._scaled_values[:2]

    @property
    def raw_values_and_scaling(self) -> tuple[DataFrame, prep.Scaling]:
        return self._scaled_values[0], self._scaled_values[2]

    def path(self, name: str) -> str:
        return fresh_path(self.spark, name)


def query(check: str | None = None):
    """Register a function of ``Tables`` under its name, with its SQL if there is one."""

    def register(build: Callable[[Tables], DataFrame]):
        name = build.__name__
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if check is not None:
            ORACLES[name] = check
        return build

    return register


def names(*columns: str) -> str:
    return ", ".join(columns)


def rounded(columns: list[str], digits: int = 4) -> list[str]:
    return [f"round({c}, {digits}) AS {c}" for c in columns]


# --- Sources and sinks ---------------------------------------------------------------

REPORT_COLUMNS = [SEQ, QUOTE, REQUEST, ACCEPT, PRODUCT, ORDER, CUSTOMER, AMOUNT, REP]


@query(sql.after(sql.REPORT, f"SELECT {names(*REPORT_COLUMNS)} FROM report"))
def csv_report_scan(t: Tables) -> DataFrame:
    path = t.path("report-csv")
    files.write_report(t.report, path, missing="Not quoted yet")
    return files.read_report(t.spark, path, row_id=SEQ).select(*REPORT_COLUMNS)


@query(
    sql.after(
        sql.REPORT,
        f"SELECT row_number() OVER (ORDER BY src_seq) - 1 AS src_seq, {names(*[c for c in REPORT_COLUMNS if c not in (SEQ, PRODUCT)])},"
        " product || ' 12\" x, y' AS product FROM report",
    )
)
def csv_report_numbered(t: Tables) -> DataFrame:
    """A report without row numbers, with quote marks and commas in its cells."""
    path = t.path("report-csv")
    odd = t.report.withColumn(PRODUCT, F.concat(PRODUCT, F.lit(' 12" x, y')))
    files.write_report(odd.repartitionByRange(SEQ).sortWithinPartitions(SEQ), path)
    return files.read_report(t.spark, path).select(*REPORT_COLUMNS)


_BROKEN = "{} || ' 12\" x,' || {} || 'y'"
_NUMBERED = f"SELECT row_number() OVER (ORDER BY src_seq) - 1 AS src_seq, {names(*[c for c in REPORT_COLUMNS if c not in (SEQ, PRODUCT)])}"


@query(sql.after(sql.REPORT, f"{_NUMBERED}, {_BROKEN.format('product', 'chr(10)')} AS product FROM report"))
def csv_multi_line_scan(t: Tables) -> DataFrame:
    """A report with line breaks, quote marks and commas in its cells, read in splits."""
    path = t.path("report-csv")
    odd = t.report.withColumn(PRODUCT, F.expr(_BROKEN.format(PRODUCT, "'\\n'")))
    files.write_report(odd.repartitionByRange(SEQ).sortWithinPartitions(SEQ), path)
    return files.read_report(t.spark, path, multi_line=True).select(*REPORT_COLUMNS)


# Cells that cannot be read: a date of another shape, a key with letters, a third decimal.
_BAD = {REQUEST: "src_seq % 17 = 0", CUSTOMER: "src_seq % 19 = 0 AND customer_no IS NOT NULL", AMOUNT: "src_seq % 23 = 0 AND paid_amount IS NOT NULL"}


def _report_with_bad_cells(t: Tables) -> str:
    """Whole keys are written with ``.0``, as for a column of numbers with gaps."""
    path = t.path("report-csv")
    cells = {
        REQUEST: f"date_format({REQUEST}, CASE WHEN {_BAD[REQUEST]} THEN 'yyyy/MM/dd' ELSE '{TIMESTAMP_FORMAT}' END)",
        CUSTOMER: f"concat({CUSTOMER}, CASE WHEN {_BAD[CUSTOMER]} THEN 'x' ELSE '.0' END)",
        AMOUNT: f"concat({AMOUNT}, CASE WHEN {_BAD[AMOUNT]} THEN '5' ELSE '' END)",
        PRODUCT: f"concat({PRODUCT}, '\\ny')",
    }
    text = t.report.withColumns({c: F.expr(e) for c, e in cells.items()})
    files.write_report(text.repartitionByRange(SEQ).sortWithinPartitions(SEQ), path)
    return path


_PLACED = f"WITH {sql.REPORT}, numbered AS (SELECT *, row_number() OVER (ORDER BY src_seq) - 1 AS place FROM report) SELECT place AS src_seq, "
_ANY_BAD = " OR ".join(f"({e})" for e in _BAD.values())


@query(
    _PLACED
    + names(*[c for c in REPORT_COLUMNS if c not in (SEQ, PRODUCT)])
    + f", product || chr(10) || 'y' AS product FROM numbered WHERE NOT ({_ANY_BAD})"
)
def csv_checked_rows(t: Tables) -> DataFrame:
    """The good rows of a report with bad cells; rejected rows keep their numbers."""
    return files.read_report_checked(t.spark, _report_with_bad_cells(t))[0].select(*REPORT_COLUMNS)


@query(
    f"{_PLACED} concat_ws(',', {', '.join(f'CASE WHEN {e} THEN {chr(39)}{c}{chr(39)} END' for c, e in _BAD.items())}) AS reasons"
    f" FROM numbered WHERE {_ANY_BAD}"
)
def csv_rejected_rows(t: Tables) -> DataFrame:
    rejects = files.read_report_checked(t.spark, _report_with_bad_cells(t))[1]
    return rejects.select(SEQ, F.array_join("reasons", ",").alias("reasons"))


@query(sql.after(sql.ENRICH, f"SELECT {names(CUSTOMER, *INDUSTRY)} FROM enrich").replace("WHERE c_custkey % 5 <> 0", ""))
def csv_enrich_scan(t: Tables) -> DataFrame:
    path = t.path("enrich-csv")
    files.write_enrichment(testdata.enrichment(t.spark, t.folder, all_customers=True), path)
    return files.read_enrichment(t.spark, path)


_TOKENS = sorted({*DEFAULT_MISSING, *REPORT_MISSING})


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % {2 * len(_TOKENS)} >= {len(_TOKENS)}"
    " THEN o_orderpriority END AS cell FROM orders"
)
def na_tokens(t: Tables) -> DataFrame:
    place = F.col("o_orderkey") % (2 * len(_TOKENS))
    token = F.get(F.array(*[F.lit(x) for x in _TOKENS]), place.cast("int"))
    cells = t.table("orders").select(
        "o_orderkey", F.coalesce(token, F.col("o_orderpriority")).alias("cell")
    )
    return files.normalise_missing(cells, REPORT_MISSING)


_TRAINING = names(QUOTE, *LABELS, *rounded(FEATURES))
_SCORING = names(QUOTE, *rounded(FEATURES))


@query(sql.after(sql.SCALED, f"SELECT {_TRAINING} FROM scaled"))
def json_training_scan(t: Tables) -> DataFrame:
    path = t.path("training-json")
    files.training_rows(t.both[1]).write.json(path)
    return files.read_training_json(t.spark, path).selectExpr(QUOTE, *LABELS, *rounded(FEATURES))


@query(sql.after(sql.SCALED, f"SELECT {_TRAINING} FROM scaled"))
def json_array_scan(t: Tables) -> DataFrame:
    """Files that hold JSON arrays of some thousand records on one line, read in splits."""
    path = t.path("training-array")
    rows = files.training_rows(t.both[1])
    arrays = F.ceil(F.lit(rows.count() / 1000)).cast("int")
    bucket = F.pmod(F.xxhash64(f"`{files.QUOTE_HEADER}`"), arrays)
    whole = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    rows.groupBy(bucket.alias("bucket")).agg(F.to_json(whole).alias("value")).select("value").write.text(path)
    release(t.spark)
    return files.read_training_json(t.spark, path, array_file=True).selectExpr(QUOTE, *LABELS, *rounded(FEATURES))


@query(sql.after(sql.SCALED, f"SELECT {_SCORING} FROM scaled"))
def json_scoring_scan(t: Tables) -> DataFrame:
    path = t.path("scoring-json")
    files.scoring_rows(t.both[1]).write.json(path)
    return files.read_scoring_json(t.spark, path).selectExpr(QUOTE, *rounded(FEATURES))


@query(sql.after(sql.SCALED, f"SELECT {_TRAINING} FROM scaled"))
def training_export(t: Tables) -> DataFrame:
    path = t.path("training-csv")
    files.write_training_csv(t.both[1], path)
    return files.read_training_csv(t.spark, path).selectExpr(
        QUOTE, *LABELS, *rounded(EXPORT_FEATURES)
    )


@query(
    sql.after(sql.FALLBACK, "SELECT src_seq, quote_no, close_2w, product_close_rate AS score FROM feat")
)
def scored_export(t: Tables) -> DataFrame:
    """Stand-in score: the product's close rate."""
    path = t.path("scored-csv")
    scored = t.features.select(SEQ, QUOTE, "close_2w", F.col("product_close_rate").alias("score"))
    files.write_scored(scored, path)
    schema = "src_seq bigint, quote_no string, close_2w int, score double"
    return t.spark.read.schema(schema).option("header", True).csv(path)


_TEXT_SCORE = "CAST(CAST(product_close_rate AS DECIMAL(9,6)) AS {})"


@query(
    sql.after(
        sql.FALLBACK,
        "SELECT src_seq, quote_no, '{\"' || quote_no || '\":\"' || "
        + _TEXT_SCORE.format("VARCHAR")
        + " || '\"}' AS json FROM feat",
    )
)
def score_json(t: Tables) -> DataFrame:
    scored = t.features.selectExpr(SEQ, QUOTE, _TEXT_SCORE.format("STRING") + " AS score")
    return files.score_json(scored, keep=[SEQ])


# --- Projections, filters, expressions -----------------------------------------------


@query("SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def parse_dates(t: Tables) -> DataFrame:
    text = F.date_format("o_orderdate", TIMESTAMP_FORMAT)
    return t.table("orders").select("o_orderkey", fx.parse_timestamp(text).alias("parsed"))


_FILLED = [SEQ, QUOTE, REQUEST, ACCEPT, PRODUCT, ORDER, CUSTOMER, AMOUNT, *INDUSTRY, REP]


@query(
    sql.after(
        sql.QUOTES,
        f"SELECT {names(*_FILLED)} FROM quotes".replace(
            AMOUNT, f"CAST({AMOUNT} AS DECIMAL(18,2)) AS {AMOUNT}"
        ),
    )
)
def fill_defaults(t: Tables) -> DataFrame:
    return t.filled.select(*_FILLED)


@query(
    sql.after(
        sql.REPORT,
        "SELECT src_seq, coalesce(quote_no, '0') AS quote_no, coalesce(customer_no, 0) AS customer_no,"
        " coalesce(sales_rep, '0') AS sales_rep, accept_ts,"
        " CAST(coalesce(paid_amount, 0) AS DECIMAL(18,2)) AS paid_amount FROM report",
    )
)
def fill_all_zero(t: Tables) -> DataFrame:
    return prep.fill_all_zero(t.report.select(SEQ, QUOTE, CUSTOMER, REP, ACCEPT, AMOUNT))


@query(
    sql.after(
        sql.REPORT,
        "SELECT src_seq, regexp_replace(order_number, '[^0-9]+$', '') AS order_number FROM report",
    )
)
def clean_order_number(t: Tables) -> DataFrame:
    return t.report.select(SEQ, fx.clean_order_number(F.col(ORDER)).alias(ORDER))


@query(
    sql.after(
        sql.REPORT, "SELECT src_seq, regexp_replace(product, '^Custom ', '') AS product FROM report"
    )
)
def clean_product(t: Tables) -> DataFrame:
    return t.report.select(SEQ, fx.clean_product(F.col(PRODUCT)).alias(PRODUCT))


@query(sql.after(sql.REPORT, "SELECT src_seq, quote_no FROM report WHERE quote_no IS NOT NULL"))
def valid_quotes(t: Tables) -> DataFrame:
    return cleaning.valid_quotes(t.report).select(SEQ, QUOTE)


@query(
    sql.after(
        sql.FLAGGED,
        f"SELECT {names(SEQ, *QUOTE_COLUMNS)} FROM flagged".replace(
            AMOUNT, f"CAST({AMOUNT} AS DECIMAL(18,2)) AS {AMOUNT}"
        ),
    )
)
def quote_projection(t: Tables) -> DataFrame:
    return cleaning.select_quote_columns(cleaning.flag_new_customers(t.quotes).rows)


_KEPT = sorted([SEQ, *QUOTE_COLUMNS, *LABELS, "sales_cycle"])


@query(sql.after(sql.CLEAN, f"SELECT {names(*_KEPT)} FROM clean"))
def drop_aux_columns(t: Tables) -> DataFrame:
    lagged = t.clean.with_rows(ordering.beside(t.clean, history.lag_columns(t.clean)))
    epochs = history.order_epochs(lagged).drop(ordering.POS, ordering.CHUNK)
    return prep.drop_auxiliary(epochs)


@query(sql.after(sql.CLEAN, "SELECT src_seq, days, sales_cycle FROM clean"))
def sales_cycle_days(t: Tables) -> DataFrame:
    days = fx.floored_days(F.col(REQUEST), F.col(ACCEPT))
    return t.clean.rows.select(SEQ, days.alias("days"), "sales_cycle")


@query(sql.after(sql.CLEAN, "SELECT src_seq, close_3d, close_2w FROM clean"))
def close_flags(t: Tables) -> DataFrame:
    return t.clean.rows.select(SEQ, *LABELS)


@query(sql.after(sql.CLEAN, "SELECT src_seq, whether_order FROM clean"))
def order_flag(t: Tables) -> DataFrame:
    return t.clean.rows.select(SEQ, "whether_order")


_FALLBACK = [f"{g}_{k}" for g in GROUPS for k in history.METRICS]


@query(sql.after(sql.FALLBACK, f"SELECT {names(SEQ, *_FALLBACK)} FROM feat"))
def metric_fallback(t: Tables) -> DataFrame:
    return t.features.select(SEQ, *_FALLBACK)


_NEUTRAL = {"sales_rep_aov": "aov", "sales_rep_close_rate": "avg_close_rate", "sales_rep_asc": "avg_sales_cycle"}


@query(
    sql.after(
        sql.SCALED,
        f"SELECT src_seq, {names(*[f'round({g}, 4) AS {c}' for c, g in _NEUTRAL.items()])}"
        f" FROM scaled WHERE {sql.IS_TEST}",
    )
)
def neutralize_rep(t: Tables) -> DataFrame:
    _, test = close_rate.train_and_test(t.both[1])
    return test.selectExpr(SEQ, *rounded(list(_NEUTRAL)))


@query(
    sql.after(
        sql.CLEAN, f"SELECT src_seq, quote_no FROM clean WHERE {sql.IS_TEST} AND whether_new = 1"
    )
)
def new_customer_subset(t: Tables) -> DataFrame:
    _, test = prep.split(t.clean.rows)
    return prep.new_customers(test).select(SEQ, QUOTE)


@query(
    "SELECT event_id, CASE WHEN value < 20 THEN 0 ELSE value END AS predicted_amount FROM events"
)
def clip_small_values(t: Tables) -> DataFrame:
    """The event values stand in for predictions."""
    return t.table("events").select(
        "event_id", fx.clip_small(F.col("value")).alias("predicted_amount")
    )


@query(
    sql.after(
        sql.FALLBACK,
        f"SELECT src_seq, {names(*[f'CAST({c} AS REAL) AS {c}' for c in FEATURES])} FROM feat",
    )
)
def float32_features(t: Tables) -> DataFrame:
    return prep.as_float32(t.features.select(SEQ, *FEATURES))


@query(
    sql.after(
        sql.FALLBACK,
        f"SELECT src_seq, {names(*[f'{c} AS f{i}' for i, c in enumerate(sorted(FEATURES))])} FROM feat",
    )
)
def feature_order(t: Tables) -> DataFrame:
    return prep.numbered_features(t.features.select(SEQ, *FEATURES), keep=[SEQ])


# Amounts and figures in tens, so that points lie inside and outside of both ranges.
_TENS = "SELECT CAST(paid_amount AS DOUBLE) / 10 AS actual, product_aov / 10 AS predicted FROM feat"
_POINTS = "SELECT {0} AS upper, actual, predicted FROM points WHERE actual BETWEEN 0 AND {0} AND predicted BETWEEN 0 AND {0}"


@query(sql.after(sql.FALLBACK, f"SELECT * FROM (WITH points AS ({_TENS}) {_POINTS.format(60000)} UNION ALL {_POINTS.format(20000)})"))
def actual_vs_predicted(t: Tables) -> DataFrame:
    """Stand-in prediction: the product's average order value."""
    points = t.features.selectExpr("double(paid_amount) / 10 AS actual", "product_aov / 10 AS predicted")
    parts = [
        metrics.actual_vs_predicted(points, "actual", "predicted", upper).select(
            F.lit(upper).alias("upper"), "actual", "predicted"
        )
        for upper in (60000, 20000)
    ]
    return parts[0].unionByName(parts[1])


# --- Joins ---------------------------------------------------------------------------


@query(sql.after(sql.JOINED, f"SELECT {names(*REPORT_COLUMNS, *INDUSTRY)} FROM joined"))
def enrich_quotes(t: Tables) -> DataFrame:
    return cleaning.enrich_quotes(t.report, t.enrich).select(*REPORT_COLUMNS, *INDUSTRY)


@query(sql.after(sql.DEDUPED, "SELECT src_seq, quote_no, order_number, paid_amount FROM deduped"))
def quote_order_amount(t: Tables) -> DataFrame:
    return cleaning.dedupe_orders(t.quotes).rows.select(SEQ, QUOTE, ORDER, AMOUNT)


@query(
    sql.after(
        sql.SCALED,
        "SELECT f.src_seq, f.quote_no, f.close_2w, f.product_close_rate,"
        " round(s.product_close_rate, 4) AS score FROM feat f JOIN scaled s USING (src_seq)",
    )
)
def attach_predictions(t: Tables) -> DataFrame:
    """Stand-in prediction: the scaled close rate of the product, made elsewhere. Repeated
    predictions of a row leave it one row."""
    raw, scaled = t.both
    scored = scaled.withColumn("score", F.round("product_close_rate", 4))
    scored = scored.unionByName(scored.filter(f"{SEQ} % 3 = 0"))
    return scoring.attach_predictions(raw, scored, ["score"]).select(
        SEQ, QUOTE, "close_2w", "product_close_rate", "score"
    )


@query(
    sql.after(
        sql.SCALED_VALUE,
        "SELECT f.src_seq, f.quote_no, "
        + names(
            *[f"f.{c} AS {c}_raw, round(s.{c}, 4) AS {c}_scaled" for c in VALUE_FEATURES]
        )
        + " FROM feat f JOIN scaled_value s USING (src_seq)",
    )
)
def raw_scaled_join(t: Tables) -> DataFrame:
    joined = scoring.raw_and_scaled(*t.raw_values_and_scaling)
    return joined.selectExpr(
        SEQ,
        QUOTE,
        *[f"{c}_raw" for c in VALUE_FEATURES],
        *rounded([f"{c}_scaled" for c in VALUE_FEATURES]),
    )


@query(
    sql.after(
        sql.CLEAN,
        f"SELECT src_seq, quote_no, product, paid_amount FROM clean WHERE {sql.IS_TEST} AND whether_new = 1",
    )
)
def test_rows_semi(t: Tables) -> DataFrame:
    rows = t.clean.rows
    _, test = prep.split(rows)
    return scoring.rows_of(rows, prep.new_customers(test)).select(SEQ, QUOTE, PRODUCT, AMOUNT)


# --- Aggregations --------------------------------------------------------------------


@query(
    sql.after(
        sql.QUOTES,
        "SELECT quote_no, order_number, CAST(sum(paid_amount) AS DECIMAL(28,2)) AS paid_amount"
        " FROM quotes GROUP BY ALL",
    )
)
def amount_by_quote_order(t: Tables) -> DataFrame:
    return cleaning.amount_by_quote_order(t.filled)


@query(sql.after(sql.SCALED, f"SELECT src_seq, {names(*rounded(FEATURES))} FROM scaled"))
def zscore_features(t: Tables) -> DataFrame:
    return t.both[1].selectExpr(SEQ, *rounded(FEATURES))


def _stand_in(t: Tables) -> DataFrame:
    """Label two weeks, score the product's close rate, class 1 from one half."""
    score = F.col("product_close_rate")
    return t.features.select(
        F.col("close_2w").alias(LABEL),
        F.when(score >= 0.5, 1).otherwise(0).alias(PREDICTION),
        score.alias(SCORE),
    )


_STAND_IN = "(SELECT close_2w AS label, CASE WHEN product_close_rate >= 0.5 THEN 1 ELSE 0 END AS prediction, product_close_rate AS score FROM feat)"


@query(
    sql.after(
        sql.FALLBACK,
        "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy"
        f" FROM {_STAND_IN}",
    )
)
def metric_accuracy(t: Tables) -> DataFrame:
    return metrics.accuracy(_stand_in(t)).selectExpr("round(accuracy, 6) AS accuracy")


@query(
    sql.after(
        sql.FALLBACK,
        "SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * CAST(sum(neg) AS DOUBLE)), 6) AS auc"
        " FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED"
        " PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT score, CAST(sum(label) AS DOUBLE) AS pos,"
        f" CAST(sum(1 - label) AS DOUBLE) AS neg FROM {_STAND_IN} GROUP BY score))",
    )
)
def metric_auc(t: Tables) -> DataFrame:
    return metrics.auc(_stand_in(t)).selectExpr("round(auc, 6) AS auc")


_CELLS = {"true_positive": (1, 1), "true_negative": (0, 0), "false_positive": (0, 1), "false_negative": (1, 0)}


@query(
    sql.after(
        sql.FALLBACK,
        "SELECT "
        + names(
            *[
                f"CAST(count(*) FILTER (label = {y} AND prediction = {p}) AS BIGINT) AS {c}"
                for c, (y, p) in _CELLS.items()
            ]
        )
        + f" FROM {_STAND_IN}",
    )
)
def metric_confusion(t: Tables) -> DataFrame:
    return metrics.confusion(_stand_in(t))


@query(
    sql.after(
        sql.FALLBACK,
        "SELECT round(avg(pow((CAST(paid_amount AS DOUBLE) - product_aov) / 1000, 2)), 4) AS mse FROM feat",
    )
)
def metric_mse(t: Tables) -> DataFrame:
    """Errors in thousands; stand-in prediction: the product's average order value."""
    scored = t.features.selectExpr(
        f"double(paid_amount) / 1000 AS {LABEL}", f"product_aov / 1000 AS {PREDICTION}"
    )
    return metrics.mean_squared_error(scored).selectExpr("round(mse, 4) AS mse")


# --- Windows -------------------------------------------------------------------------

def _lag_sql(kinds: list[str]) -> str:
    lags = [
        f"CASE WHEN {k} IS NULL THEN 0 ELSE coalesce(lag({history.LAGGED[n]}) OVER (PARTITION BY {k} {sql.ORD}), 0) END AS {g}_{n}_lag"
        for g, k in GROUPS.items()
        for n in kinds
    ]
    return names(
        *lags,
        *[f"coalesce(lag({history.LAGGED[n]}) OVER ({sql.ORD}), 0) AS {history.LAGGED_OVERALL[n]}" for n in kinds],
    )


@query(sql.after(sql.CLEAN, f"SELECT src_seq, {_lag_sql(list(history.LAGGED))} FROM clean"))
def group_lag(t: Tables) -> DataFrame:
    """All 24 lag columns of the groupings and the three over all rows."""
    lagged = ordering.beside(t.clean, history.lag_columns(t.clean))
    return lagged.select(SEQ, *[c for c in lagged.columns if c.endswith("_lag")])


_FRAME = [QUOTE, CUSTOMER, REP, AMOUNT, *VALUE_FEATURES]
_ZERO_TEXT = {QUOTE: "''", CUSTOMER: "0", REP: "'0'"}


@query(
    sql.after(
        sql.FALLBACK,
        f"SELECT src_seq, {names(*[f'coalesce({c}, {_ZERO_TEXT[c]}) AS {c}' if c in _ZERO_TEXT else c for c in _FRAME])},"
        f" {_lag_sql(['amt', 'order'])} FROM feat",
    )
)
def value_frame(t: Tables) -> DataFrame:
    """The value frame with its lag columns, all that is missing filled."""
    frame = lead_value.value_frame(t.report, t.enrich, task_rows=CHUNK_ROWS)
    return frame.select(SEQ, *_FRAME, *[c for c in frame.columns if c.endswith("_lag")])


@query(sql.after(sql.FLAGGED, "SELECT src_seq, whether_new FROM flagged"))
def whether_new(t: Tables) -> DataFrame:
    return cleaning.flag_new_customers(t.quotes).rows.select(SEQ, "whether_new")


@query(sql.after(sql.DEDUPED, "SELECT src_seq, order_number FROM deduped"))
def dedupe_orders(t: Tables) -> DataFrame:
    return cleaning.dedupe_orders(t.quotes).rows.select(SEQ, ORDER)


@query(sql.after(sql.HISTORY, "SELECT src_seq, aov, avg_close_rate, avg_sales_cycle FROM history"))
def global_history(t: Tables) -> DataFrame:
    figures = history.shared_figures(t.clean, {}, list(history.METRICS), everything=True)
    return ordering.beside(t.clean, figures).select(SEQ, "aov", "avg_close_rate", "avg_sales_cycle")


def _one_metric(t: Tables, kind: str) -> DataFrame:
    """One metric for all eight groupings, before the fallback."""
    customers = history.customer_figures(t.clean, [kind])
    shared = history.shared_figures(t.clean, SHARED_GROUPS, [kind])
    rows = ordering.beside(t.clean, customers, shared)
    return rows.select(SEQ, *[f"{g}_{kind}" for g in GROUPS])


def _metric_sql(kind: str) -> str:
    return sql.after(sql.HISTORY, f"SELECT {names(SEQ, *[f'{g}_{kind}' for g in GROUPS])} FROM history")


@query(_metric_sql("aov"))
def history_aov(t: Tables) -> DataFrame:
    return _one_metric(t, "aov")


@query(_metric_sql("close_rate"))
def history_close_rate(t: Tables) -> DataFrame:
    return _one_metric(t, "close_rate")


@query(_metric_sql("asc"))
def history_sales_cycle(t: Tables) -> DataFrame:
    return _one_metric(t, "asc")


def _customers(t: Tables) -> DataFrame:
    return history.without_customer(ordering.beside(t.clean, history.customer_figures(t.clean, [])))


@query(sql.after(sql.HISTORY, "SELECT src_seq, cust_tot_spend, cust_tot_orders FROM history"))
def customer_totals(t: Tables) -> DataFrame:
    return _customers(t).select(SEQ, "cust_tot_spend", "cust_tot_orders")


@query(sql.after(sql.SINCE, "SELECT src_seq, CAST(order_grp AS BIGINT) AS order_grp FROM epochs"))
def order_epoch(t: Tables) -> DataFrame:
    return history.order_epochs(t.clean).select(SEQ, "order_grp")


@query(sql.after(sql.SINCE, "SELECT src_seq, CAST(quotes_since AS BIGINT) AS quotes_since FROM epochs"))
def quotes_in_epoch(t: Tables) -> DataFrame:
    return history.order_epochs(t.clean).select(SEQ, "quotes_since")


@query(sql.after(sql.SINCE, "SELECT src_seq, quotes_since_last_order FROM since"))
def quotes_since_last_order(t: Tables) -> DataFrame:
    return _customers(t).select(SEQ, "quotes_since_last_order")


_BY = names(CUSTOMER, REQUEST, ORDER, PRODUCT)


@query(
    sql.after(
        sql.QUOTES,
        f"SELECT {_BY}, CAST(amount AS DECIMAL(28,2)) AS paid_amount,"
        f" CAST(sum(amount) OVER (PARTITION BY customer_no ORDER BY {_BY}) AS DECIMAL(38,2)) AS cust_tot,"
        f" CAST(sum(amount) OVER (PARTITION BY product ORDER BY {_BY}) AS DECIMAL(38,2)) AS type_tot"
        f" FROM (SELECT {_BY}, sum(paid_amount) AS amount FROM quotes"
        " WHERE customer_no IS NOT NULL GROUP BY ALL)",
    )
)
def running_totals_example(t: Tables) -> DataFrame:
    return history.running_totals(
        t.filled,
        [CUSTOMER, REQUEST, ORDER, PRODUCT],
        AMOUNT,
        {"cust_tot": CUSTOMER, "type_tot": PRODUCT},
    )


# --- Order, split --------------------------------------------------------------------


@query(
    sql.after(
        sql.QUOTES, f"SELECT src_seq, CAST(row_number() OVER ({sql.ORD}) AS BIGINT) AS place FROM quotes"
    )
)
def quote_order(t: Tables) -> DataFrame:
    counted = t.quotes.with_rows(t.quotes.rows.withColumn("quotes", F.lit(1).cast("bigint")))
    placed = ordering.add_shared_prior(counted, {}, ["quotes"], everything="all")
    return placed.rows.selectExpr(SEQ, "all__quotes + 1 AS place")


@query(sql.after(sql.CLEAN, f"SELECT src_seq, {sql.IS_TEST} AS is_test FROM clean"))
def split_75_25(t: Tables) -> DataFrame:
    return prep.mark_test_rows(t.clean.rows).select(SEQ, prep.IS_TEST)


# --- Models --------------------------------------------------------------------------


# A model's scores are not SQL. Its queries give the rows with their labels, which the SQL
# knows, and whether class and score of each are what they must be.
_VALID = "coalesce({0}_prob BETWEEN 0 AND 1 AND {0} = int({0}_prob > 0.5), false)"
_TRUE = "true AS valid"
_TEST_ROWS = f"FROM clean WHERE {sql.IS_TEST}"


def _judged(scored: DataFrame, *columns: str) -> DataFrame:
    return scored.selectExpr(*columns, f"{_VALID.format('pred')} AS valid")


def _tested(t: Tables, pipeline, label: str) -> DataFrame:
    train, test = close_rate.train_and_test(t.both[1])
    model = models.fit(pipeline, train, label)
    return _judged(models.predict_class(model, test, "pred"), SEQ, QUOTE, label)


def _refitted(t: Tables, label: str) -> DataFrame:
    scaled = t.both[1]
    model = models.fit(models.boosted_classifier(**t.limit), scaled, label)
    return _judged(models.predict_class(model, scaled, "pred"), SEQ, QUOTE, label)


def _test_sql(label: str) -> str:
    return sql.after(sql.CLEAN, f"SELECT src_seq, quote_no, {label}, {_TRUE} {_TEST_ROWS}")


def _all_sql(label: str) -> str:
    return sql.after(sql.CLEAN, f"SELECT src_seq, quote_no, {label}, {_TRUE} FROM clean")


@query(_test_sql("close_3d"))
def mlp_3d(t: Tables) -> DataFrame:
    return _tested(t, models.neural_net(**t.limit), "close_3d")


@query(_test_sql("close_2w"))
def mlp_2w(t: Tables) -> DataFrame:
    return _tested(t, models.neural_net(**t.limit), "close_2w")


@query(_test_sql("close_3d"))
def gbt_3d(t: Tables) -> DataFrame:
    return _tested(t, models.boosted_classifier(**t.limit), "close_3d")


@query(_test_sql("close_2w"))
def gbt_2w(t: Tables) -> DataFrame:
    return _tested(t, models.boosted_classifier(**t.limit), "close_2w")


@query(_all_sql("close_3d"))
def gbt_full_3d(t: Tables) -> DataFrame:
    return _refitted(t, "close_3d")


@query(_all_sql("close_2w"))
def gbt_full_2w(t: Tables) -> DataFrame:
    return _refitted(t, "close_2w")


@query(sql.after(sql.CLEAN, f"SELECT count(*) AS n_rows, CAST(sum(paid_amount) AS DECIMAL(38,2)) AS amount, true AS mse_valid {_TEST_ROWS}"))
def value_gbt(t: Tables) -> DataFrame:
    """Test rows, their amount, and whether the error of the value model is a number that the
    spread of the amounts does not exceed by far."""
    tested = lead_value.tested_values(t.both_values[1], **t.limit)
    return tested.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col(LABEL).cast("decimal(28,2)")).cast("decimal(38,2)").alias("amount"),
        (F.avg(F.pow(F.col(LABEL) - F.col(PREDICTION), 2)) < 4 * F.avg(F.pow(LABEL, F.lit(2)))).alias("mse_valid"),
    )


@query(sql.after(sql.CLEAN, f"SELECT src_seq, quote_no, paid_amount, {_TRUE} FROM clean"))
def value_gbt_full(t: Tables) -> DataFrame:
    """The full value model next to raw and scaled rows; values below 20 are 0."""
    scored = lead_value.full_values(*t.raw_values_and_scaling, **t.limit)
    value = lead_value.PREDICTED
    return scored.selectExpr(SEQ, QUOTE, AMOUNT, f"coalesce({value} = 0 OR {value} >= 20, false) AS valid")


@query(sql.after(sql.FALLBACK, f"SELECT src_seq, quote_no, close_3d, close_2w, cust_tot_orders, product_close_rate, {_TRUE} FROM feat"))
def scored_quotes(t: Tables) -> DataFrame:
    """Raw rows with the predictions of both full models."""
    scored = close_rate.full_predictions(*t.raw_and_scaling, **t.limit)
    valid = " AND ".join(_VALID.format(f"pred_{label}") for label in LABELS)
    return scored.selectExpr(SEQ, QUOTE, *LABELS, "cust_tot_orders", "product_close_rate", f"{valid} AS valid")


def _report_sql() -> str:
    parts = [
        f"SELECT '{name}, {horizon}' AS report, count(*) AS n_rows, CAST(sum({label}) AS BIGINT) AS positives, {_TRUE} {_TEST_ROWS}{more}"
        for label, horizon in close_rate.HORIZON.items()
        for name, more in (("MLP", ""), ("GBT", ""), ("GBT for New Customer", " AND whether_new = 1"))
    ]
    return sql.after(sql.CLEAN, " UNION ALL ".join(parts))


@query(_report_sql())
def model_report(t: Tables) -> DataFrame:
    """Size and positives of each report, and whether its figures fit together."""
    limit = {"rounds": t.rounds, "net_rounds": t.rounds} if t.rounds else {}
    report = close_rate.model_reports(t.both[1], **limit)
    n = "(true_positive + true_negative + false_positive + false_negative)"
    return report.selectExpr(
        "report",
        f"{n} AS n_rows",
        "true_positive + false_negative AS positives",
        f"auc BETWEEN 0 AND 1 AND abs(accuracy - (true_positive + true_negative) / {n}) < 1e-12 AS valid",
    )


@query("SELECT true AS known, true AS ranked, true AS complete")
def feature_importance(t: Tables) -> DataFrame:
    """Whether the counted splits are those of all trees, by known features, most used first."""
    train, _ = close_rate.train_and_test(t.both[1])
    model = models.fit(models.boosted_classifier(**t.limit), train, "close_2w")
    inner = sum((tree.numNodes - 1) // 2 for tree in model.stages[-1].trees)
    ranked = models.split_counts(t.spark, model).withColumn("place", F.monotonically_increasing_id())
    later = ranked.select(F.collect_list("splits").alias("s"), F.collect_set("feature").alias("f"))
    known = F.array(*[F.lit(c) for c in FEATURES])
    return later.select(
        (F.size(F.array_except("f", known)) == 0).alias("known"),
        (F.col("s") == F.reverse(F.array_sort("s"))).alias("ranked"),
        (F.aggregate("s", F.lit(0).cast("bigint"), lambda a, b: a + b) == inner).alias("complete"),
    )


@query(sql.after(sql.CLEAN, f"SELECT src_seq, quote_no, close_2w, {_TRUE} {_TEST_ROWS} AND whether_new = 1"))
def new_customer_test_scores(t: Tables) -> DataFrame:
    scored = close_rate.new_customer_test_scores(*t.raw_and_scaling, **t.limit)
    return _judged(scored, SEQ, QUOTE, "close_2w")


@query(sql.after(sql.CLEAN, f"SELECT src_seq, quote_no, true AS same, true AS same_as_scaled {_TEST_ROWS}"))
def model_roundtrip(t: Tables) -> DataFrame:
    """A model saved with its scaling scores raw rows as before, and as the scaled rows are."""
    raw, scaling = t.raw_and_scaling
    train, test = prep.split(raw)
    model = close_rate.fit_on_raw(train, scaling, "close_3d", **t.limit)
    path = t.path("model")
    models.save_model(model, path)
    loaded = models.load_model(path)
    scored = models.predict_class(loaded, models.predict_class(model, test, "before"), "after")
    both = models.predict_class(models.on_scaled(loaded), scaling.apply(scored, models.SUFFIX), "scaled")
    return both.selectExpr(SEQ, QUOTE, "before_prob = after_prob AS same", "scaled_prob = after_prob AS same_as_scaled")


def _trained_from_json(t: Tables) -> str:
    """The folder of a model trained on JSON records."""
    source, root = t.path("training-json"), t.path("trainer-model")
    files.write_json(files.training_rows(t.both[1]), source)
    trainer.train_from_json(t.spark, source, root, **t.limit)
    return root


@query(sql.after(sql.CLEAN, f"SELECT quote_no, {_TRUE} FROM clean"))
def train_from_json(t: Tables) -> DataFrame:
    model = models.load_current(t.spark, _trained_from_json(t))
    scored = trainer.score_records(t.both[1].select(QUOTE, *FEATURES), model)
    return scored.selectExpr(QUOTE, "coalesce(score BETWEEN 0 AND 1, false) AS valid")


@query(
    sql.after(
        sql.FALLBACK,
        "SELECT quote_no, arg_max(product_close_rate, src_seq) AS score FROM feat GROUP BY quote_no",
    )
)
def score_latest(t: Tables) -> DataFrame:
    """Stand-in score: the product's close rate; a quote's rows arrive in file order."""
    scored = t.features.select(QUOTE, SEQ, F.col("product_close_rate").alias("score"))
    return scoring.latest_scores(scored, "score", SEQ)


# --- Streaming -----------------------------------------------------------------------


@query(sql.after(sql.CLEAN, "SELECT quote_no, true AS same_as_batch FROM clean"))
def stream_score(t: Tables) -> DataFrame:
    """Every record once, and whether all scores are those of the batch."""
    root = _trained_from_json(t)
    source, target = t.path("scoring-json"), t.path("stream-scores")
    files.write_json(files.scoring_rows(t.both[1]), source)
    records = streams.read_records(t.spark, source)
    streams.score_stream(records, root, target, t.path("stream-state")).awaitTermination()
    scored = streams.read_scores(t.spark, target).select(QUOTE, "score")
    batch = trainer.score_records(files.read_scoring_json(t.spark, source), models.load_current(t.spark, root))
    same = scored.exceptAll(batch).isEmpty() and batch.exceptAll(scored).isEmpty()
    return scored.select(QUOTE, F.lit(same).alias("same_as_batch"))


@query(
    "SELECT CAST(user_id AS VARCHAR) AS quote_no, arg_max(value, event_id) AS score"
    " FROM events GROUP BY user_id"
)
def stream_latest_score(t: Tables) -> DataFrame:
    """Events stand in for scores: the user for the quote, the value for its score."""
    source, target = t.path("score-json"), t.path("latest-scores")
    schema = "quote_no string, score double, arrival bigint"
    t.table("events").selectExpr(
        "string(user_id) AS quote_no", "value AS score", "event_id AS arrival"
    ).write.json(source)
    records = t.spark.readStream.schema(schema).json(source)
    streams.latest_score_stream(
        records, "score", "arrival", target, t.path("latest-state")
    ).awaitTermination()
    return streams.read_latest_scores(t.spark, target, "score", "arrival")


# --- Whole feature tables ------------------------------------------------------------


@query(
    sql.after(sql.FALLBACK, f"SELECT {names(SEQ, *QUOTE_COLUMNS, *LABELS, *FEATURES)} FROM feat")
)
def lead_features(t: Tables) -> DataFrame:
    return t.features.select(SEQ, *QUOTE_COLUMNS, *LABELS, *FEATURES)


@query(
    sql.after(
        sql.FALLBACK,
        f"SELECT src_seq, quote_no, paid_amount, {names(*VALUE_FEATURES)} FROM feat",
    )
)
def value_features(t: Tables) -> DataFrame:
    table = lead_value.value_table(t.report, t.enrich, task_rows=CHUNK_ROWS)
    return table.select(SEQ, QUOTE, AMOUNT, *VALUE_FEATURES)
