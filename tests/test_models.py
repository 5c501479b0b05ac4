"""Model checks: ranges, planted signal, round trips, stream equals batch."""

import json
import math
import random
from fractions import Fraction
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from leadtide import remote
from leadtide.operators import metrics, models, prep, scoring
from leadtide.plans import close_rate, lead_value, trainer
from leadtide.registry.catalog import Tables
from leadtide.schema import FEATURES, QUOTE, SEQ
from leadtide.sources import files
from leadtide.streaming import scores as streams


@pytest.fixture(scope="module")
def tables(spark, folder):
    return Tables(spark, folder)


@pytest.fixture(scope="module")
def planted(spark):
    """A label that hangs on two of three features."""
    rng = random.Random(5)
    rows = []
    for i in range(800):
        a, b, c = (rng.gauss(0, 1) for _ in range(3))
        rows.append((i, a, b, c, int(a + b + rng.gauss(0, 0.5) > 0), 30 * a + 5 * b))
    return spark.createDataFrame(
        rows, "src_seq bigint, a double, b double, c double, label int, value double"
    )


@pytest.mark.parametrize("build", [models.boosted_classifier, models.neural_net])
def test_classifiers_find_a_planted_signal(planted, build):
    pipeline = build(["a", "b", "c"], rounds=30)
    train, test = prep.split(planted)
    scored = models.predict_class(models.fit(pipeline, train, "label"), test, "pred")
    probs = [r["pred_prob"] for r in scored.collect()]
    assert all(0 <= p <= 1 for p in probs)
    report = metrics.classification_report(
        scored.selectExpr("'m' AS report", "label", "pred AS prediction", "pred_prob AS score")
    ).first()
    assert report["auc"] > 0.9 and report["accuracy"] > 0.8
    cells = ("true_positive", "true_negative", "false_positive", "false_negative")
    assert sum(report[c] for c in cells) == len(probs)
    right = report["true_positive"] + report["true_negative"]
    assert report["accuracy"] == pytest.approx(right / len(probs))


def test_regressor_finds_a_planted_signal(planted):
    train, test = prep.split(planted)
    model = models.fit(models.boosted_regressor(["a", "b", "c"], rounds=10), train, "value")
    scored = models.predict_value(model, test, "prediction").withColumn("label", F.col("value"))
    spread = test.agg(F.var_pop("value")).first()[0]
    assert metrics.mean_squared_error(scored).first()["mse"] < spread / 4


def test_split_counts_rank_the_used_features(spark, planted):
    model = models.fit(models.boosted_classifier(["a", "b", "c"], rounds=5), planted, "label")
    counts = models.split_counts(spark, model, ["a", "b", "c"]).collect()
    assert {counts[0]["feature"], counts[1]["feature"]} == {"a", "b"}
    trees = model.stages[-1].trees
    assert sum(r["splits"] for r in counts) == sum((t.numNodes - 1) // 2 for t in trees)


def test_reports_cover_models_labels_and_new_customers(tables):
    reports = close_rate.model_reports(tables.both[1], rounds=2, net_rounds=5, partitions=4).collect()
    assert {r["report"] for r in reports} == {
        f"{m}, {h}" for m in ("MLP", "GBT", "GBT for New Customer") for h in ("3 Days", "2 Weeks")
    }
    assert all(0 <= r["accuracy"] <= 1 and math.isfinite(r["auc"]) for r in reports)


def test_full_predictions_keep_every_row_once(tables):
    raw, scaling = tables.raw_and_scaling
    scored = close_rate.full_predictions(raw, scaling, rounds=2)
    assert scored.count() == raw.count() == scored.select(SEQ).distinct().count()
    added = set(scored.columns) - set(raw.columns)
    assert added == {"pred_close_3d", "pred_close_3d_prob", "pred_close_2w", "pred_close_2w_prob"}
    assert scored.filter("pred_close_2w_prob IS NULL").count() == 0


def test_new_customer_scores_are_test_rows_of_new_customers(tables):
    scored = close_rate.new_customer_test_scores(*tables.raw_and_scaling, rounds=2)
    marked = prep.mark_test_rows(scored)
    assert scored.count() > 0
    assert marked.filter("NOT is_test OR whether_new <> 1").count() == 0


def test_value_plan(tables):
    raw, scaled = tables.both_values
    joined = lead_value.full_values(*tables.raw_values_and_scaling, rounds=2)
    assert joined.count() == raw.count()
    assert joined.filter("predicted_amount < 20 AND predicted_amount <> 0").count() == 0
    assert {"aov_raw", "aov_scaled", "paid_amount", "predicted_amount"} <= set(joined.columns)
    assert lead_value.test_error(scaled, rounds=2).first()["mse"] > 0


@pytest.fixture(scope="module")
def trained(spark, tables, tmp_path_factory):
    folder = tmp_path_factory.mktemp("trainer")
    source, target = str(folder / "training"), str(folder / "model")
    files.training_rows(tables.both[1]).write.json(source)
    return trainer.train_from_json(spark, source, target, rounds=2), target


def test_a_loaded_model_scores_alike(spark, tables, trained):
    model, root = trained
    records = tables.both[1].select(QUOTE, *FEATURES)
    one = trainer.score_records(records, model)
    two = trainer.score_records(records, models.load_current(spark, root))
    assert one.exceptAll(two).count() == 0 and one.count() == two.count() > 0


def test_a_saved_model_scores_raw_quotes(tables, tmp_path):
    """Scaling is part of the model: after a reload, raw rows score as the scaled rows do."""
    raw, scaling = tables.raw_and_scaling
    models.save_model(close_rate.fit_on_raw(raw, scaling, "close_2w", rounds=3), str(tmp_path / "m"))
    plain = models.fit(models.boosted_classifier(rounds=3), tables.both[1], "close_2w")
    want = models.predict_class(plain, tables.both[1], "p").select(SEQ, "p", "p_prob")
    got = models.predict_class(models.load_model(str(tmp_path / "m")), raw, "p")
    assert got.columns == [*raw.columns, "p", "p_prob"]
    assert got.select(SEQ, "p", "p_prob").exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_repeated_customers_of_the_attributes_repeat_no_prediction(tables):
    raw, scaling = tables.raw_and_scaling
    twice = raw.unionByName(raw)
    scored = close_rate.full_predictions(twice, scaling, rounds=1)
    both = scoring.raw_and_scaled(twice, scaling)
    assert scored.count() == both.count() == twice.count() == 2 * raw.count()
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (scored, both)]
    assert not any("Exchange" in plan.replace("ReusedExchange", "") and "Join" in plan for plan in plans)
    guesses = raw.select(SEQ, F.lit(0.5).alias("p"))
    guesses = guesses.unionByName(guesses).unionByName(raw.limit(3).select(SEQ, F.lit(0.7).alias("p")))
    assert scoring.attach_predictions(raw, guesses, ["p"]).count() == raw.count()


def test_one_run_of_the_models_gives_the_whole_report(spark):
    rng = random.Random(3)
    rows = [(f"m{i % 3}", int(rng.random() < 0.4), int(rng.random() < 0.5), rng.randrange(12) / 12) for i in range(900)]
    scored = spark.createDataFrame(rows, "report string, label int, prediction int, score double")
    report = {r["report"]: r for r in metrics.classification_report(scored, partitions=3).collect()}
    separate = metrics.accuracy(scored, "report").join(metrics.auc(scored, "report"), "report")
    separate = separate.join(metrics.confusion(scored, "report"), "report")
    for r in separate.collect():
        assert {k: pytest.approx(v) for k, v in r.asDict().items()} == report[r["report"]].asDict()
    counted = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: counted.add(1) or x, "double")
    metrics.classification_report(scored.withColumn("score", seen("score"))).collect()
    assert counted.value == len(rows)


def test_scaling_does_not_depend_on_the_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1) * 10.0 ** rng.randrange(-6, 7), rng.random() / 3, 7.25, None if i % 3 else 1e300 * rng.random(), 0.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    names = list("abcde")
    one = prep.fit_scaling(df.coalesce(1), names)
    for n in (3, 8):
        assert prep.fit_scaling(df.repartition(n, "a"), names) == one
    for k, c in enumerate(names):
        values = [Fraction(r[k]) for r in rows if r[k] is not None]
        mean = sum(values) / len(values)
        spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) if k != 3 else one.deviation[c]
        assert one.mean[c] == pytest.approx(float(mean), rel=1e-14) and one.deviation[c] == pytest.approx(spread, rel=1e-12)
    assert one.deviation["c"] == one.deviation["e"] == 0.0
    assert prep.fit_scaling(df.limit(0), ["a"]) == prep.Scaling({"a": 0.0}, {"a": 0.0})
    with pytest.raises(ValueError, match="not finite"):
        prep.fit_scaling(spark.createDataFrame([(float("inf"),)], "a double"), ["a"])


def test_retraining_moves_the_pointer(spark, tables, tmp_path):
    source, root = str(tmp_path / "training"), str(tmp_path / "model")
    files.training_rows(tables.both[1]).write.json(source)
    trainer.train_from_json(spark, source, root, "close_3d", 1)
    first = models.current_version(spark, root)
    trainer.train_from_json(spark, source, root, "close_2w", 2)
    assert len(models.load_current(spark, root).stages[-1].trees) == 2
    second = models.current_version(spark, root)
    assert second > first
    models.set_current(spark, root, first)
    assert len(models.load_current(spark, root).stages[-1].trees) == 1
    with pytest.raises(FileNotFoundError):
        models.set_current(spark, root, "nothing")


def test_a_retrain_that_fails_keeps_the_model(spark, tables, tmp_path, monkeypatch):
    source, root = str(tmp_path / "training"), str(tmp_path / "model")
    files.training_rows(tables.both[1]).write.json(source)
    trainer.train_from_json(spark, source, root, rounds=1)
    before = models.current_version(spark, root)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("[1, 2")
    with pytest.raises(Exception):
        trainer.train_from_json(spark, str(tmp_path / "bad"), root, rounds=1)

    def half(model, path):  # fails after some files are written
        model.stages[0].save(f"{path}/stages")
        raise OSError("disk full")

    monkeypatch.setattr(models, "save_model", half)
    with pytest.raises(OSError):
        trainer.train_from_json(spark, source, root, rounds=2)
    assert models.current_version(spark, root) == before
    assert len(models.load_current(spark, root).stages[-1].trees) == 1


def test_stream_scores_equal_batch_scores(spark, tables, trained, tmp_path):
    model, root = trained
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = files.scoring_rows(tables.both[1])
    rows.filter("`Quote.No` < '5'").repartition(3).write.json(source)
    streams.score_stream(streams.read_records(spark, source), root, target, state).awaitTermination()
    # Later files are picked up by the next start; earlier ones are not scored again.
    rows.filter("`Quote.No` >= '5'").write.mode("append").json(source)
    streams.score_stream(streams.read_records(spark, source), root, target, state).awaitTermination()
    stream = streams.read_scores(spark, target).drop("model")
    batch = trainer.score_records(tables.both[1].select(QUOTE, *FEATURES), model)
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0


def test_a_running_stream_changes_model_at_a_batch_border(spark, tables, tmp_path):
    training, source, root, target = (str(tmp_path / n) for n in ("training", "in", "model", "out"))
    files.training_rows(tables.both[1]).write.json(training)
    trainer.train_from_json(spark, training, root, rounds=1)
    rows = files.scoring_rows(tables.both[1])
    rows.filter("`Quote.No` < '5'").coalesce(1).write.json(source)
    stream = streams.score_stream(
        streams.read_records(spark, source), root, target, str(tmp_path / "state"), forever=True
    )
    stream.processAllAvailable()
    first = models.current_version(spark, root)
    trainer.train_from_json(spark, training, root, "close_2w", rounds=2)
    second = models.current_version(spark, root)
    rows.filter("`Quote.No` >= '5'").coalesce(1).write.mode("append").json(source)
    stream.processAllAvailable()
    stream.stop()
    scored = streams.read_scores(spark, target)
    by_model = {r["model"]: r["n"] for r in scored.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert by_model == {first: rows.filter("`Quote.No` < '5'").count(), second: rows.filter("`Quote.No` >= '5'").count()}
    late = scored.filter(F.col("model") == second).drop("model")
    batch = trainer.score_records(tables.both[1].select(QUOTE, *FEATURES), models.load_version(root, second))
    assert late.exceptAll(batch).count() == 0


def test_raw_records_are_scored_by_a_stream(spark, tables, tmp_path):
    raw, scaling = tables.raw_and_scaling
    source, root, target = (str(tmp_path / n) for n in ("in", "model", "out"))
    model = close_rate.fit_on_raw(raw, scaling, "close_3d", rounds=2)
    models.save_version(spark, model, root)
    raw.select(QUOTE, *FEATURES).write.json(source)
    schema = raw.select(QUOTE, *FEATURES).schema
    score = lambda rows, m: models.predict_class(m, rows, "p").select(QUOTE, F.col("p_prob").alias("score"))
    streams.score_stream(
        streams.read_records(spark, source, schema), root, target, str(tmp_path / "state"), score=score
    ).awaitTermination()
    got = streams.read_scores(spark, target).drop("model")
    assert got.exceptAll(score(raw, model)).count() == 0 and got.count() == raw.count()


def test_latest_score_wins_across_batches(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "quote_no string, score double, arrival bigint"

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        records = spark.readStream.schema(schema).json(source)
        streams.latest_score_stream(
            records, "score", "arrival", target, state
        ).awaitTermination()
        latest = streams.read_latest_scores(spark, target, "score", "arrival")
        return {r["quote_no"]: r["score"] for r in latest.collect()}

    assert arrive([("q", 0.1, 1), ("q", 0.3, 3), ("r", 0.2, 2)]) == {"q": 0.3, "r": 0.2}
    # A late record with an earlier arrival does not win.
    assert arrive([("q", 0.9, 2), ("r", 0.8, 5), ("s", 0.5, 4)]) == {"q": 0.3, "r": 0.8, "s": 0.5}


def test_latest_scores_stay_few_files_over_many_batches(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "quote_no string, score double, arrival bigint"
    rng = random.Random(9)
    rows = [(f"q{rng.randrange(30)}", float(i), (i * 7919) % 5003) for i in range(800)]
    (tmp_path / "in").mkdir()
    for k in range(40):
        lines = [json.dumps({"quote_no": q, "score": s, "arrival": a}) for q, s, a in rows[k::40]]
        (tmp_path / "in" / f"{k:03d}.json").write_text("\n".join(lines))
    records = streams.read_records(spark, source, schema, files_per_batch=1)
    streams.latest_score_stream(records, "score", "arrival", target, state, fold_every=5).awaitTermination()
    folders = remote.names(spark, target)
    assert sum(n.startswith("snapshot=") for n in folders) == 2
    assert sum(n.startswith("batch=") for n in folders) <= 10
    assert len(streams._parts(spark, target)) <= 6

    def latest():
        found = streams.read_latest_scores(spark, target, "score", "arrival")
        return {r["quote_no"]: r["score"] for r in found.collect()}

    want = {}
    for q, s, a in sorted(rows, key=lambda r: r[2]):
        want[q] = s
    assert latest() == want
    # A batch that is repeated after it was folded, and a fold that is repeated.
    again = spark.createDataFrame([rows[0]], schema)
    streams._latest(again, "score", "arrival").write.mode("overwrite").parquet(f"{target}/batch=3")
    streams.fold(spark, target, 39, "score", "arrival")
    assert latest() == want
    # A snapshot that was broken off does not count.
    (tmp_path / "out" / "snapshot=99").mkdir()
    assert latest() == want


class _Waiting:
    """A pipeline whose fit waits for the others."""

    def __init__(self, barrier, name):
        self.barrier, self.name = barrier, name

    def fit(self, rows):
        self.barrier.wait(60)
        return self.name, rows.columns


def test_models_are_fitted_at_the_same_time(spark):
    rows = spark.range(5).selectExpr("double(id) AS x", "int(id % 2) AS y")
    barrier = Barrier(3)
    fitted = models.fit_all((_Waiting(barrier, name), rows, "y") for name in "abc")
    assert fitted == [(name, ["x", "y", models.MODEL_LABEL]) for name in "abc"]


def test_training_rows_lie_in_even_partitions(spark):
    assert [models.training_parts(n, 12) for n in (0, 9_000, 100_000, 5_600_000, 33_600_000)] == [1, 1, 10, 12, 72]
    uneven = spark.range(0, 60_000, 1, 1).union(spark.range(0, 20_000, 1, 12))
    rows = models.dealt(uneven.withColumn("x", F.col("id") % 3))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and sum(sizes) == 80_000 and max(sizes) < 1.1 * min(sizes)


def test_training_parses_records_once(spark, tables, tmp_path, monkeypatch):
    source, trained_on = str(tmp_path / "rows"), []
    files.training_rows(tables.both[1]).write.json(source)
    fit = models.fit
    monkeypatch.setattr(models, "fit", lambda p, rows, label: trained_on.append(rows) or fit(p, rows, label))
    trainer.train_from_json(spark, source, str(tmp_path / "model"), rounds=1)
    assert all(p.endswith(".parquet") for p in trained_on[0].inputFiles())
    assert trained_on[0].count() == tables.both[1].count()
