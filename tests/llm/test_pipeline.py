"""The pipeline on a small folder with every odd row, stage by stage against plain rules."""

import random
import zlib

import corpus_pipeline as pipeline
import numpy as np
import plain_llm as plain
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadtide.llm import curriculum, language, minhash, queries

LETTERS = {"en": "etaoinshr", "fr": "çéèàùvxzq"}


def folder(spark, path):
    rng = random.Random(11)

    def text(lang, n):
        return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(3, 9))) for _ in range(n))

    rows = []
    for i in range(120):
        lang = "en" if i % 3 else "fr"
        rows.append((i, text(lang, rng.randrange(30, 120)), lang, ["web", "books", None][i % 5 % 3]))
    passage = text("en", 40)
    for i in range(120, 130):  # exact copies and near ones
        words = rows[i - 120][1].split()
        if i % 2:
            words[5] = "other"
        rows.append((i, " ".join(words), None, "web"))
    rows.append((130, text("en", 20) + " " + passage + " " + text("en", 20), "en", "web"))
    rows += [(131, None, "en", "web"), (132, "", None, None), (133, "² 12 ½ !!", "fr", "web"), (None, text("en", 50), "en", "web")]
    rows += [rows[7], (140, text("en", 30000), "en", "books")]
    schema = "doc_id bigint, text string, lang string, source string, row string, position int, score int"
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(0, passage), (1, None), (2, "some words that stand nowhere else at all in these texts here")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, passage


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, as read back from its files."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, passage = folder(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    found = {"documents": docs}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = found[name] = spark.read.parquet(f"{path}/{name}")
    return path, rows, passage, found


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_stages_return_the_columns_of_documents(stages):
    _, _, _, found = stages
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "benchmark", "mix", "tokens"]
    for name in ("language", "near_duplicates", "benchmark", "mix"):
        assert found[name].columns == found["documents"].columns


def test_texts_without_a_letter_go_and_clean_ones_stay(stages):
    _, rows, _, found = stages
    want = sorted((i is None, i or 0) for i, t, *_ in rows if any(c.isalpha() for c in t or ""))
    assert ids(found["language"]) == want


def test_one_of_each_group_stays(stages):
    _, _, _, found = stages
    texts = {r.doc_id: r.text for r in found["language"].collect() if r.doc_id is not None}
    groups = plain.near_duplicates(texts, 5, 80)
    want = [(i is None, i or 0) for i in (r.doc_id for r in found["language"].collect()) if i is None or groups[i][2]]
    assert ids(found["near_duplicates"]) == sorted(want)
    assert len(want) < found["language"].count()


def test_documents_with_benchmark_items_go(stages):
    _, _, passage, found = stages
    want = [(r.doc_id is None, r.doc_id or 0) for r in found["near_duplicates"].collect() if passage not in r.text]
    assert ids(found["benchmark"]) == sorted(want)
    assert found["near_duplicates"].filter("doc_id = 130").count() == 1


def test_the_mix_reaches_its_targets(stages):
    _, _, _, found = stages
    taken = {r.number: r for r in curriculum.taken(found["benchmark"], ["doc_id"]).selectExpr("monotonically_increasing_id() AS number", "*").collect()}
    size = {}
    for r in found["mix"].collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + len(plain.split(r.text))
    want = {}
    for r in taken.values():
        want[r.row.doc_id] = want.get(r.row.doc_id, 0) + r.taken
    assert {k: v for k, v in want.items() if v} == size


def test_tokens_are_in_training_order(stages):
    """The order of the documents in the files is that of their positions in the mix."""
    _, _, _, found = stages
    assigned = curriculum.assign(found["benchmark"], keep=["doc_id", "text"])
    places = [(p, r.row.doc_id, r.row.text) for r in assigned.collect() for p in r.positions]
    places.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0))
    packed = sorted(found["tokens"].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in packed] == [d for _, d, _ in places]
    whole = Tokenizer.from_file(queries.tokenizer_path())
    at = 0
    for r, (_, _, text) in zip(packed, places):
        tokens = [*whole.encode(text, add_special_tokens=False).ids, queries.END_ID]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        at += len(tokens)
    assert [r.doc_id for r in packed] != sorted((r.doc_id for r in packed), key=lambda i: (i is not None, i or 0))


def test_run_gives_what_the_stages_give(spark, stages):
    path, _, _, found = stages
    got = pipeline.run(spark, path)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, found["tokens"].collect()), key=str)


def test_an_empty_table_goes_through(spark, stages, tmp_path):
    path, _, _, found = stages
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    found["documents"].limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    unread = found["mix"].limit(5)  # not straight from files
    assert pipeline.tokens(spark, spark.createDataFrame(unread.collect(), unread.schema), path).count() == 5


def test_letters_of_other_kinds(spark):
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(["the cat", "der hund"] * 6)]
    odd = [(100, "²"), (101, "½ ½"), (102, "①"), (103, "ª"), (104, "日本"), (105, "12_3")]
    docs = spark.createDataFrame([*rows, *[(i, t, None) for i, t in odd]], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, docs.select("lang", "text")).collect()}
    assert {i: got[i] == language.UNKNOWN for i, _ in odd} == {100: True, 101: True, 102: True, 103: False, 104: False, 105: True}


def test_an_id_with_two_texts_joins_their_groups(spark):
    one, two = (" ".join(f"{w}{i}" for i in range(30)) for w in ("a", "b"))
    rows = [(1, one), (5, two), (5, one), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(docs, minhash.THREE_WORDS)
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(1, 1), (5, 1), (7, 1)}
    assert got.filter(F.col("kept")).count() == 1


def plain_mixture(text, model):
    """Proportions of one text by EM, one trigram after another, and the penalised set."""
    count = {}
    for slot in language.grams(text).tolist():
        count[slot] = count.get(slot, 0) + 1
    total, n_langs = sum(count.values()), model.shape[1]

    def steps(pi, n):
        for _ in range(n):
            new = [0.0] * n_langs
            for slot, c in count.items():
                whole = sum(model[slot][k] * pi[k] for k in range(n_langs))
                for k in range(n_langs):
                    new[k] += c * model[slot][k] * pi[k] / whole
            pi = [x / total for x in new]
        likelihood = sum(c * np.log(sum(model[s][k] * pi[k] for k in range(n_langs))) for s, c in count.items())
        return pi, likelihood

    pi, _ = steps([1 / n_langs] * n_langs, language.STEPS)
    ranked = sorted(range(n_langs), key=lambda k: -pi[k])
    best = None
    for size in range(1, n_langs + 1):
        chosen = [pi[k] if k in ranked[:size] else 0.0 for k in range(n_langs)]
        part, likelihood = steps([x / sum(chosen) for x in chosen], language.REFIT_STEPS if size > 1 else 0)
        worth = likelihood - language.PENALTY * (size - 1) * np.log(total + 1)
        if best is None or worth > best[1]:
            best = part, worth
    return best[0]


def test_mixtures_equal_plain_expectation_maximisation():
    rng = random.Random(6)
    tongues = {"a": "etaoinshr", "b": "çéèàùvxzq", "c": "etaxzqwkj"}

    def text(lang, n):
        return " ".join("".join(rng.choice(tongues[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))

    table = np.full((3, language.BUCKETS), language.SMOOTHING)
    for k, lang in enumerate(tongues):
        table[k] += np.bincount(language.grams(text(lang, 3000)), minlength=language.BUCKETS)
    model = np.ascontiguousarray((table / table.sum(axis=1, keepdims=True)).T)
    texts = [text("a", 40), text("b", 1), text("a", 30) + " " + text("b", 30), "x", text("c", 60) + " " + text("a", 15)]
    texts += [" ".join(text(lang, 12) for lang in tongues), text("b", 200)]
    for got, t in zip(language.mixtures(texts, model), texts):
        assert np.allclose(got, plain_mixture(t, model), atol=1e-9), t
