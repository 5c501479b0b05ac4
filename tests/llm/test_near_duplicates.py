"""MinHash and binary-code near-dedup against all pairs."""

import numpy as np
import plain_llm as plain
import pytest
from pyspark.sql import functions as F

from leadtide.llm import binary_codes, minhash


@pytest.mark.parametrize("rule", [minhash.THREE_WORDS, minhash.FIVE_WORDS])
def test_minhash_equals_all_pairs(spark, rule):
    texts = plain.corpus()
    rows = plain.rows(texts)
    got = minhash.near_duplicates(spark.createDataFrame(rows, plain.DOCS), rule).collect()
    want = plain.near_duplicates(texts, rule.words, rule.percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id], r


def test_minhash_of_nothing(spark):
    got = minhash.near_duplicates(spark.createDataFrame([], plain.DOCS))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == 0


def test_only_pairs_that_may_link_meet_over_a_difference(spark):
    hub = list(range(100))
    sets = {0: hub, 1: [*hub, -5], 2: [*hub[18:], -5, *range(2000, 2017)], 3: [*hub[18:], *range(2000, 2018)]}
    members = spark.createDataFrame([*sets.items()], "id bigint, members array<bigint>")
    open_rows = spark.createDataFrame(
        [(i, 0, len(s), i) for i, s in sets.items() if i], "rep bigint, hub bigint, n int, component bigint"
    )
    rows = minhash._differences(open_rows, members, minhash.FIVE_WORDS)
    # 1 and 2 share their rarest difference; 35 others part them, and only 22 could.
    assert minhash._first_pairs(rows, minhash.FIVE_WORDS).collect() == [(2, 3)]
    # What one set alone has is counted as a difference and goes no further.
    found = {(r.id, r.shingle): (r.apart, r.place, r.short) for r in rows.collect()}
    assert found[1, -5] == (1, 0, True) and found[2, -5] == (36, 0, True) and (3, 2017) not in found
    assert found[3, 0] == (36, 1, True) and found[3, 17] == (36, 18, False)


def test_sets_of_one_hub_are_dealt_by_id(spark, monkeypatch):
    """Whether hubs are broadcast or not; nine in ten sets have the same hub."""
    sets = {i: [i, 1000 + i % 5] for i in range(400)}
    members = spark.createDataFrame([*sets.items()], "id bigint, members array<bigint>")
    hubs = [(i, i if i % 10 == 0 else 0, 2, i) for i in sets]
    who = spark.createDataFrame(hubs, "id bigint, hub bigint, n int, component bigint")
    for most in (minhash.BROADCAST_SHINGLES, 0):
        monkeypatch.setattr(minhash, "BROADCAST_SHINGLES", most)
        found = minhash._beside_hubs(who, members)
        rows = found.select("id", "hub", "n", "component", "members", "core", F.spark_partition_id().alias("part")).collect()
        got = {r.id: (r.hub, r.n, r.component, r.members, r.core) for r in rows}
        assert len(rows) == 400 and got == {i: (h, n, c, sets[i], sets[h]) for i, h, n, c in hubs}


def vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64))
    for i in range(60):  # groups at cosines on both sides of 0.9
        x[100 + i] = x[i % 12] + rng.normal(size=64) * (0.02 * (i % 30))
    x[200:230] = x[20]  # exact copies
    x[230:240] = x[20] * 3.5  # the same direction
    out = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]
    return x, [*out, *[(1000 + i, v, None) for i, v in enumerate(odd)], (None, x[0].tolist(), 1)]


def test_binary_codes_equal_all_pairs(spark):
    x, rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int")
    got = {r.vec_id: r for r in binary_codes.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    part = plain.smallest_reachable(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(linked)) if a < b])
    for i in range(len(x)):
        want = (linked[i].sum() - 1, part[i], part[i] == i)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == want, i
    for i in range(1000, 1006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].component_id is None and got[None].n_links == 0


def test_vectors_of_any_length_link(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=64)
    near = base + rng.normal(size=64) * 0.05
    rows = [(k, (v * scale).tolist()) for k, (v, scale) in enumerate([(base, 1e200), (near, 1e200), (base, 1e-200), (near, 1e-300), (-base, 1.0)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in binary_codes.near_duplicates(df).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (3, 0), 4: (0, 4)}


def test_recall_close_to_the_threshold(spark):
    """Pairs planted between 0.90 and 0.92 among vectors that are far apart."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(2000):
        side = x[10_000 + i] - (x[10_000 + i] @ x[i]) * x[i]
        cosine = rng.uniform(0.9001, 0.92)
        x[10_000 + i] = cosine * x[i] + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = binary_codes.near_duplicates(df).filter("vec_id BETWEEN 10000 AND 11999 AND component_id = vec_id - 10000").count()
    assert found >= 0.985 * 2000


def test_binary_codes_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert binary_codes.near_duplicates(df).count() == 0


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    b = a + rng.normal(size=a.shape) * 0.5
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    _, codes, factors = binary_codes.encode(a)
    turned, _, _ = binary_codes.encode(b)
    guess, spread = binary_codes.estimate(turned, codes, factors)
    true = (a * b).sum(axis=1)
    assert abs((guess - true).mean()) < 0.005
    assert (abs(guess - true) <= 5 * spread + 1e-9).mean() > 0.999
