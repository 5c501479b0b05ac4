"""Suffix and substring dedup against sets of all strings and windows."""

import numpy as np
import plain_llm as plain

import pyarrow as pa

from leadtide import remote
from leadtide.llm import doubling, induced, suffix_dedup
from leadtide.workspace import folder as shared_folder


def test_suffix_dedup_equals_all_strings(spark):
    texts = plain.corpus()
    rows = plain.rows(texts)
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, plain.DOCS)).collect()
    want = plain.repeated_bytes(texts)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r
    assert sum(w[1] for w in want.values()) > 10000


def test_doubling_equals_all_windows(spark):
    texts = plain.corpus()
    rows = plain.rows(texts)
    got = doubling.remove_repeated(spark.createDataFrame(rows, plain.DOCS)).collect()
    want = plain.repeated_words(texts)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r


def test_nothing_repeats_in_nothing(spark):
    empty = spark.createDataFrame([], plain.DOCS)
    assert suffix_dedup.remove_repeated(empty).count() == 0
    assert doubling.remove_repeated(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(2)
    for size, letters in ((1, 2), (2, 1), (300, 2), (500, 1), (3000, 4), (3000, 256)):
        text = rng.integers(0, letters, size).astype(np.uint16)
        got = np.concatenate(list(induced.falling_suffixes(text)))
        whole = text.tolist()
        want = sorted(range(size), key=lambda k: whole[k:], reverse=True)
        shown = [k for k in got.tolist() if k < size]
        depth = induced.DEPTH
        assert sorted(shown) == list(range(size))
        assert [whole[k : k + depth] for k in shown] == [whole[k : k + depth] for k in want]


def test_prefix_groups_equal_prefixes():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 2), (49, 1), (120, 1), (700, 2), (3000, 257)):
        piece = rng.integers(0, letters, size)
        text = np.concatenate([piece, rng.integers(0, letters, 5), piece]).astype(np.uint16)
        group = {}
        for starts, groups in induced.prefix_groups(text):
            group.update(zip(starts.tolist(), groups.tolist()))
        ends = [*text.tolist(), *range(300, 300 + induced.DEPTH)]
        by_prefix = {}
        for k in range(len(text)):
            by_prefix.setdefault(tuple(ends[k : k + induced.DEPTH]), set()).add(group[k])
        assert all(len(g) == 1 for g in by_prefix.values())
        assert len(set.union(*by_prefix.values())) == len(by_prefix)


def test_suffix_dedup_leaves_no_working_tables(spark):
    """Tables that have been read go at once: disk holds those of one step."""
    place = f"{shared_folder(spark)}/leadtide"
    before = set(remote.names(spark, place))
    got = suffix_dedup.remove_repeated(spark.createDataFrame(plain.rows(plain.corpus()), plain.DOCS))
    left = {name.rsplit("-", 1)[0] for name in set(remote.names(spark, place)) - before}
    assert left == {"survey", "classes", "cut"}
    assert got.count() == len(plain.rows(plain.corpus()))


def test_contexts_of_many_documents_share_a_batch():
    texts = [f"{i} " + "the same words stand in every one of these documents " * 3 for i in range(50)]
    named = [np.unique(suffix_dedup._anchors(t.encode())[1]).view(np.int64) for t in texts]
    rows = pa.RecordBatch.from_pydict(
        {"doc_id": pa.array(range(50), pa.int64()), "text": texts, "found": pa.array([n.tolist() for n in named])}
    )
    got = [*suffix_dedup._contexts([rows])]
    assert len(got) == 1
    for doc, start, context in zip(*(got[0].column(c).to_pylist() for c in ("doc_id", "start", "context"))):
        assert texts[doc].encode()[start : start + len(context)] == context
    assert set(got[0].column("doc_id").to_pylist()) == set(range(50))
