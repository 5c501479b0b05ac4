"""Repeated word windows, found at half their length first.

A window of ``LENGTH`` words that starts twice contains windows of half that length that start
twice. Level 1 looks at windows of ``LENGTH / 2`` words, and of these only at anchors: each
long window names the short window in it with the least hash. Equal long windows name equal
anchors at equal offsets, so a long window whose anchor is nowhere repeated is unique. Level 2
doubles the length around the repeated anchors alone: it hashes just the long windows that
named them, and the first start of each decides. The long windows of one anchor are
neighbours; their whole run is compared first, and of equal runs only the first goes on to be
compared window by window. The search ends there, as longer windows say nothing more; a level
without candidates leaves the next nothing to do.

Documents with equal words are one class; only its first member takes part, and later members
lose every window. Counting joins and sums over hashes is left to Spark: minima and counts are
combined before their shuffle, and a passage that a third of all documents share is a key with
many rows on one side of a join, which Spark splits: the other side is written first, as both
must come straight from a shuffle for that. Tables of a level are dropped when the next is
written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.llm import hashing
from leadtide.llm.common import beside_texts, ship
from leadtide.workspace import drop, store

LENGTH = 20
#: A run in one number: its first start times this, and how many starts follow.
RUN = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode(errors="replace").split()


def _anchors(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of half the length, and for every long window the place of its
    anchor."""
    half = length // 2
    found = hashing.windows(hashes, half)
    span = length - half + 1
    if len(found) < span:
        return found, np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(found, span).argmin(axis=1)
    return found, least + np.arange(len(least))


def _survey(length: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, keys, shas, places, hashed = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    words = _words(text)
                    joined = b" ".join(words)
                    n.append(len(words))
                    shas.append(hashlib.sha256(joined).hexdigest())
                    if len(words) < length:
                        keys.append(None), places.append(None), hashed.append(None)
                        continue
                    keys.append(hashlib.blake2b(joined, digest_size=16).digest())
                    found, anchor = _anchors(hashing.word_hashes(words), length)
                    anchor = np.unique(anchor)
                    places.append(anchor.astype(np.int32))
                    hashed.append(found[anchor].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(shas),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array(hashed, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_words", "key", "sha", "places", "hashes"],
                )

    return run


def _runs(length: int):
    """The runs of long windows that name a repeated anchor: first and last start, and two
    hashes of 64 bits over all words of the run (two long windows cover it)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                first, second = hashing.both_hashes(_words(batch.column("text")[i].as_py()))
                _, anchor = _anchors(first, length)
                edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
                low, high = edge[:-1], edge[1:] - 1
                kept = np.isin(anchor[low], np.array(batch.column("found")[i].as_py(), np.int64))
                low, high = low[kept], high[kept]
                keys = []
                for lane in (first, second):
                    whole = hashing.windows(lane, length)
                    keys.append(hashing.join(hashing.join(whole[low], whole[high]), (high - low).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(low), batch.column("doc_id")[i].as_py(), np.int64)),
                        pa.array(low.astype(np.int32)),
                        pa.array(high.astype(np.int32)),
                        *[pa.array(k.view(np.int64)) for k in keys],
                    ],
                    names=["doc_id", "low", "high", "hash", "hash2"],
                )

    return run


def _spans(column, i: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last starts of a document's runs."""
    runs = column[i].values.to_numpy(zero_copy_only=False)
    return runs // RUN, runs // RUN + runs % RUN


def _long(length: int):
    """The long windows of runs, with two hashes of 64 bits."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                low, high = _spans(batch.column("found"), i)
                start = np.repeat(low, high - low + 1)
                start = start + np.arange(len(start)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                lanes = hashing.both_hashes(_words(batch.column("text")[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(start), batch.column("doc_id")[i].as_py(), np.int64)),
                        pa.array(start.astype(np.int32)),
                        *[pa.array(hashing.windows(lane, length)[start].view(np.int64)) for lane in lanes],
                    ],
                    names=["doc_id", "place", "hash", "hash2"],
                )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            ids, removed, shas = [], [], []
            for i in range(batch.num_rows):
                words = _words(batch.column("text")[i].as_py())
                edge = np.zeros(len(words) + 1, np.int64)
                low, high = _spans(batch.column("found"), i)
                np.add.at(edge, low, 1)
                np.add.at(edge, high + length, -1)
                keep = np.cumsum(edge[:-1]) == 0
                ids.append(batch.column("doc_id")[i].as_py())
                removed.append(len(words) - int(keep.sum()))
                shas.append(hashlib.sha256(b" ".join([words[k] for k in np.flatnonzero(keep)])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas)],
                names=["doc_id", "removed", "cut_sha"],
            )

    return run


def repeated_anchors(reps: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``, the places of its anchors that also stand elsewhere."""
    rows = reps.select("doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("a")).select(
        "doc_id", F.col("a.places").alias("place"), F.col("a.hashes").alias("hash")
    )
    twice = store(
        rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "level-1-hashes"
    )
    found = store(
        rows.join(twice, "hash", "left_semi").groupBy("doc_id").agg(F.collect_set("place").alias("found")),
        "level-1",
    )
    drop(twice)
    return found


def _firsts(rows: DataFrame, at: str) -> DataFrame:
    """The first ``doc_id`` and ``at`` of all hashes that stand more than once; written."""
    place = F.struct("doc_id", at)
    first = rows.groupBy("hash", "hash2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    return store(first.filter("n > 1").drop("n"), "level-2-first")


def _later(rows: DataFrame, first: DataFrame, at: str) -> DataFrame:
    """``rows`` with ``later``: whether the same hashes stand at a smaller ``doc_id`` or, in the
    same document, at a smaller ``at``. ``first`` comes from ``_firsts``."""
    key = ["hash", "hash2"]
    place = F.struct("doc_id", at)
    later = F.coalesce(place != F.col("first"), F.lit(False))
    return rows.join(first, key, "left").select(*[c for c in rows.columns if c not in key], later.alias("later"))


def _by_document(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc_id").agg(F.collect_set(F.expr(f"bigint(low) * {RUN} + (high - low)")).alias("found"))


def repeated_starts(docs: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id`` and ``found``: runs of starts of long windows whose words also start earlier,
    as numbers (see ``RUN``).

    ``found``: the repeated anchors of the documents to search. A document's list is bounded by
    its own length.
    """
    whole = store(
        beside_texts(docs, found).mapInArrow(_runs(length), "doc_id bigint, low int, high int, hash bigint, hash2 bigint"),
        "level-2-runs",
    )
    first = _firsts(whole, "low")
    runs = store(_later(whole, first, "low"), "level-2-marked")
    drop(found, whole, first)
    firsts = store(_by_document(runs.filter("NOT later")), "level-2-firsts")
    windows = store(
        beside_texts(docs, firsts).mapInArrow(_long(length), "doc_id bigint, place int, hash bigint, hash2 bigint"),
        "level-2-windows",
    )
    drop(firsts)
    first = _firsts(windows, "place")
    single = _later(windows, first, "place").filter("later").select("doc_id", F.col("place").alias("low"), F.col("place").alias("high"))
    starts = store(_by_document(runs.filter("later").select("doc_id", "low", "high").unionByName(single)), "level-2")
    drop(windows, runs, first)
    return starts


#: Most ids of later copies that are broadcast, 8 bytes each.
BROADCAST_IDS = 1_000_000


def remove_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of every row of ``docs``.

    A word goes if a window of ``length`` words that covers it also starts earlier: in a
    smaller ``doc_id``, or before in the same document. Null, empty and short texts have no
    window and stay whole. Rows with a null id are later than all others and lose nothing but
    are returned; ids must otherwise be unique, and rows that repeat an id and a text are
    judged as one document and returned each. ``length`` is even and at most
    ``RUN``. Other columns are not read. An empty table gives an empty one.
    """
    if length % 2 or length > RUN:
        raise ValueError(f"length is even and at most {RUN}")
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    surveyed = store(
        docs.mapInArrow(
            _survey(length),
            "doc_id bigint, n_words bigint, key binary, sha string, places array<int>, hashes array<bigint>",
        ),
        "survey",
    )
    named = surveyed.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    firsts = store(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    # Documents that are no first of their words; what is left repeats an id only with its text.
    copies = store(
        named.select("key", "doc_id").join(firsts, "key").filter("doc_id != rep").select("doc_id").distinct(), "copies"
    )
    few = copies.count() <= BROADCAST_IDS
    reps = named.join(F.broadcast(copies) if few else copies, "doc_id", "left_anti")
    found = repeated_anchors(reps)
    rows = store(surveyed.select("doc_id", "n_words", "key", "sha"), "documents")
    drop(surveyed, copies)
    found = repeated_starts(docs.dropna(subset=["doc_id"]), found, length)
    cut = store(
        beside_texts(docs, found).mapInArrow(_cut(length), "doc_id bigint, removed bigint, cut_sha string").distinct(),
        "cut",
    )
    drop(found)
    rows = rows.join(firsts, "key", "left").join(cut, "doc_id", "left")
    later = F.col("rep") < F.col("doc_id")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(later, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(later, F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
