"""Language of documents that may mix languages.

Each language is a distribution of letter trigrams, counted over all labelled training
documents. A document is a mixture: expectation-maximisation over its trigrams finds the
proportions of the languages. Sets of languages are nested by proportion; the set with the
best likelihood less ``PENALTY * log(trigrams)`` for every language after the first is taken.

Trigrams are hashed to ``BUCKETS`` slots, so the model has languages times buckets numbers,
whatever the corpus; counts are summed in the tasks before they are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadtide.llm.common import row_struct, ship
from leadtide.workspace import store

UNKNOWN = "und"
BITS = 15
BUCKETS = 1 << BITS
SMOOTHING = 0.5
PENALTY = 3.0
STEPS, REFIT_STEPS = 10, 4
BATCH_BYTES = 1 << 19
#: Number signs such as ² are no letters.
LETTER = regex.compile(r"\p{L}")

_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Slots of the trigrams of the lower-cased letters; other characters part words."""
    letters = _CLASS[np.frombuffer(f" {text.lower()} ".encode(errors="replace"), np.uint8)]
    space = letters == 32
    letters = letters[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    code = (letters[:-2] << 16) | (letters[1:-1] << 8) | letters[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training. A null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(grams(text), minlength=BUCKETS)
    pa.default_memory_pool().release_unused()  # the worker lives on
    for lang, counts in sums.items():
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(slots)), pa.array(slots, pa.int32()), pa.array(counts[slots])],
            names=["lang", "slot", "n"],
        )


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their trigram probabilities, from ``lang`` and ``text``."""
    ship(labelled.sparkSession)
    counts = (
        labelled.select("lang", "text")
        .filter("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_count, "lang string, slot int, n bigint")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    counts = store(counts, "language-counts")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    table = np.full((len(names), BUCKETS), SMOOTHING)
    # The counts of one language at a time: at most as many rows as there are buckets. The model
    # grows with the languages alone, 256 kB each.
    for k, name in enumerate(names):
        rows = counts.filter(F.col("lang") == name).toPandas()
        table[k, rows["slot"]] += rows["n"]
    if names:
        table /= table.sum(axis=1, keepdims=True)
    return names, table


def mixtures(texts: list[str], model: np.ndarray) -> np.ndarray:
    """Proportions of the languages in each text; zero for languages that are not taken.

    ``model``: slots by languages. All texts step together; every text must have a trigram.
    """
    slots = [grams(t) for t in texts]
    key = np.concatenate([s.astype(np.int64) + (i << BITS) for i, s in enumerate(slots)])
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.float64)
    key = key[first]
    doc = key >> BITS
    start = np.searchsorted(doc, np.arange(len(texts)))
    total = np.add.reduceat(count, start)
    prob = model[key & (BUCKETS - 1)]
    n_langs = prob.shape[1]

    def fit(pi, steps):
        for step in range(steps + 1):
            mixed = prob * pi[doc]
            whole = mixed.sum(axis=1)
            if step == steps:
                return pi, np.add.reduceat(count * np.log(whole), start)
            mixed *= (count / whole)[:, None]
            pi = np.add.reduceat(mixed, start, axis=0) / total[:, None]

    pi, _ = fit(np.full((len(texts), n_langs), 1 / n_langs), STEPS)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1)
    best, value = None, None
    for size in range(1, n_langs + 1):
        part = np.where(rank < size, pi, 0.0)
        part /= part.sum(axis=1, keepdims=True)
        part, likelihood = fit(part, REFIT_STEPS if size > 1 else 0)
        worth = likelihood - PENALTY * (size - 1) * np.log(total + 1)
        if best is None:
            best, value = part, worth
        else:
            better = worth > value
            best[better], value[better] = part[better], worth[better]
    return best


def _predict(names, shared):
    def judged(rows, texts):
        model = shared.value
        found = [i for i, t in enumerate(texts) if t and names and LETTER.search(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if found:
            pi = mixtures([texts[i] for i in found], model)
            top = pi.argmax(axis=1)
            for i, l, p in zip(found, top, pi[np.arange(len(found)), top]):
                langs[i], scores[i] = names[l], float(min(1.0, p))
        return pa.RecordBatch.from_arrays(
            [rows, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["row", "lang_pred", "score"]
        )

    def run(batches):
        for batch in batches:
            texts, held, begin = [], 0, 0
            column = batch.column("text")
            for i in range(batch.num_rows):
                texts.append(column[i].as_py())
                held += len(texts[-1] or "")
                if held >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield judged(batch.column("row").slice(begin, len(texts)), texts)
                    texts, held, begin = [], 0, i + 1
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def predict(docs: DataFrame, labelled: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all if None) of ``docs`` with ``lang_pred`` and ``score``.

    ``labelled`` trains the model. ``lang_pred`` is the language with the largest proportion,
    ``score`` that proportion in the taken set. Null texts and texts without a letter are
    ``und`` with score 0, and so is everything if there is nothing to learn from. Ties go to
    the first language by code point. Repeated rows get the same; an empty table gives an
    empty one. Clashing input columns named ``lang_pred`` or ``score`` are replaced.
    """
    spark = docs.sparkSession
    names, table = train(labelled)
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(table.T))
    keep = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = row_struct(docs.select(*docs.columns), "text").withColumn(
        "row", F.struct(*[F.col("row")[c].alias(c) for c in keep])
    )
    kind = rows.schema["row"].dataType.simpleString()
    done = rows.mapInArrow(_predict(names, shared), f"row {kind}, lang_pred string, score double")
    return done.select("row.*", "lang_pred", "score")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")
