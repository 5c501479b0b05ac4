"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters and digits, lower-cased. A document holds an item if some window of
``WINDOW`` tokens of the item stands in it with at most ``SUBSTITUTIONS`` tokens replaced. A
mask fixes some positions of a stretch of tokens and ignores the others; two windows with two
replaced tokens agree on every fixed position of at least one mask at one place, wherever the
replaced ones are (a test tries all 78 choices), so joining on the hashes of the fixed
positions loses nothing. Around each hit, on its diagonal, the windows are compared token by
token.

Items shorter than a window but of at least ``LEAST_TOKENS`` tokens must stand whole and
unchanged. Shorter items are no evidence and are ignored.

The hashes of the items are broadcast only if they are few; otherwise documents and items
meet by a shuffled join on the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.llm.common import row_struct
from leadtide.workspace import store

WINDOW = 13
SUBSTITUTIONS = 2
LEAST_TOKENS = 5
#: Fixed positions of the masks.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
TOKEN = r"[\\p{L}\\p{N}]+"
#: Tokens of a block, and those kept around it.
BLOCK, MARGIN = 64, WINDOW - 1
#: Item hashes that are broadcast at most: below 0.8 kB each with their block, 80 MB.
BROADCAST_SEEDS = 100_000
#: Contaminated ids that are broadcast at most, 8 bytes each.
BROADCAST_IDS = 500_000


def _tokens(text: str) -> str:
    """SQL: hashes of the tokens of a text."""
    return f"transform(regexp_extract_all(lower({text}), '{TOKEN}', 0), w -> xxhash64(w))"


def _blocks(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and blocks of its tokens: ``t``, and the places ``first`` to ``last`` it answers for.

    A block holds the tokens around its places that a comparison may need, so that a long text
    never stands in more than one row. The outer explode keeps Spark from adding a filter that
    would split every text once more.
    """
    blocks = (
        f"CASE WHEN size(t) >= {LEAST_TOKENS} THEN transform(sequence(0, size(t) - 1, {BLOCK}), s -> named_struct("
        f"'first', least(s, {MARGIN}), 'last', least(s, {MARGIN}) + least({BLOCK}, size(t) - s) - 1, "
        f"'t', slice(t, greatest(s - {MARGIN}, 0) + 1, least(s, {MARGIN}) + {BLOCK + MARGIN}))) END"
    )
    return rows.select(key, F.explode_outer(F.expr(blocks)).alias("b")).select(key, "b.first", "b.last", "b.t")


def _with_seeds(blocks: DataFrame, masks, only: str | None = None) -> DataFrame:
    """``blocks`` with a row for every ``place`` it answers for and mask, and its ``seed``.

    ``only``: SQL of the length an item must have for a mask, with ``{n}`` and ``{spaced}``.
    """
    seeds = []
    for number, mask in enumerate(masks):
        fits = f"place + {mask[-1]} < size(t)"
        if only:
            fits += " AND " + only.format(n=len(mask), spaced=str(number < len(MASKS)))
        picked = ", ".join(f"get(t, place + {p})" for p in mask)
        seeds.append(f"CASE WHEN {fits} THEN xxhash64({number}, {picked}) END")
    return (
        blocks.withColumn("place", F.explode_outer(F.expr("sequence(first, last)")))
        .withColumn("seed", F.explode(F.expr(f"array({', '.join(seeds)})")))
        .filter("seed IS NOT NULL")
    )


def matches(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``doc_id``, ``item_id`` of the documents of ``docs`` that hold an item, once each.

    Null and empty texts hold nothing and match nothing; null ids are given back as null.
    Repeated documents or items match alike. Only ``doc_id``, ``text`` and ``item_id``,
    ``text`` are read. Empty tables give an empty one.

    Up to ``broadcast_seeds`` item hashes are broadcast. Beyond, places and hashes alone meet by
    shuffle, and tokens are fetched for the hits by id and hash of the block; the comparison is
    exact, so rows that share an id cannot mislead it.
    """
    items = store(_blocks(benchmark.selectExpr("item_id", f"{_tokens('text')} AS t"), "item_id"), "items")
    # A block of fewer tokens than a window is a whole item.
    lengths = sorted(r[0] for r in items.filter(f"size(t) < {WINDOW}").select(F.size("t")).distinct().collect())
    masks = [*MASKS, *[tuple(range(n)) for n in lengths]]
    only = f"CASE WHEN {{spaced}} THEN size(t) >= {WINDOW} ELSE size(t) = {{n}} END"
    seeds = store(
        _with_seeds(items, masks, only).selectExpr("item_id", "t AS item_t", "place AS item_place", "seed"),
        "seeds",
    )
    blocks = _blocks(docs.selectExpr("doc_id", f"{_tokens('text')} AS t"), "doc_id")
    if seeds.count() <= broadcast_seeds:
        return _verified(_with_seeds(blocks, masks).join(F.broadcast(seeds), "seed"))
    blocks = store(blocks.withColumn("block", F.xxhash64("t")), "blocks")
    seeds = seeds.withColumn("item_block", F.xxhash64("item_t"))
    hits = (
        _with_seeds(blocks, masks)
        .selectExpr("doc_id AS d", "block AS db", "place", "seed")
        .join(seeds.selectExpr("item_id AS i", "item_block AS ib", "item_place", "seed"), "seed")
        .select("d", "db", "place", "i", "ib", "item_place")
        .distinct()
    )
    stretches = seeds.select("item_id", "item_block", "item_t").distinct()
    return _verified(
        hits.join(stretches, F.expr("i <=> item_id AND ib = item_block"))
        .join(blocks, F.expr("d <=> doc_id AND db = block"))
    )


def _verified(hits: DataFrame) -> DataFrame:
    """The hits on one diagonal are compared around the seed, in windows that hold its start.

    The compared stretch ends where the document or the item ends: a window must lie in both.
    A block holds all tokens up to a window's length away from its places.
    """
    shift = f"least(place, item_place, {WINDOW - 1})"
    length = f"least({WINDOW}, size(item_t))"
    near = f"least({shift} + {WINDOW}, size(t) - place + {shift}, size(item_t) - item_place + {shift})"
    equal = (
        f"zip_with(slice(t, place - {shift} + 1, {near}), slice(item_t, item_place - {shift} + 1, {near}), "
        "(x, y) -> int(x = y))"
    )
    allowed = f"CASE WHEN size(item_t) < {WINDOW} THEN 0 ELSE {SUBSTITUTIONS} END"
    return (
        hits.filter("place < size(t) AND item_place < size(item_t)")
        .selectExpr("doc_id", "item_id", f"{equal} AS equal", f"{length} AS n", f"{allowed} AS allowed")
        .filter(
            "size(equal) >= n AND exists(sequence(0, greatest(size(equal) - n, 0)), "
            "k -> aggregate(slice(equal, k + 1, n), 0, (s, x) -> s + x) >= n - allowed)"
        )
        .select("doc_id", "item_id")
        .distinct()
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged. Rows with a null id stay.

    The ids that go are joined to narrow ids first only if they are few; otherwise by shuffle.
    """
    bad = store(matches(docs.dropna(subset=["doc_id"]), benchmark).select("doc_id").distinct(), "contaminated")
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return row_struct(docs, "doc_id").join(bad, "doc_id", "left_anti").select("row.*")
