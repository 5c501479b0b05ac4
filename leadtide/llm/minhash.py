"""Near duplicates by b-bit MinHash.

A document's set is its distinct shingles of as many words as the ``Rule`` says. ``HASHES``
minima of the set give ``bands`` band keys of ``rows`` minima each, and a packed signature of
the ``BITS`` low bits of every minimum. Documents that share a band key are candidates; for a candidate pair the
share of equal slots, counted by bit operations on whole longs and corrected for chance
collisions, estimates the similarity, and pairs far below the threshold go. What is left is
confirmed on full sets.

Two texts at the threshold miss each other in all bands with probability
``(1 - threshold ** rows) ** bands``, under one in a million for both rules here, and are
turned away by the estimate, six deviations below, about as rarely.

Large groups: exact copies are one class with its smallest id. In a band, members are first
paired with the smallest member alone. Only bands that still hold several components go on.
There, a set with too many shingles that no other has can link with nothing and is dropped;
the rest meet the set with the fewest such shingles, the hub of the band. What still stands
apart then is compared by its differences from the hub, which hold none of the shingles that
the band has in common: two sets that link have a rare difference in common (see
``_differences``). First one set of each such group meets the others, then what is still
apart meets. That step is exact. Every step is a join that Spark can split; no task holds a
band.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.llm import hashing
from leadtide.llm.common import components, ship
from leadtide.workspace import store

HASHES = 128
BITS = 4
LONGS = HASHES * BITS // 64
BROADCAST_IDS = 1_000_000
#: Most shingles of hubs that are broadcast, 8 bytes each; parts of a hub's sets beyond that.
BROADCAST_SHINGLES, HUB_PARTS = 2_000_000, 16

_RANDOM = np.random.default_rng(7)
_A = _RANDOM.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)
LOW_BITS = 0x1111111111111111


@dataclass(frozen=True)
class Rule:
    """Texts are near duplicates if ``percent`` of their shingles of ``words`` words agree."""

    words: int = 5
    percent: int = 80
    rows: int = 4
    bands: int = 32

    @property
    def estimate(self) -> float:
        """Estimates below this are turned away: six deviations under the threshold."""
        j = self.percent / 100
        return j - 6 * (j * (1 - j) / HASHES) ** 0.5


FIVE_WORDS = Rule()
THREE_WORDS = Rule(words=3, percent=85, rows=5, bands=25)


def shingles(text: str | None, length: int) -> tuple[np.ndarray, list[bytes]]:
    """Hashes of the distinct shingles, sorted, and the words."""
    words = (text or "").encode(errors="replace").lower().split()
    if not words:
        return np.empty(0, np.uint64), words
    hashes = hashing.word_hashes(words)
    return np.unique(hashing.windows(hashes, min(length, len(words)))), words


def minima(found: np.ndarray) -> np.ndarray:
    """The high halves of the minima of ``HASHES`` functions over a set."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        for k in range(0, HASHES, 16):
            values = _A[k : k + 16, None] * part + _B[k : k + 16, None]
            np.minimum(out[k : k + 16], values.min(axis=1), out=out[k : k + 16])
    return out >> np.uint64(32)


def _signatures(rule: Rule):
    length, n_rows, n_bands = rule.words, rule.rows, rule.bands

    def run(batches):
        names = ["doc_id", "n", "key", "bands", "sig"]
        lanes = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts, keys, bands, sigs = part.column(0), [], [], [], []
                for text in part.column(1).to_pylist():
                    found, words = shingles(text, length)
                    counts.append(len(found))
                    if not len(found):
                        keys.append(None), bands.append(None), sigs.append(None)
                        continue
                    keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    least = minima(found)
                    rows = least[: n_rows * n_bands].reshape(n_bands, n_rows)
                    band = rows[:, 0]
                    for r in range(1, n_rows):
                        band = hashing.join(band, rows[:, r])
                    bands.append(band.view(np.int64))
                    low = (least & np.uint64((1 << BITS) - 1)).reshape(LONGS, -1)
                    sigs.append(np.bitwise_or.reduce(low << lanes, axis=1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sigs, pa.list_(pa.int64())),
                    ],
                    names=names,
                )

    return run


def _sets(length: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t, length)[0].view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "members"]
                )

    return run


def _estimate() -> str:
    """SQL: the similarity of two signatures, corrected for equal low bits by chance."""
    fold = f"shiftrightunsigned(x, {BITS // 2})"
    differing = "aggregate(zip_with(sig_a, sig_b, (p, q) -> p ^ q), 0, (n, x) -> n + bit_count("
    # Fold the bits of a slot onto its lowest one.
    step = f"(x | {fold})"
    slot = f"({step} | shiftrightunsigned({step}, 1))"
    chance = 1 / (1 << BITS)
    equal = f"(1 - {differing}{slot} & {LOW_BITS}L)) / {HASHES}D)"
    return f"({equal} - {chance}D) / {1 - chance}D"


def _shingle_sets(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """``id``, ``members`` of the documents in ``ids``, broadcast if they are few."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return (
        docs.select("doc_id", "text")
        .join(ids, "doc_id", "left_semi")
        .mapInArrow(_sets(rule.words), "id bigint, members array<bigint>")
    )


def _confirm(docs: DataFrame, pairs: DataFrame, signatures: DataFrame, rule: Rule) -> DataFrame:
    """The links among candidate ``pairs`` (a, b), on full sets."""
    near = store(
        pairs.join(signatures.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(signatures.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
        .filter(f"{_estimate()} >= {rule.estimate}")
        .select("a", "b"),
        "pairs",
    )
    ids = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = _shingle_sets(docs, ids, rule)
    return (
        near.join(sets.select(F.col("id").alias("a"), F.col("members").alias("set_a")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("members").alias("set_b")), "b")
        .selectExpr(
            "a", "b", "size(set_a) + size(set_b) AS both",
            "size(array_intersect(set_a, set_b)) AS shared",
        )
        .filter(f"100 * shared >= {rule.percent} * (both - shared)")
        .select("a", "b")
        .distinct()
    )


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the component of ``rep``."""
    found = components(links).withColumnRenamed("id", "rep")
    return rows.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of bands that hold more than one component."""
    several = (
        members.groupBy("band", "key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low != high")
        .select("band", "key")
    )
    return members.join(several, ["band", "key"], "left_semi")


def _possible(docs: DataFrame, members: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``members`` of mixed bands without those that can link with nothing there, and the
    sets of all that were looked at.

    Adds ``n``, the set's size, and ``m``, its shingles that some other member has too. A
    link shares at most ``m`` shingles, with a set that is at least ``percent`` as large and no
    smaller than the smallest of the band. What this rules out has no link at all, so it can
    be dropped, and then more shingles stand alone: two passes.
    """
    members = _mixed(members)
    for turn in range(2):
        ids = store(members.select(F.col("rep").alias("doc_id")).distinct(), "open-ids")
        rows = store(_shingle_sets(docs, ids, rule), "open-sets")
        alone = (
            rows.select("id", F.explode("members").alias("shingle"))
            .groupBy("shingle")
            .agg(F.min("id").alias("id"), F.max("id").alias("last"))
            .filter("id = last")
            .groupBy("id")
            .agg(F.count(F.lit(1)).alias("alone"))
        )
        sizes = (
            rows.select("id", F.size("members").alias("n"))
            .distinct()
            .join(alone, "id", "left")
            .selectExpr("id AS rep", "n", "n - coalesce(alone, 0L) AS m")
        )
        known = members.select("rep", "band", "key", "component").join(sizes, "rep")
        least = known.groupBy("band", "key").agg(F.min("n").alias("least"))
        open_rows = known.join(least, ["band", "key"]).filter(
            f"{100 + rule.percent} * m >= {rule.percent} * (n + greatest(least, {rule.percent / 100}D * n))"
        )
        members = store(_mixed(open_rows.drop("least")), "open-bands")
    return members, rows


def _beside_hubs(who: DataFrame, sets: DataFrame) -> DataFrame:
    """``who`` with its set (``members``) and that of its hub (``core``), dealt by ``id``.

    All sets of a hub never meet in one task, as a join by ``hub`` alone would have it: few hubs
    are broadcast; many are joined in parts of their sets, and the result is dealt by ``id``.
    """
    cores = sets.withColumnsRenamed({"id": "hub", "members": "core"}).join(who.select("hub").distinct(), "hub", "left_semi")
    cores = store(cores, "hub-sets")
    if (cores.agg(F.sum(F.size("core"))).first()[0] or 0) <= BROADCAST_SHINGLES:
        return who.join(sets.hint("merge"), "id").join(F.broadcast(cores), "hub")
    part = F.pmod(F.xxhash64("id"), F.lit(HUB_PARTS))
    cores = cores.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))))
    placed = who.withColumn("part", part.cast("int")).join(cores, ["hub", "part"]).drop("part")
    return placed.join(sets.hint("merge"), "id")


def _differences(open_rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The rare differences of open sets from the hubs of their bands.

    Sets a and b link if they differ in at most ``t = k * (|a| + |b|)`` shingles, where
    ``k = (1 - percent) / (1 + percent)``. With A and B their differences from a hub h, a and b
    differ in as many shingles as A and B do. If not both link with h, A and B together have
    more than t members, so a link needs a common one; in any order, of those before the first
    common one, in A and in B, there are at most t, and in one of them at most t / 2. The order
    is by the number of open sets with that difference. Those that one set alone has come first
    and are only counted; they meet nothing.

    Rows: ``hub``, ``shingle``, ``id``, ``component``, ``n``, ``apart`` (all its differences),
    ``place`` (members before it), and ``short``: whether at most t / 2 for the largest t that
    the set may have.
    """
    who = open_rows.select(F.col("rep").alias("id"), "hub", "n", "component").distinct()
    sets = sets.dropDuplicates(["id"])
    apart = store(
        _beside_hubs(who, sets)
        .selectExpr(
            "id", "hub", "n", "component", "concat(array_except(members, core), array_except(core, members)) AS all"
        )
        .selectExpr("id", "hub", "n", "component", "size(all) AS apart", "explode(all) AS shingle"),
        "differences",
    )
    often = apart.groupBy("hub", "shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    most = f"n * {(100 - rule.percent) / rule.percent!r}D"
    return store(
        apart.join(often, ["hub", "shingle"])
        .groupBy("id", "hub", "n", "component", "apart")
        .agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("s"))
        .selectExpr("*", "apart - size(s) AS alone")
        .selectExpr("*", f"posexplode(slice(s, 1, greatest(int({most}) + 1 - alone, 0))) AS (at, one)")
        .selectExpr("hub", "one.shingle AS shingle", "id", "component", "n", "apart", "alone + at AS place")
        .withColumn("short", F.expr(f"place <= int({most} / 2)")),
        "rare-differences",
    )


def _may_link(rule: Rule) -> str:
    """SQL: sides a and b of ``_differences`` are of different components and may link.

    If the common difference is their first one, no more than those from it on can be common,
    in A as in B, and all others are differences between a and b.
    """
    k = (100 - rule.percent) / (100 + rule.percent)
    return (
        "id_a != id_b AND component_a != component_b AND "
        "greatest(apart_a - apart_b + 2 * place_b, apart_b - apart_a + 2 * place_a) "
        f"<= {k!r}D * (n_a + n_b) + 1e-9 AND "
        f"100 * least(n_a, n_b) >= {rule.percent} * greatest(n_a, n_b)"
    )


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("hub", "shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n", "apart", "place")])


def _pairs_of(joined: DataFrame, rule: Rule) -> DataFrame:
    pairs = joined.filter(_may_link(rule))
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def _first_pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """One set of each group of a common difference, the one that has it first, with the rest."""
    one = F.min(F.struct("place", "id", "component", "n", "apart")).alias("one")
    chosen = rows.filter("short").groupBy("hub", "shingle").agg(one).select("hub", "shingle", "one.*")
    return _pairs_of(_side(chosen, "a").join(_side(rows, "b"), ["hub", "shingle"]), rule)


def _other_pairs(rows: DataFrame, links: DataFrame, rule: Rule) -> DataFrame:
    """All pairs with a common difference whose sets are still of different components."""
    found = components(links).select(F.col("id"), F.col("component").alias("now"))
    rows = rows.join(found, "id", "left").withColumn("component", F.coalesce("now", "id")).drop("now")
    several = (
        rows.groupBy("hub", "shingle")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low != high")
        .select("hub", "shingle")
    )
    rows = store(rows.join(several, ["hub", "shingle"], "left_semi"), "rare-differences")
    return _pairs_of(_side(rows.filter("short"), "a").join(_side(rows, "b"), ["hub", "shingle"]), rule)


def near_duplicates(docs: DataFrame, rule: Rule = FIVE_WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``kept`` of every row of ``docs``.

    Null and empty texts, and texts of white space, have no shingles and link with nothing.
    A null id links with nothing either; its component is null and it is kept. Rows that
    share an id share a component, and of several texts of the smallest id of their classes the
    one with the smallest hash is searched; equal texts are always one component. Other columns are not read. An empty table gives an
    empty one. Very long texts have larger sets and the same signature size.
    """
    ship(docs.sparkSession)
    signed = store(
        docs.select("doc_id", "text").mapInArrow(
            _signatures(rule),
            "doc_id bigint, n bigint, key binary, bands array<bigint>, sig array<bigint>",
        ),
        "signatures",
    )
    named = signed.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = store(
        named.join(classes, "key")
        .filter("doc_id = rep")
        .groupBy("rep")
        .agg(F.min_by(F.struct("bands", "sig"), "key").alias("first"))
        .select("rep", "first.bands", "first.sig"),
        "representatives",
    )
    bands = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"))
    members = store(bands.join(shared.filter("hub != last").drop("last"), ["band", "key"]), "bands")

    links = store(
        _confirm(docs, members.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), reps, rule),
        "found",
    )
    members = members.drop("hub")
    open_rows, sets = _possible(docs, store(_labelled(members, links), "placed"), rule)
    if open_rows.limit(1).count():
        # The set with the fewest shingles of its own is the likeliest to link.
        hubs = open_rows.groupBy("band", "key").agg(
            F.min(F.struct((F.col("n") - F.col("m")).alias("own"), "rep", "component")).alias("hub")
        )
        open_rows = store(open_rows.join(hubs, ["band", "key"]), "hubs")
        second = (
            open_rows.filter("component != hub.component")
            .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
            .distinct()
        )
        links = store(links.unionByName(_confirm(docs, second, reps, rule)), "found")
        open_rows = _mixed(_labelled(open_rows.drop("component").withColumn("hub", F.col("hub.rep")), links))
        rows = _differences(store(open_rows, "open-bands"), sets, rule)
        for pairs_of in (lambda: _first_pairs(rows, rule), lambda: _other_pairs(rows, links, rule)):
            links = store(links.unionByName(_confirm(docs, pairs_of(), reps, rule)), "found")

    # An id with several texts joins their classes.
    classed = named.join(classes, "key").select("doc_id", "rep")
    several = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a != last")
    joined = classed.join(several.select("doc_id", "a"), "doc_id").filter("rep != a").select("a", F.col("rep").alias("b"))
    links = links.unionByName(joined.distinct())
    found = components(links).withColumnRenamed("id", "rep")
    placed = classes.join(found, "rep", "left").select(
        "key", F.coalesce("component", "rep").alias("component")
    )
    ids = named.join(placed, "key").groupBy("doc_id").agg(F.min("component").alias("component"))
    out = signed.select("doc_id", "n").join(ids, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
