"""Mixing sources to target weights along a curriculum.

Every source has a weight that moves linearly from its start to its end over the training
time 0 to 1. The integral of the weight gives the source's share of all words. Within a
source, documents are put in a random but fixed order (a hash of the id); a document's place
in that order, in words, is a cumulative demand, and the time at which the source's schedule
has asked for that many words is found by inverting the integral. Sorting by it gives the
training order.

The place needs a running sum over a source that may hold most rows. Documents are cut into
hash buckets of about ``BUCKET_ROWS`` rows: sums per source and bucket are combined before
the shuffle, a window runs over these few sums, and another inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.llm.common import word_count
from leadtide.workspace import store

#: Start and end weight of the first, second, third source, and so on again; means 5, 2, 1.
SCHEDULE = ((6.0, 4.0), (2.0, 2.0), (0.5, 1.5))
MAX_REPEAT = 3
BUCKET_ROWS = 8192
#: SQL of the time at which the integral of a schedule reaches the part ``u`` of its whole.
TIME = (
    "CASE WHEN tilt = 0 THEN u ELSE ((1 + tilt) - "
    "sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * u, 0D))) / (2 * tilt) END"
)
EVERYTHING = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
EARLIER = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def source_targets(sizes: DataFrame, schedule=SCHEDULE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source_key``, ``source_size``, ``target``, ``tilt`` of each source.

    ``sizes``: one row a source with ``source_key``, ``source``, ``source_size``. Shares of the
    total follow the integrals of the weights. A target stops at ``max_repeat`` sizes and the
    excess is shared anew: the targets are ``least(cap, level * weight)`` for the one level at
    which they add up to the total, found by ordering the sources by cap over weight. The
    windows see one row a source.
    """
    n = len(schedule)
    start = "element_at(array({}), turn)".format(", ".join(f"{a}D" for a, _ in schedule))
    end = "element_at(array({}), turn)".format(", ".join(f"{b}D" for _, b in schedule))
    return (
        sizes.selectExpr(
            "*", f"int((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {n}) + 1 AS turn"
        )
        .selectExpr(
            "source_key",
            "source_size",
            f"({start} + {end}) / 2 AS weight",
            f"({start} - {end}) / ({start} + {end}) AS tilt",
            f"double({max_repeat} * source_size) AS cap",
        )
        .selectExpr(
            "*",
            f"sum(source_size) OVER (ORDER BY cap / weight, source_key {EVERYTHING}) AS total",
            f"coalesce(sum(cap) OVER (ORDER BY cap / weight, source_key {EARLIER}), 0D) AS capped",
            "sum(weight) OVER (ORDER BY cap / weight DESC, source_key DESC "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_weight",
        )
        # The level if just the sources before this one are at their caps.
        .selectExpr("*", "(total - capped) / open_weight AS guess")
        .selectExpr(
            "*",
            "max(CASE WHEN guess * weight <= cap THEN guess END) "
            f"OVER (ORDER BY cap / weight, source_key {EVERYTHING}) AS level",
        )
        .selectExpr(
            "source_key",
            "source_size",
            "tilt",
            "least(cap, coalesce(level * weight, cap)) AS target",
        )
    )


def assign(
    docs: DataFrame,
    schedule=SCHEDULE,
    max_repeat: int = MAX_REPEAT,
    seed: int = 17,
    bucket_rows: int = BUCKET_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Each row of ``docs`` as ``row`` (its columns ``keep``, all if None), with what the mix
    makes of it.

    Columns: ``size`` (words), ``source_size``, ``target``, ``copies``, and ``positions``, the
    places of the copies in the training order, counted in words of the whole mix. A source
    is taken whole as often as fits its target; of the rest, documents come once more in hash
    order as long as they end nearer to the target than without them.

    Null or empty texts have size 0: they come along with each whole pass and add no words.
    A null source is a source of its own, last in order. Rows without an id are spread by their
    texts. Repeated rows count one by one; rows of one id and size are interchangeable, so
    reruns agree. An empty table gives an empty one.
    """
    if any(a < 0 or b < 0 or a + b <= 0 for a, b in schedule):
        raise ValueError("weights are not negative, and not zero throughout")
    n_buckets = docs.count() // bucket_rows + 1
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("n"), F.xxhash64(docs["text"])))
    digest = F.substring(F.md5(F.concat_ws(":", name, F.lit(str(seed))).cast("binary")), 1, 15)
    rows = docs.select(
        F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"),
        docs["source"].alias("source"),
        docs["doc_id"].alias("id"),
        F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("n")).alias("source_key"),
        word_count(docs["text"]).alias("size"),
        F.conv(digest, 16, 10).cast("bigint").alias("turn"),
    ).withColumn("bucket", F.expr(f"shiftright(turn, 32) * {n_buckets} div {1 << 28}"))
    sums = store(
        rows.groupBy("source_key", "source", "bucket").agg(
            F.sum("size").alias("bucket_size")
        ),
        "mix-sums",
    )
    targets = source_targets(
        sums.groupBy("source_key", "source").agg(F.sum("bucket_size").alias("source_size")),
        schedule,
        max_repeat,
    )
    targets = store(targets, "mix-targets")
    whole = targets.agg(
        F.sum("target").alias("total"), F.sum(F.col("target") * F.col("tilt")).alias("leaning")
    ).first()
    total, leaning = whole["total"] or 0.0, whole["leaning"] or 0.0
    base = sums.selectExpr(
        "source_key",
        "bucket",
        f"coalesce(sum(bucket_size) OVER (PARTITION BY source_key ORDER BY bucket {EARLIER}), 0L) AS base",
    ).join(targets, "source_key")
    place = "least(1D, (e * source_size + before + size / 2D) / target)"
    return (
        rows.drop("source").join(base, ["source_key", "bucket"])
        .selectExpr(
            "row", "size", "source_size", "target", "tilt",
            "base + coalesce(sum(size) OVER (PARTITION BY source_key, bucket "
            f"ORDER BY turn, id, size {EARLIER}), 0L) AS before",
        )
        .selectExpr(
            "*",
            "CASE WHEN source_size = 0 THEN 0 ELSE int(floor(target / source_size)) END AS passes",
        )
        .selectExpr(
            "*",
            "passes + int(size > 0 AND before + size / 2D < target - passes * source_size) AS copies",
        )
        .selectExpr(
            "row", "size", "source_size", "target", "copies",
            "CASE WHEN copies > 0 THEN transform(transform(transform(sequence(0, copies - 1), "
            f"e -> {place}), u -> {TIME}), t -> {total!r}D * t + {leaning!r}D * (t - t * t)) "
            "ELSE array() END AS positions",
        )
    )


def in_order(assigned: DataFrame) -> DataFrame:
    """The copies of ``assign``'s rows with their ``position``, range-sorted by it."""
    copies = assigned.withColumn("position", F.explode("positions")).drop("positions")
    return copies.repartitionByRange("position", "row.doc_id").sortWithinPartitions("position", "row.doc_id")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training set: the columns of ``docs``, a row for each copy, in training order."""
    return in_order(assign(docs, **options)).select("row.*")


def taken(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """Each row of ``docs`` as ``row``, with ``size``, ``source_size``, ``target``, and what the
    sorted mix holds of it: ``taken``, its words with repeats, and ``first_position``.

    The mix is written in training order and read back.
    """
    number = F.monotonically_increasing_id().alias("number")
    assigned = store(assign(docs, keep=keep, **options).select("*", number), "mix")
    order = store(in_order(assigned).select("number", "size", "position"), "mix-order")
    held = order.groupBy("number").agg(F.sum("size").alias("taken"), F.min("position").alias("first_position"))
    return assigned.join(held, "number", "left").select(
        "row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_position"
    )
