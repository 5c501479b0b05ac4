"""Running figures over an ordered table, without a task that sees a whole group.

``number_rows`` sorts once, gives every row its position and cuts the table into chunks
of neighbouring rows. A chunk is a slice of one range partition of the full order
(tie-breaker included) and holds at most ``task_rows`` rows, however the rows spread over
keys or dates; in a table of many more rows than that, at most ``chunk_size`` gives.

A running figure of a group is then what the group's earlier chunks give, together with the
running figure inside the chunk. Nothing else is needed to treat a group of any size, and no
step asks how large a group is:

* ``add_shared_prior`` and ``add_shared_previous``: many groupings with few members. All their
  windows run after one exchange that places each chunk in its own task. What went before a
  chunk enters as one extra *carry* row at the front of each member's rows there: the window
  takes it like any other row, and it is removed afterwards.
* ``member_figures``: one grouping with many members, such as customers. A chunk works out its
  own figures; each member leaves one state a chunk, and one window composes the states of a
  member. All figures of the grouping share that window and the exchange of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadtide.workspace import store

POS = "pos"
CHUNK = "chunk"
EVERY_ROW = "every_row"
FRONT = -1

# Rows that one task sorts and windows with ease.
TASK_ROWS = 5_000_000
# Chunks of a table, about, before they are allowed to hold more rows than was asked for.
CHUNKS = 96

# monotonically_increasing_id keeps the partition in the bits above these.
ROW_BITS = 33
ROW_MASK = (1 << ROW_BITS) - 1


@dataclass(frozen=True)
class Ordered:
    """Rows that carry ``pos`` and ``chunk``.

    ``n_rows`` is an upper bound on the rows.
    """

    rows: DataFrame
    n_rows: int
    n_chunks: int
    task_rows: int = TASK_ROWS
    #: The written table behind the rows, as long as it is needed.
    stored: DataFrame | None = None

    def with_rows(self, rows: DataFrame) -> Ordered:
        """The same order over a subset of the rows or over further columns."""
        return replace(self, rows=rows)


def chunk_size(n_rows: int, task_rows: int) -> int:
    """The most rows of a chunk: ``task_rows``, or more in a table that would have far too many
    chunks. A chunk costs a task in every step, a block for every task of an exchange, and a
    carry row for each member in it, so their number must not grow with the table as long as
    a task can hold more rows."""
    return max(task_rows, min(TASK_ROWS, -(-n_rows // CHUNKS)))


def number_rows(
    df: DataFrame,
    order: Iterable[Column],
    name: str,
    partitions: int | None = None,
    task_rows: int = TASK_ROWS,
) -> Ordered:
    """Number ``df`` by ``order``, which must tell all rows apart, and store it.

    The result is written because positions come from the range exchange: reading them
    twice must give the same numbers. ``partitions`` defaults to the session's shuffle
    partitions, merged by AQE where they are small.
    """
    order = list(order)
    spread = (
        df.repartitionByRange(partitions, *order)
        if partitions
        else df.repartitionByRange(*order)
    )
    rows = store(
        spread.sortWithinPartitions(*order).withColumn(POS, F.monotonically_increasing_id()),
        name,
    )
    size = rows.selectExpr(
        "count(1) AS n",
        f"max(shiftright({POS}, {ROW_BITS})) AS last_part",
        f"max({POS} & {ROW_MASK}) AS last_row",
    ).first()
    task_rows = chunk_size(size["n"], task_rows)
    slices = (size["last_row"] or 0) // task_rows + 1
    chunk = (
        f"int(shiftright({POS}, {ROW_BITS}) * {slices} + ({POS} & {ROW_MASK}) div {task_rows})"
    )
    return Ordered(
        rows.withColumn(CHUNK, F.expr(chunk)),
        size["n"],
        ((size["last_part"] or 0) + 1) * slices,
        task_rows,
        rows,
    )


def place_chunks(ordered: Ordered, rows: DataFrame) -> DataFrame:
    """Each chunk in a partition of its own."""
    return rows.repartitionById(ordered.n_chunks, CHUNK)


def beside(ordered: Ordered, *parts: DataFrame) -> DataFrame:
    """The rows with the columns of ``parts``, matched by position.

    All sides are placed by chunk, so the joins add no exchange and stay even.
    """
    rows = place_chunks(ordered, ordered.rows)
    for part in parts:
        rows = rows.join(part, [CHUNK, POS])
    return rows


def prior_name(group: str, measure: str) -> str:
    return f"{group}__{measure}"


def _no_null(keys: Iterable[str]) -> str:
    return " AND ".join(f"{key} IS NOT NULL" for key in keys)


def _prior_sum(measure: str, piece: list[str], keys: list[str], name: str) -> str:
    """Sum over the earlier rows of a piece, 0 if there are none or a key is missing."""
    over = (
        f"sum({measure}) OVER (PARTITION BY {', '.join(piece)} ORDER BY {POS} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return f"coalesce(CASE WHEN {_no_null(keys)} THEN {over} END, 0) AS {name}"


def _shared_carry(
    rows: DataFrame, groups: Mapping[str, str], measures: list[str]
) -> DataFrame:
    """Per group member and chunk, the member's totals over all earlier chunks.

    All groupings are summed in one aggregation, combined before its shuffle. The window
    sees at most one row per chunk for each member.
    """
    types = dict(rows.dtypes)
    members = ", ".join(f"'{name}', cast({key} AS string)" for name, key in groups.items())
    totals = (
        rows.selectExpr(
            CHUNK, *measures, f"stack({len(groups)}, {members}) AS (grouping, member)"
        )
        .filter("member IS NOT NULL")
        .groupBy("grouping", "member", CHUNK)
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    per_member = "OVER (PARTITION BY grouping, member ORDER BY " + CHUNK
    earlier = f"{per_member} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        totals.selectExpr(
            CHUNK,
            "grouping",
            "member",
            f"lag({CHUNK}) {per_member}) AS last",
            *[f"cast(sum({m}) {earlier} AS {types[m]}) AS {m}" for m in measures],
        )
        .filter("last IS NOT NULL")
        .selectExpr(
            CHUNK,
            f"bigint({FRONT}) AS {POS}",
            *measures,
            *[
                f"cast(CASE WHEN grouping = '{name}' THEN member END AS {types[key]}) AS {key}"
                for name, key in groups.items()
            ],
        )
    )


def add_shared_prior(
    ordered: Ordered,
    groups: Mapping[str, str],
    measures: Iterable[str],
    everything: str | None = None,
    source: DataFrame | None = None,
    figures: Callable[[str], list[str]] | None = None,
) -> Ordered:
    """Add ``<group>__<measure>``: the measure's sum over the group's earlier rows.

    ``groups`` maps a name to its key column; ``everything`` names the figures over all
    rows. No earlier row or a missing key gives 0. Chunk totals are read from ``source``,
    the same rows in a form that is cheap to read twice. ``figures`` gives SQL columns
    that replace the key and the sums of a group at once, so that the sorts of the next
    groups move fewer columns.
    """
    measures = list(measures)
    groups = dict(groups)
    rows = ordered.rows
    source = rows if source is None else source
    if everything:
        rows = rows.withColumn(EVERY_ROW, F.lit(1))
        source = source.withColumn(EVERY_ROW, F.lit(1))
        groups = {everything: EVERY_ROW, **groups}
    columns = rows.columns
    if ordered.n_chunks > 1:
        rows = rows.unionByName(
            _shared_carry(source, groups, measures), allowMissingColumns=True
        )
    rows = rows.repartitionById(ordered.n_chunks, CHUNK)
    if figures:
        for name, key in groups.items():
            others = [c for c in rows.columns if c != key]
            sums = [_prior_sum(m, [key, CHUNK], [key], prior_name(name, m)) for m in measures]
            rows = rows.selectExpr(*others, *sums).selectExpr(*others, *figures(name))
    else:
        rows = rows.selectExpr(
            *columns,
            *[
                _prior_sum(m, [key, CHUNK], [key], prior_name(name, m))
                for name, key in groups.items()
                for m in measures
            ],
        )
    if ordered.n_chunks > 1:
        rows = rows.filter(F.col(POS) > FRONT)
    return ordered.with_rows(rows.drop(EVERY_ROW))


def _shared_last(rows: DataFrame, groups: Mapping[str, str], columns: list[str]) -> DataFrame:
    """Per group member and chunk, the member's last row in the chunks before."""
    types = dict(rows.dtypes)
    members = ", ".join(f"'{name}', cast({key} AS string)" for name, key in groups.items())
    per_member = "OVER (PARTITION BY grouping, member ORDER BY " + CHUNK + ")"
    return (
        rows.selectExpr(
            CHUNK, POS, f"struct({', '.join(columns)}) AS cells", f"stack({len(groups)}, {members}) AS (grouping, member)"
        )
        .filter("member IS NOT NULL")
        .groupBy("grouping", "member", CHUNK)
        .agg(F.max_by("cells", POS).alias("cells"))
        .selectExpr(CHUNK, "grouping", "member", f"lag(cells) {per_member} AS cells")
        .filter("cells IS NOT NULL")
        .selectExpr(
            CHUNK,
            f"bigint({FRONT}) AS {POS}",
            "cells.*",
            *[
                f"cast(CASE WHEN grouping = '{name}' THEN member END AS {types[key]}) AS {key}"
                for name, key in groups.items()
            ],
        )
    )


def add_shared_previous(
    ordered: Ordered, groups: Mapping[str, str], columns: Iterable[str], everything: str | None = None
) -> Ordered:
    """Add ``<group>__<column>``: the column's value in the group's previous row.

    0 in the first row of a group, where a key is missing, and where the previous value is.
    ``groups`` and ``everything`` as in ``add_shared_prior``; columns must not be keys. The rows
    should be narrow: they are exchanged once, and sorted once for each group.
    """
    columns = list(columns)
    groups = dict(groups)
    rows = ordered.rows
    if everything:
        rows = rows.withColumn(EVERY_ROW, F.lit(1))
        groups = {everything: EVERY_ROW, **groups}
    kept = rows.columns
    if ordered.n_chunks > 1:
        rows = rows.unionByName(_shared_last(rows, groups, columns), allowMissingColumns=True)
    rows = place_chunks(ordered, rows)
    rows = rows.selectExpr(
        *kept,
        *[
            f"coalesce(CASE WHEN {key} IS NOT NULL THEN lag({c}) OVER "
            f"(PARTITION BY {key}, {CHUNK} ORDER BY {POS}) END, 0) AS {prior_name(name, c)}"
            for name, key in groups.items()
            for c in columns
        ],
    )
    return ordered.with_rows(rows.filter(F.col(POS) > FRONT).drop(EVERY_ROW))


def member_figures(
    ordered: Ordered,
    group: str,
    key: str,
    sums: Iterable[str] = (),
    mark: str | None = None,
    previous: Mapping[str, str] | None = None,
) -> DataFrame:
    """Figures over the earlier rows with the same ``key``, by position, placed by chunk.

    * ``<group>__<measure>`` for each of ``sums``: its sum, 0 without an earlier row;
    * with ``mark``, a column of 0 and 1, ``<group>__since``: the number of rows after the last
      earlier row that is marked, the row itself included;
    * for each ``new: column`` of ``previous``, the value in the previous row.

    A missing key is no group: sums are 0, ``since`` and previous values null. Rows are read
    and exchanged once; a member leaves at most one state for each chunk that it is in.
    """
    sums, previous = list(sums), dict(previous or {})
    sources = sorted({*previous.values()})
    columns = list(dict.fromkeys([CHUNK, POS, key, *sums, *([mark] if mark else []), *sources]))
    types = dict(ordered.rows.dtypes)
    place = f"(PARTITION BY {key}, {CHUNK} ORDER BY {POS})"
    before = f"(PARTITION BY {key}, {CHUNK} ORDER BY {POS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    local = place_chunks(ordered, ordered.rows.select(*columns)).selectExpr(
        *columns,
        f"bigint(row_number() OVER {place}) AS row_here",
        *[f"sum({m}) OVER {before} AS sum_{m}" for m in sums],
        *[f"lag(struct({c})) OVER {place} AS last_{c}" for c in sources],
    )
    if mark:
        local = local.selectExpr("*", f"max(CASE WHEN {mark} = 1 THEN row_here END) OVER {before} AS marked_here")
    if ordered.n_chunks > 1:
        carry = place_chunks(ordered, _member_carry(local, key, sums, mark, sources))
        carry = carry.withColumnsRenamed({CHUNK: "carry_chunk", key: "carry_key"})
        # No carry has a missing key. A plain equality would filter the rows of the states for
        # keys, and so give them an exchange of their own.
        local = local.join(carry, F.expr(f"{CHUNK} = carry_chunk AND {key} <=> carry_key"), "left")
    else:
        names = ["rows", *[f"sum_{m}" for m in sums], *(["marked"] if mark else [])]
        local = local.selectExpr(
            "*", *[f"0 AS carry_{n}" for n in names], *[f"last_{c} AS carry_last_{c}" for c in sources]
        )
    in_group = f"{key} IS NOT NULL"
    figures = [
        f"cast(CASE WHEN {in_group} THEN coalesce(sum_{m}, 0) + coalesce(carry_sum_{m}, 0) ELSE 0 END"
        f" AS {_summed(types[m])}) AS {prior_name(group, m)}"
        for m in sums
    ]
    if mark:
        # The place of the last marked row in the whole group, 0 if there is none.
        marked = "coalesce(marked_here + coalesce(carry_rows, 0), carry_marked, 0)"
        figures.append(
            f"CASE WHEN {in_group} THEN bigint(coalesce(carry_rows, 0) + row_here - {marked}) END AS {prior_name(group, 'since')}"
        )
    figures += [
        f"CASE WHEN {in_group} THEN coalesce(last_{c}, carry_last_{c}).{c} END AS {new}" for new, c in previous.items()
    ]
    return local.selectExpr(CHUNK, POS, *figures)


def _summed(kind: str) -> str:
    """Type of a running sum: decimals as wide as they get, others as they are."""
    return kind if not kind.startswith("decimal") else f"decimal(38,{kind.rstrip(')').split(',')[1]})"


def _member_carry(local: DataFrame, key: str, sums: list[str], mark: str | None, sources: list[str]) -> DataFrame:
    """What each member's earlier chunks give to a chunk: composed states, one row a chunk."""
    states = (
        local.groupBy(key, CHUNK)
        .agg(
            F.count(key).alias("rows"),
            *[F.sum(m).alias(f"sum_{m}") for m in sums],
            *([F.max(F.when(F.col(mark) == 1, F.col("row_here"))).alias("marked")] if mark else []),
            *[F.max_by(F.struct(c), POS).alias(f"last_{c}") for c in sources],
        )
        .filter("rows > 0")
    )
    chunks = f"(PARTITION BY {key} ORDER BY {CHUNK})"
    earlier = f"(PARTITION BY {key} ORDER BY {CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carry = states.selectExpr(
        CHUNK,
        key,
        f"sum(rows) OVER {earlier} AS carry_rows",
        *[f"sum(sum_{m}) OVER {earlier} AS carry_sum_{m}" for m in sums],
        *[f"lag(last_{c}) OVER {chunks} AS carry_last_{c}" for c in sources],
        *(["marked"] if mark else []),
    )
    if mark:
        carry = carry.selectExpr("*", f"max(coalesce(carry_rows, 0) + marked) OVER {earlier} AS carry_marked").drop("marked")
    return carry.filter("carry_rows IS NOT NULL")
