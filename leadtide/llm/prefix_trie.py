"""The prefix trie of conversations, as balanced parentheses per shard.

A conversation is a path of turn keys. Equal paths are counted first and the different ones
range-sorted; a shard is a run of neighbours, so the paths below a node are neighbours too. A
shard writes its nodes in preorder as parentheses, an opening and a closing one each. Excess
(open minus closed) is summed up in blocks with their minima, and a tree of minima over the
blocks; ``findclose`` walks it to the closing parenthesis, which delimits the subtree. Inside
it, rank counts nodes and leaf pairs ``()``, and cumulative arrays give members and savings.

A node that the last path of a shard shares with the first of the next is on a spine. Shards
give partial figures for their spines; these are merged by key, and the children of spine
nodes fetch their parent's smallest member from the merged spines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadtide.llm.common import ship
from leadtide.workspace import store

#: Bytes of a turn's key in a path: half a SHA-256.
KEY = 16
#: Turns that a shard holds in numpy arrays.
SHARD_TURNS = 400_000
#: Conversations whose ids are gathered in one row.
ID_BITS = 12
#: Parentheses of a block of the excess.
BLOCK = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

PATHS = "path binary, sizes array<bigint>, n_ends bigint, least bigint, ends_sha256 string"
PATHS_ARROW = pa.schema(
    [("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n_ends", pa.int64()), ("least", pa.int64()), ("ends_sha256", pa.string())]
)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turns``: the keys and text sizes of each conversation's turns, in order.

    Turns are ordered by ``turn``, null first; equal ones by role and key. Only keys and sizes
    are shuffled, by the number of the five conversations that share a beginning. Rows without
    a conversation are left out.
    """
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    turn = conversations["turn"].cast("bigint")
    whole = F.concat(F.length(role.cast("binary")).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(
        conversations["conv_id"].cast("bigint").alias("conv_id"),
        F.struct(
            turn.isNotNull().alias("numbered"),
            turn.alias("turn"),
            role.alias("role"),
            F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * KEY).alias("key"),
            F.length(text.cast("binary")).cast("bigint").alias("size"),
        ).alias("t"),
    ).filter("conv_id IS NOT NULL")
    rows = rows.select("conv_id", F.expr("conv_id - conv_id % 5").alias("base"), "t").repartition("base")
    return rows.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``path``, ``sizes`` of every conversation after its rebuild.

    Conversation c begins with the first ``crc32(c) % 9`` turns of conversation ``c - c % 5``
    (of all it has, of none if it is absent) and goes on with its own after as many.
    """
    rows = turn_paths(conversations).withColumn("h", F.expr("int(crc32(binary(string(conv_id))) % 9)"))
    first = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))
    given = F.first(first, ignorenulls=True).over(Window.partitionBy("base"))
    rows = rows.withColumn("given", given).selectExpr(
        "conv_id",
        "concat(coalesce(slice(given, 1, h), array()), slice(turns, h + 1, greatest(size(turns) - h, 0))) AS turns",
    )
    return as_paths(rows)


def as_paths(rows: DataFrame) -> DataFrame:
    """Paths of ``conv_id``, ``turns``: their keys in a row, and their sizes."""
    return rows.selectExpr(
        "conv_id",
        "unhex(array_join(transform(turns, t -> t.key), '')) AS path",
        "transform(turns, t -> t.size) AS sizes",
    )


def _ends(batches):
    """One row a path, from neighbouring rows of its ids; their hash is carried on."""
    held, rows = None, []

    def closed():
        path, sizes, n, least, digest = held
        rows.append((path, sizes, n, least, digest.hexdigest()))

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PATHS_ARROW)], schema=PATHS_ARROW)

    for batch in batches:
        for path, sizes, n, least, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0] == path:
                held[2] += n
                held[3] = min(held[3], least)
                held[4].update(b"," + ids.encode())
            else:
                if held:
                    closed()
                held = [path, sizes, n, least, hashlib.sha256(ids.encode())]
        if len(rows) >= 5_000:
            yield batch_of()
            rows = []
    if held:
        closed()
    if rows:
        yield batch_of()


def shards(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The different paths, sorted, with their shard, number of conversations, smallest one and
    the hash of their ids; a written table.

    Ids of a path are gathered in rows of neighbouring ids, each at most ``2^ID_BITS``, and
    hashed in order, so a path with very many conversations is never in memory as a whole. Ids
    must be unique, as ``turn_paths`` gives them.
    """
    spark = paths.sparkSession
    ship(spark)
    ids = F.array_sort(F.collect_list("conv_id"))
    pieces = store(
        paths.groupBy("path", F.shiftright("conv_id", ID_BITS).alias("block")).agg(
            F.any_value("sizes").alias("sizes"),
            F.count(F.lit(1)).alias("n"),
            F.min("conv_id").alias("least"),
            F.array_join(F.transform(ids, lambda c: c.cast("string")), ",").alias("ids"),
        ),
        "trie-ids",
    )
    turns = pieces.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    spread = pieces.repartitionByRange(int(turns // shard_turns) + 1, "path").sortWithinPartitions("path", "block")
    ends = spread.select("path", "sizes", "n", "least", "ids").mapInArrow(_ends, PATHS)
    return store(ends.withColumn("shard", F.spark_partition_id()), "trie-paths")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    if a == b[: len(a)]:
        return len(a) // KEY
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = np.flatnonzero(x != y)
    return int(differ[0] if len(differ) else n) // KEY


def _borders(batches):
    for batch in batches:
        rows = list(zip(*[c.to_pylist() for c in batch.columns]))
        shared = [
            (k, -1 if before is None else _common(before, first), -1 if after is None else _common(last, after))
            for k, first, last, before, after in rows
        ]
        if shared:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*shared)], names=["shard", "left", "right"])


def borders(sharded: DataFrame) -> DataFrame:
    """``shard``, ``left``, ``right``: the depth down to which a shard shares its first path
    with the shard before and its last with the shard after; -1 without one.

    One row a shard; its window sees two paths of each.
    """
    edge = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")
    near = edge.select("shard", "first", "last", F.lag("last").over(order), F.lead("first").over(order))
    return near.mapInArrow(_borders, "shard int, left int, right int")


class Parentheses:
    """Balanced parentheses (1 opens, 0 closes) with block minima of the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        #: Opening parentheses before each place.
        self.opened = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        pairs = np.zeros(len(bits), np.int64)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        #: Leaf pairs that begin before each place.
        self.pairs = np.concatenate([[0], np.cumsum(pairs)])
        blocks = max(1, -(-len(bits) // BLOCK))
        leaves = 1 << (blocks - 1).bit_length()
        top = np.iinfo(np.int32).max
        self.padded = np.full(leaves * BLOCK, top, np.int32)
        self.padded[: len(bits)] = self.excess
        self.least = np.full(2 * leaves, top, np.int32)  # a heap: children of k are 2k, 2k + 1
        self.least[leaves:] = self.padded.reshape(leaves, BLOCK).min(1)
        level = leaves // 2
        while level:
            self.least[level : 2 * level] = np.minimum(
                self.least[2 * level : 4 * level : 2], self.least[2 * level + 1 : 4 * level : 2]
            )
            level //= 2
        self.leaves = leaves

    def _in_block(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place of a block after ``after`` whose excess is at most the target, or -1."""
        out = np.empty(len(block), np.int64)
        for at in range(0, len(block), 1 << 15):
            b, t = block[at : at + (1 << 15)], target[at : at + (1 << 15)]
            place = b[:, None] * BLOCK + np.arange(BLOCK)
            hit = (self.padded.reshape(-1, BLOCK)[b] <= t[:, None]) & (place > after[at : at + (1 << 15), None])
            first = hit.argmax(1)
            out[at : at + (1 << 15)] = np.where(hit[np.arange(len(b)), first], b * BLOCK + first, -1)
        return out

    def findclose(self, opening: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess[opening] - 1
        block = opening // BLOCK
        found = self._in_block(block, opening, target)
        todo = np.flatnonzero(found < 0)
        node, goal = block[todo] + self.leaves, target[todo]
        # Up, until a block range to the right holds an excess that small; then down to it.
        up = np.ones(len(todo), bool)
        while up.any():
            right = (node & 1 == 0) & (self.least[np.minimum(node + 1, 2 * self.leaves - 1)] <= goal)
            node = np.where(up, np.where(right, node + 1, node >> 1), node)
            up &= ~right
        while (down := node < self.leaves).any():
            left = self.least[np.minimum(2 * node, 2 * self.leaves - 1)] <= goal
            node = np.where(down, 2 * node + ~left, node)
        found[todo] = self._in_block(node - self.leaves, np.full(len(todo), -1), goal)
        return found


NODES = (
    "spine boolean, key binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_NODES_ARROW = pa.schema(
    [
        ("spine", pa.bool_()), ("key", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()),
        ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
        ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ]
)


def _spine_keys(path: bytes, depth: int) -> list[bytes]:
    """A key for each prefix of a path, down to ``depth``."""
    digest, out = hashlib.blake2b(digest_size=KEY), []
    for d in range(depth + 1):
        if d:
            digest.update(path[(d - 1) * KEY : d * KEY])
        out.append(digest.digest())
    return out


def shard_nodes(
    paths: list[bytes], sizes: pa.Array, n_ends: np.ndarray, least: np.ndarray, ends: list[str], left: int, right: int
) -> pa.RecordBatch:
    """The nodes of one shard, from its sorted paths, in preorder.

    ``left`` and ``right`` are the depths of the shared spines. Sums over the shards that hold
    a node are its figures: a turn's text is taken off, and a child or a leaf counted, in the
    first shard that has the node, and a leaf that the next shard goes on from is none.
    """
    depth = np.array([len(p) // KEY for p in paths], np.int64)
    shared = np.zeros(len(paths), np.int64)
    shared[1:] = [_common(a, b) for a, b in zip(paths, paths[1:])]
    # Each path closes what it does not share with the one before, and opens the rest.
    runs = np.zeros(2 * len(paths) + 1, np.int64)
    runs[0:-1:2][1:] = depth[:-1] - shared[1:]
    runs[1::2] = depth - shared
    runs[1] += 1  # the root
    runs[-1] = depth[-1] + 1
    bits = np.repeat(np.arange(len(runs)) & 1, runs).astype(np.uint8)
    tree = Parentheses(bits)
    opening = np.flatnonzero(bits)
    n = len(opening)
    closing = tree.findclose(opening)
    begin, end = tree.opened[opening], tree.opened[closing]  # the nodes of a subtree, by rank
    level = tree.excess[opening].astype(np.int64) - 1

    owner = np.repeat(np.arange(len(paths)), runs[1::2])  # the path that opens a node
    flat = sizes.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(depth)])
    size = np.zeros(n, np.int64)
    below = level > 0
    size[below] = flat[first[owner[below]] + level[below] - 1]
    last_of = np.cumsum(runs[1::2]) - 1  # the node at which a path ends
    multiplicity = np.zeros(n, np.int64)
    multiplicity[last_of] = n_ends

    def summed(values: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(values)])
        return running[end] - running[begin]

    new = ~((owner == 0) & (level <= left))
    n_convs = summed(multiplicity)
    saved = summed((n_convs - new) * size)
    n_leaves = tree.pairs[closing] - tree.pairs[opening]
    if right == depth[-1]:  # the next shard goes on from the last path: no leaf after all
        n_leaves = n_leaves - ((begin <= last_of[-1]) & (end > last_of[-1]))

    # Parents: the node one level up that was opened last.
    parent = np.full(n, -1, np.int64)
    order = np.lexsort((np.arange(n), level))
    by_level = level[order]
    starts = np.searchsorted(by_level, np.arange(by_level[-1] + 2))
    for d in range(1, int(by_level[-1]) + 1):
        above, here = order[starts[d - 1] : starts[d]], order[starts[d] : starts[d + 1]]
        parent[here] = above[np.searchsorted(above, here) - 1]
    n_children = np.zeros(n, np.int64)
    np.add.at(n_children, parent[new & (parent >= 0)], 1)

    # Smallest members: paths are in preorder, so those of a subtree are a slice.
    from_path = np.searchsorted(last_of, begin)
    to_path = np.searchsorted(last_of, end)
    conv = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), np.ravel([from_path, to_path], "F"))[::2]

    on_left = (owner == 0) & (level <= left)
    last_path = np.zeros(n, bool)
    last_path[(begin <= last_of[-1]) & (end > last_of[-1])] = True
    on_right = last_path & (level <= right)
    spine = on_left | on_right
    keys: list[bytes | None] = [None] * n
    for flags, path, down in ((on_left, paths[0], left), (on_right, paths[-1], right)):
        if down >= 0:
            names = _spine_keys(path, down)
            for k in np.flatnonzero(flags):
                keys[k] = names[level[k]]
    hanging = np.flatnonzero(~spine & (parent >= 0) & spine[np.maximum(parent, 0)])
    parents: list[bytes | None] = [None] * n
    for k in np.flatnonzero(spine):  # a spine is a path down from the root
        parents[k] = keys[parent[k]] if parent[k] >= 0 else None
    for k in hanging:
        parents[k] = keys[parent[k]]
    sha = np.full(n, EMPTY_SHA, object)
    sha[last_of] = ends
    known = (parent >= 0) & ~spine
    known[hanging] = False
    columns = [
        spine, keys, parents, conv, level, pa.array(conv[np.maximum(parent, 0)], mask=~known),
        n_convs, n_children, n_leaves, saved, sha.tolist(),
    ]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _NODES_ARROW)], schema=_NODES_ARROW
    )


def _shard_batches(batches):
    """Shards of a task, each taken together from its neighbouring rows."""

    def nodes_of(parts):
        whole = pa.Table.from_batches(parts)
        column = {name: whole.column(name).combine_chunks() for name in whole.schema.names}
        out = shard_nodes(
            column["path"].to_pylist(), column["sizes"], column["n_ends"].to_numpy(), column["least"].to_numpy(),
            column["ends_sha256"].to_pylist(), column["left"][0].as_py(), column["right"][0].as_py(),
        )
        for at in range(0, out.num_rows, 20_000):
            yield out.slice(at, 20_000)

    held, shard = [], None
    for batch in batches:
        names = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and names[a] != shard:
                yield from nodes_of(held)
                held = []
            shard = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield from nodes_of(held)


def nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each different beginning of ``paths`` (``conv_id``, ``path``, ``sizes``).

    Columns: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    * A path without turns is a member of the root alone. No paths give no node.
    * Equal texts are equal keys: 128 bits of SHA-256 over role and text.
    * A task holds a shard of about ``shard_turns`` turns, at least one path; a path is one
      row of 24 bytes a turn, which bounds a conversation to some fifty million turns.
    """
    sharded = shards(paths, shard_turns)
    spread = sharded.agg(F.max("shard")).first()[0]
    if spread is None:
        return sharded.sparkSession.createDataFrame([], NODES).drop("spine", "key", "parent")
    # A row a shard; Spark broadcasts it while it is small.
    placed = sharded.join(borders(sharded), "shard").repartitionById(spread + 1, "shard")
    placed = placed.sortWithinPartitions("shard", "path")
    found = store(placed.mapInArrow(_shard_batches, NODES), "trie-nodes")
    spines = store(
        found.filter("spine")
        .groupBy("key", "depth")
        .agg(
            F.any_value("parent").alias("parent"),
            F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            # A path ends in one shard only; the others have the hash of nothing.
            F.max(F.struct((F.col("ends_sha256") != EMPTY_SHA).alias("ends"), "ends_sha256"))["ends_sha256"].alias("ends_sha256"),
        ),
        "trie-spines",
    )
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = spines.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    inner = found.filter("NOT spine AND parent IS NULL").select("conv_id", "depth", "parent_conv_id", *figures)
    edge = found.filter("NOT spine AND parent IS NOT NULL").unionByName(spines, allowMissingColumns=True)
    edge = edge.select("parent", "conv_id", "depth", *figures).join(above, "parent", "left")
    return inner.unionByName(edge.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), *figures))
