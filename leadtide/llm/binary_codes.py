"""Near duplicate vectors by randomised-rotation binary codes.

Every vector is scaled to length 1 and turned by a fixed random rotation. Its code is the
signs of the turned components; the stored correction factor is the inner product of the
vector with its own code, taken as a unit vector. For another vector q, the inner product of q
and the code, divided by the factor, is an unbiased estimate of the cosine, with an error of
``sqrt((1 - factor ** 2) / factor ** 2 / (d - 1))`` a deviation. A pair is computed exactly, in
double precision, if the upper confidence bounds from both codes reach the threshold.

Candidates: further rotations give ``tables`` keys of ``bits`` signs each, with ``bits`` about
the logarithm of the number of vectors, so that unrelated vectors rarely meet, and enough
tables that a pair at the threshold meets in one with probability ``RECALL``. Keys are dealt
in groups of a few thousand rows. A key with more rows is cut into blocks, and each pair of
blocks is a group of its own: every pair still meets, and no task holds more than two blocks.

Equal vectors are one class with its smallest id; copies are not expanded into pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadtide.llm.common import components, ship
from leadtide.workspace import store

COSINE = 0.9
RECALL = 0.99
#: Deviations of the confidence bound.
SURE = 4.0
BLOCK = 2048
GROUP_ROWS = 4096
SEED = 11


def rotation(dim: int, number: int) -> np.ndarray:
    """Rotation ``number`` of ``dim`` dimensions, the same in every task."""
    normal = np.random.default_rng([SEED, dim, number]).standard_normal((dim, dim))
    q, r = np.linalg.qr(normal)
    return q * np.sign(np.diag(r))


def to_scale(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component between 1/2 and 1, so
    that no norm overflows or vanishes. The cosine stays what it is."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    half = exponent // 2
    return np.ldexp(np.ldexp(x, -half), half - exponent)


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned vectors, packed codes and correction factors of unit vectors (rows)."""
    turned = unit @ rotation(unit.shape[1], 0).T
    factor = np.abs(turned).sum(axis=1) / math.sqrt(unit.shape[1])
    return turned, np.packbits(turned > 0, axis=1), factor


def estimate(turned: np.ndarray, codes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row, the cosine of a turned vector with a coded one, and one deviation."""
    dim = turned.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    inner = np.einsum("ij,ij->i", signs, turned.astype(np.float32)) / math.sqrt(dim)
    spread = np.sqrt(np.maximum(0.0, 1 - factors**2) / factors**2 / max(1, dim - 1))
    return inner / factors, spread


def plan(n: int) -> tuple[int, int]:
    """Signs a key and number of tables for ``n`` vectors."""
    bits = min(48, max(6, math.ceil(math.log2(max(2, n))) - 1))
    agree = (1 - math.acos(COSINE) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def _keys(bits: int, tables: int):
    names = ["tab", "key", "id", "x"]

    def run(batches):
        rotations: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = batch.column(1).to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                x = to_scale(np.array([vectors[i] for i in rows], np.float64))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in rotations:
                    need = math.ceil(bits * tables / dim)
                    rotations[dim] = np.concatenate([rotation(dim, k + 1) for k in range(need)])
                signs = (x @ rotations[dim][: bits * tables].T > 0).reshape(len(rows), tables, bits)
                keys = signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                lists = pa.array([vectors[i] for i in rows], pa.list_(pa.float64()))
                for table in range(tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(rows), table, np.int32)),
                            pa.array(keys[:, table] * 4096 + dim % 4096),
                            pa.array(ids[rows], pa.int64()),
                            lists,
                        ],
                        names=names,
                    )

    return run


def _meet(group: pa.Table) -> pa.Table:
    """Links between rows of equal key in one group."""
    table = group.sort_by([("key", "ascending"), ("id", "ascending")])
    keys = table.column("key").to_numpy()
    ids = table.column("id").to_numpy()
    found_a, found_b, found_cos = [], [], []
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    sizes = np.diff(np.append(bounds, len(keys)))
    if len(keys) and sizes.max() > 1:
        multi = np.repeat(sizes > 1, sizes)
        table, keys, ids = table.filter(pa.array(multi)), keys[multi], ids[multi]
        lists = table.column("x").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        dims = np.diff(offsets)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = to_scale(flat[offsets[rows][:, None] + np.arange(dim)].astype(np.float64))
            norm = np.linalg.norm(x, axis=1)
            turned, codes, factors = encode(x / norm[:, None])
            key, own = keys[rows], ids[rows]
            for step in range(1, len(rows)):
                a = np.flatnonzero(key[step:] == key[:-step])
                if not len(a):
                    break
                b = a + step
                upper = np.full(len(a), np.inf)
                for q, o in ((a, b), (b, a)):
                    value, spread = estimate(turned[q], codes[o], factors[o])
                    upper = np.minimum(upper, value + SURE * spread)
                near = (upper >= COSINE) & (own[a] != own[b])
                a, b = a[near], b[near]
                cosine = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
                good = cosine >= COSINE
                found_a.append(own[a[good]])
                found_b.append(own[b[good]])
    a = np.concatenate(found_a) if found_a else np.empty(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.empty(0, np.int64)
    return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})


def links(vectors: DataFrame) -> DataFrame:
    """``a``, ``b``: linked pairs of ``vectors`` (``id`` unique, ``x`` sound), once each."""
    n = vectors.count()
    bits, tables = plan(n)
    rows = vectors.select("id", "x").mapInArrow(
        _keys(bits, tables), "tab int, key bigint, id bigint, x array<double>"
    )
    large = store(
        rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {BLOCK}"), "large-keys"
    )
    # Keys above BLOCK rows: at most tables * n / BLOCK of them.
    blocks = f"int(ceil(n / {BLOCK}))"
    groups = max(1, n // GROUP_ROWS)
    place = f"int(pmod(xxhash64(id, 5), {blocks}))"
    dealt = rows.join(F.broadcast(large) if large.count() <= 1_000_000 else large, ["tab", "key"], "left").selectExpr(
        "tab", "key", "id", "x",
        f"explode(CASE WHEN n IS NULL THEN array(named_struct('p', bigint(pmod(xxhash64(key), {groups})), 'q', -1)) "
        f"ELSE transform(sequence(0, {blocks} - 1), "
        f"j -> named_struct('p', key, 'q', least(j, {place}) * 65536 + greatest(j, {place}))) END) AS g",
    )
    return (
        dealt.groupBy("tab", "g.p", "g.q")
        .applyInArrow(_meet, "a bigint, b bigint")
        .distinct()
    )


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``embeddings``.

    Null, empty and zero vectors, and those with a null or non-finite component, link with
    nothing; nor do rows with a null id, whose component is null and which are kept. Vectors of
    different length never link. Equal vectors link with each other whatever their number; rows
    that repeat an id are one vector each in ``n_links``. Other columns are not read. An empty
    table gives an empty one.
    """
    ship(embeddings.sparkSession)
    rows = embeddings.selectExpr("vec_id", "cast(embedding AS array<double>) AS x").selectExpr(
        "vec_id",
        "CASE WHEN size(x) > 0 AND vec_id IS NOT NULL "
        "AND forall(x, v -> coalesce(NOT isnan(v) AND abs(v) < double('Infinity'), false)) "
        "AND exists(x, v -> v != 0) THEN x END AS x",
    ).withColumn("hash", F.when(F.col("x").isNotNull(), F.sha2(F.to_json(F.struct("x")), 256)))
    sound = store(rows.filter("x IS NOT NULL"), "vectors")
    classes = store(
        sound.groupBy("hash").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes"
    )
    reps = sound.join(classes, "hash").filter("vec_id = rep").select(F.col("rep").alias("id"), "x").dropDuplicates(["id"])
    found = store(links(store(reps, "class-vectors")), "links")
    weights = classes.select("rep", "copies")
    other = found.selectExpr("explode(array(named_struct('s', a, 't', b), named_struct('s', b, 't', a))) AS e")
    counted = (
        other.select("e.s", F.col("e.t").alias("rep"))
        .join(weights, "rep")
        .groupBy("s")
        .agg(F.sum("copies").alias("beyond"))
        .withColumnRenamed("s", "rep")
    )
    parts = components(found).withColumnRenamed("id", "rep")
    per_class = (
        classes.join(counted, "rep", "left")
        .join(parts, "rep", "left")
        .select(
            "hash",
            (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = rows.select("vec_id", "hash").join(per_class, "hash", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
