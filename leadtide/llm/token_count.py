"""Token counts of flat token files by a scan for separators.

A file is a run of ids, cut into blocks of equal size wherever that falls, with an end id
after every document and no index. Each block is searched by one vector comparison; it gives
the lengths of the documents that begin and end inside it, the ids up to its first separator
and the ids after its last. A prefix scan over the blocks of a file, one row a block, stitches
the documents that cross blocks and numbers all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.llm.common import ship
from leadtide.llm.token_pack import encoder, rows_of
from leadtide.workspace import fresh_path

BLOCK_TOKENS = 1 << 17
FILES = "kind string, file int, block int, payload binary, doc_ids array<bigint>"


def _stream(path: str, separator: int, id_bytes: int, block_tokens: int):
    names = ["kind", "file", "block", "payload", "doc_ids"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def run(batches):
        encode = encoder(path, True)
        if not encode.vocabulary > separator:
            raise ValueError("the separator is not in the vocabulary")
        file = TaskContext.get().partitionId()
        dtype = f"<u{id_bytes}"
        if encode.vocabulary > 1 << (8 * id_bytes):
            raise ValueError("the vocabulary needs more bytes an id")
        end = np.array([separator], dtype)
        held, parts, docs, block, names_row = 0, [], [], 0, 0
        for doc_id, text in rows_of(batches):
            ids = encode(text).astype(dtype)
            docs.append(doc_id)
            parts += [ids, end]
            held += len(ids) + 1
            if held >= block_tokens:
                flat = np.concatenate(parts)
                whole = held // block_tokens * block_tokens
                for at in range(0, whole, block_tokens):
                    yield row("tokens", file, block, flat[at : at + block_tokens].tobytes(), None)
                    block += 1
                parts, held = [flat[whole:]], held - whole
            if len(docs) >= 10_000:
                yield row("names", file, names_row, None, docs)
                names_row, docs = names_row + 1, []
        if held:
            yield row("tokens", file, block, np.concatenate(parts).tobytes(), None)
        if docs:
            yield row("names", file, names_row, None, docs)

    return run


def write_flat(
    docs: DataFrame,
    tokenizer: str,
    separator: int,
    id_bytes: int = 2,
    block_tokens: int = BLOCK_TOKENS,
) -> str:
    """Write whole texts as flat token files, one a partition; returns the path.

    Special tokens spelled in a text are ordinary text, so only true ends are separators. The
    names of a file's documents are written beside it, in order and without offsets.
    """
    ship(docs.sparkSession)
    path = fresh_path(docs.sparkSession, "flat")
    docs.select("doc_id", "text").mapInArrow(
        _stream(tokenizer, separator, id_bytes, block_tokens), FILES
    ).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    return path


def _scan(separator: int, id_bytes: int):
    names = ["file", "block", "n", "n_ends", "head", "tail", "inner"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = np.frombuffer(batch.column(2)[i].as_buffer(), f"<u{id_bytes}")
                ends = np.flatnonzero(ids == separator)
                head = int(ends[0]) + 1 if len(ends) else None
                tail = len(ids) - int(ends[-1]) - 1 if len(ends) else len(ids)
                values = [file, block, len(ids), len(ends), head, tail, np.diff(ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(values, types)], names=names
                )

    return run


def count_tokens(blocks: DataFrame, separator: int, id_bytes: int = 2) -> DataFrame:
    """``file``, ``number``, ``start``, ``n_tokens``, ``ended`` of every document.

    ``blocks``: ``file``, ``block``, ``payload`` (unsigned ids of ``id_bytes`` bytes, low byte first). ``start`` counts the ids
    of all files before; ``n_tokens`` includes the separator. Ids after the last separator of a
    file are a document that has not ended. Neighbouring separators are empty documents of one
    id. Empty blocks and files give nothing. Payloads must not be null.
    """
    ship(blocks.sparkSession)
    found = blocks.select("file", "block", "payload").mapInArrow(
        _scan(separator, id_bytes),
        "file int, block int, n bigint, n_ends bigint, head bigint, tail bigint, inner array<bigint>",
    )
    order = "PARTITION BY file ORDER BY block"
    earlier = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    scanned = found.selectExpr(
        "*",
        f"coalesce(sum(n) {earlier}, 0L) AS before",
        f"coalesce(sum(n_ends) {earlier}, 0L) AS number",
        f"lead(block) OVER ({order}) IS NULL AS is_last",
    ).selectExpr(
        "*",
        f"coalesce(last(CASE WHEN n_ends > 0 THEN before + n - tail END, true) {earlier}, 0L) AS open_at",
    )
    base = (
        scanned.groupBy("file")
        .agg(F.sum("n").alias("n"))
        .selectExpr(
            "file",
            "coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base",
        )
    )
    first = "CASE WHEN n_ends > 0 THEN array(before + head - open_at) ELSE array() END"
    last_open = "CASE WHEN n_ends > 0 THEN before + n - tail ELSE open_at END"
    left = f"CASE WHEN is_last AND before + n > {last_open} THEN array(before + n - ({last_open})) ELSE array() END"
    return (
        scanned.selectExpr(
            "file", "number", "n_ends", "open_at", f"posexplode(concat({first}, inner, {left})) AS (k, n_tokens)"
        )
        .selectExpr(
            "file",
            "number + k AS number",
            "open_at + coalesce(sum(n_tokens) OVER (PARTITION BY file, number, open_at ORDER BY k "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset",
            "n_tokens",
            "k < n_ends AS ended",
        )
        .join(base, "file")
        .selectExpr("file", "number", "base + offset AS start", "n_tokens", "ended")
    )


def count_documents(spark: SparkSession, path: str, separator: int, id_bytes: int = 2) -> DataFrame:
    """The counts of files written by ``write_flat``, with the documents' ids."""
    read = spark.read.schema(FILES).parquet(path)
    counts = count_tokens(read.filter("kind = 'tokens'"), separator, id_bytes)
    names = read.filter("kind = 'names'").selectExpr(
        "file", "posexplode(doc_ids) AS (k, doc_id)", "block"
    ).selectExpr("file", "bigint(block) * 10000 + k AS number", "doc_id")
    return counts.join(names, ["file", "number"]).select("doc_id", "file", "number", "start", "n_tokens")
