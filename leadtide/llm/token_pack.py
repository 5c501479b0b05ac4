"""Token ids with a fixed number of bits, in blocks with offsets.

A shard is a range of document ids; its blocks hold whole documents, in order, until a block
has ``BLOCK_TOKENS`` ids. Every id takes the bits that the largest id of the vocabulary
needs, so id ``i`` of a block lies at bit ``i * width`` and any slice can be unpacked alone.
Blocks are rows of a Parquet table: Spark commits them, so a lost executor leaves no half
file, and a block and its offsets come from the same attempt.

Columns: ``shard``, ``block``, ``first_token`` (ids before it in the shard), ``n_tokens``,
``width``, ``doc_ids``, ``doc_ends`` (ends of the documents, in ids of the block), ``payload``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.llm.common import ship
from leadtide.workspace import fresh_path

BLOCK_TOKENS = 1 << 16
BLOCKS = (
    "shard int, block int, first_token bigint, n_tokens int, width int, "
    "doc_ids array<bigint>, doc_ends array<int>, payload binary"
)
BLOCK_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()),
        ("n_tokens", pa.int32()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_ends", pa.list_(pa.int32())), ("payload", pa.binary()),
    ]
)


def bit_width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, low bits first; the last byte is filled with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload, width: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop``; only the bytes that hold them are touched."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", stop - start, start * size).astype("<u4")
    if stop <= start:
        return np.empty(0, "<u4")
    data = np.frombuffer(payload, np.uint8)
    first = start * width // 8
    part = np.concatenate([data[first : (stop * width + 7) // 8], np.zeros(8, np.uint8)])
    at = np.arange(start, stop, dtype=np.int64) * width - first * 8
    value = np.zeros(stop - start, np.uint64)
    for i in range((width + 7 + 7) // 8):
        value |= part[at // 8 + i].astype(np.uint64) << np.uint64(8 * i)
    return ((value >> (at % 8).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


class Memo(dict):
    """What a function gave, for at least the last ``size`` different keys."""

    def __init__(self, function, size: int):
        self.function, self.size, self.older = function, size, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """The ids of whole texts, with the ids of words kept.

    For texts in plain Latin letters, the vocabulary's normalisation is lower-casing and its
    words split at white space; those words are cut into pieces, and each different piece is
    encoded once by the vocabulary's own model. Any other text, and one in which a special
    token may be spelled, goes to the tokenizer whole. The tests hold both ways equal.
    ``special_as_text``: spelled special tokens are ordinary text.
    """

    #: The steps of a vocabulary to which the way by words applies.
    STEPS = ["NFC", "Replace", "Lowercase"]
    CUTS = [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", None]
    PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
    PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-ÿ]+|[0-9]|[^\sa-z0-9ß-ÿ]+")
    #: Words and pieces kept. A worker lives on after its task, so that a job of several stages
    #: may want fewer.
    KEPT = (250_000, 200_000)

    def __init__(self, path: str, special_as_text: bool = False, kept: tuple[int, int] = KEPT):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.whole.encode_special_tokens = special_as_text
        self.vocabulary = self.whole.get_vocab_size()
        self.special = None if special_as_text else [t["content"] for t in spec["added_tokens"]]
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = [s.get("pattern", {}).get("Regex") for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == self.STEPS and cuts == self.CUTS
        self.model = self.whole.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in range(256) if self.PLAIN.fullmatch(chr(c))]
        self.table = {ord(c): level.pre_tokenize_str(c)[0][0] for c in plain}
        self.dtype = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.pieces = Memo(self._piece, kept[1])
        self.words = Memo(self._word, kept[0])

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.translate(self.table))]
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.PIECE.findall(word.lower())])

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of ``text``; none for null."""
        if not text:
            return np.empty(0, self.dtype)
        if not self.by_word or not self.PLAIN.fullmatch(text) or any(s in text for s in self.special or ()):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return np.array(ids, self.dtype)
        return np.frombuffer(b"".join(map(self.words.__getitem__, text.split())), self.dtype)


ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, special_as_text: bool = False, kept: tuple[int, int] = Encoder.KEPT) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    key = path, special_as_text, kept
    if key not in ENCODERS:
        ENCODERS[key] = Encoder(path, special_as_text, kept)
    return ENCODERS[key]


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text), a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _blocks(path: str, end_id: int, vocabulary: int | None, kept: tuple[int, int]):
    def run(batches):
        encode = encoder(path, False, kept)
        width = bit_width(max(vocabulary or encode.vocabulary, end_id + 1))
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], encode.dtype)
        block = first = held = 0
        docs, ends, parts = [], [], []

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([v], t)
                    for v, t in zip(
                        [shard, block, first, held, width, docs, ends, pack(np.concatenate(parts), width)],
                        BLOCK_ARROW.types,
                    )
                ],
                schema=BLOCK_ARROW,
            )

        for doc_id, text in rows_of(batches):
            ids = encode(text)
            parts += [ids, end]
            held += len(ids) + 1
            docs.append(doc_id)
            ends.append(held)
            if held >= BLOCK_TOKENS:
                yield flush()
                block, first, held = block + 1, first + held, 0
                docs, ends, parts = [], [], []
        if docs:
            yield flush()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def stored_order(docs: DataFrame) -> list[Column] | None:
    """Columns that rise as the rows stand in the files that ``docs`` was read from, in the
    order of their part numbers; None if it was not read from Parquet files."""
    name = F.col("_metadata.file_name")
    order = [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("int"), name, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        return None
    return order


def write(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    path: str | None = None,
    order: list[Column] | None = None,
    kept: tuple[int, int] = Encoder.KEPT,
) -> str:
    """Encode whole texts and write them in ascending ``doc_id`` order; returns the path.

    ``order`` names other columns to order by; they should tell all rows apart. ``kept`` are
    the words and pieces that a worker keeps encoded: fewer take less memory and more time. Null and empty
    texts are documents with the end id alone. A null id comes first; equal ids are neighbours,
    in order of their texts. An empty table writes no block. Other columns are not read. A
    block is longer than ``BLOCK_TOKENS`` if one document is.
    """
    ship(docs.sparkSession)
    path = path or fresh_path(docs.sparkSession, "tokens")
    if order:
        names = [f"order_{i}" for i in range(len(order))]
        rows = docs.select("doc_id", "text", *[c.alias(n) for c, n in zip(order, names)])
        ordered = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("doc_id", "text")
    else:
        rows = docs.select("doc_id", "text")
        ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer, end_id, None, kept), BLOCKS).write.option(
        "compression", "zstd"
    ).parquet(path)
    return path


def _documents(batches):
    names = ["doc_id", "shard", "offset", "n_tokens", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        for row in range(batch.num_rows):
            shard, first, width = (batch.column(n)[row].as_py() for n in ("shard", "first_token", "width"))
            docs = batch.column("doc_ids")[row].as_py()
            ends = batch.column("doc_ends")[row].as_py()
            payload = batch.column("payload")[row].as_buffer()
            starts = [0, *ends[:-1]]
            crc = [zlib.crc32(unpack(payload, width, a, b)) for a, b in zip(starts, ends)]
            columns = [
                docs,
                [shard] * len(docs),
                [first + a for a in starts],
                [b - a for a, b in zip(starts, ends)],
                crc,
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id``, ``start`` (ids before it), ``n_tokens``, ``ids_crc32``."""
    ship(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    base = (
        blocks.groupBy("shard")
        .agg(F.sum("n_tokens").alias("n"))
        .selectExpr(
            "shard",
            "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base",
        )
    )
    read = blocks.mapInArrow(
        _documents, "doc_id bigint, shard int, offset bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return read.join(base, "shard").selectExpr(
        "doc_id", "base + offset AS start", "n_tokens", "ids_crc32"
    )


def read_tokens(payload, width: int, doc_ends: list[int], number: int) -> np.ndarray:
    """The ids of document ``number`` of a block."""
    return unpack(payload, width, doc_ends[number - 1] if number else 0, doc_ends[number])
