r"""WARC archives written and read as rows of chunks.

Writing: a record is a head and a run of payload chunks, each a row of (record, chunk number).
Payloads are framed as HTTP chunks, so that every row ends in a line break: Spark's own text
writer joins the rows and commits the files, on any file system it can reach. Payloads are cut
by Spark as they are written; no Python runs on this side.

Reading: Spark reads the lines of an archive in order, and a task takes them through one
parser that holds the head of a record, one line and one chunk, whatever the size of the
payload. It gives a row for each chunk; digests are carried on from chunk to chunk, and the
last row of a record has them whole.

Archives are compressed as a whole (gzip) and have one file a partition. Spark names them
``part-*.txt.gz``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadtide.llm.common import ship
from leadtide.workspace import fresh_path, store

#: Payload bytes of a chunk row.
CHUNK = 1 << 16
#: The version line, the date of records without one of their own, the profile
#: of a revisit, and the alphabet of base32.
VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = ["page_id", "url", "sha1", "sha256", "n_bytes"]
PAYLOAD = ["sha1", "sha256", "n_bytes"]


def base32(hexadecimal: Column) -> Column:
    """Base32 of 20 bytes given as hexadecimal digits: five digits make four letters."""
    parts = []
    for group in range(8):
        number = F.conv(F.substring(hexadecimal, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def with_payload(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (bytes of ``html``, empty for null) and its digests."""
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    return pages.select(pages["page_id"].cast("bigint").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload")).select(
        "*",
        F.sha1("payload").alias("sha1"),
        F.sha2("payload", 256).alias("sha256"),
        F.length("payload").cast("bigint").alias("n_bytes"),
    )


def shared_payloads(pages: DataFrame) -> DataFrame:
    """The records that share their payload with another, and the one that holds it.

    One row for each different (page, url, payload) of such records: how many rows it stands
    for (``times``), and page and url of the holder, the record with the largest page_id (null
    is the smallest; of equal ones, that with the largest url). Two payloads are equal if
    SHA-1, SHA-256 and length agree.
    """
    narrow = with_payload(pages).select(*RECORD)
    records = narrow.groupBy(*RECORD).agg(F.count(F.lit(1)).alias("times"))
    largest = F.max(F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", "url"))
    shared = (
        records.groupBy(*PAYLOAD)
        .agg(F.sum("times").alias("copies"), largest.alias("holder"))
        .filter("copies > 1")
        .select(*PAYLOAD, F.col("holder.page_id").alias("holder_id"), F.col("holder.url").alias("holder_url"))
    )
    return records.join(shared, PAYLOAD)


def record_id(page_id: Column, url: Column, sha256: Column, number: Column) -> Column:
    """A URI that names the page and tells all records apart."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    known = F.concat_ws(" ", text(page_id), url.isNull().cast("string"), text(url), sha256, number.cast("string"))
    return F.concat(F.lit("<urn:page:"), text(page_id), F.lit(":"), F.md5(known), F.lit(">"))


def _records(pages: DataFrame) -> DataFrame:
    """The pages as records: with ``number`` among equal rows and the response they refer to.

    The table of shared payloads is written first: Spark sees its size, broadcasts it if it
    is small and joins by shuffle if not. Equal rows are counted, not gathered.
    """
    rows = with_payload(pages)
    shared = store(shared_payloads(pages), "revisits").select(
        *[F.col(c).alias(f"s_{c}") for c in RECORD], "times", "holder_id", "holder_url", F.lit(True).alias("shared")
    )
    same = [rows[c].eqNullSafe(shared[f"s_{c}"]) for c in RECORD]
    joined = rows.join(shared, same, "left").drop(*[f"s_{c}" for c in RECORD])
    columns = [*rows.columns, "shared", "holder_id", "holder_url"]
    out = joined.filter("times IS NULL OR times = 1").select(*columns, F.lit(0).cast("bigint").alias("number"))
    if shared.filter("times > 1").head(1):
        repeated = joined.filter("times > 1").groupBy(*columns).agg(F.count(F.lit(1)).alias("times"))
        numbers = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("number")
        out = out.unionByName(repeated.select(*columns, numbers))
    return out


def chunk_lines(pages: DataFrame, chunk: int = CHUNK, at_least: int = 0, date: str = DATE) -> DataFrame:
    """``record_id``, ``chunk``, ``value`` (bytes without their final line feed) of the archive.

    Chunk 0 of a record is its head, with the first payload bytes of a response. A revisit is
    its head alone: it keeps the HTTP head with the length of the payload.
    """
    rows = _records(pages)
    is_holder = (
        rows["page_id"].eqNullSafe(rows["holder_id"]) & rows["url"].eqNullSafe(rows["holder_url"]) & (rows["number"] == 0)
    )
    full, rest = F.floor(F.col("n_bytes") / chunk), F.col("n_bytes") % chunk
    framed = full * (chunk + len(f"{chunk:x}") + 4) + F.when(rest > 0, rest + F.length(F.hex(rest)) + 4).otherwise(0) + 5
    rows = rows.select(
        "*",
        (F.col("shared").isNotNull() & ~is_holder & (F.col("n_bytes") >= at_least)).alias("is_revisit"),
        record_id(rows["page_id"], rows["url"], rows["sha256"], rows["number"]).alias("record_id"),
        record_id(rows["holder_id"], rows["holder_url"], rows["sha256"], F.lit(0)).alias("refers_to"),
    )
    revisit = F.col("is_revisit")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(revisit, F.concat(F.lit("Content-Length: "), F.col("n_bytes"))).otherwise(
            F.lit("Transfer-Encoding: chunked")
        ),
        F.lit("\r\n\r\n"),
    )
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.length(http) + F.when(revisit, 0).otherwise(framed)
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.concat(F.lit("\r\nWARC-Record-ID: "), "record_id"),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean), F.lit("")),
        F.concat(F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), "refers_to", F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        block,
        F.lit("\r\n\r\n"),
        http,
    )
    last = F.when(revisit, 0).otherwise(F.ceil(F.col("n_bytes") / chunk)).cast("int")
    # Heads are made once a record; the payload is cut row by row, by reference to its bytes.
    rows = rows.select("record_id", "payload", "is_revisit", head.alias("head"), last.alias("last"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("chunk"))
    data = F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))
    begin = F.when(F.col("chunk") == 0, F.col("head")).otherwise("").cast("binary")
    more = F.col("chunk") < F.col("last")
    body = (
        F.when(F.col("is_revisit"), F.lit(b"\r\n\r"))
        .when(
            more,
            F.concat(F.lower(F.hex(F.length(data))).cast("binary"), F.lit(b"\r\n"), data, F.lit(b"\r")),
        )
        .otherwise(F.lit(b"0\r\n\r\n\r\n\r"))
    )
    return rows.select("record_id", "chunk", F.concat(begin, body).alias("value"))


def write(
    pages: DataFrame, path: str | None = None, chunk: int = CHUNK, at_least: int = 0, date: str = DATE
) -> str:
    """Write a WARC record for each row of ``pages`` (``page_id``, ``url``, ``html``).

    Returns the folder. Rows with equal payloads of at least ``at_least`` bytes are one
    response, the row with the largest page_id, and revisits of it.

    * Null ``html`` is an empty payload; a null ``url`` leaves out the target URI; line breaks
      in a url are written as ``%0D`` and ``%0A``. A null ``page_id`` is smaller than any.
    * Rows equal in page_id, url and html are records of their own, told apart by a number;
      the first is the response. Other columns are not written, whatever their names.
    * An empty table gives archives without records.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    lines = chunk_lines(pages, chunk, at_least, date).select(F.col("value").cast("string").alias("value"))
    lines.write.options(lineSep="\n", compression="gzip", maxRecordsPerFile=0).text(path)
    return path


class _Lines:
    """The bytes of one file, as lines or by length; holds one line."""

    def __init__(self, lines: Iterator[bytes], file: str):
        self.lines, self.file, self.held = lines, file, b""

    def line(self) -> bytes | None:
        """The next line, with its line feed; None at the end of the file."""
        if self.held:
            held, self.held = self.held, b""
            return held
        return next(self.lines, None)

    def head(self, open_end: bool = False) -> dict[str, str]:
        """Header fields up to the empty line, by lower-case name."""
        fields: dict[str, str] = {}
        name = None
        while True:
            line = self.line()
            if line is None and open_end:
                return fields
            if line is None:
                raise ValueError(f"{self.file}: the file ends in a head")
            text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
            if not text:
                return fields
            if text[0] in " \t" and name:  # a folded line
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes, a line at most at once."""
        while size > 0:
            line = self.line()
            if line is None:
                raise ValueError(f"{self.file}: the file ends in a block")
            if len(line) > size:
                line, self.held = line[:size], line[size:]
            size -= len(line)
            yield line


def _chunked(lines: _Lines) -> Iterator[bytes]:
    """The payload of a block in HTTP chunks."""
    while True:
        size = int((lines.line() or b"").split(b";")[0].strip() or b"0", 16)
        if size == 0:
            lines.head(True)  # trailing fields
            return
        yield from lines.take(size)
        lines.line()


class _Counted(_Lines):
    """A block of known length inside a file."""

    def __init__(self, outer: _Lines, size: int):
        self.held, self.file = b"", outer.file
        self.lines = outer.take(size)


def _regrouped(pieces: Iterator[bytes], chunk: int) -> Iterator[bytes]:
    """The same bytes, ``chunk`` at a time; at least one piece, perhaps empty."""
    held, size, given = [], 0, False
    for piece in pieces:
        while size + len(piece) >= chunk:
            head, piece = piece[: chunk - size], piece[chunk - size :]
            yield b"".join([*held, head])
            held, size, given = [], 0, True
        if piece:
            held.append(piece)
            size += len(piece)
    if held or not given:
        yield b"".join(held)


def parse(lines: Iterator[bytes], file: str, chunk: int) -> Iterator[tuple]:
    """Rows (number, fields, http fields, chunk, data, digest or None) of one file's lines."""
    stream, number = _Lines(lines, file), 0
    while True:
        line = stream.line()
        if line is None:
            return
        if not line.strip(b"\r\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{file}: a record does not start with its version: {line[:40]!r}")
        fields = stream.head()
        block = _Counted(stream, int(fields["content-length"]))
        http: dict[str, str] = {}
        payload = iter(block.line, None)
        if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
            block.line()
            http = block.head(True)
            if fields.get("warc-type") != "revisit" and "chunked" in http.get("transfer-encoding", "").lower():
                payload = _chunked(block)
        digest, at, held = hashlib.sha1(), 0, None
        for data in _regrouped(payload, chunk):
            if held is not None:
                yield number, fields, http, at, held, None
                at += 1
            digest.update(data)
            held = data
        yield number, fields, http, at, held, base64.b32encode(digest.digest()).decode()
        for _ in iter(block.line, None):  # what is left of the block
            pass
        number += 1


CHUNKS = (
    "file string, record bigint, chunk bigint, last boolean, record_id string, record_type string, "
    "target_uri string, refers_to string, stated_digest string, stated_bytes bigint, data binary, "
    "bytes_so_far bigint, payload_digest string"
)
_ARROW = pa.schema(
    [
        ("file", pa.string()), ("record", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()),
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
        ("refers_to", pa.string()), ("stated_digest", pa.string()), ("stated_bytes", pa.int64()),
        ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("payload_digest", pa.string()),
    ]
)
#: Output rows and payload bytes of one batch.
BATCH_ROWS, BATCH_BYTES = 5_000, 8 << 20


def _reader(chunk: int, with_data: bool):
    def files(batches):
        """Runs of lines of the same file."""
        state = {"batch": None, "at": 0}

        def refill() -> bool:
            while state["batch"] is None or state["at"] == len(state["batch"][0]):
                batch = next(batches, None)
                if batch is None:
                    return False
                names, n = batch.column(0), batch.num_rows
                one = n and names[0] == names[n - 1]  # the lines of a file are neighbours
                names = [names[0].as_py()] * n if one else names.to_pylist()
                state["batch"], state["at"] = (names, batch.column(1).to_pylist()), 0
            return True

        def lines(file):
            while refill() and state["batch"][0][state["at"]] == file:
                state["at"] += 1
                yield state["batch"][1][state["at"] - 1] + b"\n"

        while refill():
            file = state["batch"][0][state["at"]]
            run = lines(file)
            yield file, run
            for _ in run:
                pass

    def run(batches):
        rows, held = [], 0
        for file, lines in files(iter(batches)):
            so_far = 0
            for number, fields, http, at, data, digest in parse(lines, file, chunk):
                so_far = len(data) + (so_far if at else 0)
                if not with_data and digest is None:
                    continue
                length = http.get("content-length", "")
                rows.append(
                    (
                        file, number, at, digest is not None, fields.get("warc-record-id"), fields.get("warc-type"),
                        fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest"),
                        int(length) if length.isdigit() else None, data if with_data else None, so_far, digest,
                    )
                )
                held += len(data) if with_data else 0
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return run


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of archives: a record's rows are neighbours and in order.

    ``data`` holds up to ``chunk`` payload bytes; ``bytes_so_far`` counts them; the row with
    ``last`` has ``payload_digest``, base32 SHA-1 of the payload read. A payload is the HTTP
    entity of a record of type ``application/http``, else the block; an empty one is one row
    of no bytes. ``stated_digest`` and ``stated_bytes`` are what the heads say. Without
    ``with_data`` only the last rows are given, and no bytes leave the tasks.

    A file is read by one task, from its start: gzip files always are. A plain file that
    Spark would split raises; compress it, or raise ``spark.sql.files.maxPartitionBytes``.
    """
    ship(spark)
    whole = F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    file = F.when(whole, F.col("_metadata.file_path")).otherwise(
        F.raise_error(F.concat(F.lit("split archive: "), F.col("_metadata.file_path")))
    )
    lines = spark.read.option("lineSep", "\n").text(path).select(file.alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(_reader(chunk, with_data), CHUNKS)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id given by ``record_id``."""
    return F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*):", 1).try_cast("bigint")


def read_pages(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and
    ``verified`` of every record written by ``write``.

    Length and digest of a response are those of the payload read; a revisit has none and
    states them. ``verified``: a response has the digest that its head states.
    """
    records = read_chunks(spark, path, chunk, with_data=False)
    revisit = F.col("record_type") == "revisit"
    stated = F.regexp_replace("stated_digest", "^sha1:", "")
    return records.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, page_of(F.col("refers_to"))).alias("refers_to"),
        (revisit | (stated == F.col("payload_digest"))).alias("verified"),
    )
