"""WARC archives by way of a chunked record table.

A payload is never a value of a Python task: it streams as rows of record and
chunk number, a digest is carried from chunk to chunk, and the archive is
written and read in the same pieces. Archive files lie in the shared folder;
only files named in the committed list of segments count, so the leftovers of
a lost task are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskspark.llm.arrow_text import batch_of, map_batches
from deskspark.llm.stored import stored
from deskspark.session import run_folder

CHUNK_BYTES = 256 << 10
#: An archive file is closed after so many bytes; a segment of it is one task's reading.
FILE_BYTES = 1 << 30
SEGMENT_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0
#: Pages carry no time of their own.
RECORD_DATE = "1970-01-01T00:00:00Z"
READ_BYTES = 1 << 20

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _digest(hasher) -> str:
    return base64.b32encode(hasher.digest()).decode()


def chunked(rows: DataFrame, data: Column, keep: list[str], size: int = CHUNK_BYTES) -> DataFrame:
    """Each row's bytes as rows ``chunk_no, last, chunk`` in order; no bytes are one empty chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.length("_data") / size)).cast("int")
    told = rows.select(*keep, F.coalesce(data, F.lit(b"")).alias("_data"))
    numbered = told.select(*keep, "_data", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    return numbered.select(
        *keep,
        "chunk_no",
        (F.col("chunk_no") == F.col("_n") - 1).alias("last"),
        F.substring("_data", F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"),
    )


def carried_digests(chunks: DataFrame, keep: list[str]) -> DataFrame:
    """One row per record: ``keep``, ``payload_bytes`` and ``payload_digest``, from its chunks in order.

    Chunks of a record follow each other in one partition, as ``chunked`` and
    ``read_chunks`` leave them.
    """
    fields = chunks.select(*keep).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, size = hashlib.sha1(), 0
        for batch in batches:
            names = batch.schema.names
            numbers, last, data = (batch.column(names.index(c)) for c in ("chunk_no", "last", "chunk"))
            ends, sizes, digests = [], [], []
            for i, (number, closes) in enumerate(zip(numbers.to_pylist(), last.to_pylist())):
                if number == 0:
                    hasher, size = hashlib.sha1(), 0
                piece = data[i].as_buffer()
                hasher.update(piece)
                size += len(piece)
                if closes:
                    ends.append(i)
                    sizes.append(size)
                    digests.append(_digest(hasher))
            kept = [batch.column(names.index(c)).take(pa.array(ends, pa.int64())) for c in keep]
            kinds = [*[k.type for k in kept], pa.int64(), pa.string()]
            yield batch_of([*keep, "payload_bytes", "payload_digest"], [*kept, sizes, digests], kinds)

    told = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_batches(chunks, task, f"{told}, payload_bytes long, payload_digest string")


def classify(digests: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``refers_to``: the smallest id with the same payload, null for that record itself."""
    first = digests.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"))
    again = (F.col("first_id") < F.col("page_id")) & (F.col("payload_bytes") >= least)
    return digests.join(first, ["payload_digest", "payload_bytes"]).withColumn(
        "refers_to", F.when(again, F.col("first_id"))
    )


def _open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:") :]
    return fs.FileSystem.from_uri(folder)


def _header(page: str, url: str | None, refers_to: str | None, size: int, digest: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {RECORD_DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {size}"]
    block = len(HTTP_HEAD) + (size if refers_to is None else 0)
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {block}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + HTTP_HEAD


class _Archive:
    """One task's archive file: a gzip member per record, in segments cut between records."""

    def __init__(self, folder: str) -> None:
        system, path = _open_folder(folder)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        system.create_dir(path, recursive=True)
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.at = self.start = 0
        self.packer = None

    def _put(self, data: bytes) -> None:
        if data:
            self.stream.write(data)
            self.at += len(data)

    def begin(self, header: bytes) -> None:
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.packer.compress(header))

    def add(self, data: memoryview) -> None:
        self._put(self.packer.compress(data))

    def end(self) -> None:
        self._put(self.packer.compress(b"\r\n\r\n"))
        self._put(self.packer.flush())

    def segment(self) -> tuple[str, int, int]:
        cut = (self.name, self.start, self.at)
        self.start = self.at
        return cut


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes records to archives in ``folder``; returns the stored list of ``file, start, stop`` segments.

    ``records`` has ``page_id, url, refers_to, payload_bytes, payload_digest``
    and ``payload`` (binary; not written for revisits).
    """
    keep = ["page_id", "url", "refers_to", "payload_bytes", "payload_digest"]
    body = F.when(F.col("refers_to").isNull(), F.col("payload"))
    told = records.select(
        F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("refers_to").cast("string").alias("refers_to"), "payload_bytes", "payload_digest", body.alias("payload"),
    )

    def cuts(found: list[tuple[str, int, int]]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[], [], []]
        return batch_of(["file", "start", "stop"], [list(c) for c in columns], [pa.string(), pa.int64(), pa.int64()])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, found = None, []
        for batch in batches:
            data = batch.column("chunk")
            rows = batch.drop_columns(["chunk"]).to_pylist()
            for i, row in enumerate(rows):
                if archive is None:
                    archive = _Archive(folder)
                if row["chunk_no"] == 0:
                    page = "" if row["page_id"] is None else row["page_id"]
                    archive.begin(
                        _header(page, row["url"], row["refers_to"], row["payload_bytes"], row["payload_digest"])
                    )
                archive.add(data[i].as_buffer())
                if row["last"]:
                    archive.end()
                    if archive.at - archive.start >= SEGMENT_BYTES:
                        found.append(archive.segment())
                    if archive.at >= FILE_BYTES:
                        found += [archive.segment()] if archive.at > archive.start else []
                        archive.stream.close()
                        archive = None
        if archive is not None:
            if archive.at > archive.start:
                found.append(archive.segment())
            archive.stream.close()
        yield cuts(found)

    segments = map_batches(chunked(told, F.col("payload"), keep), task, "file string, start long, stop long")
    return stored(segments, "segments")


def _records(stream, stop: int) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """Header fields and payload pieces of each record up to ``stop``; pieces must be read in turn."""
    packed = b""
    while packed or stream.tell() < stop:
        unpacker, held, done = zlib.decompressobj(31), bytearray(), False

        def more() -> bool:
            """Unpack some more of this record; at most ``READ_BYTES`` are added."""
            nonlocal packed, done
            if unpacker.eof:
                done = True
                return False
            source = unpacker.unconsumed_tail or packed or stream.read(min(READ_BYTES, stop - stream.tell()))
            packed = b""
            if not source:
                raise ValueError("Archive ends inside a record")
            held.extend(unpacker.decompress(source, READ_BYTES))
            if unpacker.eof:
                packed = unpacker.unused_data
            return True

        while (cut := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        fields = dict(x.split(": ", 1) for x in held[:cut].decode().split("\r\n")[1:])
        del held[: cut + 4]
        while (cut := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        left = int(fields["Content-Length"]) - cut - 4
        del held[: cut + 4]

        def payload() -> Iterator[bytes]:
            nonlocal left
            while left > 0:
                if not held:
                    more()
                piece = bytes(held[:left])
                del held[: len(piece)]
                left -= len(piece)
                yield piece

        yield fields, payload()
        while not done:
            more()


def _named(field: str | None) -> str | None:
    return None if field is None else field.removeprefix("<urn:page:").removesuffix(">")


_READ = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
    ("told_bytes", pa.int64()), ("told_digest", pa.string()), ("chunk_no", pa.int32()), ("last", pa.bool_()),
    ("chunk", pa.binary()),
]


def read_chunks(spark: SparkSession, folder: str, segments: DataFrame) -> DataFrame:
    """The records of the listed segments as chunk rows, in order and with their header fields."""
    names, kinds = [n for n, _ in _READ], [k for _, k in _READ]

    def chunks(row: dict) -> Iterator[tuple]:
        system, path = _open_folder(folder)
        with system.open_input_file(f"{path}/{row['file']}") as stream:
            stream.seek(row["start"])
            for fields, pieces in _records(stream, row["stop"]):
                told = fields.get("X-Payload-Length")
                head = (
                    _named(fields["WARC-Record-ID"]), fields["WARC-Type"], fields.get("WARC-Target-URI"),
                    _named(fields.get("WARC-Refers-To")), None if told is None else int(told),
                    fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                )
                number, before = 0, b""
                for piece in pieces:
                    if before:
                        yield (*head, number, False, before)
                        number += 1
                    before = piece
                yield (*head, number, True, before)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                for chunk in chunks(row):
                    rows.append(chunk)
                    held += len(chunk[-1])
                    if held >= 8 * READ_BYTES or len(rows) >= 4096:
                        yield batch_of(names, [list(c) for c in zip(*rows)], kinds)
                        rows, held = [], 0
                if rows:
                    yield batch_of(names, [list(c) for c in zip(*rows)], kinds)

    schema = (
        "record_id string, record_type string, url string, refers_to string, told_bytes long, "
        "told_digest string, chunk_no int, last boolean, chunk binary"
    )
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(segments.repartition(width, "file", "start"), task, schema)


def archive_pages(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES
) -> DataFrame:
    """Writes a WARC record per page, reads all archives back, and returns a row per record.

    Columns: ``page_id, payload_bytes, payload_digest, record_type, refers_to``
    and ``url``, all from what was read. A null html is an empty payload, a null
    url is left out of the record, a null id is written and read as empty.
    Equal rows are records of their own and count as one id: the response's
    copies are responses too. An empty table gives no archive and no rows; other
    columns are ignored. A payload that does not match its digest is an error.

    Pages move once, to meet their record type; the digest table and its groups
    hold ids only, so a payload shared by many pages makes no large group.
    """
    spark = pages.sparkSession
    kind = pages.select(page_id).schema[0].dataType.simpleString()
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("mark", F.xxhash64("payload"))
    found = carried_digests(chunked(rows, F.col("payload"), ["page_id", "mark"]), ["page_id", "mark"])
    typed = classify(stored(found, "digests"), least).distinct()
    told = typed.select(
        F.col("page_id").alias("t_page"), F.col("mark").alias("t_mark"), "payload_bytes", "payload_digest", "refers_to"
    )
    records = rows.join(told, F.col("page_id").eqNullSafe(F.col("t_page")) & (F.col("mark") == F.col("t_mark")))
    folder = run_folder(spark, "archives")
    segments = write_archives(records, folder)
    keep = ["record_id", "record_type", "url", "refers_to", "told_bytes", "told_digest"]
    read = carried_digests(read_chunks(spark, folder, segments), keep)
    response = F.col("record_type") == "response"
    checked = F.when(
        response & (F.col("payload_digest") != F.col("told_digest")), F.raise_error(F.lit("Payload digest differs"))
    ).otherwise(F.col("told_digest"))
    return read.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast(kind).alias("page_id"),
        F.when(response, F.col("payload_bytes")).otherwise(F.col("told_bytes")).alias("payload_bytes"),
        checked.alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        "url",
    )
