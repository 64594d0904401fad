"""WARC archives with each payload stored once: revisits resolved by payload digest.

``write`` makes archives of response records, ``headers`` reads what identifies each record, ``resolve`` finds for
every record the response that it repeats, ``deduplicate`` writes archives in which only that response
carries the payload, and ``read`` resolves their revisits. Only headers are shuffled: by digest, to find the
response to keep, and by file and offset, to copy records in one pass over each archive. Payloads go from file
to file in the task that reads them. An archive is a file of gzip members, one a record, of about
``FILE_BYTES``, so that a file is a small unit of work however large the crawl is.

Files are written under names that no other attempt uses and moved into the folder once the table of
their records is complete (see ``sources.stores``); lost executors leave nothing in the folder.

Records with equal payload digests (SHA-1) of at least ``least_bytes`` bytes are copies. The one with the greatest page id
is the response (null is the least; ids that are whole numbers go by value, others by their text before them; of equal ids the
greater record id), the others become revisits. Records that were revisits before stay so, now of the response that
is kept; one without a digest takes that of the record it refers to; one whose response is not in the folder keeps its old reference.

Rows: a null html is an empty payload; a null page id or url has no header and reads back as null; an empty text
reads back as empty. Spaces and control characters of a url or page id are written as percent codes. Repeated rows are
records of their own. Empty tables give a folder without archives. Long texts are held one at a time. Columns other than the three named are left out.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from snapcount.session import cut, ship_package, spread
from snapcount.sources.stores import publish, staging_folder, store

FILE_BYTES = 16_000_000
READ_BYTES = 1 << 16
HELD_BYTES = 1 << 22  # of rows that a task gathers before it hands them on
DATE = "2026-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# One row a record. ``file`` is the archive's name in its folder; ``offset`` and ``length`` place the gzip member.
RECORDS = (
    "file string, offset long, length long, record_id string, record_type string, page_id string, url string, "
    "date string, payload_digest string, payload_bytes long, refers_to string"
)


def schema_and_arrow(ddl: str) -> tuple[T.StructType, pa.Schema]:
    schema = T._parse_datatype_string(ddl)
    return schema, to_arrow_schema(schema)


# -- one record ----------------------------------------------------------------------------


def sha1(data: bytes) -> str:
    """Bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def member(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as one gzip member."""
    lines = ["WARC/1.1"] + [f"{name}: {value}" for name, value in fields if value is not None]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def http_head(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def response(record: dict, block: bytes) -> bytes:
    return member(
        [
            ("WARC-Type", "response"),
            ("WARC-Record-ID", f"<{record['record_id']}>"),
            ("WARC-Date", record["date"]),
            ("WARC-Target-URI", record["url"]),
            ("WARC-Payload-Digest", f"sha1:{record['payload_digest']}"),
            ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Page-ID", record["page_id"]),
        ],
        block,
    )


def revisit(record: dict, block: bytes) -> bytes:
    digest = record["payload_digest"]
    return member(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", f"<{record['record_id']}>"),
            ("WARC-Date", record["date"]),
            ("WARC-Target-URI", record["url"]),
            ("WARC-Profile", IDENTICAL),
            ("WARC-Refers-To", record["refers_to"] and f"<{record['refers_to']}>"),
            ("WARC-Refers-To-Target-URI", record.get("refers_to_url")),
            ("WARC-Refers-To-Date", record.get("refers_to_date")),
            ("WARC-Payload-Digest", digest and f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Page-ID", record["page_id"]),
        ],
        block,
    )


def parsed(data: bytes) -> tuple[dict, bytes, bytes]:
    """Fields of a record, its HTTP head, and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, end, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/"):
        http, end, payload = b"", b"", block
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    response_ = fields["WARC-Type"] != "revisit"
    record = {
        "record_id": fields["WARC-Record-ID"].strip("<>"),
        "record_type": fields["WARC-Type"],
        "page_id": fields.get("Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "date": fields.get("WARC-Date"),
        "payload_digest": sha1(payload) if response_ else digest,
        "payload_bytes": len(payload) if response_ else None,
        "refers_to": fields["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in fields else None,
    }
    if response_ and digest not in (None, record["payload_digest"]):
        raise ValueError(f"payload of {record['record_id']} has another digest than its header says")
    return record, http + end, payload


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member, one at a time."""
    offset, waiting = 0, stream.read(READ_BYTES)
    while waiting:
        unpack, parts, length = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not waiting:
                raise EOFError("archive ends inside a record")
            parts.append(unpack.decompress(waiting))
            length += len(waiting) - len(unpack.unused_data)
            waiting = unpack.unused_data if unpack.eof else stream.read(READ_BYTES)
        yield offset, length, b"".join(parts)
        offset += length
        waiting = waiting or stream.read(READ_BYTES)


class Archives:
    """Writes records to one archive after another in a staging folder."""

    def __init__(self, staging: str, most: int):
        self.system, self.root = store(staging)
        self.most = most
        self.stream, self.name, self.offset = None, "", 0

    def add(self, record: dict, data) -> dict:
        """Give the record its id and place. ``data`` makes its bytes once the id is known."""
        if self.stream is None:
            self.system.create_dir(self.root, recursive=True)
            self.name, self.offset = f"{uuid.uuid4().hex}.warc.gz", 0
            self.stream = self.system.open_output_stream(posixpath.join(self.root, self.name), compression=None)
        record = record | {"record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{self.name}#{self.offset}')}"}
        content = data(record)
        self.stream.write(content)
        placed = record | {"file": self.name, "offset": self.offset, "length": len(content)}
        self.offset += len(content)
        if self.offset >= self.most:
            self.close()
        return placed

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def rows_of(records: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in records], schema=arrow)


def _published(written: DataFrame, staging: str, folder: str) -> DataFrame:
    """Write the table of records, then move its archives into the folder."""
    index = cut(written)
    publish(index.select(F.col("file").alias("staged"), F.col("file").alias("name")), staging, folder)
    return index


# -- archives ------------------------------------------------------------------------------


def write(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write a response record for each row of ``pages`` (page_id, url, html); returns their headers."""
    spark = pages.sparkSession
    ship_package(spark)
    schema, arrow = schema_and_arrow(RECORDS)
    staging = staging_folder(spark, folder)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(staging, FILE_BYTES)
        for batch in batches:
            done = []
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                payload, page_id, url = (html.as_py() or "").encode(), page_id.as_py(), url.as_py()
                block = http_head(len(payload)) + payload
                record = {
                    "record_type": "response", "page_id": None if page_id is None else one_line(page_id),
                    "url": None if url is None else one_line(url), "date": date,
                    "payload_digest": sha1(payload), "payload_bytes": len(payload), "refers_to": None,
                }
                done.append(archives.add(record, lambda r, block=block: response(r, block)))
            yield rows_of(done, arrow)
        archives.close()

    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    return _published(rows.mapInArrow(each, schema), staging, folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the archives of a folder."""
    store(folder)[0].create_dir(store(folder)[1], recursive=True)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"))


def headers(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in ``folder``, with its payload too if asked for.

    Every payload is read and compared with its digest.
    """
    ship_package(spark)
    schema, arrow = schema_and_arrow(RECORDS + (", payload binary" if payloads else ""))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found, held = [], 0
                with system.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for offset, length, data in members(stream):
                        record, _, payload = parsed(data)
                        found.append(record | {"file": name, "offset": offset, "length": length, "payload": payload})
                        if not payloads:
                            del found[-1]["payload"]
                        held += length if payloads else 1000
                        if held > HELD_BYTES:
                            yield rows_of(found, arrow)
                            found, held = [], 0
                yield rows_of(found, arrow)

    return spread(_files(spark, folder), "file").mapInArrow(each, schema)


def _with_reference(records: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``columns`` of the record that each revisit refers to, as ``original_<column>``.

    Only revisits are shuffled. The side that is referred to has one row an id, so Spark may split the rows that refer to
    one much used response.
    """
    targets = records.filter(F.col("record_type") != "revisit").select(
        F.col("record_id").alias("refers_to"), *(F.col(c).alias(f"original_{c}") for c in columns)
    )
    refers = (F.col("record_type") == "revisit") & F.col("refers_to").isNotNull()
    alone = records.filter(~refers).withColumns(
        {f"original_{c}": F.lit(None).cast(records.schema[c].dataType) for c in columns}
    )
    return records.filter(refers).join(targets, "refers_to", "left").select(*alone.columns).unionByName(alone)


def resolve(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with the decision on each: ``new_type``, and of revisits the response that is kept (``kept_file``,
    ``kept_offset``, ``kept_url``, ``kept_date``)."""
    known = _with_reference(records, ["payload_digest", "payload_bytes"])
    known = known.withColumns(
        {c: F.coalesce(c, f"original_{c}") for c in ("payload_digest", "payload_bytes")}
    ).drop("original_payload_digest", "original_payload_bytes")
    number = F.expr("try_cast(page_id as long)")
    rank = F.struct(
        F.col("page_id").isNotNull(), number.isNotNull().alias("whole"), number.alias("number"), "page_id", "record_id"
    )
    place = F.struct("file", "offset", "url", "date")
    kept = (
        known.filter((F.col("record_type") != "revisit") & (F.col("payload_bytes") >= least_bytes))
        .groupBy("payload_digest")
        .agg(F.max_by(place, rank).alias("kept"))
    )
    joined = known.join(kept, "payload_digest", "left")
    itself = (F.col("kept.file") == F.col("file")) & (F.col("kept.offset") == F.col("offset"))
    again = (F.col("record_type") == "revisit") | (F.col("kept").isNotNull() & ~itself)
    return joined.select(
        *records.columns,
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("new_type"),
        *(F.when(again, F.col(f"kept.{c}")).alias(f"kept_{c}") for c in ("file", "offset", "url", "date")),
    )


def deduplicate(
    spark: SparkSession, source: str, target: str, least_bytes: int = 0, records: DataFrame | None = None
) -> DataFrame:
    """Copy the archives of ``source`` to ``target`` with every payload once and fresh headers.

    ``records`` are the headers of ``source``, if they are at hand (as ``write`` returns them). The kept responses are
    written first, so that revisits can name their new ids. Returns the new headers.
    """
    decided = cut(resolve(cut(headers(spark, source)) if records is None else records, least_bytes))
    schema, arrow = schema_and_arrow(RECORDS + ", old_file string, old_offset long")
    names = [n for n in RECORDS.replace(",", "").split()[::2] if n != "refers_to"]

    def copied(rows: DataFrame, staging: str) -> DataFrame:
        """Copy these records, file by file in order of their places."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = store(source)
            archives, name, stream = Archives(staging, FILE_BYTES), None, None
            for batch in batches:
                done = []
                for row in batch.to_pylist():
                    if row["file"] != name:
                        if stream is not None:
                            stream.close()
                        name, stream = row["file"], system.open_input_file(posixpath.join(root, row["file"]))
                    stream.seek(row["offset"])
                    _, head, payload = parsed(zlib.decompress(stream.read(row["length"]), 31))
                    record = row | {"old_file": row["file"], "old_offset": row["offset"], "record_type": row["new_type"]}
                    if row["new_type"] == "revisit":
                        done.append(archives.add(record, lambda r, head=head: revisit(r, head)))
                    else:
                        done.append(archives.add(record, lambda r, block=head + payload: response(r, block)))
                yield rows_of(done, arrow)
            if stream is not None:
                stream.close()
            archives.close()

        placed = spread(rows, "file").sortWithinPartitions("file", "offset")
        return _published(placed.mapInArrow(each, schema), staging, target)

    common = ["new_type", *names]
    responses = decided.filter(F.col("new_type") != "revisit").select(*common, F.lit(None).cast("string").alias("refers_to"))
    first = copied(responses, staging_folder(spark, target))
    ids = first.select(
        F.col("old_file").alias("kept_file"), F.col("old_offset").alias("kept_offset"), F.col("record_id").alias("new_id")
    )
    revisits = decided.filter(F.col("new_type") == "revisit").join(ids, ["kept_file", "kept_offset"], "left")
    second = copied(
        revisits.select(
            *common, F.coalesce("new_id", "refers_to").alias("refers_to"),
            F.col("kept_url").alias("refers_to_url"), F.col("kept_date").alias("refers_to_date"),
        ),
        staging_folder(spark, target),
    )
    return first.unionByName(second).drop("old_file", "old_offset")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder's archives, revisits with the size of the payload and the page that they refer to."""
    found = cut(headers(spark, folder))
    known = _with_reference(found, ["page_id", "payload_bytes"])
    return known.withColumn("payload_bytes", F.coalesce("payload_bytes", "original_payload_bytes")).withColumnsRenamed(
        {"original_page_id": "refers_to_page"}
    ).drop("original_payload_bytes")
