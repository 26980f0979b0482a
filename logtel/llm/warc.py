"""Dictionary-compressed web archives (``.warc.zst``).

A task writes its records to archives of about ``archive_bytes`` of payload.
An archive begins with a skippable frame that holds a Zstandard dictionary
built from the archive's own records; then every record is a frame of its own,
compressed with the dictionary, so that a reader can start at any record.

Of pages with equal payloads of at least ``least_bytes`` one is a response
and the others are revisits that refer to it and carry no payload. Equality
is found on digests; payloads move once, and a payload that very many pages
share is a join key that Spark splits.

Files go to a folder that all executors share, under names no other attempt
uses; a name is known only through the index row returned after the file was
closed, so what a lost task leaves behind is never read. The folder may be on
any file system that ``pyarrow.fs`` opens.

Results by case: a null html is an empty payload; a null url is replaced by
the record's own URI; pages that repeat the largest id and its payload are all
responses; a page without id refers to the named response, and without one
it is a response itself; extra columns are ignored; no pages give no archives.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack, unpack
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the skippable frame of a dictionary, and the profile of a revisit.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:page:"


@dataclass(frozen=True)
class Archives:
    """Parameters of the writer."""

    archive_bytes: int = 16 << 20
    least_bytes: int = 1000
    dictionary_bytes: int = 110_000
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"


def with_record_types(pages: DataFrame, spec: Archives = Archives()) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (null for revisits), ``digest``, ``n_bytes``, ``record_type`` and ``refers_to``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    shared = rows.filter(F.col("n_bytes") >= spec.least_bytes).groupBy("digest", "n_bytes")
    shared = shared.agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return rows.join(shared, ["digest", "n_bytes"], "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "digest",
        "n_bytes",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(revisit, F.col("keep")).alias("refers_to"),
    )


def _record(row: dict, spec: Archives) -> bytes:
    name = _NAME + ("" if row["page_id"] is None else str(row["page_id"]))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or "").encode("utf-8", "surrogatepass")
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": f"<{name}>",
        "WARC-Target-URI": name if row["url"] is None else quote(row["url"], safe="%/:=&?~#+!$,;'@()*[]"),
        "WARC-Date": spec.date,
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if row["record_type"] == "revisit":
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{_NAME}{row['refers_to']}>"}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes], most: int) -> zstandard.ZstdCompressionDict:
    """Trained on all records of the archive; with too few of them to train on, their beginning itself."""
    size = max(1024, min(most, sum(map(len, records)) // 64))
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[:size], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _archive(folder: str, records: list[bytes], spec: Archives) -> tuple[str, list[int], list[int]]:
    """Write one archive: its path, and offset and length of each record's frame."""
    dictionary = _dictionary(records, spec.dictionary_bytes)
    head = dictionary.as_bytes()
    files, root = fs.FileSystem.from_uri(folder)
    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    compressor = zstandard.ZstdCompressor(level=spec.level, dict_data=dictionary)
    offsets, lengths, at = [], [], 8 + len(head)
    with files.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None) as out:
        out.write(pack("<II", DICTIONARY_MAGIC, len(head)) + head)
        for record in records:
            frame = compressor.compress(record)
            out.write(frame)
            offsets.append(at)
            lengths.append(len(frame))
            at += len(frame)
    return path, offsets, lengths


def write_archives(typed: DataFrame, folder: str, spec: Archives = Archives()) -> DataFrame:
    """Write rows of ``with_record_types``; an index row ``page_id, archive, offset, length`` for each record.

    Store the result before reading it: every evaluation writes archives of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

        def closed(ids: list, records: list[bytes]) -> pa.RecordBatch:
            path, offsets, lengths = _archive(folder, records, spec)
            columns = [pa.array(ids, pa.int64()), pa.array([path] * len(ids)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            return pa.record_batch(columns, names=["page_id", "archive", "offset", "length"])

        ids, records, held = [], [], 0
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n].as_py() for name in batch.schema.names}
                ids.append(row["page_id"])
                records.append(_record(row, spec))
                held += len(records[-1])
                if held >= spec.archive_bytes:
                    yield closed(ids, records)
                    ids, records, held = [], [], 0
        if records:
            yield closed(ids, records)

    return typed.mapInArrow(write, "page_id bigint, archive string, offset bigint, length bigint")


def records_in(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive's bytes: header fields and block."""
    dictionary, at = None, 0
    if len(data) >= 8 and unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        at = 8 + unpack("<I", data[4:8])[0]
        dictionary = zstandard.ZstdCompressionDict(data[8:at])
    decompressor, view = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(data)
    while at < len(data):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(view[at : at + 65536]))
            at += min(65536, len(data) - at) - len(frame.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines)
        yield fields, rest[: int(fields["Content-Length"])]


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the archives named in ``index``: ``page_id``, ``url``, ``record_type``, ``payload`` (null for
    revisits), ``digest`` and ``n_bytes`` as their headers state them, and ``refers_to``."""
    archives = index.select("archive").distinct()
    # a row stands for a whole archive, so the rows are dealt out by their number, not by their size
    tasks = max(1, min(archives.count(), 20_000))
    schema = "page_id bigint, url string, record_type string, payload binary, digest string, n_bytes bigint, refers_to bigint"

    def number(uri: str | None) -> int | None:
        digits = uri.strip("<>")[len(_NAME) :] if uri else ""
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
        names = [part.split()[0] for part in schema.split(", ")]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_stream(place, compression=None) as source:
                    data = source.read()
                rows = []
                for fields, block in records_in(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append(
                        (number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], None if revisit else payload, digest, stated, number(fields.get("WARC-Refers-To")))
                    )
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return archives.repartition(tasks, "archive").mapInArrow(read, schema)
