"""WARC archives: write with an index, read back by coalesced byte ranges.

Writing tasks append one gzip member per record to an archive of their own and return
the index: archive, offset, length, URL and digest of every record. The index is written
before anything reads it, so archives of attempts that were lost are never referred to.
Readers get sorted stretches of the index, join neighbouring records into one byte range
and read no byte twice.

Cases: a null payload is empty; a null URL is written as an empty one and read back as
null; rows with equal ids and payloads are records of equal type; a page without id revisits
the smallest id that has its payload, and is a response where only pages without id have
it, as there is nothing to refer to; equal payloads below ``min_revisit`` bytes are all
responses; line ends in a URL are written and read back as ``%0D`` and ``%0A``. An empty
table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm.shared import shared_path, written

MIN_REVISIT = 100
LEVEL = 4
#: Neighbouring records are read together up to so many bytes, or over so large a gap.
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: So many archive bytes are one stretch of the index, read by one task.
STRETCH_BYTES = 64 << 20

INDEX = (
    "page_id long, archive string, at long, length long, url string, payload_digest string, "
    "record_type string, refers_to long"
)
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def record_bytes(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One record: headers, an empty line, the payload (none in a revisit) and two line ends."""
    revisit = refers_to is not None
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        fields.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        fields.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    body = b"" if revisit else payload
    fields += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The parts of a record; raises if its payload does not have its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if len(rest) != len(body) + 4 or kind == "response" and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page, to = (fields.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
    return {
        "page_id": int(page) if page else None,
        "url": fields["WARC-Target-URI"] or None,
        "payload": body if kind == "response" else None,
        "payload_bytes": len(body) if kind == "response" else int(fields["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(to) if to else None,
    }


def _revisits(pages: DataFrame, min_revisit: int) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload a smaller id has as well; no id counts as the largest."""
    keys = pages.where(F.octet_length("html") >= min_revisit).select(
        F.col("page_id").cast("long"), F.sha2("html", 256).alias("digest")
    )
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    found = keys.join(first, "digest").where("page_id IS NULL AND refers_to IS NOT NULL OR page_id > refers_to")
    return found.select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to").distinct()


def write_warc(
    pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = MIN_REVISIT
) -> DataFrame:
    """Write every row of (page_id, url, html) below ``folder``; returns the written index."""
    revisits = written(_revisits(pages, min_revisit), "revisits")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).join(
        revisits, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("digest") == F.col("revisit_digest")), "left"
    )
    rows = rows.select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            index = []
            for page, url, html, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store, path = pyarrow.fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page, url, html.encode(), digest, to, date)) + packer.flush()
                out.write(member)
                index.append((page, name, at, len(member), url, digest, "response" if to is None else "revisit", to))
                at += len(member)
            if index:
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], names=_names(INDEX))
        if out is not None:
            out.close()

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def _ranges(index: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, at, length) joined to (archive, from, to, records)."""
    name, start, stop, parts = None, 0, 0, []
    for archive, at, length in index:
        if parts and (archive != name or at > stop + GAP_BYTES or at + length - start > RANGE_BYTES):
            yield name, start, stop, parts
            parts = []
        if not parts:
            name, start = archive, at
        parts.append((at, length))
        stop = at + length
    if parts:
        yield name, start, stop, parts


def read_warc(index: DataFrame) -> DataFrame:
    """The records that (archive, at, length) rows of an index select, parsed and checked.

    The number of reading tasks follows the bytes of the records, not those of the index,
    which adaptive execution would go by; there is one for each core at least.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            for archive, start, stop, parts in _ranges(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if archive != name:
                    store, path = pyarrow.fs.FileSystem.from_uri(archive)
                    name, handle = archive, store.open_input_file(path)
                data = handle.read_at(stop - start, start)
                found = [parse_record(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in parts]
                types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in found], t) for k, t in zip(_names(RECORD), types)], names=_names(RECORD)
                )

    spots = index.select("archive", "at", "length")
    stretch = F.floor(F.col("at") / STRETCH_BYTES)
    size = spots.agg(F.sum("length")).first()[0] or 0
    tasks = max(size // STRETCH_BYTES + 1, index.sparkSession.sparkContext.defaultParallelism)
    placed = spots.repartition(tasks, "archive", stretch).sortWithinPartitions("archive", "at")
    return placed.mapInArrow(read, RECORD)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages, then read all records back through the index."""
    index = write_warc(pages, folder or shared_path(pages.sparkSession, "warc"))
    return read_warc(index)
