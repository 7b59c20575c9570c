"""WARC: a deterministic sharded writer, and a reader of what it wrote.

Writing range-sorts the records by page, each task streams its range into gzip members (one a record), rolls to a new
file when the compressed size passes ``roll_bytes``, and names each file for good only when it is whole; a manifest of
the files, written and committed by Spark, says which files count, and the reader holds every file against it. Headers
and digests are made anew from the payload. The ranges follow from the input alone, so a rerun of a task or a job
writes the same bytes under the same final names, and a lost executor leaves at most a file with a temporary name.

Of records with equal payloads the one with the largest page_id is the response and the others revisit it. The payload
is compressed before any shuffle, and only the small (digest, length, page_id) rows decide who revisits whom.

Defined cases: a null html is an empty payload, which is compared like any other; a null url is written as
``urn:page:<id>``; pages that repeat the largest page_id with an equal payload are all responses, and their record ids
get a number; a null page_id is below every other, sorts first, and is read back as null; an empty table writes an empty
manifest; a listed file that is missing, or is not what the manifest says, is an error. Very long pages are one record
each, and a file that is over its size after one holds no other. Columns besides those that an operator names are not
read by it, or are handed on as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from io import BytesIO
from itertools import islice
from zlib import DEFLATED, compressobj, decompress, decompressobj

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, shared_dir, ship_package, table

CRLF = "\r\n"
#: FIXED VALUES: the format's version and its profile for records that only point at an equal payload.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the pages carry no date; a fixed one keeps the files the same on every run

MANIFEST = "path string, records long, bytes long, sha1 string, partition int, number int"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string"


def member(data: bytes) -> bytes:
    """One gzip member, without a time stamp."""
    c = compressobj(6, DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(kind: str, page_id, url, digest: str, size: int, refers_to=None, payload: bytes = b"", copy: int = 0) -> bytes:
    """One record; a response carries the payload, a revisit its digest, its length and the record that has it.

    A record's id is its page and digest, with a number where a page repeats both.
    """
    name = "null" if page_id is None else page_id
    head = [
        VERSION,
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}:{digest}{f':{copy}' if copy else ''}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url if url is not None else f'urn:page:{name}'}".replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest if kind == 'response' else EMPTY_DIGEST}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}:{digest}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return (CRLF.join(head) + CRLF * 2).encode() + payload + (CRLF * 2).encode()


def base32(digest: bytes) -> str:
    return b32encode(digest).decode()


EMPTY_DIGEST = base32(sha1(b"").digest())


def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as the gzip member of its response record, with digest and length; before any shuffle."""
    for ids, urls, htmls in blocks(batches, 8_000_000):
        rows = []
        for page_id, url, html in zip(ids, urls, htmls, strict=True):
            payload = html.encode()
            found = sha1(payload)
            data = record("response", page_id, url, base32(found.digest()), len(payload), payload=payload)
            rows.append((page_id, url, found.hexdigest(), len(payload), member(data)))
        columns = zip(*rows, strict=True)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "hex", "size", "gz"])


def file_writer(folder: str, roll_bytes: int):
    """Streams a sorted partition into rolled files; yields a manifest row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        made: list[tuple] = []
        out = temporary = final = digest = None
        records = size = copy = 0
        before = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                if store.get_file_info(final).type == fs.FileType.NotFound:
                    store.move(temporary, final)
                else:  # an attempt before this one has named the same bytes
                    store.delete_file(temporary)
                made.append((final.rsplit("/", 1)[1], records, size, digest.hexdigest(), part, len(made)))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                this = (row["page_id"], row["hex"])  # equal ones follow each other, and lie in one range
                copy, before = copy + 1 if this == before else 0, this
                digest32 = base32(bytes.fromhex(row["hex"]))
                if row["refers_to"] is not None:
                    data = member(record("revisit", row["page_id"], row["url"], digest32, row["size"], row["refers_to"], copy=copy))
                elif copy:
                    payload = decompress(row["gz"], 31).partition(b"\r\n\r\n")[2][: row["size"]]
                    data = member(record("response", row["page_id"], row["url"], digest32, row["size"], payload=payload, copy=copy))
                else:
                    data = row["gz"]
                if out is None:
                    final = f"{root}/part-{part:06d}-{len(made):05d}.warc.gz"
                    temporary = f"{final}.{attempt}.tmp"
                    out, digest, records = store.open_output_stream(temporary), sha1(), 0
                    info = f"{VERSION}{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:file:{part}:{len(made)}>{CRLF}WARC-Date: {DATE}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: 0{CRLF * 3}{CRLF}"
                    first = member(info.encode())
                    out.write(first)
                    digest.update(first)
                    size = len(first)
                out.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
                if size >= roll_bytes:
                    close()
        close()
        if made:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["path", "records", "bytes", "sha1", "partition", "number"])

    return run


def range_count(compressed_bytes: float, shard_bytes: int, least_bytes: int, most_small: int) -> int:
    """One range for each shard_bytes; where those are fewer than most_small, up to that many of least_bytes or more."""
    return max(1, int(compressed_bytes // shard_bytes) + 1, min(most_small, int(compressed_bytes // least_bytes) + 1))


def write_warc(pages: DataFrame, folder: str, *, shard_bytes: int = 256 << 20, roll_bytes: int = 64 << 20, least_bytes: int = 4 << 20, most_small: int = 200) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under folder; returns the committed manifest.

    The number of ranges follows the input's size alone, with html taken to compress to a third (range_count()).
    """
    from pyarrow import fs

    spark = pages.sparkSession
    ship_package(spark)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{root}/archive", recursive=True)
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    made = own.mapInArrow(compressed, "page_id long, url string, hex string, size long, gz binary")
    # equal payloads are found on the hex digest that the JVM makes, without the payloads being moved
    slim = own.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("hex"), F.octet_length("html").alias("n"))
    last = slim.groupBy("hex", "n").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    revisits = slim.join(last, ["hex", "n"]).filter(~F.col("page_id").eqNullSafe(F.col("last")) & F.col("last").isNotNull())
    # page_id and digest name a page's rows; all that they name have the same payload and the same target
    targets = revisits.select(F.col("page_id").alias("revisit_id"), F.col("hex").alias("revisit_hex"), F.col("last").alias("refers_to")).distinct()
    joined = made.join(targets, F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("hex") == F.col("revisit_hex")), "left")
    kept = joined.select("page_id", "url", "hex", "size", "refers_to", F.when(F.col("refers_to").isNull(), F.col("gz")).alias("gz"))
    total = own.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    ranges = range_count(total / 3, shard_bytes, least_bytes, most_small)
    ordered = kept.repartitionByRange(ranges, F.col("page_id").asc_nulls_first(), "hex").sortWithinPartitions(F.col("page_id").asc_nulls_first(), "hex", "url")
    ordered.mapInArrow(file_writer(f"{folder}/archive", roll_bytes), MANIFEST).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parsed(path: str, data: bytes, slice_bytes: int = 1 << 20) -> Iterator[tuple]:
    """The records of one file, member by member, checked against their own digests."""
    stream, left = BytesIO(data), b""
    while left or stream.tell() < len(data):
        inflate, text = decompressobj(31), []
        while not inflate.eof:
            text.append(inflate.decompress(left or stream.read(slice_bytes)))
            left = inflate.unused_data
            if not left and not inflate.eof and stream.tell() >= len(data):
                raise ValueError(f"{path} ends within a record")
        head, _, rest = b"".join(text).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
        kind = fields["WARC-Type"]
        if kind == "warcinfo":
            continue
        body = rest[: int(fields["Content-Length"])]
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        found = base32(sha1(body).digest())
        if found != fields["WARC-Block-Digest"].removeprefix("sha1:") or (kind == "response" and (found != digest or len(body) != size)):
            raise ValueError(f"{path}: {fields['WARC-Record-ID']} does not have its digest")
        page = lambda record_id: record_id[10:-1].split(":")[0]  # noqa: E731  of <urn:page:id:digest>
        name, target = page(fields["WARC-Record-ID"]), fields.get("WARC-Refers-To")
        yield (None if name == "null" else int(name), fields["WARC-Target-URI"], kind, size, digest, None if target is None else int(page(target)), path)


def file_reader(folder: str):
    """The records of the manifest's files, each file held against its records, bytes and sha1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for entry in batch.to_pylist():
                path = entry["path"]
                if store.get_file_info(f"{root}/{path}").type != fs.FileType.File:
                    raise ValueError(f"{path} is in the manifest and missing")
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    data = stream.read()
                if len(data) != entry["bytes"] or sha1(data).hexdigest() != entry["sha1"]:
                    raise ValueError(f"{path} is not the file that the manifest has")
                found, count = parsed(path, data), 0
                while rows := list(islice(found, 10_000)):
                    count += len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                if count != entry["records"]:
                    raise ValueError(f"{path} has {count} records, not {entry['records']}")

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest under folder has; a task holds one file, of about the rolled size."""
    ship_package(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n_files = manifest.count()
    tasks = max(1, min(n_files, 1000 + n_files // 10))
    return manifest.repartition(tasks, "path").mapInArrow(file_reader(f"{folder}/archive"), RECORD)


def op4_warc(spark, sf_dir):
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
