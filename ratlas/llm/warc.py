"""WARC archives: writing one gzip member per record, and a sequential reader that checks what it reads."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratlas.llm.common import Scratch, slices

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload-length and page fields are extensions; readers skip fields they don't know.
PAGE_FIELD, LENGTH_FIELD, REFERS_FIELD = "X-Page-Id", "X-Payload-Length", "X-Refers-To-Page-Id"
#: Bytes of compressed input that the reader asks for at once.
CHUNK = 1 << 16
MAX_HEADER = 1 << 20


class WarcError(ValueError):
    """A record that breaks the framing or doesn't match its digest."""


def digest(data: bytes) -> str:
    """Bare base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object, url: str | None, payload_digest: str) -> str:
    """A record's name, the same whenever and wherever it is written."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}:{url}').urn}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id: object, url: str | None, payload: bytes, payload_digest: str, refers_to: object = None, refers_url: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member: a response with its payload, or a revisit with the response's headers alone, which names
    the response (its page and url are given) by its record, address and date."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, url, payload_digest)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        fields.append(("WARC-Target-URI", _uri(url)))
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), (LENGTH_FIELD, str(len(payload)))]
    if page_id is not None:
        fields.append((PAGE_FIELD, str(page_id)))
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url, payload_digest)), ("WARC-Refers-To-Date", date), (REFERS_FIELD, str(refers_to))]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", _uri(refers_url)))
    fields.append(("Content-Length", str(len(block))))
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head + block + b"\r\n\r\n") + pack.flush()


def members(source: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as its decompressed pieces; a member must be used up before the next."""
    rest = b""
    while True:
        rest = rest or source.read(CHUNK)
        if not rest:
            return
        tool = zlib.decompressobj(31)

        def pieces(tool=tool) -> Iterator[bytes]:
            nonlocal rest
            while not tool.eof:
                rest = tool.unconsumed_tail or rest or source.read(CHUNK)
                if not rest:
                    raise WarcError("a gzip member ends too soon")
                got = tool.decompress(rest, CHUNK)
                rest = b""
                if got:
                    yield got
            rest = tool.unused_data

        yield pieces()


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive in order: fields by lower-case name, and the payload (of a revisit: empty).

    Pieces are joined only up to the length that the record declares. Raises WarcError if a version line, a length or
    a digest is wrong.
    """
    for member in members(source):
        held = bytearray()
        end = -1
        for piece in member:
            held += piece
            if (end := held.find(b"\r\n\r\n")) >= 0:
                break
            if len(held) > MAX_HEADER:
                raise WarcError("no end of header")
        lines = bytes(held[: max(end, 0)]).decode("utf-8", "surrogatepass").split("\r\n")
        if end < 0 or lines[0].encode() != VERSION:
            raise WarcError("no version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            raise WarcError("no content length") from None
        del held[: end + 4]
        for piece in member:
            held += piece
            if len(held) > length + 4:
                break
        if len(held) != length + 4 or held[length:] != b"\r\n\r\n":
            raise WarcError(f"{fields.get('warc-record-id')}: the block isn't as long as declared")
        block = bytes(held[:length])
        if fields.get("warc-block-digest", "sha1:").removeprefix("sha1:") not in ("", digest(block)):
            raise WarcError(f"{fields.get('warc-record-id')}: wrong block digest")
        payload = block.partition(b"\r\n\r\n")[2]
        if fields.get("warc-type") == "response" and fields.get("warc-payload-digest", "sha1:").removeprefix("sha1:") not in ("", digest(payload)):
            raise WarcError(f"{fields.get('warc-record-id')}: wrong payload digest")
        yield fields, b"" if fields.get("warc-type") == "revisit" else payload


def _open(uri: str):
    """A file system and a path in it, for any address that Arrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        out, path, size, n = None, "", 0, 0
        done: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out
            if out:
                out.close()
                done.append((f"{folder}/{path}", size, n))
                out = None

        for batch in slices(batches, "html"):
            for row in batch.to_pylist():
                # a task that is tried again writes other names; only names that reach the manifest are read
                if out is None:
                    path, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}", compression=None)
                payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                own = digest(payload)
                again = row["keeper"] is not None and row["keeper"] != row["page_id"]
                data = record("revisit" if again else "response", row["page_id"], row["url"], payload, own, row["keeper"] if again else None, row["keeper_url"] if again else None)
                out.write(data)
                size += len(data)
                n += 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write a record for each page below folder; returns the manifest: path, bytes, records of each archive.

    The payload is html in UTF-8 (null: empty). Of pages with equal payloads of at least least_bytes bytes, that with
    the largest page_id is a response and the others revisit it; a row without page_id, or repeating the largest, is a
    response. Payloads are compared by SHA-1 and length, counted before the shuffle, and only payloads that occur twice
    come back to the pages, so a payload in a third of all pages meets in no single task. Archives are rolled at
    roll_bytes. The manifest is itself a table in the folder: it names the archives of the attempts that succeeded.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("__sha"), F.octet_length(payload).alias("__len"))
    twice = keyed.where(F.col("__len") >= least_bytes).groupBy("__sha", "__len").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("__k"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    rows = keyed.join(twice, ["__sha", "__len"], "left").select("page_id", "url", "html", F.when(F.col("page_id").isNotNull(), F.col("__k.page_id")).alias("keeper"), F.col("__k.url").alias("keeper_url"))
    manifest = rows.mapInArrow(_write(f"{folder}/archives", roll_bytes), "path string, bytes bigint, records bigint")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/archives")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _read(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * keep_payload]
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string()] + [pa.binary()] * keep_payload

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for uri, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, path = _open(uri)
                rows, held, n = [], 0, 0
                with store.open_input_stream(path, compression=None) as source:
                    for f, payload in read_records(source):
                        n += 1
                        again = f["warc-type"] == "revisit"
                        length = int(f[LENGTH_FIELD.lower()]) if again else len(payload)
                        told = f["warc-payload-digest"].removeprefix("sha1:")
                        rows.append((f.get(PAGE_FIELD.lower()), f.get("warc-target-uri"), f["warc-type"], f.get(REFERS_FIELD.lower()), length, told, *[payload] * keep_payload))
                        held += len(payload)
                        if len(rows) >= 5000 or keep_payload and held > 4 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{uri}: {n} records, the manifest has {records}")
                if rows:
                    yield table(rows)

    return run


def read_archives(manifest: DataFrame, payload: bool = True, kind: str = "bigint") -> DataFrame:
    """Per record of the archives in a manifest: page_id, url, record_type, refers_to, payload_bytes, payload_digest and
    the payload (of revisits: empty). Each archive is read by one task, in pieces; digests and counts are verified."""
    spread = manifest.select("path", "records").repartition(max(1, spark_tasks(manifest.sparkSession)), "path")
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * payload
    df = spread.mapInArrow(_read(payload), schema)
    return df.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def spark_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def archive_table(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages' archives to the shared folder and read every record back, without payloads."""
    folder = Scratch(pages.sparkSession, "warc").path
    return read_archives(write_archives(pages, folder, least_bytes), payload=False, kind=dict(pages.dtypes)["page_id"])
