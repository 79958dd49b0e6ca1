"""A deterministic sharded WARC writer and its reader.

1. A narrow table holds each record's key, payload digest and size. Among equal payloads of at least ``MIN_BYTES`` bytes
   the record with the smallest key is the response; the others revisit it. Digests are grouped with partial
   aggregation. A payload that more than one in ``HOT`` records share is joined back by a table of at most ``HOT`` rows
   that all tasks get, so its copies never meet in one task; the others are joined by an exchange.
2. Records are dealt to ranges of the key by a histogram sort (exact byte counts), one exchange, and sorted. A range
   holds about ``RANGE_BYTES`` of payload, several files.
3. Each range writes its files in turn: every record is a gzip member of its own with headers made anew (the record id
   follows from key, payload and copy, block and payload digests from the bytes; the date is a parameter, so that the
   same rows give the same bytes), and a file is closed once it holds ``roll_bytes`` compressed bytes. Memory holds a
   record and its compressed form.
4. A file is written under a temporary name and renamed when whole. The manifest of files, renamed last, commits the
   archive; readers take only what it names. A task that runs again writes the same bytes under the same names.

Defined cases: a null payload is empty; a null key sorts first and is never chosen as the response over another; of rows with equal key and
payload the first is the response and the rest revisit it; a payload of any length is one record; other columns are
ignored; an empty table gives an empty archive. A null url is left out of the record.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import HOT, discard, documents, file_system, join_frequent, materialise, rename, shared_folder
from spreadloom.llm.sharding import KEY, deal, keyed, plan
from spreadloom.llm.tokens import small_batches

MIN_BYTES = 100
#: Compressed bytes of a file, and payload bytes of a range, which compress to some four files.
ROLL_BYTES, RANGE_BYTES = 16 << 20, 128 << 20
#: The format's version line and the profile of a revisit.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
RECORDS = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
MANIFEST = "part int, number int, name string, records long, bytes long, sha256 string"
FIELDS = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def record_id(key: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{key}:{digest}:{copy}')}>"


def address(url: str | None) -> str | None:
    return url and "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def record(key: int | None, url: str | None, payload: bytes, digest: str, copy: int, original: int | None, original_url: str | None, revisit: bool, date: str = DATE) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(key, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", address(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Refers-To", record_id(original, digest, 0) if revisit else None),
        ("WARC-Refers-To-Target-URI", address(original_url) if revisit else None),
        ("WARC-Refers-To-Date", date if revisit else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("X-Key", key),
        ("X-Refers-To-Key", original if revisit else None),
        ("X-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time or name, so equal data give equal bytes."""
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


class Archive:
    """The files of one range. ``rows`` gets a row for each whole file."""

    def __init__(self, folder: str, part: int, roll_bytes: int):
        self.fs, self.base = file_system(folder)
        self.part, self.roll, self.number, self.rows, self.sink = part, roll_bytes, 0, [], None

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.named, self.bytes, self.records, self.sum = f"{self.base}/_{uuid.uuid4().hex}", 0, 0, hashlib.sha256()
            self.sink = self.fs.open_output_stream(self.named, compression=None)
        self.sink.write(data)
        self.sum.update(data)
        self.bytes += len(data)
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        name = f"records-{self.part:06d}-{self.number:05d}.warc.gz"
        self.fs.move(self.named, f"{self.base}/{name}")
        self.rows.append({"part": self.part, "number": self.number, "name": name, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()})
        self.number, self.sink = self.number + 1, None


def markers(digests: DataFrame) -> DataFrame:
    """(key columns, digest, original, original_url), once for each key and payload of the records that have equals.

    ``digests`` is a written table (_key, _mixed, _row, url, digest).
    """
    first = F.min(F.when(F.col("_key").isNotNull(), F.struct("_key", "_row", "url")))
    shared = digests.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = materialise(shared.select("digest", F.col("first._key").alias("original"), F.col("first.url").alias("original_url"), "n"), "shared")
    return join_frequent(digests.select("_key", "_mixed", "digest"), shared, ["digest"], digests.count() // HOT).distinct()


def write(df: DataFrame, key: str, url: str, payload: str, min_bytes: int = MIN_BYTES, roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES, date: str = DATE) -> str:
    """Write an archive of all rows; returns the committed folder."""
    spark = df.sparkSession
    folder = shared_folder(spark, "warc")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("body"))
    size = F.octet_length("body")
    records, found = keyed(rows, "key", F.col("body"), size + 1), plan(rows, "key", F.col("body"), size + 1, part_bytes=range_bytes)
    digests = materialise(records.where(size >= min_bytes).select("_key", "_mixed", "_row", "url", F.sha2("body", 256).alias("digest")), "digests")
    none = F.lit(None).cast("string")
    # a marker goes before each record that has equals and says which it goes back to
    marks = markers(digests).select(F.col("_key").alias("key"), none.alias("url"), none.alias("body"), "_key", "_mixed", F.lit(-(1 << 63)).alias("_row"), F.lit(0).cast("long").alias("_size"), "digest", "original", "original_url")
    both = records.withColumns({"digest": none, "original": F.lit(None).cast("long"), "original_url": none}).unionByName(marks)
    # ranges begin before the marker of their first record
    found.keys = found.keys.astype("S17").astype(KEY)
    names = ["part", "key", "url", "body", "digest", "original", "original_url"]
    dealt = deal(both, found).select(names)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, marker, last, copy = None, None, None, 0
        for batch in small_batches(batches, "body"):
            for part, k, u, text, noted, original, first_url in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if text is None:
                    marker = (k, noted, original, first_url)
                    continue
                data = text.encode()
                digest = hashlib.sha256(data).hexdigest()
                copy = copy + 1 if last == (k, digest) else 0
                last = (k, digest)
                archive = archive or Archive(folder, part, roll_bytes)
                marked = marker is not None and marker[:2] == (k, digest)
                first, home = marker[2:] if marked else (None, None)
                archive.add(member(record(k, u, data, digest, copy, first, home, marked and (k != first or copy > 0), date)))
        if archive:
            archive.close()
            yield pa.RecordBatch.from_pylist(archive.rows, FIELDS)

    dealt.mapInArrow(store, MANIFEST).write.parquet(f"{folder}/_manifest")
    rename(spark, f"{folder}/_manifest", f"{folder}/manifest")
    discard(digests)
    return folder


def members(source) -> Iterator[bytes]:
    """The records of a file, one in memory at a time."""
    data, unpack, out = b"", zlib.decompressobj(31), []
    while True:
        if not data and not (data := source.read(1 << 20)):
            break
        out.append(unpack.decompress(data))
        data = b""
        if unpack.eof:
            yield b"".join(out)
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
    if out:
        raise ValueError("a record is cut off")


def parsed(data: bytes) -> dict:
    """Header fields in lower case, and the block; digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["warc-payload-digest"] != f"sha256:{hashlib.sha256(payload).hexdigest()}":
            raise ValueError(f"damaged payload {fields.get('warc-record-id')}")
    return fields


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each record of a committed archive, from the files that its manifest names."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                out: list[tuple] = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for data in members(source):
                        f = parsed(data)
                        whole = lambda x: None if x is None else int(x)
                        out.append((whole(f.get("x-key")), f.get("warc-target-uri"), int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"], whole(f.get("x-refers-to-key"))))
                        if len(out) == 10_000:
                            yield batch_of(out)
                            out = []
                yield batch_of(out)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("part", "number", "name")
    parts = (files.agg(F.max("part")).first()[0] or 0) + 1
    return files.repartitionById(parts, "part").mapInArrow(scan, RECORDS)


def batch_of(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write(documents(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_BYTES} AND page_id <> first THEN first END AS refers_to
FROM f
"""
