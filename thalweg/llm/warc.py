"""A deterministic sharded WARC writer, and a reader.

Records are sorted by page_id over ranges that exact histograms cut, so a rerun gives the same shards; each shard is a
task, and rolls to a new file by compressed size (FILE_BYTES). Headers are made anew for each record: ids from a digest of
the record, payload and block digests, lengths, a date that is a parameter. Each record is a gzip member of its own. Files
are written under temporary names and count from the moment the manifest, renamed last, names them.

Of records with equal payloads of 100 bytes or more, that of the smallest page_id is the response and the others revisit
it, without the payload. Cases: a null html is an empty payload; a null url is read back as null, and one that doesn't fit
a header line as it was; a null page_id has no id in its header, sorts first and is never referred to (if no other row has
the payload, all are responses); of rows that agree in page_id and payload, and hold the smallest page_id, each is a
response; an empty table gives no file; more columns are left out. A single page_id that holds more than a shard is dealt
over several by payload and url, so only rows that are equal in all three stay together.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, file_system, key_ranges, slices
from .shards import ShardFile, commit

DATE, LEAST, LEVEL = "2020-01-01T00:00:00Z", 100, 3
#: Compressed bytes after which a file ends, and payload bytes of a task. Larger ones make fewer files of a larger archive.
FILE_BYTES, SHARD_BYTES = 4 << 20, 32 << 20
#: Rows that a worker takes from a batch together.
SLICE = 200
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the registered name space of URLs
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _one_line(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "") or "urn:none"


def _url_lines(url: str | None) -> list[str]:
    """The target, and what it takes to read the url back where it is null or has characters that a line can't hold."""
    line = _one_line(url)
    if url is None:
        return [f"WARC-Target-URI: {line}", "X-Target-Null: true"]
    exact = [] if line == url else ["X-Target-Base64: " + base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()]
    return [f"WARC-Target-URI: {line}", *exact]


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, html: bytes | None, size: int, digest: str, refers: int | None, date: str = DATE) -> bytes:
    """A record as a gzip member. refers: the page that holds the payload; then html isn't needed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + html if refers is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}", *_url_lines(url)]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if refers is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Page-ID: {refers}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """A record without its gzip member. Raises where lengths or digests don't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
    url = None if "X-Target-Null" in fields else fields["WARC-Target-URI"]
    if "X-Target-Base64" in fields:
        url = base64.b64decode(fields["X-Target-Base64"]).decode("utf-8", "surrogatepass")
    return {"page_id": page and int(page), "url": url, "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers and int(refers), "payload": payload if fields["WARC-Type"] == "response" else None}


def _members(stream) -> Iterator[bytes]:
    z, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(out)
                z, out = zlib.decompressobj(31), []
            else:
                break
    if out and any(out):
        raise ValueError("truncated archive")


def write(spark: SparkSession, pages: DataFrame, root: str, date: str = DATE, file_bytes: int = FILE_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """pages: page_id, url, html. Writes the archives under root and returns the manifest: name, shard, records, bytes."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    ranges = key_ranges(Scratch(spark, "warc"), rows, "page_id", F.octet_length("html") + 200, shard_bytes)
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    large = rows.where(F.col("size") >= LEAST).groupBy(F.col("digest").alias("d"))
    first = large.agg(F.min("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).where("n > 1 and holder is not null").select("d", "holder")
    # Payloads are shuffled once. What a page revisits comes beside it, as a row that sorts before the page's own.
    small = rows.select("page_id", "digest", "url").join(first, F.col("digest") == F.col("d")).where(~F.col("holder").eqNullSafe(F.col("page_id")))
    notes = small.select("page_id", "url", "digest", F.lit(0).cast("long").alias("size"), F.lit(None).cast("binary").alias("html"), F.col("holder").alias("refers")).distinct()
    both = rows.select("page_id", "url", "digest", "size", "html", F.lit(None).cast("long").alias("refers")).unionByName(notes)
    both = both.withColumn("shard", ranges.shard(F.col("page_id"), F.xxhash64("digest", "url")))
    order = ["page_id", "digest", "url", F.col("refers").asc_nulls_last()]
    dealt = both.repartitionById(ranges.shards, "shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: ShardFile | None = None
        number, records, shard, note = 0, 0, 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if out:
                out.close()
                yield pa.RecordBatch.from_pylist([{"temporary": out.temporary, "name": out.name, "shard": shard, "records": records, "bytes": out.size}], schema)

        for b in slices(batches, SLICE):
            for shard, page, url, html, size, digest, refers in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "html", "size", "digest", "refers")), strict=True):
                if refers is not None:
                    note = (page, url, digest), refers
                    continue
                if not out or out.size >= file_bytes:
                    yield from done()
                    number, records = number + 1 if out else 0, 0
                    out = ShardFile(root, f"part-{shard:08d}-{number:05d}.warc.gz")
                refers = note[1] if note and note[0] == (page, url, digest) else None
                out.write(record(page, url, html, size, digest, refers, date))
                records += 1
        yield from done()

    schema = pa.schema([("temporary", pa.string()), ("name", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64())])
    return commit(root, dealt.mapInArrow(run, "temporary string, name string, shard int, records long, bytes long"))


def read(spark: SparkSession, root: str, listed: DataFrame, payloads: bool = True) -> DataFrame:
    """listed: the manifest. page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if `payloads`, of
    every record in the archives, a task for each file. Lengths and digests are checked in any case."""
    more = [("payload", pa.binary())] if payloads else []
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        for b in batches:
            for name in b.column("name").to_pylist():
                with fs.open_input_stream(f"{top}/{name}", compression=None) as f:
                    held, size = [], 0
                    for data in _members(f):
                        held.append(parse(data) if payloads else {k: v for k, v in parse(data).items() if k != "payload"})
                        size += len(data) if payloads else 1000
                        if size > 1 << 23:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    tasks = max(1, listed.count())
    return listed.select("name").repartition(tasks).mapInArrow(run, f"page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long{', payload binary' if payloads else ''}")


def archive(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes the archives into the shared folder and reads them back."""
    root = Scratch(spark, "warc").path("archives")
    return read(spark, root, write(spark, pages, root), payloads)
