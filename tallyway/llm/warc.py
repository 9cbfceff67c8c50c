"""WARC archives with a record per zstandard frame and a shared dictionary in front.

Layout of a file: a skippable frame with the dictionary (itself a zstandard frame or plain), then one frame per record,
compressed with it. Each frame can be read alone by a reader that has the dictionary.

Pages with equal payloads are stored once: the largest page_id keeps the response record, the others become revisit
records without payload that refer to it. Payload digests are aggregated narrow, without the pages, and only the
list of revisits is joined to them.

Defined results: a null html is an empty payload; a null url is written as the page's own urn. Of pages without an id
and with equal payloads, each stays a response unless some page with an id has that payload. Rows that repeat both
id and payload get the same record. No rows make no files. Other columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyway.llm.tables import cut, shared_path, small

# Fixed values of the formats.
DICTIONARY_FRAME, SKIPPABLE = 0x184D2A5D, 0x184D2A50
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REPEATING = ("warc-concurrent-to",)
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

DATE = "2024-01-01T00:00:00Z"
#: Records from which a file's dictionary is trained, their bytes at most, and its size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 200, 4_000_000, 16_384
CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}')}>"


def spelled(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response, or a revisit if it refers to another page."""
    name, target = digest(payload), url or f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, name)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{name}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        lines.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, name)), ("X-Refers-To-Page-Id", str(refers_to))]
    lines.append(("Content-Length", str(len(block))))
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


class Writer:
    """Writes records to a binary stream; the first ones wait until a dictionary is trained on them."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.pack = out, [], 0, None
        self.records = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.pack is not None:
            self.out.write(self.pack.compress(record))
            return
        self.waiting.append(record)
        self.held += len(record)
        if len(self.waiting) >= SAMPLE or self.held >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        dictionary = None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting)
        except zstandard.ZstdError:
            pass  # too few or too small records: the file has no dictionary
        if dictionary is not None:
            body = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
        self.pack = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self.out.write(self.pack.compress(record))
        self.waiting = []

    def close(self) -> None:
        if self.pack is None:
            self.start()


def parsed_headers(head: bytes, may_repeat: Callable[[str], bool]) -> dict[str, str]:
    """Headers by name in lower case, the first where one may repeat. Repeating any other is an error, as it leaves open which holds."""
    found: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header line: {line[:80]!r}")
        key = name.decode("ascii").lower()
        if key in found and not may_repeat(key):
            raise ValueError(f"repeated header: {key}")
        found.setdefault(key, value.strip().decode())
    return found


def parsed(frame: bytes) -> Record:
    """The record in one frame; an error tells what in its headers or lengths is wrong."""
    version, _, rest = frame.partition(b"\r\n")
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head, end, rest = rest.partition(b"\r\n\r\n")
    if not end:
        raise ValueError("the headers don't end")
    headers = parsed_headers(head, lambda name: name in REPEATING)
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"missing headers: {missing}")
    told = headers["content-length"]
    if not told.isdigit() or len(rest) != int(told) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {told} doesn't fit {len(rest) - 4} bytes and the record's end")
    record = Record(headers, rest[:-4])
    if headers.get("warc-block-digest", f"sha1:{digest(record.block)}") != f"sha1:{digest(record.block)}":
        raise ValueError("the block doesn't fit its digest")
    if headers.get("content-type", "").startswith("application/http"):
        status, _, http = record.block.partition(b"\r\n")
        if not status.startswith(b"HTTP/"):
            raise ValueError("no status line")
        http_head, _, record.payload = http.partition(b"\r\n\r\n")
        record.http = parsed_headers(http_head, lambda name: name not in ("content-length", "content-type"))
        if headers["warc-type"] == "response":
            if record.http.get("content-length", str(len(record.payload))) != str(len(record.payload)):
                raise ValueError("the payload doesn't fit its Content-Length")
            if headers.get("warc-payload-digest", f"sha1:{digest(record.payload)}") != f"sha1:{digest(record.payload)}":
                raise ValueError("the payload doesn't fit its digest")
    return record


def records(file) -> Iterator[Record]:
    """Records of an open archive, one frame at a time; skippable frames between them, such as seek tables, are passed over."""
    head = file.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        size = struct.unpack("<I", head[4:])[0]
        body = file.read(size)
        if len(body) != size:
            raise ValueError("the dictionary ends early")
        if body[:4] == ZSTD_MAGIC:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, head = zstandard.ZstdCompressionDict(body), b""
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
    data, at = head, None
    while data or (data := file.read(CHUNK)):
        while len(data) < 8 and (more := file.read(CHUNK)):
            data += more
        if len(data) >= 8 and SKIPPABLE <= struct.unpack("<I", data[:4])[0] < SKIPPABLE + 16:
            left = 8 + struct.unpack("<I", data[4:8])[0]
            while left > len(data):
                left -= len(data)
                if not (data := file.read(CHUNK)):
                    raise ValueError("a skippable frame ends early")
            data = data[left:]
            continue
        at, parts = unpack.decompressobj(), []
        while True:
            parts.append(at.decompress(data))
            if at.eof:
                data = at.unused_data
                break
            if not (data := file.read(CHUNK)):
                raise ValueError("the last frame ends early")
        yield parsed(b"".join(parts))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, html) into ``folder`` (a URI); returns file and n_records.

    Equal payloads of ``least`` bytes or more are stored once.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.select("page_id", F.sha1(body).alias("sha1"), F.length(body).alias("size")).filter(F.col("size") >= least)
    first = cut(keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND refers_to IS NOT NULL"))
    same = keys.join(small(first.select("sha1", "refers_to")), "sha1").filter("page_id IS NULL OR page_id < refers_to")
    revisits = cut(same.select(F.col("page_id").alias("r_page_id"), F.col("sha1").alias("r_sha1"), "refers_to").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, writer = f"pages-{uuid.uuid4().hex}.warc.zst", None, None
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer = Writer(out)
                writer.add(spelled(row["page_id"], row["url"], row["body"], row["refers_to"]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "n_records": writer.records}])

    keyed = pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("sha1"))
    named = keyed.join(small(revisits), F.col("page_id").eqNullSafe(F.col("r_page_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    return cut(named.select("page_id", "url", "body", "refers_to").mapInArrow(run, "file string, n_records long"))


READ = pa.schema(
    [("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_digest", pa.string()),
     ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("refers_to", pa.int64())]
)


def read(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives, validated; a bad record is an error. Payloads only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in records(stream):
                        number = lambda h, r=r: int(r.headers[h]) if h in r.headers else None
                        rows.append({
                            "page_id": number("x-page-id"), "record_id": r.headers["warc-record-id"], "record_type": r.headers["warc-type"],
                            "url": r.headers.get("warc-target-uri"), "payload_digest": r.headers["warc-payload-digest"].removeprefix("sha1:"),
                            "payload_bytes": int(r.http["content-length"]), "payload": r.payload if payloads else None, "refers_to": number("x-refers-to-page-id"),
                        })
                        held += len(r.payload) if payloads else 200
                        if held > 8 * CHUNK or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, READ)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, READ)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, record_id string, record_type string, url string, payload_digest string, payload_bytes long, payload binary, refers_to long"
    return files.select("file").repartition(n, "file").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into a new shared folder and reads every record back: what each says of its page."""
    files = write(pages, shared_path(spark, "warc"))
    return read(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
