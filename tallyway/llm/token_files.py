"""Token files: zstandard frames that stand alone, a trailing seek table and a checksum per frame.

A file is a valid zstandard stream. Each document is a frame of its token ids; then comes a skippable frame with the
document index, and last the seek table of the public seekable format: for each frame its compressed and plain sizes and
the low 32 bits of the plain bytes' XXH64. A reader opens the end of the file, looks a document up, and reads and
decompresses that frame alone.

Documents are written in ascending doc_id order over all files: Spark ranges and sorts them, each task streams one
range to one file. Names are new for every attempt and only those that a finished task reports count, so a lost
executor leaves at most a file that nobody reads.

Defined results: null text is empty and has only the end id; null doc_ids come first; rows that repeat a doc_id follow
each other by text. No rows make no files. Other columns don't matter.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyway.llm import bpe
from tallyway.llm.tables import cut, shared_path

# Fixed values of the zstandard and seekable formats.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("start", "<u8"), ("size", "<u4")])
LEVEL = 3
#: Bytes of text, and at least of each document, by which the number of files is chosen; a file's index stays small.
FILE_SIZE, LEAST_SIZE = 64 << 20, 64
#: Bytes read at once where a file is read as a whole.
READ_AHEAD = 1 << 20
LISTED = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """Appends documents to an open binary stream; ``close`` adds index and seek table."""

    def __init__(self, out, wide: bool):
        self.out, self.kind = out, "<u4" if wide else "<u2"
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.frames, self.sizes, self.tokens = array("I"), array("I"), 0
        self.ids, self.known = array("q"), array("B")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        plain = ids.astype(self.kind).tobytes()
        frame = self.pack.compress(plain)
        self.out.write(frame)
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.sizes.append(len(ids))
        self.frames.extend((len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.tokens += len(ids)

    def close(self) -> None:
        index = np.zeros(len(self.ids), INDEX)
        size = np.array(self.sizes, np.int64)
        index["doc_id"], index["known"], index["size"] = self.ids, self.known, size
        index["frame"], index["start"] = np.arange(len(index)), np.cumsum(size) - size
        body = bytes([int(self.kind == "<u4")]) + self.pack.compress(index.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.frames.extend((len(body) + 8, 0, 0))
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames) // 3, HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Random access to one token file through an open, seekable stream."""

    def __init__(self, file, size: int):
        self.file = file
        n, flags, magic = struct.unpack("<IBI", self.read(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        length = 12 * n + 9
        head = self.read(size - length - 8, length + 8)
        if struct.unpack("<II", head[:8]) != (SKIPPABLE_SEEK, length):
            raise ValueError("the seek table's frame doesn't fit the file")
        self.frames = np.frombuffer(head, "<u4", 3 * n, 8).reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        body = self.read(int(self.at[n - 1]), int(self.frames[n - 1, 0]))
        if struct.unpack("<II", body[:8]) != (SKIPPABLE_INDEX, len(body) - 8):
            raise ValueError("the document index is missing")
        self.kind = "<u4" if body[8] else "<u2"
        self.unpack = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpack.decompress(body[9:], max_output_size=n * INDEX.itemsize), INDEX)

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if at < 0 or len(data) != size:
            raise ValueError("the file ends early")
        return data

    def ids(self, k: int) -> np.ndarray:
        """Ids of the ``k``-th document; only its frame is read. A frame that fails its checksum is an error."""
        frame = int(self.index["frame"][k])
        return self.opened(frame, self.read(int(self.at[frame]), int(self.frames[frame, 0])))

    def opened(self, frame: int, data: bytes) -> np.ndarray:
        _, plain_size, told = self.frames[frame].tolist()
        plain = self.unpack.decompress(data, max_output_size=max(plain_size, 1))
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != told:
            raise ValueError(f"frame {frame} is damaged")
        return np.frombuffer(plain, self.kind)

    def all(self, stream) -> Iterator[np.ndarray]:
        """Ids of every document, in order, from a stream at the beginning of the file; one read follows the other."""
        for frame in self.index["frame"].tolist():
            size = int(self.frames[frame, 0])
            data = stream.read(size)
            if len(data) != size:
                raise ValueError("the file ends early")
            yield self.opened(frame, data)

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this id; ids ascend, so it is a binary search."""
        known = int((self.index["known"] == 0).sum())
        ids = self.index["doc_id"][known:]
        return list(range(known + int(np.searchsorted(ids, doc_id)), known + int(np.searchsorted(ids, doc_id, "right"))))


def open_reader(uri: str) -> Reader:
    store, path = pafs.FileSystem.from_uri(uri)
    return Reader(store.open_input_file(path), store.get_file_info(path).size)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 0, files: int | None = None) -> DataFrame:
    """Writes token files of ``docs`` (doc_id, text) into ``folder`` (a URI) and returns their list.

    Columns: file, file_no (ascending with doc_id), n_docs, n_tokens, first_token (ids in all files before).
    """
    spark = docs.sparkSession
    if files is None:
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + LEAST_SIZE
        total = docs.agg(F.sum(size).alias("n")).first()["n"] or 0
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE_SIZE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, writer, part = f"tokens-{uuid.uuid4().hex}.zst", None, 0
        wide = bpe.encoder(tokenizer).tokenizer.get_vocab_size() > 1 << 16
        out = None
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id").to_pylist()
            if ids and writer is None:
                out, part = store.open_output_stream(f"{base}/{name}", compression=None), batch.column("part")[0].as_py()
                writer = Writer(out, wide)
            for doc_id, row in zip(ids, bpe.encoded(texts, tokenizer, end), strict=True):
                writer.add(doc_id, row)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "part": part, "n_docs": len(writer.sizes), "n_tokens": writer.tokens}], LISTED)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ranged = keyed.repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    made = cut(ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "file string, part int, n_docs long, n_tokens long"))
    # One row per file, so a window over all of them is small.
    order = Window.orderBy("part")
    return made.select(
        "file", (F.row_number().over(order) - 1).alias("file_no"), "n_docs", "n_tokens",
        (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("first_token"),
    )


def read(files: DataFrame) -> DataFrame:
    """Every document in the listed files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = open_reader(row["file"])
                index = reader.index
                store, path = pafs.FileSystem.from_uri(row["file"])
                with store.open_input_stream(path, compression=None, buffer_size=READ_AHEAD) as stream:
                    crcs = np.fromiter(map(bpe.crc, reader.all(stream)), np.int64, len(index))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(index["doc_id"].astype(np.int64), mask=index["known"] == 0),
                        pa.array(index["start"].astype(np.int64) + row["first_token"]),
                        pa.array(index["size"].astype(np.int64)),
                        pa.array(crcs),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "first_token").repartition(n, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of the ``wanted`` (doc_id) documents: doc_id, ids. Each file is opened once and only those frames are read."""
    asked = wanted.filter("doc_id IS NOT NULL").select("doc_id").distinct()

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                ids = np.unique(open_reader(file).index["doc_id"])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ids)), pa.array(ids.astype(np.int64))], ["file", "doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, reader = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["file"] != file:
                    file, reader = row["file"], open_reader(row["file"])
                rows += [{"doc_id": row["doc_id"], "ids": reader.ids(k).astype(np.int64).tolist()} for k in reader.find(row["doc_id"])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    places = files.select("file").mapInArrow(bounds, "file string, doc_id long").join(asked, "doc_id")
    return places.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "doc_id").mapInArrow(run, "doc_id long, ids array<long>")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` into a new shared folder and reads every document back from the files."""
    return read(cut(write(docs, shared_path(spark, "tokens"), tokenizer)))
