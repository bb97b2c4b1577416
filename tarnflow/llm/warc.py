"""WARC archives whose records are compressed one by one against an embedded Zstandard dictionary.

Each archive file begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary, itself Zstandard-compressed,
built from records of that archive; every record follows as a frame of its own, so that a record can be read alone, by
its offset, with the dictionary at hand.  Payloads that occur more than once are stored once: the record of the smallest
id is a ``response``, the others are ``revisit`` records that refer to it.

Which record comes first is settled by one aggregation over (digest, id), combined before its shuffle; the payloads
move once, to the tasks that write.  A file's name holds a random name of its task's attempt, so attempts never touch each
other's files, however they divide the records; the files that count are those that the written table lists, and a file that
it doesn't list is what a lost attempt left.  A file that is not finished ends in ``.part``.  Files go to any store that
``pyarrow.fs`` opens; the folder must be shared by all executors.

Defined cases.  A null payload is an empty one.  Rows that repeat the response's id and payload are
responses too.  Null ids get records without a target id, after all others of their payload.  Payloads
shorter than ``min_revisit`` bytes are always responses.  An empty table makes no files.  Too few or too uniform
records for a dictionary leave the skippable frame empty, and records are compressed without one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import random
import struct
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import bound_batches

SKIPPABLE_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 1 << 16
#: The dictionary is built from records drawn from the whole archive, up to this much of them, and SAMPLE_RECORD of each; this
#: bounds memory, and has no say in what is archived.
SAMPLE_BYTES, SAMPLE_RECORD = 2 << 20, 128 << 10
ARCHIVE_BYTES = 64 << 20  # payload after which a task begins its next file
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record; a revisit has no payload of its own."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if kind == "revisit" else payload)
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The header fields of a record, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def build_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from records, or nothing if they are too few for one."""
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1 << 12, sum(map(len, samples)) // 10)), samples, k=512, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstd.ZstdError:
        return b""


class ArchiveWriter:
    """Writes one archive to a binary stream.  Records wait in a temporary file, which close() reads, until the dictionary is
    built from a sample of them all."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.payload_bytes = out, level, 0
        self.waiting, self.lengths = tempfile.TemporaryFile(), []
        self.draw, self.drawn, self.drawn_bytes = random.Random(0), [], 0  # drawn: a heap, the greatest lot first

    def write(self, raw: bytes) -> None:
        self.payload_bytes += len(raw)
        self.waiting.write(raw)
        sample = raw[:SAMPLE_RECORD]
        heapq.heappush(self.drawn, (-self.draw.random(), len(self.lengths), sample))
        self.lengths.append(len(raw))
        self.drawn_bytes += len(sample)
        while self.drawn_bytes > SAMPLE_BYTES:
            self.drawn_bytes -= len(heapq.heappop(self.drawn)[2])

    def close(self) -> None:
        dictionary = build_dictionary([sample for _, _, sample in sorted(self.drawn, key=lambda d: d[1])])
        self.drawn = []
        frame = zstd.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(frame)) + frame)
        compressor = zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        with self.waiting:
            self.waiting.seek(0)
            for length in self.lengths:
                self.out.write(compressor.compress(self.waiting.read(length)))


def read_archive(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one after the other, read in pieces of ``chunk`` bytes."""
    head = source.read(8)
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no dictionary frame")
    frame = source.read(size)
    dictionary = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(frame)) if size else None
    decompressor = zstd.ZstdDecompressor(dict_data=dictionary)
    rest = b""
    while rest or (rest := source.read(chunk)):
        one, parts = decompressor.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                break
            if not (rest := source.read(chunk)):
                raise ValueError("the archive ends within a record")
        rest = one.unused_data
        yield b"".join(parts)


def with_targets(pages: DataFrame, id_col: str, payload_col: str, min_revisit: int = 0) -> DataFrame:
    """pages with payload, payload_bytes, digest (hex), and first_id: the id of the response that holds the payload."""
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = pages.withColumns({"__payload": payload, "__digest": F.sha1(payload)})
    firsts = pages.select("__digest", id_col).groupBy("__digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("__copies"))
    return pages.join(firsts.where("__copies > 1").drop("__copies"), "__digest", "left").withColumn("__first", F.when(F.octet_length("__payload") >= min_revisit, F.col("__first")))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes pages to ``*.warc.zst`` files in folder; returns (path, records, bytes) of the files, when run."""
    rows = with_targets(pages, id_col, payload_col, min_revisit).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(uri_col), F.lit("")).alias("uri"), "__payload", "__digest", F.col("__first").cast("string").alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId():06d}-{uuid.uuid4().hex}"
        made, out, writer, n = [], None, None, 0

        def finish():
            writer.close()
            size = out.tell()
            out.close()
            target = f"{stem}-{len(made):04d}.warc.zst"
            fs.move(f"{target}.part", target)
            made.append((target, n, size))

        for batch in batches:
            for page, uri, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{stem}-{len(made):04d}.warc.zst.part", compression=None)
                    writer, n = ArchiveWriter(out), 0
                revisit = first is not None and page != first
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                writer.write(record("revisit" if revisit else "response", "" if page is None else page, uri.replace("\r", "%0D").replace("\n", "%0A"), name, payload, first))
                n += 1
                if writer.payload_bytes >= ARCHIVE_BYTES:
                    finish()
                    out = None
        if out is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"path": [m[0] for m in made], "records": pa.array([m[1] for m in made], pa.int64()), "bytes": pa.array([m[2] for m in made], pa.int64())})

    return rows.mapInArrow(write, "path string, records long, bytes long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of the files listed in ``files`` (column path): type, id, uri, digest, refers_to and payload."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["type", "id", "uri", "digest", "refers_to", "payload_length", "payload"])

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as source:
                    for raw in read_archive(source):
                        f = parse_record(raw)
                        name = lambda x: x and (x.removeprefix("<urn:x-page:").removesuffix(">") or None)
                        length = int(f.get("WARC-Payload-Length", len(f["payload"])))
                        if f["WARC-Type"] == "response" and f["WARC-Payload-Digest"] != f"sha1:{base32_sha1(f['payload'])}":
                            raise ValueError(f"{path}: a payload does not have its digest")
                        rows.append((f["WARC-Type"], name(f["WARC-Record-ID"]), f["WARC-Target-URI"], f["WARC-Payload-Digest"].removeprefix("sha1:"), name(f.get("WARC-Refers-To")), length, f["payload"]))
                        held += len(raw)
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism * 2).mapInArrow(read, "type string, id string, uri string, digest string, refers_to string, payload_length long, payload binary")
