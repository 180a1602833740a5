"""WARC archives compressed record by record with an embedded Zstandard dictionary.

Writer: a task writes archives of at most ARCHIVE payload bytes one after the other. An archive's dictionary is
built from its first TRAIN bytes of records, stands in a skippable frame at the archive's start, and every record
is a frame of its own, so a reader can start at any record's offset once it has the dictionary; records after the
first TRAIN bytes go straight to the file. Of pages with equal payloads of at least REVISIT bytes, that of the
smallest id is a response and the others are revisits that refer to it.

Archives go to the folder that executors share (``spark.checkpoint.dir``), under a name of their own for
every attempt; the manifest that the writer returns lists the archives of the attempts that succeeded, and
the reader reads those alone.

Edge cases: a null html is an empty payload; null urls become the empty URI; payloads below REVISIT bytes are
all responses; rows that repeat the smallest id of their payload are all responses; a null id comes after all
others (with null ids alone, all are responses); a very long page is one record, held in memory; an empty
table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_path

REVISIT = 100
#: Bytes of records that an archive holds, and those that a writer gathers for the dictionary, the most it holds, but for one page.
ARCHIVE, TRAIN = 512 << 20, 8 << 20
#: Digests of at least this share of all pages, of which there are 1/HOT at most, are looked up apart.
HOT = 1e-3
DICTIONARY = 64 << 10
#: Bytes of each record, evenly spread slices of it, from which the dictionary is built.
SAMPLE = 4096
# Magic numbers of the dictionary's skippable frame and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, bytes, first, is_response): the role of each page's record."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    keys = src.where(F.col("bytes") >= REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = materialize(keys.where("n > 1"), "repeated")
    # Payloads that many pages share go to all executors, 1/HOT rows at most; their pages aren't moved by digest.
    many = F.lit(max(2.0, HOT * pages.count()))
    hot = F.broadcast(again.where(F.col("n") >= many).select("digest", F.col("first").alias("hot"), F.lit(True).alias("is_hot")))
    src = src.join(hot, "digest", "left").withColumn("key", F.when(F.col("is_hot"), F.concat("digest", F.coalesce(F.col("page_id").cast("string"), F.col("url")))).otherwise(F.col("digest")))
    cold = again.where(F.col("n") < many).select(F.col("digest").alias("key"), F.col("first").alias("cold"))
    src = src.join(cold, "key", "left").withColumn("first", F.coalesce("cold", "hot")).drop("key", "cold", "hot", "is_hot")
    return src.withColumn("is_response", F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")))


def record(page_id: int | None, url: str, html: str, digest: str, size: int, first: int | None, response: bool) -> bytes:
    """One record: header block and content block."""
    payload = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if not response else b"Content-Length: %d\r\n" % size) + b"\r\n"
    block = http + (payload if response else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if not response:
        head += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from slices of the records; where they are too few or too small to train one, the slices themselves."""
    samples = []
    for r in records:
        step = max(512, len(r) * 512 // SAMPLE)
        samples += [r[i : i + 512] for i in range(0, len(r), step)]
    size = sum(map(len, samples))
    if len(samples) >= 8 and size >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, max(1024, size // 8)), samples, k=64, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """An archive being written: its dictionary first, then a frame for every record."""

    def __init__(self, path: str, records: list[bytes]) -> None:
        fs, at = pafs.FileSystem.from_uri(path)
        own = train(records)
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=True)
        self.file = fs.open_output_stream(at, compression=None)
        head = own.as_bytes()
        self.file.write(struct.pack("<II", SKIPPABLE, len(head)) + head)
        self.path, self.records, self.size, self.bytes = path, 0, 0, 8 + len(head)
        for r in records:
            self.add(r)

    def add(self, data: bytes) -> None:
        z = self.packer.compress(data)
        self.file.write(z)
        self.records, self.size, self.bytes = self.records + 1, self.size + len(data), self.bytes + len(z)

    def close(self) -> pa.RecordBatch:
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path]), pa.array([self.records], pa.int64()), pa.array([self.bytes], pa.int64())], names=["path", "records", "bytes"])


def write(planned: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the archives and returns the manifest (path, records, bytes), which is kept in the shared folder."""
    where = folder or shared_path(planned.sparkSession, "warc")
    cols = ["page_id", "url", "html", "digest", "bytes", "first", "is_response"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(where)
        fs.create_dir(at, recursive=True)
        held: list[bytes] = []
        size, now = 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() if i != 2 else c for i, c in enumerate(b.columns))):
                r = record(row[0], row[1], row[2].as_py(), *row[3:])
                if now is None:
                    held.append(r)
                    size += len(r)
                    if size >= TRAIN:
                        now, held, size = Archive(f"{where}/{uuid.uuid4().hex}.warc.zst", held), [], 0
                else:
                    now.add(r)
                if now is not None and now.size >= ARCHIVE:
                    yield now.close()
                    now = None
        if held:
            now = Archive(f"{where}/{uuid.uuid4().hex}.warc.zst", held)
        if now is not None:
            yield now.close()

    return materialize(planned.select(*cols).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def frames(f) -> Iterator[bytes]:
    """The frames of a stream after its skippable dictionary, decompressed one by one."""
    head = f.read(8)
    own = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        own = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", head[4:])[0]))
        head = b""
    unpacker = zstandard.ZstdDecompressor(dict_data=own) if own else zstandard.ZstdDecompressor()
    left, one, parts = head, None, []
    while True:
        if not left:
            left = f.read(1 << 18)
            if not left:
                break
        if one is None:
            one, parts = unpacker.decompressobj(), []
        parts.append(one.decompress(left))
        left = one.unused_data if one.eof else b""
        if one.eof:
            yield b"".join(parts)
            one = None
    if one is not None:
        raise ValueError("the archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and content block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(fields["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def read(manifest: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload): every record of the archives.

    A response's length and digest are computed from what was read, and must equal its header fields; a
    revisit's come from its header, its payload is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda s: int(s[10:-1]) if s[10:-1] else None
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(at, compression=None) as f:
                    for data in frames(f):
                        fields, block = parse(data)
                        kind, digest, n, body = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2], int(fields["warc-payload-length"]), None
                        if kind == "response":
                            body = block.partition(b"\r\n\r\n")[2]
                            if len(body) != n or hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"payload of {fields['warc-record-id']} in {path} differs from its digest")
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], kind, number(fields["warc-refers-to"]) if kind == "revisit" else None, n, digest, body))
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    # An archive is a task's work; they are dealt out one by one.
    paths = manifest.select("path").repartition(max(1, manifest.count()))
    return paths.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, from the archives read back."""
    return read(write(plan(pages))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
