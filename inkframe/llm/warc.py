"""WARC archives of one Zstandard frame a record, their dictionary in a leading skippable frame, and their reader."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, slices, stored

#: Fixed value: magic number of the skippable frame that holds a dictionary. The frame's content is the dictionary itself,
#: or a Zstandard frame of it.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
#: Bytes of payload from which a dictionary is trained, its largest size, level, and least payload that is revisited.
SAMPLE, DICTIONARY, LEVEL, LEAST = 1 << 20, 1 << 15, 3, 100
#: Payload bytes after which the next archive begins, and bytes read at a time.
ARCHIVE, CHUNK = 1 << 28, 1 << 20
MANIFEST = "file string, records long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block, but the length and digest of the full payload."""
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers (lower-case names) and block of a record; refuses what isn't one whole record of the stated length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"a header without a colon: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in headers:
            raise ValueError(f"a record without {name}")
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, {n} are stated")
    return {"headers": headers, "block": rest[:n]}


def dictionary_of(sample: list[bytes]) -> bytes:
    """A dictionary trained on the first payloads of an archive; empty if they are too few to train one."""
    if len(sample) < 16 or sum(map(len, sample)) < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes one archive. The first records wait until `SAMPLE` bytes are there to train the dictionary on."""

    def __init__(self, stream):
        self.stream, self.waiting, self.size, self.records, self.compressor = stream, [], 0, 0, None

    def add(self, data: bytes, payload: bytes) -> None:
        self.records += 1
        self.size += len(payload)
        if self.compressor is None:
            self.waiting.append((data, payload))
            if self.size >= SAMPLE:
                self._begin()
        else:
            self.stream.write(self.compressor.compress(data))

    def _begin(self) -> None:
        raw = dictionary_of([p for _, p in self.waiting])
        if raw:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
            self.stream.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        used = zstandard.ZstdCompressionDict(raw) if raw else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=used, write_content_size=True, write_checksum=True)
        for data, _ in self.waiting:
            self.stream.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.compressor is None:
            self._begin()


def frames(stream) -> Iterator[bytes]:
    """The content of each Zstandard frame of an archive, one at a time; the dictionary comes from the leading frame."""
    data, used, first = b"", None, True
    while True:
        while len(data) < 8 and (more := stream.read(CHUNK)):
            data += more
        if not data:
            return
        if len(data) >= 8 and 0x184D2A50 <= (magic := struct.unpack("<I", data[:4])[0]) <= 0x184D2A5F:
            n = 8 + struct.unpack("<I", data[4:8])[0]
            while len(data) < n and (more := stream.read(CHUNK)):
                data += more
            if len(data) < n:
                raise ValueError("an archive that ends within a skippable frame")
            if magic == DICTIONARY_FRAME and first:
                raw = data[8:n]
                raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
                used = zstandard.ZstdCompressionDict(raw)
            data, first = data[n:], False
            continue
        first = False
        if data[:4] != ZSTD_MAGIC:
            raise ValueError("neither a Zstandard nor a skippable frame")
        one = zstandard.ZstdDecompressor(dict_data=used).decompressobj()
        parts = [one.decompress(data)]
        while not one.eof:
            more = stream.read(CHUNK)
            if not more:
                raise ValueError("an archive that ends within a frame")
            parts.append(one.decompress(more))
        data = one.unused_data
        yield b"".join(parts)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, first, revisit: which pages hold a payload that a page of smaller id holds.

    Digests meet in a map-side combined minimum; only digests of two pages or more are joined back.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    several = pages.where(F.octet_length("html") >= LEAST).groupBy(F.col("digest").alias("d"))
    several = several.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    several = stored(several, "payloads")
    joined = pages.join(several, pages.digest == several.d, "left")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", "first", revisit.alias("revisit"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for every page; returns the stored manifest (file, records) of the task attempts that succeeded."""
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches):
        fs, at = pa.fs.FileSystem.from_uri(folder)
        stream = writer = name = None

        def finish():
            writer.close()
            stream.close()
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "records": [writer.records]}, schema=schema)

        for b in slices(batches, 64):
            for row in b.to_pylist():
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    stream = fs.open_output_stream(f"{at}/{name}", compression=None)
                    writer = ArchiveWriter(stream)
                payload = row["html"].encode()
                writer.add(record(row["page_id"], row["url"], payload, row["digest"], row["first"], row["revisit"]), payload)
                if writer.size >= ARCHIVE:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return stored(plan_records(pages).mapInArrow(run, MANIFEST), "archives")


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row for every record of the archives, each checked: headers, lengths, and the digest of each response."""
    files = manifest.repartition(max(1, manifest.count()), "file")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(row["file"])
                rows, n = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for data in frames(stream):
                        found, n = parse(data), n + 1
                        h, kind = found["headers"], found["headers"]["warc-type"]
                        algorithm, _, digest = h.get("warc-payload-digest", "").partition(":")
                        if kind not in ("response", "revisit") or algorithm != "sha256":
                            raise ValueError(f"{row['file']}: a {kind} record with digest {algorithm}")
                        if kind == "response" and (hashlib.sha256(found["block"]).hexdigest() != digest or int(h["x-payload-length"]) != len(found["block"])):
                            raise ValueError(f"{row['file']}: the payload of {h['warc-record-id']} is damaged")
                        rows.append((number(h["warc-record-id"]), int(h["x-payload-length"]), digest, kind, number(h.get("warc-refers-to")), h.get("warc-target-uri")))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if n != row["records"]:
                    raise ValueError(f"{row['file']}: {n} records, the manifest says {row['records']}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return files.mapInArrow(run, RECORD)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives and read what they hold.

    Null html is an empty payload. Rows that repeat the smallest page_id of a payload are responses as well. Null ids are
    never the smallest unless all are null. An empty table gives no archive and no rows.
    """
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc"))).drop("url")
