"""Token ids as Arrow files of equal-length sequences, and the reader of those files."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import new_folder, slices, stored

#: Tokens of a sequence, and sequences of an Arrow batch.
LENGTH, BATCH = 2048, 128
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_sequences long"


def file_schema(length: int, wide: bool) -> pa.Schema:
    """ids and mask have one fixed-size list a sequence; ends has the documents that end in it, in order.

    Ids are 16 bits wide where the vocabulary allows. The mask is false on the padding of a file's last sequence only.
    """
    end = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
    return pa.schema([
        ("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)),
        ("mask", pa.list_(pa.bool_(), length)),
        ("ends", pa.list_(end)),
    ])


class SequenceWriter:
    """Writes one file; holds one batch of sequences and one document."""

    def __init__(self, stream, length: int, wide: bool, batch: int = BATCH):
        self.length, self.size, self.schema = length, batch * length, file_schema(length, wide)
        self.kind = np.uint32 if wide else np.uint16
        self.out = pa.ipc.new_file(stream, self.schema)
        self.waiting, self.held, self.ends, self.at = [], 0, [], 0
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_docs += 1
        self.n_tokens += len(ids)
        self.waiting.append(ids.astype(self.kind))
        self.held += len(ids)
        self.ends.append((self.n_tokens - 1, doc_id, len(ids)))
        while self.held >= self.size:
            self._write(self.size)

    def _write(self, n: int) -> None:
        flat = np.concatenate(self.waiting) if len(self.waiting) != 1 else self.waiting[0]
        take, rest = flat[:n], flat[n:]
        self.waiting, self.held = [rest] if len(rest) else [], len(rest)
        rows = -(-n // self.length)
        mask = np.ones(rows * self.length, bool)
        if rows * self.length > n:
            take = np.concatenate([take, np.zeros(rows * self.length - n, self.kind)])
            mask[n:] = False
        until = self.at + n
        k = next((i for i, e in enumerate(self.ends) if e[0] >= until), len(self.ends))
        done, self.ends = self.ends[:k], self.ends[k:]
        row = np.array([(e[0] - self.at) // self.length for e in done], np.int64)
        offsets = np.searchsorted(row, np.arange(rows + 1))
        end = pa.StructArray.from_arrays([pa.array([e[1] for e in done], pa.int64()), pa.array([e[2] for e in done], pa.int64())], names=["doc_id", "n_tokens"])
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(take), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), end),
        ], schema=self.schema))
        self.at, self.n_sequences = until, self.n_sequences + rows

    def close(self) -> None:
        if self.held:
            self._write(self.held)
        self.out.close()


def write_sequences(docs: DataFrame, path: str, folder: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Write the ids of all documents, each closed by `end_id`, to Arrow files in ascending doc_id order.

    One range shuffle of the texts; each task streams its sorted range through the tokenizer into one file, named anew in
    each attempt. The manifest returned lists the files of the attempts that succeeded, in order, and is stored.
    Null text is empty (the end id alone); null doc_ids come first; rows of equal doc_id stay, ordered by text.
    """
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16

    def run(batches):
        fs, at = pa.fs.FileSystem.from_uri(folder)
        enc, end, writer = encoder(path), np.array([end_id], "<u4").tobytes(), None
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        for b in slices(batches):
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if writer is None:
                    fs.create_dir(at, recursive=True)
                    stream = fs.open_output_stream(f"{at}/{name}")
                    writer = SequenceWriter(stream, length, wide)
                writer.add(doc_id, np.frombuffer(enc.ids(text or "") + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            row = {"part": [TaskContext.get().partitionId()], "file": [f"{folder}/{name}"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens], "n_sequences": [writer.n_sequences]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())]))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(run, MANIFEST), "sequence-files")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files themselves, a batch in memory at a time.

    A file whose masks, document ends and manifest disagree is refused.
    """
    n = manifest.count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.select("file", "first", F.col("n_tokens").alias("expected")).repartition(max(1, n), "file")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                fs, at = pa.fs.FileSystem.from_uri(row["file"])
                with fs.open_input_file(at) as source:
                    reader = pa.ipc.open_file(source)
                    start, crc, seen, total = row["first"], 0, 0, 0
                    for k in range(reader.num_record_batches):
                        batch = reader.get_batch(k)
                        ids = batch.column("ids").flatten().to_numpy()
                        mask = batch.column("mask").flatten()
                        real = mask.true_count
                        if mask.slice(0, real).true_count != real:
                            raise ValueError(f"{row['file']}: padding before the end")
                        ids, at_id, out = ids[:real].astype("<u4"), 0, []
                        for end in batch.column("ends").flatten().to_pylist():
                            take = end["n_tokens"] - seen
                            crc = zlib.crc32(ids[at_id:at_id + take], crc)
                            out.append((end["doc_id"], start, end["n_tokens"], crc))
                            start, at_id, crc, seen = start + end["n_tokens"], at_id + take, 0, 0
                        if at_id > real:
                            raise ValueError(f"{row['file']}: a document ends beyond its batch")
                        crc, seen, total = zlib.crc32(ids[at_id:], crc), seen + real - at_id, total + real
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)
                    if seen or total != row["expected"]:
                        raise ValueError(f"{row['file']}: {total} ids, the manifest says {row['expected']}")

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def arrow_round_trip(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as the files written hold it.

    A null or empty text is the end id alone. Rows without an id come first, rows of one id in the order of their texts; each has
    its own place. Texts of any length run on over as many sequences as they need. An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    return read_documents(write_sequences(docs, path, new_folder(spark, "arrow"), end_id, length))
