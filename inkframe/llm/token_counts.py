"""Token counts with the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, is_byte_bpe, not_whole
from .common import slices


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs`, as the library for the file at `path` counts.

    The driver proves once which vocabulary strings encode alone as one token; tasks get the exceptions (at most the
    vocabulary), count pre-tokens that are such strings directly and merge only the others. No shuffle.
    Null or empty text: 0 bytes, 0 tokens. Repeated rows stay. A null doc_id stays null. Other columns are ignored.
    """
    unproven = tuple(not_whole(path)) if is_byte_bpe(path) else None
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        enc = encoder(path, unproven)
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = [enc.count(t) for t in texts]
            size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
