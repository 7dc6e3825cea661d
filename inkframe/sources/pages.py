"""Scanned page images to scanline tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered

SUFFIXES = ("jpg", "jpeg")
IMAGE_SCHEMA = (
    "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
)
LINES_SCHEMA = "event string, file string, y bigint, px array<smallint>"


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _event(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _order_number(file: Column) -> list[Column]:
    """The whole number made of all digits in a file name, of any length: its digits counted, then compared as text."""
    digits = F.regexp_replace(F.regexp_replace(file, r"\D", ""), "^0+", "")
    return [F.length(digits), digits]


def _glob(suffixes: Sequence[str]) -> str:
    """File names of these suffixes in any case, for the listing itself."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def _is_page(file: Column, suffixes: Sequence[str]) -> Column:
    return file.rlike(r"(?i)\.(" + "|".join(suffixes) + ")$")


def page_numbers(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """`(event, file, page_no)`: a file's place in its folder, in natural order, from 1.

    Only the listing is read. File contents are never part of the ordering.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(suffixes)).load(path).select("path")
        .select(_event(F.col("path")).alias("event"), _file(F.col("path")).alias("file"))
    )
    length, digits = _order_number(F.col("file"))
    listing = listing.filter(_is_page(F.col("file"), suffixes)).withColumn("_length", length).withColumn("_digits", digits)
    # Chunks follow the order: digits counted, the leading part of the number, then the name's start where there is no number.
    listing = listing.withColumn("_head", F.when(F.col("_length") > 4, F.expr("left(_digits, _length - 4)")).otherwise(""))
    listing = listing.withColumn("_name", F.when(F.col("_length") == 0, F.substring("file", 1, 4)).otherwise(""))
    order = [F.col("_digits"), F.col("file")]
    ordered = numbered(listing, ["event"], ["_length", "_head", "_name"], order, "page_no")
    return ordered.select("event", "file", "page_no")


def read_pages(spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Decoded page images `(event, file, image)`; decoding is the JVM's."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(suffixes)).load(path)
    return _named(images, suffixes)


def stream_pages(
    spark: SparkSession, path: str, suffixes: Sequence[str] = SUFFIXES, files_per_trigger: int = 64
) -> DataFrame:
    """The same as a stream, with the file's time as `ts`; at most `files_per_trigger` pages are held at a time.

    A page's number is its place among all files of its event, so it comes later: see `streaming.pairing.number_stream`.
    """
    images = (
        spark.readStream.format("image").schema(IMAGE_SCHEMA).option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _glob(suffixes)).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )
    return _named(images.select("image", F.col("_metadata.file_modification_time").alias("ts")), suffixes, "ts")


def _named(images: DataFrame, suffixes: Sequence[str], *more: str) -> DataFrame:
    origin = F.col("image.origin")
    return images.select(_event(origin).alias("event"), _file(origin).alias("file"), "image", *more).filter(
        _is_page(F.col("file"), suffixes)
    )


def _grey(keep: Sequence[str] = ()):
    """Lines of page images; columns named in `keep` are on every line of their page."""
    kind = [pa.field("event", pa.string()), pa.field("file", pa.string()), pa.field("y", pa.int64()), pa.field("px", pa.list_(pa.int16()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*kind, *(batch.schema.field(c) for c in keep)])
            for row in range(batch.num_rows):
                event, file, h, w, n, data = (batch.column(c)[row].as_py() for c in range(6))
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int64)
                # Channels come blue first; one channel is already grey.
                grey = raw[:, :, 0] if n == 1 else (raw[:, :, 2] * 299 + raw[:, :, 1] * 587 + raw[:, :, 0] * 114) // 1000
                px = pa.ListArray.from_arrays(
                    pa.array(np.arange(h + 1, dtype=np.int32) * w), pa.array(grey.astype(np.int16).ravel())
                )
                same = pa.array(np.full(h, row))
                more = [batch.column(c).take(same) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([event] * h), pa.array([file] * h), pa.array(np.arange(h, dtype=np.int64)), px, *more], schema=schema
                )

    return run


def _readable() -> Column:
    """The image source marks a file that it cannot decode with a height of -1."""
    size = F.col("image.height") * F.col("image.width") * F.col("image.nChannels")
    return F.coalesce((F.col("image.height") > 0) & (F.length("image.data") == size), F.lit(False))


def rejected_images(images: DataFrame) -> DataFrame:
    """`(event, file, reason)` of pages whose file is no image; `to_scanlines` leaves those out."""
    reason = F.when(F.coalesce(F.col("image.height"), F.lit(-1)) <= 0, "not decodable").otherwise("incomplete pixels")
    return images.filter(~_readable()).select("event", "file", reason.alias("reason"))


def to_scanlines(images: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Decoded images to grey lines, one page at a time in Arrow; no shuffle. See `rejected_images` for the rest.

    Columns named in `keep` (a stream's `ts`, say) go along on every line of their page.
    """
    flat = images.filter(_readable()).select("event", "file", "image.height", "image.width", "image.nChannels", "image.data", *keep)
    more = "".join(f", {c} {images.schema[c].dataType.simpleString()}" for c in keep)
    return flat.mapInArrow(_grey(keep), LINES_SCHEMA + more)
