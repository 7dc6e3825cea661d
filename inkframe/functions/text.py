"""Names, dates, column letters and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the chapter's scan file name pattern.
SCAN_NAME = r"(?i)^(\d{1,2})\.(\d{1,2})\.(\d{2,4})[_-](.+?)(?:[_-]CH\d+)?\.pdf$"


def scan_date(name: Column) -> Column:
    """ISO date in `m.d.yy_place_CHnn.pdf`; null where the name has another shape."""
    year = F.regexp_extract(name, SCAN_NAME, 3)
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    parts = [F.lpad(F.regexp_extract(name, SCAN_NAME, i), 2, "0") for i in (1, 2)]
    return F.when(name.rlike(SCAN_NAME), F.concat_ws("-", full, *parts))


def scan_place(name: Column) -> Column:
    """Place in the same name, separators turned to spaces."""
    place = F.regexp_replace(F.regexp_extract(name, SCAN_NAME, 4), r"[-_]+", " ")
    return F.when(name.rlike(SCAN_NAME), F.trim(place))


def chapter_date(iso: Column) -> Column:
    """`2025-09-06` to `9.6.25`; anything that is not ISO passes through."""
    short = F.concat_ws(
        ".",
        F.substring(iso, 6, 2).try_cast("int").cast("string"),
        F.substring(iso, 9, 2).try_cast("int").cast("string"),
        F.substring(iso, 3, 2),
    )
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), short).otherwise(iso)


def column_name(index: Column) -> Column:
    """1-based index to spreadsheet letters (bijective base 26) of any length; null below 1."""
    i = index.cast("bigint")

    def peel(acc: Column, _: Column) -> Column:
        n, rest = acc["n"], acc["n"] - 1
        more = F.struct(
            F.call_function("div", rest, F.lit(26)).alias("n"),
            F.concat(F.chr(F.pmod(rest, F.lit(26)) + 65), acc["s"]).alias("s"),
        )
        return F.when(n > 0, more).otherwise(acc)

    # Fourteen letters hold any bigint.
    start = F.struct(i.alias("n"), F.lit("").alias("s"))
    return F.when(i >= 1, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, peel, lambda acc: acc["s"]))


def column_index(letters: Column) -> Column:
    """Spreadsheet letters back to the 1-based index."""
    return F.aggregate(
        F.split(letters, ""),
        F.lit(0).cast("bigint"),
        lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64),
    )


def match_key(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]", "")


def suggested_filename(date: Column, shoreline: Column) -> Column:
    """`<date>_<Shore-Line>.xlsx`, with `Cleanup` where nothing of the name is left."""
    slug = F.regexp_replace(
        F.regexp_replace(F.trim(shoreline), r"[^A-Za-z0-9_\s-]", ""), r"\s+", "-"
    )
    return F.concat(date, F.lit("_"), F.coalesce(F.nullif(slug, F.lit("")), F.lit("Cleanup")), F.lit(".xlsx"))


def describe_age(seconds: Column) -> Column:
    """`just now`, `n minutes ago`, `n hours ago`, `n days ago`, from whole seconds."""
    s = F.greatest(seconds, F.lit(0))
    minutes = F.floor(s / 60 + 0.5).cast("bigint")
    hours = F.floor(minutes / 60 + 0.5).cast("bigint")
    days = F.floor(hours / 24 + 0.5).cast("bigint")

    def counted(n: Column, unit: str) -> Column:
        return F.concat(
            n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")
        )

    return (
        F.when(s < 90, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours < 24, counted(hours, "hour"))
        .otherwise(counted(days, "day"))
    )
