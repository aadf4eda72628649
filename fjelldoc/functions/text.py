"""Scalar text and number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display limits and formats.
SNIPPET_CHARS = 300
TITLE_CHARS = 80
ELLIPSIS = "…"
STAMP_FORMAT = "yyyy-MM-dd_HH-mm-ss"
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ssxxx"


def clip(text: Column, limit: int) -> Column:
    """First `limit` characters, with an ellipsis only when something was left out."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(ELLIPSIS))).otherwise(text)


def snippet(text: Column) -> Column:
    return clip(text, SNIPPET_CHARS)


def auto_title(message: Column) -> Column:
    """Chat title: the first 80 characters without trailing blanks, marked when longer."""
    head = F.regexp_replace(F.left(message, F.lit(TITLE_CHARS)), r"(?U)\s+\z", "")
    return F.when(F.length(message) > TITLE_CHARS, F.concat(head, F.lit(ELLIPSIS))).otherwise(head)


def file_title(path: Column) -> Column:
    """Last path segment without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*\z", "")


def filename_slug(value: Column, fallback: str = "eksport") -> Column:
    """Lower-case ASCII words joined by single hyphens."""
    folded = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    for letter, ascii_form in (("æ", "ae"), ("ø", "o"), ("å", "a")):
        folded = F.replace(folded, F.lit(letter), F.lit(ascii_form))
    dashed = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(dashed == "", F.lit(fallback)).otherwise(dashed)


def timestamp_suffix(ts: Column) -> Column:
    return F.date_format(ts, STAMP_FORMAT)


def export_filename(prefix: Column, ts: Column, extension: str) -> Column:
    return F.concat(filename_slug(prefix, "kartlag-eksport"), F.lit("-"), timestamp_suffix(ts), F.lit("." + extension))


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def js_round(x: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(x + 0.5)


def one_decimal(x: Column) -> Column:
    """One decimal, exact ties upwards; the fraction is split off first so that the stored binary value decides."""
    whole = F.floor(x)
    tenths = whole * 10 + F.floor((x - whole) * 10 + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_number(n: Column) -> Column:
    """1.2M, 3.4K, or the rounded number; null shows as 0."""
    return (
        F.when(n.isNull(), F.lit("0"))
        .when(n >= 1_000_000, F.concat(one_decimal(n / 1_000_000), F.lit("M")))
        .when(n >= 1_000, F.concat(one_decimal(n / 1_000), F.lit("K")))
        .otherwise(js_round(n).cast("string"))
    )


def percent_used(remaining: Column, used: Column, entitled: Column) -> Column:
    return F.when(remaining.isNotNull(), js_round((1 - remaining) * 100)).when(
        used.isNotNull() & (entitled > 0), js_round(used / entitled * 100)
    )


def bar_width(percent: Column, unlimited: Column, unavailable: Column) -> Column:
    return F.when(unavailable | unlimited, F.lit(0).cast("bigint")).otherwise(
        F.least(F.coalesce(percent, F.lit(0).cast("bigint")), F.lit(100).cast("bigint"))
    )


def fixed_windows(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """Overlapping fixed-size windows; the step is size - overlap, at least one."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    cut = F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))
    return F.when(F.length(text) > 0, cut).otherwise(F.array().cast("array<string>"))


def prompt_sections(*sections: Column) -> Column:
    """Optional sections, in order, joined by a blank line; null sections disappear."""
    return F.concat_ws("\n\n", *sections)
