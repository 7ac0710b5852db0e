"""Time expressions: intervals, clock formats, ranges, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum.functions.text import strip


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlap_seconds(s: Column, e: Column, rs: Column, re_: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e, re_) - F.greatest(s, rs))


def temporal_distance(s: Column, e: Column, rs: Column, re_: Column) -> Column:
    """Seconds between two intervals, 0 when they overlap."""
    return (F.when(overlap_seconds(s, e, rs, re_) > 0, F.lit(0.0))
            .when(e < rs, rs - e).otherwise(s - re_))


def interval_iou(s: Column, e: Column, rs: Column, re_: Column) -> Column:
    """Overlap over union of two intervals; 0 without overlap or without length."""
    both = overlap_seconds(s, e, rs, re_)
    union = F.greatest(F.lit(0.0), e - s) + F.greatest(F.lit(0.0), re_ - rs) - both
    return F.when((both <= 0) | (union <= 0), F.lit(0.0)).otherwise(F.try_divide(both, union))


def relevance_grade(iou: Column) -> Column:
    """Overlap ratio in percent, rounded half to even."""
    return F.bround(iou * 100).cast("long")


def parse_timestamp(x: str | Column) -> Column:
    """``M:SS`` or ``H:MM:SS`` to seconds; null for anything else."""
    parts = F.transform(F.split(strip(_col(x)), ":"), lambda p: p.try_cast("long"))
    ok = F.size(parts).isin(2, 3) & ~F.exists(parts, lambda p: p.isNull())
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 60 + p))


def parse_id_list(x: str | Column) -> Column:
    """Ids of a cell: a list literal or a number, else every run of digits."""
    c = strip(F.coalesce(_col(x), F.lit("")))
    opened = F.regexp_replace(F.regexp_replace(c, r"^[(\{]", "["), r",?\s*[)\}]$", "]")
    listed = F.from_json(opened, "array<bigint>")
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("long"))
    clean = opened.rlike(r"^\[[\s\d,+-]*\]$") & listed.isNotNull() & ~F.exists(F.coalesce(listed, F.array().cast("array<bigint>")), lambda v: v.isNull())
    return F.when(clean, listed).when(c.rlike(r"^-?\d+$"), F.array(c.try_cast("long"))).otherwise(runs)


RANGE = r"^\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*$"


def parse_answer_ranges(x: str | Column) -> Column:
    """``a-b | c-d`` to spans; null if a piece is no range, an end precedes its start, or none is left."""
    pieces = F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), r"\|"), strip), lambda p: p != "")
    spans = F.transform(pieces, lambda p: F.struct(
        F.regexp_extract(p, RANGE, 1).try_cast("double").alias("start"),
        F.regexp_extract(p, RANGE, 2).try_cast("double").alias("end")))
    bad = F.exists(spans, lambda s: s["start"].isNull() | s["end"].isNull() | (s["end"] < s["start"]))
    return F.when((F.size(pieces) > 0) & ~bad, spans)


def format_answer_ranges(x: str | Column) -> Column:
    return F.array_join(F.transform(_col(x), lambda s: F.format_string("%.1f-%.1f", s["start"], s["end"])), " | ")


def clock(x: str | Column, *, millis: bool = False) -> Column:
    """Seconds as ``HH:MM:SS`` or ``HH:MM:SS.mmm``."""
    c = _col(x)
    hh = F.floor(c / 3600)
    mm = F.floor((c - hh * 3600) / 60)
    rest = c - hh * 3600 - mm * 60
    if millis:
        return F.format_string("%02d:%02d:%06.3f", hh, mm, rest)
    return F.format_string("%02d:%02d:%02d", hh, mm, F.floor(rest))


def plain_number(x: str | Column) -> Column:
    """A double in plain notation from a millionth up to 10^15, as ``12345678.9`` or ``0.0005``."""
    c = _col(x).cast("double")
    digits = F.regexp_replace(c.try_cast("decimal(38,22)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    written = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) | (c == 0)
    return F.when(written | (F.abs(c) < 1e-6) | (F.abs(c) >= 1e15), c.cast("string")).otherwise(F.coalesce(digits, c.cast("string")))


def strip_key(x: str | Column) -> Column:
    """The key inside ``id(...)``."""
    tail = F.element_at(F.split(_col(x), r"id\("), -1)
    return F.element_at(F.split(tail, r"\)"), 1)
