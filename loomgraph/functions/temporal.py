"""Dates written as text, their extents, half-open bounds and the relation of two of them. Times are UTC."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = 500
PROBES = (dt.datetime(1999, 6, 15, tzinfo=dt.UTC), dt.datetime(2035, 2, 20, tzinfo=dt.UTC))
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_M = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in FULL_MONTHS if m != "September") + "|Sep(?:t|tember)?)"
_DASH = r"\s*(?:[-–—]|to)\s*"
MARKERS = (
    ("circa", r"(?i)\bcirca\b|\bca?\.\s*(?=\d)"),
    ("approximate", r"(?i)\b(?:around|approximately|about|roughly)\b"),
    ("before", r"(?i)\b(?:before|prior\s+to|until|no\s+later\s+than)\b"),
    ("after", r"(?i)\b(?:after|since|no\s+earlier\s+than)\b"),
)
_STRIP = r"(?i)\b(?:circa|around|approximately|about|roughly|before|prior\s+to|no\s+later\s+than|after|since|no\s+earlier\s+than)\s*|\bca?\.\s*(?=\d)|\buntil\s+"
EXTENT = "struct<start_date:timestamp,end_date:timestamp,precision:string,uncertainty:string,original_text:string>"


def uncertainty(text: Column) -> Column:
    found = F.when(text.rlike(MARKERS[0][1]), MARKERS[0][0])
    for name, pattern in MARKERS[1:]:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise("exact")


def strip_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _STRIP, ""))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("int")


def _at(year: Column, month: Column | int = 1) -> Column:
    """NULL beyond the years 1 to 9999."""
    year = year.cast("int")
    return F.when((year >= 1) & (year <= 9999), F.make_timestamp(year, F.lit(month) if isinstance(month, int) else month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def _found(start: Column, end: Column | None, precision: str, ok: Column | None = None) -> Column:
    end = F.lit(None).cast("timestamp") if end is None else end
    ok = start.isNotNull() if ok is None else ok & start.isNotNull() & end.isNotNull()
    return F.when(ok, F.struct(start.alias("start"), end.alias("end"), F.lit(precision).alias("precision")))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; written out it would be repeated wherever the body names it."""
    return F.transform(F.array(value), body)[0]


def parse_range(t: Column) -> Column:
    """Years, months or quarters from one to another; NULL where the last comes before the first."""
    years, months, quarters = rf"(?i)^(\d{{4}}){_DASH}(\d{{4}})$", rf"(?i)^{_M}{_DASH}{_M}\s+(\d{{4}})$", r"(?i)^Q([1-4])\s*[-–—]\s*Q([1-4])\s+(\d{4})$"
    a, b = _part(t, years, 1), _part(t, years, 2)
    m, n, y = _month(_part(t, months, 1)), _month(_part(t, months, 2)), _part(t, months, 3)
    p, q, z = (_part(t, quarters, k).cast("int") for k in (1, 2, 3))
    return (
        F.when(t.rlike(years), _found(_at(a), _at(b), "year", b.cast("int") >= a.cast("int")))
        .when(t.rlike(months), _found(_at(y, m), _at(y, n), "month", n >= m))
        .when(t.rlike(quarters), _found(_at(z, p * 3 - 2), _at(z, q * 3 - 2), "month", q >= p))
    )


def parse_partial(t: Column) -> Column:
    """A year, month and year, quarter or decade."""
    month, quarter, decade = rf"(?i)^{_M}\s+(\d{{4}})$", r"(?i)^Q([1-4])\s+(\d{4})$", r"(?i)^(?:the\s+)?(\d{3})0s$"
    ten = _part(t, decade, 1).cast("int") * 10
    return (
        F.when(t.rlike(r"^\d{4}$"), _found(_at(t), None, "year"))
        .when(t.rlike(month), _found(_at(_part(t, month, 2), _month(_part(t, month, 1))), None, "month"))
        .when(t.rlike(quarter), _found(_at(_part(t, quarter, 2), _part(t, quarter, 1).cast("int") * 3 - 2), None, "month"))
        .when(t.rlike(decade), _found(_at(ten), _at(ten + 9), "year", ten > 0))
    )


def parse_period(t: Column) -> Column:
    """A century or a third of one."""
    part = r"(?i)^(?:(early|mid|late)\s+)?(\d{1,2})(?:st|nd|rd|th)\s+century$"
    which, base = F.lower(_part(t, part, 1)), (_part(t, part, 2).cast("int") - 1) * 100
    first = base + F.when(which == "mid", 34).when(which == "late", 67).otherwise(1)
    last = base + F.when(which == "early", 33).when(which == "mid", 66).otherwise(100)
    return F.when(t.rlike(part) & (base >= 0), _found(_at(first), _at(last), "year", base >= 0))


def time_precision(text: Column) -> Column:
    return F.when(text.rlike(r"\d{1,2}:\d{2}"), "minute").when(text.rlike(r"(?i)\b\d{1,2}\s*(?:am|pm|a\.m\.|p\.m\.|o'clock)"), "hour").otherwise("day")


def _calendar(text: Column, base: Column) -> Column:
    """Any other written date, missing parts from ``base``; without a base two probes must agree. Relative phrases are NULL."""

    @F.arrow_udf(T.StructType([T.StructField("at", T.TimestampType()), T.StructField("ambiguous", T.BooleanType())]))
    def run(texts: pa.Array, bases: pa.Array) -> pa.Array:
        from dateutil import parser

        def one(t: str, b: dt.datetime) -> dt.datetime | None:
            try:
                found = parser.parse(t, fuzzy=False, default=b)
            except (ValueError, OverflowError):
                return None
            return found.astimezone(dt.UTC) if found.tzinfo else found.replace(tzinfo=dt.UTC)

        out = []
        for t, b in zip(texts.to_pylist(), bases.to_pylist()):
            if t is None:
                out.append({"at": None, "ambiguous": False})
                continue
            tried = [one(t, p) for p in ([b.astimezone(dt.UTC) if b.tzinfo else b.replace(tzinfo=dt.UTC)] if b else PROBES)]
            out.append({"at": tried[0] if len(set(tried)) == 1 else None, "ambiguous": len(set(tried)) > 1})
        return pa.array(out, pa.struct([("at", pa.timestamp("us", tz="UTC")), ("ambiguous", pa.bool_())]))

    return run(text, base)


_UNIT = r"(second|minute|hour|day|week|month|year)s?"
_AGO, _IN, _NEAR_UNIT = rf"(?i)^(\d{{1,4}}|an?|one)\s+{_UNIT}\s+ago$", rf"(?i)^in\s+(\d{{1,4}}|an?|one)\s+{_UNIT}$", rf"(?i)^(last|next)\s+{_UNIT}$"


def parse_relative(t: Column, base: Column) -> Column:
    """The moment that a relative phrase means as seen from ``base``: today, yesterday, tomorrow, "3 weeks ago", "in a month", "last
    year", "next day"; NULL for anything else or without a base."""
    word = F.lower(t)
    days = F.when(word.isin("today", "now"), 0).when(word == "yesterday", -1).when(word == "tomorrow", 1)
    found = F.when(days.isNotNull(), F.timestamp_add("DAY", days, base))
    for pattern, sign in ((_AGO, -1), (_IN, 1), (_NEAR_UNIT, None)):
        first, unit = _part(t, pattern, 1), F.lower(_part(t, pattern, 2))
        n = F.when(F.lower(first) == "last", -1).otherwise(1) if sign is None else F.coalesce(first.try_cast("int"), F.lit(1)) * sign
        for name in ("second", "minute", "hour", "day", "week", "month", "year"):
            found = found.when(t.rlike(pattern) & (unit == name), F.timestamp_add(name.upper(), n.cast("int"), base))
    return found


def is_empty(extent: Column) -> Column:
    """A NULL extent, or one all of whose fields are NULL."""
    return extent.isNull() | F.coalesce(*[extent[f].cast("string") for f in ("start_date", "end_date", "precision", "uncertainty", "original_text")]).isNull()


def is_temporal(extent: Column) -> Column:
    return ~is_empty(extent)


def build_extent(expression: Column, sequence: Column, reference_date: Column | None = None, *, calendar: bool = True) -> Column:
    """struct(extent, sequence, undatable) of what a model said: a text that can't be read is kept as the extent's text and flagged;
    a sequence alone makes an entity ordered, not dated; neither gives NULL."""
    said = F.trim(F.coalesce(expression, F.lit(""))) != ""
    read = parse(expression, reference_date, calendar=calendar)
    none = F.lit(None)
    kept = F.struct(none.cast("timestamp").alias("start_date"), none.cast("timestamp").alias("end_date"), none.cast("string").alias("precision"), none.cast("string").alias("uncertainty"), F.trim(expression).alias("original_text"))
    return F.when(said | sequence.isNotNull(), F.struct(F.when(said, F.coalesce(read, kept)).alias("extent"), sequence.alias("sequence"), (said & read.isNull()).alias("undatable")))


def parse(text: Column, reference_date: Column | None = None, *, calendar: bool = True) -> Column:
    """The extent of a date text, or NULL: blank, over ``LONGEST`` characters, unreadable, or (without a reference date) a
    text that two probe dates read differently (``is_ambiguous``). ``calendar=False`` leaves out the Python parser."""
    cleaned = F.trim(text)
    fixed = _bind(strip_markers(cleaned), _fixed)
    if calendar:
        t = strip_markers(cleaned)
        base = F.lit(None).cast("timestamp") if reference_date is None else reference_date
        at = _calendar(F.when(fixed.isNull() & (t != ""), t), base)["at"]
        if reference_date is not None:
            at = F.coalesce(parse_relative(t, base), at)
        open_end = F.when(at.isNotNull(), F.struct(at.alias("start"), F.lit(None).cast("timestamp").alias("end"), time_precision(t).alias("precision"), F.lit(False).alias("period")))
        fixed = F.coalesce(fixed, open_end)

    def extent(found: Column) -> Column:
        marker = F.when(found["period"] & (uncertainty(cleaned) == "exact"), "approximate").otherwise(uncertainty(cleaned))
        made = F.struct(found["start"].alias("start_date"), found["end"].alias("end_date"), found["precision"].alias("precision"), marker.alias("uncertainty"), cleaned.alias("original_text"))
        return F.when(found.isNotNull() & (F.length(cleaned) <= LONGEST), made)

    return _bind(fixed, extent)


def _fixed(t: Column) -> Column:
    """What the fixed forms give, and whether it is a century or part of one; NULL for anything else."""
    def noted(period: bool) -> Callable[[Column], Column]:
        return lambda f: F.when(f.isNotNull(), F.struct(f["start"].alias("start"), f["end"].alias("end"), f["precision"].alias("precision"), F.lit(period).alias("period")))

    return F.coalesce(_bind(F.coalesce(parse_range(t), parse_partial(t)), noted(False)), _bind(parse_period(t), noted(True)))


def is_ambiguous(text: Column) -> Column:
    """Needs a reference date."""
    t = strip_markers(F.trim(text))
    fixed = _bind(t, _fixed)
    return F.coalesce(_calendar(F.when(fixed.isNull() & (t != ""), t), F.lit(None).cast("timestamp"))["ambiguous"], F.lit(False))


def render(start: Column, end: Column, precision: Column, marker: Column) -> Column:
    """The text that parses to this extent, or NULL."""
    prefix = F.create_map(*[F.lit(x) for pair in (("exact", ""), ("circa", "circa "), ("approximate", "around "), ("before", "before "), ("after", "after ")) for x in pair])[F.coalesce(marker, F.lit("exact"))]
    month = F.element_at(F.array(*map(F.lit, FULL_MONTHS)), F.month(start))

    def whole(unit: str) -> Column:
        return F.date_trunc(unit, start) == start

    year = F.lpad(F.year(start).cast("string"), 4, "0")
    return (
        F.when((precision == "year") & whole("year") & end.isNull(), F.concat(prefix, F.year(start)))
        .when((precision == "year") & whole("year") & (F.date_trunc("year", end) == end) & (F.year(end) > F.year(start)), F.concat(prefix, F.year(start), F.lit("-"), F.year(end)))
        .when(end.isNull() & (precision == "month") & whole("month"), F.concat(prefix, month, F.lit(" "), year))
        .when(end.isNull() & (precision == "day") & whole("day"), F.concat(prefix, F.dayofmonth(start), F.lit(" "), month, F.lit(" "), year))
    )


def widen(moment: Column, precision: Column) -> Column:
    """The first instant after the stated unit; a microsecond later without one."""
    out = F.when(precision.isNull(), moment + F.expr("interval 1 microsecond"))
    for unit in ("year", "month", "day", "hour", "minute"):
        out = out.when(precision == unit, F.date_trunc(unit, moment) + F.expr(f"interval 1 {unit}"))
    return out


def bounds(start: Column, end: Column, precision: Column, marker: Column) -> Column:
    """struct(lower, upper), half open, NULL for unbounded; NULL for an undated extent."""
    anchor = F.coalesce(start, end)
    lower = F.when(marker == "before", None).when(marker == "after", widen(anchor, precision)).otherwise(start)
    upper = F.when(marker == "before", anchor).when(marker == "after", None).otherwise(widen(F.coalesce(end, start), precision))
    return F.when(anchor.isNotNull(), F.struct(lower.cast("timestamp").alias("lower"), upper.cast("timestamp").alias("upper")))


def relate(a: Column, b: Column) -> Column:
    """Of two bounds: equals, before, after, during, contains or overlaps, tested in this order; NULL where one is NULL."""
    lo_le = lambda x, y: x.isNull() | F.coalesce(x <= y, F.lit(False))  # noqa: E731  NULL is the far past
    up_le = lambda x, y: y.isNull() | F.coalesce(x <= y, F.lit(False))  # noqa: E731  NULL is the far future
    apart = lambda x, y: F.coalesce(x <= y, F.lit(False))
    al, au, bl, bu = a["lower"], a["upper"], b["lower"], b["upper"]
    return F.when(a.isNotNull() & b.isNotNull(), (
        F.when(al.eqNullSafe(bl) & au.eqNullSafe(bu), "equals")
        .when(apart(au, bl), "before")
        .when(apart(bu, al), "after")
        .when(lo_le(bl, al) & up_le(au, bu), "during")
        .when(lo_le(al, bl) & up_le(bu, au), "contains")
        .otherwise("overlaps")
    ))
