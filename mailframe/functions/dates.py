"""RFC 5322 dates with built-in Spark expressions: parsing, checking, instants and rendering.

A parsed date keeps what was written: ``struct<dow,day,month,year,hour,minute,second,zone,off_h,off_m>``. Years are
literal, fractions of seconds are dropped, weekday and calendar are only checked by ``valid``.

``compat`` (the default) reads an offset as the sum of its signed hours and unsigned minutes, so that -0330 is
two and a half hours west; without it the sign covers both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let
from .fields import strip_comments, unfold

# Names of days and months, and hours of named zones.
DAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ZONES = {"UT": 0, "GMT": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
MILITARY = {**{c: i + 1 for i, c in enumerate("ABCDEFGHIKLM")}, **{c: -i - 1 for i, c in enumerate("NOPQRSTUVWXY")}, "Z": 0}

_PATTERN = (
    r"^\s*(?:(" + "|".join(DAYS) + r")\s*,)?\s*(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s+(\d{4,}|\d{2,3})\s+"
    r"(\d{2})\s*:\s*(\d{2})(?:\s*:\s*(\d{2})(?:\.\d+)?)?\s*([+-]\d{4}|UT|GMT|[ECMP][SD]T|[A-IK-Za-ik-z])"
)


def _table(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def zone_hours(zone: Column) -> Column:
    """Hours of a zone: named, military (null for lower-case letters) or ±hhmm."""
    return F.when(zone.rlike(r"^[+-]\d{4}$"), F.substring(zone, 1, 3).cast("int")).otherwise(F.try_element_at(_table(ZONES | MILITARY), zone))


def zone_minutes(zone: Column) -> Column:
    return F.when(zone.rlike(r"^[+-]\d{4}$"), F.substring(zone, 4, 2).cast("int")).when(F.map_contains_key(_table(ZONES | MILITARY), zone), F.lit(0))


def valid_zone(zone: Column) -> Column:
    """Named, military, or hours under 24 with minutes under 60."""
    return F.coalesce((F.abs(zone_hours(zone)) < 24) & (zone_minutes(zone) < 60), F.lit(False))


def military_zone(letter: Column) -> Column:
    """The zone of a letter in either case; null for J and what is no letter."""
    up = F.upper(letter)
    return F.when(up.rlike("^[A-IK-Z]$"), up)


def parse(value: Column) -> Column:
    """The date at the start of a value (comments and folds aside), or null."""

    def whole(text: Column) -> Column:
        # one match, written as its groups
        groups = F.split(F.regexp_replace(text, rf"(?s){_PATTERN}.*$", "$1|$2|$3|$4|$5|$6|$7|$8"), r"\|")
        return F.when(text.rlike(_PATTERN), let(groups, parts))

    def parts(groups: Column) -> Column:
        group = lambda n: groups[n - 1]
        month = F.array_position(F.array(*map(F.lit, MONTHS)), group(3)).cast("int")
        return F.struct(
            F.nullif(group(1), F.lit("")).alias("dow"), group(2).cast("int").alias("day"), month.alias("month"), group(4).try_cast("int").alias("year"),
            group(5).cast("int").alias("hour"), group(6).cast("int").alias("minute"), F.nullif(group(7), F.lit("")).cast("int").alias("second"),
            group(8).alias("zone"), zone_hours(group(8)).alias("off_h"), zone_minutes(group(8)).alias("off_m"),
        )

    return let(strip_comments(unfold(value)), whole)


def offset_seconds(date: Column, compat: bool = True) -> Column:
    minutes = date["off_m"] if compat else F.when(date["zone"].startswith("-"), -date["off_m"]).otherwise(date["off_m"])
    return date["off_h"] * 3600 + minutes * 60


def local_timestamp(date: Column) -> Column:
    """The wall-clock time as if in UTC; null if there is no such time."""
    return F.try_make_timestamp(date["year"], date["month"], date["day"], date["hour"], date["minute"], F.coalesce(date["second"], F.lit(0)).cast("decimal(8,6)"), F.lit("UTC"))


def epoch(date: Column, compat: bool = True) -> Column:
    """Seconds since 1970 of the instant; null for invalid dates and unknown zones."""
    return let(date, lambda d: F.unix_seconds(local_timestamp(d)) - offset_seconds(d, compat))


def weekday(day: Column) -> Column:
    """Mon to Sun of a date or timestamp column (a timestamp's day is taken in UTC)."""
    days = F.floor(F.unix_seconds(day.cast("timestamp")) / 86400)
    return F.element_at(F.array(*map(F.lit, DAYS)), (F.pmod(days + 3, F.lit(7)) + 1).cast("int"))


def valid(date: Column) -> Column:
    """Whether the calendar has the date and its weekday, if given, is right."""
    return let(date, lambda d: let(local_timestamp(d), lambda there: there.isNotNull() & (d["dow"].isNull() | (d["dow"] == weekday(there)))))


def of_epoch(seconds: Column, zone: Column, compat: bool = True) -> Column:
    """The date of an instant in a zone, with its weekday."""
    shape = F.struct(zone.alias("zone"), zone_hours(zone).alias("off_h"), zone_minutes(zone).alias("off_m"))
    there = F.timestamp_seconds(seconds + offset_seconds(shape, compat))
    return let(there, lambda there: F.struct(
        weekday(there).alias("dow"), F.dayofmonth(there).alias("day"), F.month(there).alias("month"), F.year(there).alias("year"),
        F.hour(there).alias("hour"), F.minute(there).alias("minute"), F.second(there).alias("second"), zone.alias("zone"), zone_hours(zone).alias("off_h"), zone_minutes(zone).alias("off_m"),
    ))


def render(date: Column) -> Column:
    """"Fri, 21 Nov 1997 09:55:06 -0600", without the parts that the date lacks."""

    def text(d: Column) -> Column:
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        year = d["year"].cast("string")
        return F.concat(
            F.coalesce(F.concat(d["dow"], F.lit(", ")), F.lit("")), d["day"].cast("string"), F.lit(" "), F.element_at(F.array(*map(F.lit, MONTHS)), d["month"]), F.lit(" "),
            F.when(F.length(year) < 4, F.lpad(year, 4, "0")).otherwise(year), F.lit(" "), two(d["hour"]), F.lit(":"), two(d["minute"]),
            F.coalesce(F.concat(F.lit(":"), two(d["second"])), F.lit("")), F.lit(" "), d["zone"],
        )

    return let(date, text)


def same(a: Column, b: Column) -> Column:
    """Equal as written: GMT isn't +0000, and a missing second isn't zero."""
    drop = lambda d: F.struct(*(d[x] for x in ("dow", "day", "month", "year", "hour", "minute", "second", "zone")))
    return drop(a).eqNullSafe(drop(b))
