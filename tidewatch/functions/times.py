"""Coarse relative ages: parsing, calculating back, estimating from a transition.

Timestamps are TIMESTAMP_NTZ in UTC, so that no result depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit words by unit, in the languages that sources show.
UNITS = {
    "second": ("秒", "秒鐘", "秒钟"),
    "minute": ("分鐘", "分钟", "分"),
    "hour": ("小時", "小时", "時間"),
    "day": ("天", "日"),
    "week": ("週", "周", "週間"),
    "month": ("月", "個月", "个月", "か月", "ヶ月"),
    "year": ("年",),
}
JUST_NOW = ("剛剛", "刚刚", "現在", "现在", "たった今", "just now")
YESTERDAY = ("昨天", "昨日", "yesterday")
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
DIGITS = ("０１２３４５６７８９", "0123456789")


def any_of(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def parsed(text: Column) -> Column:
    """struct<value, unit, kind>; kind is short (under a week), long or unparsed. An age may stand within other words."""
    flat = F.translate(F.regexp_replace(F.lower(F.trim(text)), r"(?U)\s+", " "), *DIGITS)
    east = rf"(\d+)\s*({any_of(w for group in UNITS.values() for w in group)})\s*前"
    west = rf"\b(\d+|an?)\s+({'|'.join(UNITS)})s?\s+ago\b"
    said = F.struct(*(F.regexp_extract(flat, p, i).alias(n) for n, p, i in (("number", east, 1), ("word", east, 2), ("amount", west, 1), ("name", west, 2))), flat.alias("flat"))
    unit_of = F.create_map(*(F.lit(x) for unit, group in UNITS.items() for word in (*group, unit) for x in (word, unit)))

    def read(x: Column) -> Column:
        number = F.when(x["number"] != "", x["number"]).when(x["amount"].isin("a", "an"), "1").otherwise(x["amount"])
        value = F.when(x["flat"].isin(*JUST_NOW), 0).when(x["flat"].isin(*YESTERDAY), 1).otherwise(number.try_cast("int"))
        unit = F.when(x["flat"].isin(*JUST_NOW), "second").when(x["flat"].isin(*YESTERDAY), "day").otherwise(unit_of[F.when(x["word"] != "", x["word"]).otherwise(x["name"])])
        return F.struct(value.alias("value"), F.when(value.isNotNull(), unit).alias("unit"))

    return F.element_at(F.transform(F.transform(F.array(said), read), lambda x: F.struct(x["value"].alias("value"), x["unit"].alias("unit"), kind_of(x["value"], x["unit"]).alias("kind"))), 1)


def kind_of(value: Column, unit: Column) -> Column:
    short = unit.isin("second", "minute", "hour") | ((unit == "day") & (value < 7))
    return F.when(short, "short").when(unit.isin("week", "month", "year"), "long").otherwise("unparsed")


def calculated_back(observed_at: Column, age: Column) -> Column:
    """The instant that a short age points to; null for others."""
    seconds = F.lit(None).cast("long")
    for unit, n in SECONDS.items():
        seconds = F.when(age["unit"] == unit, age["value"].cast("long") * n).otherwise(seconds)
    return F.when(age["kind"] == "short", F.timestamp_add("SECOND", -seconds, observed_at))


def epoch_micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), at)


def estimated(before: Column, after: Column, age: Column, zone: str) -> Column:
    """The date that lies `age` before the midpoint of two instants, in local calendar steps."""
    half = F.timestamp_add("MICROSECOND", F.timestamp_diff("MICROSECOND", before, after) / 2, before)
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), half).cast("date")
    n = age["value"]
    return F.when(age["unit"] == "week", F.date_sub(local, n * 7)).when(age["unit"] == "month", F.add_months(local, -n)).when(age["unit"] == "year", F.add_months(local, -12 * n))


def shown(at: Column, zone: str) -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at), "yyyy-MM-dd HH:mm:ss")


def retry_seconds(attempts: Column) -> Column:
    return F.least(F.lit(3600), (F.lit(30) * F.pow(F.lit(2), F.least(attempts, F.lit(7)))).cast("int"))


ZONE = r"(?:[Zz]|[+-]\d\d:?\d\d)$"


def instant(value: Column) -> Column:
    """An ISO text as an instant, TIMESTAMP_NTZ in UTC; one without a zone is UTC, one that can't be read is null."""
    zoned = F.when(value.rlike(ZONE), value).otherwise(F.concat(value, F.when(value.rlike(r"\d:\d\d"), "Z").otherwise(" 00:00:00Z")))
    return F.timestamp_add("MICROSECOND", F.unix_micros(zoned.try_cast("timestamp")), F.expr("TIMESTAMP_NTZ'1970-01-01'"))


def strict_instant(value: Column) -> Column:
    """As instant(), but a text without a zone, or one that can't be read, stops the query."""
    return F.when(value.isNull(), F.lit(None).cast("timestamp_ntz")).when(value.rlike(ZONE), F.coalesce(instant(value), F.raise_error(F.concat(F.lit("not a time: "), value)).cast("timestamp_ntz"))).otherwise(
        F.raise_error(F.concat(F.lit("a time needs a zone: "), value)).cast("timestamp_ntz")
    )


def local_text(value: Column, zone: str, none: str = "—") -> Column:
    """A stored time as shown: local, to the second; nothing is `none`, and what can't be read stays as it is."""
    return F.when(F.coalesce(value, F.lit("")) == "", none).otherwise(F.coalesce(shown(instant(value), zone), value))


def shifted(at: Column, hours: int = 8) -> Column:
    """A fixed offset, whatever the zone's rules."""
    return F.date_format(F.timestamp_add("HOUR", F.lit(hours), at), "yyyy-MM-dd HH:mm:ss")


def posted(estimate: Column, back: Column) -> Column:
    """The estimated date, else the time calculated back."""
    return F.coalesce(F.nullif(estimate, F.lit("")), F.nullif(back, F.lit("")))


def epoch_seconds(value: Column) -> Column:
    """Seconds of a date or time in text; null for what can't be read and for the epoch itself."""
    seconds = epoch_micros(instant(value)) / 1_000_000
    return F.when(seconds != 0, seconds)


def posted_axis(back: Column, estimate: Column) -> Column:
    """One axis for sorting, in microseconds: the time calculated back, else noon of the estimated date (UTC)."""
    noon = epoch_micros(estimate.cast("timestamp_ntz")) + 12 * 3600 * 1_000_000
    return F.coalesce(epoch_micros(back), noon)


#: What the two columns say without a time.
NOTHING, WATCHED, UNREADABLE, NOT_YET = "—", "觀察中", "無法解析", "尚未更新"


def time_columns(back: Column, estimate: Column, status: Column, zone: str) -> Column:
    """struct<back, estimate> of the detail view, from stored texts; a null status is pending. An estimate empties the first column."""
    status = F.coalesce(F.nullif(status, F.lit("")), F.lit("pending"))
    pair = lambda a, b: F.struct(a.alias("back"), b.alias("estimate"))
    dash, word = F.lit(NOTHING), lambda w: pair(F.lit(w), F.lit(w))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    out = F.when(has(back), pair(local_text(back, zone), dash)).when(has(estimate), pair(dash, estimate)).when(status == "long", pair(dash, F.lit(WATCHED)))
    return out.when(status == "unparsed", word(UNREADABLE)).when(status == "pending", word(NOT_YET)).otherwise(word(NOTHING))


def listed_time_columns(back: Column, estimate: Column, status: Column) -> Column:
    """struct<back, estimate> of the list view: the first column looks at no estimate, and hours are shifted by a fixed offset."""
    waits = lambda c: c.when(status == "unparsed", UNREADABLE).when(status == "pending", NOT_YET).otherwise(NOTHING)
    first = waits(F.when(back.isNotNull(), shifted(back)))
    second = waits(F.when(back.isNotNull(), NOTHING).when(estimate.isNotNull(), estimate).when(status == "long", WATCHED))
    return F.struct(first.alias("back"), second.alias("estimate"))
