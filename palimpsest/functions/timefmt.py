"""Times in standard form, ``YYYY,MM,DD,HH:mm``, and prefixes of it as cut-offs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD = "yyyy,MM,dd,HH:mm"
#: Genitive month names as dates on pages have them, with the numbers they stand for.
MONTHS = {
    "січня": "01",
    "лютого": "02",
    "березня": "03",
    "квітня": "04",
    "травня": "05",
    "червня": "06",
    "липня": "07",
    "серпня": "08",
    "вересня": "09",
    "жовтня": "10",
    "листопада": "11",
    "грудня": "12",
}


def standard(ts: Column) -> Column:
    """A timestamp in standard form, to the minute, without any shift of zone."""
    return F.date_format(ts, STANDARD)


def parse_standard(text: Column) -> Column:
    """The timestamp of a whole standard form; null if it is none."""
    return F.try_to_timestamp(text, F.lit(STANDARD))


def cutoff_floor(prefix: str) -> datetime:
    """The first moment of a prefix such as ``2024``, ``2024,03`` or ``2024,03,01,10:15``."""
    parts = prefix.split(",")
    clock = parts[3].split(":") if len(parts) > 3 else []
    numbers = [int(p) for p in (*parts[:3], *clock)]
    return datetime(*(numbers + [1, 1][len(numbers) - 1 :])) if len(numbers) < 3 else datetime(*numbers)


def since(ts: Column, prefix: str) -> Column:
    """Whether the standard form of ``ts`` is at or after ``prefix`` as a string; a bound that scans can push down."""
    return ts >= F.lit(cutoff_floor(prefix))


def until(ts: Column, prefix: str) -> Column:
    """Whether the standard form of ``ts`` is at or before ``prefix`` as a string: strictly before a short prefix, and
    within the minute of a whole one."""
    floor = cutoff_floor(prefix)
    return ts < F.lit(floor + timedelta(minutes=1) if len(prefix) == 16 else floor)


def from_utc(text: Column) -> Column:
    """ISO time with a Z in standard form; seconds go, no shift."""
    return F.date_format(F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'"), STANDARD)


def from_message(text: Column) -> Column:
    """``19:15, 20 травня 2023`` in standard form: commas go, words turn round, months become numbers, single characters
    get a zero in front."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    words = F.split(F.regexp_replace(text, ",", ""), " ")
    turned = F.transform(
        F.reverse(words),
        lambda w: F.coalesce(F.element_at(months, w), F.when(F.length(w) == 1, F.concat(F.lit("0"), w)).otherwise(w)),
    )
    return F.array_join(turned, ",")


# The pattern of a date within a text. It takes as much as it can.
MESSAGE = "[0-9][0-9]:[0-9][0-9].+[0-9][0-9]?.+[0-9][0-9][0-9][0-9]"


def last_modified(text: Column) -> Column:
    """The date within a text in standard form; the text itself if there is none."""
    found = F.regexp_extract(text, f"({MESSAGE})", 1)
    return F.when(found != "", from_message(found)).otherwise(text)


def display_day(text: Column) -> Column:
    """Standard form as ``DD Mon YYYY``; empty stays empty."""
    return F.when(text == "", "").otherwise(F.date_format(parse_standard(text), "dd MMM yyyy"))


def display(text: Column, with_time: bool = True) -> Column:
    """A standard form or a prefix of it as ``DD MON YYYY HH:mm``, as far as it goes."""
    parts = F.split(text, ",")
    names = F.array(*[F.lit(m) for m in "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()])
    month = F.get(names, F.get(parts, 1).cast("int") - 1)
    shown = [F.get(parts, 2), month, F.get(parts, 0)] + ([F.get(parts, 3)] if with_time else [])
    return F.concat_ws(" ", *shown)


def day(text: Column) -> Column:
    return F.substring(text, 1, 10)


def from_input(text: Column) -> Column:
    """``2024-03-01`` as a prefix of standard form."""
    return F.translate(text, "-", ",")


def now(universal: bool = False) -> Column:
    """The current time in standard form, in the session's time zone or in UTC."""
    ts = F.current_timestamp()
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()) if universal else ts, STANDARD)
