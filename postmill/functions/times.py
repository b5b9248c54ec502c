"""Dates of the archive: ISO strings with offset on the outside, instants where order matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postmill.functions.text import first_of

ZONE = "Europe/Rome"
# Italian month names by their number.
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")


def instant(iso: Column) -> Column:
    """Timestamp of an ISO string; without offset it is read in the session's zone (UTC); null where unreadable."""
    return F.try_to_timestamp(iso)


def iso(ts: Column, zone: str = ZONE) -> Column:
    """ISO text to the second with the zone's numeric offset; the session must run in UTC."""
    local = F.from_utc_timestamp(ts, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(ts)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.format_string("%02d:%02d", (F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60))


def later(a: Column, b: Column) -> Column:
    """The string of the later instant; at a tie, or where only b can be read, b."""
    x, y = instant(a), instant(b)
    return F.when(x.isNotNull() & (y.isNull() | (x > y)), a).otherwise(F.coalesce(b, a))


def best_date(certified: Column, sent: Column, fetched: Column) -> Column:
    """Certified date, else sent, else fetched; empty strings count as missing."""
    return first_of(certified, sent, fetched)


def mailbox_internal(c: Column) -> Column:
    """INTERNALDATE text (padded day, numeric offset) as a timestamp; null where malformed."""
    return F.try_to_timestamp(F.trim(c), F.lit("d-MMM-yyyy HH:mm:ss Z"))


def until(day: Column, limit: str) -> Column:
    """Whether an ISO string lies before the end of ``limit``: a bare date covers its whole day."""
    if len(limit) == 10:
        return day < F.date_add(F.to_date(F.lit(limit)), 1).cast("string")
    return day <= F.lit(limit)


#: Italian names of the days from Monday, English ones of the months as mail servers write them.
DAYS = ("lunedì", "martedì", "mercoledì", "giovedì", "venerdì", "sabato", "domenica")
SERVER_MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
_ISO = r"(\d{4})-(\d{2})-(\d{2})"
_SIGNED = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\b"
_WRITTEN = r"(?iU)\b(\d{1,2})\s+(" + "|".join(MONTHS) + r")\b"


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("int").cast("string"), 2, "0")


def _month(c: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{k:02d}"))]), F.lower(_part(c, _WRITTEN, 2)))


def short_date(c: Column) -> Column:
    """dd/mm of the first ISO, d/m/y or Italian written date of a text; other text trimmed, empty for null."""
    return F.coalesce(
        F.when(c.rlike(_ISO), F.concat_ws("/", _part(c, _ISO, 3), _part(c, _ISO, 2))), F.when(c.rlike(_SIGNED), F.concat_ws("/", _two(_part(c, _SIGNED, 1)), _two(_part(c, _SIGNED, 2)))),
        F.when(c.rlike(_WRITTEN), F.concat_ws("/", _two(_part(c, _WRITTEN, 1)), _month(c))), F.trim(c), F.lit(""),
    )


def deadline_key(deadline: Column, fallback: Column) -> Column:
    """STRUCT rank, day to sort by: rank 0 and an ISO day where the deadline can be read, else 1 and the fallback.

    A year of two digits is of this century, a written date without year comes after all others.
    """
    year = F.when(F.length(_part(deadline, _SIGNED, 3)) == 2, F.concat(F.lit("20"), _part(deadline, _SIGNED, 3))).otherwise(F.lpad(_part(deadline, _SIGNED, 3), 4, "0"))
    written = F.when(deadline.rlike(r"\b20\d{2}\b"), _part(deadline, r"\b(20\d{2})\b", 1)).otherwise("9999")
    day = F.coalesce(
        F.when(deadline.rlike(_ISO), _part(deadline, _ISO, 0)), F.when(deadline.rlike(_SIGNED), F.concat_ws("-", year, _two(_part(deadline, _SIGNED, 2)), _two(_part(deadline, _SIGNED, 1)))),
        F.when(deadline.rlike(_WRITTEN), F.concat_ws("-", written, _month(deadline), _two(_part(deadline, _WRITTEN, 1)))),
    )
    return F.struct(F.when(day.isNull(), 1).otherwise(0).alias("rank"), F.coalesce(day, fallback, F.lit("")).alias("day"))


def italian_date(day: Column) -> Column:
    """Weekday, day and month of a date in Italian words, null for null."""
    named = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), k)
    return F.when(day.isNotNull(), F.concat_ws(" ", named(DAYS, F.weekday(day) + 1), F.dayofmonth(day).cast("string"), named(MONTHS, F.month(day))))


def server_date(day: Column) -> Column:
    """A day as mail servers take it in searches: 02-Jan-2024."""
    month = F.element_at(F.array(*[F.lit(x) for x in SERVER_MONTHS]), F.month(day))
    return F.when(day.isNotNull(), F.concat_ws("-", F.lpad(F.dayofmonth(day).cast("string"), 2, "0"), month, F.year(day).cast("string")))


def certificate_date(day: Column, hour: Column, zone: Column) -> Column:
    """Instant of a certificate's d/m/y day, H:M[:S] hour and +hhmm zone (UTC where missing); null where unreadable."""
    d, h, z = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})", r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?", r"^\s*([+-])(\d{2}):?(\d{2})"
    second = F.when(_part(hour, h, 3) != "", _part(hour, h, 3)).otherwise("00")
    offset = F.when(zone.rlike(z), F.concat(_part(zone, z, 1), _part(zone, z, 2), F.lit(":"), _part(zone, z, 3))).otherwise("+00:00")
    text = F.concat(_part(day, d, 3), F.lit("-"), _two(_part(day, d, 2)), F.lit("-"), _two(_part(day, d, 1)), F.lit("T"), _two(_part(hour, h, 1)), F.lit(":"), _part(hour, h, 2), F.lit(":"), second, offset)
    return F.when(day.rlike(d) & hour.rlike(h), F.try_to_timestamp(text))
