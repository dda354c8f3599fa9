"""Capture dates and the camera's clock.

Nothing here reads the wall clock: `as_of` is passed in, so that a plan made
twice from the same tables gives the same rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.media import is_dated_video
from shelfmark.functions.paths import file_name

# Digit runs that may hold a date: 13 or 10 digits, 8 digits, or a year
# followed by two more numbers with one repeated separator.
_RUNS = (
    r"(?<![0-9])([0-9]{13}(?![0-9])|[0-9]{10}(?![0-9])|[0-9]{8}(?![0-9])"
    r"|[0-9]{4}([-_.])[0-9]{2}\2[0-9]{2}(?![0-9]))"
)


def as_date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def plausible(date: Column, earliest_year: int, as_of: dt.date | str) -> Column:
    return F.coalesce((F.year(date) >= earliest_year) & (date <= F.date_add(as_date(as_of), 1)), F.lit(False))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated, and planned, once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _if_plausible(date: Column, earliest_year: int, as_of: dt.date | str) -> Column:
    return _bound(date, lambda d: F.when(plausible(d, earliest_year, as_of), d))


def local_date(seconds: Column, tz: str) -> Column:
    """Date shown in `tz` at a Unix time, whatever the session's zone."""
    # Header clocks may hold any 64-bit number; past year 9999 is no date.
    seconds = F.when(F.abs(seconds) < 253_402_300_800, seconds)
    if tz == "UTC":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    interval = F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    utc = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + interval
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc).cast("date")


def ymd(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def file_name_date(name: Column, as_of: dt.date | str, tz: str = "UTC") -> Column:
    """First valid date in a file name, left to right."""
    def run_date(run: Column) -> Column:
        n = F.length(run)
        digits = F.regexp_replace(run, "[-_.]", "")
        by_digits = _if_plausible(
            ymd(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)),
            C.EARLIEST_NAME_YEAR, as_of,
        )
        number = run.try_cast("bigint")
        seconds = F.when(n == 13, F.floor(number / 1000)).otherwise(number)
        by_epoch = _if_plausible(local_date(seconds, tz), C.EARLIEST_NAME_EPOCH_YEAR, as_of)
        is_epoch = run.rlike("^([0-9]{13}|[0-9]{10})$")
        return F.when(is_epoch, by_epoch).otherwise(by_digits)

    dates = F.transform(F.regexp_extract_all(name, F.lit(_RUNS), F.lit(1)), run_date)
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull()), F.lit(1))


def exif_date(text: Column, as_of: dt.date | str) -> Column:
    """`YYYY:MM:DD...`, or with `-`, `/` or `.` in both places."""
    head = F.substring(text, 1, 10)
    date = F.try_to_date(F.translate(head, ":/.", "---"), "yyyy-MM-dd")
    return F.when(
        head.rlike(r"^[0-9]{4}([:/.-])[0-9]{2}\1[0-9]{2}$"),
        _if_plausible(date, C.EARLIEST_EXIF_YEAR, as_of),
    )


def video_date(apple_date: Column, mvhd_seconds: Column, as_of: dt.date | str, tz: str = "UTC") -> Column:
    head = F.substring(apple_date, 1, 10)
    apple = F.when(
        head.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
        _if_plausible(F.try_to_date(head, "yyyy-MM-dd"), C.EARLIEST_VIDEO_YEAR, as_of),
    )
    first = C.QUICKTIME_EPOCH_OFFSET + C.UNSET_CLOCK_SECONDS
    header = F.when(
        mvhd_seconds >= first,
        _if_plausible(
            local_date(mvhd_seconds - F.lit(C.QUICKTIME_EPOCH_OFFSET), tz), C.EARLIEST_VIDEO_YEAR, as_of
        ),
    )
    return F.coalesce(apple, header)


def modified_date(mtime_ns: Column, tz: str = "UTC") -> Column:
    # Integer floor: a double does not hold nanoseconds exactly.
    second = F.lit(1_000_000_000)
    seconds = F.call_function("div", mtime_ns - F.pmod(mtime_ns, second), second)
    return local_date(seconds, tz)


def metadata_date(
    path: Column, exif_original: Column, exif_digitized: Column,
    apple_date: Column, mvhd_seconds: Column, as_of: dt.date | str, tz: str = "UTC",
) -> Column:
    """Date from metadata alone, for dating a live video by its photo."""
    return F.coalesce(
        exif_date(exif_original, as_of),
        exif_date(exif_digitized, as_of),
        F.when(is_dated_video(path), video_date(apple_date, mvhd_seconds, as_of, tz)),
    )


def dated_by(date: Column, source: str) -> Column:
    """(day, date_source), null without a date."""
    return _bound(
        date, lambda d: F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(source).alias("date_source")))
    )


def capture_date(
    path: Column, mtime_ns: Column, exif_original: Column, exif_digitized: Column,
    exif_modified: Column, apple_date: Column, mvhd_seconds: Column,
    as_of: dt.date | str, tz: str = "UTC",
) -> Column:
    """(day, date_source): the first date found, strongest hint first."""
    return F.coalesce(
        dated_by(exif_date(exif_original, as_of), C.DATED_BY_EXIF),
        dated_by(exif_date(exif_digitized, as_of), C.DATED_BY_EXIF),
        dated_by(
            F.when(is_dated_video(path), video_date(apple_date, mvhd_seconds, as_of, tz)), C.DATED_BY_VIDEO
        ),
        dated_by(file_name_date(file_name(path), as_of, tz), C.DATED_BY_NAME),
        dated_by(exif_date(exif_modified, as_of), C.DATED_BY_EXIF_MODIFIED),
        dated_by(modified_date(mtime_ns, tz), C.DATED_BY_MTIME),
    )


def day_name(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def day_path(day: Column) -> Column:
    """Names from the root down: year, month, day album."""
    return F.array(F.date_format(day, "yyyy"), F.date_format(day, "MM"), day_name(day))


def camera_time(instant_utc: Column) -> Column:
    """Camera clock (no zone) behind an instant given as UTC without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(C.CAMERA_ZONE), instant_utc)


def stored_span(camera: Column) -> Column:
    """(lo, hi): UTC instants, without zone, a camera clock time may be stored as.

    Daylight saving is seven hours behind UTC and standard time eight. A clock
    time that neither reading gives back was skipped, and may be either.
    """
    summer = camera + F.expr("interval 7 hours")
    winter = camera + F.expr("interval 8 hours")
    is_summer = camera_time(summer) == camera
    is_winter = camera_time(winter) == camera
    neither = ~is_summer & ~is_winter
    return F.struct(
        F.when(is_summer | neither, summer).otherwise(winter).alias("lo"),
        F.when(is_winter | neither, winter).otherwise(summer).alias("hi"),
    )


def parse_bound(text: str, end: bool) -> dt.datetime:
    """A date bound typed by a user; a missing time is the start or the last second."""
    value = text.strip()
    spaced = value.replace("T", " ", 1)
    for pattern, rest in (("%Y-%m-%d %H:%M:%S", 0), ("%Y-%m-%d %H:%M", 59)):
        try:
            return dt.datetime.strptime(spaced, pattern) + dt.timedelta(seconds=rest if end else 0)
        except ValueError:
            pass
    try:
        day = dt.datetime.strptime(value, "%Y-%m-%d")
    except ValueError:
        raise ValueError(f"not a date: {text!r}") from None
    return day + dt.timedelta(seconds=86399 if end else 0)
