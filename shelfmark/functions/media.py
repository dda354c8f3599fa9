"""What a file is, and what the service would make of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark import constants as C
from shelfmark.functions.paths import extension


def is_supported(path: Column) -> Column:
    return extension(path).isin(C.SUPPORTED_EXTENSIONS)


def is_raw(path: Column) -> Column:
    return extension(path).isin(C.RAW_EXTENSIONS)


def is_convertible(path: Column) -> Column:
    return extension(path).isin(C.CONVERTIBLE_EXTENSIONS)


def is_renderable(path: Column) -> Column:
    return extension(path).isin(C.RAW_EXTENSIONS + C.CONVERTIBLE_EXTENSIONS)


def is_camera_jpeg(path: Column) -> Column:
    return extension(path).isin(C.CAMERA_JPEG_EXTENSIONS)


def is_still(path: Column) -> Column:
    return extension(path).isin(C.STILL_EXTENSIONS + C.RAW_EXTENSIONS)


def is_live_video(path: Column) -> Column:
    return extension(path).isin(C.LIVE_VIDEO_EXTENSIONS)


def is_dated_video(path: Column) -> Column:
    return extension(path).isin(C.DATED_VIDEO_EXTENSIONS)


def media_class(path: Column) -> Column:
    return F.struct(
        is_supported(path).alias("supported"),
        is_raw(path).alias("raw"),
        is_convertible(path).alias("convertible"),
        is_renderable(path).alias("renderable"),
        is_still(path).alias("still"),
        is_live_video(path).alias("live_video"),
        is_dated_video(path).alias("dated_video"),
    )


def is_video_format(fmt: Column) -> Column:
    return F.coalesce(F.upper(fmt).isin(C.VIDEO_FORMATS), F.lit(False))


def video_refusal(
    path: Column,
    unfinished: Column,
    duration_s: Column,
    short_side: Column,
    max_minutes: int = C.MAX_VIDEO_MINUTES,
) -> Column:
    """(code, reason) of the first refusal a video would meet, else null."""
    def refusal(code: int, reason: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))

    too_long = (F.lit(max_minutes) > 0) & (F.floor(duration_s) > max_minutes * 60)
    return F.when(
        is_dated_video(path),
        F.when(unfinished, refusal(C.CODE_UNFINISHED, C.REASON_UNFINISHED))
        .when(too_long, refusal(C.CODE_TOO_LONG, C.REASON_TOO_LONG))
        .when(short_side < C.MIN_VIDEO_SIDE, refusal(C.CODE_TOO_SMALL, C.REASON_TOO_SMALL)),
    )


def outcome_class(status: Column, code: Column) -> Column:
    """ok, refused (permanent) or failed (planned again next run)."""
    return (
        F.when(status.isin(C.PERMANENT_STATUSES), "refused")
        .when(~status.between(200, 299), "failed")
        .when(code.isin(C.PERMANENT_CODES), "refused")
        .when(code.isNotNull(), "failed")
        .otherwise("ok")
    )
