"""Names, ratings and text of reports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error codes and their names.
ERROR_NAMES = {-1: "InvalidData", -2: "NotFound", -5: "IOError", -11: "EAGAIN", -22: "InvalidArgument"}
#: Milliseconds a frame up to which a rating holds.
RATINGS = ((30, "excellent"), (50, "good"), (100, "fair"))
BAR = 30


def error_name(code: Column) -> Column:
    out = F.lit("Unknown")
    for k, name in ERROR_NAMES.items():
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def rating(ms: Column) -> Column:
    out = F.lit("poor")
    for most, name in reversed(RATINGS):
        out = F.when(ms <= most, F.lit(name)).otherwise(out)
    return out


def progress_bar(percent: Column) -> Column:
    full = F.floor(percent / 100 * BAR).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(BAR) - full), F.lit("]"))


def video_text(width: Column, height: Column, rate: Column, seconds: Column, count: Column, codec: Column) -> Column:
    return F.format_string("Video: %dx%d, %.2f FPS, %.2fs, %d frames, %s", width.cast("long"), height.cast("long"), rate, seconds, count, codec)
