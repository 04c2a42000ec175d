"""Character sets and the tone curve that maps gray levels to their characters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters from dark to bright.
STANDARD = " .'`^\"^:;Il!i><~+_-?[]{}1()|/\\tfjrxnuvczXYUJCLQ0OZmwqpbdkhao*#MW&8%B@$"
DETAILED = " .:-=+*#%@$WMB8"
CHARSETS = {"standard": STANDARD, "detailed": DETAILED}


def pick_charset(name: str | None) -> str:
    """By name, in any case; unknown names mean the standard set."""
    return CHARSETS.get((name or "").lower(), STANDARD)


def charset_name(col: Column) -> Column:
    low = F.lower(col)
    return F.when(low.isin(*CHARSETS), low).otherwise(F.lit("standard"))


def tone_index(gray: Column, size: int) -> Column:
    """Place in a set of ``size`` characters: the S-curve in integers, rounded to the nearest place."""
    last = size - 1
    low = 4 * gray * gray * last
    high = 2 * last * (65025 - 2 * (255 - gray) * (255 - gray))
    rounded = F.when(2 * gray < 255, low).otherwise(high) + 65025
    return F.least(F.lit(last), F.greatest(F.lit(0), F.floor(rounded / 130050).cast("int")))


def char_at(index: Column, chars: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in chars]), index + 1)


def lut(spark: SparkSession, charset: str) -> DataFrame:
    """(gray, idx, ch) for all 256 levels: a fixed dimension for broadcast joins."""
    chars = pick_charset(charset)
    g = spark.range(0, 256, 1, 1).select(F.col("id").cast("int").alias("gray"))
    return g.withColumn("idx", tone_index(F.col("gray"), len(chars))).withColumn("ch", char_at(F.col("idx"), chars))
