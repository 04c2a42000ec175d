"""Frames out of the provided tables and out of formulas."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _byte(col) -> "F.Column":
    return (col % 256).cast("int")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordinal_pixels(df: DataFrame, ordinal: str, width: int, height: int, r, g, b, *more) -> DataFrame:
    """Rows numbered from 0 become the pixels of frames of width * height, row by row."""
    n, i = width * height, F.col(ordinal)
    return df.select(
        F.floor((i - i % n) / n).cast("long").alias("frame_id"),
        F.floor((i % n - i % width) / width).cast("int").alias("y"),
        (i % width).cast("int").alias("x"),
        _byte(r).alias("r"),
        _byte(g).alias("g"),
        _byte(b).alias("b"),
        *more,
    )


def events_pixels(events: DataFrame, *more) -> DataFrame:
    """40 x 25 pixels a frame."""
    return ordinal_pixels(events, "event_id", 40, 25, F.floor("value"), F.col("user_id") * 7, F.col("event_id") * 13, *more)


def orders_pixels(orders: DataFrame) -> DataFrame:
    """50 x 30 pixels a frame."""
    return ordinal_pixels(orders, "o_orderkey", 50, 30, F.col("o_custkey"), F.floor("o_totalprice"), F.col("o_orderkey"))


def embedding_tiles(embeddings: DataFrame) -> DataFrame:
    """Vectors of 64 as 8 x 8 gray tiles."""
    e = embeddings.select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("p", "v"))
    level = F.floor((F.col("v").cast("double") + 1) * 127.5)
    return e.select("frame_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.least(F.lit(255), F.greatest(F.lit(0), level)).cast("int").alias("gray"))


def text_codes(documents: DataFrame, columns: int, rows: int) -> DataFrame:
    """Characters of a text clipped to a grid; codes over 255 become a space."""
    line = documents.select(F.col("doc_id").alias("frame_id"), F.posexplode(F.split("text", "\n")).alias("ty", "line")).filter(F.col("ty") < rows)
    ch = line.select("frame_id", "ty", F.posexplode(F.filter(F.split(F.substring("line", 1, columns), ""), lambda c: c != "")).alias("tx", "ch"))
    code = F.ascii("ch")
    return ch.select("frame_id", "ty", "tx", F.when(code < 256, code).otherwise(32).alias("code"))


def test_card(spark: SparkSession, width: int, height: int, frames: int) -> DataFrame:
    n, i = width * height, F.col("id")
    p = spark.range(n * frames).select(F.floor(i / n).cast("long").alias("frame_id"), F.floor((i % n) / width).cast("int").alias("y"), (i % width).cast("int").alias("x"))
    x, y, f = F.col("x"), F.col("y"), F.col("frame_id")
    return p.select("frame_id", "y", "x", _byte(7 * x + 3 * y + 5 * f).alias("r"), _byte(2 * x + 11 * y + 13 * f).alias("g"), _byte(x * x + y * y + 17 * f).alias("b"))


def synthetic_mask(spark: SparkSession, cell_width: int, cell_height: int) -> DataFrame:
    """A glyph mask with every level, for tests: (code, cy, cx, alpha); only codes 33..126 have ink."""
    n, i = cell_width * cell_height, F.col("id")
    m = spark.range(0, 256 * n, 1, 1).select(F.floor(i / n).cast("int").alias("code"), F.floor((i % n) / cell_width).cast("int").alias("cy"), (i % cell_width).cast("int").alias("cx"))
    ink = (F.col("code") * 37 + F.col("cy") * 101 + F.col("cx") * 53) % 256
    return m.withColumn("alpha", F.when(F.col("code").between(33, 126), ink).otherwise(0).cast("int"))


def event_packets(events: DataFrame) -> DataFrame:
    """Packets for the demux operators: streams 0 (video), 1 (audio), 2 (data)."""
    s = F.pmod("user_id", F.lit(3)).cast("int")
    return events.select(
        F.floor(F.col("event_id") / 1000).cast("string").alias("video_id"),
        F.col("event_id").alias("seq"),
        s.alias("stream_index"),
        F.element_at(F.array(F.lit("video"), F.lit("audio"), F.lit("data")), s + 1).alias("kind"),
        (F.col("event_id") * 1024).alias("pts"),
    )


def event_timings(events: DataFrame) -> DataFrame:
    """Stage times: five stages a frame, whole milliseconds."""
    stage = F.element_at(F.array(*[F.lit(x) for x in ("decode", "grayscale", "mapping", "render", "encode")]), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(F.floor(F.col("event_id") / 5).cast("long").alias("frame_id"), stage.alias("stage"), F.floor(F.col("value") / 10).cast("long").alias("elapsed_ms"))
