"""Pixels to cells: bounds, assignment and means.

A cell's bounds are floor(i * (size / cells)) in double precision, so a plain x * cells div size is not
always the same and the last pixel can be outside every cell. The range join of pixels with bounds is done as
two small hash joins with one row per coordinate (at most the frame's width and height).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tone import char_at, pick_charset, tone_index


def axis_bounds(size: int, cells: int) -> list[tuple[int, int]]:
    """Half-open bounds of each cell of an axis; empty where both agree."""
    if size <= 0 or cells <= 0:
        raise ValueError("sizes must be positive")
    scale = size / cells
    return [(int(i * scale), min(int((i + 1) * scale), size)) for i in range(cells)]


def bounds_frame(spark: SparkSession, axis: str, size: int, cells: int) -> DataFrame:
    rows = [(axis, i, lo, hi) for i, (lo, hi) in enumerate(axis_bounds(size, cells))]
    return spark.createDataFrame(rows, "axis string, cell int, lo int, hi int")


def axis_lookup(spark: SparkSession, at: str, cell: str, size: int, cells: int) -> DataFrame:
    """(coordinate, cell), one row per covered coordinate."""
    rows = [(p, i) for i, (lo, hi) in enumerate(axis_bounds(size, cells)) for p in range(lo, hi)]
    return spark.createDataFrame(rows, f"{at} int, {cell} int")


def assign_cells(pixels: DataFrame, width: int, height: int, columns: int, rows: int) -> DataFrame:
    """Adds ty, tx; pixels outside every cell are dropped."""
    spark = pixels.sparkSession
    xs, ys = axis_lookup(spark, "x", "tx", width, columns), axis_lookup(spark, "y", "ty", height, rows)
    return pixels.join(F.broadcast(xs), "x").join(F.broadcast(ys), "y")


def cell_means(pixels: DataFrame, width: int, height: int, columns: int, rows: int, channels=("gray",), fill: bool = True) -> DataFrame:
    """(frame_id, ty, tx, channels): truncated means; with fill, cells without a pixel have gray 0 and color 255.

    The grid of a frame is made by exploding its cell numbers, so every frame that occurs has all cells.
    """
    sums = [F.sum(c).alias(f"s_{c}") for c in channels]
    mean = lambda c: F.expr(f"s_{c} div n").cast("int").alias(c)
    got = assign_cells(pixels, width, height, columns, rows).groupBy("frame_id", "ty", "tx").agg(*sums, F.count("*").alias("n")).select("frame_id", "ty", "tx", *map(mean, channels))
    if not fill:
        return got
    cell = F.explode(F.sequence(F.lit(0), F.lit(columns * rows - 1))).alias("cell")
    grid = pixels.select("frame_id").distinct().select("frame_id", cell)
    grid = grid.select("frame_id", F.floor(F.col("cell") / columns).cast("int").alias("ty"), (F.col("cell") % columns).cast("int").alias("tx"))
    empty = {c: 0 if c == "gray" else 255 for c in channels}
    return grid.join(got, ["frame_id", "ty", "tx"], "left").fillna(empty)


def map_chars(cells: DataFrame, charset: str = "standard") -> DataFrame:
    """Adds ch by gray: the tone curve's 256 levels are a constant array, so no join is needed."""
    chars = pick_charset(charset)
    return cells.withColumn("ch", char_at(tone_index(F.col("gray"), len(chars)), chars))


def row_text(cells: DataFrame) -> DataFrame:
    """(frame_id, ty, line): characters in column order."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tx", "ch"))), lambda s: s["ch"]), "")
    return cells.groupBy("frame_id", "ty").agg(line.alias("line"))


def frame_text(cells: DataFrame) -> DataFrame:
    """(frame_id, art): rows joined by line feeds; one exchange by frame does for both steps."""
    lines = row_text(cells.repartition("frame_id"))
    art = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ty", "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy("frame_id").agg(art.alias("art"))
