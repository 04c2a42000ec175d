"""Sizes, rates and container metadata, as Columns and as plain numbers for planning."""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_WIDTH = 240
DEFAULT_RATE = 30.0


@dataclass(frozen=True)
class Grid:
    """A planned conversion: frame size, grid size and cell size; the output has the frame's size."""

    width: int
    height: int
    columns: int
    rows: int
    cell_width: int
    cell_height: int


def plan_grid(width: int, height: int, columns: int = 0, rows: int = 0) -> Grid:
    if width <= 0 or height <= 0:
        raise ValueError("a frame needs a positive width and height")
    columns = columns if columns > 0 else DEFAULT_WIDTH
    rows = rows if rows > 0 else max(1, round(columns * (height / width)))
    return Grid(width, height, columns, rows, max(1, round(width / columns)), max(1, round(height / rows)))


def grid_columns(option: Column) -> Column:
    return F.when(option > 0, option).otherwise(F.lit(DEFAULT_WIDTH)).cast("int")


def grid_rows(columns: Column, width: Column, height: Column, option: Column) -> Column:
    auto = F.greatest(F.lit(1), F.bround(columns * (height.cast("double") / width)).cast("int"))
    return F.when(option > 0, option).otherwise(auto).cast("int")


def cell_size(size: Column, cells: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(size.cast("double") / cells).cast("int"))


def font_size(option: Column, cell_height: Column) -> Column:
    """The option, unless it is not positive or exactly 14, which mean automatic."""
    auto = F.greatest(F.lit(6.0), cell_height * F.lit(0.95))
    return F.when((option <= 0) | (option == 14), auto).otherwise(option.cast("double"))


def frame_rate(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den.cast("double")).otherwise(F.lit(DEFAULT_RATE))


def output_rate(option: Column, source: Column) -> Column:
    return F.when(option > 0, option.cast("double")).when(source > 0, source).otherwise(F.lit(DEFAULT_RATE))


def frame_count(nb_frames: Column, duration_us: Column, rate: Column) -> Column:
    known = F.when((duration_us > 0) & (rate > 0), F.floor(duration_us * rate / 1e6)).otherwise(F.lit(0))
    return F.when(nb_frames > 0, nb_frames).otherwise(known).cast("long")


def duration_seconds(count: Column, rate: Column) -> Column:
    return F.when((count > 0) & (rate > 0), count / rate).otherwise(F.lit(0.0))


def seek_microseconds(frame: Column, rate: Column) -> Column:
    return F.floor(frame / rate * 1e6).cast("long")
