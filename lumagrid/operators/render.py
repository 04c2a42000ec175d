"""Cells to pixels: glyph masks, tints, blending, clipping and the black margin."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import blend, tint_background, tint_stroke

#: Font families to look for, after the configured one.
FONT_CANDIDATES = ("Consolas", "Cascadia Mono", "Cascadia Code", "DejaVu Sans Mono", "Liberation Mono", "FreeMono", "Courier New", "Courier")
FALLBACK_FONT = "monospace"


def char_code(ch: str = "ch"):
    """Code of a character; what is over 255 is drawn as a space."""
    return F.when(F.ascii(ch) < 256, F.ascii(ch)).otherwise(32)


def text_cells(texts: DataFrame, columns: int, rows: int) -> DataFrame:
    """(frame_id, art) -> (frame_id, ty, tx, code), clipped to the grid; ragged lines leave cells out."""
    line = texts.select("frame_id", F.posexplode(F.split("art", "\n")).alias("ty", "line")).filter(F.col("ty") < rows)
    ch = line.select("frame_id", "ty", F.posexplode(F.filter(F.split(F.substring("line", 1, columns), ""), lambda c: c != "")).alias("tx", "ch"))
    return ch.select("frame_id", "ty", "tx", char_code().cast("int").alias("code"))


def _placed(cells: DataFrame, atlas: DataFrame, cw: int, ch: int, width: int, height: int) -> DataFrame:
    """Cells meet their glyph's pixels (256 * cw * ch rows, broadcast); what is outside the output is dropped."""
    reach = cells.filter((F.col("tx") * cw < width) & (F.col("ty") * ch < height))
    p = reach.join(F.broadcast(atlas), "code").withColumns({"px": F.col("tx") * cw + F.col("cx"), "py": F.col("ty") * ch + F.col("cy")})
    return p.filter((F.col("px") < width) & (F.col("py") < height))


def render_mono(cells: DataFrame, atlas: DataFrame, cw: int, ch: int, width: int, height: int, foreground=(255, 255, 255), background=(0, 0, 0)) -> DataFrame:
    """(frame_id, py, px, r, g, b) of covered pixels."""
    p = _placed(cells, atlas, cw, ch, width, height)
    return p.select("frame_id", "py", "px", *[blend(f, b, "alpha").alias(n) for n, f, b in zip("rgb", foreground, background, strict=True)])


def render_color(cells: DataFrame, atlas: DataFrame, cw: int, ch: int, width: int, height: int) -> DataFrame:
    """Cells with code, r, g, b; a cell without a color is drawn on black in black."""
    p = _placed(cells.fillna(0, ["r", "g", "b"]), atlas, cw, ch, width, height)
    return p.select("frame_id", "py", "px", *[blend(tint_stroke(c), tint_background(c), "alpha").alias(c) for c in "rgb"])


def full_frame(pixels: DataFrame, frames: DataFrame, width: int, height: int) -> DataFrame:
    """All pixels of each frame; what no cell covers is black."""
    at = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1))).alias("at")
    grid = frames.select("frame_id").distinct().select("frame_id", at)
    grid = grid.select("frame_id", F.floor(F.col("at") / width).cast("int").alias("py"), (F.col("at") % width).cast("int").alias("px"))
    return grid.join(pixels, ["frame_id", "py", "px"], "left").fillna(0, ["r", "g", "b"])


def first_font(installed: DataFrame, configured: str | None) -> DataFrame:
    """The first candidate that is installed (in any case), else the fallback: one row (family)."""
    spark = installed.sparkSession
    names = [c for c in (configured, *FONT_CANDIDATES) if c]
    wanted = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "prio int, family string")
    have = installed.select(F.lower("family").alias("low")).distinct()
    hit = wanted.join(have, F.lower("family") == F.col("low"), "left_semi")
    last = spark.createDataFrame([(len(names), FALLBACK_FONT)], "prio int, family string")
    return hit.union(last).orderBy("prio").limit(1).select("family")


def awt_atlas(spark: SparkSession, family: str, size: float, cw: int, ch: int) -> DataFrame:
    """Glyph masks drawn once by the driver's JVM: (code, cy, cx, alpha), at most 94 * cw * ch rows with ink.

    Glyphs are centered by their ink's width and by the font's ascent and descent. Masks depend on the
    installed fonts; ship them as a table if they have to be the same everywhere.
    """
    awt = spark._jvm.java.awt
    image = awt.image.BufferedImage(cw, ch, awt.image.BufferedImage.TYPE_BYTE_GRAY)
    pen = image.createGraphics()
    font = awt.Font(family, awt.Font.PLAIN, 1).deriveFont(float(size))
    pen.setRenderingHint(awt.RenderingHints.KEY_TEXT_ANTIALIASING, awt.RenderingHints.VALUE_TEXT_ANTIALIAS_ON)
    pen.setFont(font)
    context, metrics = pen.getFontRenderContext(), pen.getFontMetrics()
    top = (ch - (metrics.getAscent() + metrics.getDescent())) * 0.5 + metrics.getAscent()
    rows = []
    for code in range(256):
        pen.setColor(awt.Color.BLACK)
        pen.fillRect(0, 0, cw, ch)
        if 32 < code < 127:
            ink = font.createGlyphVector(context, chr(code)).getVisualBounds()
            pen.setColor(awt.Color.WHITE)
            pen.drawString(chr(code), float((cw - ink.getWidth()) * 0.5 - ink.getX()), float(top))
        raster = image.getRaster()
        rows += [(code, y, x, raster.getSample(x, y, 0) if 32 < code < 127 else 0) for y in range(ch) for x in range(cw)]
    pen.dispose()
    return spark.createDataFrame(rows, "code int, cy int, cx int, alpha int")
