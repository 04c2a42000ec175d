"""Integer color arithmetic on Columns (0..255 in, 0..255 out)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luma weights of red, green and blue; they add up to 256.
LUMA = (54, 183, 19)


def _c(x: "Column | str | int") -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, int) else F.col(x)


def div(a: Column, b: int) -> Column:
    """Integer division of a non-negative number by a positive constant."""
    return F.floor((a - a % F.lit(b)) / F.lit(b)).cast("int")


def gray(r="r", g="g", b="b") -> Column:
    """Luma of a pixel: the weighted sum, shifted right by 8."""
    return F.shiftright((LUMA[0] * _c(r) + LUMA[1] * _c(g) + LUMA[2] * _c(b)).cast("int"), 8)


def tint_background(c) -> Column:
    """15 % of a channel."""
    return div(_c(c) * 3, 20)


def tint_stroke(c) -> Column:
    """125 % of a channel, at most 255."""
    return F.least(F.lit(255), div(_c(c) * 5, 4))


def blend(stroke, background, alpha) -> Column:
    """stroke over background by alpha; both end cases agree with the formula."""
    return div(_c(stroke) * _c(alpha) + _c(background) * (255 - _c(alpha)), 255)


def mask(r="r", g="g", b="b") -> Column:
    """Coverage of a white-on-black glyph pixel."""
    return F.greatest(_c(r), _c(g), _c(b))
