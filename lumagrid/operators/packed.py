"""Packed frames (one row a frame) through numpy kernels in Arrow batches; same results as the pixel form."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import LUMA
from ..functions.tone import pick_charset
from .cells import axis_bounds


def pack_pixels(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(frame_id, width, height, data): RGB24 of frames whose pixels are all there."""
    item = F.struct((F.col("y") * width + F.col("x")).alias("i"), F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgb"]).alias("h"))
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["h"]), "")
    return pixels.groupBy("frame_id").agg(F.unhex(hexes).alias("data")).select("frame_id", F.lit(width).alias("width"), F.lit(height).alias("height"), "data")


def unpack(frames: DataFrame, names=("r", "g", "b")) -> DataFrame:
    """(frame_id, width, data) -> (frame_id, y, x, channels)."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f, w, d in zip(b.column("frame_id").to_pylist(), b.column("width").to_pylist(), b.column("data"), strict=True):
                v = np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, k).astype(np.int32)
                i = np.arange(len(v), dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array(np.full(len(v), f, np.int64)), "y": i // w, "x": i % w} | {n: v[:, j].copy() for j, n in enumerate(names)})

    return frames.select("frame_id", "width", "data").mapInArrow(run, "frame_id long, y int, x int, " + ", ".join(f"{n} int" for n in names))


def _gray_planes(planes: np.ndarray) -> np.ndarray:
    """uint8 (3, ...) -> uint8; the weighted sum is at most 65280, so 16 bits do."""
    total = planes[0] * np.uint16(LUMA[0])
    total += planes[1] * np.uint16(LUMA[1])
    total += planes[2] * np.uint16(LUMA[2])
    total >>= 8
    return total.astype(np.uint8)


def packed_gray(frames: DataFrame) -> DataFrame:
    """RGB24 -> one byte a pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [_gray_planes(np.frombuffer(d.as_buffer(), np.uint8).reshape(-1, 3).T).tobytes() for d in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("width"), b.column("height"), pa.array(data, pa.binary())], names=["frame_id", "width", "height", "data"])

    return frames.select("frame_id", "width", "height", "data").mapInArrow(run, "frame_id long, width int, height int, data binary")


def _axis_sums(a: np.ndarray, bounds: list[tuple[int, int]], axis: int) -> np.ndarray:
    """Sums over half-open bounds of one of the last two axes; empty bounds give 0. Bounds have no gaps."""
    lo, hi = np.array(bounds).T
    inside = a[:, : hi[-1]] if axis == 1 else a[:, :, : hi[-1]]
    k = hi[0] - lo[0]
    if k and (hi - lo == k).all():  # equal cells: a plain sum over a split axis, which numpy vectorises
        kind = np.uint16 if a.dtype == np.uint8 and k <= 257 else np.int32
        split = inside.shape[:axis] + (len(bounds), k) + inside.shape[axis + 1 :]
        return inside.reshape(split).sum(axis=axis + 1, dtype=kind)
    full = np.flatnonzero(hi > lo)
    sums = np.add.reduceat(inside, lo[full], axis=axis, dtype=np.int32)
    if len(full) == len(bounds):
        return sums
    out = np.zeros(a.shape[:axis] + (len(bounds),) + a.shape[axis + 1 :], np.int32)
    if axis == 1:
        out[:, full] = sums
    else:
        out[:, :, full] = sums
    return out


def cell_arrays(rgb: np.ndarray, columns: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(h, w, 3) -> gray (rows, columns) and color (rows, columns, 3), with the defaults of empty cells."""
    h, w, _ = rgb.shape
    xs, ys = axis_bounds(w, columns), axis_bounds(h, rows)
    planes = np.ascontiguousarray(np.moveaxis(rgb, 2, 0))
    s = np.concatenate([_axis_sums(_axis_sums(p, ys, 1), xs, 2).astype(np.int32) for p in (planes, _gray_planes(planes)[None])])
    n = np.outer([b - a for a, b in ys], [b - a for a, b in xs])
    mean = s // np.maximum(n, 1)
    mean[:3, n == 0] = 255
    return mean[3], np.moveaxis(mean[:3], 0, 2)


def packed_cells(frames: DataFrame, columns: int, rows: int) -> DataFrame:
    """(frame_id, ty, tx, gray, r, g, b): one row a cell straight from the frame's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(columns * rows, dtype=np.int32)
        for b in batches:
            for f, w, h, d in zip(*(b.column(c).to_pylist() for c in ("frame_id", "width", "height")), b.column("data"), strict=True):
                gray, rgb = cell_arrays(np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, 3), columns, rows)
                flat = rgb.reshape(-1, 3).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"frame_id": pa.array(np.full(len(i), f, np.int64)), "ty": i // columns, "tx": i % columns, "gray": gray.ravel().astype(np.int32)} | {n: flat[:, j].copy() for j, n in enumerate("rgb")})

    return frames.select("frame_id", "width", "height", "data").mapInArrow(run, "frame_id long, ty int, tx int, gray int, r int, g int, b int")


def packed_render(frames: DataFrame, atlas: DataFrame, columns: int, rows: int, cw: int, ch: int, charset: str = "standard", color: bool = True) -> DataFrame:
    """Color frame -> rendered frame of the same size, all stages fused: one row in, one row out.

    The atlas (256 * cw * ch numbers) goes along with the task.
    """
    masks = np.zeros((256, ch, cw), np.uint16)
    for r in atlas.filter("alpha > 0").collect():  # at most 94 * cw * ch rows
        masks[r["code"], r["cy"], r["cx"]] = r["alpha"]
    chars = pick_charset(charset)
    last = len(chars) - 1
    level = np.arange(256)
    index = (np.where(2 * level < 255, 4 * level * level * last, 2 * last * (65025 - 2 * (255 - level) ** 2)) + 65025) // 130050
    codes = np.array([ord(c) for c in chars], np.uint8)[np.clip(index, 0, last)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for w, h, d in zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("data"), strict=True):
                gray, rgb = cell_arrays(np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, 3), columns, rows)
                alpha = masks[codes[gray]].transpose(0, 2, 1, 3).reshape(rows, ch, columns * cw)
                image = np.zeros((h, w, 3), np.uint8)
                high, wide = min(h, rows * ch), min(w, columns * cw)
                if color:
                    under, over = (rgb * 3 // 20).astype(np.uint16), np.minimum(255, rgb * 5 // 4).astype(np.uint16)
                    for k in range(3):
                        # stroke * a + under * (255 - a), divided by 255 exactly for what fits 16 bits.
                        value = alpha * np.repeat(over[..., k] - under[..., k], cw, 1)[:, None, :]
                        value += np.repeat(under[..., k] * np.uint16(255), cw, 1)[:, None, :]
                        value += value >> 8
                        value += 1
                        value >>= 8
                        image[:high, :wide, k] = value.reshape(rows * ch, columns * cw)[:high, :wide]
                else:
                    image[:high, :wide] = alpha.reshape(rows * ch, columns * cw)[:high, :wide, None]
                out.append(image.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], names=["frame_id", "width", "height", "data"])

    return frames.select("frame_id", "width", "height", "data").mapInArrow(run, "frame_id long, width int, height int, data binary")


def to_yuv(rgb: np.ndarray) -> list[np.ndarray]:
    """(h, w, 3) -> planes y, u, v of 4:2:0 in limited range; a 2 x 2 mean makes the chroma, so sizes have to be even."""
    h, w, _ = rgb.shape
    if w % 2 or h % 2:
        raise ValueError("4:2:0 needs an even width and height")
    r, g, b = np.moveaxis(rgb.astype(np.int32), 2, 0)
    y = ((66 * r + 129 * g + 25 * b + 128) >> 8) + 16
    u, v = ((-38 * r - 74 * g + 112 * b + 128) >> 8) + 128, ((112 * r - 94 * g - 18 * b + 128) >> 8) + 128
    half = [(p.reshape(h // 2, 2, w // 2, 2).sum((1, 3)) + 2) >> 2 for p in (u, v)]
    return [p.astype(np.uint8) for p in (y, *half)]


def from_yuv(planes: list[np.ndarray], shared: tuple[int, int]) -> np.ndarray:
    """Planes in limited range -> (h, w, 3); a chroma sample counts for all ``shared`` (columns, rows) of its pixels."""
    h, w = planes[0].shape
    y = 298 * (planes[0].astype(np.int32) - 16) + 128
    if len(planes) == 1:
        u = v = np.zeros_like(y)
    else:
        u, v = (p.astype(np.int32).repeat(shared[1], 0).repeat(shared[0], 1)[:h, :w] - 128 for p in planes[1:])
    rgb = np.stack([y + 409 * v, y - 100 * u - 208 * v, y + 516 * u], 2) >> 8
    return np.clip(rgb, 0, 255).astype(np.uint8)


def yuv420p(frames: DataFrame) -> DataFrame:
    """RGB24 -> planar YUV 4:2:0 (``to_yuv``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(b.column("width").to_pylist(), b.column("height").to_pylist(), b.column("data"), strict=True)
            out = [b"".join(p.tobytes() for p in to_yuv(np.frombuffer(d.as_buffer(), np.uint8).reshape(h, w, 3))) for w, h, d in sizes]
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], names=["frame_id", "width", "height", "data"])

    return frames.select("frame_id", "width", "height", "data").mapInArrow(run, "frame_id long, width int, height int, data binary")


def unpack_yuv420p(frames: DataFrame) -> DataFrame:
    """(frame_id, plane, y, x, v): planes 0 to 2, chroma at half the size."""
    n, i = F.col("width") * F.col("height"), F.col("i")
    at = frames.select("*", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i"))
    plane = F.when(i < n, 0).when(i < n + n / 4, 1).otherwise(2)
    at = at.select("frame_id", plane.alias("plane"), (i - F.when(plane == 0, 0).when(plane == 1, n).otherwise(n + n / 4)).cast("int").alias("k"), F.when(plane == 0, F.col("width")).otherwise((F.col("width") / 2).cast("int")).alias("w"), F.conv(F.hex(F.substring("data", i + 1, F.lit(1))), 16, 10).cast("int").alias("v"))
    return at.select("frame_id", "plane", F.floor(F.col("k") / F.col("w")).cast("int").alias("y"), (F.col("k") % F.col("w")).alias("x"), "v")
