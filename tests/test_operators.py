"""Operators against plain Python, at the edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumagrid.functions import color, geometry, report, tone
from lumagrid.operators import cells, media, packed, render
from lumagrid.sources import adapters, frame_files


def curve(g, size):
    n = g / 255
    s = 2 * n * n if n < 0.5 else 1 - 2 * (1 - n) ** 2
    return max(0, min(size - 1, int(s * (size - 1) + 0.5)))


@pytest.mark.parametrize("name", ["standard", "detailed", "DETAILED", "other", None])
def test_lut_is_the_float_curve(spark, name):
    chars = tone.pick_charset(name)
    got = {r["gray"]: (r["idx"], r["ch"]) for r in tone.lut(spark, name).collect()}
    assert got == {g: (curve(g, len(chars)), chars[curve(g, len(chars))]) for g in range(256)}


def test_charsets():
    assert (len(tone.STANDARD), len(tone.DETAILED)) == (70, 15)
    assert tone.STANDARD[0] == tone.DETAILED[0] == " "


def test_colors(spark):
    rows = spark.range(256).select("id", color.gray(F.col("id"), F.col("id"), F.col("id")).alias("g"), color.tint_background(F.col("id")).alias("b"), color.tint_stroke(F.col("id")).alias("s")).collect()
    for r in rows:
        assert (r["g"], r["b"], r["s"]) == (r["id"], int(np.float32(r["id"]) * np.float32(0.15)), min(255, int(np.float32(r["id"]) * np.float32(1.25))))
    ends = spark.range(256).select("id", color.blend(F.col("id"), 7, 0).alias("zero"), color.blend(F.col("id"), 7, 255).alias("full")).collect()
    assert all(r["zero"] == 7 and r["full"] == r["id"] for r in ends)


def test_bounds():
    assert cells.axis_bounds(854, 200)[-1][1] == 853
    assert cells.axis_bounds(112, 80)[45][0] == 62
    assert sum(lo == hi for lo, hi in cells.axis_bounds(20, 30)) == 10
    rng = random.Random(3)
    for _ in range(300):
        w, n = rng.randint(1, 2000), rng.randint(1, 400)
        b = cells.axis_bounds(w, n)
        assert len(b) == n and b[0][0] == 0 and b[-1][1] <= w
        assert all(x[1] == y[0] for x, y in zip(b, b[1:]))
    with pytest.raises(ValueError):
        cells.axis_bounds(0, 3)


def test_empty_cells_and_packed_form(spark):
    for w, h, tw, th in ((20, 6, 30, 9), (112, 9, 80, 4), (13, 7, 5, 3)):
        card = adapters.test_card(spark, w, h, 2).withColumn("gray", color.gray())
        a = {tuple(r) for r in cells.cell_means(card, w, h, tw, th, ("gray", "r", "g", "b")).select("frame_id", "ty", "tx", "gray", "r", "g", "b").collect()}
        b = {tuple(r) for r in packed.packed_cells(packed.pack_pixels(card, w, h), tw, th).collect()}
        assert a == b and len(a) == 2 * tw * th


def test_packed_render_equals_relational(spark):
    plan = geometry.plan_grid(30, 20, 7, 6)
    card = adapters.test_card(spark, 30, 20, 2).withColumn("gray", color.gray())
    atlas = adapters.synthetic_mask(spark, plan.cell_width, plan.cell_height)
    means = cells.map_chars(cells.cell_means(card, 30, 20, 7, 6, ("gray", "r", "g", "b"))).withColumn("code", render.char_code())
    for colored in (True, False):
        f = render.render_color if colored else render.render_mono
        whole = render.full_frame(f(means, atlas, plan.cell_width, plan.cell_height, 30, 20), card, 30, 20)
        a = {tuple(r) for r in whole.select("frame_id", "py", "px", "r", "g", "b").collect()}
        out = packed.packed_render(packed.pack_pixels(card, 30, 20), atlas, 7, 6, plan.cell_width, plan.cell_height, color=colored)
        assert a == {tuple(r) for r in packed.unpack(out).collect()}


def test_text_rendering_edges(spark):
    rows = [(0, "ab\nc\n"), (1, ""), (2, "中x"), (3, "abcdef\nghij")]
    got = {}
    for r in render.text_cells(spark.createDataFrame(rows, "frame_id long, art string"), 3, 2).collect():
        got[(r["frame_id"], r["ty"], r["tx"])] = r["code"]
    assert got == {(0, 0, 0): 97, (0, 0, 1): 98, (0, 1, 0): 99, (2, 0, 0): 32, (2, 0, 1): 120, (3, 0, 0): 97, (3, 0, 1): 98, (3, 0, 2): 99, (3, 1, 0): 103, (3, 1, 1): 104, (3, 1, 2): 105}


def test_geometry():
    p = geometry.plan_grid(1920, 1080)
    assert (p.columns, p.rows, p.cell_width, p.cell_height) == (240, 135, 8, 8)
    p = geometry.plan_grid(1280, 720)
    assert (p.columns * p.cell_width, p.rows * p.cell_height) == (1200, 675)
    p = geometry.plan_grid(640, 480)
    assert (p.rows, p.columns * p.cell_width, p.rows * p.cell_height) == (180, 720, 540)
    with pytest.raises(ValueError):
        geometry.plan_grid(0, 5)


def test_rates_and_names(spark):
    r = spark.range(1).select(
        geometry.frame_rate(F.lit(30000), F.lit(1001)).alias("a"), geometry.frame_rate(F.lit(5), F.lit(0)).alias("b"), geometry.output_rate(F.lit(0), F.lit(0.0)).alias("c"),
        geometry.frame_count(F.lit(0), F.lit(0), F.lit(25.0)).alias("d"), geometry.font_size(F.lit(14), F.lit(20)).alias("e"), geometry.font_size(F.lit(12), F.lit(20)).alias("f"),
        report.error_name(F.lit(-5)).alias("g"), report.error_name(F.lit(3)).alias("h"), report.rating(F.lit(30)).alias("i"), report.rating(F.lit(101)).alias("j"),
    ).first()
    assert math.isclose(r["a"], 29.97002997) and tuple(r)[1:] == (30.0, 30.0, 0, 19.0, 12.0, "IOError", "Unknown", "excellent", "poor")


def test_selection(spark):
    frames = spark.range(10).select(F.col("id").alias("frame_id"), F.lit("v").alias("video_id"))
    assert media.limit_frames(frames, 3).count() == 3 and media.limit_frames(frames, 0).count() == 10
    assert media.seek_frames(frames, 8).count() == 2
    with pytest.raises(ValueError):
        media.seek_frames(frames, -1)
    assert [r["pts"] for r in media.assign_pts(media.seek_frames(frames, 5)).orderBy("frame_id").collect()] == [0, 1, 2, 3, 4]
    none = media.frame_stats(spark.createDataFrame([], "frame_id long, stage string, elapsed_ms long")).first()
    assert (none["frames"], none["mean_ms"], none["fps"]) == (0, 0.0, 0.0)
    pts = spark.createDataFrame([(x,) for x in (-3, -1, 0, 1, 3)], "p long").select(media.rescale_pts(F.col("p"), 1, 2, 1, 1).alias("q")).collect()
    assert [r["q"] for r in pts] == [-2, -1, 0, 1, 2]


def test_fonts(spark):
    have = spark.createDataFrame([("consolas",), ("Courier",)], "family string")
    assert render.first_font(have, None).first()["family"] == "Consolas"
    assert render.first_font(have.filter("family = 'x'"), "Foo").first()["family"] == "monospace"


def test_awt_atlas(spark):
    try:
        rows = render.awt_atlas(spark, "DejaVu Sans Mono", 10, 8, 12).collect()
    except Exception as e:  # no fonts on this machine
        pytest.skip(str(e)[:80])
    ink = {r["code"] for r in rows if r["alpha"]}
    assert len(rows) == 256 * 96 and ink and ink <= set(range(33, 127))


def test_files(spark, tmp_path):
    card = packed.pack_pixels(adapters.test_card(spark, 6, 4, 3), 6, 4).withColumn("video_id", F.lit("v"))
    frame_files.write_ppm(card, str(tmp_path / "ppm"))
    want = {(r["frame_id"], bytes(r["data"])) for r in card.collect()}
    assert {(r["frame_id"], bytes(r["data"])) for r in frame_files.read_ppm(spark, str(tmp_path / "ppm")).collect()} == want
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.rgb").write_bytes(b"".join(d for _, d in sorted(want)))
    assert {(r["frame_id"], bytes(r["data"])) for r in frame_files.read_raw(spark, str(tmp_path / "raw"), 6, 4).collect()} == want
    with pytest.raises(Exception, match="whole frames"):
        frame_files.read_raw(spark, str(tmp_path / "raw"), 5, 4).collect()


def test_plans_have_no_nested_loop(spark):
    card = adapters.test_card(spark, 40, 25, 2).withColumn("gray", color.gray())
    plan = cells.cell_means(card, 40, 25, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_segments(spark, tmp_path, monkeypatch):
    card = packed.pack_pixels(adapters.test_card(spark, 6, 4, 7), 6, 4).withColumn("video_id", F.lit("a_b"))
    frame_files.write_ppm(card.coalesce(1), str(tmp_path / "ppm"))
    assert len(list((tmp_path / "ppm").iterdir())) == 1  # seven frames, one file, nothing temporary
    rows = {(r["video_id"], r["frame_id"], bytes(r["data"])) for r in card.collect()}
    assert {(r["video_id"], r["frame_id"], bytes(r["data"])) for r in frame_files.read_ppm(spark, str(tmp_path / "ppm")).collect()} == rows
    bad = card.withColumn("width", F.when(F.col("frame_id") == 6, 5).otherwise(6))
    with pytest.raises(Exception, match="size"):
        frame_files.write_ppm(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    frame_files.write_ppm(card.filter("frame_id < 0"), str(tmp_path / "none"))
    assert frame_files.read_ppm(spark, str(tmp_path / "none")).count() == 0


def _yuv_by_hand(rgb):
    """One frame through 4:2:0 and back, a pixel at a time."""
    h, w, _ = rgb.shape
    px = rgb.astype(int)
    u = lambda y, x: ((-38 * px[y, x, 0] - 74 * px[y, x, 1] + 112 * px[y, x, 2] + 128) >> 8) + 128
    v = lambda y, x: ((112 * px[y, x, 0] - 94 * px[y, x, 1] - 18 * px[y, x, 2] + 128) >> 8) + 128
    out = np.zeros_like(rgb)
    for y in range(h):
        for x in range(w):
            lum = ((66 * px[y, x, 0] + 129 * px[y, x, 1] + 25 * px[y, x, 2] + 128) >> 8) + 16
            four = [(y // 2 * 2 + a, x // 2 * 2 + b) for a in (0, 1) for b in (0, 1)]
            cu, cv = ((sum(f(*p) for p in four) + 2) // 4 for f in (u, v))
            c, d, e = 298 * (lum - 16) + 128, cu - 128, cv - 128
            out[y, x] = [max(0, min(255, t >> 8)) for t in (c + 409 * e, c - 100 * d - 208 * e, c + 516 * d)]
    return out


def test_y4m(spark, tmp_path):
    card = packed.pack_pixels(adapters.test_card(spark, 8, 6, 5), 8, 6).withColumn("video_id", F.lit("v"))
    path = str(tmp_path / "y4m")
    frame_files.write_y4m(card, path, 24000, 1001)
    want = {r["frame_id"]: _yuv_by_hand(np.frombuffer(bytes(r["data"]), np.uint8).reshape(6, 8, 3)).tobytes() for r in card.collect()}
    assert {r["frame_id"]: bytes(r["data"]) for r in frame_files.read_y4m(spark, path).collect()} == want
    info = frame_files.y4m_info(spark, path).collect()
    assert sum(r["nb_frames"] for r in info) == 5
    assert {(r["video_id"], r["width"], r["height"], r["rate_num"], r["rate_den"], r["pixel_format"]) for r in info} == {("v", 8, 6, 24000, 1001, "420jpeg")}
    with pytest.raises(Exception, match="even"):
        frame_files.write_y4m(packed.pack_pixels(adapters.test_card(spark, 5, 4, 1), 5, 4).withColumn("video_id", F.lit("v")), str(tmp_path / "odd"))


def test_y4m_of_others(spark, tmp_path):
    def put(name, head, *frames):
        (tmp_path / name).write_bytes(head + b"".join(b"FRAME\n" + f for f in frames))

    y = bytes([16, 81, 145, 235, 16, 235])
    put("gray.y4m", b"YUV4MPEG2 W3 H2 F25:1 Cmono XA=W9\n", y, y)
    put("full.y4m", b"YUV4MPEG2 W3 H2 F25:1 C444\n", y + bytes([128] * 12))
    put("odd.y4m", b"YUV4MPEG2 W3 H2 F25:1\n", y + bytes([128] * 4))
    put("wide_0007.y4m", b"YUV4MPEG2 W3 H2 F25:1 C422\n", y + bytes([128] * 8))
    level = [0, 76, 150, 255, 0, 255]
    rows = frame_files.read_y4m(spark, str(tmp_path)).collect()
    assert sorted((r["video_id"], r["frame_id"]) for r in rows) == [("full", 0), ("gray", 0), ("gray", 1), ("odd", 0), ("wide", 7)]
    assert all(list(r["data"])[::3] == level and list(r["data"])[1::3] == level for r in rows)
    assert {(r["video_id"], r["nb_frames"]) for r in frame_files.y4m_info(spark, str(tmp_path)).collect()} == {("full", 1), ("gray", 2), ("odd", 1), ("wide", 1)}
    put("bad.y4m", b"YUV4MPEG2 W3 H2 F25:1 C444\n", y)
    with pytest.raises(Exception, match="cut off"):
        frame_files.read_y4m(spark, str(tmp_path), "bad.y4m").collect()
    assert frame_files.y4m_info(spark, str(tmp_path), "bad.y4m").first()["nb_frames"] == 0
    (tmp_path / "no.y4m").write_bytes(b"RIFF....")
    for f in (frame_files.read_y4m, frame_files.y4m_info):
        with pytest.raises(Exception, match="not a YUV4MPEG2"):
            f(spark, str(tmp_path), "no.y4m").collect()


def test_observed(spark, tmp_path):
    from pyspark.sql import Observation

    seen = Observation("sink")
    frames = packed.pack_pixels(adapters.test_card(spark, 6, 4, 9), 6, 4).withColumn("video_id", F.lit("v"))
    frame_files.write_ppm(media.observed(frames, seen), str(tmp_path / "out"))
    assert seen.get["frames"] == 9


def test_stream_late_rows_and_restart(spark, tmp_path):
    from datetime import datetime

    from lumagrid.streaming import streams

    def put(n, *hours):
        rows = [(datetime(2024, 1, 1 + h // 24, h % 24),) for h in hours]
        spark.createDataFrame(rows, "ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))

    def run():
        arriving = spark.readStream.schema("ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        done = streams.count_windows(arriving, str(tmp_path / "out"), str(tmp_path / "state"), "1 hour", "2 hours")
        return {(r["start"].day - 1) * 24 + r["start"].hour: r["frames"] for r in done.collect()}

    put(1, 1, 1, 2)
    put(2, 2, 5)
    assert run() == {1: 2, 2: 2, 5: 1}
    put(3, 9, 9)
    assert run() == {1: 2, 2: 2, 5: 1, 9: 2}  # a restart goes on after what is done
    put(4, 1, 8)  # hour 1 is closed: two hours before 9, so its row is dropped; hour 8 is open
    assert run() == {1: 2, 2: 2, 5: 1, 8: 1, 9: 2}
    assert run() == {1: 2, 2: 2, 5: 1, 8: 1, 9: 2}
