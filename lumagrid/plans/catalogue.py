"""Queries of the frame dataflow, one for each operator, and their SQL.

Every integer comes out as BIGINT on both sides. SQL divides with // where Spark uses exact integer forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from ..functions import color, geometry, report, tone
from ..operators import cells, media, packed, render
from ..sources import adapters, frame_files
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def longs(df: DataFrame) -> DataFrame:
    kinds = ("int", "smallint", "tinyint")
    return df.select(*[F.col(c).cast("long").alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return longs(f(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n.split('.')[-1]}" for n in names)


# ---- SQL parts -------------------------------------------------------------------------------------------

EVENTS_PX = """px AS (SELECT event_id // 1000 AS frame_id, (event_id % 1000) // 40 AS y, event_id % 40 AS x,
    CAST(floor(value) AS BIGINT) % 256 AS r, (user_id * 7) % 256 AS g, (event_id * 13) % 256 AS b FROM events)"""
ORDERS_PX = """px AS (SELECT o_orderkey // 1500 AS frame_id, (o_orderkey % 1500) // 50 AS y, o_orderkey % 50 AS x,
    o_custkey % 256 AS r, CAST(floor(o_totalprice) AS BIGINT) % 256 AS g, o_orderkey % 256 AS b FROM orders)"""
GRAY = "g AS (SELECT *, (54*r + 183*g + 19*b) >> 8 AS gray FROM px)"


def card_px(w: int, h: int, n: int) -> str:
    return f"""ids AS (SELECT i // {w * h} AS f, (i % {w * h}) // {w} AS y, i % {w} AS x FROM range({w * h * n}) t(i)),
    px AS (SELECT f AS frame_id, y, x, (7*x + 3*y + 5*f) % 256 AS r, (2*x + 11*y + 13*f) % 256 AS g, (x*x + y*y + 17*f) % 256 AS b FROM ids)"""


def bounds_sql(w: int, h: int, tw: int, th: int) -> str:
    def one(name: str, size: int, n: int) -> str:
        return f"""{name} AS (SELECT i AS cell, CAST(floor(i * (CAST({size} AS DOUBLE) / {n})) AS BIGINT) AS lo,
        least(CAST(floor((i + 1) * (CAST({size} AS DOUBLE) / {n})) AS BIGINT), {size}) AS hi FROM range({n}) t(i))"""

    return one("bx", w, tw) + ", " + one("by_", h, th)


def cells_sql(w: int, h: int, tw: int, th: int, source: str = "g") -> str:
    """CTE c: all cells of all frames with truncated means and the defaults of empty cells."""
    return bounds_sql(w, h, tw, th) + f""", m AS (SELECT frame_id, by_.cell AS ty, bx.cell AS tx, sum(gray) // count(*) AS gray, sum(r) // count(*) AS r,
        sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM {source} JOIN bx ON x >= bx.lo AND x < bx.hi JOIN by_ ON y >= by_.lo AND y < by_.hi GROUP BY 1, 2, 3),
    c AS (SELECT f.frame_id, by_.cell AS ty, bx.cell AS tx, coalesce(gray, 0) AS gray, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b
        FROM (SELECT DISTINCT frame_id FROM {source}) f, bx, by_ LEFT JOIN m ON m.frame_id = f.frame_id AND m.ty = by_.cell AND m.tx = bx.cell)"""


def index_sql(size: int, g: str = "gray") -> str:
    last = size - 1
    return f"""least({last}, greatest(0, CASE WHEN 2*{g} < 255 THEN (4*{g}*{g}*{last} + 65025) // 130050
        ELSE (2*{last}*(65025 - 2*(255-{g})*(255-{g})) + 65025) // 130050 END))"""


def chars_sql(chars: str) -> str:
    return "'" + chars.replace("'", "''") + "'"


def char_sql(chars: str) -> str:
    return f"substr({chars_sql(chars)}, CAST({index_sql(len(chars))} AS BIGINT) + 1, 1)"


def atlas_sql(cw: int, ch: int) -> str:
    return f"""atlas AS (SELECT code, cy, cx, CASE WHEN code BETWEEN 33 AND 126 THEN (code*37 + cy*101 + cx*53) % 256 ELSE 0 END AS alpha
        FROM range(256) a(code), range({ch}) b(cy), range({cw}) d(cx))"""


def rendered_sql(cw: int, ch: int, w: int, h: int, colored: bool, source: str) -> str:
    def value(c: str) -> str:
        return f"(least(255, {c}*5//4)*alpha + ({c}*3//20)*(255-alpha)) // 255" if colored else "alpha"

    return f"""p AS (SELECT frame_id, ty*{ch} + cy AS py, tx*{cw} + cx AS px, {', '.join(f'{value(c)} AS {c}' for c in 'rgb')}
        FROM {source} JOIN atlas USING (code) WHERE ty*{ch} + cy < {h} AND tx*{cw} + cx < {w})"""


def full_sql(w: int, h: int, source: str) -> str:
    return f"""SELECT {big('f.frame_id', 'y.py', 'x.px')}, {', '.join(f'CAST(coalesce(p.{c}, 0) AS BIGINT) AS {c}' for c in 'rgb')}
        FROM (SELECT DISTINCT frame_id FROM {source}) f, range({h}) y(py), range({w}) x(px)
        LEFT JOIN p ON p.frame_id = f.frame_id AND p.py = y.py AND p.px = x.px"""


# ---- pixels and tone -------------------------------------------------------------------------------------


def events_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events_pixels(adapters.read(spark, sf_dir, "events")).withColumn("gray", color.gray())


def orders_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.orders_pixels(adapters.read(spark, sf_dir, "orders")).withColumn("gray", color.gray())


@query("gray_pixels", f"WITH {EVENTS_PX}, {GRAY} SELECT {big('frame_id', 'y', 'x', 'gray')} FROM g")
def _(spark, sf_dir):
    return events_px(spark, sf_dir).select("frame_id", "y", "x", "gray")


@query("gray_tiles", f"""SELECT vec_id AS frame_id, {big('y', 'x', 'gray')} FROM (SELECT vec_id, (p - 1) // 8 AS y, (p - 1) % 8 AS x,
    least(255, greatest(0, floor((CAST(embedding[p] AS DOUBLE) + 1) * 127.5))) AS gray FROM embeddings, range(1, 65) t(p) WHERE p <= len(embedding))""")
def _(spark, sf_dir):
    return adapters.embedding_tiles(adapters.read(spark, sf_dir, "embeddings"))


for _name in tone.CHARSETS:

    @query(f"tone_lut_{_name}", f"""SELECT {big('gray')}, CAST({index_sql(len(tone.CHARSETS[_name]))} AS BIGINT) AS idx, {char_sql(tone.CHARSETS[_name])} AS ch FROM range(256) t(gray)""")
    def _(spark, sf_dir, name=_name):
        return tone.lut(spark, name)


@query("charset_pick", """SELECT DISTINCT event_type AS name, CASE WHEN lower(event_type) IN ('standard', 'detailed') THEN lower(event_type) ELSE 'standard' END AS charset FROM events""")
def _(spark, sf_dir):
    return adapters.read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), tone.charset_name(F.col("event_type")).alias("charset")).distinct()


@query("mask_from_rgb", f"WITH {ORDERS_PX} SELECT {big('frame_id', 'y', 'x')}, CAST(greatest(r, g, b) AS BIGINT) AS alpha FROM px")
def _(spark, sf_dir):
    return orders_px(spark, sf_dir).select("frame_id", "y", "x", color.mask().alias("alpha"))


@query("cell_tint", f"WITH {ORDERS_PX} SELECT {big('frame_id', 'y', 'x')}, {', '.join(f'CAST({c}*3//20 AS BIGINT) AS bg_{c}, CAST(least(255, {c}*5//4) AS BIGINT) AS fg_{c}' for c in 'rgb')} FROM px")
def _(spark, sf_dir):
    tints = [x for c in "rgb" for x in (color.tint_background(c).alias(f"bg_{c}"), color.tint_stroke(c).alias(f"fg_{c}"))]
    return orders_px(spark, sf_dir).select("frame_id", "y", "x", *tints)


@query("blend_table", "SELECT CAST(c AS BIGINT) AS c, CAST(a AS BIGINT) AS alpha, CAST((least(255, c*5//4)*a + (c*3//20)*(255-a)) // 255 AS BIGINT) AS v FROM range(256) x(c), range(256) y(a)")
def _(spark, sf_dir):
    t = spark.range(65536).select((F.col("id") % 256).cast("int").alias("c"), F.floor(F.col("id") / 256).cast("int").alias("alpha"))
    return t.withColumn("v", color.blend(color.tint_stroke("c"), color.tint_background("c"), "alpha"))


# ---- cells and text --------------------------------------------------------------------------------------


@query("cell_mean_gray", f"WITH {EVENTS_PX}, {GRAY}, {cells_sql(40, 25, 10, 5)} SELECT {big('frame_id', 'ty', 'tx', 'gray')} FROM c")
def _(spark, sf_dir):
    return cells.cell_means(events_px(spark, sf_dir), 40, 25, 10, 5)


@query("cell_mean_color", f"WITH {ORDERS_PX}, {GRAY}, {cells_sql(50, 30, 10, 6)} SELECT {big('frame_id', 'ty', 'tx', 'gray', 'r', 'g', 'b')} FROM c")
def _(spark, sf_dir):
    return cells.cell_means(orders_px(spark, sf_dir), 50, 30, 10, 6, ("gray", "r", "g", "b"))


for _name, (_w, _h, _tw, _th) in {"cell_mean_ragged": (112, 9, 80, 4), "cell_mean_upscaled": (20, 6, 30, 9), "cell_mean_dropped_col": (854, 12, 200, 5)}.items():

    @query(_name, f"WITH {card_px(_w, _h, 2)}, {GRAY}, {cells_sql(_w, _h, _tw, _th)} SELECT {big('frame_id', 'ty', 'tx', 'gray', 'r', 'g', 'b')} FROM c")
    def _(spark, sf_dir, w=_w, h=_h, tw=_tw, th=_th):
        card = adapters.test_card(spark, w, h, 2).withColumn("gray", color.gray())
        return cells.cell_means(card, w, h, tw, th, ("gray", "r", "g", "b"))


@query("axis_bounds", f"WITH {bounds_sql(854, 112, 200, 80)} SELECT 'x' AS axis, {big('cell', 'lo', 'hi')} FROM bx UNION ALL SELECT 'y', {big('cell', 'lo', 'hi')} FROM by_")
def _(spark, sf_dir):
    return cells.bounds_frame(spark, "x", 854, 200).union(cells.bounds_frame(spark, "y", 112, 80))


@query("cell_mean_short_rgb", f"WITH {EVENTS_PX}, {GRAY}, s AS (SELECT * FROM g WHERE (y*40 + x)*3 + 2 < 2001), {cells_sql(40, 25, 10, 5, 's')} SELECT {big('frame_id', 'ty', 'tx', 'gray', 'r', 'g', 'b')} FROM c")
def _(spark, sf_dir):
    short = events_px(spark, sf_dir).filter((F.col("y") * 40 + F.col("x")) * 3 + 2 < 2001)
    return cells.cell_means(short, 40, 25, 10, 5, ("gray", "r", "g", "b"))


EVENT_CHARS = f"WITH {EVENTS_PX}, {GRAY}, {cells_sql(40, 25, 10, 5)}, t AS (SELECT *, {char_sql(tone.STANDARD)} AS ch FROM c)"


def event_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = cells.cell_means(events_px(spark, sf_dir), 40, 25, 10, 5, ("gray", "r", "g", "b"))
    return cells.map_chars(means)


@query("char_grid", f"{EVENT_CHARS} SELECT {big('frame_id', 'ty', 'tx')}, ch FROM t")
def _(spark, sf_dir):
    return event_chars(spark, sf_dir).select("frame_id", "ty", "tx", "ch")


@query("char_grid_by_lut", f"{EVENT_CHARS} SELECT {big('frame_id', 'ty', 'tx')}, ch FROM t")
def _(spark, sf_dir):
    means = cells.cell_means(events_px(spark, sf_dir), 40, 25, 10, 5)
    return means.join(F.broadcast(tone.lut(spark, "standard")), "gray").select("frame_id", "ty", "tx", "ch")


@query("ascii_rows", f"{EVENT_CHARS} SELECT {big('frame_id', 'ty')}, string_agg(ch, '' ORDER BY tx) AS line FROM t GROUP BY 1, 2")
def _(spark, sf_dir):
    return cells.row_text(event_chars(spark, sf_dir))


@query("ascii_frames", f"{EVENT_CHARS}, l AS (SELECT frame_id, ty, string_agg(ch, '' ORDER BY tx) AS line FROM t GROUP BY 1, 2) SELECT {big('frame_id')}, string_agg(line, chr(10) ORDER BY ty) AS art FROM l GROUP BY 1")
def _(spark, sf_dir):
    return cells.frame_text(event_chars(spark, sf_dir))


TEXT_CODES = """lines AS (SELECT doc_id AS frame_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ty FROM documents),
    cut AS (SELECT frame_id, ty, line FROM lines WHERE ty < 12 AND length(line) > 0),
    codes AS (SELECT frame_id, ty, tx, CASE WHEN unicode(substr(line, tx + 1, 1)) < 256 THEN unicode(substr(line, tx + 1, 1)) ELSE 32 END AS code
        FROM (SELECT frame_id, ty, line, unnest(range(least(40, length(line)))) AS tx FROM cut))"""


@query("text_codes", f"WITH {TEXT_CODES} SELECT {big('frame_id', 'ty', 'tx', 'code')} FROM codes")
def _(spark, sf_dir):
    return adapters.text_codes(adapters.read(spark, sf_dir, "documents"), 40, 12)


# ---- rendering -------------------------------------------------------------------------------------------

EVENT_CELLS = f"{EVENT_CHARS}, k AS (SELECT *, ascii(ch) AS code FROM t), {atlas_sql(4, 5)}"


def event_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_chars(spark, sf_dir).withColumn("code", render.char_code())


@query("render_mono", f"{EVENT_CELLS}, {rendered_sql(4, 5, 40, 25, False, 'k')} SELECT {big('frame_id', 'py', 'px', 'r', 'g', 'b')} FROM p")
def _(spark, sf_dir):
    return render.render_mono(event_codes(spark, sf_dir), adapters.synthetic_mask(spark, 4, 5), 4, 5, 40, 25)


@query("render_color", f"{EVENT_CELLS}, {rendered_sql(4, 5, 40, 25, True, 'k')} SELECT {big('frame_id', 'py', 'px', 'r', 'g', 'b')} FROM p")
def _(spark, sf_dir):
    return render.render_color(event_codes(spark, sf_dir), adapters.synthetic_mask(spark, 4, 5), 4, 5, 40, 25)


@query("render_text", f"WITH {TEXT_CODES}, {atlas_sql(2, 3)}, {rendered_sql(2, 3, 80, 36, False, 'codes')} SELECT {big('frame_id')}, CAST(sum(r * (py * 80 + px + 1)) AS BIGINT) AS checksum, count(*) AS pixels FROM p GROUP BY 1")
def _(spark, sf_dir):
    texts = adapters.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("art"))
    p = render.render_mono(render.text_cells(texts, 40, 12), adapters.synthetic_mask(spark, 2, 3), 2, 3, 80, 36)
    return p.groupBy("frame_id").agg(F.sum(F.col("r").cast("long") * (F.col("py") * 80 + F.col("px") + 1)).alias("checksum"), F.count("*").alias("pixels"))


for _name, (_w, _h, _tw, _th) in {"render_margin": (64, 36, 12, 7), "render_clipped": (64, 48, 24, 18)}.items():
    _plan = geometry.plan_grid(_w, _h, _tw, _th)
    _cw, _ch = _plan.cell_width, _plan.cell_height

    @query(
        _name,
        f"WITH {card_px(_w, _h, 2)}, {GRAY}, {cells_sql(_w, _h, _tw, _th)}, k AS (SELECT *, ascii({char_sql(tone.STANDARD)}) AS code FROM c), {atlas_sql(_cw, _ch)}, {rendered_sql(_cw, _ch, _w, _h, True, 'k')} {full_sql(_w, _h, 'px')}",
    )
    def _(spark, sf_dir, plan=_plan):
        card = adapters.test_card(spark, plan.width, plan.height, 2).withColumn("gray", color.gray())
        means = cells.cell_means(card, plan.width, plan.height, plan.columns, plan.rows, ("gray", "r", "g", "b"))
        codes = cells.map_chars(means).withColumn("code", render.char_code())
        atlas = adapters.synthetic_mask(spark, plan.cell_width, plan.cell_height)
        p = render.render_color(codes, atlas, plan.cell_width, plan.cell_height, plan.width, plan.height)
        return render.full_frame(p, card, plan.width, plan.height)


_FONTS = ", ".join(f"({i}, '{f}')" for i, f in enumerate(render.FONT_CANDIDATES))


@query("font_first_match", f"""SELECT coalesce((SELECT f FROM (VALUES {_FONTS}) c(i, f) WHERE lower(f) IN
    (SELECT lower(f) FROM part, (VALUES {_FONTS}) d(i, f) WHERE d.i = 3 + p_size % 5) ORDER BY i LIMIT 1), 'monospace') AS family""")
def _(spark, sf_dir):
    names = F.array(*[F.lit(f.upper()) for f in render.FONT_CANDIDATES])
    have = adapters.read(spark, sf_dir, "part").select(F.element_at(names, (F.col("p_size") % 5 + 4).cast("int")).alias("family"))
    return render.first_font(have, "Some Font")


@query("font_families_distinct", "SELECT DISTINCT lower(p_brand) AS family FROM part")
def _(spark, sf_dir):
    return adapters.read(spark, sf_dir, "part").select(F.lower("p_brand").alias("family")).distinct()


# ---- geometry, rates and metadata ------------------------------------------------------------------------

SIZES = "sizes AS (SELECT 16 + 8*i AS w, 9 + 5*j AS h, k AS opt FROM range(40) a(i), range(30) b(j), (VALUES (0), (80), (14)) c(k))"


def sizes(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    base = spark.range(1200).select((16 + 8 * (i % 40)).cast("int").alias("w"), (9 + 5 * F.floor(i / 40)).cast("int").alias("h"))
    return base.select("w", "h", F.explode(F.array(F.lit(0), F.lit(80), F.lit(14))).alias("opt"))


@query("grid_geometry", f"""WITH {SIZES}, a AS (SELECT *, CASE WHEN opt > 0 THEN opt ELSE 240 END AS tw FROM sizes),
    b AS (SELECT *, greatest(1, round_even(tw * (CAST(h AS DOUBLE) / w), 0)) AS th FROM a)
    SELECT {big('w', 'h', 'opt', 'tw', 'th')}, CAST(greatest(1, round_even(CAST(w AS DOUBLE) / tw, 0)) AS BIGINT) AS cw, CAST(greatest(1, round_even(CAST(h AS DOUBLE) / th, 0)) AS BIGINT) AS ch,
    CAST(tw * greatest(1, round_even(CAST(w AS DOUBLE) / tw, 0)) AS BIGINT) AS out_w FROM b""")
def _(spark, sf_dir):
    t = sizes(spark).withColumn("tw", geometry.grid_columns(F.col("opt")))
    t = t.withColumn("th", geometry.grid_rows(F.col("tw"), F.col("w"), F.col("h"), F.lit(0)))
    t = t.withColumn("cw", geometry.cell_size(F.col("w"), F.col("tw"))).withColumn("ch", geometry.cell_size(F.col("h"), F.col("th")))
    return t.withColumn("out_w", F.col("tw") * F.col("cw"))


@query("font_size_rule", f"WITH {SIZES} SELECT DISTINCT {big('opt', 'h')}, CASE WHEN opt <= 0 OR opt = 14 THEN greatest(6.0::DOUBLE, h * 0.95::DOUBLE) ELSE opt::DOUBLE END AS size FROM sizes")
def _(spark, sf_dir):
    return sizes(spark).select("opt", "h", geometry.font_size(F.col("opt"), F.col("h")).alias("size")).distinct()


VIDEOS = """v AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 30000 WHEN 1 THEN 25 WHEN 2 THEN 0 ELSE 60 END AS num, CASE o_orderkey % 4 WHEN 0 THEN 1001 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS den,
    CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS nb, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey * 1000 END AS us FROM orders),
    a AS (SELECT *, CASE WHEN den > 0 THEN num / CAST(den AS DOUBLE) ELSE 30.0::DOUBLE END AS rate FROM v),
    i AS (SELECT *, CASE WHEN nb > 0 THEN nb WHEN us > 0 AND rate > 0 THEN CAST(floor(us * rate / 1e6::DOUBLE) AS BIGINT) ELSE 0 END AS frames FROM a)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    v = adapters.read(spark, sf_dir, "orders").select(
        k.alias("id"), pick(4, 30000, 25, 0, 60).alias("num"), pick(4, 1001, 1, 1, 0).alias("den"), F.when(k % 3 == 0, F.col("o_custkey")).otherwise(0).alias("nb"), F.when(k % 5 == 0, 0).otherwise(k * 1000).alias("us")
    )
    v = v.withColumn("rate", geometry.frame_rate(F.col("num"), F.col("den")))
    return v.withColumn("frames", geometry.frame_count(F.col("nb"), F.col("us"), F.col("rate")))


@query("video_info", f"WITH {VIDEOS} SELECT id, rate, frames, CASE WHEN frames > 0 AND rate > 0 THEN frames / rate ELSE 0.0::DOUBLE END AS seconds, '1920x1080' AS resolution, 'unknown' AS codec FROM i")
def _(spark, sf_dir):
    v = videos(spark, sf_dir)
    return v.select("id", "rate", "frames", geometry.duration_seconds(F.col("frames"), F.col("rate")).alias("seconds"), F.format_string("%dx%d", F.lit(1920), F.lit(1080)).alias("resolution"), F.coalesce(F.lit(None).cast("string"), F.lit("unknown")).alias("codec"))


@query("output_rate", f"WITH {VIDEOS} SELECT id, CASE WHEN id % 7 = 0 THEN 24.0::DOUBLE WHEN rate > 0 THEN rate ELSE 30.0::DOUBLE END AS rate_out FROM i")
def _(spark, sf_dir):
    return videos(spark, sf_dir).select("id", geometry.output_rate(F.when(F.col("id") % 7 == 0, 24).otherwise(0), F.col("rate")).alias("rate_out"))


@query("video_text", f"WITH {VIDEOS} SELECT id, printf('Video: %dx%d, %.2f FPS, %.2fs, %d frames, %s', 1920, 1080, rate, 2.5::DOUBLE, frames, 'h264') AS text FROM i")
def _(spark, sf_dir):
    return videos(spark, sf_dir).select("id", report.video_text(F.lit(1920), F.lit(1080), F.col("rate"), F.lit(2.5), F.col("frames"), F.lit("h264")).alias("text"))


@query("seek_times", f"WITH {VIDEOS} SELECT id, CAST(floor(nb / rate * 1e6::DOUBLE) AS BIGINT) AS us FROM i WHERE rate > 0")
def _(spark, sf_dir):
    return videos(spark, sf_dir).filter("rate > 0").select("id", geometry.seek_microseconds(F.col("nb"), F.col("rate")).alias("us"))


@query("error_names", f"SELECT CAST(-c AS BIGINT) AS code, CASE -c {' '.join(f'WHEN {k} THEN {chr(39)}{v}{chr(39)}' for k, v in report.ERROR_NAMES.items())} ELSE 'Unknown' END AS name FROM range(40) t(c)")
def _(spark, sf_dir):
    return spark.range(40).select((-F.col("id")).alias("code"), report.error_name(-F.col("id")).alias("name"))


# ---- streams, packets and selection ----------------------------------------------------------------------

PACKETS = """pk AS (SELECT CAST(event_id // 1000 AS VARCHAR) AS video_id, event_id AS seq, user_id % 3 AS stream_index, CASE user_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'data' END AS kind, event_id * 1024 AS pts FROM events),
    fs AS (SELECT video_id, coalesce(min(CASE WHEN kind = 'video' THEN stream_index END), -1) AS video_index, coalesce(min(CASE WHEN kind = 'audio' THEN stream_index END), -1) AS audio_index FROM pk GROUP BY 1)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_packets(adapters.read(spark, sf_dir, "events"))


@query("first_streams", f"WITH {PACKETS} SELECT video_id, {big('video_index', 'audio_index')} FROM fs")
def _(spark, sf_dir):
    return media.first_streams(packets(spark, sf_dir))


@query("route_packets", f"""WITH {PACKETS} SELECT video_id, seq, {big('stream_index')}, pts, CASE WHEN stream_index = video_index THEN 'video' ELSE 'audio' END AS route
    FROM pk JOIN fs USING (video_id) WHERE stream_index = video_index OR stream_index = audio_index""")
def _(spark, sf_dir):
    p = packets(spark, sf_dir)
    return media.route_packets(p, media.first_streams(p)).select("video_id", "seq", "stream_index", "pts", "route")


@query("audio_rescale", f"WITH {PACKETS} SELECT seq, CAST((pts * 1 * 90000 * 2 + 44100) // (2 * 44100) AS BIGINT) AS pts FROM pk WHERE kind = 'audio'")
def _(spark, sf_dir):
    return packets(spark, sf_dir).filter("kind = 'audio'").select("seq", media.rescale_pts(F.col("pts"), 1, 44100, 1, 90000).alias("pts"))


@query("interleave_packets", f"""WITH {PACKETS} SELECT video_id, seq, pts, CAST(CASE kind WHEN 'video' THEN 0 ELSE 1 END AS BIGINT) AS rank FROM pk WHERE kind <> 'data'""")
def _(spark, sf_dir):
    p = packets(spark, sf_dir).select("video_id", "seq", "pts", "kind")
    return media.interleave(p.filter("kind = 'video'").drop("kind"), p.filter("kind = 'audio'").drop("kind"))


@query("limit_frames", f"WITH {EVENTS_PX} SELECT {big('frame_id', 'y', 'x', 'r', 'g', 'b')} FROM px WHERE frame_id < 3")
def _(spark, sf_dir):
    return media.limit_frames(events_px(spark, sf_dir).drop("gray"), 3)


@query("seek_frames", f"WITH {EVENTS_PX} SELECT {big('frame_id', 'y', 'x', 'r', 'g', 'b')} FROM px WHERE frame_id >= 4")
def _(spark, sf_dir):
    return media.seek_frames(events_px(spark, sf_dir).drop("gray"), 4)


@query("assign_pts", "SELECT CAST(event_id // 100 AS BIGINT) AS video_id, event_id AS frame_id, CAST(row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS BIGINT) AS pts FROM events")
def _(spark, sf_dir):
    e = adapters.read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("video_id"), F.col("event_id").alias("frame_id"))
    return media.assign_pts(e)


# ---- metrics ---------------------------------------------------------------------------------------------

TIMES = """tm AS (SELECT event_id // 5 AS frame_id, CASE event_id % 5 WHEN 0 THEN 'decode' WHEN 1 THEN 'grayscale' WHEN 2 THEN 'mapping' WHEN 3 THEN 'render' ELSE 'encode' END AS stage,
    CAST(floor(value / 10) AS BIGINT) AS elapsed_ms FROM events), fr AS (SELECT frame_id, sum(elapsed_ms) AS ms FROM tm GROUP BY 1)"""
RATING = "CASE " + " ".join(f"WHEN ms <= {k} THEN '{v}'" for k, v in report.RATINGS) + " ELSE 'poor' END"


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.event_timings(adapters.read(spark, sf_dir, "events"))


@query("stage_totals", f"WITH {TIMES} SELECT stage, CAST(sum(elapsed_ms) AS BIGINT) AS total_ms, count(*) AS n FROM tm GROUP BY 1")
def _(spark, sf_dir):
    return media.stage_totals(times(spark, sf_dir))


@query("stage_means", f"WITH {TIMES} SELECT stage, CAST(sum(elapsed_ms) AS DOUBLE) / count(*) AS mean_ms, CAST(sum(elapsed_ms) AS DOUBLE) / 1000 AS seconds FROM tm GROUP BY 1")
def _(spark, sf_dir):
    t = media.stage_totals(times(spark, sf_dir))
    return t.select("stage", (F.col("total_ms").cast("double") / F.col("n")).alias("mean_ms"), (F.col("total_ms").cast("double") / 1000).alias("seconds"))


@query("perf_rating", f"WITH {TIMES} SELECT {big('frame_id', 'ms')}, {RATING} AS rating FROM fr")
def _(spark, sf_dir):
    t = times(spark, sf_dir).groupBy("frame_id").agg(F.sum("elapsed_ms").alias("ms"))
    return t.withColumn("rating", report.rating(F.col("ms")))


@query("monitor_stats", f"""WITH {TIMES}, s AS (SELECT count(*) AS frames, coalesce(sum(ms), 0) AS total FROM fr), m AS (SELECT frames, total, CASE WHEN frames > 0 THEN CAST(total AS DOUBLE) / frames ELSE 0.0::DOUBLE END AS ms FROM s)
    SELECT frames, CAST(total AS BIGINT) AS total_ms, ms AS mean_ms, CASE WHEN ms > 0 THEN 1000.0::DOUBLE / ms ELSE 0.0::DOUBLE END AS fps, {RATING} AS rating FROM m""")
def _(spark, sf_dir):
    return media.frame_stats(times(spark, sf_dir))


@query("progress_per_second", """WITH c AS (SELECT date_trunc('second', ts) AS h, count(*) AS n FROM events GROUP BY 1),
    d AS (SELECT h, n, sum(n) OVER (PARTITION BY date_trunc('day', h) ORDER BY h) AS total FROM c)
    SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS second, CAST(total AS BIGINT) AS total, CAST(total - coalesce(lag(total) OVER (PARTITION BY date_trunc('day', h) ORDER BY h), 0) AS BIGINT) AS since_last FROM d""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    day = Window.partitionBy(F.date_trunc("day", "h")).orderBy("h")
    c = adapters.read(spark, sf_dir, "events").groupBy(F.date_trunc("second", "ts").alias("h")).agg(F.count("*").alias("n"))
    c = c.withColumn("total", F.sum("n").over(day)).withColumn("since_last", F.col("total") - F.coalesce(F.lag("total").over(day), F.lit(0)))
    return c.select(F.date_format("h", "yyyy-MM-dd HH:mm:ss").alias("second"), "total", "since_last")


@query("percent_complete", """WITH p AS (SELECT event_id // 1000 AS video_id, event_id, 100.0::DOUBLE * count(*) OVER (PARTITION BY event_id // 1000 ORDER BY event_id) / 1000 AS percent FROM events)
    SELECT CAST(video_id AS BIGINT) AS video_id, event_id, percent, '[' || repeat('#', CAST(floor(percent / 100 * 30) AS BIGINT)) || repeat('.', 30 - CAST(floor(percent / 100 * 30) AS BIGINT)) || ']' AS bar FROM p""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    video = F.floor(F.col("event_id") / 1000)
    done = F.count("*").over(Window.partitionBy(video).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    e = adapters.read(spark, sf_dir, "events").select(video.alias("video_id"), "event_id", (F.lit(100.0) * done / 1000).alias("percent"))
    return e.withColumn("bar", report.progress_bar(F.col("percent")))


# ---- packed frames, files and streams --------------------------------------------------------------------


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.pack_pixels(events_px(spark, sf_dir), 40, 25)


@query("packed_gray", ORACLE_SQL["gray_pixels"])
def _(spark, sf_dir):
    return packed.unpack(packed.packed_gray(event_frames(spark, sf_dir)), ("gray",))


@query("packed_cells", f"WITH {EVENTS_PX}, {GRAY}, {cells_sql(40, 25, 10, 5)} SELECT {big('frame_id', 'ty', 'tx', 'gray', 'r', 'g', 'b')} FROM c")
def _(spark, sf_dir):
    return packed.packed_cells(event_frames(spark, sf_dir), 10, 5)


@query("packed_render", f"""{EVENT_CELLS}, {rendered_sql(4, 5, 40, 25, True, 'k')} SELECT {big('frame_id')}, CAST(py AS BIGINT) AS y, CAST(px AS BIGINT) AS x, {big('r', 'g', 'b')} FROM p""")
def _(spark, sf_dir):
    return packed.unpack(packed.packed_render(event_frames(spark, sf_dir), adapters.synthetic_mask(spark, 4, 5), 10, 5, 4, 5))


YUV = f"""WITH {ORDERS_PX}, c AS (SELECT *, ((66*r + 129*g + 25*b + 128) >> 8) + 16 AS lum, CAST(floor((-38*r - 74*g + 112*b + 128) / 256.0) AS BIGINT) + 128 AS u,
    CAST(floor((112*r - 94*g - 18*b + 128) / 256.0) AS BIGINT) + 128 AS v FROM px),
    q AS (SELECT frame_id, y // 2 AS y, x // 2 AS x, (CAST(sum(u) AS BIGINT) + 2) // 4 AS u, (CAST(sum(v) AS BIGINT) + 2) // 4 AS v FROM c GROUP BY 1, 2, 3)"""


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.pack_pixels(orders_px(spark, sf_dir), 50, 30)


def order_video(spark: SparkSession, sf_dir: str) -> str:
    """The frames as Y4M files, in ten videos of 30000 / 1001 frames a second."""
    path = streams.work_dir(spark)
    frames = order_frames(spark, sf_dir)
    frame_files.write_y4m(frames.withColumn("video_id", F.concat(F.lit("v"), F.col("frame_id") % 10)), path, 30000, 1001)
    return path


@query("yuv420p", f"""{YUV} SELECT {big('frame_id')}, CAST(0 AS BIGINT) AS plane, {big('y', 'x')}, CAST(lum AS BIGINT) AS v FROM c
    UNION ALL SELECT {big('frame_id')}, 1, {big('y', 'x')}, u FROM q UNION ALL SELECT {big('frame_id')}, 2, {big('y', 'x')}, v FROM q""")
def _(spark, sf_dir):
    return packed.unpack_yuv420p(packed.yuv420p(order_frames(spark, sf_dir)))


def _byte_sql(red: int, green: int, name: str) -> str:
    """One channel out of limited-range YUV: the factors of u and v."""
    return f"CAST(least(255, greatest(0, floor((298*(c.lum - 16) + {red}*(q.u - 128) + {green}*(q.v - 128) + 128) / 256.0))) AS BIGINT) AS {name}"


@query("y4m_roundtrip", f"""{YUV} SELECT {big('c.frame_id', 'c.y', 'c.x')}, {_byte_sql(0, 409, 'r')}, {_byte_sql(-100, -208, 'g')}, {_byte_sql(516, 0, 'b')}
    FROM c JOIN q ON c.frame_id = q.frame_id AND c.y // 2 = q.y AND c.x // 2 = q.x""")
def _(spark, sf_dir):
    return packed.unpack(frame_files.read_y4m(spark, order_video(spark, sf_dir)))


@query("y4m_info", """WITH n AS (SELECT 'v' || (f % 10) AS video_id, count(*) AS frames FROM (SELECT DISTINCT o_orderkey // 1500 AS f FROM orders) GROUP BY 1)
    SELECT video_id, CAST(50 AS BIGINT) AS width, CAST(30 AS BIGINT) AS height, '50x30' AS resolution, 30000 / 1001.0::DOUBLE AS rate, CAST(frames AS BIGINT) AS frames, frames / (30000 / 1001.0::DOUBLE) AS seconds, 'rawvideo' AS codec, '420jpeg' AS pixel_format FROM n""")
def _(spark, sf_dir):
    files = frame_files.y4m_info(spark, order_video(spark, sf_dir))
    v = files.groupBy("video_id", "width", "height", "rate_num", "rate_den", "codec", "pixel_format").agg(F.sum("nb_frames").alias("frames"))
    v = v.withColumn("rate", geometry.frame_rate(F.col("rate_num"), F.col("rate_den")))
    return v.select("video_id", "width", "height", F.format_string("%dx%d", "width", "height").alias("resolution"), "rate", "frames", geometry.duration_seconds(F.col("frames"), F.col("rate")).alias("seconds"), "codec", "pixel_format")


@query("frame_roundtrip", f"WITH {EVENTS_PX} SELECT {big('frame_id', 'y', 'x', 'r', 'g', 'b')} FROM px")
def _(spark, sf_dir):
    path = streams.work_dir(spark)
    frame_files.write_ppm(event_frames(spark, sf_dir).withColumn("video_id", F.lit("events")), path)
    return packed.unpack(frame_files.read_ppm(spark, path))


@query("stream_frames", ORACLE_SQL["gray_pixels"])
def _(spark, sf_dir):
    return streams.stream_gray(spark, sf_dir).select("frame_id", "y", "x", "gray")


@query("stream_progress", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS frames FROM events GROUP BY 1")
def _(spark, sf_dir):
    return streams.stream_counts(spark, sf_dir).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("day"), "frames")
