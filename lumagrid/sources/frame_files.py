"""Frame files: raw RGB24, binary PPM and YUV4MPEG2 (Y4M), read through Spark's file source and written by a Data Source.

Reading uses ``binaryFile``, so any store that Spark reaches will do; a file is one row until it is cut into frames, so
long videos belong in several files. Writing makes such files: the frames of a task and video follow each other
in a segment of SEGMENT_BYTES or a little more, each with its number, so that neither one file a frame nor one task a video is needed.
Y4M frames keep their number in an X tag of their FRAME line, PPM frames in a comment.

A task writes to the folder of its attempt; the commit moves its segments (a few a task) to the target, an abort
removes the job's folder. Stores are reached through Arrow's file systems.
"""

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.packed import from_yuv, to_yuv

FRAME = "video_id string, frame_id long, width int, height int, data binary"
SEGMENT_BYTES = 64_000_000
_PPM = re.compile(rb"P6\s+(?:#(?: frame (\d+))?[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s")
_Y4M = re.compile(rb"YUV4MPEG2((?: [^ \n]+)*) ?\n")
_MARK = re.compile(rb"FRAME((?: [^ \n]+)*)\n")
_LONGEST_HEADER = 1024
#: Chroma layouts of Y4M, as (columns, rows) of pixels that share a sample; (0, 0) is no chroma.
CHROMA = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1), "mono": (0, 0)}


def _binary(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _frame(video: str, number: int, width: int, height: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"video_id": [video], "frame_id": pa.array([number], pa.int64()), "width": pa.array([width], pa.int32()), "height": pa.array([height], pa.int32()), "data": [data]})


def read_raw(spark: SparkSession, path: str, width: int, height: int, glob: str = "*.rgb") -> DataFrame:
    """Frames of raw RGB24 files; a trailing part of a frame is an error, as a wrong size would be unseen."""
    size = 3 * width * height

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                raw = content.as_buffer()
                if len(raw) % size:
                    raise ValueError(f"{name}: {len(raw)} bytes are not whole frames of {size}")
                for i in range(len(raw) // size):
                    yield _frame(name, i, width, height, raw[i * size : (i + 1) * size].to_pybytes())

    return _binary(spark, path, glob).mapInArrow(cut, FRAME)


def _named(name: str) -> tuple[str, int]:
    """(video, number of the first frame) out of video_number.suffix; other names are the video's."""
    m = re.fullmatch(r"(.+)_(\d+)(?:-[0-9a-f]+)?\.[^.]+", name)
    return (m[1], int(m[2])) if m else (name.rsplit(".", 1)[0], 0)


def ppm_frames(name: str, content: bytes) -> Iterator[tuple[str, int, int, int, bytes]]:
    video, number = _named(name)
    at = 0
    while at < len(content):
        m = _PPM.match(content, at)
        if not m:
            raise ValueError(f"{name}: not a binary PPM of 255 levels")
        w, h = int(m[2]), int(m[3])
        number = int(m[1]) if m[1] else number
        at = m.end() + 3 * w * h
        if at > len(content):
            raise ValueError(f"{name}: the size doesn't fit {w} x {h}")
        yield video, number, w, h, content[m.end() : at]
        number += 1


def y4m_header(name: str, content: bytes) -> tuple[int, int, int, tuple[int, int]]:
    """(end of the header, width, height, chroma layout)."""
    m = _Y4M.match(content[:_LONGEST_HEADER])
    if not m:
        raise ValueError(f"{name}: not a YUV4MPEG2 file")
    tags = {t[:1]: t[1:] for t in m[1].decode("latin-1").split() if t[0] != "X"}
    w, h, layout = int(tags.get("W", 0)), int(tags.get("H", 0)), tags.get("C", "420")
    if w <= 0 or h <= 0:
        raise ValueError(f"{name}: a frame needs a positive width and height")
    if layout not in CHROMA:
        raise ValueError(f"{name}: samples of layout {layout} can't be read")
    return m.end(), w, h, CHROMA[layout]


def y4m_frames(name: str, content: bytes) -> Iterator[tuple[str, int, int, int, bytes]]:
    video, number = _named(name)
    at, w, h, chroma = y4m_header(name, content)
    planes = [(h, w)] + ([(-(-h // chroma[1]), -(-w // chroma[0]))] * 2 if chroma[0] else [])
    size = sum(a * b for a, b in planes)
    while at < len(content):
        m = _MARK.match(content, at)
        if not m or m.end() + size > len(content):
            raise ValueError(f"{name}: cut off or damaged at byte {at}")
        for tag in m[1].split():
            if tag.startswith(b"Xframe="):
                number = int(tag[7:])
        at, yuv = m.end(), []
        for shape in planes:
            yuv.append(np.frombuffer(content, np.uint8, shape[0] * shape[1], at).reshape(shape))
            at += shape[0] * shape[1]
        yield video, number, w, h, from_yuv(yuv, chroma).tobytes()
        number += 1


def _read(spark: SparkSession, path: str, glob: str, frames) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content"), strict=True):
                for f in frames(name, content.as_py()):
                    yield _frame(*f)

    return _binary(spark, path, glob).mapInArrow(parse, FRAME)


def read_ppm(spark: SparkSession, path: str, glob: str = "*.ppm") -> DataFrame:
    """Frames of PPM files of one or many images, named video_number.ppm after their first frame."""
    return _read(spark, path, glob, ppm_frames)


def read_y4m(spark: SparkSession, path: str, glob: str = "*.y4m") -> DataFrame:
    """Frames of Y4M files as RGB24 of the same size, whatever their chroma layout."""
    return _read(spark, path, glob, y4m_frames)


def y4m_info(spark: SparkSession, path: str, glob: str = "*.y4m") -> DataFrame:
    """One row a file: video_id, width, height, rate_num, rate_den, nb_frames, codec, pixel_format; built-in functions only.

    Only headers are looked at: the number of frames follows from the file's length if all FRAME lines are as long as the
    first, and is 0 (unknown) where that does not come out even. A file that isn't Y4M is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    head = F.decode(F.substring("content", 1, _LONGEST_HEADER), "ISO-8859-1")
    t = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length"), head.alias("head"))
    t = t.withColumn("head", F.when(F.col("head").startswith("YUV4MPEG2"), F.col("head")).otherwise(F.raise_error(F.concat("name", F.lit(": not a YUV4MPEG2 file")))))
    t = t.withColumns({"first": F.substring_index("head", "\n", 1), "mark": F.length(F.element_at(F.split("head", "\n"), 2)) + 1})
    tag = lambda p: F.regexp_extract("first", f" {p}", 1)
    number = lambda p: F.coalesce(F.try_to_number(tag(p), F.lit("9" * 10)), F.lit(0)).cast("long")
    w, h, layout = F.col("width"), F.col("height"), F.col("pixel_format")
    t = t.withColumns({"width": number("W(\\d+)"), "height": number("H(\\d+)"), "rate_num": number("F(\\d+):"), "rate_den": number("F\\d+:(\\d+)"), "pixel_format": F.when(tag("C(\\w+)") == "", "420").otherwise(tag("C(\\w+)"))})
    half = lambda x: F.floor((x + 1) / 2)
    chroma = F.when(layout == "mono", 0).when(layout == "444", 2 * w * h).when(layout == "422", 2 * half(w) * h).otherwise(2 * half(w) * half(h))
    each, body = w * h + chroma + F.col("mark"), F.col("length") - F.length("first") - 1
    frames = F.when((body > 0) & (body % each == 0), F.floor(body / each)).otherwise(0).cast("long")
    return t.select(F.regexp_replace("name", "(_\\d+(-[0-9a-f]+)?)?\\.[^.]+$", "").alias("video_id"), "width", "height", "rate_num", "rate_den", frames.alias("nb_frames"), F.lit("rawvideo").alias("codec"), "pixel_format")


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class FrameSource(DataSource):
    """``df.write.format("frame_segments").mode("append").option("container", "y4m").save(path)``: rows sorted by video and frame."""

    @classmethod
    def name(cls) -> str:
        return "frame_segments"

    def schema(self) -> str:
        return FRAME

    def writer(self, schema, overwrite):
        return FrameWriter(self.options)


def _store(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.container = options["path"].rstrip("/"), options.get("container", "ppm")
        self.rate = f"{int(options.get('rate_num', 30))}:{int(options.get('rate_den', 1))}"
        self.job = uuid.uuid4().hex
        if self.container not in ("ppm", "y4m"):
            raise ValueError(f"no container {self.container}")

    def _bytes(self, r, first: bool) -> bytes:
        w, h, data = r["width"], r["height"], bytes(r["data"])
        if w <= 0 or h <= 0 or len(data) != 3 * w * h:
            raise ValueError("the data doesn't fit the frame's size")
        if self.container == "ppm":
            return b"P6\n# frame %d\n%d %d\n255\n" % (r["frame_id"], w, h) + data
        head = b"YUV4MPEG2 W%d H%d F%s Ip A1:1 C420jpeg\n" % (w, h, self.rate.encode()) if first else b""
        planes = to_yuv(np.frombuffer(data, np.uint8).reshape(h, w, 3))
        return head + b"FRAME Xframe=%018d\n" % r["frame_id"] + b"".join(p.tobytes() for p in planes)

    def write(self, rows) -> Written:
        store, root = _store(self.path)
        attempt = TaskContext.get().taskAttemptId()
        folder = f"{root}/_temporary-{self.job}/{attempt}"
        names, out, key, size = [], None, None, 0
        try:
            for r in rows:
                kind = (r["video_id"], r["width"], r["height"])
                if kind != key or size >= SEGMENT_BYTES:
                    if out:
                        out.close()
                    if not names:
                        store.create_dir(folder, recursive=True)
                    names.append(f"{attempt}/{r['video_id']}_{r['frame_id']:09d}-{self.job[:8]}{attempt:x}.{self.container}")
                    out, key, size = store.open_output_stream(f"{root}/_temporary-{self.job}/{names[-1]}"), kind, 0
                part = self._bytes(r, size == 0)
                out.write(part)
                size += len(part)
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{root}/_temporary-{self.job}/{name}", f"{root}/{name.split('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        folder = f"{root}/_temporary-{self.job}"
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def _write(frames: DataFrame, path: str, **options) -> None:
    frames.sparkSession.dataSource.register(FrameSource)
    rows = frames.select("video_id", "frame_id", "width", "height", "data").sortWithinPartitions("video_id", "frame_id")
    rows.write.format("frame_segments").mode("append").options(**options).save(path)


def write_ppm(frames: DataFrame, path: str) -> None:
    """Segments of PPM images; the folder has to be reached by all executors."""
    _write(frames, path, container="ppm")


def write_y4m(frames: DataFrame, path: str, rate_num: int = 30, rate_den: int = 1) -> None:
    """Segments of Y4M (4:2:0) with a rational rate; a frame's number is its time in units of 1 / rate. Sizes have to be even."""
    if rate_num <= 0 or rate_den <= 0:
        raise ValueError("a rate needs positive numbers")
    _write(frames, path, container="y4m", rate_num=rate_num, rate_den=rate_den)
