"""Streams, packets, frame selection and stage metrics."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.report import rating


def first_streams(packets: DataFrame) -> DataFrame:
    """(video_id, video_index, audio_index): the first stream of each kind, -1 if there is none."""
    first = lambda kind: F.coalesce(F.min(F.when(F.col("kind") == kind, F.col("stream_index"))), F.lit(-1))
    return packets.groupBy("video_id").agg(first("video").alias("video_index"), first("audio").alias("audio_index"))


def route_packets(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets of the first video or audio stream with their route; the rest is dropped."""
    p = packets.join(streams, "video_id")
    route = F.when(F.col("stream_index") == F.col("video_index"), "video").when(F.col("stream_index") == F.col("audio_index"), "audio")
    return p.withColumn("route", route).filter(F.col("route").isNotNull()).drop("video_index", "audio_index")


def rescale_pts(pts, num_in: int, den_in: int, num_out: int, den_out: int):
    """pts in another time base, rounded to the nearest, halves away from zero."""
    a, b = num_in * den_out, den_in * num_out
    n = pts.cast("long") * a
    return (F.signum(n) * F.floor((F.abs(n) * 2 + b) / (2 * b))).cast("long")


def limit_frames(frames: DataFrame, most: int) -> DataFrame:
    """Frames before number ``most``; 0 and less mean all. A filter, so that it reaches the scan."""
    return frames.filter(F.col("frame_id") < most) if most > 0 else frames


def seek_frames(frames: DataFrame, first: int) -> DataFrame:
    if first < 0:
        raise ValueError("a frame number can't be negative")
    return frames.filter(F.col("frame_id") >= first)


def assign_pts(frames: DataFrame, video: str = "video_id", order: str = "frame_id") -> DataFrame:
    return frames.withColumn("pts", F.row_number().over(Window.partitionBy(video).orderBy(order)) - 1)


def stage_totals(times: DataFrame) -> DataFrame:
    return times.groupBy("stage").agg(F.sum("elapsed_ms").alias("total_ms"), F.count("*").alias("n"))


def frame_stats(times: DataFrame) -> DataFrame:
    """One row: frames, total, mean ms a frame, theoretical rate and rating; zeros without frames."""
    t = times.groupBy("frame_id").agg(F.sum("elapsed_ms").alias("ms")).agg(F.count("*").alias("frames"), F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"))
    t = t.withColumn("mean_ms", F.coalesce(F.try_divide(F.col("total_ms").cast("double"), "frames"), F.lit(0.0)))
    t = t.withColumn("fps", F.coalesce(F.try_divide(F.lit(1000.0), "mean_ms"), F.lit(0.0)))
    return t.withColumn("rating", rating(F.col("mean_ms")))


def observed(frames: DataFrame, observation) -> DataFrame:
    """Counts frames while they pass to a sink: ``observation.get['frames']`` afterwards."""
    return frames.observe(observation, F.count("*").alias("frames"))


def interleave(video: DataFrame, audio: DataFrame) -> DataFrame:
    """Both tables in one, in the order of a muxer: by time, video before audio; sorted within partitions."""
    both = video.withColumn("rank", F.lit(0)).unionByName(audio.withColumn("rank", F.lit(1)))
    return both.repartitionByRange("video_id", "pts", "rank").sortWithinPartitions("video_id", "pts", "rank")
