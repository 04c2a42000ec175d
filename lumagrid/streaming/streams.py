"""The frame dataflow over growing inputs, with Structured Streaming."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import gray
from ..sources.adapters import events_pixels


def work_dir(spark: SparkSession) -> str:
    """A new folder that all executors reach; without ``spark.checkpoint.dir`` only local mode has one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stream-") if not base else f"{base.rstrip('/')}/stream-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"


def file_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """New files of a table; back-pressure is the number of files a trigger takes."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def drain(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run to the end of what is there, into files; a restart with the same checkpoint goes on after it."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray pixels of arriving events: stateless, so no watermark is needed."""
    base = work_dir(spark)
    pixels = events_pixels(file_stream(spark, sf_dir, "events")).withColumn("gray", gray())
    return drain(pixels, f"{base}/out", f"{base}/checkpoint")


def count_windows(events: DataFrame, path: str, checkpoint: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, frames): rows a window of event time ``ts``, run to the end of what is there.

    Rows that are more than ``late`` behind the latest of earlier batches are dropped where their window is closed, and
    closed windows leave the state, so that it holds one row an open window. A batch writes only the
    windows it changed, under its own number, so a batch that is repeated after a failure replaces itself; the result
    is each window's row of the last batch. A restart with the same checkpoint goes on where it ended.
    """
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("frames"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counts = counts.select(F.col("w.start").alias("start"), "frames")
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = events.sparkSession.read.schema("start timestamp, frames long, batch long").parquet(path)
    return done.groupBy("start").agg(F.max_by("frames", "batch").alias("frames"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames a day of arriving events."""
    base = work_dir(spark)
    events = file_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return count_windows(events, f"{base}/out", f"{base}/checkpoint")
