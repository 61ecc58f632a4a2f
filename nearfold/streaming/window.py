"""A sliding window over an insertion stream, by count: the last ``window`` of the sequence stay live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def live_snapshots(source: DataFrame, root: str, window: int, checkpoint: str, vec: str = "vec"):
    """Start a streaming query over (seq, id, vec): each micro-batch writes an immutable snapshot of the live rows.

    Snapshot ``root/batch=N`` holds the rows with seq above the highest seq seen minus ``window``, the last seq of an id
    deciding. A batch reads the snapshot before it, so its work depends on the window and the batch, not on
    the stream's length; a repeated batch overwrites its own snapshot, so results are exact after failures.
    """
    if window < 1:
        raise ValueError("window must be positive")

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.filter("seq is not null and id is not null").select("seq", "id", vec)
        before = latest(spark, root, number)
        rows = new if before is None else before.unionByName(new)
        top = rows.agg(F.max("seq")).first()[0]
        if top is None:
            return
        kept = rows.filter(F.col("seq") > top - window).groupBy("id").agg(F.max(F.struct("seq", vec)).alias("x")).select("x.seq", "id", f"x.{vec}")
        kept.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def latest(spark: SparkSession, root: str, below: int | None = None) -> DataFrame | None:
    """The newest complete snapshot, or the newest before batch ``below``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = [int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{root}/batch={max(done)}") if done else None


def run_available(writer) -> StreamingQuery:
    """Process what is there and stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def event_rate(events: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, end, n): events per window of event time; those later than ``late`` are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"))
    return w.select("window.start", "window.end", "n")
