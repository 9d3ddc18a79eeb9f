"""The changes as streams: filled, validated, rolled up and applied as rows arrive.

A sink writes a micro-batch under its batch number, so a batch that is run again
replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import column
from ..operators.constraints import failed_names
from ..operators.feed import apply_feed, last_changes


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files under ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_batches(stream: DataFrame, folder: str, checkpoint: str, parts: dict[str, Callable[[DataFrame], DataFrame]], mode: str = "append") -> None:
    """Write each micro-batch's ``parts`` as tables ``folder/name/batch=n``, all that is available now."""

    def one(batch: DataFrame, n: int) -> None:
        for name, f in parts.items():
            f(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fill_new_rows(stream: DataFrame, name: str, sources: DataFrame, on: str, value: str) -> DataFrame:
    """Rows filled before they land: a supplied value is kept, else the static ``sources``' one by ``on`` is taken."""
    known = sources.select(F.col(on).alias("__on"), column(value).alias("__value"))
    return stream.join(known, F.col(on) == F.col("__on"), "left").withColumn(name, F.coalesce(F.col(name), F.col("__value"))).drop("__on", "__value")


def quarantine_stream(stream: DataFrame, constraints: dict[str, str], folder: str, checkpoint: str) -> None:
    """Split a stream in ``clean`` and ``rejected`` tables; rejected rows carry the names that they fail."""
    marked = stream.withColumn("failed", failed_names(constraints))
    write_batches(marked, folder, checkpoint, {"clean": lambda b: b.filter(F.size("failed") == 0).drop("failed"), "rejected": lambda b: b.filter(F.size("failed") > 0)})


def cagg_stream(stream: DataFrame, ts: str, bucket: str, keys: list[str], aggs: dict[str, Column], delay: str) -> DataFrame:
    """A time-bucketed rollup of a stream (``aggs`` by name); rows later than ``delay`` are dropped, a bucket comes out once it is closed.

    Watermarks need a zoned time, so it is cast there and back (session zone UTC).
    """
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    return rows.groupBy(F.window("__ts", bucket).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()]).select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), *keys, *aggs)


def window_stream(stream: DataFrame, ts: str, kind: str, duration: str, keys: list[str], delay: str, slide: str | None = None) -> DataFrame:
    """``start, end``, keys and ``rows`` of tumbling, sliding or session windows of a stream.

    A window comes out once the watermark, ``delay`` behind the latest time of the batches
    before, is past its end; until then it is kept in the state, over batches and restarts, and a session
    grows and merges with others as rows come. Later rows for a closed window are dropped.
    """
    if kind not in ("tumbling", "sliding", "session"):
        raise ValueError(f"no kind of window {kind}")
    rows = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    w = F.session_window("__ts", duration) if kind == "session" else F.window("__ts", duration, slide or duration)
    return rows.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), *keys, "rows")


def incremental_apply(stream: DataFrame, change: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> DataFrame:
    """Apply a change in restartable slices; the cursor is the stream's checkpoint and moves with the data."""
    write_batches(stream, folder, checkpoint, {"rows": change})
    return stream.sparkSession.read.parquet(f"{folder}/rows").drop("batch")


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers ``n`` of the finished tables ``folder/name=n``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or [])


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def subscribe(stream: DataFrame, target: DataFrame, key: list[str], folder: str, checkpoint: str, sequence: str = "seq", compact_after: int = 16) -> DataFrame:
    """Apply a feed's micro-batches to ``target``, each change once, and return the table as it is then.

    ``target`` is copied when the folder is new. A micro-batch writes the last change
    per key under its number, so running it again replaces it; the table is never
    rewritten for a batch. After ``compact_after`` batches they are folded into a new
    copy; the copy before it stays for who reads it still, older copies and the changes in them are deleted. A restart goes on from what the folder and the checkpoint hold, also when
    nothing new has come. A later batch wins over an earlier one whatever its ``seq``.
    """
    spark = target.sparkSession
    if not _numbers(spark, folder, "copy"):
        target.write.mode("overwrite").parquet(f"{folder}/copy=-1")

    def table() -> tuple[DataFrame, int]:
        """The newest copy with the changes after it, and how many batches those are."""
        last = _numbers(spark, folder, "copy")[-1]
        copy = spark.read.schema(target.schema).parquet(f"{folder}/copy={last}")
        after = [n for n in _numbers(spark, folder, "changes") if n > last]
        if not after:
            return copy, 0
        parts = [spark.read.parquet(f"{folder}/changes={n}").withColumn(sequence, F.struct(F.lit(n).alias("n"), F.col(sequence).alias("s"))) for n in after]
        return apply_feed(copy, reduce(DataFrame.unionByName, parts), key, sequence), len(after)

    def one(batch: DataFrame, n: int) -> None:
        last_changes(batch, key, sequence).write.mode("overwrite").parquet(f"{folder}/changes={n}")
        now, batches = table()
        if batches >= compact_after:
            now.write.mode("overwrite").parquet(f"{folder}/copy={n}")
            *_, kept, _ = _numbers(spark, folder, "copy")
            for name, first in (("copy", kept), ("changes", kept + 1)):
                _delete(spark, [f"{folder}/{name}={m}" for m in _numbers(spark, folder, name) if m < first])

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return table()[0]
