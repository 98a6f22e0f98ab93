"""Incremental versions of curation operators on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_reports(stream: DataFrame, key: list[str], at: str, late: str = "7 days") -> DataFrame:
    """Each evaluation once: repeats that arrive within the watermark are dropped, and state older than it is forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed_stats(stream: DataFrame, entity: str, number: Column, at: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows, numbers and mean score per entity and window of event time; a window is final once the watermark passes it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), entity).agg(F.count("*").alias("n_rows"), F.count(number).alias("n_scores"), F.avg(number).alias("mean_score")).select(F.col("w.start").alias("start"), entity, "n_rows", "n_scores", "mean_score")


def append_new(stream: DataFrame, target: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet table the rows whose key it doesn't hold yet; a batch that is run again changes nothing."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        # Only an absent table counts as empty; any other failure to read it is an error and never a duplicate.
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            held = spark.read.parquet(target)
            cond = None
            renamed = held.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
            for c in key:
                one = F.col(c).eqNullSafe(F.col(f"_{c}"))
                cond = one if cond is None else cond & one
            fresh = fresh.join(renamed, cond, "left_anti")
        fresh.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
