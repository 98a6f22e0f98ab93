"""Dense ranks of distinct keys and range buckets of integer positions, without a window over the whole table in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.runtime import cut


def dense_ranks(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Each distinct combination of ``keys`` with its 0-based rank in sort order (nulls first, as one key).

    The distinct keys are range partitioned, so that each partition ranks its own; the sizes of the partitions before it, one
    number each, are added. An empty table gives an empty result.
    """
    spread = df.select(*keys).distinct().repartitionByRange(*keys).withColumn("__gl_p", F.spark_partition_id())
    spread = cut(spread, "ranks")
    offsets, total = [], 0
    for p, n in sorted(tuple(r) for r in spread.groupBy("__gl_p").agg(F.count("*").alias("n")).collect()):
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    before = F.broadcast(spark.createDataFrame(offsets, "__gl_p int, __gl_before bigint"))  # one row per partition
    own = F.row_number().over(Window.partitionBy("__gl_p").orderBy(*keys)) - 1
    return spread.withColumn("__gl_own", own).join(before, "__gl_p").select(*keys, (F.col("__gl_before") + F.col("__gl_own")).alias(rank))


def range_buckets(df: DataFrame, position: str, bucket: str, buckets: int) -> tuple[DataFrame, Bucketizer | None]:
    """``df`` with the number of its range bucket: buckets are about equally full, and later positions never have a lower number.

    ``position`` is a double. The bounds are approximate quantiles of all rows (a mergeable summary of bounded size); the returned
    bucketizer places further rows. Rows of one position share a bucket.
    """
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.approxQuantile(position, probs, 1 / (4 * buckets)))) if buckets > 1 else []
    if not cuts:
        return df.withColumn(bucket, F.lit(0)), None
    place = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=position, outputCol=bucket, handleInvalid="error")
    return place.transform(df).withColumn(bucket, F.col(bucket).cast("int")), place
