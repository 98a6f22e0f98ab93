"""References to keys that are not there: runs of parent keys and as-of matching of references to them.

Defined results. A null reference is no reference. A key that no run holds is an orphan at any position. Repeated log entries and
entries out of order change nothing; of entries of one key at one instant the one with the largest tie value counts. Empty logs
make every reference an orphan; empty references give an empty result. Further columns of the references pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.ranks import dense_ranks, range_buckets
from gridloom.runtime import checked_broadcast, cut

#: References that one bucket of the as-of match holds, about, once there are more than the session's shuffle partitions take.
BUCKET_ROWS = 1_000_000
_RUN = "struct<code:bigint,run_start:bigint,run_end:bigint>"


def integer_runs(keys: DataFrame, key: str, block: int = 1 << 20) -> DataFrame:
    """Sorted distinct integers as contiguous runs (run_start, run_end), without a global sort in one task.

    Runs are found within blocks of the key space, so a run over a block's edge comes as one run per block; to match references to
    their preceding run start, these are as good as one.
    """
    k = F.col(key).cast("long")
    uniq = keys.select(k.alias("k")).filter("k is not null").distinct().withColumn("b", F.floor(F.col("k") / block))
    w = Window.partitionBy("b").orderBy("k")
    return uniq.withColumn("i", F.col("k") - F.row_number().over(w)).groupBy("b", "i").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end")).drop("b", "i")


def validity_runs(log: DataFrame, keys: list[str], at: str, on: Column, tie: str) -> DataFrame:
    """The spans [run_start, run_end) of integer time in which each key is in force; run_end is null for a span still open.

    ``log`` holds one row per change; ``on`` is true where a change puts the key in force. Repeats are dropped by an aggregation
    before the window, and each task of the window sorts single keys' changes and streams over them.
    """
    change = log.select(*keys, F.col(at).alias("t"), on.alias("on"), F.col(tie).alias("tie")).filter(F.col("t").isNotNull())
    change = change.groupBy(*keys, "t").agg(F.max_by("on", "tie").alias("on"))
    w = Window.partitionBy(*keys).orderBy("t")
    flips = change.withColumn("was", F.lag("on").over(w)).filter("was is null or was <> on")
    return flips.withColumn("run_end", F.lead("t").over(w)).filter("on").select(*keys, F.col("t").alias("run_start"), "run_end")


def preceding_runs(refs: DataFrame, runs: DataFrame, code: str, at: str, slice_width: int) -> DataFrame:
    """``refs`` with ``run``, the last run of the same code that starts at or before the reference's place (null: none).

    Places are pairs of integers (code, at); both columns must hold no nulls. References and run starts are cut into range buckets
    of about equally many references, so that a hot code is spread by ``at`` over several; the last run that starts before a bucket
    is carried into it (one row per bucket passes the driver). Places of one code and slice of ``slice_width`` share a bucket. Within a bucket one sorted pass carries the last run start along.
    """
    spark = refs.sparkSession
    bounds = refs.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n")).first()
    if not bounds.n:
        return refs.withColumn("run", F.lit(None).cast(_RUN))
    slices = float((bounds.hi - bounds.lo) // slice_width + 1)
    place = lambda x: F.col(code) + F.least(F.greatest(F.floor((F.col(x) - bounds.lo) / slice_width) / F.lit(slices), F.lit(0.0)), F.lit(1.0 - 1e-9))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bounds.n // BUCKET_ROWS)
    placed, by = range_buckets(refs.withColumn("__gl_place", place(at)), "__gl_place", "__gl_bucket", buckets)
    starts = runs.select(F.col(code), F.col("run_start").alias(at), F.struct(F.col(code).cast("bigint").alias("code"), F.col("run_start").cast("bigint").alias("run_start"), F.col("run_end").cast("bigint").alias("run_end")).alias("run"))
    starts = starts.withColumn("__gl_place", place(at))
    starts = by.transform(starts).withColumn("__gl_bucket", F.col("__gl_bucket").cast("int")) if by else starts.withColumn("__gl_bucket", F.lit(0))
    last = {r[0]: r[1] for r in starts.groupBy("__gl_bucket").agg(F.max("run")).collect()}
    carried, held = [], None
    for b in range(len(by.getSplits()) - 1 if by else 1):
        if held is not None:
            carried.append((b, held.code, held.run_start, tuple(held)))
        held = max(filter(None, (held, last.get(b))), default=None)
    carry = spark.createDataFrame(carried, f"__gl_bucket int, {code} bigint, {at} bigint, run {_RUN}")
    is_ref = placed.drop("__gl_place").withColumn("__gl_ref", F.lit(1))
    both = is_ref.unionByName(starts.drop("__gl_place").unionByName(carry, allowMissingColumns=True).withColumn("__gl_ref", F.lit(0)), allowMissingColumns=True)
    seen = Window.partitionBy("__gl_bucket").orderBy(code, at, "__gl_ref").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("run", F.last("run", ignorenulls=True).over(seen)).filter("__gl_ref = 1")
    return met.select(*refs.columns, F.when(F.col("run.code") == F.col(code), F.col("run")).alias("run"))


def orphan_references(refs: DataFrame, runs: DataFrame, keys: list[str], at: str, slice_width: int) -> DataFrame:
    """The references whose key lies in no run at their position ``at``; ``runs`` are those of ``validity_runs``.

    The distinct keys of the runs become dense integers in sort order, so that a parent is a contiguous run of integer places (key,
    position). A reference is matched to its preceding run start and reported if it lies at or beyond that run's end. A key that
    no run holds, or a position that is null, makes an orphan at once.
    """
    codes = checked_broadcast(cut(dense_ranks(runs, keys, "__gl_code"), "codes"))
    spans = cut(runs.join(codes, keys).select("__gl_code", "run_start", "run_end"), "runs")
    coded = cut(refs.join(codes, keys, "left"), "references")
    placeless = F.col("__gl_code").isNull() | F.col(at).isNull()
    met = preceding_runs(coded.filter(~placeless), spans, "__gl_code", at, slice_width)
    beyond = F.col("run").isNull() | F.coalesce(F.col(at) >= F.col("run.run_end"), F.lit(False))
    return coded.filter(placeless).select(*refs.columns).unionByName(met.filter(beyond).select(*refs.columns))


def orphans_of_integers(refs: DataFrame, ref: str, runs: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Rows whose integer reference lies in no run of parent keys: as-of match to the preceding run start, report beyond run end.
    Null references are none."""
    place = refs.filter(F.col(ref).isNotNull()).withColumn("__gl_code", F.lit(0).cast("bigint")).withColumn("__gl_at", F.col(ref).cast("bigint"))
    spans = runs.select(F.lit(0).cast("bigint").alias("__gl_code"), "run_start", (F.col("run_end") + 1).alias("run_end"))
    met = preceding_runs(place, spans, "__gl_code", "__gl_at", block)
    return met.filter(F.col("run").isNull() | (F.col("__gl_at") >= F.col("run.run_end"))).select(*refs.columns)
