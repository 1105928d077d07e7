"""Scoring of trajectories that arrive as files, with idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.relational import upsert

BUCKETS = 256


def versions(spark: SparkSession, target: str) -> dict[int, list[int]]:
    """Versions of each bucket of a target, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = path(target).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path(f"{target}/v=*/bucket=*")) or []
    out: dict[int, list[int]] = {}
    for s in found:
        bucket, version = s.getPath().getName(), s.getPath().getParent().getName()
        out.setdefault(int(bucket.split("=")[1]), []).append(int(version.split("=")[1]))
    return {k: sorted(v) for k, v in out.items()}


def current(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a target: of each bucket its last version."""
    return spark.read.parquet(*[f"{target}/v={v[-1]}/bucket={k}" for k, v in sorted(versions(spark, target).items())])


def score_stream(spark: SparkSession, folder: str, schema: str, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "sample_id", buckets: int = BUCKETS) -> StreamingQuery:
    """Score JSON files that appear in ``folder`` and merge them into the Parquet table ``target`` by key; ``current`` reads it.

    The table lies in buckets by the key's hash.  Each batch writes a new
    version, named by batch, of the buckets that it touches, so that a batch
    that is run again after a failure gives the same table; of each bucket the
    version before the last stays for those who still read it.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        new = score(batch.dropDuplicates([key])).withColumn("bucket", bucket).persist()
        try:
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]
            before = {k: [v for v in versions(spark, target).get(k, []) if v < number] for k in touched}
            read = [f"{target}/v={v[-1]}/bucket={k}" for k, v in before.items() if v]
            rows = new
            if read:
                old = spark.read.schema(new.drop("bucket").schema).parquet(*read).withColumn("bucket", bucket)
                rows = upsert(old, new, new, key)
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
            path = spark._jvm.org.apache.hadoop.fs.Path
            fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
            for k, v in before.items():
                for old_version in v[:-1]:
                    fs.delete(path(f"{target}/v={old_version}/bucket={k}"), True)
        finally:
            new.unpersist()

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
