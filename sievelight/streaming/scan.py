"""The line detectors on a stream of (path, content) files or rows.

Detectors keep no state over rows (neighbouring lines come from a row's own array), so they run on a stream
as they do on a table.  What is new is decided per micro-batch against the fingerprints of earlier batches, which lie
apart from the findings, by their first two digits: a batch reads those of its own digits only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import detect, post

_SEEN = "fingerprint string, batch long, digits string"


def findings(stream: DataFrame) -> DataFrame:
    """Findings of the stateless detectors."""
    out = detect.scan_rules(stream)
    for part in (detect.scan_entropy_tokens, detect.scan_contextual, detect.scan_auth_headers, detect.scan_url_secrets, detect.scan_multiline):
        out = out.unionByName(part(stream))
    return out


def _seen(spark: SparkSession, path: str) -> DataFrame:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], _SEEN)
    return spark.read.schema(_SEEN).parquet(path)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Scan Parquet files (path, content) that arrive in source; new findings go to sink, one folder a batch, and
    their fingerprints to sink's neighbour of the name _seen.

    A batch that is run again replaces its folders, so findings are written once."""
    stream = spark.readStream.schema("path string, content string").parquet(source)
    known = f"{sink.rstrip('/')}_seen"

    def write(batch: DataFrame, number: int) -> None:
        rows = post.with_fingerprints(post.deduplicated(batch)).drop("ignore_id").withColumn("digits", F.substring("fingerprint", 1, 2)).persist()
        try:
            digits = [r["digits"] for r in rows.select("digits").distinct().collect()]  # 256 at most
            before = _seen(spark, known).where(F.col("digits").isin(digits) & (F.col("batch") != number)).select("fingerprint")
            fresh = rows.join(before.distinct(), "fingerprint", "left_anti")
            fresh.drop("digits").write.mode("overwrite").parquet(f"{sink}/batch={number}")
            new = spark.read.parquet(f"{sink}/batch={number}").select("fingerprint").distinct().withColumn("digits", F.substring("fingerprint", 1, 2)).withColumn("batch", F.lit(number).cast("long"))
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("digits", "batch").parquet(known)
        finally:
            rows.unpersist()

    query = findings(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
