"""Incremental re-scan: files that arrive are fingerprinted and searched once for each content."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions import content

SCHEMA = "path string, text string"


def rescan(spark: SparkSession, incoming: str, results: str, checkpoint: str, patterns: Mapping[str, str]) -> StreamingQuery:
    """Reads new JSON files (path, text) below ``incoming``, and appends the keyword matches of contents not seen before.

    Below ``results``: ``contents`` (fingerprint), ``files`` (path, fingerprint) and ``matches`` (fingerprint, name,
    ordinal, match), partitioned by batch. A batch that is run again overwrites what it wrote, so each counts once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        files = rows.where("text IS NOT NULL").select("path", "text", content.raw_fingerprint(F.col("text")).alias("fingerprint"))
        new = files.groupBy("fingerprint").agg(F.min("text").alias("text"))
        if number and (before := _read(session, f"{results}/contents", "fingerprint string, batch long")) is not None:
            new = new.join(before.where(F.col("batch") < number), "fingerprint", "left_anti")
        out = lambda df, name: df.write.mode("overwrite").parquet(f"{results}/{name}/batch={number}")
        out(content.keyword_matches(new, patterns, "fingerprint").withColumnRenamed("path", "fingerprint"), "matches")
        out(files.select("path", "fingerprint"), "files")
        out(new.select("fingerprint"), "contents")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1000).json(incoming)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return spark.read.schema(schema).parquet(path) if fs.exists(target) else None


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): events by window; those later than the watermark are left out of a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
