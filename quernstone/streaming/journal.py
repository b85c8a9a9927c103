"""Structured Streaming: journals, incremental decontamination and event-time windows. Each runs over what is there and stops, so it can be scheduled again from its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlap


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    batch = spark.read.parquet(path)
    # a stream source takes a folder or a glob
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/{name}.parquet*")


def _run(df: DataFrame, to: str, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start(f"{to}/rows")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{to}/rows")


def first_seen(spark: SparkSession, sf_dir: str, name: str, key: list[str], to: str) -> DataFrame:
    """The journal: one row for each key, exactly once across restarts."""
    return _run(_stream(spark, sf_dir, name).select(*key).dropDuplicates(key), to)


def contaminated(spark: SparkSession, sf_dir: str, to: str) -> DataFrame:
    """(doc_id, item_id, share of the item's grams) of arriving documents; the benchmark's grams are the static side."""
    grams = overlap.positions(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text").select("item_id", "gram").distinct()
    hits = overlap.positions(_stream(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "gram").join(grams, "gram").select("doc_id", "item_id", F.col("gram").alias("g"))
    total = grams.groupBy("item_id").agg(F.count("*").alias("n"))
    return _run(hits, to).groupBy("doc_id", "item_id").agg(F.count_distinct("g").alias("shared")).join(total, "item_id").select("doc_id", "item_id", (F.col("shared") / F.col("n")).alias("share"))


def daily(spark: SparkSession, sf_dir: str, to: str) -> DataFrame:
    """Counts and sums of events in tumbling days. Every batch writes the windows that it changed, under its own number (so
    a batch that runs again replaces its rows); a window's last version counts. Windows older than the watermark are closed,
    and rows that come later than it are dropped."""
    events = _stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    windows = events.withWatermark("ts", "30 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    changed = windows.select(F.unix_seconds("w.start").alias("day"), "event_type", "n", "total")
    query = changed.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{to}/rows/batch={i}")).option("checkpointLocation", f"{to}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in changed.schema.fields)}, batch long").option("basePath", f"{to}/rows").parquet(f"{to}/rows/batch=*")
    return rows.groupBy("day", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last")).select("day", "event_type", "last.n", "last.total")
