"""Structured Streaming: idempotent intake of event messages and running counts.

The source's format is a parameter; Kafka needs its connector on the class path,
tests use files. A checkpoint keeps the offsets; a target that already holds a
message's key doesn't take it again, so a replayed batch changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.operators import events
from placewright.sources.tables import path_exists

SCHEMA = "topic string, partition_id int, offset_value bigint, value string"


def read_messages(spark: SparkSession, source: str, path: str | None = None, **options) -> DataFrame:
    """A stream of ``topic``, ``partition_id``, ``offset_value``, ``value`` from files (json, parquet) or Kafka."""
    if source == "kafka":
        raw = spark.readStream.format("kafka").options(**{"startingOffsets": "earliest", **options}).load()
        return raw.select("topic", F.col("partition").alias("partition_id"), F.col("offset").alias("offset_value"), F.col("value").cast("string").alias("value"))
    return spark.readStream.format(source).schema(SCHEMA).options(**options).load(path)


def intake(stream: DataFrame, target: str, dead: str, checkpoint: str):
    """Write each new message once to ``target`` (flattened, by topic) and unreadable ones to ``dead``; stops when the source is drained.

    A batch is written under its own number with overwrite, so a batch that is run again after a failure
    replaces itself.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        df.persist()
        try:
            good, bad = events.split_payloads(df, "value")
            flat = events.flatten(good, "value").drop("value")
            known = _known(spark, target, number, df)
            fresh = events.new_only(flat, known) if known is not None else flat.dropDuplicates(events.KEY)
            fresh.write.mode("overwrite").partitionBy("topic").parquet(f"{target}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known(spark: SparkSession, target: str, number: int, batch: DataFrame) -> DataFrame | None:
    """The target's messages that the batch may hold again: of its topics, and in their ranges of offsets, so only those files and row groups are read."""
    if not path_exists(spark, target):
        return None
    # one row per topic and partition of the source
    spans = batch.groupBy("topic", "partition_id").agg(F.min("offset_value").alias("a"), F.max("offset_value").alias("b")).collect()
    held = F.lit(False)
    for r in spans:
        held = held | ((F.col("topic") == r.topic) & (F.col("partition_id") == r.partition_id) & F.col("offset_value").between(r.a, r.b))
    return spark.read.option("basePath", target).parquet(target).where((F.col("batch") < number) & held).select(*events.KEY)


def running_counts(stream: DataFrame, target: str, checkpoint: str, late: str = "2 days"):
    """Counts by topic and type of messages, each counted once within the watermark; each batch replaces the table at ``target``.

    The counts are one row per topic and type, so a table is written whole; readers see that of the last batch that ended.
    """
    flat = events.flatten(stream, "value").where("event_time is not null").withWatermark("event_time", late)
    once = flat.dropDuplicatesWithinWatermark(events.KEY)
    counts = once.groupBy("topic", "event_type").count()
    write = lambda df, number: df.coalesce(1).write.mode("overwrite").parquet(target)
    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stop(query, seconds: float = 60) -> None:
    """End a stream after the batch at hand: it waits for what is under way, then stops; the checkpoint has where to go on."""
    import time

    until = time.monotonic() + seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()
