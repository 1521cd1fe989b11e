"""Streaming ingestion: parse, verify, dead-letter, deduplicate, append. Late rows are never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import TOPIC, partition_key
from ..operators import dedupe, validate
from ..sources.events import COLUMNS
from ..sources.sinks import append_new, exists
from ..sources.subjects import note_subjects, without_marked

RECORD = "topic string, partition int, offset long, key string, value string"
DEAD_LETTER = "topic string, partition int, offset long, reason string"
COUNTERS = "batch long, polled long, materialized long, dead_lettered long"
LATENESS = "2 hours"
#: How long a key counts as seen, by the clock.
SEEN_FOR = "7 days"
PACKED = "spark.sql.inMemoryColumnarStorage.compressed"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_records(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of event-log records from files with the columns of a Kafka record."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", max_files).json(path)


def read_kafka(spark: SparkSession, servers: str, topic: str = TOPIC, max_offsets: int = 500, **options: str):
    """A reader of a topic from its earliest offset; load() gives the stream. Needs the Kafka connector on the class path."""
    chosen = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(max_offsets)}
    return spark.readStream.format("kafka").options(**chosen, **options)


def kafka_records(stream: DataFrame) -> DataFrame:
    """The columns of an event-log record of a loaded Kafka stream."""
    return stream.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def judged(records: DataFrame) -> DataFrame:
    """Records with the typed columns of their events and the reason why they are dead letters, null for good ones."""
    return validate.dead_letter_reason(validate.parse_envelope(records)).select("topic", "partition", "offset", "reason", *COLUMNS)


def split_judged(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = parsed.where("reason is null").select(COLUMNS)
    return good, parsed.where("reason is not null").select("topic", "partition", "offset", "reason")


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows with Bronze columns, and dead letters with reason and place only, never the payload."""
    return split_judged(judged(records))


def count_judged(parsed: DataFrame, batch: int = 0) -> DataFrame:
    rows = parsed.select(F.lit(batch).cast("long").alias("batch"), "reason")
    return rows.groupBy("batch").agg(F.count("*").alias("polled"), F.count_if(F.col("reason").isNull()).alias("materialized"), F.count("reason").alias("dead_lettered"))


def counters(records: DataFrame, batch: int = 0) -> DataFrame:
    """How many records a batch polled, materialized (repeats count) and dead-lettered."""
    return count_judged(judged(records), batch)


def note_days(good: DataFrame, touched: str, number: int) -> None:
    """Writes which days the good events of a batch fall on, and how many on each; a repeated batch writes the same again."""
    days = good.groupBy(F.to_date("occurred_at").cast("string").alias("event_date")).agg(F.count("*").alias("event_count"))
    days.coalesce(1).write.mode("overwrite").json(f"{touched.rstrip('/')}/batch={number:012d}")


def with_lateness(rows: DataFrame, latest: str, allowed: str = LATENESS) -> DataFrame:
    """Adds is_late: the event is older than `latest` (an instant as text) less the allowed lateness. Late rows stay."""
    return rows.withColumn("is_late", F.col("occurred_at") < F.lit(latest).cast("timestamp_ntz") - F.expr(f"interval {allowed}"))


def ingest_stream(records: DataFrame, bronze: str, dead_letters: str, checkpoint: str, counted: str | None = None, strict: bool = False, every: str | None = None, touched: str | None = None, near_days: int | None = 1, markers: str | None = None, index: str | None = None):
    """Runs over all that is there and ends: new events to Bronze, others to the dead letters. Returns the query.

    Each batch is parsed once, then appended against the ids that Bronze has within `near_days` of its own days (None: in
    all days); a replayed batch finds its own rows there, so it adds none. A failing write fails the batch, and the
    checkpoint stays where it was. Dead letters and counters come at least once. `touched` is a folder to which each
    batch writes the days of its good events once they are appended, for the rebuild of those days; a batch that fails in
    between comes again and writes them then. `strict`: the first bad record fails the batch instead. `every` ("30 seconds"): goes on at that interval
    until stopped.

    `markers` is the folder of deletion requests: events of subjects marked there when a batch starts are not stored
    (the counters have them as read). `index` is the index of subjects and days, which each batch adds its own to first.
    """

    def run(batch: DataFrame, number: int) -> None:
        # the batch is kept as it is: ids and raw events differ from row to row, and looking for shorter encodings costs much
        conf = batch.sparkSession.conf
        packed = conf.get(PACKED)
        conf.set(PACKED, "false")
        parsed = judged(batch).persist()
        try:
            good, bad = split_judged(parsed)
            if strict and not bad.isEmpty():
                raise ValueError(f"a record cannot be read: {bad.first()['reason']}")
            if markers:
                good = without_marked(good, markers)
            if index:
                note_subjects(good, index)
            append_new(good, bronze, near_days)
            if touched:
                note_days(good, touched, number)
            bad.write.mode("append").json(dead_letters)
            if counted:
                count_judged(parsed, number).write.mode("append").json(counted)
        finally:
            parsed.unpersist()
            conf.set(PACKED, packed)

    writer = records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def publish_then_store(events: DataFrame, log: str, store: str) -> None:
    """Appends accepted events to the durable log, then to the store, each against the keys that it has.

    If the second write fails, the log has the events already: the same call again adds them to the store alone.
    """
    events = events.persist()
    try:
        for path in (log, store):
            append_new(events, path)
    finally:
        events.unpersist()


def replay_log(spark: SparkSession, log: str, store: str, checkpoint: str) -> None:
    """Brings the events of a log into a store from the checkpoint on; what the store has already is not written again."""
    if not exists(spark, log):
        return
    rows = spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    query = rows.writeStream.foreachBatch(lambda batch, _: append_new(batch.select(COLUMNS), store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_seen(good: DataFrame) -> DataFrame:
    """Keyed first-row deduplication with a seven-day state of processing time, native to Spark; rows are never late.

    The watermark is on the time at which a batch reads its rows, so late but new events pass, and a key is forgotten
    seven days after it came first. Use ingest_first_seen's trigger or stop it explicitly.
    """
    rows = good.withColumn("_read_at", F.current_timestamp()).withWatermark("_read_at", SEEN_FOR)
    return rows.dropDuplicatesWithinWatermark(dedupe.KEY).drop("_read_at")


def ingest_first_seen(records: DataFrame, path: str, checkpoint: str) -> None:
    """Appends the first good record of each key to a file sink, by the keyed state, over all that is there."""
    spark = records.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        query = first_seen(split(records)[0]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(once=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def provisional_counts(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Events and exact users of each stage in tumbling windows of event time, of a batch; `windows` does it for a stream."""
    if events.isStreaming:
        raise ValueError("windows.run_windows counts a stream")
    rows = events.where("occurred_at is not null").withColumn("at", F.col("occurred_at").cast("timestamp"))
    counted = rows.groupBy("workspace_id", "event_name", F.window("at", size).alias("w")).agg(F.count("*").alias("event_count"), F.count_distinct("anonymous_id").alias("users"))
    return counted.select("workspace_id", "event_name", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_count", "users")


def to_records(events: DataFrame) -> DataFrame:
    """Event-log records of Bronze rows, as a producer would write them."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    user = ["user_id"] if "user_id" in events.columns else []
    event = F.struct("event_id", "anonymous_id", *user, "event_name", iso("occurred_at").alias("occurred_at"), iso("received_at").alias("received_at"), "schema_version", "tracking_plan_version", "funnel_definition_version")
    value = F.to_json(F.struct("workspace_id", event.alias("event")))
    n = F.substring("event_id", 7, 12).cast("long")
    return events.select(F.lit(TOPIC).alias("topic"), (n % 4).cast("int").alias("partition"), n.alias("offset"), partition_key("workspace_id", "anonymous_id").alias("key"), value.alias("value"))
