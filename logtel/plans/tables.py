"""The operators' inputs, derived from the given tables with the DataFrame API."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logtel.operators.layout import input_bytes

DAY_MS = 86400000


_SCHEMAS: dict[str, StructType] = {}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


#: Stored bytes of a narrow table that one task makes text or work of.
SPREAD_BYTES = 2 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over two tasks a core and more, for what makes much text or work of each narrow row.

    A file is split where its row groups lie, so a table in a few large groups
    is read, and all that is made of it computed, by as few tasks, however many
    splits are counted. Dealing the narrow rows costs little beside that work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, -(-input_bytes(df) // SPREAD_BYTES)))


def load_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(load(spark, folder, name))


def epoch_ms(name: str) -> Column:
    """Whole epoch ms of a zone-less timestamp, rounded down, in any session zone."""
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name})")
    return F.floor(micros / F.lit(1000)).cast("bigint")


def every(n: int, c: str, value: Column) -> Column:
    """NULL in each n-th row, else ``value``."""
    return F.when(F.col(c) % n != 0, value)


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def final_status() -> Column:
    blocked = (F.col("event_type") == "signup") & (F.col("event_id") % 97 == 0)
    return F.when(F.col("event_type") == "error", "Skipped").when(blocked, "Pending").otherwise("Done")


def _session(day: Column) -> Column:
    return F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), day.cast("string"))


# --- message log ----------------------------------------------------------------------------


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """A log of four partitions; sequence numbers are event ids, so each partition has gaps."""
    return load(spark, folder, "events").select(
        (F.col("user_id") % 4).alias("partition_id"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 128).cast("string").alias("msg_offset"),
        epoch_ms("ts").alias("enqueued_ms"),
        _session(F.to_date("ts")).alias("partition_key"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"),
        every(3, "event_id", F.col("event_type")).alias("correlation_id"),
        F.lit("application/json").alias("content_type"),
        F.encode("props", "UTF-8").alias("body"),
        F.create_map(F.lit("x-seq"), F.col("event_id").cast("string")).alias("system_properties"),
        F.create_map(F.lit("kind"), F.col("event_type")).alias("app_properties"),
    )


def checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoints half way into each partition; partition 3 has none."""
    half = F.floor(F.max("seq") * 0.5).cast("bigint")
    return (
        messages(spark, folder)
        .filter("partition_id <> 3")
        .groupBy("partition_id")
        .agg(half.alias("seq"))
        .withColumn("msg_offset", (F.col("seq") * 128).cast("string"))
    )


# --- debug dumps ----------------------------------------------------------------------------


def _dump_rows(spark: SparkSession, folder: str) -> DataFrame:
    session = _session(F.to_date("ts"))
    return load(spark, folder, "events").select(
        "*",
        F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")).alias("run_id"),
        session.alias("session_id"),
        F.concat(session, F.lit(":"), (F.col("event_id") % 2).cast("string")).alias("occurrence_id"),
        epoch_ms("ts").alias("ms"),
        final_status().alias("final_status"),
    )


def dump_messages(spark: SparkSession, folder: str, final: bool = False) -> DataFrame:
    """Messages of four runs with their loaded (or final) status."""
    loaded = F.when(F.col("final_status") == "Skipped", "Skipped").otherwise("Pending")
    return _dump_rows(spark, folder).select(
        "run_id",
        F.col("event_id").alias("seq"),
        (F.col("final_status") if final else loaded).alias("status"),
        "session_id",
        every(31, "event_id", F.col("ms")).alias("timestamp_ms"),
        F.when(F.col("event_id") % 17 == 0, "(unmapped)").otherwise(F.col("event_type")).alias("label"),
    )


def dump_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    """Each session of done messages gives an Emit and an Acknowledge."""
    emit = F.col("occurrence_id").endswith(":0")
    return (
        _dump_rows(spark, folder)
        .filter("final_status = 'Done'")
        .groupBy("run_id", "session_id", "occurrence_id")
        .agg(F.max("ms").cast("string").alias("last_activity"), F.min("event_type").alias("first_type"))
        .select(
            "run_id",
            "session_id",
            "occurrence_id",
            F.when(emit, "Emit").otherwise("Acknowledge").alias("kind"),
            "last_activity",
            F.when(F.col("first_type") != "click", F.concat(F.lit("d-"), F.col("session_id"))).alias("doc_id"),
            F.when(F.col("first_type") == "purchase", F.lit("sale")).alias("doc_type"),
            F.concat(F.lit("Ext/"), F.col("first_type")).alias("blade_name"),
        )
    )


def dump_sources(spark: SparkSession, folder: str) -> DataFrame:
    done = _dump_rows(spark, folder).filter("final_status = 'Done'")
    return done.select("run_id", "occurrence_id", F.col("event_id").alias("seq"))


def dump_marked(spark: SparkSession, folder: str) -> DataFrame:
    """Messages the flush marked done: all done ones, and half of the blocked ones without evidence."""
    marked = F.col("final_status").isin("Done") | ((F.col("final_status") == "Pending") & (F.col("event_id") % 194 == 0))
    return _dump_rows(spark, folder).filter(marked).select("run_id", F.col("event_id").alias("seq"))


def dump_final(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded dispositions; where none is recorded the field is NULL."""
    said = F.when(F.col("event_id") % 23 == 0, F.lit("rehydrated"))
    return _dump_rows(spark, folder).select(
        "run_id", F.col("event_id").alias("seq"), said.alias("disposition"), F.col("event_id").alias("position")
    )


def dump_start(spark: SparkSession, folder: str) -> DataFrame:
    ids = load(spark, folder, "events").select(F.concat(F.lit("run-"), (F.col("user_id") % 4).cast("string")).alias("run_id"))
    return ids.distinct().withColumn("start_seq", F.lit(-1).cast("bigint"))


def dump_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Run 0 records its start, run 1 its whole range; the others record nothing."""
    grouped = dump_messages(spark, folder).groupBy("run_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    is0, is1 = F.col("run_id") == "run-0", F.col("run_id") == "run-1"
    return grouped.select(
        "run_id",
        F.when(is0, F.col("lo") + 3).alias("starting_checkpoint"),
        F.when(is1, F.col("hi") - 1).alias("final_checkpoint"),
        F.when(is1, F.col("lo") - 10).alias("range_min"),
        F.when(is1, F.col("hi") + 10).alias("range_max"),
    )


def dump_flush(spark: SparkSession, folder: str) -> DataFrame:
    """Declared flush figures; run 2 declares one document too many."""
    emitted = dump_occurrences(spark, folder).filter("kind = 'Emit'").groupBy("run_id").agg(F.count("*").alias("n"))
    marked = dump_marked(spark, folder).groupBy("run_id").agg(F.count("*").alias("m"))
    last = dump_messages(spark, folder).groupBy("run_id").agg(F.max("seq").alias("hi"))
    extra = F.when(F.col("run_id") == "run-2", 1).otherwise(0)
    return emitted.join(marked, "run_id").join(last, "run_id").select(
        "run_id",
        (F.col("n") + extra).alias("events_written"),
        F.col("m").alias("messages_marked_done"),
        every(5, "hi", F.col("hi")).alias("checkpoint_seq"),
    )


# --- poll telemetry -------------------------------------------------------------------------


def cycles(spark: SparkSession, folder: str, load=load) -> DataFrame:
    """One finished poll cycle per event, three sources."""
    e = F.col("event_id")
    records = _double(e % 41)
    total = _double((e % 7) * 500)
    query, mapped = every(4, "event_id", F.col("value") * 10), every(4, "event_id", F.col("value"))
    counter = lambda n: F.when(e % 10 >= 3, _double(e % n))

    def span(stage: str, start: Column, length: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), _double(start).alias("start_ms"), _double(length).alias("dur_ms"))

    seal = span("seal", e % 5, F.coalesce(query, F.lit(0.0)) + F.coalesce(mapped, F.lit(0.0)) + e % 11)
    ends = F.array(span("write", e % 100, e % 23), span("advance", e % 200, e % 3))
    begin = F.array(span("cursorRead", F.lit(0), e % 5))
    timeline = F.when(e % 6 == 0, F.concat(begin, ends)).otherwise(F.concat(begin, F.array(seal), ends))
    outcome = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "skipped")
    return load(spark, folder, "events").withColumn("ms", epoch_ms("ts")).select(
        e.cast("string").alias("run_id"),
        F.concat(F.lit("src-"), (F.col("user_id") % 3).cast("string")).alias("source"),
        outcome.otherwise("success").alias("outcome"),
        F.col("ms").alias("started_ms"),
        (F.col("ms") + (e % 7) * 500).alias("completed_ms"),
        total.alias("total_ms"),
        records.alias("records"),
        F.when(total > 0, records / (total / 1000)).otherwise(0.0).alias("records_per_sec"),
        every(8, "event_id", _double(F.col("user_id") % 10)).alias("users"),
        F.when(e % 3 == 0, F.col("value")).alias("cursor_lag_sec"),
        query.alias("query_ms"),
        mapped.alias("map_ms"),
        every(9, "event_id", F.col("value") * 2).alias("write_ms"),
        every(7, "event_id", _double(e % 13)).alias("advance_ms"),
        every(2, "event_id", F.col("value")).alias("write_units"),
        every(5, "event_id", _double((e % 97) * 10)).alias("input_rows"),
        counter(3).alias("store_retries"),
        counter(11).alias("store_throttled"),
        counter(50).alias("store_attempted"),
        counter(40).alias("store_succeeded"),
        counter(4).alias("store_failed"),
        counter(2).alias("store_cancelled"),
        every(6, "event_id", F.col("ms") - 300000).alias("window_start_ms"),
        (F.col("ms") - (e % 3) * 150000).alias("window_end_ms"),
        timeline.alias("timeline"),
        e.alias("arrival"),
    )


def mixed_cycles(spark: SparkSession, folder: str) -> DataFrame:
    """Rollups of runs that may roll up more than once."""
    rolled = cycles(spark, folder).filter("outcome = 'success'")
    return rolled.withColumn("run_id", F.concat(F.lit("r"), F.floor(F.col("arrival") / 3).cast("string")))


def mixed_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Stage events of the same runs; some of these runs never roll up."""
    rest = load(spark, folder, "events").filter("event_type IN ('error', 'signup')")
    return rest.select(
        F.concat(F.lit("r"), F.floor(F.col("event_id") / 3).cast("string")).alias("run_id"),
        F.lit("seal").alias("stage"),
        F.lit("start").alias("ev"),
        _double(F.col("event_id") % 50).alias("at_ms"),
        F.lit(None).cast("double").alias("dur_ms"),
        every(4, "event_id", epoch_ms("ts")).alias("ts_ms"),
        F.col("event_id").alias("arrival"),
    )


def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    """Start and end events of fifty runs, with many ties in time."""
    e = F.col("event_id")
    is_end = F.col("event_type").isin("purchase", "error")
    names = F.when(e % 3 == 0, "seal").when(e % 3 == 1, "write").otherwise("cursorRead")
    return load(spark, folder, "events").withColumn("ms", epoch_ms("ts")).select(
        F.concat(F.lit("r"), (F.col("user_id") % 50).cast("string")).alias("run_id"),
        names.alias("stage"),
        F.when(is_end, "end").otherwise("start").alias("ev"),
        _double(F.floor((F.col("ms") - 1704067200000) / 3600000) * 3600000).alias("at_ms"),
        F.when(is_end, F.col("value")).alias("dur_ms"),
        every(9, "event_id", F.col("ms")).alias("ts_ms"),
        e.alias("arrival"),
    )


# --- benchmark runs -------------------------------------------------------------------------


def iterations(spark: SparkSession, folder: str, load=load, also: Sequence[str] = ()) -> DataFrame:
    """One iteration per order: five runs of twelve shards, some times unreadable, two thirds with a snapshot; ``also`` are columns of the order."""
    k = F.col("o_orderkey")
    ms = F.col("ms")

    def mod(n: int, name: str) -> Column:
        return _double(k % n).alias(name)

    def one(condition: Column, name: str) -> Column:
        return F.when(condition, 1.0).otherwise(0.0).alias(name)

    sample = lambda o, status: F.struct(
        F.lit(float(o)).alias("ordinal"),
        F.concat(F.lit(f"row{o}-"), k.cast("string")).alias("row_id"),
        F.lit(status).alias("status"),
    )
    event = F.struct((ms + 5).alias("at_ms"), F.lit("read").alias("kind"), _double(k % 9).alias("message_count"))
    window_end = every(7, "o_orderkey", ms - (k % 3) * 100000)
    pipeline = F.struct(
        every(11, "o_orderkey", ms + k % 800).alias("observed_ms"),
        (ms + k % 700).alias("current_ms"),
        every(7, "o_orderkey", ms - 300000).alias("window_start_ms"),
        window_end.alias("window_end_ms"),
        (ms - 1000).alias("watermark_ms"),
        (ms - 500).alias("candidate_watermark_ms"),
        (k % 5 != 0).alias("has_checkpoint"),
        F.when((k % 5 != 0) & (k % 25 != 1), window_end - (k % 4) * 1000).alias("checkpoint_ms"),
        mod(5000, "total_shard_messages"),
        mod(6, "window_messages"),
        mod(9, "backlog_messages"),
        F.when(k % 8 == 1, 2.0).otherwise(0.0).alias("blocked_messages"),
        F.when(k % 2 == 1, 0.0).otherwise(_double(k % 4)).alias("pending"),
        mod(12, "done"),
        mod(3, "skipped"),
        mod(2, "duplicate_acknowledged"),
        F.lit(0.0).alias("poisoned"),
        F.array(sample(1, "pending"), sample(2, "done")).alias("messages"),
        F.array(event).alias("events"),
    )
    return load(spark, folder, "orders").withColumn("ms", epoch_ms("o_orderdate")).select(
        F.col("o_orderpriority").alias("run_id"),
        k.cast("string").alias("iteration_id"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("client_id"),
        F.concat(F.lit("shard-"), (F.col("o_custkey") % 12).cast("string")).alias("shard_id"),
        k.alias("arrival"),
        every(101, "o_orderkey", ms).alias("started_ms"),
        every(103, "o_orderkey", ms + k % 1000).alias("completed_ms"),
        every(7, "o_orderkey", ms - 300000).alias("window_start_ms"),
        window_end.alias("window_end_ms"),
        mod(1000, "total_ms"),
        mod(100, "lease_acquire"), mod(300, "poll_source"), mod(20, "store_setup"), mod(30, "rehydrate_state"),
        mod(10, "duplicate_rows"), mod(250, "process_events"), mod(90, "flush"), mod(15, "advance_checkpoint"),
        mod(5, "query_build"), mod(50, "first_row"), mod(200, "stream_rows"), mod(45, "map_rows"),
        mod(500, "rows_fetched"), mod(450, "messages_processed"), mod(50, "events_finalized"), mod(70, "flush_documents"),
        one(F.col("o_orderstatus") == "F", "full_flushes"),
        one(F.col("o_orderstatus") == "P", "partial_flushes"),
        mod(2, "checkpoint_advancements"),
        one(k % 19 == 0, "blocked_messages"),
        mod(11, "backlog_messages"),
        _double(k * 1024).alias("managed_bytes"),
        _double(F.col("o_custkey") * 2048).alias("working_set_bytes"),
        _double(F.floor("o_totalprice")).alias("gc_heap_bytes"),
        every(13, "o_orderkey", _double(ms)).alias("previous"),
        _double(ms + 10000).alias("upper"),
        every(17, "o_orderkey", _double(ms + (k % 5) * 1000 - 1000)).alias("advanced_to"),
        mod(37, "blocked_ms"),
        every(3, "o_orderkey", pipeline).alias("pipeline"),
        *also,
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The five runs; one has no readable start and one no readable end."""
    times = load(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.count("*").alias("n")
    )
    return times.select(
        F.col("o_orderpriority").alias("run_id"),
        F.concat(F.lit("label "), F.col("o_orderpriority")).alias("label"),
        F.lit("bench").alias("source"),
        F.when(~F.col("o_orderpriority").startswith("1"), epoch_ms("lo") - 1000).alias("started_ms"),
        F.when(~F.col("o_orderpriority").startswith("2"), epoch_ms("hi") + 5000).alias("completed_ms"),
        _double("n").alias("duration_ms"),
    )


def memory_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled memory of two of the runs."""
    sampled = load(spark, folder, "orders").filter("o_orderpriority IN ('1-URGENT', '2-HIGH')")
    return sampled.select(
        F.col("o_orderpriority").alias("run_id"),
        F.col("o_orderkey").cast("string").alias("iteration_id"),
        every(29, "o_orderkey", epoch_ms("o_orderdate") + 500).alias("at_ms"),
        _double(F.col("o_orderkey") * 4096).alias("managed_bytes"),
        _double(F.col("o_custkey") * 8192).alias("working_set_bytes"),
        _double(F.floor("o_totalprice")).alias("gc_heap_bytes"),
    )


# --- telemetry rows and envelopes -----------------------------------------------------------


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Telemetry rows with a blank key in every fiftieth."""
    return load(spark, folder, "events").select(
        every(50, "event_id", F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("sessionId"),
        F.col("user_id").cast("string").alias("objectId"),
        every(20, "event_id", epoch_ms("ts").cast("string")).alias("clientTime"),
        every(60, "event_id", F.date_format("ts", "M/d/yyyy, h:mm:ss.SSSSSS a")).alias("PreciseTimeStamp"),
        "event_type",
        "props",
        F.col("event_id").alias("_ord"),
    )


def pull_rows(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("object_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        every(40, "event_id", epoch_ms("ts")).alias("client_ms"),
        (epoch_ms("ts") + 60000).alias("ts_ms"),
    )


def stored_events(spark: SparkSession, folder: str) -> DataFrame:
    """What has already been stored: everything but purchases, with ISO text times, some unreadable."""
    stored = load(spark, folder, "events").filter("event_type <> 'purchase'")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return stored.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("user_id") % 10 == 7, "zz unreadable").otherwise(text).alias("client_time"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Users to pull: every customer is listed, so some have no stored event."""
    return load(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("object_id"))


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Envelopes of multi-part events, one event per conversation; payload as JSON text."""
    part = F.when(F.col("role") == "system", "opening").when(F.col("role") == "user", "question").otherwise("answer")
    received = F.col("conv_id") * 3600000 + F.col("turn") * 60000
    body = F.struct(
        F.when(F.col("conv_id") % 13 == 0, "other").otherwise("conversation").alias("kind"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"),
        F.concat(F.lit("e"), F.col("conv_id").cast("string")).alias("event"),
        part.alias("part"),
        received.alias("at"),
        (F.col("conv_id") % 5 == 0).alias("urgent"),
        F.concat(F.col("role"), F.lit("-"), (F.length("text") % 7).cast("string")).alias("dedupe"),
        F.length("text").alias("chars"),
    )
    return load(spark, folder, "conversations").select(
        F.to_json(body).alias("payload"),
        (F.col("conv_id") % 4).cast("string").alias("partition_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("sequence_number"),
        F.col("turn").cast("string").alias("msg_offset"),
        received.alias("received_ms"),
    )
