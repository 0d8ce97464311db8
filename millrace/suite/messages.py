"""Messages, streams, tracked runs and objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import registry, tables
from millrace.operators.runs import Context, data_ref, tracked, tracked_write
from millrace.operators.sql import execution_record
from millrace.session import scratch
from millrace.sources import messages, objects
from millrace.streaming import distinct, envelope, events, results
from millrace.suite import standins as s
from millrace.suite.base import fresh_database, query, table


def _queue(spark: SparkSession, folder: str, kind: DataFrame, label: str) -> str:
    """Message bodies written where a stream can pick them up."""
    place = scratch(spark, label)
    s.bodies(kind).write.text(place)
    return place


def _consumed(spark: SparkSession, folder: str, label: str, **options) -> DataFrame:
    """All result messages taken in by the streaming consumer, two files at a time."""
    queue = _queue(spark, folder, s.result_messages(spark, folder), f"{label}_queue")
    stored = scratch(spark, f"{label}_stored")
    stream = messages.message_stream(spark, queue, files_per_batch=2)
    results.consume_results(stream, stored, scratch(spark, f"{label}_checkpoint"), **options).awaitTermination()
    return spark.read.parquet(stored)


@query(
    "s6_message_source",
    f"""select case when {s.READABLE_SQL} then 'c-' || event_id end as correlation_id,
        {s.READABLE_SQL} and event_id % 2 = 1 as wrapped from events""",
)
def s6_message_source(spark: SparkSession, folder: str) -> DataFrame:
    queue = _queue(spark, folder, s.command_messages(spark, folder), "source_queue")
    stream = messages.message_stream(spark, queue, files_per_batch=4)
    place = scratch(spark, "source_out")
    query = (
        stream.select("body").writeStream.format("parquet").option("path", place)
        .option("checkpointLocation", scratch(spark, "source_checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    raw = spark.read.schema("body string").parquet(place)
    message = envelope.unwrap(F.col("body"))
    return raw.select(
        F.get_json_object(message, "$.correlation_id").alias("correlation_id"),
        (message != F.col("body")).alias("wrapped"),
    )


@query(
    "s7_message_sink",
    f"""select case event_id % 4 when 0 then 'storage' when 1 then 'query' when 2 then 'transform'
            else 'catalog' end as type, event_type as action, 'c-' || event_id as correlation_id,
        cast({s.K_SQL} as varchar) as k from events""",
)
def s7_message_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Commands published as JSON under their type, then read back from there."""
    place = scratch(spark, "published")
    messages.publish(s.command_messages(spark, folder), "command", place)
    back = spark.read.schema("value string, type string").text(place)
    field = lambda path: F.get_json_object("value", path)
    return back.select(
        "type",
        field("$.action").alias("action"),
        field("$.correlation_id").alias("correlation_id"),
        field("$.payload.k").alias("k"),
    )


@query(
    "e1_unwrap_envelope",
    f"""select 'c-' || event_id as correlation_id, event_type as action from events where {s.READABLE_SQL}
        union all select null, null from events where not ({s.READABLE_SQL})""",
)
def e1_unwrap_envelope(spark: SparkSession, folder: str) -> DataFrame:
    message = envelope.unwrap(F.col("body"))
    return s.bodies(s.command_messages(spark, folder)).select(
        F.get_json_object(message, "$.correlation_id").alias("correlation_id"),
        F.get_json_object(message, "$.action").alias("action"),
    )


@query(
    "e2_decode",
    f"""select true as valid, case event_type when 'purchase' then 'success' when 'signup' then 'pending'
            else 'error' end as status, 'c-' || event_id as correlation_id, 'job-' || user_id as job_id,
        case when event_id % 10 <> 0 then 'step-' || event_id end as step_id, {s.K_SQL} as duration_ms,
        case when event_type = 'error' then 2 else 0 end as errors, 'main.t' || ({s.K_SQL} % 10) as input,
        epoch_us(ts) as sent_us from events where {s.READABLE_SQL}
       union all select false, null, null, null, null, 0, 0, null, null from events where not ({s.READABLE_SQL})""",
)
def e2_decode(spark: SparkSession, folder: str) -> DataFrame:
    decoded = envelope.decode(s.bodies(s.result_messages(spark, folder)), "result")
    return decoded.select(
        "valid", "status", "correlation_id", "job_id", "step_id", "duration_ms",
        F.size("errors").alias("errors"),
        F.try_element_at("inputs", F.lit(1))["location"].alias("input"),
        F.when(F.col("valid"), F.unix_micros("timestamp")).alias("sent_us"),
    )


@query(
    "e3_route",
    f"""select 'c-' || event_id as correlation_id, case event_id % 4 when 0 then 'storage-commands'
            when 1 then 'query-commands' when 2 then 'transform-commands' end as topic,
        case when event_id % 4 = 3 then 'Unknown service type: catalog' end as route_error
        from events where {s.READABLE_SQL}""",
)
def e3_route(spark: SparkSession, folder: str) -> DataFrame:
    commands = envelope.decode(s.bodies(s.command_messages(spark, folder)), "command").filter("valid")
    return envelope.route(commands).select("correlation_id", "topic", "route_error")


_PATCH_SQL = f"""select 'step-' || event_id as step_id,
        case when event_type = 'purchase' then 'success' else 'failed' end as status,
        {s.K_SQL} as duration_ms, 'main.t' || ({s.K_SQL} % 10) as inputs,
        case when event_type = 'purchase' then 'main.t' || ({s.K_SQL} % 5) end as outputs,
        case when event_type = 'error' then 'no answer; gave up' end as error,
        epoch_us(ts) as patched_us
    from events where {s.READABLE_SQL} and event_id % 10 <> 0"""


def _patch_view(patches: DataFrame) -> DataFrame:
    return patches.select(
        "step_id", "status", "duration_ms",
        F.array_join(F.col("inputs.location"), ",").alias("inputs"),
        F.array_join(F.col("outputs.location"), ",").alias("outputs"),
        "error",
        F.unix_micros("patched_at").alias("patched_us"),
    )


@query("e4_result_to_step", _PATCH_SQL)
def e4_result_to_step(spark: SparkSession, folder: str) -> DataFrame:
    decoded = envelope.decode(s.bodies(s.result_messages(spark, folder)), "result")
    return _patch_view(results.step_patches(decoded.filter("valid")))


@query("e5_consume_results", _PATCH_SQL)
def e5_consume_results(spark: SparkSession, folder: str) -> DataFrame:
    """The same patches, through the streaming consumer."""
    return _patch_view(results.stored_patches(_consumed(spark, folder, "consume")))


@query("e5_gathered_results", _PATCH_SQL)
def e5_gathered_results(spark: SparkSession, folder: str) -> DataFrame:
    """The same patches, with all micro-batches but the newest moved into few files."""
    queue = _queue(spark, folder, s.result_messages(spark, folder), "gather_queue")
    stored, gathered = scratch(spark, "gather_stored"), scratch(spark, "gathered")
    stream = messages.message_stream(spark, queue, files_per_batch=2)
    results.consume_results(stream, stored, scratch(spark, "gather_checkpoint")).awaitTermination()
    results.gather_results(spark, stored, gathered)
    return _patch_view(results.stored_patches(results.read_results(spark, stored, gathered)))


@query(
    "e5_outcomes",
    f"""select case when not ({s.READABLE_SQL}) then 'error' when event_id % 10 = 0 then 'skipped'
            when event_id % 3 = 0 then 'error' else 'updated' end as outcome,
        case when not ({s.READABLE_SQL}) then 'unreadable message' when event_id % 10 = 0 then 'no_step_id'
            when event_id % 3 = 0 then 'Step not found: step-' || event_id end as reason, count(*) as n
        from events group by all""",
)
def e5_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes when only two thirds of the steps are known."""
    known = s.steps(spark, folder).filter("cast(substring(step_id, 6) as bigint) % 3 <> 0").select("step_id")
    stored = _consumed(spark, folder, "outcome", known_steps=known)
    return stored.groupBy("outcome", "reason").agg(F.count("*").alias("n"))


_LATE_SQL = "event_id % 7 = 0 and ts < timestamp '2024-01-06'"


@query(
    "e5_distinct_results",
    f"""select 'c-' || event_id as correlation_id, case when event_type = 'purchase' then 'success'
            when event_type = 'signup' then 'pending' else 'error' end as status, {_LATE_SQL} as late
        from events where {s.READABLE_SQL}""",
)
def e5_distinct_results(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that come again are dropped; messages that come weeks too late are kept apart."""
    sent, place = s.result_messages(spark, folder), scratch(spark, "again_queue")
    number = F.substring_index("correlation_id", "-", -1).cast("bigint")
    late = (number % 7 == 0) & (F.col("timestamp") < "2024-01-06")
    day = F.substring("timestamp", 1, 10)
    arrivals = [
        ~late & (day < "2024-01-20"),
        (day >= "2024-01-20") | (day == "2024-01-19"),  # that day's messages once more
        late | (day >= "2024-01-30"),
    ]
    stored, once = scratch(spark, "again_stored"), scratch(spark, "again_once")
    checks = scratch(spark, "again_checkpoint"), scratch(spark, "once_checkpoint")
    # Each arrival is one micro-batch of as many files as its writers make; the streams go on from their checkpoints.
    for n, some in enumerate(arrivals):
        s.bodies(sent.filter(some)).write.text(f"{place}/{n}")
        running = [
            results.consume_results(messages.message_stream(spark, place), stored, checks[0]),
            distinct.store_distinct(messages.message_stream(spark, place), once, checks[1]),
        ]
        for stream in running:
            stream.awaitTermination()
    found = distinct.all_results(spark.read.parquet(stored), spark.read.parquet(once))
    return found.select("correlation_id", "status", "late")


@query(
    "e5_steps_after_results",
    f"""select 'step-' || event_id as step_id, 'job-' || user_id as job_id,
        case when not ({s.READABLE_SQL}) or event_id % 10 = 0 then 'pending'
             when event_type = 'purchase' then 'success' else 'failed' end as status,
        case when {s.READABLE_SQL} and event_id % 10 <> 0 then epoch_us(ts) end as completed_us
        from events""",
)
def e5_steps_after_results(spark: SparkSession, folder: str) -> DataFrame:
    """Steps added first, then patched by the consumed results and folded to their state."""
    requests = table(spark, folder, "events").select(
        F.concat(F.lit("step-"), F.col("event_id").cast("string")).alias("step_id"),
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_type").alias("step_name"),
        F.lit("query").alias("handler_type"),
        F.lit("execute").alias("action"),
        F.timestamp_seconds(F.lit(0)).alias("patched_at"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    patches = results.stored_patches(_consumed(spark, folder, "fold"))
    log = registry.add_steps(requests, ["step_id"]).unionByName(registry.step_updates(patches))
    return registry.current_steps(log).select(
        "step_id", "job_id", "status", F.unix_micros("completed_at").alias("completed_us")
    )


@query(
    "e6_tracked_run",
    """select 'success' as status, 'table' as handler, 'job-7' as job_id, cast(count(*) as varchar) as row_count,
        '' as errors, 'orders' as read, 'main.orders_copy' as written, 1 as executions from orders
       union all select 'error', 'table', 'job-7', null, 'duplicate key', '', '', 0 from orders having count(*) > 0""",
)
def e6_tracked_run(spark: SparkSession, folder: str) -> DataFrame:
    """A write that succeeds and an insert that breaks a key rule, each leaving its result."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    name = f"{fresh_database(spark, 'tracked')}.orders_copy"
    context = Context("table", "corr-1", "job-7", "step-1")
    read, written = [data_ref("table", "orders", "parquet")], [data_ref("table", "main.orders_copy")]
    ran = [execution_record("insert into orders_copy select * from orders")]
    good = tracked_write(orders, context, lambda f: tables.store(spark, name, f), read, written, ran)

    def twice() -> dict:
        keyed = f"{name}_keyed"
        tables.create_table(spark, keyed, [tables.ColumnSpec("o_custkey", "BIGINT", primary_key=True)])
        return {"row_count": tables.insert(spark, keyed, orders.select("o_custkey"))}

    bad = tracked(spark, context, twice, read, written, ran)
    return good.unionByName(bad).select(
        "status", "handler", "job_id",
        F.try_element_at("data", F.lit("row_count")).alias("row_count"),
        F.regexp_extract(F.array_join("errors", ";"), "^(duplicate key|)", 1).alias("errors"),
        F.array_join(F.col("inputs.location"), ",").alias("read"),
        F.array_join(F.col("outputs.location"), ",").alias("written"),
        F.size("executions").alias("executions"),
    )


@query(
    "e7_batch_summary",
    f"""select case when not ({s.READABLE_SQL}) then 'error' when event_id % 10 = 0 then 'skipped'
            else 'updated' end as outcome,
        case when not ({s.READABLE_SQL}) then null when event_type = 'purchase' then 'success'
             when event_type = 'signup' then 'pending' else 'error' end as status,
        count(*) as processed from events group by all""",
)
def e7_batch_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The batches' summaries added up (how messages fall into batches depends on the files)."""
    summary = results.batch_summary(_consumed(spark, folder, "summary"))
    return summary.groupBy("outcome", "status").agg(F.sum("processed").alias("processed"))


@query(
    "e8_domain_events",
    f"""select 'query.' || case event_type when 'purchase' then 'success' when 'signup' then 'pending'
            else 'error' end as type, 'c-' || event_id as correlation_id, 'query' as source,
        'job-' || user_id as job_id, case when event_id % 10 <> 0 then 'step-' || event_id end as step_id,
        cast({s.K_SQL} as varchar) as k, epoch_us(ts) as sent_us from events where {s.READABLE_SQL}""",
)
def e8_domain_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events made from the results in a stream, published, and decoded again."""
    queue = _queue(spark, folder, s.result_messages(spark, folder), "event_queue")
    decoded = envelope.decode(messages.message_stream(spark, queue), "result").filter("valid")
    place = scratch(spark, "event_out")
    messages.publish_stream(
        events.domain_events(decoded), "event", place, scratch(spark, "event_checkpoint")
    ).awaitTermination()
    back = envelope.decode(spark.read.schema("body string").text(place).select("body"), "event")
    part = lambda key: F.try_element_at("payload", F.lit(key)).alias(key)
    return back.filter("valid").select(
        "type", "correlation_id", "source", part("job_id"), part("step_id"), part("k"),
        F.unix_micros("timestamp").alias("sent_us"),
    )


# --- objects ---------------------------------------------------------------------------------


def _text_objects(spark: SparkSession, folder: str) -> str:
    """The documents as text files, one prefix per language."""
    place = scratch(spark, "objects")
    table(spark, folder, "documents").select("lang", "text").write.partitionBy("lang").text(place)
    return place


_BYTES_SQL = "select 'lang=' || lang as prefix, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by lang"


def _prefix():
    return F.substring_index("path", "/", 1).alias("prefix")


@query("s2_object_listing", _BYTES_SQL)
def s2_object_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes from the listing add up to what was stored under each prefix."""
    listing = objects.list_objects(spark, _text_objects(spark, folder))
    return listing.filter(F.col("path").endswith(".txt")).groupBy(_prefix()).agg(F.sum("size").alias("bytes"))


@query("s2_object_listing_tables")
def s2_object_listing_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The table files themselves; their paths and times are not known to SQL."""
    return objects.list_objects(spark, folder)


@query("s3_object_scan", _BYTES_SQL)
def s3_object_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies decoded from their base64 text have the stored length."""
    bodies = objects.scan_objects(spark, _text_objects(spark, folder)).filter(F.col("path").endswith(".txt"))
    return bodies.groupBy(_prefix()).agg(F.sum(F.length(F.unbase64("body_base64"))).alias("bytes"))


@query(
    "s4_object_stat",
    """select 'lang=' || lang || '/missing' as path, false as found, null as size from documents group by lang
       union all select 'lang=' || lang, true, cast(sum(strlen(text) + 1) as bigint) from documents group by lang""",
)
def s4_object_stat(spark: SparkSession, folder: str) -> DataFrame:
    """Stats of all listed objects, added up per prefix, and of one missing object per prefix."""
    place = _text_objects(spark, folder)
    present = objects.list_objects(spark, place).filter(F.col("path").endswith(".txt")).select("path")
    missing = table(spark, folder, "documents").select(F.concat(F.lit("lang="), "lang", F.lit("/missing")))
    stats = objects.stat_objects(spark, place, present.union(missing.distinct()))
    shown = F.when(F.col("found"), F.substring_index("path", "/", 1)).otherwise(F.col("path"))
    return stats.groupBy(shown.alias("path"), "found").agg(F.sum("size").alias("size"))
