"""Catalogue, job registry and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import catalog, indexes, lineage, registry
from millrace.schemas import JOB
from millrace.session import scratch
from millrace.streaming import state
from millrace.suite import standins as s
from millrace.suite.base import fresh_database, query, table


def _us(column: str):
    return F.unix_micros(column).alias(column.replace("_at", "_us"))


# --- catalogue -------------------------------------------------------------------------------


def _assets(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.current_assets(s.asset_log(spark, folder))


def _asset_view(assets: DataFrame) -> DataFrame:
    return assets.select(
        "name", "asset_type", "location", "description", F.array_join("tags", ",").alias("tags")
    )


_ASSET_VIEW_SQL = "name, asset_type, location, description, tag1 || ',' || tag2 as tags"


@query(
    "c1_register",
    f"""select {_ASSET_VIEW_SQL}, cast(created_s as bigint) as created_s, cast(seq as bigint) as updated_s
        from ({s.ASSETS_SQL})""",
)
def c1_register(spark: SparkSession, folder: str) -> DataFrame:
    """The newest registration of each part name since it was last removed."""
    assets = _assets(spark, folder)
    return assets.select(
        "name", "asset_type", "location", "description",
        F.array_join("tags", ",").alias("tags"),
        F.unix_seconds("created_at").alias("created_s"),
        F.unix_seconds("updated_at").alias("updated_s"),
    )


@query(
    "c2_unregister",
    f"""select {_ASSET_VIEW_SQL} from ({s.ASSETS_SQL}) where name not in
        (select p_name from part where p_size = 50)""",
)
def c2_unregister(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "part").filter("p_size = 50").select(F.col("p_name").alias("name"))
    return _asset_view(catalog.unregister(_assets(spark, folder), gone))


@query(
    "c3_get",
    f"""select w.name, a.name is not null as found, a.asset_type, a.location from
        (select distinct p_name as name from part union select distinct p_brand from part) w
        left join ({s.ASSETS_SQL}) a on w.name = a.name""",
)
def c3_get(spark: SparkSession, folder: str) -> DataFrame:
    """All part names, which are assets, and all brands, which are not."""
    parts = table(spark, folder, "part")
    wanted = parts.select(F.col("p_name").alias("name")).union(parts.select("p_brand"))
    assets = catalog.current_assets(s.asset_log(spark, folder), wanted)
    return catalog.get_assets(assets, wanted).select(
        "name", "found", "asset_type", "location"
    )


@query(
    "c4_search",
    f"""select {_ASSET_VIEW_SQL} from ({s.ASSETS_SQL}) where asset_type = 'economy'
        and (contains(lower(name), 'e') or contains(lower(description), 'e'))""",
)
def c4_search(spark: SparkSession, folder: str) -> DataFrame:
    return _asset_view(catalog.search(_assets(spark, folder), query="E", asset_type="economy"))


@query(
    "c4_indexed_search",
    f"""select {_ASSET_VIEW_SQL} from ({s.ASSETS_SQL}) where contains(lower(name), 'size 1')
        or contains(lower(description), 'size 1')""",
)
def c4_indexed_search(spark: SparkSession, folder: str) -> DataFrame:
    """Text found through its three-letter pieces."""
    assets, name = _assets(spark, folder), f"{fresh_database(spark, 'pieces')}.pieces"
    indexes.index_text(assets, name, 16)
    return _asset_view(indexes.search_indexed(assets, name, "SIZE 1"))


@query(
    "c4_search_tags",
    f"""select {_ASSET_VIEW_SQL} from ({s.ASSETS_SQL}) where 'size_1' in (tag1, tag2)""",
)
def c4_search_tags(spark: SparkSession, folder: str) -> DataFrame:
    return _asset_view(catalog.search(_assets(spark, folder), tags=["size_1"]))


@query("c5_list", f"select name, asset_type, location from ({s.ASSETS_SQL})")
def c5_list(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.list_assets(_assets(spark, folder)).select("name", "asset_type", "location")


@query(
    "c6_asset_lineage",
    """select 'order_' || o_orderkey as name, 'upstream' as direction, 'customer_' || o_custkey as other from orders
       union all select 'order_' || o_orderkey, 'upstream', 'priority_' || o_orderpriority from orders
       union all select 'order_' || o_orderkey, 'downstream', 'status_' || o_orderstatus from orders""",
)
def c6_asset_lineage(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.asset_lineage(s.order_assets(spark, folder))


@query(
    "c6_asset_lineage_wanted",
    """select 'order_' || o_orderkey as name, 'upstream' as direction, 'customer_' || o_custkey as other from orders
        where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)
       union all select 'order_' || o_orderkey, 'upstream', 'priority_' || o_orderpriority from orders
        where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)""",
)
def c6_asset_lineage_wanted(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "lineitem").filter("l_quantity > 45").select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("name")
    )
    return catalog.asset_lineage(s.order_assets(spark, folder), names, "upstream")


@query(
    "c7_stats",
    f"""with a as ({s.ASSETS_SQL}), o as (select o_orderstatus t from orders union all
                                          select o_orderstatus from orders)
       select 'total' as kind, '' as key, count(*) + (select count(*) from orders) as n from a
       union all select 'type', asset_type, count(*) from a group by asset_type
       union all select 'type', 'table', count(*) from orders
       union all select 'tag', tag, count(*) from
            (select tag1 tag from a union all select tag2 from a union all select t from o) group by tag""",
)
def c7_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and orders together; an order carries its tag twice and is counted twice."""
    parts = _assets(spark, folder).select("asset_type", "tags")
    return catalog.stats(parts.unionByName(s.order_assets(spark, folder).select("asset_type", "tags")))


# --- registry --------------------------------------------------------------------------------


@query(
    "r1_create_job",
    """select 'job-' || sha256(length(cast(o_custkey as varchar)) || ':' || o_custkey
          || length(cast(o_orderkey as varchar)) || ':' || o_orderkey) as job_id,
        o_orderpriority as pipeline, 'dev' as environment, 'dev' as namespace, 'pending' as status,
        'unknown' as logic_version, epoch_us(o_orderdate) as created_us from orders""",
)
def r1_create_job(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a job request without environment, namespace, version or id."""
    requests = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("pipeline"),
        F.col("o_orderdate").cast("timestamp").alias("patched_at"),
        F.col("o_orderkey").alias("seq"),
        "o_custkey",
    )
    return registry.create_jobs(requests, ["o_custkey", "seq"]).select(
        "job_id", "pipeline", "environment", "namespace", "status", "logic_version", _us("created_at")
    )


def _state_sql() -> str:
    """Current state of jobs (customers patched by their events)."""
    return f"""with p as (select user_id, max_by({s.STATUS_SQL}, event_id) status,
            max(epoch_us(ts)) filter (where event_type in ('view', 'click')) started_us,
            max(epoch_us(ts)) filter (where event_type in ('purchase', 'error')) completed_us,
            max_by('failed at ' || {s.K_SQL}, event_id) filter (where event_type = 'error') error,
            max_by(event_type, event_id) last_event,
            cast(max_by({s.K_SQL}, event_id) filter (where event_type = 'view') as varchar) view_k
          from events group by user_id)
        select j.job_id, j.pipeline, j.environment, j.logic_version, coalesce(p.status, 'pending') as status,
            j.created_s * 1000000 as created_us, p.started_us, p.completed_us, p.error,
            'request' as origin, p.last_event, p.view_k
        from ({s.JOBS_SQL}) j left join p on j.job_id = 'job-' || p.user_id"""


def _job_view(jobs: DataFrame) -> DataFrame:
    return jobs.select(
        "job_id", "pipeline", "environment", "logic_version", "status",
        _us("created_at"), _us("started_at"), _us("completed_at"), "error",
        F.try_element_at("metadata", F.lit("origin")).alias("origin"),
        F.try_element_at("metadata", F.lit("last")).alias("last_event"),
        F.try_element_at("metadata", F.lit("view")).alias("view_k"),
    )


@query(
    "r2_get_job",
    f"""select w.job_id, a.job_id is not null as found, a.status, a.pipeline from
        (select distinct 'job-' || (user_id * 20) as job_id from events) w
        left join ({_state_sql()}) a on w.job_id = a.job_id""",
)
def r2_get_job(spark: SparkSession, folder: str) -> DataFrame:
    """Wanted ids of which about half exist."""
    wanted = table(spark, folder, "events").select(
        F.concat(F.lit("job-"), (F.col("user_id") * 20).cast("string")).alias("job_id")
    )
    jobs = registry.current_jobs(s.job_log(spark, folder), wanted)
    return registry.get_by_id(jobs, wanted, "job_id").select(
        "job_id", "found", "status", "pipeline"
    )


@query(
    "r2_bucketed_get",
    f"""select w.job_id, a.job_id is not null as found, a.status, a.pipeline from
        (select 'job-' || unnest([3, 7, 20, 999999]) as job_id) w left join ({_state_sql()}) a on w.job_id = a.job_id""",
)
def r2_bucketed_get(spark: SparkSession, folder: str) -> DataFrame:
    """The log in buckets of its key, added in two goes; four ids read four buckets at most."""
    log, name = s.job_log(spark, folder), f"{fresh_database(spark, 'buckets')}.job_log"
    for half in (0, 1):
        indexes.keep_bucketed(log.filter(F.pmod("seq", F.lit(2)) == half), name, "job_id", 16)
    ids = [f"job-{n}" for n in (3, 7, 20, 999999)]
    jobs = registry.current_jobs(indexes.of_ids(spark, name, "job_id", ids))
    wanted = spark.createDataFrame([(i,) for i in ids], "job_id string")
    return registry.get_by_id(jobs, wanted, "job_id").select("job_id", "found", "status", "pipeline")


@query("r3_update_job", _state_sql())
def r3_update_job(spark: SparkSession, folder: str) -> DataFrame:
    return _job_view(s.jobs(spark, folder))


@query("r3_compacted_log", _state_sql())
def r3_compacted_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every second patch stored by day and compacted, then folded with the rest."""
    log, whole, compacted = s.job_log(spark, folder), scratch(spark, "job_log"), scratch(spark, "job_log")
    registry.append_log(log.filter("seq % 2 = 0"), whole)
    registry.append_log(registry.compact_jobs(registry.read_log(spark, whole, JOB)), compacted)
    older = registry.read_log(spark, compacted, JOB)
    return _job_view(registry.current_jobs(older.unionByName(log.filter("seq % 2 <> 0"))))


@query("r3_renewed_log", _state_sql())
def r3_renewed_log(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the patches stored and the log renewed, the other half added, then folded."""
    log, place = s.job_log(spark, folder), scratch(spark, "job_log")
    registry.append_log(log.filter("seq % 2 = 0"), place)
    registry.renew_log(spark, place, JOB)
    registry.append_log(log.filter("seq % 2 <> 0"), place)
    return _job_view(registry.current_jobs(registry.read_log(spark, place, JOB)))


#: Patches in a file of the stream at most.
BATCH_ROWS = 2_000_000


@query("r3_streamed_state", _state_sql())
def r3_streamed_state(spark: SparkSession, folder: str) -> DataFrame:
    """The patches as a stream in three batches or more, their states kept batch by batch; no fold of the log."""
    place, name = scratch(spark, "patch_stream"), fresh_database(spark, "state")
    log = s.job_log(spark, folder)
    # A batch is one file of bounded length, in row groups that many tasks read, however long the log is.
    pieces = {"maxRecordsPerFile": BATCH_ROWS, "parquet.block.size": 4 << 20}
    log.repartition(3, "seq").write.options(**pieces).parquet(place)
    fields, entries = f"{name}.job_fields", f"{name}.job_entries"
    patches = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(place)
    running = [
        state.keep(state.field_states(patches, "job_id", registry.JOB_FIELDS), fields, scratch(spark, "fields_checkpoint")),
        state.keep(state.entry_states(patches, "job_id"), entries, scratch(spark, "entries_checkpoint")),
    ]
    for stream in running:
        stream.awaitTermination()
    return _job_view(state.current(spark, fields, entries, "job_id"))


@query(
    "r3_unknown_jobs",
    """select 'job-' || (user_id * 20) as job_id, count(*) as patches from events
        where user_id * 20 not in (select c_custkey from customer) group by user_id""",
)
def r3_unknown_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Patches for jobs nobody created."""
    patches = table(spark, folder, "events").select(
        F.concat(F.lit("job-"), (F.col("user_id") * 20).cast("string")).alias("job_id"),
        F.lit("running").alias("status"),
        F.col("ts").cast("timestamp").alias("patched_at"),
        F.col("event_id").alias("seq"),
    )
    log = s.created_jobs(spark, folder).unionByName(registry.job_updates(patches))
    return registry.unknown_patches(log, "job_id").groupBy("job_id").agg(F.count("*").alias("patches"))


@query(
    "r4_query_jobs",
    f"""select job_id, pipeline, environment, status, created_us from ({_state_sql()})
        where environment = 'dev' and status = 'pending' and created_us >= 1672531200000000
          and created_us <= 1672617600000000
        order by created_us desc, job_id limit 50 offset 10""",
)
def r4_query_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """A page of jobs; the page is the feature."""
    found = registry.query_jobs(
        s.jobs(spark, folder),
        registry.JobQuery(
            environment="dev",
            status="pending",
            created_after="2023-01-01T00:00:00+00:00",
            created_before="2023-01-02T00:00:00+00:00",
            limit=50,
            offset=10,
        ),
    )
    return found.select("job_id", "pipeline", "environment", "status", _us("created_at"))


@query(
    "r1_rejected",
    """select o_orderkey as number, case when o_orderkey % 3 = 0 then 'pipeline is missing' end as reason
       from orders""",
)
def r1_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Job requests, those of every third order without a pipeline: what is kept and what is refused."""
    number = F.col("o_orderkey")
    requests = table(spark, folder, "orders").select(
        number.alias("number"),
        F.when(number % 3 != 0, F.col("o_orderpriority")).alias("pipeline"),
        F.concat(F.lit("job-"), number.cast("string")).alias("job_id"),
        F.col("o_orderdate").cast("timestamp").alias("patched_at"),
        number.alias("seq"),
    )
    kept = registry.create_jobs(requests, ["number"])
    refused = registry.rejected_jobs(requests)
    return kept.select(F.col("seq").alias("number"), F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("number", "reason")
    )


@query(
    "r5_rejected",
    """select o_orderkey as number, case when o_orderkey % 3 = 0 then 'action is missing'
         when o_custkey * 2 not in (select c_custkey from customer) then 'job does not exist' end as reason
       from orders""",
)
def r5_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """Step requests, some without an action and some for jobs that do not exist: kept and refused."""
    number = F.col("o_orderkey")
    requests = table(spark, folder, "orders").select(
        number.alias("number"),
        F.concat(F.lit("job-"), (F.col("o_custkey") * 2).cast("string")).alias("job_id"),
        F.lit("load").alias("step_name"),
        F.lit("table").alias("handler_type"),
        F.when(number % 3 != 0, "insert").alias("action"),
        F.col("o_orderdate").cast("timestamp").alias("patched_at"),
        number.alias("seq"),
    )
    customers = table(spark, folder, "customer")
    jobs = customers.select(F.concat(F.lit("job-"), F.col("c_custkey").cast("string")).alias("job_id"))
    kept = registry.add_steps(requests, ["number"], jobs)
    refused = registry.rejected_steps(requests, jobs)
    return kept.select(F.col("seq").alias("number"), F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("number", "reason")
    )


@query(
    "r5_add_step",
    """select 'step-' || sha256(length(cast(o_orderkey as varchar)) || ':' || o_orderkey) as step_id, 'job-' || o_custkey as job_id,
        o_orderpriority as step_name, 'pending' as status, 0 as inputs,
        o_custkey * 2 not in (select c_custkey from customer) as orphan from orders""",
)
def r5_add_step(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a step; half of the jobs, those of customers past the middle, do not exist."""
    requests = table(spark, folder, "orders").select(
        F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.col("o_orderpriority").alias("step_name"),
        F.lit("query").alias("handler_type"),
        F.lit("execute").alias("action"),
        F.col("o_orderdate").cast("timestamp").alias("patched_at"),
        F.col("o_orderkey").alias("seq"),
    )
    added = registry.add_steps(requests, ["seq"])
    jobs = (
        table(spark, folder, "customer")
        .filter("c_custkey % 2 = 0")
        .select(F.concat(F.lit("job-"), (F.col("c_custkey") / 2).cast("bigint").cast("string")).alias("job_id"))
    )
    orphans = registry.orphan_steps(added, jobs).select("step_id", F.lit(True).alias("orphan"))
    return added.join(orphans, "step_id", "left").select(
        "step_id", "job_id", "step_name", "status",
        F.size("inputs").alias("inputs"),
        F.coalesce("orphan", F.lit(False)).alias("orphan"),
    )


@query(
    "r6_get_step",
    f"""select w.step_id, a.step_id is not null as found, a.status,
        case when a.step_id is not null then 'main.t' || (a.k % 10) || ',main.t' || (a.k % 7) end as inputs
        from (select 'step-' || (o_orderkey * 2) as step_id from orders) w
        left join ({s.STEPS_SQL}) a on w.step_id = a.step_id""",
)
def r6_get_step(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "orders").select(
        F.concat(F.lit("step-"), (F.col("o_orderkey") * 2).cast("string")).alias("step_id")
    )
    return registry.get_by_id(s.steps(spark, folder), wanted, "step_id").select(
        "step_id", "found", "status", F.array_join(F.col("inputs.location"), ",").alias("inputs")
    )


@query(
    "r7_get_job_steps",
    f"""select job_id, step_id, step_name, status, started_us, duration_ms, 2 as input_count,
        case when completed_us is null then 0 else 2 end as output_count from ({s.STEPS_SQL})""",
)
def r7_get_job_steps(spark: SparkSession, folder: str) -> DataFrame:
    return registry.job_steps(s.steps(spark, folder)).select(
        "job_id", "step_id", "step_name", "status", _us("started_at"), "duration_ms", "input_count", "output_count"
    )


@query(
    "r8_update_step",
    f"""with p as (select user_id, max_by({s.STATUS_SQL}, event_id) status,
            max(epoch_us(ts)) filter (where event_type in ('view', 'click')) started_us,
            max(epoch_us(ts)) filter (where event_type in ('purchase', 'error')) completed_us,
            max_by('main.t' || ({s.K_SQL} % 10), event_id) filter (where event_type = 'purchase') outputs,
            max_by({s.K_SQL}, event_id) duration_ms,
            max_by('failed at ' || {s.K_SQL}, event_id) filter (where event_type = 'error') error
          from events group by user_id)
        select 'step-' || c_custkey as step_id, 'job-' || c_nationkey as job_id,
            coalesce(status, 'pending') as status, started_us, completed_us,
            coalesce(outputs, '') as outputs, duration_ms, error
        from customer left join p on c_custkey = user_id""",
)
def r8_update_step(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer a step, patched by the user's events; only purchases name outputs."""
    requests = table(spark, folder, "customer").select(
        F.concat(F.lit("step-"), F.col("c_custkey").cast("string")).alias("step_id"),
        F.concat(F.lit("job-"), F.col("c_nationkey").cast("string")).alias("job_id"),
        F.lit("load").alias("step_name"),
        F.lit("transform").alias("handler_type"),
        F.lit("run").alias("action"),
        F.timestamp_seconds(F.lit(0)).alias("patched_at"),
        F.lit(-1).cast("bigint").alias("seq"),
    )
    patches = s.job_patches(spark, folder).withColumnRenamed("job_id", "step_id").drop("metadata")
    events = table(spark, folder, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    details = events.select(
        F.col("event_id").alias("seq"),
        k.alias("duration_ms"),
        F.when(
            F.col("event_type") == "purchase",
            F.array(
                F.struct(
                    F.lit("table").alias("ref_type"),
                    F.concat(F.lit("main.t"), F.pmod(k, F.lit(10)).cast("string")).alias("location"),
                    F.lit(None).cast("string").alias("format"),
                    F.lit(None).cast("map<string,string>").alias("metadata"),
                )
            ),
        ).alias("outputs"),
    )
    patches = patches.withColumn("step_id", F.regexp_replace("step_id", "^job-", "step-")).join(details, "seq")
    log = registry.add_steps(requests, ["seq"]).unionByName(registry.step_updates(patches))
    return registry.current_steps(log).select(
        "step_id", "job_id", "status", _us("started_at"), _us("completed_at"),
        F.array_join(F.col("outputs.location"), ",").alias("outputs"),
        "duration_ms", "error",
    )


@query(
    "r9_producers",
    f"""select st.step_id, st.job_id, st.step_name, j.logic_version, st.completed_us
        from ({s.STEPS_SQL}) st join ({s.JOBS_SQL}) j on st.job_id = j.job_id
        where st.completed_us is not null and st.k % 5 = 3 and j.environment = 'prod'""",
)
def r9_producers(spark: SparkSession, folder: str) -> DataFrame:
    found = lineage.producers(s.steps(spark, folder), s.created_jobs(spark, folder), "main.t3", "prod")
    return found.select("step_id", "job_id", "step_name", "logic_version", _us("completed_at"))


@query(
    "r10_consumers",
    f"""select st.step_id, st.job_id, st.step_name, j.logic_version, st.started_us
        from ({s.STEPS_SQL}) st join ({s.JOBS_SQL}) j on st.job_id = j.job_id
        where st.k % 10 = 3 or st.k % 7 = 3""",
)
def r10_consumers(spark: SparkSession, folder: str) -> DataFrame:
    found = lineage.consumers(s.steps(spark, folder), s.created_jobs(spark, folder), "main.t3")
    return found.select("step_id", "job_id", "step_name", "logic_version", _us("started_at"))


@query(
    "r11_lineage_both",
    f"""with e as (select 'producer' as role, 'main.t' || (k % 5) as location, * from ({s.STEPS_SQL})
                   where completed_us is not null
                   union select 'consumer', 'main.t' || (k % 10), * from ({s.STEPS_SQL})
                   union select 'consumer', 'main.t' || (k % 7), * from ({s.STEPS_SQL}))
        select e.location, e.role, e.step_id, e.job_id, j.environment, j.logic_version, e.started_us, e.completed_us
        from e join ({s.JOBS_SQL}) j on e.job_id = j.job_id""",
)
def r11_lineage_both(spark: SparkSession, folder: str) -> DataFrame:
    """Every location's producers and consumers; a step that reads one location twice counts once."""
    return lineage.lineage(s.steps(spark, folder), s.created_jobs(spark, folder)).select(
        "location", "role", "step_id", "job_id", "environment", "logic_version", _us("started_at"), _us("completed_at")
    )


@query(
    "r11_indexed_lineage",
    f"""with e as (select 'consumer' as role, 'main.t' || (k % 10) as location, * from ({s.STEPS_SQL})
                   union select 'consumer', 'main.t' || (k % 7), * from ({s.STEPS_SQL}))
        select e.location, e.role, e.step_id from e join ({s.JOBS_SQL}) j on e.job_id = j.job_id
        where j.environment = 'dev' and e.location in (select 'main.t' || s_nationkey from supplier)""",
)
def r11_indexed_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """The same question through the location index and a step log in buckets."""
    name = fresh_database(spark, "places")
    steps = s.steps(spark, folder).withColumn("half", F.crc32(F.col("step_id").cast("binary")) % 2)
    for half in (0, 1):
        some = steps.filter(F.col("half") == half).drop("half")
        indexes.index_locations(some, f"{name}.locations")
        indexes.keep_bucketed(some, f"{name}.steps", "step_id", 16)
    wanted = table(spark, folder, "supplier").select(F.concat(F.lit("main.t"), F.col("s_nationkey").cast("string")).alias("location"))
    ids = indexes.steps_naming(spark, f"{name}.locations", wanted, "consumers")
    kept = spark.table(f"{name}.steps").join(ids, "step_id", "left_semi")
    found = lineage.lineage(kept, s.created_jobs(spark, folder), wanted, "consumers", "dev")
    return found.select("role", "location", "step_id")


@query(
    "r11_lineage_wanted",
    f"""with e as (select 'consumer' as role, 'main.t' || (k % 10) as location, * from ({s.STEPS_SQL})
                   union select 'consumer', 'main.t' || (k % 7), * from ({s.STEPS_SQL}))
        select e.location, e.role, e.step_id from e join ({s.JOBS_SQL}) j on e.job_id = j.job_id
        where j.environment = 'dev' and e.location in (select 'main.t' || s_nationkey from supplier)""",
)
def r11_lineage_wanted(spark: SparkSession, folder: str) -> DataFrame:
    wanted = table(spark, folder, "supplier").select(
        F.concat(F.lit("main.t"), F.col("s_nationkey").cast("string")).alias("location")
    )
    return lineage.lineage(
        s.steps(spark, folder), s.created_jobs(spark, folder), wanted, "consumers", "dev"
    ).select("location", "role", "step_id")


@query(
    "r12_job_summary",
    f"""select job_id, count(*) as steps, count(*) filter (where status = 'pending') as pending_steps,
        count(*) filter (where status = 'running') as running_steps,
        count(*) filter (where status = 'success') as success_steps,
        count(*) filter (where status = 'failed') as failed_steps,
        count(*) filter (where status = 'skipped') as skipped_steps,
        cast(sum(duration_ms) as bigint) as total_duration_ms from ({s.STEPS_SQL}) group by job_id""",
)
def r12_job_summary(spark: SparkSession, folder: str) -> DataFrame:
    return registry.job_summary(s.steps(spark, folder))
