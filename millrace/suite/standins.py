"""The test tables seen as the records the operators work on. Each is a projection or a fold of a
whole table, with a SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import registry
from millrace.suite.base import table

# --- departments and expenditures ------------------------------------------------------------


def raw_departments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("department_id"),
        F.col("c_name").alias("department_name"),
        F.col("c_acctbal").alias("budget_amount"),
        F.lit("2024").alias("fiscal_year"),
    )


def raw_expenditures(spark: SparkSession, folder: str) -> DataFrame:
    """Urgent orders only, so that some departments have none."""
    return (
        table(spark, folder, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(
            F.col("o_orderkey").alias("expenditure_id"),
            F.col("o_custkey").alias("department_id"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("category"),
            F.col("o_orderdate").alias("expenditure_date"),
        )
    )


DEPARTMENTS_SQL = """select c_custkey department_id, c_name department_name,
    cast(c_acctbal as decimal(15,2)) budget_amount, cast('2024' as int) fiscal_year from customer"""
EXPENDITURES_SQL = """select o_orderkey expenditure_id, o_custkey department_id,
    cast(o_totalprice as decimal(15,2)) amount, o_orderpriority category,
    cast(o_orderdate as date) expenditure_date from orders where o_orderpriority = '1-URGENT'"""
SUMMARY_SQL = f"""with d as ({DEPARTMENTS_SQL}), x as ({EXPENDITURES_SQL}),
    e as (select department_id, sum(amount) total_spent, count(*) transaction_count
          from x group by department_id)
    select d.department_id, d.department_name, d.budget_amount, d.fiscal_year,
        cast(coalesce(e.total_spent, 0) as decimal(18,2)) total_spent,
        coalesce(e.transaction_count, 0) transaction_count,
        cast(d.budget_amount - coalesce(e.total_spent, 0) as decimal(18,2)) budget_remaining,
        round(cast(coalesce(e.total_spent, 0) as double)
              / nullif(cast(d.budget_amount as double), 0) * 100, 2) percent_spent
    from d left join e on d.department_id = e.department_id"""

# --- jobs and steps --------------------------------------------------------------------------


def _k() -> Column:
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def _status() -> Column:
    return (
        F.when(F.col("event_type") == "signup", "pending")
        .when(F.col("event_type").isin("view", "click"), "running")
        .when(F.col("event_type") == "purchase", "success")
        .otherwise("failed")
    )


def _job_id(column: str) -> Column:
    return F.concat(F.lit("job-"), F.col(column).cast("string"))


def job_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One requested job per customer."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        _job_id("c_custkey").alias("job_id"),
        F.col("c_mktsegment").alias("pipeline"),
        F.element_at(F.array(F.lit("dev"), F.lit("staging"), F.lit("prod")), F.pmod(key, F.lit(3)).cast("int") + 1).alias(
            "environment"
        ),
        F.concat(F.lit("v"), F.pmod(key, F.lit(4)).cast("string")).alias("logic_version"),
        F.timestamp_seconds(F.lit(1_672_531_200) + key * 60).alias("patched_at"),
        F.lit(-1).cast("bigint").alias("seq"),
        F.create_map(F.lit("origin"), F.lit("request")).alias("metadata"),
    )


JOBS_SQL = """select 'job-' || c_custkey job_id, c_mktsegment pipeline,
    case c_custkey % 3 when 0 then 'dev' when 1 then 'staging' else 'prod' end environment,
    'v' || (c_custkey % 4) logic_version, 1672531200 + c_custkey * 60 created_s from customer"""


def job_patches(spark: SparkSession, folder: str) -> DataFrame:
    """Every event patches its user's job."""
    failed = F.col("event_type") == "error"
    return table(spark, folder, "events").select(
        _job_id("user_id").alias("job_id"),
        _status().alias("status"),
        F.when(failed, F.concat(F.lit("failed at "), _k().cast("string"))).alias("error"),
        F.create_map("event_type", _k().cast("string"), F.lit("last"), F.col("event_type")).alias("metadata"),
        F.col("ts").cast("timestamp").alias("patched_at"),
        F.col("event_id").alias("seq"),
    )


def job_log(spark: SparkSession, folder: str) -> DataFrame:
    created = registry.create_jobs(job_requests(spark, folder), ["job_id"])
    return created.unionByName(registry.job_updates(job_patches(spark, folder)))


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    return registry.current_jobs(job_log(spark, folder))


def created_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs as created, without later patches."""
    return registry.create_jobs(job_requests(spark, folder), ["job_id"])


def _ref(location: Column) -> Column:
    return F.struct(
        F.lit("table").alias("ref_type"),
        location.alias("location"),
        F.lit("parquet").alias("format"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )


def _place(number: Column) -> Column:
    return F.concat(F.lit("main.t"), number.cast("string"))


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a step of its user's job: it reads t(k%10) and t(k%7), writes t(k%5) twice."""
    k, status = _k(), _status()
    ended = status.isin("success", "failed")
    written = _ref(_place(F.pmod(k, F.lit(5))))
    sql = F.struct(
        F.lit("sql").alias("execution_type"),
        F.create_map(F.lit("dialect"), F.lit("spark"), F.lit("statements"), F.col("props")).alias("details"),
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("step-"), F.col("event_id").cast("string")).alias("step_id"),
        _job_id("user_id").alias("job_id"),
        F.concat(F.lit("do_"), F.col("event_type")).alias("step_name"),
        F.lit("transform").alias("handler_type"),
        F.lit("run").alias("action"),
        status.alias("status"),
        F.array(_ref(_place(F.pmod(k, F.lit(10)))), _ref(_place(F.pmod(k, F.lit(7))))).alias("inputs"),
        F.when(ended, F.array(written, written)).otherwise(F.array().cast(f"array<{schemas.DATA_REF}>")).alias(
            "outputs"
        ),
        F.array(sql).alias("executions"),
        F.when(status != "pending", F.col("ts").cast("timestamp")).alias("started_at"),
        F.when(ended, F.col("ts").cast("timestamp")).alias("completed_at"),
        F.floor(F.col("value") * 100).cast("int").alias("duration_ms"),
    )


STATUS_SQL = """case event_type when 'signup' then 'pending' when 'view' then 'running'
    when 'click' then 'running' when 'purchase' then 'success' else 'failed' end"""
K_SQL = "cast(regexp_extract(props, '[0-9]+') as int)"
STEPS_SQL = f"""select 'step-' || event_id step_id, 'job-' || user_id job_id,
    'do_' || event_type step_name, {STATUS_SQL} status, {K_SQL} k, event_id, user_id,
    case when event_type <> 'signup' then epoch_us(ts) end started_us,
    case when event_type in ('purchase','error') then epoch_us(ts) end completed_us,
    cast(floor(value * 100) as int) duration_ms from events"""

# --- catalogue -------------------------------------------------------------------------------


def asset_log(spark: SparkSession, folder: str) -> DataFrame:
    """Parts in key order as registrations of their name; every 50th instead removes the name."""
    key = F.col("p_partkey")
    removes = F.pmod(key, F.lit(50)) == 49
    return table(spark, folder, "part").select(
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("asset_type"),
        F.concat(F.lit("main.part_"), key.cast("string")).alias("location"),
        F.concat(F.lit("Size "), F.col("p_size").cast("string"), F.lit(" "), F.col("p_brand")).alias("description"),
        F.lit(None).cast("array<struct<name:string,type:string>>").alias("columns"),
        F.array("p_brand", F.concat(F.lit("size_"), F.pmod("p_size", F.lit(5)).cast("string"))).alias("tags"),
        F.array(F.concat(F.lit("raw_"), key.cast("string"))).alias("upstream"),
        F.array(F.concat(F.lit("mart_"), F.pmod(key, F.lit(10)).cast("string"))).alias("downstream"),
        F.lit("loader").alias("created_by"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
        F.when(removes, "unregister").otherwise("register").alias("op"),
        F.timestamp_seconds(key).alias("logged_at"),
        key.alias("seq"),
    )


ASSETS_SQL = """select * from (
    select p_name name, lower(p_type) asset_type, 'main.part_' || p_partkey location,
        'Size ' || p_size || ' ' || p_brand description, p_brand tag1, 'size_' || (p_size % 5) tag2,
        p_partkey seq, min(p_partkey) over (partition by p_name) created_s,
        row_number() over (partition by p_name order by p_partkey desc) newest
    from (select p.* from part p left join
            (select p_name as gone, max(p_partkey) as cut from part where p_partkey % 50 = 49
             group by p_name) r on p.p_name = r.gone
          where p.p_partkey % 50 <> 49 and (r.cut is null or p.p_partkey > r.cut))) where newest = 1"""


def order_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as an asset with one or two neighbours on each side."""
    name = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    return table(spark, folder, "orders").select(
        name("order_", "o_orderkey").alias("name"),
        F.lit("table").alias("asset_type"),
        F.array(name("customer_", "o_custkey"), name("priority_", "o_orderpriority")).alias("upstream"),
        F.array(name("status_", "o_orderstatus")).alias("downstream"),
        F.array("o_orderstatus", "o_orderstatus").alias("tags"),
    )


# --- messages --------------------------------------------------------------------------------


def result_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a result; purchases succeeded, signups are pending, the rest are errors.

    Every tenth has no step id.
    """
    key, k = F.col("event_id"), _k()
    success = F.col("event_type") == "purchase"
    empty_refs = F.array().cast(f"array<{schemas.DATA_REF}>")
    return table(spark, folder, "events").select(
        F.when(success, "success").when(F.col("event_type") == "signup", "pending").otherwise("error").alias("status"),
        F.create_map(F.lit("k"), k.cast("string")).alias("data"),
        F.when(
            F.col("event_type") == "error", F.array(F.lit("no answer"), F.lit("gave up"))
        ).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.concat(F.lit("c-"), key.cast("string")).alias("correlation_id"),
        _job_id("user_id").alias("job_id"),
        F.when(F.pmod(key, F.lit(10)) != 0, F.concat(F.lit("step-"), key.cast("string"))).alias("step_id"),
        k.alias("duration_ms"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
        F.lit("query").alias("handler"),
        F.array(_ref(_place(F.pmod(k, F.lit(10))))).alias("inputs"),
        F.when(success, F.array(_ref(_place(F.pmod(k, F.lit(5)))))).otherwise(empty_refs).alias("outputs"),
        F.array().cast(f"array<{schemas.EXECUTION}>").alias("executions"),
    )


def command_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a command to one of four services, the last of which has no topic."""
    services = F.array(*[F.lit(s) for s in ("storage", "query", "transform", "catalog")])
    return table(spark, folder, "events").select(
        F.element_at(services, F.pmod("event_id", F.lit(4)).cast("int") + 1).alias("type"),
        F.col("event_type").alias("action"),
        F.create_map(F.lit("k"), _k().cast("string")).alias("payload"),
        F.concat(F.lit("c-"), F.col("event_id").cast("string")).alias("correlation_id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp"),
    )


def bodies(messages: DataFrame) -> DataFrame:
    """Message bodies as they arrive: odd ones wrapped in a notification, every 97th unreadable."""
    number = F.substring_index("correlation_id", "-", -1).cast("bigint")
    plain = F.to_json(F.struct("*"))
    wrapped = F.to_json(F.struct(F.lit("Notification").alias("Type"), plain.alias("Message")))
    return messages.select(
        F.when(F.pmod(number, F.lit(97)) == 0, "not json")
        .when(F.pmod(number, F.lit(2)) == 1, wrapped)
        .otherwise(plain)
        .alias("body")
    )


READABLE_SQL = "event_id % 97 <> 0"
