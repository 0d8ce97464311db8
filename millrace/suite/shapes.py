"""Statements, the query shapes users run, and general coverage of the SQL surface."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.positions import positions
from millrace.operators import checks, sql, tables
from millrace.operators.tables import ColumnSpec
from millrace.plans import budget
from millrace.suite import standins as s
from millrace.suite.base import fresh_database, query, table

_TOP_SQL = "select o_orderkey, o_custkey, o_totalprice from {source} order by o_totalprice desc, o_orderkey"


@query(
    "q1_execute_sql",
    f"""select *, true as truncated, cast(1000 as int) as row_count
        from ({_TOP_SQL.format(source='orders')} limit 1000)""",
)
def q1_execute_sql(spark: SparkSession, folder: str) -> DataFrame:
    """A capped result: the row cap is the feature."""
    result = sql.execute(spark, _TOP_SQL.replace("{source}", "{orders}"), orders=table(spark, folder, "orders"))
    frame = spark.createDataFrame(result.rows, result.schema)
    return frame.withColumns(
        {"truncated": F.lit(result.truncated), "row_count": F.lit(result.row_count)}
    )


@query(
    "q1a_parameters",
    """select o_orderkey, o_orderstatus, o_totalprice, 42 as x, 'test' as y from orders
       where o_orderstatus = 'F' and o_totalprice > 100000""",
)
def q1a_parameters(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    named = sql.statement(
        spark,
        "select o_orderkey, o_orderstatus, o_totalprice from {orders} where o_orderstatus = :status",
        {"status": "F"},
        orders=orders,
    )
    return sql.statement(
        spark,
        "select *, ? as x, ? as y from {rows} where o_totalprice > ?",
        [42, "test", 100000],
        rows=named,
    )


@query(
    "q2_execute_script",
    "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O'",
)
def q2_execute_script(spark: SparkSession, folder: str) -> DataFrame:
    database = fresh_database(spark, "script")
    sql.execute_script(
        spark,
        [
            f"CREATE TABLE {database}.open_orders (o_orderkey bigint, o_totalprice double) USING parquet",
            f"""INSERT INTO {database}.open_orders SELECT o_orderkey, o_totalprice
                FROM parquet.`{folder}/orders.parquet` WHERE o_orderstatus = 'O'""",
        ],
    )
    return spark.table(f"{database}.open_orders")


@query(
    "q3_execute_many",
    """select c_custkey, c_mktsegment || ' #' || c_nationkey as label, c_acctbal as amount
       from customer""",
)
def q3_execute_many(spark: SparkSession, folder: str) -> DataFrame:
    database = fresh_database(spark, "many")
    spark.sql(f"CREATE TABLE {database}.labels (c_custkey bigint, label string, amount double) USING parquet")
    sets = table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    sql.execute_many(
        spark,
        f"""INSERT INTO {database}.labels
            SELECT c_custkey, c_mktsegment || ' #' || c_nationkey, c_acctbal FROM {{params}}""",
        sets,
    )
    return spark.table(f"{database}.labels")


@query(
    "q4_result_record",
    """select 'sql' as execution_type, 'spark' as dialect,
        'select count(*) as n, max(o_totalprice) as top from {orders} where o_custkey <> ?' as statement,
        '[-1]' as parameters, count(*) as n, max(o_totalprice) as top from orders""",
)
def q4_result_record(spark: SparkSession, folder: str) -> DataFrame:
    result = sql.execute(
        spark,
        "select count(*) as n, max(o_totalprice) as top from {orders} where o_custkey <> ?",
        [-1],
        orders=table(spark, folder, "orders"),
    )
    details = result.execution["details"]
    return spark.createDataFrame(result.rows, result.schema).withColumns(
        {
            "execution_type": F.lit(result.execution["execution_type"]),
            "dialect": F.lit(details["dialect"]),
            "statement": F.lit(details["statements"][0]),
            "parameters": F.lit(str(details["parameters"])),
        }
    )


@query("q10_project_cast", s.EXPENDITURES_SQL)
def q10_project_cast(spark: SparkSession, folder: str) -> DataFrame:
    return budget.stg_expenditures(s.raw_expenditures(spark, folder))


@query(
    "q11_group_agg",
    """select o_custkey as department_id, cast(sum(cast(o_totalprice as decimal(15,2))) as decimal(18,2))
        as total_spent, count(*) as transaction_count from orders group by o_custkey""",
)
def q11_group_agg(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("o_totalprice").cast("decimal(15,2)")
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("department_id"))
        .agg(
            F.sum(amount).cast("decimal(18,2)").alias("total_spent"),
            F.count("*").alias("transaction_count"),
        )
    )


@query(
    "q12_left_join_default",
    """select c_custkey, coalesce(n, 0) as orders from customer left join
        (select o_custkey, count(*) n from orders where o_orderpriority = '1-URGENT' group by o_custkey)
        on c_custkey = o_custkey""",
)
def q12_left_join_default(spark: SparkSession, folder: str) -> DataFrame:
    counts = (
        s.raw_expenditures(spark, folder)
        .groupBy(F.col("department_id").alias("c_custkey"))
        .agg(F.count("*").alias("orders"))
    )
    return (
        table(spark, folder, "customer")
        .select("c_custkey")
        .join(counts, "c_custkey", "left")
        .withColumn("orders", F.coalesce("orders", F.lit(0)))
    )


@query(
    "q13_ratio_metrics",
    """select o_orderkey, cast(c_acctbal as decimal(15,2)) - cast(o_totalprice as decimal(15,2)) as remaining,
        round(o_totalprice / nullif(c_acctbal, 0) * 100, 2) as percent
        from orders join customer on o_custkey = c_custkey""",
)
def q13_ratio_metrics(spark: SparkSession, folder: str) -> DataFrame:
    balance, price = F.col("c_acctbal"), F.col("o_totalprice")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return (
        table(spark, folder, "orders")
        .join(customers, "o_custkey")
        .select(
            "o_orderkey",
            (balance.cast("decimal(15,2)") - price.cast("decimal(15,2)")).alias("remaining"),
            F.round(price / F.nullif(balance, F.lit(0.0)) * 100, 2).alias("percent"),
        )
    )


@query(
    "q14_global_agg",
    f"""select cast(sum(total_spent) as decimal(18,2)) total_spent,
        cast(sum(budget_amount) as decimal(18,2)) total_budget, count(*) departments
        from ({s.SUMMARY_SQL})""",
)
def q14_global_agg(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder).agg(
        F.sum("total_spent").cast("decimal(18,2)").alias("total_spent"),
        F.sum("budget_amount").cast("decimal(18,2)").alias("total_budget"),
        F.count("*").alias("departments"),
    )


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return budget.budget_summary(
        budget.stg_departments(s.raw_departments(spark, folder)),
        budget.stg_expenditures(s.raw_expenditures(spark, folder)),
    )


@query("q15_filter", "select c_custkey, c_name, c_acctbal from customer where c_acctbal > 5000")
def q15_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").filter("c_acctbal > 5000").select("c_custkey", "c_name", "c_acctbal")


@query("q16_order_by", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey")
def q16_order_by(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("q17_distinct", "select distinct l_partkey, l_suppkey from lineitem")
def q17_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query(
    "q18_sequence",
    """select n, coalesce(orders, 0) as orders from
        (select unnest(generate_series(1, n)) n from (select count(*) n from orders))
        left join (select o_orderkey * 2 as k, count(*) orders from orders group by all) on n = k""",
)
def q18_sequence(spark: SparkSession, folder: str) -> DataFrame:
    """A sequence as long as the orders table, next to the orders whose doubled key falls on a number."""
    orders = table(spark, folder, "orders")
    counts = orders.groupBy((F.col("o_orderkey") * 2).alias("n")).agg(F.count("*").alias("orders"))
    return (
        spark.range(1, orders.count() + 1)
        .select(F.col("id").alias("n"))
        .join(counts, "n", "left")
        .withColumn("orders", F.coalesce("orders", F.lit(0)))
    )


@query("q19_literal_select", "select s_suppkey, 1 as num, 'hello' as greeting from supplier")
def q19_literal_select(spark: SparkSession, folder: str) -> DataFrame:
    return sql.statement(
        spark,
        "select s_suppkey, 1 as num, 'hello' as greeting from {supplier}",
        supplier=table(spark, folder, "supplier"),
    )


@query(
    "q20_inner_join",
    f"""select st.step_id, st.job_id, j.environment, j.logic_version from ({s.STEPS_SQL}) st
        join ({s.JOBS_SQL}) j on st.job_id = j.job_id where j.environment = 'prod'""",
)
def q20_inner_join(spark: SparkSession, folder: str) -> DataFrame:
    jobs = s.created_jobs(spark, folder).filter("environment = 'prod'")
    return (
        s.steps(spark, folder)
        .select("step_id", "job_id")
        .join(jobs.select("job_id", "environment", "logic_version"), "job_id")
    )


_CTE = """with urgent as (select o_custkey, sum(cast(o_totalprice as decimal(15,2))) spent
        from {orders} where o_orderpriority = '1-URGENT' group by o_custkey)
    select c_mktsegment, cast(sum(spent) as decimal(18,2)) spent, count(*) customers
    from {customer} join urgent on c_custkey = o_custkey group by c_mktsegment"""


@query("q21_cte_model", _CTE.format(orders="orders", customer="customer"))
def q21_cte_model(spark: SparkSession, folder: str) -> DataFrame:
    return sql.statement(
        spark, _CTE, orders=table(spark, folder, "orders"), customer=table(spark, folder, "customer")
    )


@query(
    "q22_paging",
    "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey limit 100 offset 200",
)
def q22_paging(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of a hundred; the page is the feature."""
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_orderdate")
        .orderBy(F.desc("o_orderdate"), "o_orderkey")
        .offset(200)
        .limit(100)
    )


@query(
    "q23_nulls_last",
    f"""select step_id, completed_us, started_us,
        cast(row_number() over (order by completed_us desc nulls last, step_id) as bigint) as position
        from ({s.STEPS_SQL})""",
)
def q23_nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    """All steps by completion with unfinished ones last, and their position in that list."""
    steps = (
        s.steps(spark, folder)
        .select(
            "step_id",
            F.unix_micros("completed_at").alias("completed_us"),
            F.unix_micros("started_at").alias("started_us"),
        )
    )
    return positions(steps, F.desc_nulls_last("completed_us"), F.asc("step_id"))


# --- general coverage ------------------------------------------------------------------------


@query(
    "p1_semi_anti",
    """select c_custkey, true as labelled from customer
        where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')
       union all select c_custkey, false from customer
        where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')""",
)
def p1_semi_anti(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey")
    urgent = s.raw_expenditures(spark, folder).select(F.col("department_id").alias("c_custkey")).distinct()
    with_orders = customers.join(urgent, "c_custkey", "left_semi").withColumn("labelled", F.lit(True))
    without = customers.join(urgent, "c_custkey", "left_anti").withColumn("labelled", F.lit(False))
    return with_orders.unionByName(without)


@query(
    "p3_count_distinct",
    """select l_returnflag, count(distinct l_partkey) parts, count(distinct l_suppkey) suppliers
       from lineitem group by l_returnflag""",
)
def p3_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag")
        .agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))
    )


@query(
    "p4_rollup_cube",
    """select 'rollup' as shape, l_returnflag, l_linestatus, count(*) n from lineitem
        group by rollup (l_returnflag, l_linestatus)
       union all select 'cube', l_returnflag, l_linestatus, count(*) from lineitem
        group by cube (l_returnflag, l_linestatus)""",
)
def p4_rollup_cube(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    count = F.count("*").alias("n")
    rolled = lines.rollup("l_returnflag", "l_linestatus").agg(count).withColumn("shape", F.lit("rollup"))
    cubed = lines.cube("l_returnflag", "l_linestatus").agg(count).withColumn("shape", F.lit("cube"))
    return rolled.unionByName(cubed)


@query(
    "p5_window",
    """with m as (select o_custkey, cast(date_trunc('month', o_orderdate) as date) as order_month,
            cast(sum(cast(o_totalprice as decimal(15,2))) as decimal(18,2)) as spent from orders group by all)
        select o_custkey, order_month, spent, row_number() over w as place, lag(spent) over w as previous,
            cast(sum(spent) over w as decimal(18,2)) as running
        from m window w as (partition by o_custkey order by order_month
                            rows between unbounded preceding and current row)""",
)
def p5_window(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals per customer over months: summed first, so a window holds months, not orders."""
    months = (
        table(spark, folder, "orders")
        .groupBy("o_custkey", F.date_trunc("month", "o_orderdate").cast("date").alias("order_month"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("decimal(18,2)").alias("spent"))
    )
    order = Window.partitionBy("o_custkey").orderBy("order_month")
    running = F.sum("spent").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return months.withColumns(
        {
            "place": F.row_number().over(order).cast("bigint"),
            "previous": F.lag("spent").over(order),
            "running": running.cast("decimal(18,2)"),
        }
    )


@query(
    "p6_set_operations",
    """select 'both' as side, k from (select l_partkey k from lineitem where l_returnflag = 'R'
                                      intersect select l_partkey from lineitem where l_returnflag = 'A')
       union all select 'unsold', k from (select p_partkey k from part except select l_partkey from lineitem
                                          where l_returnflag = 'R')""",
)
def p6_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    sold = {f: lines.filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k")).distinct() for f in "RA"}
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    both = sold["R"].intersect(sold["A"]).withColumn("side", F.lit("both"))
    unsold = parts.subtract(sold["R"]).withColumn("side", F.lit("unsold"))
    return both.unionByName(unsold)


@query(
    "p7_strings",
    """select p_partkey, lower(p_brand) brand, contains(lower(p_name), 'red') is_red,
        translate(p_brand, '#', '') plain, split_part(p_name, ' ', 2) noun,
        replace('"' || p_type || '"."' || p_name || '"', '"', '') relation from part""",
)
def p7_strings(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit('"'), "p_type", F.lit('"."'), "p_name", F.lit('"'))
    return table(spark, folder, "part").select(
        "p_partkey",
        F.lower("p_brand").alias("brand"),
        F.lower("p_name").contains("red").alias("is_red"),
        F.translate("p_brand", "#", "").alias("plain"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
        F.translate(quoted, '"', "").alias("relation"),
    )


@query(
    "p8_dates",
    """select o_orderkey, cast(o_orderdate as date) order_day, cast(date_trunc('month', o_orderdate) as date) month_start,
        cast(year(o_orderdate) as int) as year, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') iso from orders""",
)
def p8_dates(spark: SparkSession, folder: str) -> DataFrame:
    when = F.col("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        when.cast("date").alias("order_day"),
        F.date_trunc("month", when).cast("date").alias("month_start"),
        F.year(when).alias("year"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
    )


_SUBQUERY = """select o_orderkey, o_custkey, o_totalprice from {orders} o
    where o_totalprice > (select avg(o_totalprice) from {orders})
      and exists (select 1 from {customer} where c_custkey = o.o_custkey and c_acctbal < 0)
      and o_totalprice = (select max(i.o_totalprice) from {orders} i where i.o_custkey = o.o_custkey)"""


@query("p9_subqueries", _SUBQUERY.format(orders="orders", customer="customer"))
def p9_subqueries(spark: SparkSession, folder: str) -> DataFrame:
    return sql.statement(
        spark, _SUBQUERY, orders=table(spark, folder, "orders"), customer=table(spark, folder, "customer")
    )


# --- tables ----------------------------------------------------------------------------------

_ORDER_COLUMNS = [
    ColumnSpec("o_orderkey", "BIGINT", primary_key=True),
    ColumnSpec("o_custkey", "BIGINT", nullable=False),
    ColumnSpec("o_orderpriority", "VARCHAR"),
    ColumnSpec("o_totalprice", "DECIMAL(15,2)"),
]
_ORDER_SQL = """select o_orderkey, o_custkey, o_orderpriority, cast(o_totalprice as decimal(15,2)) o_totalprice
    from orders"""


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(*[c.name for c in _ORDER_COLUMNS])


@query(
    "t1_create_table",
    f"""select * from ({_ORDER_SQL}) cross join (select 4 as columns_kept)""",
)
def t1_create_table(spark: SparkSession, folder: str) -> DataFrame:
    """Creating an existing table again, with another layout, keeps the table and its rows."""
    name = f"{fresh_database(spark, 'create')}.orders"
    tables.create_table(spark, name, _ORDER_COLUMNS)
    tables.insert(spark, name, _orders(spark, folder))
    tables.create_table(spark, name, [ColumnSpec("other", "INT")])
    kept = tables.read_table(spark, name)
    return kept.withColumn("columns_kept", F.lit(len(kept.columns)))


@query(
    "t2_drop_table",
    """select 'region' as name, count(*) as row_count from region
       union all select 'supplier', count(*) from supplier""",
)
def t2_drop_table(spark: SparkSession, folder: str) -> DataFrame:
    """Three tables stored, one dropped, and a missing one dropped without complaint."""
    database = fresh_database(spark, "dropped")
    for name in ("nation", "region", "supplier"):
        tables.store(spark, f"{database}.{name}", table(spark, folder, name))
    tables.drop_table(spark, f"{database}.nation", if_exists=False)
    tables.drop_table(spark, f"{database}.nation")
    return _listed(spark, database, ("region", "supplier"))


def _listed(spark: SparkSession, database: str, names: tuple[str, ...]) -> DataFrame:
    """The database's table names with the row counts of the tables expected there."""
    counts = [
        spark.table(f"{database}.{n}").agg(F.lit(n).alias("name"), F.count("*").alias("row_count"))
        for n in names
    ]
    return tables.list_tables(spark, database).join(reduce(DataFrame.union, counts), "name", "left")


@query("t3_insert", _ORDER_SQL)
def t3_insert(spark: SparkSession, folder: str) -> DataFrame:
    """Two inserts into a bucketed, keyed table; both check their keys against what is there."""
    name = f"{fresh_database(spark, 'inserted')}.orders"
    tables.create_table(spark, name, _ORDER_COLUMNS, buckets=8)
    orders = _orders(spark, folder)
    late = F.col("o_orderpriority") == "5-LOW"
    tables.insert(spark, name, orders.filter(~late))
    tables.insert(spark, name, orders.filter(late))
    return tables.read_table(spark, name)


_UPSERT_SQL = """with b as (select user_id * 20 as c_custkey, max_by(value, event_id) as balance
        from events group by user_id)
    select coalesce(c.c_custkey, b.c_custkey) as c_custkey, c.c_mktsegment,
        case when b.c_custkey is not null then cast(b.balance as decimal(15,2))
             else cast(c.c_acctbal as decimal(15,2)) end as c_acctbal
    from customer c full outer join b on c.c_custkey = b.c_custkey"""


def _upserted(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    name = f"{fresh_database(spark, 'upserted')}.customer"
    columns = [
        ColumnSpec("c_custkey", "BIGINT", primary_key=True),
        ColumnSpec("c_mktsegment", "VARCHAR"),
        ColumnSpec("c_acctbal", "DECIMAL(15,2)"),
    ]
    tables.create_table(spark, name, columns, buckets=buckets)
    tables.insert(spark, name, table(spark, folder, "customer").select(*[c.name for c in columns]))
    batch = table(spark, folder, "events").select(
        (F.col("user_id") * 20).alias("c_custkey"), F.col("value").alias("c_acctbal"), "event_id"
    )
    tables.upsert(spark, name, batch, ["c_custkey"], sequence="event_id")
    return tables.read_table(spark, name)


@query("t4_upsert", _UPSERT_SQL)
def t4_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The last event per key wins and the segment, which the batch leaves out, is kept."""
    return _upserted(spark, folder, 0)


@query("t4_upsert_bucketed", _UPSERT_SQL)
def t4_upsert_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    return _upserted(spark, folder, 8)


@query("t4_merge_plan", _UPSERT_SQL)
def t4_merge_plan(spark: SparkSession, folder: str) -> DataFrame:
    """The merge alone, by full outer join, as used for a batch too big to broadcast."""
    target = table(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(15,2)").alias("c_acctbal")
    )
    batch = table(spark, folder, "events").select(
        (F.col("user_id") * 20).alias("c_custkey"),
        F.col("value").cast("decimal(15,2)").alias("c_acctbal"),
        F.col("event_id").alias("_seq"),
    )
    return tables.merge(target, tables.latest_rows(batch, ["c_custkey"]), ["c_custkey"])


@query("t5_truncate", "select p_partkey, p_name from part where p_size > 25")
def t5_truncate(spark: SparkSession, folder: str) -> DataFrame:
    name = f"{fresh_database(spark, 'truncated')}.part"
    columns = [ColumnSpec("p_partkey", "BIGINT", primary_key=True), ColumnSpec("p_name", "TEXT")]
    tables.create_table(spark, name, columns)
    parts = table(spark, folder, "part")
    tables.insert(spark, name, parts.select("p_partkey", "p_name"))
    tables.truncate(spark, name)
    tables.insert(spark, name, parts.filter("p_size > 25").select("p_partkey", "p_name"))
    return tables.read_table(spark, name)


@query(
    "t6_list_tables",
    """select 'nation' as name, count(*) as row_count from nation
       union all select 'region', count(*) from region union all select 'supplier', count(*) from supplier""",
)
def t6_list_tables(spark: SparkSession, folder: str) -> DataFrame:
    database = fresh_database(spark, "listed")
    names = ("supplier", "region", "nation")
    for name in names:
        tables.store(spark, f"{database}.{name}", table(spark, folder, name))
    return _listed(spark, database, names)


@query(
    "t7_table_info",
    """select * from (values (1, 'o_orderkey', 'bigint', false), (2, 'o_custkey', 'bigint', false),
        (3, 'o_orderpriority', 'string', true), (4, 'o_totalprice', 'decimal(15,2)', true))
        t(place, name, type, nullable) cross join (select count(*) as row_count from orders)""",
)
def t7_table_info(spark: SparkSession, folder: str) -> DataFrame:
    name = f"{fresh_database(spark, 'described')}.orders"
    tables.create_table(spark, name, _ORDER_COLUMNS, buckets=4)
    tables.insert(spark, name, _orders(spark, folder))
    info = tables.table_info(spark, name)
    rows = [(i, c["name"], c["type"], c["nullable"], info.row_count) for i, c in enumerate(info.columns, 1)]
    return spark.createDataFrame(rows, "place int, name string, type string, nullable boolean, row_count bigint")


@query(
    "t8_constraint_checks",
    """select 'not_null' as rule, 'quality' as columns, count(*) filter (where quality is null) as failures
        from documents d left join labels l on d.doc_id = l.doc_id
       union all select 'not_null', 'text', count(*) filter (where text is null) from documents
       union all select 'unique', 'lang,source', count(*) from
        (select lang, source from documents where lang is not null and source is not null
         group by lang, source having count(*) > 1)""",
)
def t8_constraint_checks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return checks.constraint_report(documents, required=["quality", "text"], keys=["lang", "source"])
