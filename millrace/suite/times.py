"""Joins along time and mergeable sketches, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sketches, time_joins
from millrace.session import scratch
from millrace.suite.base import query, table

DAY = 86_400_000_000

# Events of 2024 laid over the years of the orders: a microsecond of theirs is 80 of those.
_EVENT_TIME = "epoch_us(timestamp '1995-01-01') + 80 * (epoch_us(ts) - epoch_us(timestamp '2024-01-01'))"


def _event_time() -> Column:
    return F.lit(9131 * DAY) + 80 * (time_joins.micros(F.col("ts")) - F.lit(19723 * DAY))


@query(
    "p2_asof",
    f"""with o as (select o_custkey, epoch_us(o_orderdate) as at, max(o_orderkey) as o_orderkey,
            max_by(o_totalprice, o_orderkey) as o_totalprice from orders group by all),
        e as (select event_id, user_id, {_EVENT_TIME} as at from events)
       select e.event_id, e.user_id, e.at as event_at, o.o_orderkey, o.o_totalprice, o.at as order_at
       from e asof left join o on e.user_id = o.o_custkey and e.at >= o.at""",
)
def p2_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The customer's latest order as of each event; of orders of one time the highest key."""
    events = table(spark, folder, "events").select("event_id", "user_id", _event_time().alias("event_at"))
    orders = table(spark, folder, "orders").withColumns(
        {"at": time_joins.micros(F.col("o_orderdate")), "user_id": F.col("o_custkey")}
    )
    return time_joins.asof_join(
        events, orders, ["user_id"], "event_at", "at",
        {"o_orderkey": "o_orderkey", "o_totalprice": "o_totalprice", "order_at": "at"}, 90 * DAY, ["o_orderkey"],
    )


@query(
    "p2_asof_state",
    """with s as (select user_id, ts, max(event_id) as event_id, max_by(event_type, event_id) as state from events
            where event_type in ('signup', 'purchase', 'error') group by user_id, ts)
       select e.event_id, e.user_id, s.state, s.event_id as state_event from events e
       asof left join s on e.user_id = s.user_id and e.ts > s.ts""",
)
def p2_asof_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state that each job was in just before each of its events."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", time_joins.micros(F.col("ts")).alias("at"))
    states = events.where(F.col("event_type").isin("signup", "purchase", "error"))
    found = time_joins.asof_join(
        events, states, ["user_id"], "at", "at", {"state": "event_type", "state_event": "event_id"}, 2 * DAY,
        ["event_id"], inclusive=False,
    )
    return found.select("event_id", "user_id", "state", "state_event")


# An order is open for 1 to 60 days; those of one group of ten customers are compared.
_OPEN_SQL = f"""o as (select o_orderkey, o_custkey // 10 as team, epoch_us(o_orderdate) as opened,
    epoch_us(o_orderdate) + (1 + o_orderkey % 60) * {DAY} as closed from orders)"""
_OVERLAP_SQL = f"""with {_OPEN_SQL} select a.o_orderkey, count(*) as open_orders, max(b.closed) as last_closed
    from o a join o b on a.team = b.team and a.opened < b.closed and b.opened < a.closed group by a.o_orderkey"""


def _open_orders(spark: SparkSession, folder: str) -> DataFrame:
    opened = time_joins.micros(F.col("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.expr("o_custkey div 10").alias("team"), opened.alias("opened"),
        (opened + (1 + F.col("o_orderkey") % 60) * F.lit(DAY)).alias("closed"),
    )


@query("p2_interval_overlap", _OVERLAP_SQL)
def p2_interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """For each order, how many of its team were open at some time with it, and when the last of them closed."""
    orders, span = _open_orders(spark, folder), ("opened", "closed")
    pairs = time_joins.overlap_join(orders, orders, ["team"], span, span, 30 * DAY)
    return pairs.groupBy(F.col("l.o_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("open_orders"), F.max("r.closed").alias("last_closed")
    )


@query(
    "p2_overlap_counts",
    f"""with {_OPEN_SQL} select a.o_orderkey, count(*) as open_orders
        from o a join o b on a.team = b.team and a.opened < b.closed and b.opened < a.closed group by a.o_orderkey""",
)
def p2_overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The same numbers from running counts, without pairs."""
    orders, span = _open_orders(spark, folder), ("opened", "closed")
    return time_joins.overlap_counts(orders, orders, ["team"], span, span, "open_orders", 180 * DAY).select(
        "o_orderkey", "open_orders"
    )


@query(
    "p4_sketches",
    """select event_type, count(*) as n, count(distinct user_id) as users, count(distinct event_id) as events,
        true as users_within, true as events_within, true as median_within, true as p90_within
       from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20' group by event_type""",
)
def p4_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches stored per day and merged for a range of days, held against the exact figures of the rows."""
    events, path, by = table(spark, folder, "events"), scratch(spark, "sketches"), ["event_type"]
    counted, first, last = ["user_id", "event_id"], "2024-01-05", "2024-01-20"
    sketches.store(sketches.daily(events, "ts", by, counted, ["value"]), path)
    some = sketches.stored(spark, path, first, last)
    found = sketches.merged(some, by, counted, {"value": [0.5, 0.9]})
    rows = events.where(F.to_date("ts").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    below = lambda k: F.count_if(F.col("value") < F.col("value_quantiles")[k])
    up_to = lambda k: F.count_if(F.col("value") <= F.col("value_quantiles")[k])
    exact = rows.join(found.drop("n"), by).groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("event_id").alias("events"),
        F.first("user_id_distinct").alias("user_estimate"), F.first("event_id_distinct").alias("event_estimate"),
        *[f(k).alias(f"{name}{k}") for k in (0, 1) for name, f in (("below", below), ("up_to", up_to))],
        F.count("value").alias("values"),
    )
    near = lambda estimate, n: F.abs(F.col(estimate) - F.col(n)) <= 1 + sketches.distinct_bound() * F.col(n)

    def ranked(k: int, q: float) -> Column:
        slack = 1 + sketches.rank_bound() * F.col("values")
        return (F.col(f"below{k}") <= q * F.col("values") + slack) & (F.col(f"up_to{k}") >= q * F.col("values") - slack)

    return exact.select(
        "event_type", "n", "users", "events", near("user_estimate", "users").alias("users_within"),
        near("event_estimate", "events").alias("events_within"), ranked(0, 0.5).alias("median_within"),
        ranked(1, 0.9).alias("p90_within"),
    )
