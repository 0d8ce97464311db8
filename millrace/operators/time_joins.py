"""Joins along time: the latest earlier row, running counts, and intervals that overlap.

Times are whole numbers of any unit (`micros` makes them of timestamps). As-of joins and counts union both
sides and run one window per key and slab of time, so a key with a third of all rows is spread over its
slabs. What earlier slabs leave behind is one row per key and slab, carried forward by a second, small
window. Intervals meet in time bins: an interval lies in the bins of a level as coarse as it is
long, at most `SPAN` of them unless it is longer than the coarsest, so long ones are not cut into many pieces.
No join here compares rows of other keys, slabs or bins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins that an interval of its level touches at most.
SPAN = 2
FACTOR, LEVELS = 8, 8


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp, one without zone taken as the session's."""
    return F.unix_micros(time.cast("timestamp"))


def _keys(on: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").alias(f"_k{n}") for n, c in enumerate(on)]


def _known(frame: DataFrame, columns: Sequence[str]) -> Column:
    """Whether none of the columns is null."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out


def _laid_out(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, slab: int, inclusive: bool,
    payload: Column, ties: Sequence[str],
) -> DataFrame:
    """Both sides as rows `_k…, _slab, _time, _side, _tie, _row, _payload`; only right rows have a payload."""
    if slab < 1:
        raise ValueError("slab must be at least 1")
    first, second = (1, 0) if inclusive else (0, 1)
    tie = F.struct(*[F.col(f"`{c}`") for c in ties]) if ties else F.struct(F.lit(0).alias("none"))
    given = left.where(_known(left, [*on, left_time]))
    shown = given.select(
        *_keys(on), F.col(f"`{left_time}`").cast("long").alias("_time"), F.lit(first).alias("_side"),
        F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"),
    )
    met = right.where(_known(right, [*on, right_time])).select(
        *_keys(on), F.col(f"`{right_time}`").cast("long").alias("_time"), F.lit(second).alias("_side"),
        tie.alias("_tie"), payload.alias("_payload"),
    )
    both = shown.unionByName(met, allowMissingColumns=True)
    return both.withColumn("_slab", F.floor(F.col("_time") / F.lit(slab)))


def _rows(left: DataFrame, swept: DataFrame, on: Sequence[str], left_time: str, values: Mapping[str, Column], none: Mapping[str, Column]) -> DataFrame:
    """The left rows with new columns; rows with a null key or time come back with `none`."""
    clash = {c.lower() for c in left.columns} & {c.lower() for c in values}
    if clash:
        raise ValueError(f"left already has the columns {sorted(clash)}")
    found = swept.where("_row is not null").select("_row.*", *[v.alias(n) for n, v in values.items()])
    rest = left.where(~_known(left, [*on, left_time]))
    return found.unionByName(rest.select("*", *[v.alias(n) for n, v in none.items()]))


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str,
    columns: Mapping[str, str], slab: int, ties: Sequence[str] = (), inclusive: bool = True,
) -> DataFrame:
    """Every row of `left` with `columns` (new name -> column of `right`) of the latest right row of its keys.

    A right row counts if its time is at most the left one's, or below it unless `inclusive`. Of right rows of one
    time the one with the highest `ties` counts. Rows without a match, or with a null key or time, get nulls;
    right rows with a null key or time match nothing. `slab` is the length of a slab in the unit of the times: it
    changes only how the work is spread.
    """
    payload = F.struct(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])
    both = _laid_out(left, right, on, left_time, right_time, slab, inclusive, payload, ties)
    keys = [f"_k{n}" for n in range(len(on))]
    along = Window.partitionBy(*keys, "_slab").orderBy("_time", "_side", "_tie")
    inside = F.last("_payload", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    newest = F.max_by("_payload", F.when(F.col("_payload").isNotNull(), F.struct("_time", "_tie")))
    slabs = both.groupBy(*keys, "_slab").agg(newest.alias("_newest"))
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = slabs.select(*keys, "_slab", F.last("_newest", ignorenulls=True).over(before).alias("_carried"))
    swept = both.withColumn("_inside", inside).where("_row is not null").join(carried, [*keys, "_slab"])
    best = F.coalesce("_inside", "_carried")
    kinds = {n: right.schema[c].dataType for n, c in columns.items()}
    none = {n: F.lit(None).cast(kind) for n, kind in kinds.items()}
    return _rows(left, swept, on, left_time, {n: best.getField(n) for n in columns}, none)


def count_before(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, name: str, slab: int,
    inclusive: bool = True,
) -> DataFrame:
    """Every row of `left` with the number of right rows of its keys up to its time; null for a null key or time."""
    both = _laid_out(left, right, on, left_time, right_time, slab, inclusive, F.lit(1), ())
    keys = [f"_k{n}" for n in range(len(on))]
    along = Window.partitionBy(*keys, "_slab").orderBy("_time", "_side")
    inside = F.count("_payload").over(along.rowsBetween(Window.unboundedPreceding, 0))
    slabs = both.groupBy(*keys, "_slab").agg(F.count("_payload").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = slabs.select(*keys, "_slab", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    swept = both.withColumn("_inside", inside).where("_row is not null").join(carried, [*keys, "_slab"])
    none = {name: F.lit(None).cast("long")}
    return _rows(left, swept, on, left_time, {name: F.col("_inside") + F.col("_carried")}, none)


def overlap_counts(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    name: str, slab: int,
) -> DataFrame:
    """Every row of `left` with the number of right intervals of its keys that overlap its own, without any pairs.

    Intervals hold their start and not their end. Those that began before a row's end, less those that ended
    by its start, are the ones that overlap. Empty and backward intervals and such with a null overlap nothing.
    """
    sound = lambda frame, span: _known(frame, span) & (F.col(f"`{span[0]}`") < F.col(f"`{span[1]}`"))
    held = right.where(sound(right, right_span))
    begun = count_before(left, held, on, left_span[1], right_span[0], "_begun", slab, inclusive=False)
    both = count_before(begun, held, on, left_span[0], right_span[1], "_ended", slab)
    found = F.when(sound(left, left_span) & _known(left, on), F.col("_begun") - F.col("_ended")).otherwise(0)
    return both.withColumn(name, found).drop("_begun", "_ended")


def _size(level: Column, width: int) -> Column:
    """The width of a level's bins."""
    return F.element_at(F.array(*[F.lit(width * FACTOR**n).cast("long") for n in range(LEVELS)]), level + 1)


def _spans(frame: DataFrame, span: tuple[str, str], mark: str) -> tuple[Column, Column]:
    """Start and end of an interval, of the columns that `_levelled` gives."""
    start, end = (F.col(f"{mark}{frame.columns.index(c)}").cast("long") for c in span)
    return start, end


def _levelled(frame: DataFrame, on: Sequence[str], span: tuple[str, str], width: int, mark: str) -> DataFrame:
    """The sound rows of `frame`, its columns as `<mark>0, <mark>1, …`, so that those nobody asks for are not
    shuffled; `<mark>_own` tells the level that fits a row's length."""
    start, end = (F.col(f"`{c}`").cast("long") for c in span)
    level = sum((F.when(end - start > width * FACTOR**n, 1).otherwise(0) for n in range(LEVELS - 1)), F.lit(0))
    return frame.where(_known(frame, [*on, *span]) & (start < end)).select(
        *[F.col(f"`{c}`").alias(f"{mark}{n}") for n, c in enumerate(frame.columns)], level.alias(f"{mark}_own")
    )


def _binned(rows: DataFrame, start: Column, end: Column, width: int, mark: str) -> DataFrame:
    """Rows with a `<mark>_level` once for every bin that they touch there."""
    size = _size(F.col(f"{mark}_level"), width)
    bins = F.sequence(F.floor(start / size), F.floor((end - 1) / size))
    return rows.withColumn(f"{mark}_bin", F.explode(bins)).drop(f"{mark}_own")


def _lifted(rows: DataFrame, mark: str, met: DataFrame, other: str, least: int) -> DataFrame:
    """Rows once for every level of their own (`least` 0) or above it (1) that fits some row of the other side.

    Those levels are few rows, found before anything is shuffled: a level that fits nothing takes no copies.
    """
    used = F.broadcast(met.select(F.col(f"{other}_own").alias("_used")).distinct())
    levels = F.explode(F.expr(f"filter(sequence(0, {LEVELS - 1}), n -> n >= {mark}_own + {least})"))
    lifted = rows.withColumn(f"{mark}_level", levels)
    return lifted.join(used, F.col(f"{mark}_level") == F.col("_used"), "left_semi")


def overlap_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
    width: int,
) -> DataFrame:
    """`l, r`: one row for each pair of overlapping intervals of the same keys, both sides as structs.

    Intervals hold their start and not their end; empty and backward ones and such with a null key or end
    overlap nothing. `width` is that of the finest bins, in the unit of the times; each level is eight times
    coarser. A pair meets at the level of its longer interval and counts in the first bin that both have there.
    What is shuffled of a row is what is asked of the pairs, its keys and its ends.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    a, b = _levelled(left, on, left_span, width, "_l"), _levelled(right, on, right_span, width, "_r")
    (start, end), (begun, closed) = _spans(left, left_span, "_l"), _spans(right, right_span, "_r")
    first = F.col("_l_bin") == F.floor(F.greatest(start, begun) / _size(F.col("_l_level"), width))
    same = (F.col("_l_level") == F.col("_r_level")) & (F.col("_l_bin") == F.col("_r_bin"))
    for c in on:
        same = same & (F.col(f"_l{left.columns.index(c)}") == F.col(f"_r{right.columns.index(c)}"))
    meets = same & (start < closed) & (begun < end) & first
    pair = [
        F.struct(*[F.col(f"{mark}{n}").alias(c) for n, c in enumerate(frame.columns)]).alias(name)
        for frame, mark, name in ((left, "_l", "l"), (right, "_r", "r"))
    ]

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        # Never broadcast: Spark judges the rows by their number before they are laid into bins.
        found = _binned(others, begun, closed, width, "_r").hint("merge")
        return _binned(some, start, end, width, "_l").join(found, meets).select(*pair)

    # Two joins, so that intervals that are both finer than a level never meet there.
    fitting = met(a.withColumn("_l_level", F.col("_l_own")), _lifted(b, "_r", a, "_l", 0))
    finer = met(_lifted(a, "_l", b, "_r", 1), b.withColumn("_r_level", F.col("_r_own")))
    return fitting.unionByName(finer)
