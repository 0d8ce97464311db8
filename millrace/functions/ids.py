"""Record ids that come out the same when a task is retried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """`prefix-` and the whole SHA-256 of the parts, each with its length before it and null as `-`.

    No two lists of parts give one text, so equal ids mean equal parts.
    """
    texts = [p.cast("string") for p in parts]
    told = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat(F.lit(f"{prefix}-"), F.sha2(F.concat(*told), 256))
