"""As-of joins: each row meets the last row of another table at or before its own time.

Both tables are merged in time order per key. Windows run over (key, time bucket), so a hot key is spread over as many tasks
as it has buckets; the last row of each bucket is carried into the next ones by a second window over bucket ends, smaller by
the rows that a bucket holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eviflow.operators.common import _join_null_safe


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, columns: list[str], width: int = 86_400) -> DataFrame:
    """``left`` with ``columns`` of the last ``right`` row of the same keys whose ``since`` is not after ``at``.

    Rows without such a row get nulls. Of right rows with the same keys and ``since`` the greatest in ``columns`` counts; a
    null key equals a null key, a null time meets nothing. ``width`` is a bucket's length in seconds: one that holds some
    hundred thousand rows of the hottest key is right.
    """
    seconds = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1_000_000 * width))
    named = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(columns)])
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    asked = left.select(*keys, F.col(at).alias("_at"), seconds(at).alias("_bucket"), F.lit(1).alias("_side"), row.alias("_row"))
    given = right.filter(F.col(since).isNotNull()).select(*keys, F.col(since).alias("_at"), seconds(since).alias("_bucket"), F.lit(0).alias("_side"), F.struct(named.alias("v")).alias("_value"))
    both = asked.unionByName(given, allowMissingColumns=True)
    order = [F.col("_at").asc(), F.col("_side").asc(), F.col("_value").asc()]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("_last", F.last("_value", ignorenulls=True).over(inside)).filter(F.col("_side") == 1)
    ends = given.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct("_at", "_value")).alias("_end"))
    # Every bucket that is asked for gets the end of the last bucket before it.
    places = asked.select(*keys, "_bucket").distinct().unionByName(ends, allowMissingColumns=True).groupBy(*keys, "_bucket").agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    met = _join_null_safe(local, carried, [*keys, "_bucket"], "left")
    value = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "_before"))
    return met.withColumn("_found", value).select("_row.*", *[F.col(f"_found.v.v{i}").alias(c) for i, c in enumerate(columns)])


def rules_in_force(cases: DataFrame, versions: DataFrame, width: int = 86_400) -> DataFrame:
    """Cases (case_id, ruleset_id, assessed_at) with the version of their ruleset that was in force at the time.

    ``versions (ruleset_id, version, valid_from)``: a version counts until the next one begins.
    """
    return as_of_join(cases, versions, ["ruleset_id"], "assessed_at", "valid_from", ["version", "valid_from"], width)
