"""Shared relational building blocks that hold up under skewed keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """Add named columns that are worked out exactly once per row.

    A filter on a plain derived column is pushed below its projection and works the expression out again, for every
    time it is mentioned. A one-row generator keeps the filter above it.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def cut(df: DataFrame, folder: str) -> DataFrame:
    """Write an intermediate result that several later steps use and read it back, so it is worked out once and its
    lineage ends there; ``folder`` is on storage every executor can reach."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def first_items(items: Column, limit: int | None) -> Column:
    """The first ``limit`` items of an array, all of them when it is None."""
    return items if limit is None else F.slice(items, 1, limit)


def join_keyed(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", salts: int | None = None) -> DataFrame:
    """Equi-join of ``big`` with a side that is expected small.

    Without ``salts`` the join carries no hint: Spark picks it by bytes and splits skewed partitions at run time. With
    ``salts``, for keys known to be hot, the left rows are spread over that many buckets per key and the right side is
    repeated once per bucket.
    """
    on = list(on)
    if salts is None:
        return big.join(small, on, how)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if _hashable(big, c)]), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("map", "variant")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. The rank filter sits right on the window, so Spark keeps only ``k`` rows per key in
    every map task before the shuffle and a hot key stays cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def latest_by_key(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last change per key (keyed upsert). A partial ``max_by`` combines before the shuffle; where the order holds the whole
    row, its maximum is the row, and each column is sent once."""
    rest = [c for c in changes.columns if c not in keys]
    whole = set(rest) == set(order)
    last = F.max(F.struct(*order)) if whole else F.max_by(F.struct(*rest), F.struct(*order))
    picked = changes.groupBy(*keys).agg(last.alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*changes.columns)


def with_previous(
    df: DataFrame, keys: Sequence[str], seq: str, columns: dict[str, str], width: int = 1_000_000
) -> DataFrame:
    """Add the previous row's values per key in ``seq`` order (``columns``: source -> new name).

    ``seq`` is an integer that is unique within a key. Windows run over (key, seq / width) buckets, so no task sees
    more than ``width`` rows of a key; a second window over the bucket ends, ``width`` times smaller, links the
    buckets.
    """
    keys = list(keys)
    bucket = "_bucket"
    cut = df.withColumn(bucket, F.floor(F.col(seq) / F.lit(width)))
    inside = Window.partitionBy(*keys, bucket).orderBy(seq)
    packed = F.struct(*[F.col(c).alias(new) for c, new in columns.items()])
    ends = cut.groupBy(*keys, bucket).agg(F.max_by(packed, F.col(seq)).alias("_end"))
    chain = Window.partitionBy(*keys).orderBy(bucket) if keys else Window.orderBy(bucket)
    ends = ends.withColumn("_before", F.lag("_end").over(chain)).drop("_end")
    local = cut.withColumn("_local", F.lag(packed).over(inside)).withColumn("_n", F.row_number().over(inside))
    joined = _join_null_safe(local, ends, [*keys, bucket], "left")
    previous = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_local"))
    return joined.select(*df.columns, *[previous[new].alias(new) for new in columns.values()])


def with_position(
    df: DataFrame, keys: Sequence[str], seq: str, name: str = "position", width: int = 1_000_000
) -> DataFrame:
    """1-based position per key in ``seq`` order, computed over the same bounded buckets."""
    keys = list(keys)
    bucket = "_bucket"
    cut = df.withColumn(bucket, F.floor(F.col(seq) / F.lit(width)))
    counts = cut.groupBy(*keys, bucket).agg(F.count("*").alias("_count"))
    chain = Window.partitionBy(*keys) if keys else Window
    before = chain.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, bucket, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, bucket).orderBy(seq)
    return (
        cut.withColumn("_n", F.row_number().over(inside))
        .transform(_join_null_safe, counts, [*keys, bucket], "inner")
        .select(*df.columns, (F.col("_n") + F.col("_base")).alias(name))
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on keys of which null is a value like any other; the keys come from the left."""
    named = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(named, condition, how).drop(*[f"_r_{key}" for key in keys])


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    value = F.try_divide(part.cast("double"), whole.cast("double"))
    return value if digits is None else F.round(value, digits)
