"""Ranks and running sums over the whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def _range_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys`` with (_part, _pos), written out once.

    Range boundaries come from a sample; writing the result pins it, so the counts and the
    rows that are joined later agree even when tasks are re-run.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    position = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut_lineage(ordered.select("*", F.spark_partition_id().alias("_part"), position.alias("_pos")))


def global_rank(df: DataFrame, *, order_by: list[str], partition_by: list[str] | tuple = (),
                name: str = "rank") -> DataFrame:
    """0-based rank of every row in ``order_by`` order (within ``partition_by``).

    ``order_by`` has to identify a row for the rank to be reproducible. A group may span
    many range partitions, so a group with a third of all rows is ranked by many tasks.
    """
    by = list(partition_by)
    parts = _range_parts(df, by + list(order_by))
    stats = parts.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    # one row per (group, range partition)
    before = Window.partitionBy(*[f"_s_{c}" for c in by]).orderBy("_s_part").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("_part").alias("_s_part"), "_n", "_first")
    stats = stats.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    on = F.col("_part") == F.col("_s_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return parts.join(stats, on).withColumn(name, F.col("_offset") + F.col("_pos")).select(*df.columns, name)


def running_sums(df: DataFrame, *, order_by: list[str], sums: dict[str, Column],
                 partition_by: list[str] | tuple = ()) -> DataFrame:
    """Running sums in ``order_by`` order within ``partition_by``, ties in row order.

    Each range partition sums its own rows; the totals of the partitions before it (one
    row per group and partition) are added.
    """
    by = list(partition_by)
    names = {k: f"_v_{k}" for k in sums}
    parts = _range_parts(df.withColumns({names[k]: v for k, v in sums.items()}), by + list(order_by))
    local = Window.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumns({k: F.sum(names[k]).over(local) for k in sums})
    stats = parts.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in names.items()])
    before = Window.partitionBy(*[f"_s_{c}" for c in by]).orderBy("_s_part").rowsBetween(
        Window.unboundedPreceding, -1)
    stats = stats.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col("_part").alias("_s_part"),
                         *[f"_t_{k}" for k in sums])
    stats = stats.withColumns({f"_b_{k}": F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)) for k in sums})
    on = F.col("_part") == F.col("_s_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return rows.join(stats, on).select(*df.columns, *[(F.col(k) + F.col(f"_b_{k}")).alias(k) for k in sums])
