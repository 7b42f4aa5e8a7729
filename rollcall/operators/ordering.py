"""Dense positions in a total order without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.session import ensure_checkpoint_dir


def with_position(df: DataFrame, order: list[Column | str], name: str, start: int = 1) -> DataFrame:
    """``df`` with the position of each row in ``order``, a two-level prefix sum.

    Rows are ranged over the tasks; a task counts its own rows, a prefix over
    the tasks' counts (one row each) says where it begins.  The ranged frame
    is written once, since both branches read its partition ids.  Rows equal
    in ``order`` follow each other in any order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumn("__order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]))
    ranged = keyed.repartitionByRange("__order").withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy("__order")
    # one row per task: small at any size of the input
    return (ranged.withColumn("__at", F.row_number().over(inside)).join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__before") + F.col("__at") + (start - 1)).select(*df.columns, name))


def count_up_to(records: DataFrame, marks: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``marks`` with the number of ``records`` of the same group (``by``, nulls are one value) that don't come after
    the mark in ``order``.  Groups are cut into chunks like rows above, so no group lies in one task."""
    ensure_checkpoint_dir(records.sparkSession)
    both = marks.select(*by, F.col(order), F.lit(1).alias("__kind"), F.struct(*marks.columns).alias("__mark")).unionByName(
        records.select(*by, F.col(order), F.lit(0).alias("__kind")), allowMissingColumns=True)
    one = (F.col("__kind") == 0).cast("bigint")
    ranged = both.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    chunks = ranged.groupBy(*by, "__part").agg(F.sum(one).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__part").orderBy(order, "__kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = ranged.withColumn("__so_far", F.sum(one).over(inside)).filter("__kind = 1").alias("m")
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return counted.join(before.alias("b"), [*same, F.col("m.__part") == F.col("b.__part")]).select(
        "m.__mark.*", (F.col("__before") + F.col("__so_far")).alias(name))
