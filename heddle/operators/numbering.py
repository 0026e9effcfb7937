"""Consecutive numbers over an order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.session import write_stage


def with_ordinal(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """``df`` with a consecutive number in the given order, from ``start``.

    Rows are range-partitioned and sorted; each task numbers its own rows, and the tasks' counts (one row per task)
    give what is to be added. Rows that the order doesn't tell apart get numbers in no particular order.
    """
    keyed = df.select("*", *[c.alias(f"_o{k}") for k, c in enumerate(_plain(order))])
    sort = [_like(c, F.col(f"_o{k}")) for k, c in enumerate(order)]
    placed = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_place", F.monotonically_increasing_id()).drop(*[f"_o{k}" for k in range(len(order))])
    stage = write_stage(placed, "ordered")
    counts = stage.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("_n"))
    # one row per task; what comes before each is broadcast
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + start
    first = counts.select("_part", before.alias("_first"))
    placed = stage.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(first), "_part")
    return placed.withColumn(name, F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_part", "_first")


class Desc:
    """Marks a descending order column."""

    def __init__(self, column: Column):
        self.column = column


def _plain(order: list) -> list[Column]:
    return [c.column if isinstance(c, Desc) else c for c in order]


def _like(c, named: Column) -> Column:
    return named.desc() if isinstance(c, Desc) else named.asc()
