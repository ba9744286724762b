"""Multisets as (value, cnt) tables, and similarity of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def multiset(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("cnt"))


def union(one: DataFrame, other: DataFrame) -> DataFrame:
    """The larger count of each value."""
    both = one.unionByName(other)
    return both.groupBy("value").agg(F.max("cnt").alias("cnt"))


def intersection(one: DataFrame, other: DataFrame) -> DataFrame:
    """The smaller count of each value that both have."""
    return one.join(other.withColumnRenamed("cnt", "other_cnt"), "value").select("value", F.least("cnt", "other_cnt").alias("cnt"))


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    left = one.join(other.withColumnRenamed("cnt", "other_cnt"), "value", "left")
    return left.select("value", (F.col("cnt") - F.coalesce("other_cnt", F.lit(0))).alias("cnt")).filter("cnt > 0")


def add(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("value").agg(F.sum("cnt").alias("cnt"))


def sizes(bag: DataFrame) -> DataFrame:
    """One row: size (with repeats) and different values."""
    return bag.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("size"), F.count("*").alias("different"))


def item_count(bag: DataFrame, value: object) -> int:
    row = bag.filter(F.col("value") == value).agg(F.sum("cnt")).first()
    return row[0] or 0


def is_subset(one: DataFrame, other: DataFrame) -> bool:
    return difference(one, other).isEmpty()


def above_share(bag: DataFrame, share: float) -> DataFrame:
    """Values whose count is over the whole part of size * share."""
    least = bag.agg(F.floor(F.sum("cnt") * F.lit(share)).alias("least"))
    return bag.crossJoin(F.broadcast(least)).filter(F.col("cnt") > F.col("least")).drop("least")


def jaccard(one: DataFrame, other: DataFrame) -> float:
    """Sum of smaller counts over sum of larger counts; 0 for empty multisets."""
    low = intersection(one, other).agg(F.sum("cnt")).first()[0] or 0
    high = union(one, other).agg(F.sum("cnt")).first()[0] or 0
    return low / high if high else 0.0


def _pairs(colvals: DataFrame) -> DataFrame:
    left = colvals.select(F.col("rel").alias("rel_i"), F.col("col").alias("col_i"), "val", F.col("cnt").alias("cnt_i"))
    right = colvals.select(F.col("rel").alias("rel_j"), F.col("col").alias("col_j"), "val", F.col("cnt").alias("cnt_j"))
    return left.join(right, "val").filter((F.col("rel_i") != F.col("rel_j")) | (F.col("col_i") != F.col("col_j")))


def _rows(colvals: DataFrame, suffix: str) -> DataFrame:
    return colvals.groupBy(F.col("rel").alias(f"rel_{suffix}"), F.col("col").alias(f"col_{suffix}")).agg(F.sum("cnt").alias(f"rows_{suffix}"))


def jaccard_pairs(colvals: DataFrame) -> DataFrame:
    """(rel_i, col_i, rel_j, col_j, jaccard) of every two columns that share a value, from (rel, col, val, cnt).

    The join is on values: its rows are, for each value, pairs of columns, never pairs of rows.
    """
    pairs = _pairs(colvals).filter(F.struct("rel_i", "col_i") < F.struct("rel_j", "col_j"))
    low = pairs.groupBy("rel_i", "col_i", "rel_j", "col_j").agg(F.sum(F.least("cnt_i", "cnt_j")).alias("low"))
    sized = low.join(_rows(colvals, "i"), ["rel_i", "col_i"]).join(_rows(colvals, "j"), ["rel_j", "col_j"])
    return sized.select("rel_i", "col_i", "rel_j", "col_j", (F.col("low") / (F.col("rows_i") + F.col("rows_j") - F.col("low"))).alias("jaccard"))


def column_similarity(colvals: DataFrame) -> DataFrame:
    """(rel_i, col_i, rel_j, col_j, sim): the share of column i's rows whose value is in column j."""
    held = _pairs(colvals).groupBy("rel_i", "col_i", "rel_j", "col_j").agg(F.sum("cnt_i").alias("held"))
    return held.join(_rows(colvals, "i"), ["rel_i", "col_i"]).select("rel_i", "col_i", "rel_j", "col_j", (F.col("held") / F.col("rows_i")).alias("sim"))


def similar_columns(colvals: DataFrame, threshold: float) -> DataFrame:
    return column_similarity(colvals).filter(F.col("sim") >= threshold)
