"""Integer tables: columns a0, a1, ... without nulls, rows distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornpress.operators.numeration import ranked, running


def arity(t: DataFrame) -> int:
    return len(t.columns)


def names(k: int) -> list[str]:
    return [f"a{i}" for i in range(k)]


def as_table(df: DataFrame) -> DataFrame:
    """Columns renamed by place; rows with a null go, since 0 and null are never constants."""
    t = df.toDF(*names(len(df.columns)))
    return t.select(*[F.col(c).cast("int").alias(c) for c in t.columns]).dropna().distinct()


# --- lookup ------------------------------------------------------------------------------------


def slice_(t: DataFrame, col: int, value: int) -> DataFrame:
    return t.filter(F.col(f"a{col}") == value)


def members(rows: DataFrame, t: DataFrame) -> DataFrame:
    """rows that are in t."""
    return rows.join(t, t.columns, "left_semi")


def absent(rows: DataFrame, t: DataFrame) -> DataFrame:
    """rows that are not in t."""
    return rows.join(t, t.columns, "left_anti")


def ordinals(t: DataFrame) -> DataFrame:
    """Each row's place in lexicographic order (from 0)."""
    placed = ranked(t.withColumn("row", F.struct(*t.columns)), "row", "ordinal", start=0)
    return placed.select(*t.columns, F.col("ordinal").cast("long").alias("ordinal"))


def ith(t: DataFrame, i: int) -> DataFrame:
    """The row at a place."""
    return ordinals(t).filter(F.col("ordinal") == i).drop("ordinal")


def split_by(t: DataFrame, col: int) -> DataFrame:
    """A row for each value of a column, with its number of rows; slices are filters on the value."""
    return t.groupBy(F.col(f"a{col}").alias("value")).agg(F.count("*").alias("rows"))


def slices(t: DataFrame, col: int) -> DataFrame:
    """Every row beside the slice that it is in: (part, value, a0, ...), parts numbered from 0 by rising value.

    Parts aren't gathered: a slice of any size stays spread over tasks.
    """
    part = ranked(distinct_values(t, col), "value", "part", start=0)
    return t.join(part, t[f"a{col}"] == part["value"]).select("part", "value", *t.columns)


def equal_in_row(t: DataFrame, *cols: int) -> DataFrame:
    """Rows whose given columns are equal."""
    first, *rest = (F.col(f"a{c}") for c in cols)
    return t.filter(reduce(lambda x, y: x & y, (first == r for r in rest), F.lit(True)))


def distinct_values(t: DataFrame, col: int) -> DataFrame:
    return t.select(F.col(f"a{col}").alias("value")).distinct()


def column_stats(t: DataFrame) -> DataFrame:
    """(col, ndv, low, high, rows) of every column, in one pass."""
    cells = t.select(F.posexplode(F.array(*t.columns)).alias("col", "val")).groupBy("col", "val").agg(F.count("*").alias("n"))
    return cells.groupBy("col").agg(F.count("*").alias("ndv"), F.min("val").alias("low"), F.max("val").alias("high"), F.sum("n").alias("rows"))


def insert_places(t: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of other with the place at which each would be inserted into t."""
    row = F.struct(*t.columns).alias("row")
    both = t.select(row, F.lit(1).alias("own")).unionByName(other.select(*t.columns).select(row, F.lit(0).alias("own")))
    return running(both, "row", "own", "place").filter("own = 0").select("row.*", "place")


def frequent_values(t: DataFrame, share: float) -> DataFrame:
    """(col, val, cnt) of values in at least ceil(rows * share) rows of their column."""
    cells = t.select(F.posexplode(F.array(*t.columns)).alias("col", "val")).groupBy("col", "val").agg(F.count("*").alias("cnt"))
    least = cells.groupBy("col").agg(F.ceil(F.sum("cnt") * F.lit(share)).alias("least"))
    return cells.join(F.broadcast(least), "col").filter("cnt >= least").drop("least")


def constants_of(t: DataFrame) -> DataFrame:
    return t.select(F.explode(F.array(*t.columns)).alias("value")).distinct()


# --- joins -------------------------------------------------------------------------------------


def prefixed(t: DataFrame, p: str) -> DataFrame:
    return t.toDF(*[f"{p}{c}" for c in t.columns])


def equi_join(t1: DataFrame, c1: int, t2: DataFrame, c2: int) -> DataFrame:
    """All pairs of rows with equal values, columns l_a* and r_a*."""
    left, right = prefixed(t1, "l_"), prefixed(t2, "r_")
    return left.join(right, left[f"l_a{c1}"] == right[f"r_a{c2}"])


def match_groups(t1: DataFrame, c1: int, t2: DataFrame, c2: int) -> DataFrame:
    """(value, rows1, rows2) of the values that both columns have, without listing pairs."""
    one = split_by(t1, c1).withColumnRenamed("rows", "rows1")
    return one.join(split_by(t2, c2).withColumnRenamed("rows", "rows2"), "value")


def common_values(*columns: tuple[DataFrame, int]) -> DataFrame:
    """Values that every given (table, column) has."""
    return reduce(lambda x, y: x.join(y, "value", "left_semi"), (distinct_values(t, c) for t, c in columns))


def project_join(t1: DataFrame, c1: int, out1: list[int], t2: DataFrame, c2: int, out2: list[int]) -> DataFrame:
    """Distinct chosen columns of the equi-join; each side is reduced to them before it is joined."""
    left = prefixed(t1, "l_").select(f"l_a{c1}", *[f"l_a{c}" for c in out1 if c != c1]).distinct()
    right = prefixed(t2, "r_").select(f"r_a{c2}", *[f"r_a{c}" for c in out2 if c != c2]).distinct()
    joined = left.join(right, left[f"l_a{c1}"] == right[f"r_a{c2}"])
    return joined.select(*[F.col(f"l_a{c}") for c in out1], *[F.col(f"r_a{c}") for c in out2]).distinct().toDF(*names(len(out1) + len(out2)))


# --- projections and sets ----------------------------------------------------------------------


def swapped(t: DataFrame) -> DataFrame:
    return t.select(F.col("a1").alias("a0"), F.col("a0").alias("a1"))


def column(t: DataFrame, col: int) -> DataFrame:
    return t.select(F.col(f"a{col}").alias("a0")).distinct()


def union_of(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()


def intersection(t: DataFrame, other: DataFrame) -> DataFrame:
    return t.intersect(other.select(*t.columns))


def same_rows(t: DataFrame, other: DataFrame) -> bool:
    """Equal as sets of rows."""
    return t.columns == other.columns and t.exceptAll(other).isEmpty() and other.exceptAll(t).isEmpty()


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, cols, F.lit(True))
