"""Names and the whole numbers that stand for them, as a table (name, num); numbers start at 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornpress.operators.graph import checkpointed

SCHEMA = "name string, num int"
#: Tables of more names than this are joined by a shuffle.
BROADCAST_NAMES = 100_000


def ranked(df: DataFrame, key: str, out: str, start: int = 1) -> DataFrame:
    """df, whose keys differ, with each row's rank by key: rows are dealt out by ranges of the key and ranked within each."""
    dealt = checkpointed(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key))
    return dealt.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn(out, (F.col("before") + F.col("inside") + F.lit(start - 1)).cast("int")).drop("range", "inside", "before")


def running(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with the sum of `value` over all rows of smaller key: sums of ranges of the key, and a sum within each range."""
    dealt = checkpointed(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    ends = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("range").agg(F.sum(value).alias("total")).select("range", F.coalesce(F.sum("total").over(ends), F.lit(0)).alias("before"))
    inside = F.sum(value).over(Window.partitionBy("range").orderBy(key).rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum(value).over(Window.partitionBy("range", key))
    return dealt.withColumn("inside", inside).join(F.broadcast(sums), "range").withColumn(out, F.col("before") + F.col("inside")).drop("range", "inside", "before")


def nearest(df: DataFrame, key: str, mark: str, low: str, high: str) -> DataFrame:
    """df with the nearest marked key below and above each row (null where there is none), by ranges of the key."""
    dealt = checkpointed(df.repartitionByRange(key).withColumn("range", F.spark_partition_id()))
    own = F.when(F.col(mark), F.col(key))
    ends = dealt.groupBy("range").agg(F.max(own).alias("top"), F.min(own).alias("bottom"))
    carried = ends.select(
        "range",
        F.max("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
        F.min("bottom").over(Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)).alias("above"),
    )
    ordered = Window.partitionBy("range").orderBy(key)
    inside_low = F.max(own).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    inside_high = F.min(own).over(Window.partitionBy("range").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1))
    met = dealt.withColumn("in_low", inside_low).withColumn("in_high", inside_high).join(F.broadcast(carried), "range")
    return met.withColumn(low, F.coalesce("in_low", "below")).withColumn(high, F.coalesce("in_high", "above")).drop("range", "in_low", "in_high", "below", "above")


def numbered(names: DataFrame) -> DataFrame:
    """Distinct names, numbered from 1 in order."""
    return ranked(names.select("name").dropna().distinct(), "name", "num").select("name", "num")


def add_names(numeration: DataFrame, names: DataFrame) -> DataFrame:
    """New names take the smallest free numbers, in order; known names keep theirs."""
    fresh = ranked(names.select("name").dropna().distinct().join(numeration, "name", "left_anti"), "name", "rank")
    highest = numeration.agg(F.coalesce(F.max("num"), F.lit(0))).first()[0]
    wanted = fresh.count()
    free = numeration.sparkSession.range(1, highest + wanted + 1).select(F.col("id").cast("int").alias("num")).join(numeration, "num", "left_anti")
    places = ranked(free, "num", "rank").filter(F.col("rank") <= wanted)
    return numeration.select("name", "num").unionByName(fresh.join(places, "rank").select("name", "num"))


def remove_names(numeration: DataFrame, names: DataFrame) -> DataFrame:
    return numeration.join(names.select("name"), "name", "left_anti")


def remove_numbers(numeration: DataFrame, nums: DataFrame) -> DataFrame:
    return numeration.join(nums.select("num"), "num", "left_anti")


def compaction(numeration: DataFrame) -> DataFrame:
    """(old, new): the highest numbers move into the gaps below them, smallest gap to highest number."""
    highest, used = numeration.agg(F.coalesce(F.max("num"), F.lit(0)), F.count("*")).first()
    gaps = numeration.sparkSession.range(1, used + 1).select(F.col("id").cast("int").alias("new")).join(numeration.select(F.col("num").alias("new")), "new", "left_anti")
    moving = numeration.filter(F.col("num") > used).select(F.col("num").alias("old"), (-F.col("num")).alias("down"))
    return ranked(gaps, "new", "rank").join(ranked(moving, "down", "rank"), "rank").select("old", "new")


def renumbered(numeration: DataFrame, mapping: DataFrame) -> DataFrame:
    """Numbers replaced by (old, new); others stay."""
    moved = numeration.join(mapping, numeration["num"] == mapping["old"], "left")
    return moved.select("name", F.coalesce("new", "num").alias("num"))


def permuted(numeration: DataFrame, mapping: DataFrame) -> DataFrame:
    """As renumbered, but only if the mapping has as many rows as there are names."""
    return renumbered(numeration, mapping) if mapping.count() == numeration.count() else numeration


def _near(numeration: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(numeration) if (numeration.count() if size is None else size) <= BROADCAST_NAMES else numeration


def encode(df: DataFrame, numeration: DataFrame, size: int | None = None) -> DataFrame:
    """String columns to numbers; unknown names become 0. size: the number of names, if known."""
    cols, names = df.columns, _near(numeration, size)
    for c in cols:
        coded = names.select(F.col("name").alias(c), F.col("num").alias("coded"))
        df = df.join(coded, c, "left").select(*[F.coalesce("coded", F.lit(0)).alias(c) if k == c else k for k in cols])
    return df


def decode(df: DataFrame, numeration: DataFrame, size: int | None = None) -> DataFrame:
    """Numbers to names; unknown numbers become null."""
    cols, names = df.columns, _near(numeration, size)
    for c in cols:
        named = names.select(F.col("num").alias(c), F.col("name").alias("named"))
        df = df.join(named, c, "left").withColumn(c, F.col("named")).drop("named")
    return df.select(*cols)


def remap(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Every column through (old, new); other numbers stay."""
    cols = df.columns
    for c in cols:
        df = df.join(mapping.select(F.col("old").alias(c), F.col("new").alias("moved")), c, "left").withColumn(c, F.coalesce("moved", c)).drop("moved")
    return df.select(*cols)
