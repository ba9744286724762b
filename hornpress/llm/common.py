"""What the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: One word: a run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows with equal keys beyond which a key's rows are told apart by a number.
REPEATS = 1000
#: Tables of keys up to so many rows are broadcast.
BROADCAST_KEYS = 100_000


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def record(df: DataFrame) -> Column:
    """All columns of df, whatever their names, as one."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def schema(df: DataFrame, names: list[str], rest: str) -> StructType:
    """Columns of df, of any name and type, and others as DDL."""
    out = StructType([df.schema[n] for n in names])
    for field in StructType.fromDDL(rest).fields:
        out = out.add(field)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without it."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def lean() -> None:
    """In a Python worker: Arrow memory goes back to the system when it is freed, not to a pool."""
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spill_table(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: compressed, and partitioned by nothing."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.spilled_at = path
    return out


def forget(spilled: DataFrame) -> None:
    """Deletes what spill_table wrote; the frame is of no use afterwards."""
    jvm = spilled.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(spilled.spilled_at)
    at.getFileSystem(spilled.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def few(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """keys with a broadcast hint if they are at most so many."""
    return F.broadcast(keys) if keys.count() <= most else keys


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df and `nth`: 0, 1, ... among the rows with equal (non-null) keys.

    Rows are counted by key and task, so that no task holds all rows of a key. Which row of a key
    gets which number is arbitrary; the numbers are 0 to the key's rows less one in any run.
    """
    kept = durable(df.withColumn("task", F.spark_partition_id()))
    counts = kept.groupBy(key, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(key, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = kept.withColumn("local", F.row_number().over(Window.partitionBy(key, "task").orderBy("task")) - 1)
    return local.join(base, [key, "task"]).withColumn("nth", F.col("base") + F.col("local")).drop("task", "base", "local")


def told_apart(df: DataFrame, key: str, most: int) -> DataFrame:
    """df and `nth`, which tells rows apart whose key more than `most` rows have; 0 for all others."""
    hot = durable(df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(key))
    if not hot.count():
        return df.withColumn("nth", F.lit(0).cast("long"))
    hot = few(hot)
    return df.join(hot, key, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(numbered(df.join(hot, key, "left_semi"), key).withColumn("nth", F.col("nth").cast("long")))


def skew_join(left: DataFrame, right: DataFrame, key: str, degree: str, share: float = 1 / 2000) -> DataFrame:
    """left ⋈ right where right has one row per key and, in `degree`, how many rows of left have that key.

    Rows of keys that hold more than `share` of left meet their partner by broadcast (at most
    1/share rows); the rest shuffle.
    """
    total = right.agg(F.coalesce(F.sum(degree), F.lit(0))).first()[0]
    hot = right.filter(F.col(degree) > F.lit(share * total))
    cold = right.filter(F.col(degree) <= F.lit(share * total))
    keys = hot.select(key).withColumn("is_hot", F.lit(True))
    flagged = left.join(F.broadcast(keys), key, "left")
    by_shuffle = flagged.filter("is_hot is null").drop("is_hot").join(cold, key)
    by_broadcast = flagged.filter("is_hot").drop("is_hot").join(F.broadcast(hot), key)
    return by_shuffle.unionByName(by_broadcast)
