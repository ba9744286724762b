"""Sharding by a two-pass external shuffle.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash of the record;
pass two shuffles each bucket (Spark's shuffle() is Fisher-Yates) and writes it. Laid end to end
the buckets are a random order of all records; records are dealt to shards by their place in it,
so shard sizes differ by one row at most (the law `rows`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from hornpress.llm.common import REPEATS, durable, record, table, text_of, told_apart

BUCKET_BYTES = 16 << 20
#: Tasks that buckets are dealt to, at most.
TASKS = 20_000
#: Bucket counts are summed in two steps, so that no task orders all buckets.
RUN = 4096


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def record_hash(df: DataFrame, seed: int) -> Column:
    """Of all columns; maps, which have no hash, as JSON text."""
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def bucket_offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket, from (bucket, n)."""
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    before_run = (
        runs.groupBy("run").agg(F.sum("n").alias("run_n"))
        .withColumn("base", F.coalesce(F.sum("run_n").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("run", "base")
    )
    inside = F.sum("n").over(Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before_run, "run").select("bucket", (F.col("base") + F.col("inside")).alias("offset"))


def external_shuffle(df: DataFrame, shards: int, size: Column, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's rows, all columns, as (rec struct, shard int, slot long).

    The same rows, seed and bucket size give the same shards, however the table is partitioned:
    buckets follow from the records, a bucket is ordered by its records' hashes before it is
    shuffled, and the generator of a task is drawn on by its buckets in order. Nulls are values like
    any other. Records that are equal in all share a bucket, unless they are over REPEATS: then they
    are numbered and scattered too. Columns can have any name and type; an empty table gives an
    empty result. A bucket is one row in pass two: a record must be under some 500 MB.
    """
    keys = durable(df.select(record_hash(df, seed).alias("h"), size.cast("long").alias("size")))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()["total"]
    buckets = max(8, -(-int(total) // bucket_bytes))
    bucket = F.pmod(F.when(F.col("nth") > 0, F.xxhash64("h", "nth")).otherwise(F.col("h")), F.lit(buckets)).cast("long").alias("bucket")
    offsets = bucket_offsets(told_apart(keys, "h", REPEATS).select(bucket).groupBy("bucket").agg(F.count("*").alias("n")))
    records = told_apart(df.select(record_hash(df, seed).alias("h"), record(df).alias("rec")), "h", REPEATS)
    order = lambda a, b: F.when(a["h"] != b["h"], F.when(a["h"] < b["h"], -1).otherwise(1)).when(a["nth"] < b["nth"], -1).when(a["nth"] > b["nth"], 1).otherwise(0)
    gathered = (
        records.select(bucket, "h", "nth", "rec")
        .repartition(min(buckets, TASKS), "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("h", "nth", "rec")).alias("recs"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle(F.array_sort("recs", order), F.lit(seed)).alias("recs"))
    )
    place = F.col("offset") + F.col("pos")
    return (
        gathered.join(offsets.hint("shuffle_hash"), "bucket")
        .select("offset", F.posexplode("recs").alias("pos", "item"))
        .select(F.col("item.rec").alias("rec"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).cast("long").alias("slot"))
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder for each shard; each task writes its bucket's part of a shard in slot order."""
    shuffled.sortWithinPartitions("shard", "slot").select("shard", "slot", "rec.*").write.mode("overwrite").partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = (F.octet_length(text_of()) + 1).cast("long")
    text = F.coalesce(F.col("rec.text"), F.lit(""))
    return external_shuffle(docs, 8, size).select(
        F.col("rec.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
