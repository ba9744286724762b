"""Exact dedup by a heavy-hitter split.

Frequent digests are found with Misra-Gries counters (freqItems, which keeps 1/support counters
per task and merges them), counted exactly, and the winner of each verified one is broadcast, so
that its copies are decided where they are read. All other digests use an ordinary shuffle, whose
largest group then holds no more than the share `support` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornpress.llm.common import WHITE, durable, table, text_of

SUPPORT = 1 / 2000


def frequent_winners(keyed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Of each digest held by more than the share `support` of the rows: its size and the row that stays.

    At most 1/support rows, whatever the input: every such digest is among the Misra-Gries
    counters, and the exact count drops the counters' false positives.
    """
    rows = keyed.count()
    candidates = keyed.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return (
        keyed.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("heavy_size"), F.min(F.struct("order", "rid", "doc_id")).alias("heavy"))
        .filter(F.col("heavy_size") > F.lit(support * rows))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; a null text is an empty one. The longest
    original text stays, then the smallest id (null ids last); of repeated rows with the same id
    and text one stays. Other columns of docs are not read. An empty table gives an empty result.
    """
    text = text_of(text_col)
    ident = F.col(id_col)
    keyed = durable(
        docs.select(
            ident.alias("doc_id"),
            F.struct((-F.length(text)).alias("shorter"), ident.isNull().alias("no_id"), ident.alias("id")).alias("order"),
            F.sha2(F.translate(text, WHITE, ""), 256).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    winners = durable(frequent_winners(keyed, support))
    split = keyed.join(F.broadcast(winners), "digest", "left")
    heavy = split.filter("heavy is not null").select(
        "doc_id",
        F.col("heavy.doc_id").alias("keep_id"),
        F.col("heavy_size").alias("group_size"),
        (F.col("rid") == F.col("heavy.rid")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
    group = Window.partitionBy("digest")
    best = F.min(F.struct("order", "rid", "doc_id")).over(group)
    light = (
        split.filter("heavy is null")
        .select("doc_id", "digest", "rid", F.count("*").over(group).alias("group_size"), best.alias("best"))
        .select(
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            "group_size",
            (F.col("rid") == F.col("best.rid")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )
    return heavy.unionByName(light)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, all columns, by the rule of exact_groups.

    Copies of a frequent text are dropped where they are read; the rest moves once, by digest. Texts
    of any length are compared whole; columns can have any name; an empty table gives an empty one.
    """
    text, ident = F.coalesce(F.col(f"rec.{text_col}").cast("string"), F.lit("")), F.col(f"rec.{id_col}")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")).select(
        "rec",
        F.struct((-F.length(text)).alias("shorter"), ident.isNull().alias("no_id"), ident.alias("id")).alias("order"),
        F.sha2(F.translate(text, WHITE, ""), 256).alias("digest"),
    )
    keyed = durable(packed.select("digest", "order", F.lit(0).alias("rid"), F.col("order.id").alias("doc_id")))
    winners = durable(frequent_winners(keyed, support).select("digest", F.col("heavy.order").alias("best")))
    left = packed.join(F.broadcast(winners), "digest", "left").filter(F.col("best").isNull() | F.col("order").eqNullSafe(F.col("best")))
    first = F.row_number().over(Window.partitionBy("digest").orderBy("order"))
    return left.select("rec", first.alias("nth")).filter("nth = 1").select("rec.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH keyed AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM keyed
"""
