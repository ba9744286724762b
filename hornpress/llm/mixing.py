"""Mixing sources to target weights.

Sizes are summed for each source; a source's target over its size is its repetition rate. Each
document is taken floor(rate) times plus one more copy by a Bernoulli draw with the fraction as
probability. Draws come from a hash of the row: its id, its text's digest and, among rows that are
equal in these and the source, a number. So reruns agree, and rows with equal or no ids draw apart;
of DRAWS independent seeds each source uses the one whose taken size comes nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornpress.llm.common import WORD, durable, record, table, text_of, told_apart

CAP = 3
CYCLE = (1, 2, 3)
SEED = "mix-1"
DRAWS = 64
#: Draws of 8 hex digits that a hash holds.
HELD = 8
#: Plans of more sources than this are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def hashed(block: Column, ident: str = "doc_id", seed: str = SEED) -> Column:
    """64 hex digits of a row (its id, digest and nth): HELD draws."""
    row = F.concat_ws(":", F.lit(seed), block.cast("string"), F.coalesce(F.col(ident).cast("string"), F.lit("")), "digest", F.col("nth").cast("string"))
    return F.sha2(row, 256)


def uniform(hexed: Column, draw: Column) -> Column:
    """The draw, from the hash of its block, as a number from 0 to 1."""
    return F.conv(F.substring(hexed, F.pmod(draw, F.lit(HELD)) * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(2.0**32)


def source_targets(sized: DataFrame) -> DataFrame:
    """From (source, size): source, source_size, target, times, part.

    Sources in code-point order (null last) weigh CYCLE in turn and share the sum of all sizes. No
    target is above CAP times its source's size: by rising size over weight, a source is full while
    an equal share of what is left would overfill it; the others divide the rest by weight. The
    windows run over one row for each source in one task, which sorts and spills: some ten million
    sources.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name)
    weighed = sums.select("source", "source_size", rank.alias("rank"), F.element_at(F.array(*map(F.lit, CYCLE)), F.pmod(rank - 1, F.lit(len(CYCLE))) + 1).cast("long").alias("weight"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * CAP).over(before), F.lit(0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = weighed.select("*", left.alias("left"), left_weight.alias("left_weight"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731 - products of sums need more than 64 bits
    full = (wide("source_size") * wide("left_weight")).cast("decimal(38,0)") * CAP <= (wide("left") * wide("weight")).cast("decimal(38,0)")
    first = F.min(F.when(~full, F.struct((-F.col("left_weight")).alias("order"), "left", "left_weight"))).over(every)
    target = F.when(full, (F.col("source_size") * CAP).cast("double")).otherwise((F.col("weight") * F.col("first.left")).cast("double") / F.col("first.left_weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        filled.select("source", "source_size", "weight", "left", "left_weight", first.alias("first"))
        .select("source", "source_size", target.alias("target"))
        .select("source", "source_size", "target", F.floor(rate).cast("long").alias("times"), (rate - F.floor(rate)).alias("part"))
    )


def _with_plan(df: DataFrame, plan: DataFrame, sources: int, source: Column) -> DataFrame:
    plan = plan.withColumnRenamed("source", "plan_source")
    return df.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, source.eqNullSafe(F.col("plan_source"))).drop("plan_source")


def mixing_plan(sized: DataFrame) -> tuple[DataFrame, int]:
    """(source, source_size, target, times, part, draw) and the number of sources, from (doc_id, source, size, digest, nth)."""
    targets = durable(source_targets(sized))
    sources = targets.count()
    hexes = [hashed(F.lit(b)).alias(f"hex{b}") for b in range(DRAWS // HELD)]
    drawn = _with_plan(sized.select("source", "size", *hexes), targets, sources, F.col("source"))
    taken = [F.sum(F.col("size") * (F.col("times") + (uniform(F.col(f"hex{j // HELD}"), F.lit(j)) < F.col("part")).cast("long"))) for j in range(DRAWS)]
    sums = drawn.groupBy("source", "source_size", "target", "times", "part").agg(F.array(*taken).alias("taken"))
    off = F.transform("taken", lambda x, j: F.struct(F.abs(x - F.col("target")).alias("off"), j.alias("draw")))
    plan = sums.select("source", "source_size", "target", "times", "part", F.array_min(off)["draw"].alias("draw"))
    return durable(plan), sources


def copies_of(ident: str = "doc_id") -> Column:
    """Beside the plan's columns: how often a row is taken."""
    return F.col("times") + (uniform(hashed(F.floor(F.col("draw") / HELD), ident), F.col("draw")) < F.col("part")).cast("long")


def row_key(ident: Column, source: Column, digest: Column) -> Column:
    """Of rows that draw alike unless they are numbered."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (ident, source)]
    return F.concat_ws(":", *[F.length(p).cast("string") for p in parts], *parts, ident.isNull().cast("string"), source.isNull().cast("string"), digest)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, digest, nth)."""
    text = text_of()
    sized = durable(docs.select("doc_id", F.col("source"), words(text).alias("size"), digest(text).alias("digest")))
    keyed = sized.withColumn("key", F.xxhash64(row_key(F.col("doc_id"), F.col("source"), F.col("digest"))))
    return durable(told_apart(keyed, "key", 1).drop("key"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (not at all, if never); the same columns.

    A null text has size 0; a null source is a source; rows with equal or null ids draw apart, also
    rows that are equal in all. Extra columns of any name pass through; an empty table gives an empty one.
    """
    plan, sources = mixing_plan(sizes(docs))
    text = F.coalesce(F.col("rec").getField("text").cast("string"), F.lit(""))
    rec = docs.select(record(docs).alias("rec")).withColumn("digest", digest(text))
    keyed = rec.withColumn("key", F.xxhash64(row_key(F.col("rec.doc_id"), F.col("rec.source"), F.col("digest"))))
    told = told_apart(keyed, "key", 1)
    taken = _with_plan(told, plan, sources, F.col("rec.source")).withColumn("copies", copies_of("rec.doc_id"))
    return taken.filter("copies > 0").select("rec", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("rec.*")


def mix_counts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    A null or empty text has size 0 and takes nothing. Null and repeated ids, a null source and rows
    that are equal in all are rows like any other; other columns are not read; an empty table gives
    an empty result.
    """
    sized = sizes(docs)
    plan, sources = mixing_plan(sized)
    out = _with_plan(sized, plan, sources, F.col("source")).withColumn("copies", copies_of())
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, sha256(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS nth
  FROM documents),
weighed AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER w, 0))::BIGINT AS rest,
         (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS rest_weight
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (SELECT *, source_size * 3 * rest_weight <= rest * weight AS is_full FROM filled),
opened AS (SELECT rest, rest_weight FROM judged WHERE NOT is_full ORDER BY rest_weight DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN (source_size * 3)::DOUBLE
         ELSE (weight * (SELECT rest FROM opened))::DOUBLE / (SELECT rest_weight FROM opened) END AS target
  FROM judged),
rates AS (
  SELECT *, floor(rate)::BIGINT AS times, rate - floor(rate) AS part
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets)),
draws AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, d.draw,
         r.times + (('0x' || substr(sha256('mix-1:' || (d.draw // 8)::VARCHAR || ':' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.digest || ':' || s.nth::VARCHAR), d.draw % 8 * 8 + 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < r.part)::BIGINT AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(64))::INT AS draw) d),
chosen AS (
  SELECT source, draw FROM (
    SELECT source, draw, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies)::DOUBLE - any_value(target)), draw) AS nth
    FROM draws GROUP BY source, draw) WHERE nth = 1)
SELECT d.doc_id, d.size, d.source_size, d.target, d.copies, d.size * d.copies AS taken
FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.draw = c.draw
"""
