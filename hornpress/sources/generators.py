"""Synthetic bases, the same for the same arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.functions.draws import draw


def _u(salt: str, *cols: str):  # noqa: ANN202
    return F.pmod(F.xxhash64(F.lit(salt), *cols), F.lit(1_000_000)) / 1_000_000


def families(spark: SparkSession, count: int, error: float = 0.0, grandparents: bool = False) -> dict[str, DataFrame]:
    """Families of two parents, a son and a daughter, as tables of names; a share of the tuples gets a wrong last argument."""
    ids = spark.range(count).select(F.col("id").cast("string").alias("f"))
    name = lambda who: F.concat(F.lit(f"{who}_"), "f")
    kid = F.explode(F.array(F.lit("son"), F.lit("daughter"))).alias("k")
    kids = ids.select("f", kid)
    child = F.concat("k", F.lit("_"), "f")
    out = {
        "family": kids.select(name("dad").alias("a0"), name("mom").alias("a1"), child.alias("a2")),
        "father": kids.select(name("dad").alias("a0"), child.alias("a1")),
        "mother": kids.select(name("mom").alias("a0"), child.alias("a1")),
        "child": kids.select(child.alias("a0"), F.explode(F.array(name("dad"), name("mom"))).alias("a1")),
        "gender": ids.select(F.explode(F.array(*[F.struct(name(w).alias("a0"), F.lit(g).alias("a1")) for w, g in (("dad", "male"), ("mom", "female"), ("son", "male"), ("daughter", "female"))])).alias("x")).select("x.*"),
    }
    if grandparents:
        old = ids.select("f", F.explode(F.array(F.lit("grandpa"), F.lit("grandma"))).alias("g"))
        elder = F.concat("g", F.lit("_"), "f")
        out["parent"] = out["child"].select(F.col("a1").alias("a0"), F.col("a0").alias("a1")).unionByName(old.select(elder.alias("a0"), name("dad").alias("a1")))
        out["grandparent"] = old.join(kids, "f").select(elder.alias("a0"), child.alias("a1"))
    if error:
        for k, df in out.items():
            last = df.columns[-1]
            wrong = F.concat(F.lit("stranger_"), F.pmod(F.xxhash64(F.lit("who"), *df.columns), F.lit(max(1, count))))
            out[k] = df.withColumn(last, F.when(_u(k, *df.columns) < error, wrong).otherwise(F.col(last))).distinct()
    return out


def functional(spark: SparkSession, keys: int, fan_out: int) -> DataFrame:
    """Each key with so many values."""
    return spark.range(keys).select((F.col("id") + 1).cast("int").alias("a0"), F.explode(F.sequence(F.lit(1), F.lit(fan_out))).alias("v")).select("a0", (F.col("a0") * fan_out + F.col("v") + keys).cast("int").alias("a1"))


def varying(spark: SparkSession, keys: int, most: int) -> DataFrame:
    """Keys with 1 to `most` values in turn."""
    return functional(spark, keys, most).filter(F.col("a1") - F.col("a0") * most - keys <= F.pmod(F.col("a0"), F.lit(most)) + 1)


def random_tables(spark: SparkSession, relations: int = 10, rows: int = 10, constants: int = 10, seed: int = 0) -> dict[str, DataFrame]:
    """Relations of arity 1, 2, ... with random cells; repeated rows are one."""
    out = {}
    for k in range(relations):
        cells = [(F.pmod(draw(seed, k, i, F.col("id")), F.lit(constants)) + 1).cast("int").alias(f"a{i}") for i in range(k + 1)]
        out[f"r{k + 1}"] = spark.range(rows).select(*cells).distinct()
    return out


def wizards(spark: SparkSession) -> dict[str, DataFrame]:
    """A small base of three generations for demonstrations: eight relations that follow from two."""
    fathers = [("james", "harry"), ("arthur", "ron"), ("arthur", "ginny"), ("harry", "albus")]
    mothers = [("lily", "harry"), ("molly", "ron"), ("molly", "ginny"), ("ginny", "albus")]
    parents = sorted(fathers + mothers)
    sets = {
        "father": fathers,
        "mother": mothers,
        "parent": parents,
        "child": [(c, p) for p, c in parents],
        "grandparent": sorted({(a, c) for a, b in parents for x, c in parents if b == x}),
        "sibling": sorted({(a, b) for p, a in parents for q, b in parents if p == q and a != b}),
        "male": sorted({(a,) for a, _ in fathers} | {("ron",), ("albus",)}),
        "female": sorted({(a,) for a, _ in mothers}),
    }
    return {k: spark.createDataFrame(v, ", ".join(f"a{i} string" for i in range(len(v[0])))) for k, v in sets.items()}
