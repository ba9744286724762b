"""Writers of the file formats that readers read, and of Parquet."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.operators import numeration as nm
from hornpress.operators.kb import Kb
from hornpress.plans.compress import Compressed

NAMES_A_FILE = 1_000_000


def _put(spark: SparkSession, path: str, chunks) -> None:  # noqa: ANN001
    """A single file in any store, written chunk by chunk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for c in chunks:
            stream.write(bytearray(c))
    finally:
        stream.close()


def _lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    _put(spark, path, ["".join(f"{x}\n" for x in lines).encode()])


def _rows(df: DataFrame, cols: list[str], kind: str = "<i4"):  # noqa: ANN202
    """Cells of ordered rows, partition by partition."""
    held: list[tuple] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append(tuple(r[c] for c in cols))
        if len(held) == 65536:
            yield np.array(held, kind).tobytes()
            held = []
    if held:
        yield np.array(held, kind).tobytes()


def relation(df: DataFrame, path: str) -> None:
    """Sorted rows of little-endian 32-bit cells. The format is one file; large relations are better kept as Parquet."""
    _put(df.sparkSession, path, _rows(df.orderBy(*df.columns), df.columns))


def relation_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def numeration(names: DataFrame, path: str, most: int = NAMES_A_FILE) -> int:
    """map1.tsv, map2.tsv, ...: a line for each number, empty for a free one; gives the number of files."""
    spark = names.sparkSession
    top = names.agg(F.coalesce(F.max("num"), F.lit(0))).first()[0]
    every = spark.range(1, top + 1).select(F.col("id").cast("int").alias("num")).join(names, "num", "left").select("num", F.coalesce("name", F.lit("")).alias("name"))
    files = -(-top // most)
    for k in range(files):
        part = every.filter((F.col("num") > k * most) & (F.col("num") <= (k + 1) * most)).orderBy("num")
        _put(spark, f"{path}/map{k + 1}.tsv", (f"{r['name']}\n".encode() for r in part.toLocalIterator()))
    return files


def kb_folder(kb: Kb, path: str) -> None:
    """Names, Relations.tsv and a .rel file for each relation that has rows."""
    if kb.numeration is not None:
        numeration(kb.numeration, path)
    _lines(kb.spark, f"{path}/Relations.tsv", [f"{r.name}\t{r.arity}\t{kb.sizes[r.name]}" for r in kb.relations.values()])
    for k, r in enumerate(kb.relations.values()):
        if kb.sizes[r.name]:
            relation(r.df, f"{path}/{k}.rel")


def kb_parquet(kb: Kb, path: str) -> None:
    for r in kb.relations.values():
        relation_parquet(r.df, f"{path}/{r.name}")
    if kb.numeration is not None:
        kb.numeration.write.mode("overwrite").option("maxRecordsPerFile", NAMES_A_FILE).parquet(f"{path}/_names")


def compressed(c: Compressed, path: str) -> None:
    """Necessary tuples, counterexamples, Relations.tsv (name, arity, rows, counterexamples), rules.hyp and supplementary.cst."""
    spark, lines = c.kb.spark, []
    for k, (name, r) in enumerate(c.kb.relations.items()):
        facts, wrong = c.necessary[name], c.counter.get(name)
        n, m = facts.count(), 0 if wrong is None else wrong.count()
        lines.append(f"{name}\t{r.arity}\t{n}\t{m}")
        if n:
            relation(facts, f"{path}/{k}.rel")
        if m:
            relation(wrong, f"{path}/{k}.ceg")
    _lines(spark, f"{path}/Relations.tsv", lines)
    _lines(spark, f"{path}/rules.hyp", [f"{s.rule}\t{s.eval.pos}\t{s.eval.all}\t{s.eval.length}" for s in c.rules])
    if not c.supplementary.isEmpty():
        relation(c.supplementary, f"{path}/supplementary.cst")


def negatives(samples: dict[str, DataFrame], path: str) -> None:
    """Relations.dat, .neg files and, for samples with a weight, .wt files in the same order."""
    spark, lines = next(iter(samples.values())).sparkSession, []
    for k, (name, df) in enumerate(samples.items()):
        cols = [c for c in df.columns if c != "weight"]
        lines.append(f"{name}\t{len(cols)}")
        ordered = df.orderBy(*cols)
        _put(spark, f"{path}/{k}.neg", _rows(ordered, cols))
        if "weight" in df.columns:
            _put(spark, f"{path}/{k}.wt", _rows(ordered, ["weight"], "<f4"))
    _lines(spark, f"{path}/Relations.dat", lines)


def result_text(c: Compressed, path: str) -> None:
    """Rules, necessary facts, counterexamples and constants as text, between empty lines."""
    def facts(tables: dict[str, DataFrame]) -> list[str]:
        return [f"{k}\t" + "\t".join(map(str, r)) for k, df in tables.items() for r in df.orderBy(*df.columns).toLocalIterator()]

    parts = [[str(s.rule) for s in c.rules], facts(c.necessary), facts(c.counter), [str(r[0]) for r in c.supplementary.orderBy("value").toLocalIterator()]]
    _put(c.kb.spark, path, ["\n\n".join("\n".join(p) for p in parts).encode()])


def template_results(results: DataFrame, path: str) -> None:
    """Tab-separated, the best compression ratio first."""
    cols = ["rule", "length", "pos", "neg", "coverage", "tau", "delta"]
    results.select(*cols).orderBy(F.desc("tau"), "rule").coalesce(1).write.mode("overwrite").option("header", True).csv(path, sep="\t")


def fact_lines(kb: Kb, path: str) -> None:
    """Lines of a relation and the names of its arguments."""
    parts = [nm.decode(r.df, kb.numeration).select(F.concat_ws("\t", F.lit(r.name), *r.cols).alias("value")) for r in kb.relations.values()]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").text(path)


def frequent_triples(rows: DataFrame, path: str, least: int = 6000) -> None:
    """(rel, s, o) of relations with at least so many rows, as tab-separated lines."""
    kept = rows.groupBy("rel").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("rel")
    rows.join(F.broadcast(kept), "rel", "left_semi").select("rel", "s", "o").write.mode("overwrite").csv(path, sep="\t")


def converted(spark: SparkSession, lines: str, out: str, name: str = "kb") -> Kb:
    """Fact lines as a base folder."""
    from hornpress.sources.readers import fact_lines as read

    kb = Kb.from_names(name, read(spark, lines))
    kb_folder(kb, out)
    return kb
