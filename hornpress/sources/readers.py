"""Readers. Everything is read by Spark, so paths can be in any store that it knows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.functions.scores import Eval
from hornpress.operators import numeration as nm
from hornpress.operators import tables as tb
from hornpress.operators.kb import Kb, Relation
from hornpress.plans.rules import Rule, parse_rule
from hornpress.plans.search import Scored


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def binary_table(spark: SparkSession, path: str, arity: int, kind: str = "<i4") -> DataFrame:
    """Rows of little-endian 32-bit cells, row after row, from a file or a folder of files."""
    names, out = tb.names(arity), "int" if kind == "<i4" else "float"

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame(np.frombuffer(content, kind).reshape(-1, arity), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, ", ".join(f"{c} {out}" for c in names))


def _meta(spark: SparkSession, path: str) -> list[list[str]]:
    """Lines of a small tab-separated file (one for each relation), in order."""
    text = spark.read.text(path, wholetext=True).first()
    return [line.split("\t") for line in (text[0] if text else "").split("\n") if line]


def kb_folder(spark: SparkSession, path: str, name: str = "kb", skip_missing: bool = True, check: bool = False) -> Kb:
    """A folder with Relations.tsv (name, arity, rows) and <id>.rel files.

    A relation without a file is skipped; with skip_missing=False it stays, empty. check: constants
    without a name are an error.
    """
    made: dict[str, Relation] = {}
    for k, (rel, arity, *_) in enumerate(_meta(spark, f"{path}/Relations.tsv")):
        at = f"{path}/{k}.rel"
        if exists(spark, at):
            made[rel] = Relation(rel, int(arity), binary_table(spark, at, int(arity)))
        elif not skip_missing:
            made[rel] = Kb(name, made, 0).create(rel, int(arity))[rel] if made else Relation(rel, int(arity), spark.createDataFrame([], ", ".join(f"{c} int" for c in tb.names(int(arity)))))
    from hornpress.operators.kb import highest

    numeration = numeration_files(spark, path) if exists(spark, f"{path}/map1.tsv") else None
    kb = Kb(name, made, highest(made.values()), numeration)
    if check and numeration is not None and (odd := unmapped(kb).limit(5).collect()):
        raise ValueError(f"constants without a name: {[r[0] for r in odd]}")
    return kb


def unmapped(kb: Kb) -> DataFrame:
    """(value): constants of a base that its numeration lacks."""
    return kb._used().join(kb.numeration.select(F.col("num").alias("value")), "value", "left_anti")


def numeration_files(spark: SparkSession, path: str) -> DataFrame:
    """map1.tsv, map2.tsv, ...: line numbers over all files are the numbers of names; an empty line is a free number."""
    k, start, parts = 1, 1, None
    while exists(spark, at := f"{path}/map{k}.tsv"):
        lines = spark.read.text(at, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n", -1)).alias("pos", "name"))
        count = lines.count()
        named = lines.filter("name <> ''").select("name", (F.col("pos") + start).cast("int").alias("num"))
        parts = named if parts is None else parts.unionByName(named)
        k, start = k + 1, start + count
    return parts


def fact_lines(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tab-separated lines of a relation and its arguments, of any length: relations as tables of strings."""
    cells = spark.read.text(path).select(F.split("value", "\t").alias("x")).filter("size(x) > 1").persist()
    shapes = cells.select(F.col("x")[0].alias("rel"), (F.size("x") - 1).alias("arity")).distinct().orderBy("rel", "arity").collect()
    clash = {a["rel"] for a in shapes for b in shapes if a["rel"] == b["rel"] and a["arity"] != b["arity"]}
    if clash:
        raise ValueError(f"relations of several arities: {sorted(clash)}")
    return {s["rel"]: cells.filter(F.col("x")[0] == s["rel"]).select(*[F.col("x")[i + 1].alias(f"a{i}") for i in range(s["arity"])]).distinct() for s in shapes}


def negatives_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations.dat (name, arity), <id>.neg and optional <id>.wt files: samples with their weights (1 without a file)."""
    out = {}
    for k, (rel, arity, *_) in enumerate(_meta(spark, f"{path}/Relations.dat")):
        width, weighted = int(arity), exists(spark, f"{path}/{k}.wt")
        names = tb.names(width)
        files = spark.read.format("binaryFile").load([f"{path}/{k}.neg", *([f"{path}/{k}.wt"] if weighted else [])])
        pair = files.select(F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), "content").groupBy().pivot("kind", ["neg", "wt"]).agg(F.first("content"))

        def decode(frames: Iterator[pd.DataFrame], width: int = width, names: list[str] = names) -> Iterator[pd.DataFrame]:
            for f in frames:
                for neg, wt in zip(f["neg"], f["wt"], strict=True):
                    rows = pd.DataFrame(np.frombuffer(neg, "<i4").reshape(-1, width), columns=names)
                    yield rows.assign(weight=np.float32(1) if wt is None else np.frombuffer(wt, "<f4"))

        out[rel] = pair.mapInPandas(decode, ", ".join([*(f"{c} int" for c in names), "weight float"]))
    return out


def triples(spark: SparkSession, path: str, least: int = 1, columns: tuple[int, int, int] = (0, 1, 2), sep: str = "\t", width: int = 3) -> DataFrame:
    """(rel, s, o) of lines with exactly `width` fields, of relations with at least so many lines."""
    x = F.split("value", sep)
    rel, s, o = columns
    rows = spark.read.text(path).select(x.alias("x")).filter(F.size("x") == width).select(F.col("x")[rel].alias("rel"), F.col("x")[s].alias("s"), F.col("x")[o].alias("o"))
    kept = rows.groupBy("rel").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("rel")
    return rows.join(F.broadcast(kept), "rel", "left_semi") if least > 1 else rows


def subject_first(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an id, subject, relation and object."""
    return triples(spark, path, columns=(2, 1, 3), width=4)


def spaced_triples(spark: SparkSession, path: str) -> DataFrame:
    """A header line, then subject, relation and object between white space."""
    # a "column" up to a separator that no line has; the header is that of each file
    lines = spark.read.csv(path, schema="line string", sep="\x01", quote="", header=True, enforceSchema=True).filter("trim(line) <> ''")
    x = F.split(F.trim("line"), r"\s+")
    return lines.select(x[1].alias("rel"), x[0].alias("s"), x[2].alias("o"))


def triples_with_types(spark: SparkSession, paths: list[str], types: str | None = None) -> dict[str, DataFrame]:
    """Subject, relation and object lines of several files, and a JSON file of entity to list of types as unary relations."""
    rows = spark.read.text(paths).select(F.split("value", "\t").alias("x")).filter("size(x) = 3").select(F.col("x")[1].alias("rel"), F.col("x")[0].alias("s"), F.col("x")[2].alias("o"))
    out = relations_of(rows)
    if types:
        held = spark.read.text(types, wholetext=True).select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("entity", "types"))
        flat = held.select("entity", F.explode("types").alias("type")).persist()
        for t in (r[0] for r in flat.select("type").distinct().orderBy("type").collect()):
            out[t] = flat.filter(F.col("type") == t).select(F.col("entity").alias("a0")).distinct()
    return out


def relations_of(rows: DataFrame) -> dict[str, DataFrame]:
    """(rel, s, o) to a table for each relation."""
    rows = rows.persist()
    names = [r[0] for r in rows.select("rel").distinct().orderBy("rel").collect()]
    return {n: rows.filter(F.col("rel") == n).select(F.col("s").alias("a0"), F.col("o").alias("a1")).distinct() for n in names}


def result_text(spark: SparkSession, path: str) -> tuple[list[Rule], dict[str, list[tuple]], dict[str, list[tuple]], list[str]]:
    """Four parts between empty lines: rules, necessary facts, counterexamples, constants (names)."""
    text = spark.read.text(path, wholetext=True).first()[0]
    parts = (text.split("\n\n") + ["", "", "", ""])[:4]
    lines = [[x for x in p.split("\n") if x] for p in parts]

    def facts(rows: list[str]) -> dict[str, list[tuple]]:
        out: dict[str, list[tuple]] = {}
        for r in rows:
            rel, *args = r.split("\t")
            out.setdefault(rel, []).append(tuple(args))
        return out

    return [parse_rule(r) for r in lines[0]], facts(lines[1]), facts(lines[2]), lines[3]


def hint_lines(spark: SparkSession, path: str) -> tuple[float, float, list[str]]:
    """Two thresholds (coverage, ratio), then a template on each line."""
    lines = [x for x in spark.read.text(path, wholetext=True).first()[0].split("\n") if x.strip()]
    return float(lines[0]), float(lines[1]), lines[2:]


def compressed_folder(spark: SparkSession, path: str) -> tuple[Kb, dict[str, DataFrame], list[Scored], DataFrame]:
    """What writers.compressed wrote: facts, counterexamples, rules and supplementary constants."""
    facts, counter = {}, {}
    n = 0
    for k, (rel, arity, rows, wrong) in enumerate(_meta(spark, f"{path}/Relations.tsv")):
        width = int(arity)
        empty = spark.createDataFrame([], ", ".join(f"{c} int" for c in tb.names(width)))
        facts[rel] = Relation(rel, width, binary_table(spark, f"{path}/{k}.rel", width) if int(rows) else empty)
        if int(wrong):
            counter[rel] = binary_table(spark, f"{path}/{k}.ceg", width)
    rules = [Scored(parse_rule(line[0]), Eval(float(line[1]), float(line[2]), int(line[3]))) for line in _meta(spark, f"{path}/rules.hyp")]
    try:
        extra = binary_table(spark, f"{path}/supplementary.cst", 1).toDF("value")
        extra.schema  # noqa: B018
    except AnalysisException:
        extra = spark.createDataFrame([], "value int")
    from hornpress.operators.kb import highest

    n = max(highest(facts.values()), extra.agg(F.coalesce(F.max("value"), F.lit(0))).first()[0])
    return Kb("compressed", facts, n), counter, rules, extra


def encoded(kb_name: str, relations: dict[str, DataFrame]) -> Kb:
    """Tables of strings as a base."""
    return Kb.from_names(kb_name, relations)


def decode(df: DataFrame, kb: Kb) -> DataFrame:
    return nm.decode(df, kb.numeration)
