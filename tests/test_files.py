import numpy as np
import pytest
from pyspark.sql import functions as F

from hornpress.operators.kb import Kb
from hornpress.operators.recovery import recover
from hornpress.plans.compress import compress_with
from hornpress.plans.rules import parse_rule
from hornpress.sources import readers as rd
from hornpress.sources import writers as wr
from hornpress.streaming.scoring import follow
from tests.fixtures import FAMILY, frame, kb, rows_of
from tests.test_compress import SCRIPT


def names(spark, tables):
    return {k: spark.createDataFrame([tuple(f"n{x:02d}" for x in r) for r in v], ", ".join(f"a{i} string" for i in range(len(v[0])))) for k, v in tables.items()}


def test_base_round_trip(spark, tmp_path):
    base = Kb.from_names("family", names(spark, FAMILY))
    wr.kb_folder(base, str(tmp_path))
    assert np.fromfile(tmp_path / "1.rel", "<i4").reshape(-1, 2).tolist() == sorted(map(list, rows_of(base["mother"].df)))
    back = rd.kb_folder(spark, str(tmp_path), "family")
    assert back.same_as(base) and back.n == base.n and rd.unmapped(back).isEmpty()
    (tmp_path / "0.rel").unlink()
    assert list(rd.kb_folder(spark, str(tmp_path)).relations) == ["mother", "father"]
    kept = rd.kb_folder(spark, str(tmp_path), skip_missing=False)
    assert kept["family"].df.count() == 0 and kept["family"].arity == 3
    wr.kb_parquet(base, str(tmp_path / "pq"))
    assert rows_of(spark.read.parquet(str(tmp_path / "pq/father"))) == rows_of(base["father"].df)


def test_numeration_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 4), ("b", 6), ("c", 1)], "name string, num int")
    assert wr.numeration(df, str(tmp_path), 3) == 2
    assert (tmp_path / "map1.tsv").read_text() == "c\n\n\n" and (tmp_path / "map2.tsv").read_text() == "a\n\nb\n"
    assert rows_of(rd.numeration_files(spark, str(tmp_path))) == {("a", 4), ("b", 6), ("c", 1)}


def test_compressed_round_trip(spark, tmp_path):
    c = compress_with(kb(spark, FAMILY, 17), [parse_rule(r) for r in SCRIPT])
    wr.compressed(c, str(tmp_path))
    facts, counter, rules, extra = rd.compressed_folder(spark, str(tmp_path))
    assert [str(s.rule) for s in rules] == [str(s.rule) for s in c.rules] and rules[0].eval.pos == c.rules[0].eval.pos
    back = recover(facts, counter, [s.rule for s in rules], extra)
    assert {k: rows_of(r.df) for k, r in back.relations.items()} == {k: set(v) for k, v in FAMILY.items()}
    wr.result_text(c, str(tmp_path / "all.txt"))
    got, necessary, _, constants = rd.result_text(spark, str(tmp_path / "all.txt"))
    assert [str(r) for r in got] == [str(s.rule) for s in c.rules]
    assert sum(map(len, necessary.values())) == c.report().first().necessary and len(constants) == extra.count()


def test_negatives_round_trip(spark, tmp_path):
    weighed = frame(spark, [(1, 2), (3, 4)]).withColumn("weight", (F.col("a0") / 2).cast("float"))
    wr.negatives({"r": weighed, "s": frame(spark, [(7,), (5,)])}, str(tmp_path))
    back = rd.negatives_folder(spark, str(tmp_path))
    assert rows_of(back["r"]) == {(1, 2, 0.5), (3, 4, 1.5)} and rows_of(back["s"]) == {(7, 1.0), (5, 1.0)}


def test_imports(spark, tmp_path):
    f = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    assert {k: rows_of(v) for k, v in rd.fact_lines(spark, f("facts", "p\ta\tb\nq\tc\np\ta\tb\n")).items()} == {"p": {("a", "b")}, "q": {("c",)}}
    with pytest.raises(ValueError):
        rd.fact_lines(spark, f("clash", "p\ta\np\ta\tb\n"))
    assert rows_of(rd.triples(spark, f("t", "p\ta\tb\np\tc\td\nq\ta\tb\nbad\tx\n"), 2)) == {("p", "a", "b"), ("p", "c", "d")}
    assert rows_of(rd.subject_first(spark, f("y", "id1\ta\tp\tb\nshort\n"))) == {("p", "a", "b")}
    assert rows_of(rd.spaced_triples(spark, f("d", "header\na p b\nc  q  d .\n"))) == {("p", "a", "b"), ("q", "c", "d")}
    got = rd.triples_with_types(spark, [f("x1", "a\tp\tb\n"), f("x2", "c\tp\td\n")], f("types.json", '{"a": ["t1", "t2"], "b": ["t1"]}'))
    assert {k: rows_of(v) for k, v in got.items()} == {"p": {("a", "b"), ("c", "d")}, "t1": {("a",), ("b",)}, "t2": {("a",)}}
    assert rd.hint_lines(spark, f("h", "0.2\n0.8\np(X):-q(X,?)\n")) == (0.2, 0.8, ["p(X):-q(X,?)"])


def test_text_exports(spark, tmp_path):
    base = Kb.from_names("family", names(spark, FAMILY))
    wr.fact_lines(base, str(tmp_path / "facts"))
    assert {k: v.count() for k, v in rd.fact_lines(spark, str(tmp_path / "facts")).items()} == {k: len(v) for k, v in FAMILY.items()}
    rows = spark.createDataFrame([("p", "a", "b"), ("p", "c", "d"), ("q", "a", "b")], "rel string, s string, o string")
    wr.frequent_triples(rows, str(tmp_path / "tri"), 2)
    assert spark.read.text(str(tmp_path / "tri")).count() == 2
    results = spark.createDataFrame([("a", 1, 2, 0, 0.5, 0.9, 1.0), ("b", 1, 2, 0, 0.5, 1.0, 1.0)], "rule string, length int, pos long, neg long, coverage double, tau double, delta double")
    wr.template_results(results, str(tmp_path / "res"))
    assert [r.rule for r in spark.read.csv(str(tmp_path / "res"), sep="\t", header=True).collect()] == ["b", "a"]


def test_stream(spark, tmp_path):
    base = kb(spark, FAMILY, 17)
    base["mother"].df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base["mother"].df.schema).parquet(str(tmp_path / "in"))
    follow(stream, base, [parse_rule("mother(X,Y):-family(X,?,Y)")], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.filter("by_rule").count() == 4
