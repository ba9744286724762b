import itertools
import zlib

import numpy as np
import pytest

from hornpress.llm import quality
from tests.llm.conftest import EDGE, SCHEMA

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def test_marginals_match_all_paths():
    rng = np.random.default_rng(0)
    lines = np.array([1, 4, 3, 4])
    unary, change = rng.normal(size=lines.sum()), rng.normal(size=(2, 2))
    good, pairs = quality.marginals(unary, change, lines, pairs=True)
    at = 0
    for d, n in enumerate(lines):
        total, hit, seen = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[at + t] * y for t, y in enumerate(path)) + sum(change[a, b] for a, b in itertools.pairwise(path)))
            total += w
            hit += w * np.array(path)
            for a, b in itertools.pairwise(path):
                seen[a, b] += w
        assert np.allclose(good[at : at + n], hit / total) and np.allclose(pairs[d], seen / total)
        at += n


def test_features_of_lines():
    x, size, lines = quality.line_features(["", "AB cd.\n12 12\n12 12", "é!"])
    assert lines.tolist() == [1, 3, 1] and size.tolist() == [0, 6, 5, 5, 3]
    assert x[1, 1] == 0.5 and x[1, 11] == 1 and x[3, 9] == 1 and x[0, 10] == 1 and x[2, 6] == 0.5
    wide = quality.with_neighbours(x, lines)
    assert (wide[1, 13:26] == 0).all() and (wide[1, 26:39] == x[2]).all() and (wide[3, 26:39] == 0).all()


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.97


def test_edge_cases(spark, edge, empty, model):
    got = quality.score(edge, model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    kept = quality.keep_good(edge, model)
    assert kept.columns == edge.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(empty, model).count() == quality.keep_good(empty, model).count() == 0


def test_without_labels(spark, edge):
    none = quality.train(edge, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}
    one = quality.train(edge, spark.createDataFrame([(3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int"))
    assert {r.score for r in quality.score(spark.createDataFrame(EDGE, SCHEMA), one).collect()} == {0.5}


def test_any_column_names_and_repeated_ids(spark, model):
    docs = spark.createDataFrame([(1, "A plain line of text, as people write it.\n" * 5, "x", {"k": 1}), (1, "!!!! $$$ 000", "y", None)], "doc_id long, text string, `my col` string, `a.b` map<string,int>")
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    want = [r for r, s in zip(docs.collect(), model.score([r.text for r in docs.collect()]), strict=True) if s >= 0.5]
    assert kept.collect() == want
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, "good words in a row.\n" * 4 if i % 2 else "#### 11 ## $$") for i in range(40) for _ in range(3)]
    again = quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
    once = quality.train(spark.createDataFrame(sorted(set(rows)), "doc_id long, text string"), labels)
    assert np.allclose(again.weights, once.weights) and again.curve == pytest.approx(once.curve)


def slow_score(model, text):
    """The chain's marginals by plain sums, line after line."""
    x, size, _ = quality.line_features([text])
    x = (x - model.mean) / model.scale
    n, none = len(x), np.zeros(x.shape[1])
    own = [float(np.concatenate([x[i], x[i - 1] if i else none, x[i + 1] if i < n - 1 else none, [1.0]]) @ model.weights) for i in range(n)]
    step = np.exp(model.change)
    emit = [np.array([1.0, np.exp(u)]) for u in own]
    fwd, bwd = [emit[0] / emit[0].sum()], [np.ones(2)]
    for e in emit[1:]:
        f = (fwd[-1] @ step) * e
        fwd.append(f / f.sum())
    for e in reversed(emit[1:]):
        b = step @ (e * bwd[0])
        bwd.insert(0, b / b.sum())
    good = [f[1] * b[1] / (f @ b) for f, b in zip(fwd, bwd, strict=True)]
    p = min(max(sum(g * (s + 1) for g, s in zip(good, size, strict=True)) / sum(size + 1), 1e-6), 1 - 1e-6)
    return 1 / (1 + np.exp(-(model.curve[0] * np.log(p / (1 - p)) + model.curve[1])))


def test_query_matches_slow_scores(spark, sf, texts):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.op9_quality(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert got[i].score == pytest.approx(slow_score(model, t), abs=1e-6)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == (got[i].score >= 0.5)
