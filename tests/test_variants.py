import pytest

from hornpress.__main__ import main, parsed
from hornpress.operators import negatives as ng
from hornpress.operators.templates import similar_pairs
from hornpress.plans.compress import compress
from hornpress.plans.search import Config, SampledScorer, Scorer, alike_columns, symmetric_only
from hornpress.sources import readers, writers
from tests.fixtures import kb, rows_of

P = [(i, i + 50) for i in range(1, 30)]
Q = [(b, a) for a, b in P[:25]]


@pytest.fixture(scope="module")
def duals(spark):
    return kb(spark, {"p": P, "q": Q, "r": [(k, 79) for k in range(1, 10)]}, 79).persisted()


def test_gates(duals):
    config = Config(beam=3, metric="delta")
    near = similar_pairs(duals, 0.5)
    assert (("q", 0), ("p", 1)) in near
    for gate in (alike_columns(near), symmetric_only):
        c = compress(duals, config, ["q"], Scorer(duals, config, gate=gate))
        assert [(s.rule.head.pred, s.rule.body[0].pred, s.eval.pos, s.eval.neg) for s in c.rules] == [("q", "p", 25, 4)] and c.is_lossless()
        assert rows_of(c.counter["q"]) == {(b, a) for a, b in P[25:]}


def test_scores_by_negative_samples(duals):
    config = Config(beam=3, metric="delta")
    samples = {k: ng.weights(r.df, ng.uniform(r.df, duals.n, 60), duals.n) for k, r in duals.relations.items()}
    c = compress(duals, config, ["q"], SampledScorer(duals, config, samples=samples))
    assert c.rules and c.is_lossless()


def test_command_line(spark, tmp_path, duals, capsys):
    writers.kb_folder(duals, str(tmp_path / "in"))
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "-m", "delta", "-b", "2", "-t", "2", "-v"]) == 0
    assert "equals" in capsys.readouterr().out
    _, _, rules, _ = readers.compressed_folder(spark, str(tmp_path / "out"))
    assert {s.rule.head.pred for s in rules} == {"p", "q"}
    with pytest.raises(SystemExit):
        parsed(["a", "b", "-b", "0"])
    with pytest.raises(SystemExit):
        parsed(["a", "b", "-f", "2"])


def test_conversion(spark, tmp_path):
    (tmp_path / "facts").write_text("likes\tann\tbob\nlikes\tbob\tann\ncat\ttom\n")
    made = writers.converted(spark, str(tmp_path / "facts"), str(tmp_path / "kb"))
    assert readers.kb_folder(spark, str(tmp_path / "kb"), "kb").same_as(made)
