from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from hornpress.llm import bpe, chat, mixing, quality
from hornpress.llm.queries import ORACLES, QUERIES
from tests.llm.test_dedup import brute_components, brute_print, strip

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("line", "role", "rest"), [
    ("User: hi", 2, "hi"), ("[assistant]: x", 3, "x"), ("**System:** y", 1, "y"), ("me> z", 2, "z"), ("A: b", 3, "b"), ("Useful: no", 0, "Useful: no"), ("", 0, ""), ("a thing: no", 0, "a thing: no"),
])
def test_markers(line, role, rest):
    seen, at = chat.observe(line)
    assert seen // 8 == role and line[at:] == rest


def slow_marker(line):
    """Role number and length of a marker, read a character at a time."""
    at = 0

    def skip(chars):
        nonlocal at
        while at < len(line) and (line[at].isspace() if chars is None else line[at] in chars):
            at += 1

    skip(None), skip("[<(*#_"), skip(None)
    name = next((n for n in sorted(chat.ROLE_OF, key=len, reverse=True) if line[at : at + len(n)].lower() == n and not line[at + len(n) : at + len(n) + 1].isalpha()), None)
    if name is None:
        return 0, 0
    at += len(name)
    skip(None), skip("])*_"), skip(None)
    if line[at : at + 1] not in (":", ">"):
        return 0, 0
    at += 1
    at += line[at : at + 1].isspace()
    skip("*_")
    at += line[at : at + 1].isspace()
    return chat.ROLE_OF[name] + 1, at


def test_long_lines_take_linear_time():
    import time

    began = time.monotonic()
    for line in (" " * 1_000_000, "user" + " " * 1_000_000, "[" * 1_000_000, "user " + "*" * 1_000_000, " " * 500_000 + "user:" + " " * 500_000):
        seen, at = chat.observe(line)
        assert (seen // 8, at) == slow_marker(line)
    assert time.monotonic() - began < 5


def test_markers_match_a_slow_reader():
    import random

    draw = random.Random(2)
    bits = ["user", "User", "a", "ai", "Assistant", " ", "  ", "*", "**", "[", "]", ":", ">", "_", "#", "x", "(", ")", "\t", "sys", "q"]
    for _ in range(20_000):
        line = "".join(draw.choice(bits) for _ in range(draw.randint(0, 7)))
        seen, at = chat.observe(line)
        assert (seen // 8, at) == slow_marker(line), line


def slow_path(hmm, seen):
    """Viterbi over dictionaries of scores, state by state."""
    best = {s: (int(hmm.step[chat.OUT, s]) + int(hmm.emit[s, seen[0]]), [s]) for s in range(chat.STATES)}
    for o in seen[1:]:
        best = {s: max(((v + int(hmm.step[p, s]) + int(hmm.emit[s, o]), path) for p, (v, path) in best.items()), key=lambda x: x[0]) for s in range(chat.STATES)}
        best = {s: (v, [*path, s]) for s, (v, path) in best.items()}
    return max(v for v, _ in best.values()), [path for v, path in best.values()]


def score_of(hmm, states, seen):
    return sum(int(hmm.step[p, s]) + int(hmm.emit[s, o]) for p, s, o in zip([chat.OUT, *states[:-1]], states, seen, strict=True))


def test_path_has_the_best_score():
    rng = np.random.default_rng(5)
    hmm = chat.fitted(rng.random(chat.STATES), rng.random((chat.STATES, chat.STATES)) * 9, rng.random((chat.STATES, chat.OBSERVED)) * 9)
    for n in (1, 2, 5, 40):
        seen = rng.integers(0, chat.OBSERVED, n).tolist()
        assert score_of(hmm, hmm.path(seen), seen) == slow_path(hmm, seen)[0]


def test_query_matches_brute_force(spark, monkeypatch):
    """Every row of op3: roles of the best score, over whole conversations."""
    monkeypatch.setattr(chat, "RUN", 3)
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    parts = chat.as_transcript(turns.select("conv_id", "turn", "role", "text"))
    hmm, got, by_conv = chat.train(parts), {}, {}
    for r in chat.op3_chat(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.conv_id, []).append(r)
    for r in parts.collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.text))
    assert {c: len(v) for c, v in got.items()} == {c: len(v) for c, v in by_conv.items()}
    for c, found in got.items():
        seen = [chat.observe(x)[0] for _, t in sorted(by_conv[c]) for x in t.split("\n")]
        roles = [r for f in sorted(found, key=lambda f: f.part) for r in f.roles.split(",")]
        best = slow_path(hmm, seen)[0]
        # of each role's two states the better, given the roles: the best score under these roles is the best of all
        at = [(2 * chat.ROLES.index(r), 2 * chat.ROLES.index(r) + 1) for r in roles]
        reach = {s: int(hmm.step[chat.OUT, s]) + int(hmm.emit[s, seen[0]]) for s in at[0]}
        for pair, o in zip(at[1:], seen[1:], strict=True):
            reach = {s: max(v + int(hmm.step[p, s]) for p, v in reach.items()) + int(hmm.emit[s, o]) for s in pair}
        assert max(reach.values()) == best


def test_parts_of_one_turn_and_high_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "RUN", 4)
    rows = [("c", 7, "user", f"User: line {i}") for i in range(40)] + [("d", 100 + i, ("user", "assistant")[i % 2], ("User: x", "AI: y")[i % 2]) for i in range(30)]
    parts = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(4)
    hmm = chat.train(parts.filter("conv_id = 'd'"))
    assert (hmm.step != chat.train(parts.limit(0)).step).any()
    got = chat.parse(parts, hmm).collect()
    want = hmm.path([chat.observe("User: line 1")[0]] * 40)  # the order of equal turns follows from the texts, all of which look alike
    assert len(got) == len(rows)
    assert Counter(r.roles[0] for r in got if r.conv_id == "c") == Counter(chat.ROLES[s // 2] for s in want)


@pytest.fixture(scope="module")
def parts(spark):
    return chat.as_transcript(spark.read.parquet(f"{SF}/conversations.parquet")).drop("lang").persist()


@pytest.mark.parametrize("run", [2, 256])
def test_parse_is_viterbi_over_whole_conversations(parts, monkeypatch, run):
    monkeypatch.setattr(chat, "RUN", run)
    hmm = chat.train(parts)
    got = {(r.conv_id, r.part): r for r in chat.parse(parts.drop("role"), hmm).collect()}
    by_conv = {}
    for r in parts.collect():
        by_conv.setdefault(r.conv_id, []).append((r.turn, r.text, r.role))
    right = 0
    for c, turns in by_conv.items():
        turns.sort()
        lines = [x for _, t, _ in turns for x in t.split("\n")]
        states, at = hmm.path([chat.observe(x)[0] for x in lines]), 0
        for turn, t, role in turns:
            n = len(t.split("\n"))
            assert got[c, turn].roles == [chat.ROLES[s // 2] for s in states[at : at + n]]
            right += got[c, turn].roles[0] == role
            at += n
    assert right / len(got) > 0.93


def test_rendering_and_edge_cases(spark):
    rows = [(1, 0, "User: hi\nthere"), (1, 1, "Assistant: yes"), (None, 0, "AI: a\nUser: b"), (None, None, None), (2, None, "System: s"), (3, 5, "User: q"), (3, 5, "User: q"), (4, -(2**40), ""), (4, 2**40, "A: z")]
    df = spark.createDataFrame([(*r, "key") for r in rows], "conv_id long, turn long, text string, key string")
    hmm = chat.train(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    got = chat.parse(df, hmm).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if (r.conv_id, r.part) == (1, 0))
    assert first.rendered == "<|user|>\nhi\nthere\n" and first.begun == 1
    assert [r.rendered for r in got if r.conv_id is None and r.part == 0] == ["<|assistant|>\na\n<|user|>\nb\n"]
    assert len([r for r in got if r.conv_id == 3]) == 2
    assert chat.parse(df.limit(0), hmm).count() == 0


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = quality.train(docs, labels)
    rows = [r for r, s in zip(rows, model.score([r["text"] for r in rows]), strict=True) if s >= 0.5]
    best = {}
    for r in rows:
        best[strip(r["text"])] = min(best.get(strip(r["text"]), (1, 0)), (-len(r["text"]), r["doc_id"]))
    rows = [r for r in rows if best[strip(r["text"])][1] == r["doc_id"]]
    comps = brute_components([brute_print(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    rows = [r for r, c in zip(rows, comps, strict=True) if c == r["doc_id"]]
    kept = spark.createDataFrame(rows, docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix_counts(kept).collect()}
    want = Counter()
    for r in bpe.digests(kept).collect():
        want[tuple(r)] += copies[r.doc_id]
    assert Counter(map(tuple, corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect())) == +want


def test_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_odd_columns_nulls_repeats_and_nothing(spark, sf, edge, stage):
    from pyspark.sql import functions as F

    odd = edge.withColumn("my col", F.lit("x")).withColumn("a.b", F.create_map(F.lit("k"), F.col("size"))).withColumn("nothing", F.lit(None).cast("int"))
    nulls = odd.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in odd.schema.fields])
    docs = odd.unionByName(nulls).unionByName(odd.limit(4))
    got = stage(spark, docs, sf)
    if stage is corpus_pipeline.encoded:
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == docs.count()
    else:
        assert got.columns == docs.columns and got.schema["a.b"].dataType == docs.schema["a.b"].dataType
        assert {r.text for r in got.select("text").collect()} <= {r.text for r in docs.select("text").collect()}
    assert stage(spark, odd.limit(0), sf).count() == 0
