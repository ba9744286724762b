import hashlib
import re

import numpy as np
import pytest
import xxhash

from hornpress.llm import exact_dedup, simhash
from tests.llm.conftest import EDGE, row


def strip(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(strip(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, i))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        g = groups[strip(text)]
        out.append((doc_id, rows[min(g)[3]][0], len(g), hashlib.sha256(strip(text).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("support", [exact_dedup.SUPPORT, 0.25])
def test_exact_groups_match_brute_force(edge, support):
    want, kept = brute_exact([(r[0], r[1]) for r in EDGE])
    got = exact_dedup.exact_groups(edge, support=support).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == kept
    assert all(r.kept is False or r.doc_id == r.keep_id for r in got)


@pytest.mark.parametrize("support", [0.25])
def test_exact_dedup_keeps_one_row_of_each_text(edge, support):
    kept = exact_dedup.dedup(edge, support=support)
    assert kept.columns == edge.columns
    texts = [strip(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({strip(r[1]) for r in EDGE})


def test_frequent_texts_leave_the_shuffle(spark):
    rows = [row(i, "same text" if i % 3 else f"text {i}") for i in range(300)]
    keyed = exact_dedup.durable(spark.createDataFrame([(r[1], (0, False, r[0]), r[0], r[0]) for r in rows], "digest string, order struct<a: int, b: boolean, id: long>, rid long, doc_id long"))
    hot = exact_dedup.frequent_winners(keyed, 0.1).collect()
    assert [(h.digest, h.heavy_size, h.heavy.doc_id) for h in hot] == [("same text", 200, 1)]


def test_empty_tables(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0
    assert simhash.dedup(empty).count() == 0


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, ids):
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(prints))]


def test_near_groups_match_brute_force(edge):
    rows = [(r[0], r[1]) for r in EDGE]
    prints = [brute_print(t) for _, t in rows]
    comps = brute_components(prints, [i for i, _ in rows])
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, comps, strict=True)), key=str)
    got = simhash.near_groups(edge).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


def test_near_groups_on_documents(spark, sf, texts):
    prints = [brute_print(t) for _, t in texts]
    comps = brute_components(prints, [i for i, _ in texts])
    got = {r.doc_id: r for r in simhash.op5_simhash(spark, sf).collect()}
    assert len(got) == len(texts)
    for (i, _), p, c in zip(texts, prints, comps, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{p:016x}", c)
    kept = simhash.dedup(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id").collect()
    assert {r.doc_id for r in kept} == set(comps)


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_segments_find_every_pair_in_reach(segments):
    rng = np.random.default_rng(segments)
    parts = simhash.layout(segments)
    assert sum(bits for _, bits, _ in parts) == 64
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for b in rng.choice(64, size=simhash.RADIUS, replace=False):
            y ^= 1 << int(b)
        assert any(r >= 0 and ((x ^ y) >> at & (1 << bits) - 1).bit_count() <= r for at, bits, r in parts)


@pytest.mark.parametrize(("cell", "dense"), [(4, 16), (4096, 1 << 16)])
def test_links_connect_dense_buckets(spark, monkeypatch, cell, dense):
    """A cluster around one fingerprint and scattered ones: components are those of all pairs, however buckets are cut."""
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "DENSE_PAIRS", dense)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    prints = {int(x) for x in rng.integers(0, 1 << 62, size=60)}
    for _ in range(120):
        x = centre
        for b in rng.choice(62, size=int(rng.integers(1, 7)), replace=False):
            x ^= 1 << int(b)
        prints.add(x)
    prints = sorted(prints)
    want = brute_components(prints, prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    assert [roots.get(p, p) for p in prints] == want


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}


def test_dedup_judges_rows_not_ids(spark):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, x, "a"), (5, y, "b"), (1, x, "c"), (None, x, "d"), (None, "alone " * 9, "e"), (5, y, "b"), (5, y, "a"), (1, x, "c")], "doc_id long, text string, `my col.x` string")
    got = simhash.dedup(docs.repartition(3))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, x, "c"), (5, y, "a"), (None, "alone " * 9, "e")], key=str)


@pytest.mark.parametrize("cell", [16, 4096])
def test_askers_of_a_hot_segment_are_cut(spark, monkeypatch, cell):
    """Fingerprints that share a segment's value all ask its neighbours."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(8)
    top = 0x1234 << 48
    prints = {top | int(v) for v in rng.integers(0, 1 << 48, size=400)}
    prints |= {p ^ (1 << 50) ^ 1 for p in list(prints)[:30]} | {int(v) for v in rng.integers(0, 1 << 62, size=50)}
    prints = sorted(prints)
    roots = {r.node: r.root for r in simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))).collect()}
    assert [roots.get(p, p) for p in prints] == brute_components(prints, prints)
