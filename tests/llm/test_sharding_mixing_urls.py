import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hornpress.llm import mixing, sharding, url_filter
from tests.llm.conftest import EDGE, row


def shuffled(df, **kw):
    return sharding.external_shuffle(df, 8, (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long"), **kw)


def test_shards_hold_every_row_once_and_are_even(edge):
    got = shuffled(edge).collect()
    assert sorted((tuple(r.rec) for r in got), key=str) == sorted(EDGE, key=str)
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count[k] for k in range(8)) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(count[k]))


def test_shuffle_is_seeded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    runs = [[(r.rec.doc_id, r.shard, r.slot) for r in shuffled(docs, seed=s, bucket_bytes=20_000).orderBy("rec.doc_id").collect()] for s in (1, 1, 2)]
    assert runs[0] == runs[1] != runs[2]
    order = [i for i, _, _ in sorted(runs[0], key=lambda x: (x[2], x[1]))]
    assert order != sorted(order)


def test_bucket_offsets_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    counts = [(b, b % 5 + 1) for b in range(20) if b != 7]
    got = {r.bucket: r.offset for r in sharding.bucket_offsets(spark.createDataFrame(counts, "bucket long, n long")).collect()}
    assert got == {b: sum(n for c, n in counts if c < b) for b, _ in counts}


def test_written_shards(edge, spark, tmp_path):
    sharding.write_shards(shuffled(edge.select("doc_id", "text")), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(EDGE)


def test_query_columns(spark, sf, texts):
    got = {r.doc_id: r for r in sharding.op8_sharding(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        assert (got[i].size, got[i].text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        assert got[i].law == "rows" and got[i].grown_shard is None


def fill(sizes):
    """Reshare the excess by weight, round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark, sf, texts):
    got = mixing.op10_mixing(spark, sf).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for i, t in texts:
        sizes[source[i]] += len(t.split())
    target = fill(sizes)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        assert r.taken <= 3 * r["size"] and r.taken == r["size"] * r.copies
        taken[source[r.doc_id]] += r.taken
    for s, n in target.items():
        assert abs(taken[s] - n) <= 0.15 * n
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10_mixing(spark, sf).collect()))


def test_mix_edge_cases(edge, empty):
    counts = mixing.mix_counts(edge).collect()
    assert len(counts) == len(EDGE)
    target = fill(Counter({s: sum(len((r[1] or "").encode().split()) for r in EDGE if r[3] == s) for s in {r[3] for r in EDGE}}))
    assert {round(r.target, 6) for r in counts} == {round(t, 6) for t in target.values()}
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    want = Counter()
    for r in counts:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert mixing.mix(empty).count() == mixing.mix_counts(empty).count() == 0
    assert shuffled(empty).count() == 0


def test_mix_without_words(spark):
    from tests.llm.conftest import SCHEMA

    got = mixing.mix_counts(spark.createDataFrame([row(1, ""), row(2, None, None)], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")


URLS = [
    "http://example.org/es/1", "https://A.Example.ORG/en/12?x#y", "http://example.org/en/2", "http://notexample.org/es/", "http://example.org", "http://example.org?x=/es/", "ftp://x.com/fr/a", "http://com/de/", "http://x.com/de", "http://x.net/",
    "no scheme", "", None, "://org/", "http://..com/fr/", "http://é.org/\n/x", "http://a.b.c.d.e.example.org/es/?", "http://example.org/es/x/y/z", "http://x.com/fr/://org/", "http://x.com:80/fr/",
]
MORE_RULES = [("block", "example.org", ""), ("allow", "example.org", "/es/x/"), ("block", "example.org", "/es/x/y"), ("allow", "a.example.org", "/"), ("block", "a.example.org", "/"), ("allow", "d.e.example.org", "/e")]


@pytest.mark.parametrize("more", [[], MORE_RULES])
def test_urls_match_brute_force(spark, more):
    rules = url_filter.RULES + more
    kept = {}
    for v, h, p in rules:
        kept[h, p] = max(v, kept.get((h, p), ""))
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x"), (None, URLS[1], "x"), (0, URLS[2], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"))
    want = [(i, *brute_url(u, [(v, h, p) for (h, p), v in kept.items()])) for i, u, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_urls_without_rules_or_pages(spark):
    schema = "verdict string, host string, path string"
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.filter_urls(pages, spark.createDataFrame([], schema)).collect()] == [(1, "x.org", "/", None, "allow")]
    assert url_filter.filter_urls(pages.limit(0), spark.createDataFrame(url_filter.RULES, schema)).count() == 0


@pytest.mark.parametrize("most_paths", [64, 1])
def test_urls_in_many_ranges(spark, monkeypatch, most_paths):
    monkeypatch.setattr(url_filter, "RANGES", 20)
    monkeypatch.setattr(url_filter, "MOST_PATHS", most_paths)
    rows = [(i, f"http://h{i % 3}.example.org/{'es' if i % 2 else 'en'}/{i}") for i in range(500)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, *brute_url(u, url_filter.RULES)) for i, u in rows)


@pytest.mark.parametrize("most_paths", [64, 2])
def test_urls_with_nested_hosts_and_a_crowded_host(spark, monkeypatch, most_paths):
    monkeypatch.setattr(url_filter, "RANGES", 10)
    monkeypatch.setattr(url_filter, "MOST_PATHS", most_paths)
    import random

    draw = random.Random(4)
    parts = ["/a", "/ab", "/abc", "/a/b", "/b", "", "/abd/e", "/a/"]
    hosts = ["com", "x.com", "y.x.com", "z.y.x.com", "xx.com", "org", "com.x"]
    rules = {(h, p): draw.choice(["allow", "block"]) for h in hosts for p in parts if draw.random() < 0.6 or h == "com"}
    rows = [(i, f"http://{draw.choice(['', 'q.', 'com.', 'y.'])}{draw.choice(hosts)}{draw.choice(parts)}{draw.choice(['', '/q', 'x'])}") for i in range(1500)]
    rows += [(9000, f"http://x.com{p}") for p in parts] + [(None, None)] * 20
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(v, *k) for k, v in rules.items()], "verdict string, host string, path string"))
    want = [(i, *brute_url(u, [(v, *k) for k, v in rules.items()])) for i, u in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_mix_with_null_and_repeated_ids(spark):
    rows = [(None, f"{'word ' * (i % 7 + 1)}{i}", "a") for i in range(300)] + [(5, "same words here", "b")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_counts(docs).collect()
    for source_size in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.05 * mine[0].target
    count = lambda rs: Counter((r.doc_id, r["size"], r.copies) for r in rs)
    assert count(got) == count(mixing.mix_counts(docs.repartition(2)).collect())
    assert mixing.mix(docs).count() == sum(r.copies for r in got)


def test_shards_of_repeated_rows_maps_and_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 50)
    rows = [(None, "same", {"k": 1})] * 400 + [(i, f"text {i}", {"k": i, "j": 2}) for i in range(300)] + [(7, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b c` map<string,int>")
    runs = [sorted(((r.shard, r.slot, r.rec.doc_id, r.rec.text) for r in shuffled(df.repartition(n), bucket_bytes=500).collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


def test_query_law_and_slots(spark, sf):
    got = sharding.op8_sharding(spark, sf).collect()
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(count[k]))
