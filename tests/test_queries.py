"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hornpress import queries as q

SF = "/root/testdata/sf0.001"
SOME = ["numeration", "add_names", "compaction", "insert_places", "promising_constants", "project_join", "jaccard_pairs", "eval_rules", "evidence", "template_subsumption", "neg_weights", "sample_major_nodes", "dependency_edges", "recursive_recovery", "inversions", "neg_uniform", "neg_near_positive", "neg_relevant_by_hops", "neg_remapped", "sample_walk", "sample_weighted_walk", "sample_snowball", "split_parts", "file_base", "file_compressed", "file_imports", "file_negatives", "gen_random", "stream_explained", "generalizations", "edits", "scores", "template_run", "mine_by_estimates", "relation_ids", "slices", "supplementary"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cursor = duck.execute(q.ORACLES[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == cols
    want = sorted(str([dict(zip(have, r, strict=True))[c] for c in cols]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want and want


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(q.ORACLES) <= set(q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
