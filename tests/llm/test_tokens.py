import hashlib

import pytest
import regex
from tokenizers import Tokenizer

from hornpress.llm import bpe, token_counts
from hornpress.llm.tokens import AGREED, Splitter, added_tokens, byte_alphabet, default_path, read_file
from tests.llm.conftest import EDGE


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(default_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(lib, rows):
    out = []
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        out.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_digests_are_the_librarys(edge, lib):
    got = sorted(map(tuple, bpe.digests(edge).collect()), key=str)
    assert got == expected(lib, [(r[0], r[1]) for r in EDGE])


def test_digests_of_documents_in_small_blocks(spark, sf, texts, lib, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_DISTINCT", 500)
    monkeypatch.setattr(bpe, "FREQUENT", 50)
    assert sorted(map(tuple, bpe.op6_bpe(spark, sf).collect()), key=str) == expected(lib, texts)


def test_round_trip(edge):
    back = bpe.decode(bpe.encode(edge, key="n_chars"), key="n_chars").collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in EDGE)


def test_decode_takes_any_ids(spark, lib):
    ids = [[0, 50256, 220], [], None, [171], [171, 120, 250]]
    got = bpe.decode(spark.createDataFrame(list(enumerate(ids)), "doc_id int, ids array<int>")).collect()
    assert {r.doc_id: r.text for r in got} == {k: lib.decode(i or [], skip_special_tokens=False) for k, i in enumerate(ids)}


def test_splitter_agrees_with_the_library(lib):
    split = Splitter(added_tokens(read_file(default_path())))
    agreed = regex.compile(f"[{AGREED}]")
    for c in range(0x110000):
        if 0xD800 <= c <= 0xDFFF:
            continue
        ch = chr(c)
        text = f"a{ch}a1{ch}1!{ch}! {ch}  {ch}"
        assert split(text) == [text[a:b] for _, (a, b) in lib.pre_tokenizer.pre_tokenize_str(text)], (hex(c), bool(agreed.match(ch)))
    assert split("x<|endoftext|> y") == ["x", "<|endoftext|>", " y"]
    assert len(byte_alphabet()) == 256


def test_chunks_of_long_texts(lib, monkeypatch):
    from hornpress.llm import tokens

    monkeypatch.setattr(tokens, "CHUNK", 20)
    split = Splitter(added_tokens(read_file(default_path())))
    for text in ["it's a  long text, and   so on<|endoftext|> it goes \n on and on. " * 9, "x" * 200, " " * 99 + "a b", "", "日本 語 " * 30 + "a b c" * 20]:
        assert [w for part in split.chunks(text) for w in part] == split(text)


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_query_counts_are_the_librarys(spark, sf, texts, lib, monkeypatch, broadcast):
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", broadcast)
    got = {r.doc_id: r for r in token_counts.op7_token_counts(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert tuple(got[i]) == (i, len(t.encode()), n, n > 1024, sha(t) < "1")


def test_numbers_pack():
    import numpy as np

    x = np.array([0, 1, 255, 256, 70000, 2**32 - 1], np.uint32)
    assert (bpe.unpack(bpe.pack(x)) == x).all() and len(bpe.unpack(bpe.pack(x[:0]))) == 0


def test_counts_and_cache(edge, empty, lib, spark, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(lib.encode(r[1] or "", add_special_tokens=False).ids), n > 1024) for r in EDGE), key=str)
    four = lambda df: sorted((tuple(r)[:4] for r in df.collect()), key=str)
    assert four(token_counts.count_tokens(edge, cache)) == want
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in EDGE})
    monkeypatch.setattr(token_counts, "_count", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        token_counts.count_tokens(edge, cache)
    monkeypatch.undo()
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 0)
    again = token_counts.count_tokens(edge, cache)
    assert four(again) == want and all(r.cached for r in again.collect())
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in EDGE})
    assert token_counts.count_tokens(empty, cache).count() == 0


def test_counts_use_what_is_stored(spark, tmp_path):
    from hornpress.llm.tokens import version_digest

    cache, version = str(tmp_path / "cache"), version_digest(read_file(default_path()))
    spark.createDataFrame([(sha("hello"), version, 77), (sha("other"), "older", 5)], token_counts.CACHE).write.parquet(cache)
    docs = spark.createDataFrame([(1, "hello"), (2, "other")], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, cache).collect()} == {1: 77, 2: 1}


def test_empty(empty):
    assert bpe.digests(empty).count() == 0
    assert bpe.encode(empty).count() == 0
