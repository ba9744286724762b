"""BPE encoding and decoding by a distinct-word table.

Texts are split into words where they are read. A block of documents keeps its distinct words once
and each document as positions in that list. The blocks' words, dealt out by word, make the table
of distinct words, each encoded once; its ids go back to the blocks that hold the word and are
joined to the documents by position. Very frequent words, found in a sample, are encoded up front
and sent along, so that blocks list the others only. Decoding joins ids to their pieces by position:
the table of pieces, which is the vocabulary, is sent along as an array, and an id is its place there.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from hornpress.llm.common import durable, lean, schema, spill_table, table, text_of
from hornpress.llm.tokens import Splitter, added_tokens, default_path, pieces, read_file, tokenizer

#: Frequent words sent along: at most so many, none longer, out of so many texts. They decide what moves, not what results.
FREQUENT, FREQUENT_LENGTH, FREQUENT_TEXTS = 120_000, 64, 8_000
#: A block ends, between texts, when it has so many distinct other words, bytes in these, or words in all.
BLOCK_DISTINCT, BLOCK_BYTES, BLOCK_LENGTH = 400_000, 16 << 20, 6_000_000
#: Word lists that a block cuts its words into: so many at least, and one for so many words of the vocabulary.
LISTS, LIST_WORDS = 32, 1_000_000
#: A vocabulary grows with less than this power of the number of texts.
GROWTH = 0.75
#: Bytes of a list's words whose ids a worker keeps; beyond it a word can be encoded again.
KEPT_BYTES = 64 << 20
#: Ids joined to pieces at once.
AT_ONCE = 1 << 20

Batches = Iterator[pa.RecordBatch]


def pack(values: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by significance."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _tops(added: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        lean()
        split, counts = Splitter(added), Counter()
        for b in batches:
            for text in b["text"]:
                counts.update(split(text.as_py()))
        top = [(w, n) for w, n in counts.most_common(FREQUENT) if len(w) <= FREQUENT_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    return run


def frequent_words(texts: DataFrame, added: list[str]) -> tuple[list[str], int]:
    """At most FREQUENT words, from a sample of about FREQUENT_TEXTS texts; and how many lists the vocabulary needs.

    Lists follow from the sample's vocabulary and how many times more texts there are. Too few or
    many lists change what a task holds, not results.
    """
    rows = texts.count()
    part = min(1.0, FREQUENT_TEXTS / max(1, rows))
    sample = texts if part == 1 else texts.sample(fraction=part, seed=5)
    tops = durable(sample.mapInArrow(_tops(added), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    lists = max(LISTS, int(tops.count() * (1 / part) ** GROWTH) // LIST_WORDS)
    return [r["word"] for r in tops.orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").collect()], lists


class Codes(dict):
    """Word to number; a new word gets the next one. size: the length of new words."""

    size = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.size += len(word)
        return n


def _split(added: list[str], key: str, frequent: list[str], lists: int) -> Callable[[Batches], Batches]:
    """To a row of documents (block, keys, sizes, codes) and rows of word lists (block, list, start, words)."""

    def run(batches: Batches) -> Batches:
        lean()
        import xxhash
        import zstandard

        split, digest = Splitter(added), xxhash.xxh64_intdigest
        names = ["block", "keys", "sizes", "codes", "list", "start", "words"]
        known = dict(zip(frequent, range(len(frequent)), strict=True))
        block, codes, length = TaskContext.get().partitionId() << 32, Codes(known), 0
        keys: list[pa.Array] = []
        coded: list[np.ndarray] = []

        def end() -> Batches:
            """The block's words by list, and its documents with numbers in that order."""
            rare = [w.encode("utf-8") for w in list(codes)[len(known) :]]
            of = np.fromiter((digest(w) % lists for w in rare), np.int64, count=len(rare))
            order = np.argsort(of, kind="stable")
            number = np.arange(len(codes), dtype=np.uint32)
            number[len(known) + order] = len(known) + np.arange(len(rare), dtype=np.uint32)
            held = pa.concat_arrays(keys)
            held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            sizes = np.fromiter(map(len, coded), np.uint32, count=len(coded))
            row = [pa.array([pack(x)], pa.binary()) for x in (sizes, number[np.concatenate(coded)])]
            yield pa.RecordBatch.from_arrays([pa.array([block]), held, *row, *(pa.nulls(1, k) for k in (pa.int32(), pa.int64(), pa.binary()))], names=names)
            filled, starts = np.unique(of[order], return_index=True)
            words = [zstandard.ZstdCompressor(level=3).compress(b"\xff".join(rare[i] for i in part)) for part in np.split(order, starts[1:])] if len(rare) else []
            n = len(words)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, held.type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(filled, pa.int32()), pa.array(starts, pa.int64()), pa.array(words, pa.binary())], names=names)

        for b in batches:
            begun = 0
            for i, text in enumerate(b["text"]):
                parts = [np.fromiter(map(codes.__getitem__, words), dtype=np.uint32, count=len(words)) for words in split.chunks(text.as_py())]
                coded.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
                length += len(coded[-1])
                if len(codes) - len(known) >= BLOCK_DISTINCT or codes.size >= BLOCK_BYTES or length >= BLOCK_LENGTH:
                    keys.append(b[key][begun : i + 1])
                    yield from end()
                    block, codes, length, keys, coded, begun = block + 1, Codes(known), 0, [], [], i + 1
            keys.append(b[key][begun:])
        if coded:
            yield from end()

    return run


def _encode_lists(spec: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        """Rows sorted by list: a list's distinct words, over all blocks, are encoded once each."""
        lean()
        import zstandard

        t, now, held = tokenizer(spec), None, 0
        ids: dict[bytes, list[int]] = {}
        for b in batches:
            sizes, values = [], []
            for at, packed in zip(b["list"].to_pylist(), b["words"], strict=True):
                if at != now or held > KEPT_BYTES:
                    now, ids, held = at, {}, 0
                words = zstandard.ZstdDecompressor().decompress(packed.as_py()).split(b"\xff")
                for w in words:
                    if w not in ids:
                        ids[w] = t.encode(w.decode("utf-8"), add_special_tokens=False).ids
                        held += len(w)
                found = [ids[w] for w in words]
                sizes.append(pack(np.fromiter(map(len, found), np.uint32, count=len(found))))
                values.append(pack(np.fromiter((x for f in found for x in f), np.uint32)))
            yield pa.RecordBatch.from_arrays([b["block"], b["start"], pa.array(sizes, pa.binary()), pa.array(values, pa.binary())], names=["block", "start", "sizes", "ids"])

    return run


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[start : start + length], end to end."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)
    return values[at]


#: From keys and the ids of each row to the table that a block gives.
Finish = Callable[[pa.Array, Iterator[np.ndarray]], pa.Table]


def _join(frequent_sizes: np.ndarray, frequent_ids: np.ndarray, finish: Finish) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        """A block's documents and the ids of its words, by position."""
        lean()
        words = words.sort_by("start")
        sizes = np.concatenate([frequent_sizes, *(unpack(x.as_py()) for x in words["sizes"])])
        values = np.concatenate([frequent_ids, *(unpack(x.as_py()) for x in words["ids"])])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        (held,), (lengths,), (codes,) = (docs[c].to_pylist() if c != "keys" else [docs[c].combine_chunks().flatten()] for c in ("keys", "sizes", "codes"))
        ends, codes = np.cumsum(unpack(lengths), dtype=np.int64), unpack(codes)
        return finish(held, (_gather(values, starts[c], sizes[c].astype(np.int64)) for c in np.split(codes, ends[:-1])))

    return run


def _as_ids(key: str) -> Finish:
    def finish(keys: pa.Array, rows: Iterator[np.ndarray]) -> pa.Table:
        """In chunks, each of which is sent by itself."""
        chunks, held, size = [], [], 0

        def end() -> None:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
            chunks.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int32))))

        for ids in rows:
            held.append(ids)
            size += len(ids)
            if size > AT_ONCE:
                end()
                held, size = [], 0
        if held:
            end()
        return pa.table([pa.chunked_array([keys]), pa.chunked_array(chunks)], names=[key, "ids"])

    return finish


def _as_digests(spec: str) -> Finish:
    def finish(keys: pa.Array, rows: Iterator[np.ndarray]) -> pa.Table:
        """Ids, listed and decoded again, to hashes."""
        piece = pieces(spec)
        decimal = pa.array([b"%d," % i for i in range(len(piece))], pa.large_binary())
        out = [(len(ids), hashlib.sha256(join_pieces(ids, decimal)[:-1]).hexdigest(), hashlib.sha256(decode_ids(ids, piece).encode("utf-8")).hexdigest()) for ids in rows]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
        return pa.table([keys, *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


def _encoded(docs: DataFrame, key: str, text_col: str, path: str | None, finish: Callable[[str], Finish], out: str) -> DataFrame:
    """What `finish`, given the tokenizer, makes of the ids of each row of docs: `key` and the columns `out`."""
    spec = read_file(path or default_path())
    df = docs.select(F.col(f"`{key}`"), text_of(text_col).alias("text"))
    kind = df.schema[key].dataType
    added = added_tokens(spec)
    frequent, lists = frequent_words(df.select("text"), added)
    t = tokenizer(spec)
    encoded = [t.encode(w, add_special_tokens=False).ids for w in frequent]
    sizes, values = np.array([len(x) for x in encoded], np.uint32), np.array([i for x in encoded for i in x], np.uint32)
    held = StructType([StructField("block", LongType()), StructField("keys", ArrayType(kind)), *StructType.fromDDL("sizes binary, codes binary, list int, start long, words binary").fields])
    blocks = spill_table(df.mapInArrow(_split(added, key, frequent, lists), held))
    words = blocks.filter("words is not null").select("block", "list", "start", "words")
    ids = words.repartition("list").sortWithinPartitions("list").mapInArrow(_encode_lists(spec), "block long, start long, sizes binary, ids binary")
    coded = blocks.filter("codes is not null").select("block", "keys", "sizes", "codes")
    return coded.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_join(sizes, values, finish(spec)), schema(df, [key], out))


def encode(docs: DataFrame, key: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of docs: its key and ids (array<int>) of its whole text, without added special tokens.

    path: a byte-level BPE file of the tokenizers library. A null text is an empty one, which has no
    ids. Keys may repeat or be null; other columns are not read.
    """
    return _encoded(docs, key, text_col, path, lambda _: _as_ids(key), "ids array<int>")


def join_pieces(ids: np.ndarray, piece: pa.Array) -> bytes:
    """The pieces of ids, end to end; ids are places in the table of pieces."""
    parts = []
    for at in range(0, len(ids), AT_ONCE):
        met = piece.take(pa.array(ids[at : at + AT_ONCE]))
        ends = np.frombuffer(met.buffers()[1], np.int64)
        parts.append(met.buffers()[2].slice(ends[0], ends[len(met)] - ends[0]).to_pybytes())
    return b"".join(parts)


def decode_ids(ids: np.ndarray, piece: pa.Array) -> str:
    return join_pieces(ids, piece).decode("utf-8", errors="replace")


def _decode(spec: str, key: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        lean()
        piece = pieces(spec)
        for b in batches:
            texts = [decode_ids(ids.values.to_numpy(zero_copy_only=False), piece) for ids in b["ids"]]
            yield pa.RecordBatch.from_arrays([b[key], pa.array(texts, pa.string())], names=[key, "text"])

    return run


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """(key, text) from (key, ids): ids joined to their pieces; special tokens are kept.

    The pieces are the vocabulary, which does not grow with the data. Null ids are no ids; bytes
    that are not UTF-8 become U+FFFD.
    """
    spec = read_file(path or default_path())
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select(f"`{key}`", ids).mapInArrow(_decode(spec, key), schema(encoded, [key], "text string"))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded again.

    As decode(encode(docs)), hashed where a block's ids are joined: ids and texts are not moved again.
    A null text is an empty one, without ids; ids of documents may repeat or be null; texts of any
    length are read whole; other columns are not read; an empty table gives an empty result.
    """
    return _encoded(docs, "doc_id", "text", path, _as_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
