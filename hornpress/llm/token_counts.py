"""Token counts by a digest cache.

A stored table has the count for each (content digest, tokenizer-version digest). Of the texts
that it lacks each distinct one is encoded once, and the counts are appended to it. Every byte of a
text matters to its count, so that the normal form of a content is its UTF-8, null as empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornpress.llm.common import lean, shared_dir, skew_join, spill_table, table, text_of
from hornpress.llm.tokens import Splitter, added_tokens, default_path, read_file, tokenizer, version_digest

LIMIT = 1024
CACHE = "content string, version string, n_tokens long"
#: Hashes of missing digests are broadcast up to this number (some 5 MB); beyond it texts meet the digests by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Words whose counts a worker keeps, their characters in all, and the longest of them.
KEPT_WORDS, KEPT_LENGTH, KEPT_WORD = 1_000_000, 16_000_000, 256


class WordCounts(dict):
    """Word to its number of tokens; the words of a text are encoded independently of each other."""

    def __init__(self, spec: str) -> None:
        self.encode, self.length = tokenizer(spec).encode, 0

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word, add_special_tokens=False).ids)
        if len(word) <= KEPT_WORD:
            if len(self) >= KEPT_WORDS or self.length >= KEPT_LENGTH:
                self.clear()
                self.length = 0
            self[word] = n
            self.length += len(word)
        return n


def _count(spec: str, added: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        split, counts = Splitter(added), WordCounts(spec)
        for b in batches:
            found = [sum(sum(map(counts.__getitem__, words)) for words in split.chunks(text.as_py())) for text in b["text"]]
            yield pa.RecordBatch.from_arrays([b["content"], pa.array(found, pa.int64())], names=["content", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that are stored for a tokenizer version."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE)
    return stored.filter(F.col("version") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, text_col: str = "text", path: str | None = None, distinct: DataFrame | None = None) -> DataFrame:
    """Appends the counts that `cache` lacks, and returns their digests (content).

    distinct: the digests of docs, if they are known. Only texts whose digest is missing are encoded.
    """
    spark = docs.sparkSession
    spec = read_file(path or default_path())
    version = version_digest(spec)
    text = text_of(text_col)
    content = F.sha2(text, 256)
    digests = docs.select(content.alias("content")).distinct() if distinct is None else distinct.select("content")
    missing = spill_table(digests.join(read_cache(spark, cache, version), "content", "left_anti"))
    texts = docs.select(content.alias("content"), text.alias("text"))
    if missing.count() <= BROADCAST_DIGESTS:
        texts = texts.join(F.broadcast(missing.select(F.xxhash64("content").alias("h")).distinct()), F.xxhash64("content") == F.col("h"), "left_semi")
    texts = texts.groupBy("content").agg(F.first("text").alias("text")).join(missing.hint("shuffle_hash"), "content", "left_semi")
    counted = texts.mapInArrow(_count(spec, added_tokens(spec)), "content string, n_tokens long")
    counted.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    return missing


def count_tokens(docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit, cached; new counts are appended to `cache`.

    The count of a whole text under a byte-level BPE file, without added special tokens. A null
    text counts as an empty one (0 tokens). Ids may repeat or be null; equal texts are encoded once;
    texts of any length are read whole; other columns are not read; an empty table gives an empty
    result. cached: whether the count was stored before.
    """
    spark, version = docs.sparkSession, version_digest(read_file(path or default_path()))
    text = text_of(text_col)
    content = F.sha2(text, 256)
    keyed = spill_table(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")))
    distinct = spill_table(keyed.groupBy("content").agg(F.count("*").alias("degree")))
    missing = fill(docs, cache, text_col, path, distinct)
    known = distinct.join(missing.withColumn("new", F.lit(True)), "content", "left")
    counts = known.join(read_cache(spark, cache, version), "content")
    return skew_join(keyed, counts, "content", "degree").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("new").isNull().alias("cached"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, which has a sixteenth of the contents stored when all documents are counted."""
    docs, cache = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    fill(docs.filter(F.sha2(text_of(), 256) < "1"), cache)
    return count_tokens(docs, cache)
