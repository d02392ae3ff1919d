"""Token counts with a digest cache.

The content as the tokenizer sees it is digested; the digest of content and the digest of
the tokenizer's file together are the key of a stored count.  Only distinct contents that
the cache does not have are encoded; their counts are appended to the cache, and every
row then takes its count from there.

The normaliser of the piece tokenizer turns spaces into its word sign and does nothing
else, so two texts that agree after that have equal counts.

Moving text once is the whole cost: rows are thinned within each input partition before
they are dealt by digest, so that a content that a third of all rows share is sent about once
per input partition; a left-anti join on the digests then drops hits.  Within a dealt
partition rows are sorted by digest, so the first of each is known without holding others.

Writers need no lock: two that miss the same content both append its count, and readers take
one row of each key.  Rows of a key that disagree are an error, never a guess.

Cases: null counts as the empty text, which has no tokens; whole texts are encoded;
repeated rows and repeated contents share one cache entry; an empty table gives an empty
result and an unchanged cache; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import materialise, shared_dir, text_of

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


@lru_cache(maxsize=2)
def model(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    """Digest of the text after the tokenizer's normaliser."""
    return F.unhex(F.sha2(F.translate(text, " ", "▁"), 256))


#: Digests that a task remembers while it thins.
REMEMBERED = 100_000


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows whose digest is one of the ``REMEMBERED`` last ones: most repeats, not all."""
    seen: OrderedDict[bytes, None] = OrderedDict()
    for b in batches:
        keep = []
        for k, digest in enumerate(b.column(0).to_pylist()):
            if digest in seen:
                seen.move_to_end(digest)
                continue
            seen[digest] = None
            keep.append(k)
            if len(seen) > REMEMBERED:
                seen.popitem(last=False)
        if keep:
            yield b.take(pa.array(keep))


def first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each digest, of rows in order of digest."""
    last = None
    for b in batches:
        keep = []
        for k, digest in enumerate(b.column(0).to_pylist()):
            if digest != last:
                keep.append(k)
                last = digest
        if keep:
            yield b.take(pa.array(keep))


def misses(docs: DataFrame, cache: DataFrame, version: str, text_col: str = "text") -> DataFrame:
    """``content_digest``, ``_text``: once each content that the cache has no count for."""
    rows = docs.select(content_digest(text_of(text_col)).alias("content_digest"), text_of(text_col).alias("_text"))
    schema = rows.schema
    known = cache.where(F.col("tokenizer_digest") == version).select("content_digest")
    missing = rows.mapInArrow(thinned, schema).join(known.hint("shuffle_hash"), "content_digest", "left_anti")
    return missing.repartition("content_digest").sortWithinPartitions("content_digest").mapInArrow(first_of_each, schema)


def encode_counts(missing: DataFrame, path: str, version: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                counts = [len(x) for x in model(path).encode(part.column(1).to_pylist(), num_threads=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                    ["content_digest", "tokenizer_digest", "n_tokens"],
                )

    return missing.mapInArrow(run, CACHE_SCHEMA)


def open_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored rows; a cache that is not there yet is made, empty."""
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache_path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def counts_of(cache: DataFrame, version: str) -> DataFrame:
    """``content_digest``, ``n_tokens``: one row for each content, however many writers stored it."""
    own = cache.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("_most"))
    agreed = F.when(F.col("n_tokens") == F.col("_most"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("the cache has two counts for one content")).cast("long"))
    return own.select("content_digest", agreed.alias("n_tokens"))


def count(
    docs: DataFrame, path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` for every row.

    ``cache_path`` names a stored cache that outlives the call; without it, a cache of this
    call's own is made in the shared folder."""
    spark = docs.sparkSession
    cache_path = cache_path or f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    version = tokenizer_digest(path)
    cache = open_cache(spark, cache_path)
    encode_counts(misses(docs, cache, version, text_col), path, version).write.mode("append").parquet(cache_path)
    # written, so that the join below has plain exchanges on both sides and a hot content can be split
    stored = materialise(counts_of(spark.read.schema(CACHE_SCHEMA).parquet(cache_path), version), "token-counts")
    text = text_of(text_col)
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("content_digest"))
    return rows.join(stored, "content_digest", "left").select(id_col, "n_bytes", "n_tokens")


def report(docs: DataFrame, path: str, limit: int = 4096, cache_path: str | None = None) -> DataFrame:
    return count(docs, path, cache_path).withColumn("over_limit", F.col("n_tokens") > limit)
