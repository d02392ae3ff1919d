"""Benchmark decontamination with an Aho-Corasick automaton.

Test items (questions and answers) are normalised to words; every run of ``window``
words of an item, or a shorter item as a whole, is a pattern between single spaces.  A
document is normalised the same way and scanned once; the words that any occurrence covers
are mapped back to offsets of the original text.

Words are runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased.
A separator byte is always ASCII, so the work is done on UTF-8.

Patterns are a table in the shared folder.  Up to ``block_bytes`` of patterns make one
automaton; a larger benchmark is dealt into as many blocks as needed, of which the driver and
each task hold one at a time: every block is one scan of the documents, which leaves what it
found by digest of the text, and so each worker builds each automaton once.

Cases: null or word-less texts have no words and no hits; null or word-less items are
skipped; a null item id is named by the empty string; repeated items count once by id;
an empty item table leaves every document clean; only id and text columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_batches, materialise, release, slices, text_of

#: UTF-8 bytes of patterns in one automaton (a node takes some 40 bytes, and so at most some 160 MB).
BLOCK_BYTES = 4_000_000

_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
#: A-Z to a-z, separators to space.
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: A run of words with its place in the text.
RUN = "array<struct<first:int,stop:int,start:int,end:int>>"
_RUN = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``pattern string``, ``item_ids array<string>``: each distinct window with the items that have it."""

    def batch(batches):
        for b in slices(batches, 1_000_000):
            ids, patterns = [], []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(len(words) - window + 1, min(1, len(words)))):
                    ids.append(item)
                    patterns.append(b" ".join([b"", *words[i : i + window], b""]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(patterns, pa.string())], ["item", "pattern"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), text_of(text_col).alias("text"))
    return rows.mapInArrow(batch, "item string, pattern string").groupBy("pattern").agg(F.collect_set("item").alias("item_ids"))


def blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The patterns in blocks of at most about ``block_bytes``, each with a name of its own and
    shared with the tasks until the next is asked for, and whether it is the only one."""
    spark = items.sparkSession
    windows = materialise(item_windows(items, window), "benchmark-windows")
    size = windows.agg(F.sum(F.octet_length("pattern") + 16 * F.size("item_ids"))).first()[0] or 0
    n = -(-size // block_bytes)
    try:
        for i in range(n):
            part = [(r.pattern, list(r.item_ids)) for r in windows.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == i).toLocalIterator()]
            if part:
                shared = spark.sparkContext.broadcast((uuid.uuid4().hex, part))
                yield shared, n == 1
                if n > 1:
                    shared.unpersist()
    finally:
        release(windows)


_held: dict[str, ahocorasick.Automaton] = {}


def automaton(name: str, patterns: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    """One per Python worker; the block before it goes."""
    if name not in _held:
        _held.clear()
        made = ahocorasick.Automaton()
        for k, (pattern, _) in enumerate(patterns):
            made.add_word(pattern, (k, pattern.count(" ") - 1))
        made.make_automaton()
        _held[name] = made
    return _held[name]


def scan(words: list[bytes], found: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[int]]:
    """Where patterns occur, as (first word, end word), and which."""
    normal = b" ".join([b"", *words, b""]).decode()
    ends = [(end, k, n) for end, (k, n) in found.iter(normal)] if words else []
    if not ends:
        return [], set()
    # how many words end before each matched space
    spaces = np.flatnonzero(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 0x20)
    after = np.searchsorted(spaces, [e for e, _, _ in ends]).tolist()
    return [(e - n, e) for e, (_, _, n) in zip(after, ends, strict=True)], {k for _, k, _ in ends}


def located(text: str, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words with their code point offsets, end exclusive, in the original text."""
    data = text.encode()
    at = [m.span() for m in _WORD.finditer(data)]
    # how many code points begin before each byte
    place = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [{"first": a, "stop": b, "start": int(place[at[a][0]]), "end": int(place[at[b - 1][1]])} for a, b in runs]


def digest_of(text_col: str) -> Column:
    return F.sha2(text_of(text_col), 256)


def hits(docs: DataFrame, shared: Broadcast, text_col: str) -> DataFrame:
    """``digest``, ``runs``, ``item_ids`` of each text in which patterns of a block occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, patterns = shared.value
        found = automaton(name, patterns)
        for b in slices(batches):
            out = []
            for digest, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs, which = scan(words_of(text), found)
                if which:
                    out.append((digest, located(text, union(runs)), sorted({i for p in which for i in patterns[p][1]})))
            if out:
                digests, runs, ids = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(runs, _RUN), pa.array(ids, pa.list_(pa.string()))], ["digest", "runs", "item_ids"])

    return docs.select(digest_of(text_col), text_of(text_col)).mapInArrow(run, f"digest string, runs {RUN}, item_ids array<string>")


def all_hits(docs: DataFrame, items: DataFrame, window: int, text_col: str, block_bytes: int) -> DataFrame | Broadcast | None:
    """What all blocks find, once for each text, or the only block, not scanned for yet; None
    without patterns."""
    tables: list[DataFrame] = []
    for shared, only in blocks(items, window, block_bytes):
        if only:
            return shared
        tables.append(materialise(hits(docs, shared, text_col).dropDuplicates(["digest"]), "benchmark-hits"))
    if not tables:
        return None
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs."""
    held = all_hits(docs, items, window, text_col, block_bytes)
    if held is None:
        return docs
    if isinstance(held, DataFrame):
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), digest_of(text_col).alias("digest"))
        return rows.join(held.select("digest"), "digest", "left_anti").select("_row.*")

    @F.arrow_udf(T.BooleanType())
    def clean(texts: pa.Array) -> pa.Array:
        found = automaton(*held.value)
        return pa.array([not scan(words_of(t.as_py()), found)[1] for t in texts], pa.bool_())

    return docs.where(clean(text_of(text_col)))


def find(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row: ``id_col``, ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings) and
    ``spans``, the hit passages in the original text."""
    held = all_hits(docs, items, window, text_col, block_bytes)
    several = isinstance(held, DataFrame)
    shared = None if several else held
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "stop", "start", "end")]))), T.StructField("item_ids", T.ArrayType(T.StringType()))]

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        sizes, runs, ids = [], [], []
        patterns = shared.value[1] if shared else None
        for text in b.column(b.num_columns - 1).to_pylist():
            words = words_of(text)
            hit, which = scan(words, automaton(shared.value[0], patterns)) if patterns else ([], set())
            sizes.append(len(words))
            runs.append(located(text, union(hit)) if hit else [])
            ids.append(sorted({i for p in which for i in patterns[p][1]}))
        return {"n_words": pa.array(sizes, pa.int64()), "runs": pa.array(runs, _RUN), "item_ids": pa.array(ids, pa.list_(pa.string()))}

    if several:
        sized = map_batches(docs.select(F.col(id_col), digest_of(text_col).alias("digest"), text_of(text_col).alias("_text")), lambda b: {"n_words": pa.array([len(words_of(t)) for t in b.column(2).to_pylist()], pa.int64())}, added[:1], [id_col, "digest"])
        rows = sized.join(held, "digest", "left").withColumns({"runs": F.coalesce("runs", F.array().cast(RUN)), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    else:
        rows = map_batches(docs.select(F.col(id_col), text_of(text_col).alias("_text")), batch, added, [id_col])
    merged = F.aggregate(F.array_sort("runs"), F.array().cast(RUN), _joined)
    return rows.withColumn("runs", F.when(F.size("runs") > 1, merged).otherwise(F.col("runs"))).select(
        id_col,
        "n_words",
        F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["stop"] - r["first"])).alias("n_hit"),
        "item_ids",
        F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
    )


def _joined(out: Column, r: Column) -> Column:
    """Runs in order, so far and the next one, merged if they touch or overlap."""
    last = F.element_at(out, -1)
    both = F.struct(last["first"].alias("first"), F.greatest(last["stop"], r["stop"]).alias("stop"), last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
    apart = (F.size(out) == 0) | (r["first"] > last["stop"])
    return F.when(apart, F.concat(out, F.array(r))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(both)))


def union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, with those that touch or overlap merged."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((a, e))
    return out


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document the counts and a digest of the items found."""
    return find(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
