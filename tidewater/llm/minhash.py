"""Document fingerprints by one-permutation MinHash.

Every shingle of five words is hashed once; the top bits of the hash choose a bin and the
bin keeps the smallest rest.  An empty bin borrows from another, found by hashing its own
number again and again until a bin that has a value comes up (optimal densification).  Of
each bin four bits are kept, packed; the likeness of two fingerprints is the share of equal
bins, corrected for the share that agrees by chance.

``neighbours`` deals rows into runs of consecutive rows, each run with the first row of the
next one, so that a row and its successor meet in one task with one shuffle of the texts.
Rows are in order of id and then of a digest of the text, and runs are cut between any two,
so an id that many rows share, or none at all, fills as many runs as it needs.

Cases: null counts as empty; texts without words have the zero fingerprint, equal to each
other (likeness 1) and unlike any other (0); a text of fewer than five words is one
shingle; long texts are hashed in parts, so memory is bounded; repeated ids follow each
other by a digest of their texts, null ids come last; the only row of a table is its own
successor; an empty table gives an empty result.  Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_batches, materialise, release, slices, text_of

#: Words in a shingle, bins, bits kept of a bin.
WIDTH, BINS, BITS = 5, 512, 4
#: Words hashed at a time; attempts of densification looked up at a time.
PART, ATTEMPTS = 50_000, 32
#: Bytes of text in a run of consecutive rows (16 bytes for each run go through the driver), and in a task.
RUN_BYTES, TASK_BYTES = 4_000_000, 64_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """A polynomial hash of the bytes of each shingle, from one running sum, then mixed."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    up, down = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    width = min(WIDTH, len(words))
    first, end = starts[: len(words) - width + 1], starts[width:]
    return mix((sums[end] - sums[first]) * down[first] + np.uint64(width))


def bin_minima(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """By bin the smallest hash, and whether there is one; None for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return None
    least, has = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    for at in range(0, max(1, len(words) - WIDTH + 1), PART):
        h = np.sort(shingle_hashes(words[at : at + PART + WIDTH - 1]))
        bins = (h >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        b, h = bins[first], h[first]
        least[b] = np.where(has[b], np.minimum(least[b], h), h)
        has[b] = True
    return least, has


_attempts: list[np.ndarray] = []


def attempts(k: int) -> np.ndarray:
    """The k-th block of bins that each empty bin tries."""
    while len(_attempts) <= k:
        a = np.arange(len(_attempts) * ATTEMPTS, (len(_attempts) + 1) * ATTEMPTS, dtype=np.uint64)
        i = np.arange(BINS, dtype=np.uint64)[:, None]
        _attempts.append((mix(mix(i + np.uint64(1)) + a * _BASE) % np.uint64(BINS)).astype(np.int64))
    return _attempts[k]


def densified(least: np.ndarray, has: np.ndarray) -> np.ndarray:
    full = least.copy()
    if has.sum() == 1:
        full[:] = least[has][0]
        return full
    empty, k = np.flatnonzero(~has), 0
    while len(empty):
        tried = attempts(k)[empty]
        ok = has[tried]
        done = ok.any(axis=1)
        full[empty[done]] = least[tried[done, ok[done].argmax(axis=1)]]
        empty, k = empty[~done], k + 1
    return full


_SALT = np.arange(BINS, dtype=np.uint64) * _BASE


def signature(text: str) -> np.ndarray | None:
    """The kept bits of every bin; None for a text without words."""
    found = bin_minima(text)
    if found is None:
        return None
    return (mix(densified(*found) + _SALT) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def packed(sig: np.ndarray | None) -> str:
    if sig is None:
        return "0" * (BINS * BITS // 4)
    return (sig[0::2] << 4 | sig[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    chance = 1 / (1 << BITS)
    return max(0.0, (float(np.count_nonzero(a == b)) / BINS - chance) / (1 - chance))


def unpacked(text: str) -> np.ndarray | None:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack([raw >> 4, raw & 15], axis=1).reshape(-1) if raw.any() else None


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint string``, for every row."""

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        return {"fingerprint": pa.array([packed(signature(t)) for t in b.column(1).to_pylist()], pa.string())}

    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return map_batches(rows, batch, [T.StructField("fingerprint", T.StringType())], [id_col])


def runs_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[list[tuple[int, int]], int]:
    """Place in the order of ids and digest of the first row of every run, and bytes of all
    texts.  Spark's range partitioning of keys alone finds the cuts."""
    spark = docs.sparkSession
    text = text_of(text_col)
    keys = docs.select(_order(F.col(id_col)).alias("o"), F.xxhash64(text).alias("d"), F.octet_length(text).cast("long").alias("n"))
    keys = materialise(keys, "minhash-keys")
    size = keys.agg(F.sum("n")).first()[0] or 0
    n = max(size // RUN_BYTES + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = keys.select("o", "d").repartitionByRange(n, "o", "d").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("o", "d")).alias("k"))
    found = sorted((r.k.o, r.k.d) for r in ranged.collect())
    release(keys)
    return found, size


def _order(identity: Column) -> Column:
    """Descending ids, nulls last, as ascending numbers: the complement of the id."""
    return F.coalesce(F.bitwise_not(identity.cast("long")), F.lit((1 << 63) - 1))


def neighbours(
    docs: DataFrame, each: Callable[[Iterator[tuple[int, bool, int, str]]], Iterator[pa.RecordBatch]], schema: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What ``each`` makes of the rows of every run in order: run, whether the row is the first of
    the next run, id and text."""
    firsts, size = runs_of(docs, id_col, text_col)
    orders, digests = (np.array([x[k] for x in firsts[1:]], np.int64) for k in (0, 1))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def places(order: pa.Array, digest: pa.Array) -> pa.Array:
        """The run of a row; for the first of a run also -1 - the run before it."""
        o, d = (x.to_numpy(zero_copy_only=False) for x in (order, digest))
        low, high = np.searchsorted(orders, o, "left"), np.searchsorted(orders, o, "right")
        run = low.copy()
        head = np.zeros(len(o), bool)
        for k in np.flatnonzero(low < high).tolist():
            run[k] = low[k] + np.searchsorted(digests[low[k] : high[k]], d[k], "right")
            head[k] = run[k] > low[k] and digests[run[k] - 1] == d[k]
        return pa.array([[r, -r] if h else [r] for r, h in zip(run.tolist(), head.tolist(), strict=True)], pa.list_(pa.int64()))

    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), _order(F.col(id_col)).alias("o"), F.xxhash64(text).alias("d"))
    # the first row of all follows the last
    opens = (F.col("o") == firsts[0][0]) & (F.col("d") == firsts[0][1]) if firsts else F.lit(False)
    placed = keyed.withColumn("place", places("o", "d"))
    placed = placed.withColumn("place", F.when(opens, F.concat("place", F.array(F.lit(-len(firsts)).cast("long")))).otherwise(F.col("place")))
    rows = placed.select("id", "text", "o", "d", F.explode("place").alias("place"))
    rows = rows.select(F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("run"), (F.col("place") < 0).alias("ahead"), "o", "d", "id", "text")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES + 1)
    dealt = rows.repartition(tasks, "run").sortWithinPartitions("run", "ahead", "o", "d").select("run", "ahead", "id", "text")

    def run(batches):
        yield from each((r, a, i, t) for b in slices(batches) for r, a, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True))

    return dealt.mapInArrow(run, schema)


def pairs(rows: Iterator[tuple[int, bool, int, str]]) -> Iterator[tuple[int, str, object, str, object]]:
    """Each row of the runs with its successor: id, text, signature; the successor's text and signature."""
    run = last = own = None
    over = False
    for r, ahead, i, text in rows:
        if r != run:
            run, last, over = r, None, False
        if over:
            continue  # rows equal to the next run's first
        own = own if own is not None and own[0] == text else (text, signature(text))
        if last is not None:
            yield (*last, *own)
        over, last = ahead, (i, *own)


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its text with the last third replaced by the
    start of the successor's, and the likeness to that and to the successor."""

    def each(rows):
        names = [x.split()[0] for x in REPORT.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = []
        for i, text, sig, following, following_sig in pairs(rows):
            third = len(text) // 3
            edited = text[: len(text) - third] + following[:third]
            edited_sig = signature(edited)
            held.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(sig), packed(edited_sig), likeness(sig, edited_sig), likeness(sig, following_sig)))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return neighbours(docs, each, REPORT)
