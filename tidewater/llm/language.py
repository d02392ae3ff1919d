"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams in order.  A document's own
most frequent n-grams are ranked the same way, and the out-of-place distance to a profile
is the sum over them of how far the ranks lie apart, or of the largest rank where the
profile lacks the n-gram.  The language with the smallest distance is predicted.

N-grams are one to three letters long, lower-cased, and don't cross a word; a word is
padded with one blank at either end.  An n-gram is packed exactly into 64 bits.

Profiles are learnt in Spark from all rows of the ``LANGUAGES`` most frequent languages, and
the bound of a distance is an exact decile over all of them; only row counts, profiles
(languages x ranks) and histograms of distances reach the driver.

Cases: null, empty and letterless texts are ``und`` with score 0; whole texts are ranked;
ties between n-grams go to the smaller n-gram, between languages to the first by name (so
does, with score 0, a text of which no profile has any n-gram); rows without language teach
nothing; if nothing can be learnt every text is ``und``; only the named columns are read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.llm.common import map_batches, materialise, release, slices, text_of

#: Ranks of a profile, n-grams of a document that are compared, longest n-gram.
RANKS, COMPARED, LONGEST = 400, 300, 3
#: The most frequent languages that have profiles; a column that holds anything has no more.
LANGUAGES = 200
UNKNOWN = "und"
#: A text belongs to none of the languages if its smallest distance is beyond this share of the way
#: from the ninth decile of the teaching documents' to 1; documents that give a bound of their own.
BEYOND, LEAST = 0.4, 30
#: Bins of a histogram of distances; the decile is looked for among the distances of its bin.
BINS = 4096
#: Stands for the blank in packed n-grams; not 0, so that n-grams of different lengths differ.
BLANK = 1


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point 1 for a letter, 2 for a mark, which belongs to a word with it, 0 for others."""
    return np.array([" LM".find(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.int8).clip(0)


def ngrams(text: str) -> np.ndarray:
    """All n-grams of a text, packed: 21 bits a letter, BLANK at a word's end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    kind = letters()[codes]
    if not (kind == 1).any():
        return np.empty(0, np.int64)
    keep = kind > 0
    # every run of other characters becomes one blank, and one stands at either end
    padded = np.full(len(codes) + 2, BLANK, np.int64)
    padded[1:-1] = np.where(keep, codes, BLANK)
    here = np.ones(len(padded), bool)
    here[1:] = (padded[1:] != BLANK) | (padded[:-1] != BLANK)
    c = padded[here]
    inner = c != BLANK
    out, gram, valid = [c[inner]], c, np.ones(len(c), bool)
    for n in range(2, LONGEST + 1):
        gram = (gram[:-1] << 21) | c[n - 1 :]
        valid = valid[:-1] & (inner[n - 2 : -1] if n > 2 else True)
        out.append(gram[valid])
    return np.concatenate(out)


def ranked(grams: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:most]]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    grams: np.ndarray  # all n-grams that any profile has, sorted
    ranks: np.ndarray  # by language and n-gram; RANKS where a profile lacks it
    bounds: tuple[float, ...] = ()  # of the smallest distance, by size()

    def distances(self, text: str) -> tuple[int, np.ndarray]:
        """How many n-grams are compared, and the distance to each language, from 0 to 1."""
        own = ranked(ngrams(text), COMPARED)
        if not len(own) or not self.languages:
            return 0, np.ones(len(self.languages))
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        place = np.where(self.grams[at] == own, self.ranks[:, at], RANKS)
        return len(own), np.where(place < RANKS, np.abs(place - np.arange(len(own))), RANKS).sum(axis=1) / (RANKS * len(own))

    def predict(self, text: str) -> tuple[str, float]:
        """Language, and how much nearer it is than the next: 0 where they tie, 1 where the
        document agrees with it exactly."""
        n, away = self.distances(text)
        if not n or not self.languages:
            return UNKNOWN, 0.0
        order = np.argsort(away, kind="stable")
        first = float(away[order[0]])
        second = float(away[order[1]]) if len(order) > 1 else 1.0
        return self.languages[order[0]], (1 - first / second if second > 0 else 0.0)

    def knows(self, text: str) -> bool:
        """Whether the nearest language is no farther than its own documents may be."""
        n, away = self.distances(text)
        return n > 0 and float(away.min(initial=1.0)) <= self.bounds[size(n)]


def size(n: int) -> int:
    """Texts with about as many n-grams have one bound: few n-grams lie farther off."""
    return n.bit_length() if n < COMPARED else COMPARED.bit_length() + 1


def learn(docs: DataFrame, teaches: Column | None = None, lang_col: str = "lang", text_col: str = "text", bounded: bool = True) -> Profiles:
    """Profiles from the rows for which ``teaches`` holds and that have a language; with bounds,
    for which these rows are read once more, if ``bounded``."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (teaches if teaches is not None else F.lit(True)))
    lang = F.col(lang_col).cast("string")
    frequent = [r[0] for r in rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    if not frequent:
        return Profiles((), np.empty(0, np.int64), np.empty((0, 0), np.int64))
    rows = rows.where(lang.isin(frequent))

    def count(batches):
        held: dict[str, dict[int, int]] = {}
        for b in slices(batches, 500_000):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(ngrams(text))
            for lang, parts in by.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                own = held.setdefault(lang, {})
                for v, n in zip(values.tolist(), counts.tolist(), strict=True):
                    own[v] = own.get(v, 0) + n
            if sum(map(len, held.values())) > 100_000:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    counted = rows.select(lang, F.col(text_col).cast("string").alias("_text")).mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < RANKS).collect()
    languages = tuple(sorted({r.lang for r in top}))
    grams = np.array(sorted({r.gram for r in top}), np.int64)
    ranks = np.full((len(languages), len(grams)), RANKS, np.int64)
    for r in top:
        ranks[languages.index(r.lang), np.searchsorted(grams, r.gram)] = r.rank
    profiles = Profiles(languages, grams, ranks)
    if not bounded or not languages:
        return profiles
    return replace(profiles, bounds=bounds(rows, profiles, text_col))


def bounds(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> tuple[float, ...]:
    """How far a text may be from its nearest language, by size; sizes of too few documents take the bound of all."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def nearest(b: pa.RecordBatch) -> dict[str, object]:
        found = [shared.value.distances(t) for t in b.column(0).to_pylist()]
        return {"size": pa.array([size(n) if n else None for n, _ in found], pa.int32()), "away": pa.array([float(a.min()) if n else None for n, a in found], pa.float64())}

    # not as a function of a column, which a condition on its result would have computed once more
    added = [T.StructField("size", T.IntegerType()), T.StructField("away", T.DoubleType())]
    measured = map_batches(docs.select(text_of(text_col).alias("_text")), nearest, added, []).where("size is not null")
    bin_of = F.floor(F.col("away") * BINS)
    values = materialise(measured.groupBy("size", "away").agg(F.count("*").alias("n")), "language-distances")
    try:
        binned = values.groupBy("size", bin_of.alias("bin")).agg(F.sum("n").alias("n")).collect()
        classes = [None, *sorted({r["size"] for r in binned})]  # None: all sizes
        of = lambda rows, k: [r for r in rows if k is None or r["size"] == k]
        count = {k: sum(r.n for r in of(binned, k)) for k in classes}
        place = {k: (9 * count[k] + 9) // 10 for k in classes}  # from 1
        at = {k: _reached(((r.bin, r.n) for r in of(binned, k)), place[k]) for k in classes if count[k]}
        near = values.where(bin_of.isin(sorted({b for b, _ in at.values()}))).select("size", "away", "n", bin_of.alias("bin")).collect()
    finally:
        release(values)
    decile = {k: _reached(((r.away, r.n) for r in of(near, k) if r.bin == b), place[k] - before)[0] for k, (b, before) in at.items()}
    chosen = [decile.get(k if count.get(k, 0) >= LEAST else None) for k in range(size(COMPARED) + 1)]
    return tuple(0.0 if q is None else q + BEYOND * (1 - q) for q in chosen)


def _reached(counts: Iterable[tuple[float, int]], place: int) -> tuple[float, int]:
    """The value at a place, from 1, among values that occur so often, and how many lie before it."""
    before = 0
    for value, n in sorted(counts):
        if before + n >= place:
            return value, before
        before += n
    raise ValueError("no such place")


def _rows(held: dict[str, dict[int, int]]):
    for lang, own in held.items():
        names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), pa.array([lang])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([names, pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["lang", "gram", "n"])


def identify(docs: DataFrame, profiles: Profiles, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with ``lang_pred`` and ``score``, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        found = [shared.value.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
        return {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([s for _, s in found], pa.float64())}

    rows = docs.select(*keep, text_of(text_col).alias("_text"))
    return map_batches(rows, batch, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)


def keep_known(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose language is unknown: no letters, or too far from every
    profile.  The profiles have bounds."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf(T.BooleanType())
    def known(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.knows(t.as_py()) for t in texts], pa.bool_())

    return docs.where(known(text_of(text_col)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    profiles = learn(docs, ~held_out(), bounded=False)
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(marked, profiles, ["doc_id", "held_out"])
