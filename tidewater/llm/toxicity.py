"""Toxicity by weak supervision.

Many voters look at a document: lexicons of insults, groups of words and word stems that
set marked documents apart, patterns of address and shouting, and the marks themselves as
one annotator.  A generative model of two classes estimates how often each voter fires in
each class (its accuracy) and how the voters correlate within a class; correlated voters
share their weight.  Its posterior labels train a linear classifier over single words,
stems and patterns, and that classifier alone scores texts.

Fitting takes a sample of marked rows, drawn by a hash of the id, of at most about
``TOXIC`` and ``CLEAN`` rows of each mark, and at most ``FEATURES`` words and stems: the size
of the model, and so what is broadcast or reaches the driver, doesn't grow with the tables.
Scoring covers every row and the whole of each text.

Cases: null and empty texts get the classifier's base score; marks that are null or whose
id is missing teach nothing, of several marks of an id the largest counts; without marked
rows of both kinds the lexicons alone score; repeated rows give repeated rows; only the
named columns are read.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_batches, materialise, release, slices, text_of

#: Rows that teach: marked toxic, marked clean.  Words and stems that become features, and groups that vote.
TOXIC, CLEAN, FEATURES, GROUPS = 5_000, 10_000, 400, 12
#: A mined word is in this share of the toxic rows and in so many at least, this many times likelier there,
#: and the rows times the logarithm of that come to so much, which words that are there by chance don't reach.
SHARE, LEAST, TIMES, STRENGTH = 0.004, 5, 6.0, 25.0
#: How much more a toxic row counts in the classifier's fit, as clean ones are many more.
BALANCE = 2.0
THRESHOLD = 0.7
#: Words and stems that a task counts before it passes the counts on.
HELD = 300_000

#: Common insults by language.
LEXICONS = {
    "en": "idiot stupid moron loser pathetic disgusting worthless scum trash clown dumb fool jerk creep liar filthy garbage imbecile coward vermin bastard bitch asshole dickhead scumbag dumbass jackass retard whore slut pig swine rat parasite leech lowlife degenerate maggot dimwit halfwit cretin hypocrite crap shit fuck fucking bullshit",
    "fr": "imbécile stupide crétin abruti débile minable ordure dégoûtant bouffon raclure salaud salope pourriture menteur lâche vermine connard connasse con conne enculé putain merde bâtard pute idiot idiote taré attardé parasite racaille clochard hypocrite ignoble méprisable",
    "de": "idiot idiotin dumm dumme blöd blöde trottel depp versager abschaum widerlich erbärmlich dreck drecksau lügner feigling ungeziefer schwachkopf arschloch scheiße scheiss wichser hurensohn schlampe fotze mistkerl vollpfosten hohlkopf schwein sau miststück parasit penner spinner verlierer",
    "es": "idiota estúpido estúpida imbécil tonto tonta basura patético asqueroso asquerosa escoria payaso inútil perdedor mentiroso cobarde alimaña gilipollas cabrón puta puto mierda pendejo maricón zorra cerdo cerda subnormal desgraciado parásito rata retrasado miserable",
}
_SEEDS = {w for words in LEXICONS.values() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of a stem.
STEMS = (3, 4, 5, 6, 7)
#: Marks in front of what isn't a whole word: a stem, a pattern, a lexicon.
STEM, PATTERN, LEXICON = "^", "!", "#"
_ADDRESS = re.compile(r"\b(?:you|your|du|ihr|tu|vous|eres|usted)\W+(?:\w+\W+){0,2}(?:" + "|".join(sorted(map(re.escape, _SEEDS))) + r")\b")
_MASKED = re.compile(r"\b\w\*{2,}\w")


@lru_cache(maxsize=1)
def _case() -> np.ndarray:
    """By code point 1 for a lower-case letter, 2 for a capital, 0 for others."""
    return np.array([2 if c.isupper() else int(c.islower()) for c in map(chr, range(sys.maxunicode + 1))], np.int8)


def shouts(text: str) -> bool:
    """Whether most letters of a text are capitals."""
    if len(text) < 20 or text.islower():
        return False
    kinds = np.bincount(_case()[np.frombuffer(text.encode("utf-32-le"), np.uint32)], minlength=3)
    return bool(kinds[2] > kinds[1])


def evidence(text: str) -> set[str]:
    """The distinct words of a text, its stems (marked once more where two words share one, and
    again where three do), lexicons and patterns."""
    low = text.lower()
    words = set(_WORD.findall(low))
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    found = words | {STEM + s for s in stems} | {STEM * 2 + s for s, n in stems.items() if n > 1} | {STEM * 3 + s for s, n in stems.items() if n > 2}
    seeds = words & _SEEDS
    found.update(LEXICON + k for k, v in _LEXICON_SETS.items() if not seeds.isdisjoint(v))
    if seeds and _ADDRESS.search(low):
        found.add(PATTERN + "address")
    if "**" in text and _MASKED.search(text):
        found.add(PATTERN + "masked")
    if text.count("!!") >= 3:
        found.add(PATTERN + "bangs")
    if shouts(text):
        found.add(PATTERN + "shout")
    return found


_LEXICON_SETS = {k: frozenset(v.split()) for k, v in LEXICONS.items()}
_FIXED = [*(LEXICON + k for k in LEXICONS), *(PATTERN + k for k in ("address", "masked", "bangs", "shout"))]


@dataclass(frozen=True)
class LabelModel:
    """What the voters tell: the posterior of the second class by row, how often each voter
    fires in each class, how voters correlate within a class, and the share of the second."""

    posterior: np.ndarray
    rates: np.ndarray
    correlations: np.ndarray
    prior: float


def generative_model(votes: np.ndarray, weight: np.ndarray, start: np.ndarray, rounds: int = 4, steps: int = 60) -> LabelModel:
    """Fits two classes to ``votes`` (0 or 1 by row and voter), each row standing for ``weight``
    documents.  ``start`` is a first guess of the posterior.

    Rounds alternate between expectation-maximisation with the voters' weights held, and
    taking the voters' correlations within the classes: a voter that moves with others
    counts as one over one plus the sum of its positive correlations."""
    posterior, share = start, np.ones(votes.shape[1])
    for _ in range(rounds):
        for _ in range(steps):
            mass = np.stack([weight * (1 - posterior), weight * posterior])
            rate = (mass @ votes + 0.5) / (mass.sum(axis=1, keepdims=True) + 1.0)
            prior = (mass.sum(axis=1) + 1.0) / (mass.sum() + 2.0)
            fit = (votes * share) @ np.log(rate).T + ((1 - votes) * share) @ np.log1p(-rate).T + np.log(prior)
            new = 1 / (1 + np.exp(np.clip(fit[:, 0] - fit[:, 1], -50, 50)))
            moved, posterior = float(np.abs(new - posterior).max()), new
            if moved < 1e-6:
                break
        within = np.zeros((votes.shape[1],) * 2)
        for y in range(2):
            centred = votes - rate[y]
            spread = np.sqrt(rate[y] * (1 - rate[y]))
            within += prior[y] * ((centred * mass[y][:, None]).T @ centred) / max(mass[y].sum(), 1) / np.outer(spread, spread)
        np.fill_diagonal(within, 0)
        share = 1 / (1 + np.clip(within, 0, 1).sum(axis=1))
    return LabelModel(posterior, rate, within, float(prior[1]))


class Classifier:
    """Weights of words, stems and patterns."""

    def __init__(self, weights: dict[str, float], base: float, label_model: LabelModel | None = None):
        self.weights, self.base, self.label_model = weights, base, label_model

    def score(self, text: str) -> float:
        x = self.base + sum(self.weights[f] for f in sorted(self.weights.keys() & evidence(text)))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


#: What scores where nothing can be learnt.
LEXICON_ONLY = Classifier({LEXICON + k: 4.0 for k in LEXICONS}, -3.0)


def sampled(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str, text_col: str) -> DataFrame:
    """``y``, ``_text`` of the rows that teach."""
    marked = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & teaches).groupBy(id_col).agg(F.max("toxic").cast("int").alias("y"))
    n = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, TOXIC / n.get(1, 1)))).otherwise(F.lit(min(1.0, CLEAN / n.get(0, 1))))
    drawn = marked.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("toxicity")), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select(F.col(id_col), text_of(text_col).alias("_text")).join(F.broadcast(drawn), id_col)
    return materialise(rows.select("y", "_text"), "toxicity-sample")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many rows of each mark a word or stem is, counted within the task."""
    held: Counter[tuple[int, str]] = Counter()

    def out() -> pa.RecordBatch:
        names = ["y", "f", "n"]
        return pa.RecordBatch.from_arrays([pa.array([y for y, _ in held], pa.int32()), pa.array([f for _, f in held], pa.string()), pa.array(list(held.values()), pa.int64())], names)

    for b in slices(batches):
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.update((y, f) for f in evidence(text) if f[0] not in (LEXICON, PATTERN))
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def mined(sample: DataFrame, toxic: int, clean: int) -> list[str]:
    """Words and stems that set the toxic rows apart, the ``FEATURES`` strongest.  Of stems and
    words that are in equally many rows and begin alike the longest stands for all."""
    each = sample.select("y", "_text").mapInArrow(_counted, "y int, f string, n long")
    both = each.groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("m"))
    odds = (F.col("n") + 0.5) / (toxic + 1.0) / ((F.col("m") + 0.5) / (clean + 1.0))
    often = both.where(F.col("n") >= max(LEAST, SHARE * toxic)).withColumns({"odds": odds, "base": F.ltrim("f", F.lit(STEM))})
    strong = often.withColumn("strength", F.col("n") * F.log("odds")).where((F.col("odds") >= TIMES) & (F.col("strength") >= STRENGTH))
    alike = [F.col("n"), F.col("m"), F.substring("base", 1, min(STEMS)), F.col("f").startswith(STEM * 2)]
    one = strong.groupBy(*alike).agg(F.max("strength").alias("strength"), F.min_by("f", F.struct(-F.length("base"), F.length("f"), F.col("f"))).alias("f"))
    return [r.f for r in one.orderBy(F.desc("strength"), "f").limit(FEATURES).collect()]


def learn(docs: DataFrame, labels: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    sample = sampled(docs, labels, teaches, id_col, text_col)
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        release(sample)
        return LEXICON_ONLY
    words = mined(sample, n[1], n[0])
    features = [*words, *_FIXED]
    place = {f: k for k, f in enumerate(features)}
    groups = [g for g in (words[k::GROUPS] for k in range(GROUPS)) if g]
    # voters: the mark, what is fixed, and groups of what was mined
    voters = [*(frozenset([f]) for f in _FIXED), *map(frozenset, groups)]

    def look(b: pa.RecordBatch) -> dict[str, object]:
        found = [place.keys() & evidence(t) for t in b.column(1).to_pylist()]
        bits = [sum(1 << i for i, v in enumerate(voters, 1) if not f.isdisjoint(v)) for f in found]
        return {
            "votes": pa.array([y | x for y, x in zip(b.column(0).to_pylist(), bits, strict=True)], pa.int32()),
            "at": pa.array([sorted(place[x] for x in f) for f in found], pa.list_(pa.int32())),
        }

    voted = materialise(map_batches(sample, look, [T.StructField("votes", T.IntegerType()), T.StructField("at", T.ArrayType(T.IntegerType()))], ["y"]), "toxicity-votes")
    seen = voted.groupBy("votes").count().collect()
    patterns = np.array([r.votes for r in seen], np.int64)
    votes = (patterns[:, None] >> np.arange(len(voters) + 1) & 1).astype(float)
    model = generative_model(votes, np.array([r["count"] for r in seen], float), np.where(votes[:, 0] == 1, 0.9, 0.05))
    known = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, model.posterior, strict=True)], "votes int, q double")
    row = array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(len(features) - 1)), lambda k: F.array_contains("at", k).cast("double")))
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (BALANCE * F.col("q")).alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("weight"))))
    data = voted.join(F.broadcast(known), "votes").select(row.alias("features"), both.alias("b")).select("features", "b.label", "b.weight").where("weight > 1e-6")
    data = materialise(data.select("label", "weight", "features").coalesce(4), "toxicity-labels")
    fitted = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=60).fit(data)
    for table in (sample, voted, data):
        release(table)
    return Classifier({f: float(w) for f, w in zip(features, fitted.coefficients.toArray(), strict=True) if w}, float(fitted.intercept), model)


def score(docs: DataFrame, classifier: Classifier, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns in ``keep`` with ``score``, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(classifier.weights, classifier.base))

    def batch(b: pa.RecordBatch) -> dict[str, object]:
        texts: Iterable[str] = b.column(b.num_columns - 1).to_pylist()
        return {"score": pa.array(list(map(shared.value.score, texts)), pa.float64())}

    return map_batches(docs.select(*keep, text_of(text_col).alias("_text")), batch, [T.StructField("score", T.DoubleType())], keep)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    classifier = learn(docs, labels, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return score(rows, classifier, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
