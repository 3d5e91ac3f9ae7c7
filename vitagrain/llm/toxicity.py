"""Toxicity by maximum-scoring segments of token log-odds.

Fitting. For words, and the first four and five characters of longer words as
backing-off units, the documents that hold them are counted, in the corpus and
among the labelled. A unit's log-odds of toxic against clean documents use a
Dirichlet prior that follows the whole corpus (PRIOR counts in its proportions,
FLOOR at least) and are kept where they exceed Z standard deviations. The strongest LEXICON_WORDS
of them are the model; every other token costs DRIFT, so that a background
text has a negative expectation.

Scoring. Ruzzo and Tompa's scan finds all maximal scoring segments of a text in
linear time; runs without a weighted token are one step. Scores are scaled by
the Karlin-Altschul lambda, the root of E[exp(lambda * score)] = 1 under the
clean frequencies, and compared with the log of the text's length as an
extreme-value law asks; a logistic curve over best segment, length and further
significant segments gives the score. The curve is fitted out of fold: each of
FOLDS parts of the labelled rows (by the hash that names the held-out rows) is
measured with a lexicon and a scale learnt from the other parts, so that the curve
sees segments as strong as those of texts that chose no word of the lexicon.
Where the other parts lack a class, the lexicon of all rows stands in.

Labels are read from at most SAMPLE rows, taken by the hash of the id among the
rows that may be learnt from; corpus counts cover all documents. The labels and
the lexicon are broadcast: both sizes are bounded by these parameters.

Defined cases: null and empty texts get the curve's value without a segment, so
they have a score too; repeated rows and null keys are scored alike; without
both classes among the labels, every score is 0; an empty table gives no rows;
texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.llm.common import fresh, id_text, shared_folder, written

SAMPLE = 50_000
LEXICON_WORDS = 50_000
PRIOR = 1000.0
FLOOR = 0.5
Z = 2.5
DRIFT = 0.05
#: Parts of the learnable rows: the remainders of the id's hash that are not held out.
FOLDS = 4
STEMS = (5, 4)
WORD = re.compile(r"\w+")
COUNTED = ["n", *(f"{kind}_{fold}" for fold in range(FOLDS) for kind in ("clean", "toxic"))]
COUNTS = "unit string, " + ", ".join(f"{c} long" for c in COUNTED)


def units(text: str) -> list[str]:
    """The lower-case words of a text."""
    return WORD.findall(text.lower())


def stems(word: str) -> list[str]:
    """Backing-off units of a word: its first characters, marked so that no word equals them."""
    return [word[:n] + "~" for n in STEMS if len(word) > n]


def remainder(key) -> F.Column:
    """crc32 of the id as text modulo 5."""
    return F.crc32(key.cast("string").cast("binary")) % (FOLDS + 1)


def held_out(key) -> F.Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5; a null id is not learnt from."""
    return F.coalesce(remainder(key) == 0, F.lit(True))


def training_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic and fold (from 0) of at most `sample` rows outside the held-out fold."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    rows = rows.withColumn("fold", (remainder(F.col("doc_id")) - 1).cast("int"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            seen = [Counter() for _ in COUNTED]
            for text, toxic, fold in zip(*part.columns):
                words = set(units(text.as_py()))
                words.update([s for w in words for s in stems(w)])
                seen[0].update(words)
                if (label := toxic.as_py()) is not None:
                    seen[1 + 2 * fold.as_py() + label].update(words)
            for counter in seen:
                counter[""] = counter.total()  # the row of totals
            names = list(seen[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[w] for w in names], pa.int64()) for c in seen)],
                names=["unit", *COUNTED])


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    scale: float
    curve: tuple[float, float, float, float]


def segments(words: list[str], weights: dict[str, float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first word, end, score), in one pass.

    Only weighted words are visited; the unweighted run before each costs drift a word.
    """
    get = weights.get
    found: list[tuple[float, float, int, int]] = []  # sum ahead of it, sum at its end, first, end
    total, last = 0.0, 0
    for i, word in enumerate(words):
        weight = get(word)
        if weight is None:
            continue
        total -= drift * (i - last)
        last = i + 1
        left, first, total = total, i, total + weight
        if weight <= 0:
            continue
        right = total
        while True:  # join with earlier segments that a better start and a worse end allow
            k = len(found) - 1
            while k >= 0 and found[k][0] >= left:
                k -= 1
            if k < 0 or found[k][1] >= right:
                found.append((left, right, first, i + 1))
                break
            left, first = found[k][0], found[k][2]
            del found[k:]
    return [(first, end, right - left) for left, right, first, end in found]


class Weights(dict):
    """The weight of a word: its own or that of a stem, the farthest from zero; None without any."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def get(self, word):
        if word in self:
            return self[word]
        found = [w for u in (word, *stems(word)) if (w := self.lexicon.get(u)) is not None]
        weight = max(found, key=abs) if found else None
        if len(self) >= 300_000:
            self.clear()
        self[word] = weight
        return weight


def features(text: str, weights: Weights, scale: float) -> tuple[float, float, float]:
    """Scaled best segment, log length and scaled further segments; zeros without a segment."""
    words = units(text)
    found = sorted((s for _, _, s in segments(words, weights)), reverse=True)
    if not found:
        return 0.0, 0.0, 0.0
    size = math.log(len(words) + 1)
    return scale * found[0], size, sum(max(0.0, scale * s - size) for s in found[1:])


def karlin_lambda(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * scores)) = 1, by bisection."""
    def excess(x: float) -> float:
        return float(share @ np.expm1(np.minimum(x * scores, 700.0)))

    if not (scores > 0).any() or float(share @ scores) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Intercept and slopes by Newton steps with a small ridge on the slopes."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(pull), x.T @ (y - p) - pull * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


Learnt = tuple[dict[str, float], float]


def _featured(batches: Iterator[pa.RecordBatch], learnt: list[Learnt]) -> Iterator[pa.RecordBatch]:
    """Features of labelled texts, each by the lexicon and scale of its fold."""
    weights = [Weights(lexicon) for lexicon, _ in learnt]
    for batch in batches:
        made = np.array([features(text.as_py(), weights[fold.as_py()], learnt[fold.as_py()][1])
                         for text, _, fold in zip(*batch.columns)], float).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([*(pa.array(made[:, k]) for k in range(3)), batch.column(1)],
                                         names=["best", "size", "more", "toxic"])


def learn(counts: DataFrame, total: dict[str, int], folds: list[int]) -> Learnt | None:
    """Lexicon and scale by the labelled rows of these folds; None if they lack a class."""
    n_clean, n_toxic = (sum(total[f"{kind}_{k}"] for k in folds) for kind in ("clean", "toxic"))
    if not n_clean or not n_toxic:
        return None
    clean, toxic = (sum((F.col(f"{kind}_{k}") for k in folds), F.lit(0)) for kind in ("clean", "toxic"))
    prior = FLOOR + F.col("n") * (PRIOR / total["n"])

    def log_odds(mine: F.Column, all_mine: int) -> F.Column:
        return F.log((mine + prior) / F.greatest(F.lit(all_mine + PRIOR) - mine - prior, F.lit(1e-9)))

    spread = F.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    scored = counts.where((F.col("unit") != "") & (clean + toxic > 0)).select(
        "unit", ((clean + prior) / (n_clean + PRIOR)).alias("share"),
        (log_odds(toxic, n_toxic) - log_odds(clean, n_clean)).alias("weight"), spread.alias("spread"))
    strong = scored.withColumn("z", F.abs(F.col("weight") / F.col("spread"))).where(F.col("z") >= Z)
    rows = strong.orderBy(F.desc("z"), "unit").limit(LEXICON_WORDS).collect()  # at most LEXICON_WORDS rows
    words = [r for r in rows if not r.unit.endswith("~")]
    share = np.array([r.share for r in words])
    share = np.append(share, max(0.0, 1 - share.sum()))
    return {r.unit: r.weight for r in rows}, karlin_lambda(np.array([r.weight for r in words] + [-DRIFT]), share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of all documents and the sampled labels; None without both classes."""
    spark = docs.sparkSession
    chosen = F.broadcast(training_labels(labels, sample))  # at most `sample` rows of numbers
    marked = id_text(docs).join(chosen, "doc_id", "left").select("text", "toxic", "fold")
    counts = marked.mapInArrow(_counts, COUNTS).groupBy("unit").agg(*(F.sum(c).alias(c) for c in COUNTED))
    labelled = sum((F.col(c) for c in COUNTED[1:]), F.lit(0))
    counts = written(counts.where((labelled > 0) | (F.col("unit") == "")), shared_folder(spark), "counts")
    total = counts.where("unit = ''").first()
    whole = learn(counts, total.asDict(), list(range(FOLDS))) if total is not None else None
    if whole is None:
        return None
    others = [learn(counts, total.asDict(), [k for k in range(FOLDS) if k != fold]) or whole for fold in range(FOLDS)]
    sampled = marked.where("toxic IS NOT NULL").mapInArrow(
        lambda batches: _featured(batches, others), "best double, size double, more double, toxic int").toPandas()
    beta = logistic(sampled[["best", "size", "more"]].to_numpy(), sampled["toxic"].to_numpy(float))
    return Model(*whole, tuple(float(b) for b in beta))


def with_score(docs: DataFrame, model: Model | None, out: str = "score", text: str = "text") -> DataFrame:
    """The frame with `out`: the probability of the toxic label, 0 without a model."""
    if model is None:
        return docs.withColumn(out, F.lit(0.0))

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, (base, *slopes) = Weights(model.weights), model.curve
        for column in columns:
            raw = [base + sum(a * b for a, b in zip(slopes, features(t.as_py() or "", weights, model.scale)))
                   for t in column]
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(raw, float), -30, 30))), pa.float64())

    return docs.withColumn(out, score(docs[text]))


def passages(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """doc_id, first word, end and scaled score beyond log length of each significant passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(model.weights)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                words = units(text.as_py())
                size = math.log(len(words) + 1)
                rows += [(key.as_py(), first, end, model.scale * s - size)
                         for first, end, s in segments(words, weights) if model.scale * s - size > least]
            kinds = [pa.int64()] * 3 + [pa.float64()]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["doc_id", "first_word", "end_word", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, first_word long, end_word long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)
    scored = with_score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored under 0.5, with their own columns."""
    out = fresh(docs, "toxic_score")
    return with_score(docs, fit(docs, labels), out).where(F.col(out) < 0.5).drop(out)
