"""Toxicity by a counterfactual-regularised classifier.

A logistic regression over the presence of words and of their beginnings is fitted to a bounded sample of labelled documents. For each sampled document
that mentions an identity term, the term is swapped for another of its group, or left out, and the change of the score is
penalised: a mention of a group alone must not move the score. The words are chosen by Spark from counts over the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstselect.llm.common import clear_of, pin, slices, tidy

SAMPLE_ROWS = 20_000
WORDS = 600
STEMS = (3, 4, 5, 6)
LEAST_DOCS = 5
#: By how many standard errors a word's share has to differ between the labels.
LEAST_Z = 4.0
_WORD = re.compile(r"[^\W\d_]+")

# Identity terms; the terms of a line can stand for each other in a sentence.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("mexican", "chinese", "indian", "arab", "turkish", "french", "german", "spanish"),
    ("old", "young"),
    ("disabled", "deaf", "blind"),
    ("immigrant", "refugee", "citizen"),
)


def words_of(text: str | None) -> set[str]:
    """The different words of a text (runs of letters, lower-cased) and their beginnings, with a star: stems take many endings."""
    return with_stems(set(_WORD.findall(text.lower()))) if text else set()


def with_stems(words: set[str]) -> set[str]:
    return words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS))


class Model:
    """Weights of words and a bias; the score is the logistic function of their sum."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        found = self.weights.keys() & words_of(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + math.fsum(self.weights[w] for w in found)))))


def swaps(words: set[str], groups: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> list[tuple[str, str | None]]:
    """(term, what takes its place) for every identity term among ``words``: each other term of its group, and nothing."""
    out = []
    for group in groups:
        for term in group:
            if term in words:
                out += [(term, other) for other in group if other not in words] + [(term, None)]
    return out


def fit_weights(
    rows: list[tuple[list[str], int]], vocabulary: list[str], groups=IDENTITY_TERMS, swap_weight: float = 5.0, decay: float = 0.3, steps: int = 400
) -> Model:
    """Logistic loss (both labels weighing the same) + decay of weights + ``swap_weight`` times the mean squared change of the sum under swaps, by gradient descent."""
    if not rows:
        return Model({}, -3.0)
    index = {w: i for i, w in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    y = np.array([label for _, label in rows], np.float32)
    # Rows share their swaps, of which there are as many as pairs of terms; the penalty needs only the sum of their outer products.
    times: Counter[tuple[str, str | None]] = Counter()
    for i, (words, _) in enumerate(rows):
        for w in words:
            if w in index:
                x[i, index[w]] = 1
        times.update(swaps(set(words) & index.keys(), groups))
    changes = np.zeros((len(times), len(vocabulary)))
    for change, (term, other) in zip(changes, times, strict=True):
        for sign, word in ((-1, term), (1, other)):
            for part in with_stems({word} - {None}) & index.keys():
                change[index[part]] += sign
    outer = (changes.T * np.array(list(times.values()))) @ changes / max(1, times.total())
    # Both labels weigh the same, however many rows each has.
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32)
    w, b = np.zeros(len(vocabulary)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        error = (p - y) * each
        g = x.T @ error + decay * w / len(rows) + swap_weight * 2 * (outer @ w)
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.1 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (math.sqrt(vb) + 1e-8)
    return Model({k: float(w[i]) for k, i in index.items()}, float(b))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, words: int = WORDS
) -> Model:
    """The classifier learned from the labelled rows where ``learn`` (an expression over doc_id) holds.

    At most ``sample_rows`` different texts are taken, those with the smallest hashes, half of them of either label if there are as
    many; the ``words`` that tell the labels apart best, if they do so clearly, and the identity terms, are the features. Only word lists over this
    vocabulary reach the driver. Rows without text, label or doc_id teach nothing; where labels of an id differ, the larger counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    texts = docs.select(F.col("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = texts.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")).join(known, "doc_id")
    hashed = hashed.groupBy("h").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    each = sample_rows // 2
    chosen = hashed.where("y = 1").orderBy("h").limit(each).unionByName(hashed.where("y = 0").orderBy("h").limit(each))
    # One row for each sampled text: at most sample_rows small rows are broadcast.
    sampled = texts.join(F.broadcast(chosen), "doc_id").where(F.xxhash64("text") == F.col("h")).dropDuplicates(["doc_id"])
    split = F.array_remove(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), "")
    sampled = sampled.select("h", "y", split.alias("words"))
    stems = [F.expr(f"transform(filter(words, w -> length(w) >= {n}), w -> concat(left(w, {n}), '*'))") for n in STEMS]
    sampled = pin(sampled.select("h", "y", F.array_distinct(F.concat("words", *stems)).alias("words")))
    total = {r.y: r.n for r in sampled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    one, zero = total.get(1, 0), total.get(0, 0)
    if not one or not zero:
        return Model({}, 3.0 if one else -3.0)
    counts = sampled.select("y", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("y").alias("with"), F.sum(F.lit(1) - F.col("y")).alias("without")
    )
    a, b = F.col("with") / one, F.col("without") / zero
    spread = F.sqrt((F.col("with") + F.col("without") + 1.0) / (one + zero)) * (1.0 / one + 1.0 / zero) ** 0.5
    counts = counts.where(F.col("with") + F.col("without") >= LEAST_DOCS).withColumn("z", F.abs(a - b) / spread).where(F.col("z") >= LEAST_Z)
    picked = [r.word for r in counts.orderBy(F.desc("z"), "word").limit(words).collect()]
    terms = [t for g in IDENTITY_TERMS for t in g]
    vocabulary = list(dict.fromkeys([*picked, *terms]))
    only = F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]))
    rows = [(r.words, int(r.y)) for r in sampled.select("h", "y", only.alias("words")).orderBy("h").collect()]
    model = fit_weights(rows, vocabulary)
    return Model({w: v for w, v in model.weights.items() if abs(v) > 1e-6}, model.bias)


def scored(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = False, name: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` from 0 to 1 for the whole text, in place of one of that name; null and empty texts have the score of no words."""
    keep = [c for c in docs.columns if c.lower() != name.lower() and (keep_text or c != text)]

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                scores = pa.array([model.score(t) for t in part.column(text).to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), scores], [*keep, name])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in keep), f"`{name}` double"])
    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]).mapInArrow(tidy(over), kinds)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, with all their columns."""
    name = clear_of(docs.columns, "score")
    return scored(docs, model, text, keep_text=True, name=name).where(F.col(name) < threshold).drop(name)
