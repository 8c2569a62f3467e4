"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse text features.

One weight vector is shared by all ordered thresholds: P(grade > k) = sigmoid(w.x - t_k).  The expected
severity is the sum of those probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.plans.shared import materialize

_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> Counter:
    """Counts of lower-case words (bare) and of their first four and five letters (marked with a bar)."""
    words = Counter(_WORD.findall((text or "").lower()))
    heads: Counter = Counter()
    for w, n in words.items():
        if len(w) > 4:
            heads[w[:4] + "|"] += n
            if len(w) > 5:
                heads[w[:5] + "|"] += n
    return words + heads


class Tally:
    """Counts of the features of a vocabulary, over batches of texts."""

    def __init__(self, vocabulary: dict[str, int]):
        self.known = vocabulary
        self.starts = {f[:4] for f in vocabulary}  # a word whose first four letters are not here has no feature

    def __call__(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, logarithm of one plus the count), one entry per text and feature found in it."""
        known, starts, rows, cols, counts = self.known, self.starts, [], [], []
        for r, text in enumerate(texts):
            found: dict[int, int] = {}
            words = Counter(_WORD.findall((text or "").lower()))
            for w, n in [x for x in words.items() if x[0][:4] in starts]:
                for f in (w, w[:4] + "|", w[:5] + "|")[: 1 + (len(w) > 4) + (len(w) > 5)]:
                    k = known.get(f)
                    if k is not None:
                        found[k] = found.get(k, 0) + n
            rows += [r] * len(found)
            cols += found.keys()
            counts += found.values()
        return np.array(rows, np.int64), np.array(cols, np.int64), np.log1p(np.array(counts, np.float64))


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    toxic_from: int = 1  #: the lowest grade that counts as toxic

    def __post_init__(self):
        self.tally = Tally(self.vocabulary)

    def severities(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of a toxic grade) of every text: one sparse product."""
        rows, cols, values = self.tally(texts)
        scores = np.bincount(rows, weights=values * self.weights[cols], minlength=len(texts))
        over = 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))
        return over.sum(1), over[:, self.toxic_from - 1]

    def severity(self, text: str | None) -> tuple[float, float]:
        grade, toxic = self.severities([text])
        return float(grade[0]), float(toxic[0])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending thresholds) by Adam on the mean cumulative-link loss; sparse (row, col, value) triples."""
    k, n = n_grades - 1, len(grades)
    w, free = np.zeros(n_features), np.concatenate(([1.0], np.full(k - 1, 0.5)))  # first threshold, then log-gaps
    m, v, lr = np.zeros(n_features + k), np.zeros(n_features + k), 0.1
    for step in range(1, rounds + 1):
        gaps = np.exp(free[1:])
        t = free[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        z = np.bincount(rows, weights=vals * w[cols], minlength=n)[:, None] - t[None, :]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        # probability of the grade itself is a difference of neighbouring cumulative ones
        full = np.concatenate((np.ones((n, 1)), p, np.zeros((n, 1))), axis=1)
        at = np.arange(n)
        mass = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = np.concatenate((np.zeros((n, 1)), p * (1 - p), np.zeros((n, 1))), axis=1)
        up, down = slope[at, grades] / mass, slope[at, grades + 1] / mass
        g_score = -(up - down) / n
        g_t = np.zeros(k)
        np.add.at(g_t, np.maximum(grades - 1, 0), np.where(grades > 0, up, 0.0) / n)
        np.add.at(g_t, np.minimum(grades, k - 1), -np.where(grades < k, down, 0.0) / n)
        g_free = np.concatenate(([g_t.sum()], [g_t[j:].sum() * gaps[j - 1] for j in range(1, k)]))
        grad = np.concatenate((np.bincount(cols, weights=vals * g_score[rows], minlength=n_features) + l2 * w / max(1, n_features), g_free))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, free = w - move[:n_features], free - move[n_features:]
    return w, free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def _one_of_each(rows: DataFrame, max_rows: int) -> DataFrame:
    """One row per id and text; of more than ``max_rows``, one text of every id and then those with the smallest hash."""
    rows = rows.dropDuplicates(["id", "text"]).withColumn("h", F.xxhash64("text"))
    keys = materialize(rows.select("id", "h"), "labelled-keys")  # the sort below holds numbers, not texts
    first = keys.groupBy("id").agg(F.min("h").alias("first"))
    keys = keys.join(F.broadcast(first), "id").orderBy(F.col("h") != F.col("first"), F.xxhash64("id", "h"), "id", "h").limit(max_rows)
    return rows.join(F.broadcast(keys.select("id", "h").distinct()), ["id", "h"]).drop("h")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_features: int = 4096, least_docs: int = 5, max_grades: int = 16, id: str = "doc_id", text: str = "text", label: str = "toxic", quality: str = "quality") -> Model:
    """Fit on at most ``max_rows`` labelled documents: those whose id has the smallest hash.

    Grades come from the labels alone.  ``label`` is 0 for harmless and grows with severity; where ``labels``
    has ``quality``, harmless documents have two grades, of good quality (1, or unknown) and of poor quality
    (0), and the toxic ones come above.  Candidate features stand in ``least_docs`` of the documents and
    lean to either class by more than three standard errors; those that lean most are kept.  The driver gets
    ``max_features`` of them, and each sampled document's counts of those only.  Thresholds of toxic grades are
    raised, if need be, so that a text without any feature is toxic with a probability of one quarter at most.

    An id with several labels has the largest; a document that repeats an id and its text counts once; an id's
    other texts have its label too.  Null labels and ids are left out; null and empty texts have no features;
    very long ones are read whole; ties among features go by name, and among rows by a hash.  Without both
    classes, as on an empty table, the model finds nothing toxic.  Other columns are not read.
    """
    step, toxic_from = F.col(label).cast("int"), 1 + (quality in labels.columns)
    if quality in labels.columns:
        step = F.when(step > 0, step + 1).when(F.col(quality).cast("int") == 0, 1).otherwise(0)
    some = labels.where(F.col(label).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.greatest(F.lit(0), F.least(step, F.lit(max_grades - 1))).alias("y"))
    # by id before it is counted: labels that repeat ids must not narrow the range
    some = materialize(some.groupBy("id").agg(F.max("y").alias("y")), "label-ids")
    # a hash range that holds about twice the bound, so that the sort by hash behind it is small at every size
    share = min(1.0, 2 * max_rows / max(1, some.count()))
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) * F.lit(2.0**-53)
    some = some.where(place <= share).orderBy(place, "id").limit(max_rows)
    some = materialize(some, "labels")
    # at most max_rows pairs of numbers: small enough to broadcast whatever the corpus holds
    rows = materialize(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id"), "labelled")
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = materialize(_one_of_each(rows, max_rows), "labelled-once")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def drain() -> Iterator[pa.RecordBatch]:
            names = sorted({*held[0], *held[1]})
            for at in range(0, len(names), 100_000):
                part = names[at : at + 100_000]
                cols = [pa.array(part, pa.string()), pa.array([held[0][x] for x in part], pa.int64()), pa.array([held[1][x] for x in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["f", "neg", "pos"])
            held[0].clear(), held[1].clear()

        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("y")):
                held[int(y.as_py() >= toxic_from)].update(features(text.as_py()).keys())
                if len(held[0]) + len(held[1]) > 500_000:
                    yield from drain()
        yield from drain()

    n = rows.agg(F.count_if(F.col("y") < toxic_from).alias("neg"), F.count_if(F.col("y") >= toxic_from).alias("pos")).first()
    neg, pos = n["neg"], n["pos"]
    if not neg or not pos:
        return Model({}, np.zeros(0), np.full(1, 50.0))
    counts = rows.select("text", "y").mapInArrow(count, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    both = (F.col("neg") + F.col("pos")) / (neg + pos)
    z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(both * (1 - both) * (1 / pos + 1 / neg) + 1e-12)
    best = counts.where(F.col("neg") + F.col("pos") >= least_docs).withColumn("z", z).where(F.abs("z") > 3).orderBy(F.desc(F.abs("z")), "f").limit(max_features)
    vocabulary = {r["f"]: k for k, r in enumerate(best.collect())}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(vocabulary)
        for batch in batches:
            rows, cols, values = tally(x.as_py() for x in batch.column("text"))
            ends = np.searchsorted(rows, np.arange(1, len(batch)))
            parts = [pa.array(np.split(x, ends), pa.list_(t)) for x, t in ((cols, pa.int64()), (values, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *parts], names=["id", "y", "cols", "vals"])

    kind = dict(rows.dtypes)
    data = rows.select("id", "y", "text").mapInArrow(encode, f"id {kind['id']}, y int, cols array<bigint>, vals array<double>").toPandas()
    data["n"] = data["cols"].map(len)
    data = data.sort_values(["id", "y", "n"], kind="stable").reset_index(drop=True)
    lengths, grades = data["n"].to_numpy(np.int64), data["y"].to_numpy(np.int64)
    triples = np.repeat(np.arange(len(data)), lengths), np.concatenate([np.asarray(x, np.int64) for x in data["cols"]]), np.concatenate([np.asarray(x, np.float64) for x in data["vals"]])
    weights, thresholds = fit_ordinal(*triples, grades, len(vocabulary), int(grades.max()) + 1, l2=0.01)
    # a text without any feature is toxic with a probability of one quarter at most
    return Model(vocabulary, weights, np.maximum(thresholds, np.where(np.arange(len(thresholds)) < toxic_from - 1, -np.inf, np.log(3.0))), toxic_from)


def score(docs: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` plus ``severity`` (expected grade), ``p_toxic`` (probability of a toxic grade) and ``toxic`` (at ``least`` or more).

    Whole texts count, each by itself, very long ones too; null and empty texts are scored by the thresholds
    alone.  Equal texts score alike, so repeated rows and ties need no rule.  Input columns named like an output
    column are replaced, others go through; an empty table gives an empty result.
    """

    @F.pandas_udf("severity double, p_toxic double")
    def grade(texts: pd.Series) -> pd.DataFrame:
        severity, toxic = model.severities(texts.tolist())
        return pd.DataFrame({"severity": severity, "p_toxic": toxic})

    out = docs.drop("severity", "p_toxic", "toxic").withColumn("__s", grade(F.col(text)))
    return out.withColumns({"severity": F.col("__s.severity"), "p_toxic": F.col("__s.p_toxic"), "toxic": F.col("__s.p_toxic") >= least}).drop("__s")
