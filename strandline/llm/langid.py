"""Language identification by rank-order profiles of n-grams.

A profile is a language's most frequent n-grams in order.  A document is compared by out-of-place
distance: for each of its own most frequent n-grams, how far its rank lies from the profile's, or the
profile's length where the profile lacks it.  The nearest profile wins.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BITS = 21  #: a code point has 21 bits, so three fit into one signed 64-bit number
_kinds: list[np.ndarray] = []


def _alphabet() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a combining mark, which belongs to a word but is no letter, 0 for the rest."""
    if not _kinds:
        table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
        for i in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(i))
            table[i] = 2 if kind[0] == "L" else kind == "Mn"
        _kinds.append(table)
    return _kinds[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of the lower-cased words (one border mark between them), as numbers, and their counts.

    Words are runs of letters and combining marks; a text without any letter has none.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    kinds = _alphabet()[codes]
    if not (kinds == 2).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    letter = kinds > 0
    codes = np.concatenate(([ord(" ")], np.where(letter, codes, ord(" ")), [ord(" ")]))
    gap = codes == ord(" ")
    codes = codes[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]  # gaps that follow gaps go
    one = codes[codes != ord(" ")]
    two = (codes[:-1] << BITS) | codes[1:]
    three = (two[:-1] << BITS) | codes[2:]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def top(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent grams in order; ties by their number."""
    if len(values) > 4 * n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.argsort(-counts, kind="stable")][:n]


@dataclass
class Profiles:
    """Languages in code-point order, each with its ranked grams."""

    langs: list[str]
    ranked: list[np.ndarray]
    size: int

    def __post_init__(self):
        self.by_value = [(np.sort(r), np.argsort(r)) for r in self.ranked]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 for a perfect match of ranks and 0 if nothing is shared; ``und`` scores 0."""
        values, counts = grams(text or "")
        if not len(values) or not self.langs:
            return "und", 0.0
        own = top(values, counts, self.size)
        ranks, best = np.arange(len(own)), (1 << 62, 0)
        for k, (values, places) in enumerate(self.by_value):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            best = min(best, (int(np.where(values[at] == own, np.abs(places[at] - ranks), self.size).sum()), k))
        return self.langs[best[1]], float(1.0 - best[0] / (len(own) * self.size))


def learn(docs: DataFrame, size: int = 300, max_langs: int = 1000, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all rows of ``docs`` that have a language and a text; none, and every prediction is ``und``.

    Each task counts the grams of its own rows; Spark adds the counts and ranks them.  What reaches the
    driver is at most ``size`` grams for each of at most ``max_langs`` languages (more is an error).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        weight = 0

        def drain() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                values, where = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
                counts = np.bincount(where, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                part = grams(text.as_py())
                held.setdefault(lang, []).append(part)
                weight += len(part[0])
                if weight > 4_000_000:
                    yield from drain()
                    weight = 0
        yield from drain()

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
    best = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= size)
    got = best.select("lang", "gram", "place").limit(size * max_langs + 1).toPandas()
    if len(got) > size * max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(got["lang"].unique())
    return Profiles(langs, [got[got["lang"] == x].sort_values("place")["gram"].to_numpy(np.int64) for x in langs], size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``; each row is judged by its whole text alone.

    Null, empty and letterless texts give ``und`` with score 0; a tie goes to the language first in
    code-point order, and among n-grams to the smaller number.  Very long texts cost memory in proportion to
    themselves.  Repeated rows are judged alike, each by itself.  Input columns named like an output column are
    replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        made = [profiles.predict(x) for x in texts]
        return pd.DataFrame({"lang_pred": pd.Series([a for a, _ in made], dtype=object), "score": [b for _, b in made]})

    out = docs.drop("lang_pred", "score").withColumn("__p", predict(F.col(text)))
    return out.withColumns({"lang_pred": F.col("__p.lang_pred"), "score": F.col("__p.score")}).drop("__p")
