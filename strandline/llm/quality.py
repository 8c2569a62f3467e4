"""Quality rules: a threshold table compiled into one Spark projection.  No user functions anywhere."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import words
from strandline.plans.shared import let

WINDOW = 5

#: Frequent function words of the languages in scope; written small, capitalised or in capitals.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by at are this from or an "
    "der die das und ist zu den von mit ein eine im nicht sich auf dem des für "
    "le la les de et un une des du en est que qui dans pour par sur au "
    "el los las y se del al con para su una es por lo como"
)


@dataclass(frozen=True)
class Rule:
    """A text of ``from_words`` words or more fails if ``metric`` lies outside [low, high]; an open side is None."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The table.  Ratios are per word, but for those named ``*_line_ratio`` (per line with a word).
RULES = (
    Rule("n_words", low=10, high=1_000_000),
    Rule("mean_word_chars", low=2.0, high=25.0),
    Rule("symbol_ratio", high=0.25),
    Rule("exclaim_ratio", high=0.3),
    Rule("stop_ratio", low=0.01, from_words=50),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _count(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]+", ""))


def _repeat_words(w: Column, size: int) -> Column:
    """Words inside a ``size``-word window that the text holds twice or more, the first one included.

    Most texts repeat no window: a hash-set distinct tells. For the others, windows are sorted with
    their places, those equal to a neighbour kept, and the union of the places' spans is measured.
    """

    def spans(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.least(F.lit(size), F.coalesce(F.get(places, j + 1) - p, F.lit(size))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        hits = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.sort_array(F.transform(hits, lambda x: x["i"])), spans)

    def count(hashes: Column) -> Column:
        places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(places), repeated))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) < 2, F.lit(0)).when(F.size(w) <= size, F.lit(0)).otherwise(let(hashes, count))


def metrics(text: Column, stop_words: str = STOP_WORDS, window: int = WINDOW) -> Column:
    """All figures the rules may use, as one struct, from one pass over the words of the whole text."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({form for x in stop_words.split() for form in (x, x.capitalize(), x.upper())})

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, window).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•‣]\s"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        _count(text, r"#*$%&|<>").cast("long").alias("n_symbols"),
        _count(text, "!").cast("long").alias("n_exclaim"),
    )


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, stop_words: str = STOP_WORDS) -> DataFrame:
    """``docs`` with the base figures, every ratio, ``base_failed``, ``failed_rules`` and ``kept``.

    One projection, no shuffle, no Python.  ``stop_words`` are those of four languages: for texts in others give
    their own, or rules without ``stop_ratio``, which rejects a longer text that holds none of them.  Null and empty texts have no words and fail the base rule;
    very long texts cost time in proportion to n log n of their words; ties and repeated rows are
    judged row by row; an empty table gives an empty result.  Input columns named like an output
    column are replaced.
    """
    out = docs.withColumn("__m", metrics(F.col(text), stop_words))
    m = lambda x: F.col(f"__m.{x}")
    flat = {x: m(f"w.{x}") for x in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")}
    flat |= {x: m(f"l.{x}") for x in ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines")}
    flat |= {"n_symbols": m("n_symbols"), "n_exclaim": m("n_exclaim")}
    out = out.withColumns(flat).drop("__m")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns(
        {
            "mean_word_chars": per("word_chars", "n_words"),
            "symbol_ratio": per("n_symbols", "n_words"),
            "exclaim_ratio": per("n_exclaim", "n_words"),
            "stop_ratio": per("n_stop_words", "n_words"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
            "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        }
    )
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        broken.append(F.when(bad & (F.col("n_words") >= r.from_words), F.lit(r.metric)))
    out = out.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
