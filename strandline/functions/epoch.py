"""Times, durations and paths of captured commands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_epoch_ms(text: Column) -> Column:
    """Seconds with a fraction behind ``.`` or ``,`` as milliseconds; null unless a positive, finite number."""
    seconds = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    fine = (seconds > 0) & (seconds < 9.2e12) & ~F.isnan(seconds)
    return F.when(fine, F.floor(F.round(seconds * 1_000_000) / 1000)).cast("long")


def duration_ms(start_ms: Column, end_ms: Column) -> Column:
    """Null unless both ends are known and in order."""
    return F.when(end_ms >= start_ms, end_ms - start_ms)


@F.pandas_udf(T.StringType())
def valid_utf8(raw: pd.Series) -> pd.Series:
    """Bytes as text; each run of bytes that are not UTF-8 becomes one U+FFFD, a genuine U+FFFD stays."""

    def clean(b):
        return re.sub("[\udc80-\udcff]+", "\ufffd", b.decode("utf-8", "surrogateescape"))

    return pd.Series([None if b is None else clean(bytes(b)) for b in raw], dtype=object)


def with_git_root(rows: DataFrame, roots: DataFrame, cwd: str = "cwd") -> DataFrame:
    """``git_root``: the longest known root that is the directory or lies above it.

    Each path is spread into its ancestors, so the match is an equi-join on the root, never a prefix scan.
    """
    parts = F.split(F.col(cwd), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    paths = rows.select(cwd).where(F.col(cwd).isNotNull()).distinct().withColumn("root", F.explode(above))
    best = paths.join(roots.select("root").distinct(), "root").groupBy(cwd).agg(F.max_by("root", F.length("root")).alias("git_root"))
    return rows.drop("git_root").join(best, cwd, "left")
