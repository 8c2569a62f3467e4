"""Relevance evaluation: top-1, top-5 and mean reciprocal rank over all queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ranking import Params

DEPTH = 10


def metrics(results: DataFrame, relevant: DataFrame, queries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one per ``by``) from results(query_id, id, rank) and relevant(query_id, id).

    Only a query's first relevant result within the ten best counts; a query without one counts as 0.
    """
    by = by or []
    hits = results.where(F.col("rank") <= DEPTH).join(relevant.select("query_id", "id").distinct(), ["query_id", "id"])
    first = hits.groupBy(*by, "query_id").agg(F.min("rank").alias("rank"))
    every = queries.select("query_id").distinct()
    if by:
        every = every.join(F.broadcast(results.select(*by).distinct()))  # one row a configuration
    rows = every.join(first, [*by, "query_id"], "left")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg(share(F.col("rank") == 1).alias("top1"), share(F.col("rank") <= 5).alias("top5"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("*").alias("n_queries"))


def recall_at(results: DataFrame, relevant: DataFrame, queries: DataFrame, depth: int = 4) -> DataFrame:
    """One row (found, n_queries): queries with a relevant result among the ``depth`` best."""
    asked = queries.select("query_id").distinct()
    missed = misses(results, relevant, asked, depth).select("query_id", F.lit(True).alias("missed"))
    return asked.join(missed, "query_id", "left").agg(F.count_if(F.col("missed").isNull()).alias("found"), F.count("*").alias("n_queries"))


def median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The exact median of ``value`` per group."""
    return rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("runs"))


def misses(results: DataFrame, relevant: DataFrame, queries: DataFrame, depth: int = 5) -> DataFrame:
    """Queries without a relevant result among the ``depth`` best."""
    hits = results.where(F.col("rank") <= depth).join(relevant, ["query_id", "id"])
    return queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def grid() -> dict[str, Params]:
    """The 22 rankers that are compared: each side alone in its modes, and fused ones over mode, k and keyword weight."""
    out = {"keyword-and": Params("and", 1, 0), "keyword-or": Params("or", 1, 0), "semantic": Params("and", 0, 1), "default": Params()}
    for mode in ("and", "or"):
        for k in (5, 20, 60):
            for weight in (0.25, 0.5, 1.0):
                out[f"hybrid-{mode}-k{k}-w{weight}"] = Params(mode, weight, 1.0, k)
    return out


def checked_expectations(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, id) from queries(query_id, expected array<string>); an expected text that the pool lacks fails the job."""
    wanted = queries.select("query_id", F.explode("expected").alias("text"))
    rows = wanted.join(pool.select("id", "text"), "text", "left")
    return rows.select("query_id", F.coalesce("id", F.raise_error(F.concat(F.lit("not in the pool: "), "text"))).alias("id"))
