"""Hybrid ranking: weighted reciprocal-rank fusion of keyword and vector lists, and suggestions woven in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.fulltext import keyword_search, search_index
from strandline.operators.vectors import top_k

CANDIDATES, SUGGESTIONS = 50, 5


@dataclass(frozen=True)
class Params:
    mode: str = "and"
    keyword_weight: float = 0.5
    semantic_weight: float = 1.0
    rrf_k: int = 60


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """(id, rank) from a list that a limit has bounded."""
    return rows.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))


def fuse(lists: list[tuple[DataFrame, float]], rrf_k: int = 60) -> DataFrame:
    """(id, score) of ranked lists (id, rank): the sum of weight / (k + rank)."""
    parts = [df.select("id", (F.lit(float(w)) / (F.col("rank") + rrf_k)).alias("s")) for df, w in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    return both.groupBy("id").agg(F.sum("s").alias("score"))


def rank(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float] | None, params: Params = Params(), where: Column | None = None, limit: int = 50, id: str = "doc_id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, score, keyword): the fused list, best first.  ``keyword`` marks ids that the keyword list holds.

    Each side gets the filter and keeps its best 50 before fusing; a side without weight is skipped, and so
    is the vector side where there is no query vector.  ``index`` (postings, stats) spares the keyword side the texts.
    """
    sides = []
    if params.keyword_weight > 0:
        if index is None:
            found = keyword_search(docs, query, params.mode, where, CANDIDATES, id, text).withColumnRenamed(id, "id")
        else:
            allowed = None if where is None else docs.where(where).select(F.col(id).alias("doc_id"))
            found = search_index(*index, query, params.mode, CANDIDATES, allowed).withColumnRenamed("doc_id", "id")
        sides.append((ranked(found, F.asc("bm25"), F.asc("id")).withColumn("keyword", F.lit(True)), params.keyword_weight))
    if params.semantic_weight > 0 and query_vector is not None:
        candidates = vectors
        if where is not None:
            candidates = vectors.join(docs.where(where).select(F.col(id).alias("vec_id")), "vec_id", "left_semi")
        found = top_k(candidates, query_vector, CANDIDATES).withColumnRenamed("vec_id", "id")
        sides.append((ranked(found, F.desc("score"), F.asc("id")).withColumn("keyword", F.lit(False)), params.semantic_weight))
    if not sides:
        return docs.select(F.col(id).alias("id"), F.lit(0.0).alias("score"), F.lit(False).alias("keyword")).limit(0)
    parts = [df.select("id", (F.lit(float(w)) / (F.col("rank") + params.rrf_k)).alias("s"), "keyword") for df, w in sides]
    both = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return both.groupBy("id").agg(F.sum("s").alias("score"), F.bool_or("keyword").alias("keyword")).orderBy(F.desc("score"), "id").limit(limit)


def rank_many(lists: dict[str, DataFrame], rankers: dict[str, Params], limit: int = 10) -> DataFrame:
    """(ranker, query_id, id, rank) of many rankers over many queries, from the three lists that they share.

    ``lists`` has ``and``, ``or`` and ``semantic`` as (query_id, id, rank), each up to the candidates of a side; a
    ranker is at most two rows of a small table, which meets the lists by name.
    """
    sides = []
    for name, p in rankers.items():
        sides += [(name, p.mode, float(p.keyword_weight), p.rrf_k)] * (p.keyword_weight > 0) + [(name, "semantic", float(p.semantic_weight), p.rrf_k)] * (p.semantic_weight > 0)
    spark = next(iter(lists.values())).sparkSession
    table = spark.createDataFrame(sides, "ranker string, side string, weight double, k int")
    rows = [df.where(F.col("rank") <= CANDIDATES).select(F.lit(side).alias("side"), "query_id", "id", "rank") for side, df in lists.items()]
    rows = rows[0].union(rows[1]).union(rows[2]).join(F.broadcast(table), "side")  # two rows a ranker
    fused = rows.groupBy("ranker", "query_id", "id").agg(F.sum(F.col("weight") / (F.col("k") + F.col("rank"))).alias("score"))
    place = F.row_number().over(Window.partitionBy("ranker", "query_id").orderBy(F.desc(F.round("score", 12)), "id"))
    return fused.withColumn("rank", place).where(F.col("rank") <= limit).select("ranker", "query_id", "id", "rank")


def interleave(history: DataFrame, suggestions: DataFrame, limit: int) -> DataFrame:
    """(pos, text, library): keyword matches of ``history(text, pos, keyword)`` first, then the rest of it and the
    suggestions (text, pos) in turn, history leading.  Suggested texts that history holds are dropped, five stay.
    """
    # one pass over both lists, each of them a result page: every part of it reads its source once
    rows = history.select("text", "pos", "keyword", F.lit(0).alias("src")).union(suggestions.select("text", "pos", F.lit(False), F.lit(1)))
    held = F.min("src").over(Window.partitionBy("text")) == 0
    rows = rows.withColumn("held", held).where("src = 0 or not held").withColumn("block", F.when(F.col("keyword"), 0).otherwise(1))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("block", "src").orderBy("pos"))).where(f"src = 0 or at <= {SUGGESTIONS}")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block", "at", "src"))
    return rows.withColumn("pos", place).where(F.col("pos") <= limit).select("pos", "text", (F.col("src") == 1).alias("library"))


def search(docs: DataFrame, vectors: DataFrame, catalogue: DataFrame, catalogue_vectors: DataFrame, query: str, query_vector: list[float] | None, limit: int = 5, params: Params = Params(), where: Column | None = None, id: str = "doc_id", text: str = "text", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(pos, text, library): what a user sees.  A filter, or a missing query vector, leaves suggestions out.

    Ranks ids first and joins texts to the few that stay.
    """
    top = rank(docs, vectors, query, query_vector, params, where, limit, id, text, index)
    top = top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))
    named = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(top, "id")
    if where is not None or query_vector is None:
        return named.select("pos", "text", F.lit(False).alias("library")).orderBy("pos")
    found = top_k(catalogue_vectors, query_vector, SUGGESTIONS + limit)
    found = found.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "vec_id")))
    offered = catalogue.select(F.col("id").alias("vec_id"), "text").join(found, "vec_id").select("text", "pos")
    return interleave(named.select("text", "pos", "keyword"), offered, limit)


def toy_rank(rows: DataFrame, query: str, limit: int = 4) -> DataFrame:
    """(id, score): 100 for texts that hold the query, plus shared five-letter stems; ties to the newest."""
    import re

    stems = sorted({w[:5] for w in re.findall(r"[a-z0-9]+", query.lower())})
    own = F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.substring(w, 1, 5)))
    score = F.when(F.contains(F.lower("text"), F.lit(query.lower())), 100).otherwise(0) + F.size(F.array_intersect(own, F.array(*map(F.lit, stems)).cast("array<string>")))
    return rows.select("id", "age", score.alias("score")).orderBy(F.desc("score"), "age", "id").limit(limit).select("id", "score")
