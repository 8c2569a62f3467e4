"""Keyword search: prefix terms under AND or OR, ranked by BM25 over the whole corpus.

Two forms with equal results: a scan that counts each document's matches where it lies (no shuffle but
for the top list), and postings sorted by term for corpora that are searched again and again.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import queryset
from strandline.plans.shared import materialize, spread

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def _folding() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their base letters, by Unicode decomposition."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case, without accents.  Texts of ASCII alone skip the folding, which costs most."""
    text = F.coalesce(text, F.lit(""))
    folded = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{Mn}+", "")
    return F.regexp_extract_all(F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


_FOLD = str.maketrans(ACCENTED, PLAIN)


def query_words(query: str) -> list[str]:
    """A query's words, folded exactly like documents; operators and punctuation in it mean nothing."""
    folded = "".join(c for c in query.translate(_FOLD) if unicodedata.category(c) != "Mn")
    return re.findall(r"[^\W_]+", folded.lower())


def _idf(n: int, df: int) -> float:
    idf = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
    return idf if idf > 0 else LEAST_IDF


def _score(counts: list[Column], length: Column, idfs: list[float], average: float) -> Column:
    norm = F.lit(K1) * (1 - B + B * length / F.lit(average or 1.0))
    return -reduce(lambda a, b: a + b, [F.lit(i) * c * (K1 + 1) / (c + norm) for i, c in zip(idfs, counts)])


def keyword_search(docs: DataFrame, query: str, mode: str = "and", where: Column | None = None, limit: int | None = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, bm25) of the best documents, lower being better, ties by id; of all that match, if ``limit`` is None.

    ``where`` narrows what is returned, before the limit, but not the corpus that the weights come from.
    A word matches every token that it begins; a word given twice counts twice.  No words: no rows.
    """
    words = query_words(query)
    if not words:
        return docs.select(F.col(id), F.lit(0.0).alias("bm25")).limit(0)
    names = {w: f"__f{i}" for i, w in enumerate(dict.fromkeys(words))}
    rows = spread(docs).select(F.col(id).alias("__id"), tokens(F.col(text)).alias("__t"), (F.lit(True) if where is None else where).alias("__ok"))

    def matching(word: str) -> Column:
        return F.size(F.filter("__t", lambda x: x.startswith(word)))

    # written, so that texts are cut into words once: the weights need all rows before any can be scored
    rows = materialize(rows.select("__id", "__ok", F.size("__t").alias("__len"), *[matching(w).alias(c) for w, c in names.items()]), "matches")
    total = rows.agg(F.count("*").alias("n"), F.sum("__len").alias("len"), *[F.count_if(F.col(c) > 0).alias(c) for c in names.values()]).first()
    average = (total["len"] or 0) / total["n"] if total["n"] else 0.0
    idfs = [_idf(total["n"], total[names[w]]) for w in words]
    hit = [F.col(names[w]) > 0 for w in names]
    rows = rows.where(reduce(lambda a, b: a & b if mode == "and" else a | b, hit)).where("__ok")
    score = _score([F.col(names[w]).cast("double") for w in words], F.col("__len"), idfs, average)
    rows = rows.select(F.col("__id").alias(id), score.alias("bm25")).orderBy("bm25", id)
    return rows if limit is None else rows.limit(limit)


def postings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings(term, doc_id, tf, len), stats(n, total)): every term of every document with the document's length, and one row
    of corpus figures.  Terms of a document are counted inside its row's partial aggregate.
    """
    rows = spread(docs).select(F.col(id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    terms = rows.select("doc_id", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("term", "doc_id", "len").agg(F.count("*").cast("int").alias("tf"))
    return terms.select("term", "doc_id", "tf", "len"), rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("total"))


def write_index(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", partitions: int = 64) -> None:
    """Postings by range of term, sorted, so that a prefix reads few row groups (a hot term spans several files); distinct terms; corpus figures."""
    terms, stats = postings(docs, id, text)
    terms.repartitionByRange(partitions, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    docs.sparkSession.read.parquet(f"{path}/postings").select("term").distinct().write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of a written index; their schemas are known, so no file is opened for them."""
    return spark.read.schema("term string, doc_id long, tf int, len int").parquet(f"{path}/postings"), spark.read.schema("n long, total long").parquet(f"{path}/stats")


def _after(word: str) -> str:
    """The smallest string above all that begin with ``word``."""
    return word[:-1] + chr(ord(word[-1]) + 1)


def _weight(n: Column, df: Column) -> Column:
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))


def _share(count: Column, length: Column, idf: Column, n: Column, total: Column) -> Column:
    """One word's part of the (negative) score."""
    return -idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length * n / F.greatest(total, F.lit(1))))


def search_index(terms: DataFrame, stats: DataFrame, query: str, mode: str = "and", limit: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """``keyword_search`` over an index, as one plan without any job of its own.

    Each prefix is a range of terms that reaches the Parquet scan; document frequencies come from the same
    postings, corpus figures from the stored row.  ``allowed(doc_id)`` narrows what is returned, before the
    limit, but not the corpus that the weights come from.
    """
    words = query_words(query)
    if not words:
        return terms.select("doc_id", F.lit(0.0).alias("bm25")).limit(0)
    distinct = list(dict.fromkeys(words))
    prefix = {w: (F.col("term") >= w) & (F.col("term") < _after(w)) for w in distinct}
    hits = terms.where(reduce(lambda a, b: a | b, prefix.values()))
    counted = hits.groupBy("doc_id").agg(F.max("len").alias("len"), *[F.sum(F.when(cond, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, cond in enumerate(prefix.values())])
    dfs = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(distinct))])
    have = [F.col(f"f{i}") > 0 for i in range(len(distinct))]
    rows = counted.where(reduce(lambda a, b: a & b if mode == "and" else a | b, have))
    if allowed is not None:
        rows = rows.join(allowed.select("doc_id"), "doc_id", "left_semi")
    rows = rows.join(F.broadcast(dfs)).join(F.broadcast(stats))  # one row each
    at = [distinct.index(w) for w in words]
    score = reduce(lambda a, b: a + b, [_share(F.col(f"f{i}"), F.col("len"), _weight(F.col("n"), F.col(f"d{i}")), F.col("n"), F.col("total")) for i in at])
    return rows.select("doc_id", score.alias("bm25")).orderBy("bm25", "doc_id").limit(limit)


def _search_set(make_tiles: Callable[[list[str]], DataFrame], stats: DataFrame | None, queries: DataFrame, modes: tuple[str, ...], limit: int) -> DataFrame:
    """(mode, query_id, id, rank, bm25) over tiles made for the queries' words; corpus figures are the tiles' own, if none are given."""
    got = queries.select("query_id", tokens(F.col("query")).alias("words")).collect()
    words = sorted({w for r in got for w in r.words})
    number, asked, names = {w: i for i, w in enumerate(words)}, {}, []
    for r in got:  # queries of the same words are one
        if r.words:
            names.append((r.query_id, asked.setdefault(tuple(sorted(Counter(number[w] for w in r.words).items())), len(asked))))
    tiles = materialize(make_tiles(words), "tiles")
    n, total = (tiles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))) if stats is None else stats.select("n", "total")).first()
    dfs = tiles.select(F.explode(F.arrays_zip("words", "sizes")).alias("x")).groupBy("x.words").agg(F.sum("x.sizes").alias("df")).collect()
    weights = np.zeros(len(words))
    for r in dfs:
        weights[r.words] = _idf(n, r.df)
    found = queryset.best_many(tiles, list(asked), weights, K1, B, n / max(total, 1), modes, limit)
    named = queries.sparkSession.createDataFrame(names, f"query_id {dict(queries.dtypes)['query_id']}, u long")
    return found.join(named, "u").select("mode", "query_id", "id", "rank", "bm25")


def search_many(terms: DataFrame, stats: DataFrame, queries: DataFrame, mode: str = "and", limit: int = 50) -> DataFrame:
    """(query_id, id, rank, bm25): the best documents of every row of ``queries(query_id, query)``, as ``keyword_search`` finds them one by one."""
    return _search_set(lambda words: queryset.tiles_of_postings(terms, words), stats, queries, (mode,), limit).drop("mode")


def search_many_texts(docs: DataFrame, queries: DataFrame, modes: tuple[str, ...] = ("and",), limit: int = 50, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(mode, query_id, id, rank, bm25): ``search_many`` without an index, in one or both modes; each text is cut into words once."""
    rows = spread(docs).select(F.col(id).alias("id"), tokens(F.col(text)).alias("terms"))
    return _search_set(lambda words: queryset.tiles_of_texts(rows, words), None, queries, modes, limit)
