"""Vector search by inner product (vectors of unit length: by cosine)."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest, ties by id.  ``where`` narrows the candidates before the top list.

    A query longer than the vectors is cut to their length; an empty one finds nothing.
    """
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(F.slice(q, F.lit(1), F.size(vector)), F.col(vector))
    return rows.where(F.size(vector) > 0).select(F.col(id), score.alias("score")).orderBy(F.desc("score"), id).limit(k if query else 0)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", max_queries: int = 10_000) -> DataFrame:
    """(query_id, id, rank, score) of the k nearest of every row of ``queries(query_id, vector)``, ties by id.

    The queries are one matrix that every task holds, so there may be ``max_queries`` of them (more is an error);
    a task multiplies parts of it with parts of its batches and keeps k per query.  What comes near the k best is
    scored again, component by component like ``dot``, so equal vectors have equal scores wherever they lie.
    Queries longer than the vectors are cut.
    """
    got = queries.select("query_id", "vector").where(F.size("vector") > 0).limit(max_queries + 1).toPandas()
    if len(got) > max_queries:
        raise ValueError(f"more than {max_queries} queries at once")
    names, asked = got["query_id"].tolist(), [np.asarray(v, np.float64) for v in got["vector"]]

    def run(batches):
        best = {}
        for rows in batches:
            lengths = rows["v"].map(len)
            for dims in sorted(set(lengths)):
                own = rows[lengths == dims]
                fits = [i for i, q in enumerate(asked) if len(q) >= dims]
                for at, part in itertools.product(range(0, len(own), 2048), range(0, len(fits), 256)):
                    these = fits[part : part + 256]
                    a, b = np.stack([asked[i][:dims] for i in these]), np.stack(own["v"].iloc[at : at + 2048].to_numpy()).astype(np.float64)
                    ids = own["id"].to_numpy()[at : at + 2048]
                    slack = 1e-12 * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
                    for i, q, near, off in zip(these, a, a @ b.T, slack):
                        kept = best.get(i, (np.zeros(0), np.zeros(0, np.int64)))
                        least = kept[0][-1] if len(kept[0]) == k else -np.inf
                        if len(near) > k:
                            least = max(least, np.partition(near, -k)[-k])
                        few = np.flatnonzero(~(near < least - off))
                        if len(few):
                            scores = np.concatenate([kept[0], np.add.accumulate(b[few] * q, axis=1)[:, -1]])
                            names_of = np.concatenate([kept[1], ids[few]])
                            order = np.lexsort((names_of, -scores))[:k]
                            best[i] = scores[order], names_of[order]
        held = list(best)
        for at in range(0, len(held), 1024):
            part = held[at : at + 1024]
            yield pd.DataFrame({"q": np.repeat(part, [len(best[i][0]) for i in part]), "id": np.concatenate([best[i][1] for i in part]), "score": np.concatenate([best[i][0] for i in part])})

    rows = vectors.where(F.size(vector) > 0).select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = rows.mapInPandas(run, "q long, id long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", place).where(F.col("rank") <= k)
    kind = dict(queries.dtypes)["query_id"]
    named = vectors.sparkSession.createDataFrame(list(enumerate(names)), f"q long, query_id {kind}")
    return found.join(F.broadcast(named), "q").select("query_id", "id", "rank", "score")  # max_queries rows at most


def mean_pool(rows: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """(by, vector): the mean of each group's vectors, of unit length; sums per component combine before the shuffle."""
    parts = rows.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return whole.select(by, normalise(F.transform("p", lambda s: s["x"])).alias("vector"))


def normalise(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x))


@F.pandas_udf(T.BinaryType())
def to_half(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 16-bit floats, rounded to nearest even."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").astype("<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_half(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f2").astype("f4"))


def half_rounding(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row (n, most): components, and the largest change that 16 bits make; a component beyond their range fails the job."""
    parts = rows.select(F.posexplode(F.arrays_zip(F.col(vector).alias("a"), from_half(to_half(F.col(vector))).alias("b"))).alias("pos", "x"))
    changed = F.abs(F.col("x.a").cast("double") - F.col("x.b").cast("double"))
    fits = F.when(F.abs(F.col("x.a")) > 65504, F.raise_error(F.lit("a component is too large for 16 bits"))).otherwise(changed)
    return parts.agg(F.count("*").alias("n"), F.max(fits).alias("most"))


@F.pandas_udf(T.BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """Vectors as little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_bytes(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def _encode(rows: DataFrame, encoder: Callable[[list[str]], np.ndarray], keep: str, batch: int, save: Callable[[list, list[np.ndarray]], None] | None = None, every: int = 1 << 30) -> DataFrame:
    """(keep, vector) of rows (keep, __text): each row is encoded where it lies, ``batch`` texts a call.  ``save`` gets ``every`` rows at a time, before the next is begun."""

    def run(batches):
        for rows in batches:
            for first in range(0, len(rows), every):
                some = rows.iloc[first : first + every]
                made = [v for at in range(0, len(some), batch) for v in np.asarray(encoder(some["__text"].iloc[at : at + batch].tolist()), np.float32)]
                if save:
                    save(some[keep].tolist(), made)
                yield pd.DataFrame({keep: some[keep], "vector": made})

    return rows.mapInPandas(run, f"{keep} {dict(rows.dtypes)[keep]}, vector array<float>")


def embed(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], model_id: str, folder: str | None = None, every: int = 1 << 30, text: str = "text", id: str = "id", batch: int = 64) -> DataFrame:
    """``embed_distinct`` of texts that differ from row to row: no row leaves its task.

    Where a ``folder`` (a local or mounted path) is named, a task also saves each ``every`` rows there as a Parquet file
    before it goes on; a file that can be seen is whole.
    """

    def save(ids, made):
        import os
        import uuid

        import pyarrow as pa
        import pyarrow.parquet as pq

        whole = pa.table([pa.array(ids, pa.int64()), pa.array([model_id] * len(ids)), pa.array([len(v) for v in made], pa.int32()), pa.array(made, pa.list_(pa.float32()))], ["command_id", "model_id", "dims", "vector"])
        name = uuid.uuid4().hex
        pq.write_table(whole, f"{folder}/_{name}")  # readers skip names with a line before them
        os.replace(f"{folder}/_{name}", f"{folder}/{name}.parquet")

    rows = texts.where(F.col(text).isNotNull()).select(F.col(id).alias("command_id"), F.col(text).alias("__text"))
    encoded = _encode(rows, encoder, "command_id", batch, save if folder else None, every)
    return encoded.select("command_id", F.lit(model_id).alias("model_id"), F.size("vector").alias("dims"), "vector")


def embed_distinct(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray], model_id: str, text: str = "text", id: str = "id", batch: int = 64) -> DataFrame:
    """(command_id, model_id, dims, vector) for every row; each distinct text is encoded once.

    ``encoder`` is any picklable function from a list of texts to a matrix of unit rows.
    """
    encoded = _encode(texts.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct(), encoder, "__text", batch)
    rows = texts.select(F.col(id).alias("command_id"), F.col(text).alias("__text")).join(encoded, "__text")
    return rows.select("command_id", F.lit(model_id).alias("model_id"), F.size("vector").alias("dims"), "vector")
