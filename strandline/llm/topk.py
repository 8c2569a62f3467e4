"""Exact top-k search: tiled matrix products, partial selection per tile, and tree merging of top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.plans.shared import materialize

TILE = "dims int, kind string, ids binary, body binary"
KINDS = (("<i2", 2.0**15), ("<i4", 2.0**31), ("<f8", float("inf")))  #: what a tile's components are kept as, the narrowest that holds them


def _tiles(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) packed, task by task, into tiles of up to ``size`` vectors of equal length, ordered by id, components as floor(1024 x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def pack(dims: int, least: int) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([a for a, _ in held[dims]])
            body = np.concatenate([b for _, b in held[dims]])
            at = 0
            while len(ids) - at >= max(1, least):
                part = slice(at, at + size)
                order = np.argsort(ids[part], kind="stable")
                own = body[part][order]
                top = np.abs(own).max(initial=0)
                kind = next(k for k, least in KINDS if top < least)
                cols = [pa.array([dims], pa.int32()), pa.array([kind]), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[part][order], own.astype(kind)))]
                yield pa.RecordBatch.from_arrays(cols, names=["dims", "kind", "ids", "body"])
                at += size
            held[dims] = [(ids[at:], body[at:])]

        for batch in batches:
            ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            lengths, flat, offsets = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False), None
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            for dims in np.unique(lengths):
                rows = np.flatnonzero(lengths == dims)
                body = flat[(offsets[rows][:, None] + np.arange(dims)[None, :])].reshape(len(rows), dims)
                held.setdefault(int(dims), []).append((ids[rows].astype(np.int64), np.floor(1024.0 * body.astype(np.float64))))
                if sum(len(a) for a, _ in held[int(dims)]) >= size:
                    yield from pack(int(dims), size)
        for dims in list(held):
            yield from pack(dims, 1)

    return rows.mapInArrow(run, TILE)


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; beyond what a double holds exactly, in Python's integers, held to 64 bits."""
    if not q.shape[1]:
        return np.zeros((len(q), len(d)), np.int64)
    with np.errstate(over="ignore"):
        safe = np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * q.shape[1] < 2**52
    if safe:
        return (q @ d.T).astype(np.int64)
    as_int = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object)
    return np.clip(as_int(q) @ as_int(d).T, -(2**63), 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each row's k highest scores, ties to the smaller id; ``ids`` ascend along columns."""
    k = min(k, scores.shape[1])
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    above, equal = scores > floor[:, None], scores == floor[:, None]
    need = k - above.sum(1)
    take = above | (equal & (np.cumsum(equal, axis=1) <= need[:, None]))
    row, col = np.nonzero(take)
    return row, ids[col], scores[row, col]


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def grid(tiles: int, query_tiles: int, cell_pairs: int, least: int) -> tuple[int, int]:
    """(rows, columns) of a grid over ``tiles`` x ``query_tiles`` pairs: a cell for ``cell_pairs`` of them, and ``least`` cells if there are as many pairs."""
    pairs = tiles * query_tiles
    cells = max(1, min(pairs, max(least, -(-pairs // cell_pairs))))
    columns = max(1, min(query_tiles, round((cells * query_tiles / max(1, tiles)) ** 0.5)))
    return max(1, min(tiles, -(-cells // columns))), columns


def search(vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", query_tile: int = 512, tile: int = 4096, cell_pairs: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k highest integer inner products with all other rows.

    Components x count as floor(1024 * x).  Data tiles are dealt into rows and query tiles into columns of a
    grid; every cell is one key of an equi-join, whose task multiplies each of its data tiles with each of its
    query tiles and keeps k per query of a pair.  The grid has a cell for some ``cell_pairs`` pairs of tiles, and
    the shape that copies least (each data tile to every column, each query tile to every row), so that work and
    copies are spread whatever the number of queries; nothing is broadcast.  The rows' lists merge in two levels
    of grouped top-k, which Spark prunes before each shuffle.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part;
    vectors meet only those of equal length; rows that share an id are not candidates for one another.
    Repeated rows are candidates each; query rows equal in id and vector are one query.  Ties go to the smaller id.
    An empty table gives an empty result; other columns are not read.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(id).cast("long").alias("id"), v.alias("v"), is_query.alias("q"))
    queries = rows.where("q").select("id", "v").distinct()
    n = queries.count()
    asked = materialize(_tiles(queries.repartition(max(1, -(-n // query_tile)), "id"), query_tile), "queries")
    data = materialize(_tiles(rows.select("id", "v"), tile), "tiles")
    down, across = grid(data.count(), asked.count(), cell_pairs, 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    cells = down * across
    deal = lambda n: F.pmod(F.xxhash64("ids", "body"), F.lit(n))
    cell = lambda row, column: F.col("dims") * F.lit(cells).cast("long") + row * across + column
    # both sides by the same number of partitions: adaptive execution would join cells that are small in bytes, not in work
    asked = asked.withColumns({"column": deal(across), "row": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
    asked = asked.select(cell(F.col("row"), F.col("column")).alias("cell"), F.col("kind").alias("q_kind"), F.col("ids").alias("q_ids"), F.col("body").alias("q_body")).repartition(cells, "cell")
    data = data.withColumns({"row": deal(down), "column": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    data = data.select(cell(F.col("row"), F.col("column")).alias("cell"), F.col("row").cast("int").alias("deal"), "dims", "kind", "ids", "body").repartition(cells, "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, q_kind, q_ids, q_body, kind, ids, body, deal in zip(*(batch.column(c) for c in ("dims", "q_kind", "q_ids", "q_body", "kind", "ids", "body", "deal"))):
                dims = dims.as_py()
                q_ids, ids = (np.frombuffer(x.as_buffer(), np.int64) for x in (q_ids, ids))
                q, d = (np.frombuffer(x.as_buffer(), k.as_py()).astype(np.float64).reshape(len(i), dims) for x, k, i in ((q_body, q_kind, q_ids), (body, kind, ids)))
                scores = products(q, d)
                own = int(np.unique(ids, return_counts=True)[1].max(initial=0))  # as many more as a query's own rows could take
                row, found, score = best(scores, ids, k + own)
                other = q_ids[row] != found
                cols = [q_ids[row][other], found[other], score[other]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(len(cols[0]), deal.as_py(), np.int32))], names=["query_id", "vec_id", "score", "deal"])

    pairs = data.join(asked.hint("merge"), "cell").drop("cell")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long, deal int")
    merged = _first(found, ["query_id", "deal"], k).drop("place")
    return _first(merged, ["query_id"], k).select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", "score")
