"""SimHash near-duplicates through covering locality-sensitive hashing.

For radius r, every bit position gets one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits.  Each
nonzero vector v makes a mask of the positions whose vector has an odd inner product with v.  Up to r
differing positions give r equations in r + 1 unknowns, so some v is orthogonal to all of them: the two
fingerprints agree on v's mask, and every pair within the radius collides in some table (Pagh, 2016).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.plans.shared import materialize, release

SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64 bits; bit set if set in over half the XXH64 (seed 42) of all ``width``-word shingles, repeats included."""
    import xxhash

    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory on very long texts
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks (signed 64-bit) over ``positions`` such that any ``radius`` of these lie outside one mask at least."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(len(positions))]
    masks = []
    for v in range(1, 2 ** (radius + 1)):
        bits = sum(1 << p for p, m in zip(positions, vectors) if (m & v).bit_count() % 2)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    return masks


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (value, smallest value of its group) that join what lies within ``radius`` hops; whole rows of distances at a time."""
    values = np.sort(values)
    bits, out = values.view(np.uint64), []
    todo = np.arange(len(values))
    while len(todo):
        root, todo = todo[0], todo[1:]
        front = [root]
        while front and len(todo):
            near = np.bitwise_count(bits[todo] ^ bits[front.pop()]) <= radius
            if near.any():
                front.extend(todo[near].tolist())
                out.extend((int(values[k]), int(values[root])) for k in todo[near].tolist())
                todo = todo[~near]
    return out


def near_edges(distinct: DataFrame, radius: int = 3, gather: int = 4096) -> DataFrame:
    """(a, b): edges whose components are those of "within ``radius`` differing bits", for distinct ``fp`` longs.

    A table's bucket of two is compared in Spark; one of up to ``gather`` values in one Python call. A
    larger bucket is not gathered: its members meet again under covering masks of the bits still free in
    it, of which a bucket leaves so few (14 of 64 for radius 3) that distinct values bound its size.
    """
    masks = covering_masks(list(range(64)), radius)
    keyed = lambda df, table: df.select(table.alias("t"), "fp")
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = keyed(distinct.select("fp", F.explode(parts).alias("p")), F.col("p"))
    sizes = rows.groupBy("t").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    sizes = materialize(sizes, "buckets")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = sizes.where("n = 2").where(close).select("a", "b")

    def joined(groups: DataFrame) -> DataFrame:
        """Edges of gathered buckets."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame([e for g in batch["g"] for e in forest(np.asarray(g, np.int64), radius)], columns=["a", "b"], dtype="int64")

        return groups.select("g").mapInPandas(run, "a long, b long")

    some = rows.join(sizes.where(f"n between 3 and {gather}").select("t"), "t")
    edges = pairs.union(joined(some.groupBy("t").agg(F.collect_list("fp").alias("g"))))
    if sizes.where(f"n > {gather}").limit(1).count():
        free = lambda m: [p for p in range(64) if not (m >> p) & 1]
        inner = [covering_masks(free(m), radius) for m in masks]
        large = rows.join(sizes.where(f"n > {gather}").select("t"), "t")
        # the inner key keeps the outer one: members of different outer buckets never meet
        again = F.transform(
            F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in inner]), F.col("t.i") + 1),
            lambda x, j: F.struct(F.col("t.i").alias("i"), F.col("t.key").alias("key"), j.alias("j"), F.col("fp").bitwiseAND(x).alias("inner")),
        )
        rows2 = large.select(F.explode(again).alias("t"), "fp")
        many = rows2.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
        edges = edges.union(joined(rows2.join(many, "t").groupBy("t").agg(F.collect_list("fp").alias("g"))))
    return edges


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, gather: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row (id, fp long, component_id, root, and the columns ``carry``) per row of ``docs``: its fingerprint, the
    smallest id reachable over links, and the fingerprint that names its component.

    Copies share a fingerprint and so are one node, however many there are; only distinct fingerprints
    are compared.  Null and empty texts have fingerprint zero and link like any other; very long texts are
    hashed whole, in memory in proportion to the text; a null id keeps its row and is never a component's id
    unless all are null.  Repeated rows stay; an id that repeats is one name for its rows, so there are no
    ties; an empty table gives an empty result; other columns of ``docs`` are not read, and those in ``carry``
    must not be named like an output column.
    """

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))

    marked = materialize(docs.select(F.col(id).alias("id"), prints(F.col(text).cast("binary")).alias("fp"), *carry), "prints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    nodes = materialize(nodes, "fingerprints")
    roots = components(near_edges(nodes.select("fp"), radius, gather))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(ids, "root").select("fp", "component_id", "root"), "classes")
    release(nodes, named)
    # inner equi-join; adaptive execution splits the partition of a fingerprint that many copies share
    return marked.join(classes, "fp").select(F.col("id").alias(id), "fp", "component_id", "root", *carry)


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """``docs`` with one row of every component of near duplicates: that of the smallest id.

    Where an id repeats, the row whose text and then whose other columns have the smallest hash; a null id
    counts as the largest.  Rows alike in all columns are one.  Rows without words are one component.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    marked = docs.withColumns({"__th": F.xxhash64(F.col(text), F.col(text).isNull()), "__row": F.xxhash64(*plain, *[c.isNull() for c in plain])})
    rows = materialize(near_duplicates(marked, id, text, radius, carry=("__th", "__row")).withColumnRenamed(id, "__id"), "components")
    name = F.struct(F.col("__id").isNull().alias("late"), "__id", "__th", "__row")
    first = materialize(rows.groupBy("root").agg(F.min(name).alias("first")), "firsts")
    kept = first.select("first.__th", "first.__row")
    gone = materialize(rows.select("__th", "__row").distinct().join(kept, ["__th", "__row"], "left_anti"), "near-copies")
    out = marked.join(gone, ["__th", "__row"], "left_anti")
    if rows.join(kept, ["__th", "__row"]).count() > kept.count():  # a row that stays is repeated in all columns
        out = out.dropDuplicates(["__th", "__row"])
    release(rows, first)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
