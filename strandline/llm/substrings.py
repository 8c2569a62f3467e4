"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Four exact reductions keep the count small.  A document whose whole word sequence stands in a smaller
document goes as a whole, so only one row of each group of copies is looked at.  Each window then carries
an anchor, the least hash of the shorter grams inside it: equal windows have equal anchors, so a window
whose anchor stands in one document alone cannot be repeated, and only the others are shipped and
counted.  Consecutive windows under one anchor are a run; equal runs are counted as one, and only where
runs differ are their windows counted singly.  Window hashes are two 64-bit polynomials with different
bases over 64-bit word hashes, of which 96 bits are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.plans.shared import materialize, release

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_PACKED = np.dtype([("a", "<u8"), ("b", "<u4")])  #: a window's hash: 96 bits, unaligned
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2^64, grown as longer texts come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive word hashes: sum of h[i+k] * base**k modulo 2^64."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _power(base, n), dtype=np.uint64)))
    inverse = pow(base, -1, 1 << 64)
    return (sums[width:] - sums[:-width]) * _power(inverse, n - width + 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[: len(values) - width + 1], out[width - span :][: len(values) - width + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For every window of words, the least mixed hash of the ``gram``-word sequences inside it."""
    if len(hashes) < window:
        return np.empty(0, np.uint64)
    mixed = rolling(hashes, gram, _BASES[0])
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return _least(mixed, window - gram + 1)


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """A row's key is its id and a hash of its text, so that rows that repeat an id with another text stay apart."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__id": F.col(id).cast("long"), "__th": F.xxhash64(body), "__text": body.cast("binary")})


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, len(batch), rows))


def _sketch(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Per row: its number of words, the digest of its word sequence and its distinct anchors."""
    schema = "__id long, __th long, n_words long, digest binary, anchors array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            n, digest, marks = [], [], []
            for x in batch.column("__text"):
                words = x.as_py().split()
                n.append(len(words))
                digest.append(hashlib.sha256(b" ".join(words)).digest())
                marks.append(np.unique(anchors(word_hashes(words), window, gram)).view(np.int64) if len(words) >= window else np.empty(0, np.int64))
            made = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__th"), *made], names=["__id", "__th", "n_words", "digest", "anchors"])

    return docs.select("__id", "__th", "__text").mapInArrow(run, schema)


def _runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(mark, key, n, pos, __id, __th, body): runs of consecutive windows under one of the row's shared anchors.

    ``body`` packs the ``n`` windows' hashes, 12 bytes each, from the one that starts at word ``pos``; ``key``
    is a hash of it.
    """
    names = ["mark", "key", "n", "pos", "__id", "__th", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in (p for b in batches for p in _parts(b, 64)):
            out: list[tuple] = []
            for i, th, text, marks in zip(*(batch.column(c) for c in ("__id", "__th", "__text", "marks"))):
                hashes = word_hashes(text.as_py().split())
                least = anchors(hashes, window, gram).view(np.int64)
                edges = np.concatenate(([0], np.flatnonzero(np.diff(least)) + 1, [len(least)]))
                packed = np.empty(len(least), _PACKED)
                packed["a"], packed["b"] = rolling(hashes, window, _BASES[0]), rolling(hashes, window, _BASES[1]) >> np.uint64(32)
                for k in np.flatnonzero(np.isin(least[edges[:-1]], marks.values.to_numpy(zero_copy_only=False))).tolist():
                    at, end = int(edges[k]), int(edges[k + 1])
                    body = packed[at:end].tobytes()
                    out.append((int(least[at]), xxhash.xxh3_64_intdigest(body) - (1 << 63), end - at, at, i.as_py(), th.as_py(), body))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], names=names)

    return docs.mapInArrow(run, "mark long, key long, n int, pos int, __id long, __th long, body binary")


def _windows(runs: DataFrame) -> DataFrame:
    """(a, b, __id, __th, pos): one row per window of the runs, by its 96-bit hash."""
    names = ["a", "b", "__id", "__th", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            bodies = [np.frombuffer(x, _PACKED) for x in batch.column("body").to_pylist()]
            n = np.array([len(x) for x in bodies], np.int64)
            flat = np.concatenate([np.empty(0, _PACKED), *bodies])
            pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(batch.column("pos").to_numpy(zero_copy_only=False), n)
            ids, ths = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), n) for c in ("__id", "__th"))
            cols = [np.ascontiguousarray(flat["a"]).view(np.int64), np.ascontiguousarray(flat["b"]).view(np.int32), ids, ths, pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    return runs.select("__id", "__th", "pos", "body").mapInArrow(run, "a long, b int, __id long, __th long, pos int")


def _seen_before(rows: DataFrame, keys: list[str], firsts: DataFrame) -> DataFrame:
    """Rows that a smaller id holds too, by ``firsts`` (keys, least, most): the ids of every key."""
    # both sides are written: a grouping directly under or over the join would keep adaptive execution from splitting a hot key
    return materialize(rows.join(firsts.where("least < most").select(*keys, "least").hint("merge"), keys).where("__id > least").select("__id", "__th", "pos", "n"), "repeats")


def _repeats(runs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(__id, __th, pos, n): runs of ``n`` windows from ``pos`` on that repeat, all counted in Spark.

    Runs are counted whole first: a run that a smaller id holds is repeated in all its windows.  What is
    left are the first rows of every distinct run; where runs under one anchor differ (a passage that was
    changed, or is cut off), the windows of those are counted one by one.  A window's least id is the least
    over the distinct runs that hold it, so nothing is lost, and a passage that very many rows share is one
    run, summed up by each task before the shuffle, however many rows share it.
    """
    firsts = materialize(runs.groupBy("mark", "key").agg(F.min("__id").alias("least"), F.max("__id").alias("most")), "run-counts")
    whole = _seen_before(runs.select("mark", "key", "__id", "__th", "pos", "n"), ["mark", "key"], firsts)
    several = firsts.groupBy("mark").agg(F.min("least").alias("low"), F.max("least").alias("high")).where("low < high").select("mark")
    several = materialize(several, "several")  # written for the same reason as in ``_seen_before``
    heads = materialize(firsts.join(several.hint("merge"), "mark").select("mark", "key", "least"), "run-heads")
    found = materialize(_windows(runs.join(heads.hint("merge"), ["mark", "key"]).where("__id = least")), "windows")
    least = materialize(found.groupBy("a", "b").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most"), "window-counts")
    single = _seen_before(found.withColumn("n", F.lit(1)), ["a", "b"], least)
    release(firsts, several, heads, found, least)
    return whole.union(single), [whole, single]


def merge(starts: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) word intervals covered by ``counts`` consecutive windows from each of ``starts``."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + counts - 1 + window)[order])
    breaks = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.concatenate(([0], breaks + 1))].tolist(), ends[np.concatenate((breaks, [len(ends) - 1]))].tolist()))


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, gram: int = 16) -> DataFrame:
    """(__id, __th, spans): the word intervals to remove, for rows that lose any.

    A word goes if a ``window``-word sequence over it also starts in a row with a smaller id; ``spans``
    holds maximal [start, end) intervals.  __th is the hash of the row's text (see ``_keyed``).  What is
    joined grows with the corpus, and is a table of arrays or hashes that Parquet's size understates: the
    joins are merge joins at every size, never broadcasts.
    """
    keyed = _keyed(docs, id, text)
    written = materialize(_sketch(keyed, window, gram), "sketch")
    sketch = written.where(F.col("__id").isNotNull() & (F.col("n_words") >= window))
    firsts = sketch.groupBy("digest").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where("first < last").select("digest", "first")
    firsts = materialize(firsts, "copies")
    placed = sketch.join(firsts.hint("merge"), "digest", "left")
    copies = materialize(placed.where("__id > first").select("__id", "__th", "n_words"), "copied")
    alone = placed.where("first is null or __id = first").select("__id", "__th", F.explode("anchors").alias("mark"))
    shared = alone.groupBy("mark").agg(F.min("__id").alias("least"), F.max("__id").alias("most")).where("least < most").select("mark")
    shared = materialize(shared, "shared")
    marks = materialize(alone.join(shared.hint("merge"), "mark").groupBy("__id", "__th").agg(F.collect_list("mark").alias("marks")), "marks")
    release(written, firsts, shared)
    runs = materialize(_runs(keyed.select("__id", "__th", "__text").join(marks.hint("merge"), ["__id", "__th"]), window, gram), "runs")
    release(marks)
    hits, parts = _repeats(runs)
    release(runs)
    hits = hits.groupBy("__id", "__th").agg(F.collect_list(F.struct("pos", "n")).alias("hits"))

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def merged(hits):
        def spans(own):
            at, n = (np.fromiter((h[c] for h in own), np.int64, len(own)) for c in ("pos", "n"))
            return [{"start": a, "end": b} for a, b in merge(at, n, window)]

        return hits.map(spans)

    whole = copies.select("__id", "__th", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"))
    out = materialize(whole.union(hits.select("__id", "__th", merged("hits").alias("spans"))), "spans")
    release(copies, *parts)
    # rows repeated whole share a key; they lose the same words
    return out.dropDuplicates(["__id", "__th"])


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in ``spans``, nor the white space behind each of them; the rest is unchanged."""
    if not spans:
        return text
    places = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : places[start]])
        at = places[end]
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, gram: int = 16) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``n_words``, ``n_removed`` and ``spans``.

    Null texts have no words and stay null; texts shorter than the window, and rows with a null id, are
    left alone (a null id is neither smaller nor larger than another).  Repeated rows are cut alike;
    an equal id never removes.  Very long texts are held whole in one worker, one at a time.  An empty
    table gives an empty result; input columns named like an output column are replaced.
    """
    new = ["n_words", "n_removed", "spans"]
    body = docs.drop(*new, "__id", "__th", "__text", "__spans")
    spans = repeated_spans(docs, id, text, window, gram).withColumnRenamed("spans", "__spans")
    joined = _keyed(body, id, text).join(spans.hint("merge"), ["__id", "__th"], "left").withColumn("__null", F.col(text).isNull())
    keep = [f for f in body.schema.fields if f.name != text]
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", kind)]
    schema = T.StructType([*keep, T.StructField(text, T.StringType()), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in _parts(b)):
            texts, n, gone, all_spans = [], [], [], []
            for x, null, s in zip(batch.column("__text"), batch.column("__null"), batch.column("__spans")):
                x, s = x.as_py(), [(y["start"], y["end"]) for y in s.as_py() or ()]
                n.append(len(x.split()))
                gone.append(sum(b - a for a, b in s))
                texts.append(None if null.as_py() else cut(x, s).decode())
                all_spans.append([{"start": a, "end": b} for a, b in s])
            arrays = [pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(all_spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *arrays], names=schema.names)

    wanted = [*(F.col(f"`{f.name}`") for f in keep), "__text", "__null", "__spans"]
    order = [f.name for f in body.schema.fields] + new
    return joined.select(*wanted).mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in order])
