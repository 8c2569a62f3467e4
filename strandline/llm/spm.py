"""SentencePiece encoding and decoding through a table of distinct marked words.

Where no piece of a vocabulary holds a white-space marker behind another character, segmentation can
never cross from one marked word (markers, then non-markers) into the next; the same holds at line
feeds where no longer piece holds one.  So each distinct marked word of the corpus is segmented once, by
the library itself.  Documents are packed, some million characters together, with their distinct words in
the order of a hash and, for every document, the places of its words among those.  A range of hashes is a
bucket of the table of distinct words: each pack asks each bucket for its words in one row, the bucket's
task segments a word when it first meets it, and the ids go back to the pack and, by position, to texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import blobs
from strandline.plans.shared import fresh_path, materialize

MARK = "▁"


class Codec:
    """What a model needs for encoding word by word, exactly as the library encodes whole texts."""

    def __init__(self, model: str | bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(model if isinstance(model, bytes) else open(model, "rb").read())
        norm = spec.normalizer_spec
        crossing = [p.piece for p in spec.pieces if p.type in (1, 4) and re.search(f"[^{MARK}]{MARK}", p.piece)]
        if crossing or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"pieces of this model can cross white-space markers, or its normaliser changes texts: {crossing[:5]}")
        self.prefix = norm.add_dummy_prefix
        # A line feed that no longer piece holds is a border as good as a marker.
        borders = not any("\n" in p.piece and len(p.piece) > 1 for p in spec.pieces)
        self.find = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if borders else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        norm.add_dummy_prefix = False  # a marked word brings its own marker
        self.chunks = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        self.kind = "<u2" if len(spec.pieces) <= 1 << 16 else "<u4"
        self.bos, self.eos = (np.array([x], dtype=self.kind).tobytes() for x in (self.whole.bos_id(), self.whole.eos_id()))

    def split(self, text: str) -> list[str]:
        """The marked words of a text, in order."""
        marked = text.replace(" ", MARK)
        return self.find(MARK + marked if marked and self.prefix else marked)

    def segment(self, word: str) -> bytes:
        """Ids of one marked word, little-endian numbers of ``kind``."""
        return np.array(self.chunks.encode(word), dtype=self.kind).tobytes()

    def wide(self, ids: bytes) -> bytes:
        """The same ids as little-endian unsigned 32-bit numbers."""
        return np.frombuffer(ids, dtype=self.kind).astype("<u4").tobytes()

    def decode(self, ids: bytes) -> str:
        return self.whole.decode(np.frombuffer(ids, dtype="<u4").tolist())


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _joined(words: list[str]) -> bytes:
    """Marked words, compressed; the usual single marker in front is left out, and any other word has one more."""
    return _squeeze(" ".join([w[1:] if len(w) > 1 and w[0] == MARK != w[1] else MARK + w for w in words]).encode())


def _parted(data: bytes) -> list[str]:
    return [w[1:] if w[0] == MARK else MARK + w for w in _expand(data).decode().split(" ")]


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _packs(docs: DataFrame, keep: list[str], model: bytes, pack_chars: int, folder: str) -> DataFrame:
    """(part, n, words, path, start, size): documents of one task together, up to ``pack_chars`` characters or one longer text.

    ``words`` are the pack's ``n`` distinct marked words by ascending hash, joined by spaces (they hold none);
    what else a pack holds goes to a file under ``folder``, so that it is never shuffled: a compressed Arrow
    batch of the columns ``keep`` and every document's words, as ranks by how often the pack has them (in two
    parts, low byte and rest, which compress better), and what leads from a rank to a place among ``words``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = Codec(model), TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        schema = pa.schema(list(zip(("part", "n", "words", "path", "start", "size"), kinds)))
        index: dict[str, int] = {}
        held, at, size, file = [], [], 0, blobs.Writer(folder)

        def emit() -> pa.RecordBatch:
            words = list(index)
            order = np.argsort(_hashes(words), kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            by_count = np.argsort(-np.bincount(np.concatenate([np.empty(0, np.int32), *at]), minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words), dtype=np.uint32)
            high = np.uint16 if len(words) <= 1 << 24 else np.uint32
            low = pa.array([rank[x].astype(np.uint8) for x in at], pa.list_(pa.uint8()))
            rest = pa.array([(rank[x] >> np.uint32(8)).astype(high) for x in at], pa.list_(pa.from_numpy_dtype(high)))
            sink = pa.BufferOutputStream()
            rows = pa.Table.from_batches(held).append_column("__low", low).append_column("__rest", rest).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            place = _squeeze(place[by_count].tobytes())
            blob = len(place).to_bytes(8, "little") + place + sink.getvalue().to_pybytes()
            start = file.append(blob)
            values = [part, len(words), _joined([words[k] for k in order]), file.path, start, len(blob)]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, values))], schema=schema)

        for batch in batches:
            texts, kept, first = batch.column("__text"), batch.select(keep), 0
            for k, text in enumerate(texts):
                text = text.as_py() or ""
                at.append(np.fromiter((index.setdefault(w, len(index)) for w in codec.split(text)), np.int32))
                size += len(text) + 64
                if size >= pack_chars:
                    held.append(kept.slice(first, k + 1 - first))
                    yield emit()
                    first, part, size, held, at = k + 1, part + 1, 0, [], []
                    index.clear()
            if first < len(texts):
                held.append(kept.slice(first))
        last = [emit()] if at else []
        file.close()  # before the row that names its last part
        yield from last

    return docs.mapInArrow(run, "part long, n int, words binary, path string, start long, size long")


def _lists(rows: pa.RecordBatch) -> Iterator[list[int]]:
    """Every document's words as ranks."""
    ends = np.cumsum(rows.column("__low").value_lengths().to_numpy(zero_copy_only=False))
    low, rest = (rows.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__low", "__rest"))
    ranks = (low + (rest << 8)).tolist()
    return (ranks[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))


def _requests(packs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, part, first, words): a pack's words of one range of hashes, from its word ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, joined in zip(batch.column("part"), batch.column("words")):
                words = _parted(joined.as_py())
                bucket = ((_hashes(words) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(words)]))
                cols = [pa.array(bucket[edges[:-1]]), pa.array(np.full(len(edges) - 1, part.as_py())), pa.array(edges[:-1].astype(np.int32))]
                texts = pa.array([_joined(words[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*cols, texts], names=["bucket", "part", "first", "words"])

    return packs.where("n > 0").select("part", "words").mapInArrow(run, "bucket long, part long, first int, words binary")


def _answers(requests: DataFrame, model: bytes) -> DataFrame:
    """(part, first, n, ids): for every request of ``n`` words, how many bytes of ids each has, and those, compressed.

    A bucket's requests stand together, so a word is segmented when the first of them names it, and never again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, table = Codec(model), None, {}
        for batch in batches:
            n, ids = [], []
            for bucket, words in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if bucket != current:
                    current, table = bucket, {}
                words = _parted(words.as_py())
                for w in words:
                    if w not in table:
                        table[w] = codec.segment(w)
                own = [table[w] for w in words]
                n.append(len(own))
                ids.append(_squeeze(np.fromiter(map(len, own), "<u4", len(own)).tobytes() + b"".join(own)))
            cols = [batch.column("part"), batch.column("first"), pa.array(n, pa.int32()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "first", "n", "ids"])

    together = requests.repartition("bucket").sortWithinPartitions("bucket", "part", "first")
    return together.mapInArrow(run, "part long, first int, n int, ids binary")


def encode_decode(docs: DataFrame, model: str | bytes, text: str = "text", with_ids: bool = True, pack_chars: int = 1 << 24, bucket_words: int = 250_000) -> DataFrame:
    """``docs`` without its text, plus ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and (unless told
    otherwise) ``ids array<int>`` and ``decoded``.

    Null and empty texts give begin and end id only.  Very long texts are encoded whole, in memory in
    proportion to the text.  Equal rows give equal rows, each its own; nothing depends on an order, so there
    are no ties; an empty table gives an empty result.  Input columns named like an output column are
    replaced; others, null or not, go through unchanged.

    What is shuffled are the words of each pack (``pack_chars`` characters), not every occurrence.  A pack asks
    a bucket at most once, and buckets are even ranges of a hash, so that a word of every document is one row
    entry a pack and no task gets more than its share.  A bucket's table holds some ``bucket_words`` words.
    Packs are written to files of the shared folder (see ``blobs``), so a lost executor costs its own tasks.
    """
    model = model if isinstance(model, bytes) else open(model, "rb").read()
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())] * with_ids
    keep = [f for f in docs.schema.fields if f.name not in {text, *(x.name for x in new)}]
    schema = T.StructType(keep + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec(model), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for path, start, size, found in zip(*(batch.column(c) for c in ("path", "start", "size", "found"))):
                blob = blobs.read(path.as_py(), start.as_py(), size.as_py())
                end = 8 + int.from_bytes(blob[:8], "little")
                rows = pa.ipc.open_stream(pa.py_buffer(blob).slice(end)).read_all().combine_chunks().to_batches()[0]
                place, table = np.frombuffer(_expand(blob[8:end]), np.uint32), {}
                for x in found.as_py() or ():
                    ids = _expand(x["ids"])
                    ends = np.cumsum(np.frombuffer(ids, "<u4", x["n"]), dtype=np.int64) + 4 * x["n"]
                    table.update(zip(range(x["first"], x["first"] + x["n"]), (ids[a:b] for a, b in zip([4 * x["n"], *ends.tolist()], ends.tolist()))))
                table = [table[k] for k in place.tolist()]  # by rank
                for start in range(0, rows.num_rows, 256):  # what is held at once stays small beside the pack
                    part = rows.slice(start, 256)
                    ids = [codec.wide(b"".join((codec.bos, *map(table.__getitem__, at), codec.eos))) for at in _lists(part)]
                    back = [codec.decode(x) for x in ids]
                    made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array([sha(x.encode()) for x in back], pa.string())]
                    if with_ids:
                        made += [pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())), pa.array(back, pa.string())]
                    yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *made], names=schema.names)

    rows = docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias("__text"))
    packs = materialize(_packs(rows, [f.name for f in keep], model, pack_chars, fresh_path(rows.sparkSession, "pack-files")), "packs")
    words = packs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(-(-words // bucket_words), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    answers = _answers(_requests(packs, buckets), model)
    found = answers.groupBy("part").agg(F.collect_list(F.struct("first", "n", "ids")).alias("found"))
    # a merge join at every size: packed bytes are larger than Parquet says
    return packs.select("part", "path", "start", "size").join(found.hint("merge"), "part", "left").select("path", "start", "size", "found").mapInArrow(run, schema)
