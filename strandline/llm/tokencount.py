"""Token counts by separator scan over flat, unindexed token files.

A file is a run of token ids with an end-of-document id behind every document, and nothing that says where
documents begin.  It is read in blocks of a fixed number of tokens, wherever they fall, each by any task and
searched for the separator in one vector operation.  Boundaries that straddle blocks are stitched by a prefix
scan over block summaries: how many documents ended before a block, and where the last one did.  The scan has
two levels (blocks of a group, then groups), so no task sees more than a group of a file that holds a third
of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import blobs
from strandline.plans.shared import materialize

BLOCKS = "stream long, block long, payload binary"


def bpe_encoder(path: str):
    """``encode_ordinary`` of a rank file (special strings in a text are ordinary text)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_flat_files(docs: DataFrame, tokenizer: str, separator: int, folder: str, id: str = "doc_id", text: str = "text", token_bytes: int = 2) -> DataFrame:
    """Tokenise ``docs`` into flat files of little-endian ids under ``folder``, one a task; (stream, doc_no, id) names their documents.

    ``stream`` is a file's name.  A document's tokens are followed by ``separator``; null and empty texts are a
    separator alone, very long ones are tokenised whole, repeated rows are documents each, and a null id stays
    null.  Other columns are not read.  An id that ``token_bytes`` can't hold is an error.  The rows must be
    written (``materialize``) before the files are read, and only files that they name count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, n = bpe_encoder(tokenizer), blobs.Writer(folder), 0

        def named(ids: list) -> pa.RecordBatch:
            cols = [pa.array([file.path.rsplit("/", 1)[1]] * len(ids), pa.string()), pa.array(range(n - len(ids), n), pa.int64()), pa.array(ids, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["stream", "doc_no", "id"])

        last: list = []
        for batch in batches:
            if last:
                yield named(last)
            for body in batch.column("text"):
                tokens = encode(body.as_py() or "")
                tokens.append(separator)
                flat = np.array(tokens, np.int64)
                if flat.max() >> (8 * token_bytes):
                    raise ValueError(f"a token id of {flat.max()} does not fit into {token_bytes} bytes")
                file.append(flat.astype(f"<u{token_bytes}").tobytes())
                n += 1
            last = batch.column("id").to_pylist()
        file.close()  # before the row that names its last document
        if last:
            yield named(last)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "stream string, doc_no long, id long")


def read_flat_files(spark: SparkSession, folder: str, token_bytes: int = 2, block_tokens: int = 1 << 18, task_blocks: int = 256) -> DataFrame:
    """(stream, block, path, start, bytes): the blocks of all files under ``folder``, of any size; contents are read by the scan.

    Blocks are dealt out by a hash to tasks of some ``task_blocks`` blocks, so that a large file is read by
    many.  Their number is set here: a block's row is tiny, and adaptive execution, which sees only rows,
    would give one task thousands of them.
    """
    step = token_bytes * block_tokens
    files = spark.read.format("binaryFile").load(folder).select("path", "length")  # Spark lists them; no content is read
    n = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / step)), F.lit(0))).first()[0]
    tasks = max(1, -(-n // task_blocks), min(n, 4 * spark.sparkContext.defaultParallelism))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step).cast("long")))
    rows = files.where("length > 0").select(F.substring_index("path", "/", -1).alias("stream"), "path", "length", block.alias("block"))
    start = F.col("block") * step
    return rows.repartition(tasks, "stream", "block").select("stream", "block", "path", start.alias("start"), F.least(F.lit(step), F.col("length") - start).cast("int").alias("bytes"))


def separator_scan(blocks: DataFrame, separator: int, dtype: str = "<u2", group: int = 1024) -> DataFrame:
    """(stream, doc_no, start, n_tokens, closed): every document's place in its stream and tokens before its separator.

    ``blocks`` are those of ``read_flat_files``, or rows that hold their ``payload``.  ``doc_no`` counts from 0
    in a stream; tokens behind a stream's last separator are a document that is not ``closed``.  Two separators
    in a row bound a document of no tokens.  A very long document spans any number of blocks.  Null and empty
    payloads have no tokens; an empty table gives an empty result; (stream, block) must be unique, so there are
    no ties and no repeated rows.  Other columns of ``blocks``, however named, are not read.
    """
    columns = ["stream", "block", "payload"] if "payload" in blocks.columns else ["stream", "block", "path", "start", "bytes"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                if "payload" in columns:
                    body = row.column("payload")[0].as_buffer()
                else:
                    body = blobs.read(*(row.column(c)[0].as_py() for c in ("path", "start", "bytes")))
                tokens = np.frombuffer(body, dtype=dtype) if body is not None else np.empty(0, dtype)
                at = np.flatnonzero(tokens == separator).astype(np.int64)
                cols = [row.column("stream"), row.column("block"), pa.array([len(tokens)], pa.int64()), pa.array([at], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["stream", "block", "size", "at"])

    stream = dict(blocks.dtypes)["stream"]
    found = blocks.select(*columns).mapInArrow(search, f"stream {stream}, block long, size long, at array<long>")
    # every block is searched once; what follows reads places, not tokens
    found = materialize(found, "separators").withColumn("grp", F.floor(F.col("block") / group))

    # level 1: inside a group of blocks
    before = Window.partitionBy("stream", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = found.withColumns({"off": F.coalesce(F.sum("size").over(before), F.lit(0)), "docs": F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)).cast("long")})
    last_here = F.when(F.size("at") > 0, F.col("off") + F.element_at("at", -1))
    local = local.withColumn("end", last_here).withColumn("prev", F.max("end").over(before))
    # level 2: groups of a stream
    groups = found.groupBy("stream", "grp").agg(F.sum("size").alias("g_size"), F.sum(F.size("at")).alias("g_docs"))
    ends = local.groupBy("stream", "grp").agg(F.max("end").alias("g_end"))
    earlier = Window.partitionBy("stream").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.join(ends, ["stream", "grp"])
    groups = groups.withColumns({"g_off": F.coalesce(F.sum("g_size").over(earlier), F.lit(0)), "g_before": F.coalesce(F.sum("g_docs").over(earlier), F.lit(0))})
    groups = groups.withColumn("g_prev", F.max(F.col("g_off") + F.col("g_end")).over(earlier)).select("stream", "grp", "g_off", "g_before", "g_prev")
    whole = local.join(groups, ["stream", "grp"])
    first = F.coalesce(F.col("g_off") + F.col("prev"), F.col("g_prev"), F.lit(-1)) + 1  # where the block's first document began
    off = F.col("g_off") + F.col("off")
    ends_at = F.transform("at", lambda p: p + off)
    docs = F.transform(
        ends_at,
        lambda e, k: F.struct(
            (F.col("g_before") + F.col("docs") + k).alias("doc_no"),
            F.when(k == 0, first).otherwise(off + F.get("at", k - 1) + 1).alias("start"),
            (e - F.when(k == 0, first).otherwise(off + F.get("at", k - 1) + 1)).alias("n_tokens"),
            F.lit(True).alias("closed"),
        ),
    )
    closed = whole.select("stream", F.inline(docs))
    # what stands behind a stream's last separator
    tail = found.groupBy("stream").agg(F.sum("size").alias("total"))
    last = whole.groupBy("stream").agg(F.max(F.when(F.size("at") > 0, off + F.element_at("at", -1))).alias("last"), F.sum(F.size("at")).alias("n"))
    rest = tail.join(last, "stream").where(F.col("total") > F.coalesce(F.col("last"), F.lit(-1)) + 1)
    start = F.coalesce(F.col("last"), F.lit(-1)) + 1
    rest = rest.select("stream", F.col("n").alias("doc_no"), start.alias("start"), (F.col("total") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(rest)
