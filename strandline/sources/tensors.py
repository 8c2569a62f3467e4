"""Tensor files in the safetensors layout: a length, a JSON header of names, kinds, shapes and offsets, and raw values."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"F32": "<f4", "F16": "<f2"}
TENSOR = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("data", T.ArrayType(T.FloatType()))]))


def parse_tensors(raw: bytes) -> list[dict]:
    """Name, shape and values of every tensor; a header that does not fit its file is an error."""
    size = int.from_bytes(raw[:8], "little")
    if len(raw) < 8 or size > len(raw) - 8:
        raise ValueError("tensors: the header is longer than the file")
    body, out = raw[8 + size :], []
    for name, info in sorted(json.loads(raw[8 : 8 + size]).items()):
        if name == "__metadata__":
            continue
        kind, (start, end) = _KINDS.get(info["dtype"]), info["data_offsets"]
        if kind is None:
            raise ValueError(f"tensors: {name} is of kind {info['dtype']}")
        n = int(np.prod(info["shape"], dtype=np.int64))
        if not 0 <= start <= end <= len(body) or end - start != n * np.dtype(kind).itemsize:
            raise ValueError(f"tensors: {name} has bad offsets")
        out.append({"name": name, "shape": info["shape"], "data": np.frombuffer(body[start:end], kind).astype("f4").tolist()})
    return out


@F.pandas_udf(TENSOR)
def tensors(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else parse_tensors(bytes(b)))


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, shape, data) of all tensor files under ``path``, one file a task."""
    files = spark.read.format("binaryFile").load(path).select("path", F.explode(tensors("content")).alias("t"))
    return files.select("path", "t.*")
