"""Encoding what is pending: as many jobs for many batches as for one, and what a failure leaves."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.store import Store

N = 240


def lengths(texts):
    return np.array([[float(len(t)), 1.0] for t in texts])


def filled(spark, path, n=N):
    s = Store(spark, path)
    s.add_batch(spark.range(n).select(F.concat(F.lit("run "), "id").alias("text"), F.lit("live").alias("source"), F.col("id").alias("started_at")))
    return s


def stumbling(folder, word):
    """An encoder that notes how many texts it was given, and fails at one of them."""

    def encode(texts):
        import uuid
        from pathlib import Path

        (Path(folder) / uuid.uuid4().hex).write_text(str(len(texts)))
        time.sleep(0.02)
        if word in texts:
            raise ValueError("stumbled")
        return np.array([[float(len(t)), 2.0] for t in texts])

    return encode


def test_many_batches_take_as_many_jobs_as_one(spark, tmp_path):
    jobs = {}
    for batch in (8, 100, 1000):
        s = filled(spark, f"file://{tmp_path}/{batch}")
        spark.sparkContext.setJobGroup(f"drain-{batch}", "")
        try:
            assert s.embed_pending(lengths, "m", batch) == N and s.embed_pending(lengths, "m", batch) == 0
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[batch] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"drain-{batch}"))
        got = {r.text: (r.dims, list(r.vector)) for r in s.commands().join(s.table("embeddings"), F.col("id") == F.col("command_id")).collect()}
        assert got == {f"run {i}": (2, [float(len(f"run {i}")), 1.0]) for i in range(N)}
    assert jobs[8] == jobs[100] == jobs[1000] > 0


@pytest.mark.parametrize("kind", ["file", "viewfs"])
def test_a_failure_loses_one_batch_at_most(spark, tmp_path, kind):
    """What was saved stays and replaces older vectors, is not encoded again, and goes when its command is forgotten."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.drain.link./d", f"file://{tmp_path}")
    path = f"file://{tmp_path}/store" if kind == "file" else "viewfs://drain/d/store"
    s, calls, batch = filled(spark, path), tmp_path / "calls", 24
    calls.mkdir()
    assert s.embed_pending(lengths, "old", 100) == N
    with pytest.raises(Exception, match="stumbled"):
        s.embed_pending(stumbling(calls, f"run {N // 2}"), "new", batch)
    begun = sum(int(p.read_text() or 0) for p in calls.iterdir())
    time.sleep(1)  # tasks that are stopped may still save what they have in hand
    s = Store(spark, path)
    vectors = {r.command_id: r.model_id for r in s.table("embeddings").collect()}
    saved = sum(m == "new" for m in vectors.values())
    assert len(vectors) == s.table("embeddings").count() == N and 0 < saved < N and begun - saved <= batch
    assert s.forget("run 23") == 11 and s.table("embeddings").count() == N - 11  # 23 and 230 to 239
    assert not any(p.name == "_encoded" for p in (tmp_path / "store").rglob("*"))
    left = s.table("embeddings").where("model_id = 'old'").count()
    assert s.embed_pending(lengths, "new", batch) == left > 0
    assert s.table("embeddings").groupBy("model_id").count().collect() == [("new", N - 11)]
    assert not any(p.name == "_encoded" for p in (tmp_path / "store").rglob("*"))


def test_a_second_run_keeps_what_the_first_one_saved(spark, tmp_path):
    s, calls = filled(spark, f"file://{tmp_path}/store"), tmp_path / "calls"
    calls.mkdir()
    with pytest.raises(Exception, match="stumbled"):
        s.embed_pending(stumbling(calls, f"run {N // 2}"), "m", 24)
    time.sleep(1)
    saved = s.table("embeddings").count()
    assert 0 < saved < N and s.embed_pending(lengths, "m", 24) == N - saved
    assert s.table("embeddings").count() == N and s.table("embeddings").where("vector[1] = 2").count() == saved
