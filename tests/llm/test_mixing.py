"""The mix: targets, exact quotas, disjoint draws, whole-row texts and the sampler under it."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strandline.llm import mixing
from strandline.llm import queries as Q
from tests.llm.cases import documents
from tests.llm.test_queries import WORD


def plain_targets(sizes):
    """{source: target} by handing on the excess of capped sources, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def check(rows, sizes):
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, n in sizes.items():
        assert abs(taken[s] - want[s]) <= max(0.75, n / 300)


def test_op2(spark, sf):
    docs = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    source, sizes = {d["doc_id"]: d["source"] for d in docs}, {}
    for d in docs:
        sizes[d["source"]] = sizes.get(d["source"], 0) + len(WORD.findall(d["text"] or ""))
    got = Q.op2_mixture(spark, sf).collect()
    assert {r.doc_id: r.size for r in got} == {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs} and len(got) == len(docs)
    check([r.asDict() | {"source": source[r.doc_id]} for r in got], sizes)
    assert sorted(got) == sorted(Q.op2_mixture(spark, sf).collect())


def test_edges_and_shards(spark):
    docs = documents(spark)
    placed, drawn = mixing.mix(docs, block_words=8)
    rows = placed.collect()
    assert len(rows) == docs.count()
    taken = {}
    for d in drawn.collect():
        taken[d.rank, d.offset] = taken.get((d.rank, d.offset), 0) + d.length
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    check([{"size": r.size, "source": r.source, "source_size": r.source_size, "target": r.target, "taken": taken.get((r.rank, r.offset), 0) if r["size"] else 0} for r in rows], sizes)
    blocks = drawn.select("shard", "rank", "draw").distinct().collect()
    assert len({(b.rank, b.draw) for b in blocks}) == len(blocks)  # shards are disjoint
    per_shard = np.bincount([b.shard for b in blocks], minlength=16)
    assert per_shard.max() - per_shard.min() <= 1 and len(per_shard) == 16
    quota = {r.rank: r.quota for r in rows}
    assert {k: sum(b.rank == k for b in blocks) for k in quota} == quota
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    words = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.size(mixing.words(F.col("text")))).alias("n")).collect()}
    for s, n in sizes.items():
        assert words.get(s, 0) == sum(taken.get((r.rank, r.offset), 0) for r in rows if r.source == s and r["size"])
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs, block_words=8).collect() == mixed.collect()
    lists = mixing.mixed_documents(docs.withColumn("shard", F.lit("clash")), block_words=8, placed=True).withColumn("part", F.spark_partition_id()).collect()
    for part in {r.part for r in lists}:  # every task's rows lie shard by shard, each in its own order
        own = [(r.shard, r.order_key) for r in lists if r.part == part]
        assert own == sorted(own)
    assert len({r.shard for r in lists}) == 16
    assert "Python" not in drawn._jdf.queryExecution().executedPlan().toString()


def test_the_tree_decides(spark, monkeypatch):
    """Blocks are taken where a shard's quota reaches them: with smaller quotas, less is taken."""
    docs = documents(spark)
    full = mixing.mix(docs, block_words=8)[1]
    plain = mixing.shard_quotas
    monkeypatch.setattr(mixing, "shard_quotas", lambda *a, **k: plain(*a, **k).withColumn("upto", F.transform("upto", lambda u: F.floor(u / 2))))
    half = mixing.mix(docs, block_words=8)[1]
    assert 0.4 < half.count() / full.count() < 0.6


def test_many_sources(spark):
    """Quotas drawn in rows of a few sources are as exact as drawn all at once."""
    plan = spark.range(1, 101).select(F.col("id").alias("rank"), (F.col("id") * 7 % 31).alias("quota"))
    rows = mixing.shard_quotas(plan, 3, seed=5, group=9).collect()
    want = {r.rank: r.quota for r in plan.collect()}
    assert {r.rank: r.upto[-1] for r in rows} == want
    shards = np.array([np.diff([0, *r.upto]) for r in rows])
    assert (shards >= 0).all() and np.ptp(shards.sum(0)) <= 3 and shards.shape == (100, 8)


def test_one_text_in_two_sources(spark):
    """Rows that share id and text, but not the source, each reach their own source's target."""
    docs = spark.createDataFrame([(1, "a b c d e f g h i j", "A"), (1, "a b c d e f g h i j", "B")], "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs).collect()
    words = {s: [w for r in got if r.source == s for w in r.text.split()] for s in "AB"}
    assert len(words["A"]) in (6, 7) and len(words["B"]) in (13, 14) and set(words["B"]) == set("abcdefghij")


def test_hypergeometric(spark):
    """Mean and variance of many draws against the distribution's own, small and very large."""
    for good, bad, sample in ((5, 7, 4), (300, 100, 200), (10**12, 3 * 10**12, 2 * 10**12), (0, 5, 3), (5, 0, 3), (3, 4, 7)):
        n = 4000
        got = spark.range(n).select(mixing.hypergeometric(F.lit(good), F.lit(bad), F.lit(sample), F.xxhash64("id")).alias("x")).toPandas()["x"]
        total, p = good + bad, good / (good + bad)
        var = sample * p * (1 - p) * (total - sample) / (total - 1)
        assert got.between(max(0, sample - bad), min(sample, good)).all()
        assert abs(got.mean() - sample * p) <= 5 * (var / n) ** 0.5 + 1e-9
        assert var == 0 or 0.85 < got.var() / var < 1.15
