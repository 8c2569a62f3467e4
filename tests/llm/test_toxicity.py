"""The ordinal fit on data drawn from its own model, and the verdicts on labelled documents."""

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import queries as Q
from strandline.llm import toxicity
from tests.llm.cases import documents


def test_ordinal_fit_recovers_order():
    rnd = np.random.default_rng(1)
    n, true_w, true_t = 4000, np.array([2.0, -1.5, 0.0, 0.7]), np.array([-0.5, 0.8, 2.0])
    x = rnd.normal(size=(n, 4))
    grades = ((x @ true_w + rnd.logistic(size=n))[:, None] > true_t).sum(1)
    rows, cols = np.repeat(np.arange(n), 4), np.tile(np.arange(4), n)
    w, t = toxicity.fit_ordinal(rows, cols, x.ravel(), grades, 4, 4, rounds=400)
    assert np.abs(w - true_w).max() < 0.25 and np.abs(t - true_t).max() < 0.25 and (np.diff(t) > 0).all()


def test_ordinal_fit_against_brute_force():
    """The fit is a minimum of the loss as the model is written down: no small step in any direction lowers it."""
    rnd = np.random.default_rng(2)
    n, k, l2 = 300, 3, 1e-3
    x = rnd.normal(size=(n, k))
    grades = ((x @ np.array([1.0, -0.5, 0.2]) + rnd.logistic(size=n))[:, None] > np.array([-0.3, 0.9])).sum(1)

    def loss(w, t):
        total = 0.0
        for row, g in zip(x, grades):
            over = [1.0, *(1 / (1 + np.exp(b - row @ w)) for b in t), 0.0]  # P(grade >= 0), P(grade > 0), P(grade > 1), 0
            total -= np.log(over[g] - over[g + 1])
        return total / n + l2 * (w @ w) / 2 / k

    w, t = toxicity.fit_ordinal(np.repeat(np.arange(n), k), np.tile(np.arange(k), n), x.ravel(), grades, k, 3, l2=l2, rounds=3000)
    least = loss(w, t)
    for _ in range(60):
        dw, dt = rnd.normal(size=k) * 0.05, rnd.normal(size=2) * 0.05
        assert loss(w + dw, t + dt) >= least - 1e-6
    assert least < loss(np.zeros(k), np.log([1 / (grades >= 1).mean() - 1, 1 / (grades >= 2).mean() - 1])) - 0.01


def test_scores_against_brute_force(spark):
    """Severity is the sum over grades of P(grade > k), from weights times log counts, feature by feature."""
    words = ["vile", "fools", "fool", "foolish", "day", "nice"]
    model = toxicity.Model({"vile": 0, "fool|": 1, "fooli|": 2, "nice": 3}, np.array([1.5, 0.7, 0.4, -1.0]), np.array([0.5, 2.0]))
    rnd = np.random.default_rng(3)
    texts = [" ".join(rnd.choice(words, size=rnd.integers(0, 30))) for _ in range(40)] + [None, "", "Vile, FOOLISH!"]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in rows:
        counts = toxicity.features(r.text)
        z = sum(model.weights[k] * np.log1p(counts[f]) for f, k in model.vocabulary.items())
        over = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        assert abs(r.severity - sum(over)) < 1e-9 and abs(r.p_toxic - over[0]) < 1e-9


def test_grades_come_from_labels(spark, monkeypatch):
    """Harmless, harmless of poor quality, toxic: in this order, whatever the texts say; features of both signs are used."""
    say = F.when(F.col("doc_id") % 3 == 0, "such a vile fool").otherwise("a fine day for all")
    docs = spark.range(300).withColumnRenamed("id", "doc_id").withColumn("text", say)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    used, plain = [], toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda r, c, v, grades, *a, **k: used.append(grades) or plain(r, c, v, grades, *a, **k))
    model = toxicity.fit(docs, labels)
    assert np.bincount(used[0]).tolist() == [100, 100, 100] and len(model.thresholds) == model.toxic_from == 2
    assert {"vile", "fine"} <= set(model.vocabulary) and model.weights[model.vocabulary["vile"]] > 0 > model.weights[model.vocabulary["fine"]]


def test_op3_on_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op3_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("toxic", "label")
    both = got.join(labels, "doc_id").toPandas()
    assert both[both["label"] == 1]["toxic"].mean() >= 0.95 and both[both["label"] == 0]["toxic"].mean() <= 0.01


def test_edges(spark):
    docs = documents(spark)
    text = [(i, "such a vile fool" if i % 3 == 0 else "a fine day for all", int(i % 3 == 0)) for i in range(300)]
    frame = spark.createDataFrame(text, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), max_rows=200)
    got = toxicity.score(docs.withColumn("toxic", F.lit("clash")), model).collect()
    assert len(got) == docs.count() and not any(r.toxic for r in got) and all(0 <= r.severity <= 3 for r in got)
    assert all(r.toxic for r in toxicity.score(frame.where("toxic = 1").select("doc_id", "text"), model).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, frame.select("doc_id", "toxic").limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, none).collect())


def test_repeated_ids_fill_the_sample(spark, monkeypatch):
    """Labels that repeat ids leave the sample whole, and documents that repeat them do not pass its bound."""
    say = F.when(F.col("doc_id") % 3 == 0, "such a vile fool").otherwise("a fine day for all")
    docs = spark.range(100).withColumnRenamed("id", "doc_id").withColumn("text", say)
    labels = spark.range(400_000).select((F.col("id") % 100).alias("doc_id"), (F.col("id") % 100 % 3 == 0).cast("int").alias("toxic"))
    used, plain = [], toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda r, c, v, grades, *a, **k: used.append(grades) or plain(r, c, v, grades, *a, **k))
    model = toxicity.fit(docs, labels, max_rows=100)
    assert [(len(g), (g > 0).sum()) for g in used] == [(100, 34)]
    assert toxicity.score(docs, model).where("toxic").count() == 34
    more = docs.union(docs).union(spark.range(500).select(F.lit(0).cast("long"), F.concat(F.lit("such a vile fool "), F.col("id").cast("string"))))
    toxicity.fit(more, labels, max_rows=120)
    toxicity.fit(more, labels, max_rows=1000)
    assert [len(g) for g in used[1:]] == [120, 600] and (used[1] == 0).sum() == 66


def test_labels_kept_out_of_the_fit(spark):
    """Five folds by a hash of the id: each scored by a fit on the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = []
    for k in range(5):
        out = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == k
        held = labels.where(out).select("doc_id", F.col("toxic").alias("label"))
        found += toxicity.score(docs.join(held, "doc_id"), toxicity.fit(docs, labels.where(~out))).select("label", "toxic").collect()
    toxic, clean = [r.toxic for r in found if r.label == 1], [r.toxic for r in found if r.label == 0]
    assert (len(toxic), len(clean)) == (51, 348) and sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.01 * len(clean)
