"""Many queries at once: the same results as one by one, over tiles of any size, without a row for each pair."""

import random

import duckdb
import numpy as np
import pytest

from strandline.operators import fulltext, queryset, vectors
from strandline.plans import parts


def shuffled_rows(spark, run):
    """Rows that ``run()`` shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def corpus(spark, n_docs, n_queries):
    rnd = random.Random(5)
    words = [a + b + c for a in "abc" for b in "dé" for c in ("", "x", "yz")]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(0, 30))) for _ in range(n_docs)]
    texts += texts[:9] + [None, "", "ad " * 4000]  # copies tie; a long text fills a tile
    asked = [" ".join(rnd.choices([*words, "a", "b", "none", "cdyzz"], k=rnd.randrange(0, 4))) for _ in range(n_queries)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(asked)], "query_id string, query string"), asked


@pytest.mark.parametrize("tile", [7, 2048])
def test_many_equal_one_by_one(spark, monkeypatch, tile):
    monkeypatch.setattr(queryset, "TILE", tile)
    monkeypatch.setattr(queryset, "TILE_TERMS", 10 * tile)
    monkeypatch.setattr(queryset, "PASS", 5)
    docs, queries, asked = corpus(spark, 60, 12)
    docs.cache()
    got = {}
    for r in fulltext.search_many_texts(docs, queries, ("and", "or"), 8).orderBy("rank").collect():
        got.setdefault((r.mode, r.query_id), []).append((r.id, r["rank"], round(r.bm25, 9)))
    for mode in ("and", "or"):
        by_index = {}
        for r in fulltext.search_many(*fulltext.postings(docs), queries, mode, 8).orderBy("rank").collect():
            by_index.setdefault((mode, r.query_id), []).append((r.id, r["rank"], round(r.bm25, 9)))
        assert by_index == {k: v for k, v in got.items() if k[0] == mode}
        for i, q in enumerate(asked):
            every = sorted((round(r.bm25, 9), r.doc_id) for r in fulltext.keyword_search(docs, q, mode, limit=None).collect())
            assert got.get((mode, f"q{i}"), []) == [(doc, k, score) for k, (score, doc) in enumerate(every[:8], 1)], q


def test_equal_vectors_tie_wherever_they_lie(spark):
    """Copies of a vector score alike in every batch, so ids decide; and scores are those of ``dot``."""
    rnd = np.random.default_rng(8)
    few = rnd.normal(size=(40, 13))
    rows = [(i, few[i % 40 if i % 3 else 7].tolist()) for i in range(6007)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, rnd.normal(size=13).tolist()) for i in range(5)], "query_id int, vector array<double>")
    got = {}
    for r in vectors.top_k_many(frame, queries, 600).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    for q in queries.collect():
        assert got[q.query_id] == [(r.vec_id, r.score) for r in vectors.top_k(frame, q.vector, 600).collect()]


def test_rankers_without_a_row_for_a_pair(spark, tmp_path):
    """Both keyword lists of a query set, without its pairs of a query and a document."""
    n = 2000
    spark.range(n).selectExpr("id AS doc_id", "concat('the run of ', id % 50, ' the run ', id) AS text").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id AS vec_id", "array(cos(id), sin(id)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = []
    shuffled = shuffled_rows(spark, lambda: out.extend(parts.eval_rankers(spark, f"file://{tmp_path}").collect()))
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, out)) == sorted(con.execute(parts.ORACLE_SQL["eval_rankers"]).fetchall())
    rankers_rows = 80 * 50 * 40 + 80 * 22 * 20  # of lists, rankers and results, which grow with queries alone
    assert shuffled < rankers_rows + 80 * n


def test_no_row_for_a_pair(spark):
    """Every query shares a word with every document, yet what is shuffled stays far below their product."""
    docs = spark.createDataFrame([(i, f"the run {i % 50}") for i in range(1000)], "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(i, f"the {i}") for i in range(200)], "query_id int, query string")
    terms, stats = (df.cache() for df in fulltext.postings(docs))
    assert terms.count() == 3000 and stats.count() == 1
    out = {}
    n = shuffled_rows(spark, lambda: out.update({r.query_id: r.id for r in fulltext.search_many(terms, stats, queries, "or", 2).where("rank = 1").collect()}))
    assert len(out) == 200 and out[7] == 7 and n < 200 * 1000 / 4
