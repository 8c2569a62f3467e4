"""Store, filters, search, ranking, evaluation, sources and streaming on small own cases."""

import math
import random
import re
import sqlite3
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions.epoch import with_git_root
from strandline.operators import evaluation, filters, fulltext, ranking, store, vectors, wordpiece
from strandline.operators.filters import Filter
from strandline.sources.history import import_history, read_history
from strandline.sources.pages import read_pages
from strandline.sources.tables import read_queries

E = "id long, text string, started_at long, cwd string, git_root string, session_id string, exit_code int, source string, redacted int"
ROWS = [
    (1, "a", 100, "/x", "/g", "s1", 0, "live", 1), (2, "a", None, "/y", None, None, 1, "import", 0), (3, "a", 90, "/z", None, "s2", None, "manual", 0),
    (4, "b", 50, "/y", "/g", "s1", 2, "live", 0), (5, "b", 50, None, None, "s1", 3, "live", 0), (6, "c", None, None, None, None, None, "import", 0),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(ROWS, E)


def texts(df):
    return sorted(r.text for r in df.collect())


def test_upsert_and_merge(runs):
    want = {"a": (1, 90, 999, 3, 1), "b": (4, 50, 50, 2, 0), "c": (6, 999, 999, 1, 0)}
    whole = store.commands_of(runs, 999)
    assert {r.text: (r.id, r.first_seen, r.last_seen, r.run_count, r.redacted) for r in whole.collect()} == want
    parts = [store.commands_of(runs.where(c), 999) for c in ("id % 2 = 1", "id % 2 = 0")]
    for a, b in (parts, parts[::-1]):
        assert {r.text: (r.id, r.first_seen, r.last_seen, r.run_count, r.redacted) for r in store.merge_commands(a, b).collect()} == want


def test_latest_and_filters(runs):
    commands = store.commands_of(runs, 999)
    assert {r.text: r.id for r in store.latest(runs).collect()} == {"a": 1, "b": 5, "c": 6}
    assert texts(filters.apply(commands, runs, Filter(dir="/x"))) == ["a"]
    assert texts(filters.apply(commands, runs, Filter(dir="/x", git_root="/g"))) == ["a", "b"]
    assert texts(filters.apply(commands, runs, Filter(git_root="/g"))) == ["a", "b", "c"] and not Filter(git_root="/g").is_zero
    assert texts(filters.apply(commands, runs, Filter(session="s2"))) == ["a"]
    assert texts(filters.apply(commands, runs, Filter(failed=True))) == ["b"]
    assert filters.apply(commands, runs, filters.preset("all")) is commands
    assert filters.preset("dir", "/x", "/g") == Filter("/x", "/g")


def test_hydrate_stats_forget(spark, runs):
    commands = store.commands_of(runs, 999)
    ids = spark.createDataFrame([(4, 0), (77, 1), (1, 2)], "id long, pos int")
    assert [(r.text, r.cwd, r.last_run) for r in store.hydrate(commands, runs, ids).collect()] == [("b", None, 50), ("a", "/x", 100)]
    s = store.stats(commands, runs).first()
    assert (s.commands, s.live, s.imported, s.other, s.redactions) == (3, 3, 2, 1, 1)
    assert store.last_live_run(runs).first()[0] == 100
    gone = spark.createDataFrame([("a",)], "text string")
    assert store.count_runs(runs, gone).first()[0] == 3
    assert {k: texts(v) for k, v in store.forget(gone, runs=runs, commands=commands).items()} == {"runs": ["b", "b", "c"], "commands": ["b", "c"]}
    assert [r.text for r in store.recent(commands, 2).collect()] == ["c", "a"]
    odd = spark.createDataFrame([("50%",), ("50x",), ("A",)], "text string")
    assert texts(store.find(odd, "50%")) == ["50%"] and texts(store.find(odd, "a")) == []


def test_embeddings_lifecycle(spark):
    old = spark.createDataFrame([(1, "m1", 2, [0.5, -1.5]), (2, "m1", 2, [3e-8, 1.0])], schemas.EMBEDDINGS)
    commands = spark.createDataFrame([(1,), (3,)], "id long")
    new = spark.createDataFrame([(1, "m2", 2, [9.0, 9.0]), (5, "m2", 2, [1.0, 1.0])], schemas.EMBEDDINGS)
    assert [(r.command_id, r.model_id) for r in store.save_embeddings(old, new, commands).collect()] == [(1, "m2")]
    assert sorted(r.id for r in store.pending(commands, old, "m2").collect()) == [1, 3] and [r.id for r in store.pending(commands, old, "m1").collect()] == [3]
    assert store.embedding_matrix(old, "m1").count() == 2
    with pytest.raises(Exception, match="differ in length"):
        store.embedding_matrix(old.unionByName(spark.createDataFrame([(3, "m1", 1, [1.0])], schemas.EMBEDDINGS)), "m1").collect()
    back = old.select("vector", vectors.from_bytes(vectors.to_bytes("vector")).alias("a"), vectors.from_half(vectors.to_half("vector")).alias("b")).collect()
    assert all(r.vector == r.a and np.allclose(r.vector, r.b, atol=1e-3) for r in back)
    calls = spark.createDataFrame([(1, "x"), (2, "x"), (3, "yy"), (4, None)], "id long, text string")
    got = vectors.embed_distinct(calls, lambda ts: np.array([[len(t), 1.0] for t in ts]), "m9")
    assert sorted((r.command_id, r.vector) for r in got.collect()) == [(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])]


def test_schema_checks(spark, runs):
    meta = spark.createDataFrame([("schema_version", "1"), ("imported:/h", "x")], schemas.META)
    assert schemas.check_version(meta) == 1
    with pytest.raises(ValueError):
        schemas.check_version(store.set_meta(meta, "schema_version", "2"))
    files = spark.createDataFrame([("/h",), ("/k",)], "path string")
    assert [r.path for r in store.new_files(files, meta).collect()] == ["/k"] and store.new_files(files, meta, force=True).count() == 2
    assert schemas.checked_executions(runs.withColumn("cwd", F.lit(""))).select("cwd").distinct().collect()[0].cwd is None
    for bad in (runs.withColumn("text", F.lit(" ")), runs.withColumn("source", F.lit("odd"))):
        with pytest.raises(Exception, match="empty command|unknown source"):
            schemas.checked_executions(bad).collect()


CORPUS = ["docker run postgres", "docker ps -a", "git status", "GIT Commit --amend", "résumé of foo_bar", "run docker-compose up docker", "", None, "kubectl get pods", "go run . && go test ./..."]


@pytest.mark.parametrize("mode", ["and", "or"])
@pytest.mark.parametrize("query", ["docker", "docker ps", "git st", "dock post", "RESUME", "foo", "go go", 'doc" OR *', "nothing", "", "!!", "run up"])
def test_bm25_agrees_with_fts5(spark, mode, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(i, t or "") for i, t in enumerate(CORPUS)])
    words = [w for w in re.split(r"[^\w]+|_", unicodedata.normalize("NFC", query)) if w]
    match = (" " if mode == "and" else " OR ").join(f'"{w}"*' for w in words)
    want = db.execute("SELECT rowid, bm25(f) AS s FROM f WHERE f MATCH ? ORDER BY s, rowid LIMIT 5", (match,)).fetchall() if words else []
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    got = [(r.doc_id, r.bm25) for r in fulltext.keyword_search(docs, query, mode, limit=5).collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, want))
    indexed = [(r.doc_id, r.bm25) for r in fulltext.search_index(*fulltext.postings(docs), query, mode, 5).collect()]
    assert [i for i, _ in indexed] == [i for i, _ in got] and all(math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(got, indexed))


def test_index_scan_prunes(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    fulltext.write_index(docs, f"file://{tmp_path}", partitions=2)
    terms, lengths = fulltext.read_index(spark, f"file://{tmp_path}")
    hits = terms.where((F.col("term") >= "doc") & (F.col("term") < "dod"))
    assert "GreaterThanOrEqual(term,doc)" in hits._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in fulltext.search_index(terms, lengths, "docker", limit=5).collect()] == [r.doc_id for r in fulltext.keyword_search(docs, "docker", limit=5).collect()]


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from strandline.plans.shared import shared_dir

    def session(master, named=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: named), sparkContext=context)

    assert shared_dir(session("spark://x:7077", "hdfs://y/z/")) == "hdfs://y/z" and shared_dir(session("local[2]")).startswith("file://")
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(session(master))


def test_scripts_fold_alike(spark):
    """A word of a document finds it, whatever its script, composed or not."""
    texts = ["한국어 문서 검색", "データベースが大きい", "ガギグ パピプ", "Straße und Größe", "naïve cafe\u0301", "Ελληνικά άλφα", "йод ёлка", "日本語 の 本"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms, stats = fulltext.postings(docs)
    for i, text in enumerate(texts):
        for word in text.split():
            assert i in {r.doc_id for r in fulltext.keyword_search(docs, word).collect()}, word
            assert i in {r.doc_id for r in fulltext.search_index(terms, stats, word).collect()}, word


def test_search_many_equals_one_by_one(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    asked = ["docker ps", "git st", "dock post", "RESUME", "go go", "", "run up"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    terms, stats = (df.cache() for df in fulltext.postings(docs))
    for mode in ("and", "or"):
        got = {}
        for r in fulltext.search_many(terms, stats, queries, mode, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, round(r.bm25, 9)))
        for i, q in enumerate(asked):
            assert got.get(i, []) == [(r.doc_id, round(r.bm25, 9)) for r in fulltext.keyword_search(docs, q, mode, limit=5).collect()]
    allowed = spark.createDataFrame([(1,)], "doc_id long")
    assert [r.doc_id for r in fulltext.search_index(terms, stats, "docker", "or", 5, allowed).collect()] == [1]


def test_top_k_of_many_queries(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8 if i % 9 else 5).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in (1, 2, 9)], "query_id string, vector array<double>")
    got = vectors.top_k_many(frame, queries, 7).collect()
    for i in (1, 2):
        one = [(r.vec_id, round(r.score, 9)) for r in vectors.top_k(frame, rows[i][1], 7).collect()]
        assert [(r.id, round(r.score, 9)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == f"q{i}"] == one
    with pytest.raises(ValueError):
        vectors.top_k_many(frame, queries, 7, max_queries=2)


def test_top_k_agrees_with_a_full_sort(spark):
    rnd = np.random.default_rng(3)
    m = rnd.normal(size=(200, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    for k in (1, 5, 200, 210):
        order = np.argsort(-(m @ m[7]), kind="stable")[:k]
        assert [r.vec_id for r in vectors.top_k(frame, [*m[7], 9.0], k).collect()] == order.tolist()
    assert all(r.vec_id % 2 for r in vectors.top_k(frame, m[7].tolist(), 9, F.col("label") == 1).collect())
    assert "TakeOrderedAndProject" in vectors.top_k(frame, m[7].tolist(), 5)._jdf.queryExecution().executedPlan().toString()


def test_fusion(spark):
    lists = lambda *ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id long, rank int")
    order = lambda *x: [r.id for r in ranking.fuse(list(x)).orderBy(F.desc("score"), "id").collect()]
    assert order((lists(1, 2), 1), (lists(3, 2), 1)) == [2, 1, 3] and order((lists(1), 1), (lists(3), 2)) == [3, 1] and order((lists(9, 4), 1), (lists(), 1)) == [9, 4]


def test_hybrid_and_interleave(spark):
    docs = spark.createDataFrame([(0, "docker ps"), (1, "list containers"), (2, "git log"), (3, "docker images")], "doc_id long, text string")
    vecs = spark.createDataFrame([(0, [0.6, 0.8]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    lib = spark.createDataFrame([(10, "docker top"), (11, "git log"), (12, "podman ps")], "id long, text string")
    libv = spark.createDataFrame([(10, [0.9, 0.1]), (11, [0.8, 0.2]), (12, [0.7, 0.3])], "vec_id long, embedding array<double>")
    ids = lambda **k: [r.id for r in ranking.rank(docs, vecs, "docker", **k).collect()]
    assert ids(query_vector=None) == [3, 0] or ids(query_vector=None) == [0, 3]
    assert set(ids(query_vector=[1.0, 0.0])) == {0, 1, 2, 3} and set(ids(query_vector=[1.0, 0.0], where=F.col("doc_id") > 1)) == {2, 3}
    shown = [(r.text, r.library) for r in ranking.search(docs, vecs, lib, libv, "docker", [1.0, 0.0], 6).collect()]
    assert {t for t, _ in shown[:2]} == {"docker ps", "docker images"} and not shown[0][1]
    assert shown[2:] == [("list containers", False), ("docker top", True), ("git log", False), ("podman ps", True)]
    assert not any(r.library for r in ranking.search(docs, vecs, lib, libv, "docker", [1.0, 0.0], 6, where=F.col("doc_id") >= 0).collect())
    toy = spark.createDataFrame([(1, 0, "deploy the app"), (2, 1, "deploying apps"), (3, 2, "x")], "id long, age int, text string")
    assert [(r.id, r.score) for r in ranking.toy_rank(toy, "deploy app").collect()] == [(1, 2), (2, 1), (3, 0)]


def test_evaluation(spark):
    results = spark.createDataFrame([("q1", 5, 1), ("q1", 6, 2), ("q2", 7, 1), ("q2", 8, 4), ("q3", 9, 11)], "query_id string, id long, rank int")
    relevant = spark.createDataFrame([("q1", 5), ("q2", 8), ("q3", 9), ("q4", 1)], "query_id string, id long")
    queries = spark.createDataFrame([("q1",), ("q2",), ("q3",), ("q4",)], "query_id string")
    m = evaluation.metrics(results, relevant, queries).first()
    assert (m.top1, m.top5, m.mrr, m.n_queries) == (0.25, 0.5, 0.3125, 4)
    assert sorted(r.query_id for r in evaluation.misses(results, relevant, queries).collect()) == ["q3", "q4"]
    assert len(evaluation.grid()) == 22
    pool = spark.createDataFrame([(1, "ls")], "id long, text string")
    ask = lambda *t: spark.createDataFrame([("q", list(t))], "query_id string, expected array<string>")
    assert evaluation.checked_expectations(ask("ls"), pool).first().id == 1
    with pytest.raises(Exception, match="not in the pool"):
        evaluation.checked_expectations(ask("rm"), pool).collect()


def test_histories(spark, tmp_path):
    write = lambda name, raw: (tmp_path / name).write_bytes(raw) and f"file://{tmp_path / name}"
    bash = write("bash", b"git status\n\n  \ndocker ps\r\nls -la")
    read = lambda path, shell: [(r.command, r.started_at, r.duration_ms) for r in read_history(spark, [path], shell).orderBy("seq").collect()]
    assert read(bash, "bash") == [(c, None, None) for c in ("git status", "docker ps", "ls -la")]
    timed = write("timed", b"#not a time\n#1700000000\ngit status\n#1700000060\n\nfor i in 1 2; do\n\n  echo $i\ndone\n#1700000120\n#1700000180\nls\n")
    assert [r[:2] for r in read(timed, "bash")] == [("#not a time", None), ("git status", 1700000000000), ("for i in 1 2; do\n\n  echo $i\ndone", 1700000060000), ("ls", 1700000180000)]
    zsh = write("zsh", b": 1700000000:5;make test\ngit status\n: 1700000100:0;for f in *; do\\\n  echo $f\\\ndone\n:not extended;weird\n")
    assert read(zsh, "zsh") == [("make test", 1700000000000, 5000), ("git status", None, None), ("for f in *; do\n  echo $f\ndone", 1700000100000, 0), (":not extended;weird", None, None)]
    assert read(write("meta", b": 1700000000:0;echo \xe6\x83\xb7\xa5 caf\xc3\xa9\n"), "zsh")[0][0] == "echo 日 café"
    assert read(write("end", b"echo one\\"), "zsh") == [("echo one\n", None, None)]
    assert read(write("bad", b"a\xff\xfeb\n"), "bash")[0][0] == "a�b"
    entries = read_history(spark, [write("secret", b" private\nexport API_TOKEN=abc\n\n")], "bash")
    assert [(r.text, r.redacted, r.source) for r in import_history(entries).collect()] == [("export API_TOKEN=<REDACTED:secret-env>", 1, "import")]


def test_other_sources(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.md").write_text("# a\n")
    assert [(r.dir_rank, r.md) for r in read_pages(spark, [f"file://{tmp_path}/p"]).collect()] == [(0, "# a\n")]
    (tmp_path / "q.jsonl").write_text('{"query": "x", "expected": ["ls"]}\n\n')
    assert [(r.query, r.expected) for r in read_queries(spark, f"file://{tmp_path}/q.jsonl").collect()] == [("x", ["ls"])]
    rows = spark.createDataFrame([(1, "/w/a/src"), (2, "/w/ab"), (3, None), (4, "/w/a")], "id long, cwd string")
    roots = spark.createDataFrame([("/w/a",), ("/w",)], "root string")
    assert {r.id: r.git_root for r in with_git_root(rows, roots).collect()} == {1: "/w/a", 2: "/w", 3: None, 4: "/w/a"}


def test_wordpiece():
    vocabulary = {w: i for i, w in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "git", "-", "日", "cafe"])}
    assert wordpiece.basic_tokens("Café git-x日本\u0000!") == ["cafe", "git", "-", "x", "日", "本", "!"]
    assert wordpiece.encode("Unaffable git-日 CAFÉ zzz", vocabulary) == [1, 3, 4, 5, 6, 7, 8, 9, 0, 2]
    assert wordpiece.encode("a" * 101, vocabulary) == [1, 0, 2] and len(wordpiece.encode("git " * 400, vocabulary)) == 256


def test_stream_equals_batch(spark, sf):
    from strandline.plans import queries

    key = lambda df: sorted(map(tuple, df.select("text", "id", "first_seen", "last_seen", "run_count", "redacted").collect()))
    assert key(queries.stream_upsert(spark, sf)) == key(queries.upsert_commands(spark, sf))


def test_capture_redacts(spark, tmp_path):
    from strandline.streaming import capture

    raw = "raw string, id long, started_at long"
    spark.createDataFrame([("make DB_PASSWORD=hunter2", 1, 5), (" private", 2, 6), ("", 3, 7)], raw).write.parquet(f"{tmp_path}/in")
    stream = capture.redacted_executions(spark.readStream.schema(raw).parquet(f"{tmp_path}/in"))
    for _ in range(2):  # a second start finds nothing new
        capture.upsert_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", 9).awaitTermination()
    capture.compact(spark, f"{tmp_path}/out", f"{tmp_path}/small")
    assert [(r.text, r.redacted, r.run_count) for r in capture.current(spark, f"{tmp_path}/small").collect()] == [("make DB_PASSWORD=<REDACTED:secret-env>", 1, 1)]
