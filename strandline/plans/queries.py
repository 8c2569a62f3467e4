"""The engine's bundled queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import display, epoch, redact
from strandline.operators import evaluation, filters, fulltext, ranking, store, vectors
from strandline.operators.filters import Filter
from strandline.plans.shared import fresh_path, materialize, spread, table
from strandline.sources.history import bash_entries, zsh_entries
from strandline.sources.tables import EXECUTIONS_SQL, NOW_MS, executions_of
from strandline.streaming import capture

HOME = "/srv"
MODEL = "m1"


def _executions(spark: SparkSession, d: str) -> DataFrame:
    return executions_of(table(spark, d, "events"))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    return store.commands_of(_executions(spark, d), NOW_MS)


def upsert_commands(spark, d):
    return _commands(spark, d)


def stream_upsert(spark, d):
    """The same command table through a file stream in several micro-batches."""
    where = fresh_path(spark, "stream")
    source = table(spark, d, "events")
    source.repartition(4, "event_id").write.parquet(f"{where}/in")
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    rows = events.selectExpr(*[x for x in _execution_columns()])
    capture.upsert_stream(rows, f"{where}/batches", f"{where}/checkpoint", NOW_MS).awaitTermination()
    return capture.current(spark, f"{where}/batches")


def _execution_columns() -> list[str]:
    body = EXECUTIONS_SQL.format(millis="unix_millis(CAST(ts AS TIMESTAMP))").strip().removeprefix("SELECT ").removesuffix("FROM events").strip()
    out, depth, last = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(body[last:i].strip())
            last = i + 1
    return [*out, body[last:].strip()]


def latest_execution(spark, d):
    return store.latest(_executions(spark, d)).select("text", "id", "started_at", "exit_code")


def filter_dir(spark, d):
    e = _executions(spark, d)
    return filters.apply(_commands(spark, d), e, Filter(dir="/srv/u1", git_root="/srv/g3")).select("text", "run_count")


def filter_session(spark, d):
    return filters.apply(_commands(spark, d), _executions(spark, d), Filter(session="7")).select("text", "run_count")


def filter_failed(spark, d):
    return filters.apply(_commands(spark, d), _executions(spark, d), Filter(failed=True)).select("text", "run_count")


def recent_commands(spark, d):
    return store.recent(_commands(spark, d), 20).select("id", "text", "last_seen")


def hydrate_results(spark, d):
    """The twenty most recent commands with their latest run's details."""
    commands = materialize(_commands(spark, d), "commands")
    ids = store.recent(commands, 20).select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("last_seen"), F.desc("id"))).alias("pos"))
    return store.hydrate(commands, _executions(spark, d), ids).select("pos", "text", "run_count", "cwd", "exit_code", "last_run")


def find_substring(spark, d):
    return store.find(table(spark, d, "documents"), "ing th").select("doc_id")


def stats_by_source(spark, d):
    return store.stats(_commands(spark, d), _executions(spark, d))


def last_live_run(spark, d):
    return store.last_live_run(_executions(spark, d))


def _stored_vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("command_id"), F.when(F.col("label") == 0, "m0").otherwise(MODEL).alias("model_id"), F.size("embedding").alias("dims"), F.col("embedding").alias("vector"))


def pending_embeddings(spark, d):
    return store.pending(table(spark, d, "documents").select("doc_id"), _stored_vectors(spark, d), MODEL, "doc_id")


def pending_count(spark, d):
    return pending_embeddings(spark, d).agg(F.count("*").alias("pending"))


def save_embeddings(spark, d):
    """Vectors of a new model replace those of the old one; vectors without an English document go."""
    old = _stored_vectors(spark, d)
    new = old.where("model_id = 'm0'").withColumn("model_id", F.lit("m2"))
    docs = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return store.save_embeddings(old, new, docs).select("command_id", "model_id", "dims")


def embedding_matrix(spark, d):
    return store.embedding_matrix(_stored_vectors(spark, d), MODEL).agg(F.count("*").alias("n"), F.max("dims").cast("long").alias("dims"))


def forget_cascade(spark, d):
    """Executions that are left once all commands of users 1 to 9 are forgotten."""
    e = _executions(spark, d)
    gone = e.where("text RLIKE ' --user [1-9]$'").select("text").distinct()
    return store.forget(gone, executions=e)["executions"].select("id", "text")


def forgotten_runs(spark, d):
    e = _executions(spark, d)
    return store.count_runs(e, e.where("text RLIKE ' --user [1-9]$'").select("text"))


def _keywords(spark, d, mode, where=None):
    found = fulltext.keyword_search(table(spark, d, "documents"), "the thi", mode, where, 10)
    return found.select("doc_id", F.round("bm25", 6).alias("bm25"))


def keyword_and(spark, d):
    return _keywords(spark, d, "and")


def keyword_or(spark, d):
    return _keywords(spark, d, "or")


def keyword_filtered(spark, d):
    return _keywords(spark, d, "or", F.col("lang") == "fr")


_INDEXES: dict[tuple[str, str], str] = {}


def document_index(spark, d) -> tuple[DataFrame, DataFrame]:
    """(postings, stats) of the documents; written once an application and table, read by every search after that."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        path = fresh_path(spark, "index")
        fulltext.write_index(table(spark, d, "documents"), path, partitions=8)
        _INDEXES[key] = path
    return fulltext.read_index(spark, _INDEXES[key])


def keyword_index(spark, d):
    """The same search over a written index."""
    return fulltext.search_index(*document_index(spark, d), "the thi", "or", 10).select("doc_id", F.round("bm25", 6).alias("bm25"))


def keyword_index_filtered(spark, d):
    allowed = table(spark, d, "documents").where("lang = 'fr'").select("doc_id")
    return fulltext.search_index(*document_index(spark, d), "the thi", "or", 10, allowed).select("doc_id", F.round("bm25", 6).alias("bm25"))


def _query_vector(spark, d, vec_id=0, among: DataFrame | None = None) -> list[float]:
    """Empty where there is no such row."""
    found = (among or table(spark, d, "embeddings")).where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(found["embedding"] or []) if found else []


def vector_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.top_k(rows, _query_vector(spark, d, among=rows), 10).select("vec_id", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), _query_vector(spark, d), 10, F.col("label") == 1).select("vec_id", F.round("score", 6).alias("score"))


def normalised_vectors(spark, d):
    unit = vectors.normalise(F.transform("embedding", lambda x: x.cast("double") * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.dot(unit, unit), 9).alias("norm"), F.round(vectors.dot(unit, F.col("embedding")), 6).alias("cosine"))


def _rank(spark, d, params=ranking.Params("or"), where=None, limit=20):
    rows = table(spark, d, "embeddings")
    return ranking.rank(table(spark, d, "documents"), rows, "the thi", _query_vector(spark, d, 3, rows) or None, params, where, limit, index=document_index(spark, d))


def rrf_fuse(spark, d):
    return _rank(spark, d).select("id", F.round("score", 9).alias("score"), "keyword")


def hybrid_search(spark, d):
    """What a user sees, with texts of ``benchmark`` as suggestions."""
    catalogue = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    rows = table(spark, d, "embeddings")
    known = rows.join(catalogue.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    return ranking.search(table(spark, d, "documents"), rows, catalogue, known, "the thi", _query_vector(spark, d, 3, rows) or None, 12, ranking.Params("or"), index=document_index(spark, d))


def library_dedup(spark, d):
    """Catalogue texts that no document holds already."""
    return table(spark, d, "benchmark").join(table(spark, d, "documents").select("text"), "text", "left_anti").select("item_id")


def _eval_lists(spark, d, keep: int, *order: str) -> DataFrame:
    """For each source as a query, its documents in an order: (query_id, id, rank) up to ``keep``."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*[F.desc(o[1:]) if o[0] == "-" else F.asc(o) for o in order]))
    return docs.withColumn("rank", place).where(F.col("rank") <= keep).select("query_id", "id", "rank")


def _eval_truth(spark, d) -> tuple[DataFrame, DataFrame]:
    """(every query, its relevant documents): those that labels call good and toxic."""
    docs = table(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"))
    good = table(spark, d, "labels").where("quality = 1 AND toxic = 1").select(F.col("doc_id").alias("id"))
    return docs.select("query_id"), docs.join(good, "id", "left_semi")


_SHARES = ("top1", "top5", "mrr")


def eval_metrics(spark, d):
    queries, relevant = _eval_truth(spark, d)
    out = evaluation.metrics(_eval_lists(spark, d, 10, "-n_chars", "id"), relevant, queries)
    return out.select(*[F.round(x, 9).alias(x) for x in _SHARES], "n_queries")


def eval_grid(spark, d):
    """Metrics of three rankers over the same queries: longest first, oldest first, and both fused."""
    queries, relevant = _eval_truth(spark, d)
    a, b = _eval_lists(spark, d, 50, "-n_chars", "id"), _eval_lists(spark, d, 50, "id")
    key = lambda df: df.select(F.struct("query_id", "id").alias("id"), "rank")
    both = ranking.fuse([(key(a), 1.0), (key(b), 0.5)]).select("id.query_id", "id.id", F.round("score", 12).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    fused = both.withColumn("rank", place).select("query_id", "id", "rank")
    lists = [df.withColumn("ranker", F.lit(name)) for name, df in (("longest", a), ("oldest", b), ("fused", fused))]
    out = evaluation.metrics(lists[0].union(lists[1]).union(lists[2]), relevant, queries, ["ranker"])
    return out.select("ranker", *[F.round(x, 9).alias(x) for x in _SHARES])


def _whole_lines(texts, *before):
    """Lines of whole texts (path, turn, text): cut at line feeds only, numbered by turn and position, behind the lines ``before``."""
    lines = F.concat(*before, F.split("text", "\n"))
    return texts.select("path", "turn", F.posexplode(lines).alias("pos", "line")).select("path", (F.col("turn") * (1 << 32) + F.col("pos")).alias("line_no"), "line")


def _whole_texts(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("path"), "turn", F.coalesce("text", F.lit("")).alias("text"))


def parse_history(spark, d):
    """Conversations as bash histories: every line of every text, and a time line before the text of every third turn."""
    stamp = F.concat(F.lit("#17000000"), F.lpad(F.col("turn").cast("string"), 2, "0"))
    lines = _whole_lines(_whole_texts(spark, d), F.when(F.col("turn") % 3 == 1, F.array(stamp)).otherwise(F.array().cast("array<string>")))
    return bash_entries(lines).select("path", "seq", "command", "started_at")


def parse_zsh_history(spark, d):
    """Conversations as zsh histories: a text of an even turn is one timed entry, its line feeds behind backslashes; lines of the others stand alone.

    Every second timed entry runs on into the next turn.
    """
    timed = F.concat(F.lit(": 1700000000:"), F.col("turn").cast("string"), F.lit(";"), F.replace("text", F.lit("\n"), F.lit("\\\n")))
    text = F.when(F.col("turn") % 2 == 0, timed).otherwise(F.col("text"))
    text = F.when(F.col("turn") % 4 == 2, F.concat(text, F.lit("\\"))).otherwise(text)
    return zsh_entries(_whole_lines(_whole_texts(spark, d).withColumn("text", text))).select("path", "seq", "command", "started_at", "duration_ms")


def scrub_env(spark, d):
    raw = F.concat(F.lit("  export API_TOKEN=tok"), F.col("event_id").cast("string"), F.lit(" && ./run "))
    rows = spread(table(spark, d, "events")).select("event_id", redact.scrub(raw).alias("s"))
    return rows.select("event_id", F.col("s.text").alias("text"), F.col("s.redactions").alias("redactions"))


def class_entropy(spark, d):
    """Shannon entropy of every long token of the documents."""
    found = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9+/_=-]{20,}"), F.lit(0))
    rows = spread(table(spark, d, "documents")).select("doc_id", F.posexplode(found).alias("pos", "token"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.round(redact.entropy(F.col("token")), 6).alias("bits"))


def relative_time(spark, d):
    return _executions(spark, d).select("id", display.relative_time(F.col("started_at"), F.lit(NOW_MS)).alias("ago"))


def details_line(spark, d):
    e = store.latest(_executions(spark, d))
    rows = e.join(_commands(spark, d).select("text", "run_count"), "text")
    return rows.select("text", display.details(F.col("cwd"), F.col("started_at"), F.col("exit_code"), F.col("run_count"), HOME, F.lit(NOW_MS)).alias("line"))


def panel_rows(spark, d):
    e = store.latest(_executions(spark, d))
    rows = e.join(_commands(spark, d).select("text", "run_count"), "text")
    return rows.select("text", display.panel_row(F.col("text"), F.col("cwd"), F.col("started_at"), F.col("exit_code"), F.col("run_count"), HOME, F.lit(NOW_MS)).alias("line"))


def epoch_times(spark, d):
    start = F.concat((F.lit(1700000000) + F.col("event_id")).cast("string"), F.when(F.col("event_id") % 2 == 0, ".25").otherwise(",5"))
    end = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.concat((F.lit(1700000002) + F.col("event_id") - F.col("event_id") % 4).cast("string"), F.lit(".75")))
    rows = table(spark, d, "events").select("event_id", epoch.parse_epoch_ms(start).alias("start_ms"), epoch.parse_epoch_ms(end).alias("end_ms"))
    return rows.withColumn("duration_ms", epoch.duration_ms(F.col("start_ms"), F.col("end_ms")))


def git_roots(spark, d):
    rows = _executions(spark, d).select("id", F.concat("cwd", F.lit("/src/"), "session_id").alias("cwd"))
    roots = rows.sparkSession.createDataFrame([("/srv",), ("/srv/u1",), ("/srv/u2/src",), ("/srv/u2/sr",)], "root string")
    return epoch.with_git_root(rows, roots).select("id", "git_root")


def installed_tools(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.element_at(F.split("text", " "), 1).alias("tool"), F.when(F.col("item_id") % 3 == 0, "git").otherwise("").alias("requires"))
    names = table(spark, d, "documents").select(F.element_at(F.split("text", " "), 1).alias("name")).union(spark.createDataFrame([("git",)], "name string"))
    return filters.installed(rows, names).select("item_id")


def toy_ranker(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("item_id").alias("age"), "text")
    return ranking.toy_rank(rows, "and the", 10)


QUERIES = {
    f.__name__: f
    for f in (
        upsert_commands, stream_upsert, latest_execution, filter_dir, filter_session, filter_failed, recent_commands, hydrate_results, find_substring,
        stats_by_source, last_live_run, pending_embeddings, pending_count, save_embeddings, embedding_matrix, forget_cascade, forgotten_runs,
        keyword_and, keyword_or, keyword_filtered, keyword_index, keyword_index_filtered, vector_topk, vector_topk_filtered, normalised_vectors, rrf_fuse, hybrid_search,
        library_dedup, eval_metrics, eval_grid, parse_history, parse_zsh_history, scrub_env, class_entropy, relative_time, details_line, panel_rows,
        epoch_times, git_roots, installed_tools, toy_ranker,
    )
}
