"""The two-level store: distinct commands over an append-only table of executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def commands_of(executions: DataFrame, now_ms: int, redacted: str = "redacted") -> DataFrame:
    """One row per text: first and last time seen, runs, and the redaction count of the first insert.

    Minima, maxima and counts combine before the shuffle, so a text with a third of all rows is one
    partial row a task.  An execution without a start counts as seen at ``now_ms``.
    """
    seen = F.coalesce("started_at", F.lit(now_ms))
    return executions.groupBy("text").agg(
        F.min("id").alias("id"),
        F.min(seen).alias("first_seen"),
        F.max(seen).alias("last_seen"),
        F.count("*").alias("run_count"),
        F.min(F.struct("id", redacted))[redacted].alias("redacted"),
    )


def merge_commands(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Two command tables as one: the merge commutes, so batches may come in any order."""
    return existing.unionByName(batch.select(*existing.columns)).groupBy("text").agg(
        F.min(F.struct("id", "redacted"))["id"].alias("id"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("run_count").alias("run_count"),
        F.min(F.struct("id", "redacted"))["redacted"].alias("redacted"),
    )


def latest(executions: DataFrame) -> DataFrame:
    """The latest execution of each text: by start (unknown last), then id.  Spark prunes groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc_nulls_last("started_at"), F.desc("id")))
    return executions.withColumn("__place", place).where("__place = 1").drop("__place")


def hydrate(commands: DataFrame, executions: DataFrame, ids: DataFrame) -> DataFrame:
    """Commands named by ``ids(id, pos)`` with their latest run's details, in order of ``pos``; unknown ids are skipped.

    Ids are a result page: they narrow the commands, which narrow the executions, before the window.
    """
    some = commands.join(ids.select("id", "pos"), "id")
    runs = executions.join(some.select("text"), "text", "left_semi")
    last = latest(runs).select("text", "cwd", "exit_code", F.col("started_at").alias("last_run"))
    return some.join(last, "text", "left").orderBy("pos")


def recent(commands: DataFrame, limit: int) -> DataFrame:
    return commands.orderBy(F.desc("last_seen"), F.desc("id")).limit(limit)


def find(commands: DataFrame, part: str, text: str = "text") -> DataFrame:
    """Commands that hold ``part`` as it is: case counts, and nothing in it is a wildcard.  The latest first, where times are known."""
    found = commands.where(F.contains(F.col(text), F.lit(part)))
    return found.orderBy(F.desc("last_seen"), F.desc("id")) if {"last_seen", "id"} <= set(commands.columns) else found


def shown(rows: DataFrame, text: str = "text", limit: int = 10) -> DataFrame:
    """(pos, line) of the first ``limit`` rows by ``pos``, and one line more that counts the rest, if there is any."""
    line = F.concat(F.lit("  "), F.replace(F.col(text), F.lit("\n"), F.lit(" ↵ ")))
    head = rows.where(F.col("pos") <= limit).select(F.col("pos").cast("long").alias("pos"), line.alias("line"))
    rest = rows.agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return head.union(rest.select(F.lit(limit + 1).cast("long"), F.concat(F.lit("  …and "), (F.col("n") - limit).cast("string"), F.lit(" more"))))


def shuffled(rows: DataFrame, seed: str, id: str = "id") -> DataFrame:
    """Rows with their place ``pos`` in an order that depends on the seed and the ids alone."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id).cast("string")))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key, id)))


def stats(commands: DataFrame, executions: DataFrame) -> DataFrame:
    """One row: commands, live, imported and other runs, redactions."""
    runs = executions.agg(*[F.count_if(cond).alias(name) for name, cond in (("live", F.col("source") == "live"), ("imported", F.col("source") == "import"), ("other", ~F.col("source").isin("live", "import")))])
    total = commands.agg(F.count("*").alias("commands"), F.coalesce(F.sum("redacted"), F.lit(0)).alias("redactions"))
    return total.join(runs)  # one row each


def last_live_run(executions: DataFrame) -> DataFrame:
    return executions.where("source = 'live'").agg(F.max("started_at").alias("last_live"))


def forget(texts: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of ``texts(text)``; the caller rewrites its files, so nothing of them stays on disk."""
    gone = texts.select("text").distinct()
    return {name: t.join(gone, "text", "left_anti") for name, t in tables.items()}


def count_runs(executions: DataFrame, texts: DataFrame) -> DataFrame:
    return executions.join(texts.select("text").distinct(), "text", "left_semi").agg(F.count("*").alias("runs"))


def pending(texts: DataFrame, embeddings: DataFrame, model_id: str, id: str = "id", limit: int | None = None) -> DataFrame:
    """Rows of ``texts`` without a vector of this model (a vector of another model does not count); the ``limit`` last seen, if given."""
    have = embeddings.where(F.col("model_id") == model_id).select(F.col("command_id").alias(id))
    rows = texts.join(have, id, "left_anti")
    return rows if limit is None else rows.orderBy(F.desc("last_seen"), F.desc(id)).limit(limit)


def newest_vectors(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One vector a command: new ones replace old ones, whatever their model."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("__new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("command_id").orderBy(F.desc("__new"), "model_id"))
    return both.withColumn("__place", place).where("__place = 1").drop("__place", "__new")


def save_embeddings(existing: DataFrame, new: DataFrame, commands: DataFrame) -> DataFrame:
    """``newest_vectors``, which vanish with their command."""
    return newest_vectors(existing, new).join(commands.select(F.col("id").alias("command_id")), "command_id", "left_semi")


def embedding_matrix(embeddings: DataFrame, model_id: str) -> DataFrame:
    """Vectors of one model; a vector that is not as long as the longest of them fails the job."""
    rows = embeddings.where(F.col("model_id") == model_id)
    most = rows.agg(F.coalesce(F.max("dims"), F.lit(0)).alias("__most"))
    rows = rows.join(F.broadcast(most))  # one row
    fine = (F.col("dims") == F.col("__most")) & (F.size("vector") == F.col("dims"))
    return rows.where(F.when(fine, True).otherwise(F.raise_error(F.lit("vectors of one model differ in length")))).drop("__most")


def set_meta(meta: DataFrame, key: str, value: str) -> DataFrame:
    new = meta.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return meta.where(F.col("key") != key).unionByName(new)


def new_files(files: DataFrame, meta: DataFrame, force: bool = False) -> DataFrame:
    """Files (path) that no ``imported:`` marker names yet."""
    if force:
        return files
    done = meta.where(F.col("key").startswith("imported:")).select(F.substring("key", 10, 1 << 30).alias("path"))
    return files.join(done, "path", "left_anti")


def failed(exit_code: Column) -> Column:
    return F.coalesce(exit_code, F.lit(0)) != 0
