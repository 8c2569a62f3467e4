"""A history store on Parquet: what the command line of such a tool needs, over the engine's operators.

Tables live under one folder, each as numbered versions.  Executions are appended; whatever replaces rows
writes a new version, after which the old one is deleted, so forgotten texts stay nowhere on disk.  One
writer at a time; readers see the last complete version, and the vectors that were saved since beside it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import display
from strandline.functions.redact import ignored, scrub
from strandline.operators import filters, ranking, store, vectors
from strandline.operators.filters import Filter
from strandline.operators.fulltext import keyword_search
from strandline.operators.ranking import Params
from strandline.plans.shared import materialize, numbered, release
from strandline.sources.history import import_history, read_history

_TABLES = {"executions": schemas.EXECUTIONS, "embeddings": schemas.EMBEDDINGS, "meta": schemas.META, "catalogue": f"id long, {schemas.CATALOGUE}, vector array<float>, model_id string"}
#: Vectors that an encoding has saved so far, file by file: a folder in that of the version they come on top of.
_ENCODED = ("_encoded", "rows")
#: Rows that a task encodes at most, in many parts; tasks of a job in which each encodes one part.
_TASK_ROWS, _TASKS = 1 << 16, 1 << 15
_DETAILS = ("cwd", "git_root", "exit_code", "duration_ms", "started_at", "session_id", "hostname")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        if schemas.check_version(self.table("meta")) == 0:
            self.set_meta("schema_version", str(schemas.SCHEMA_VERSION))

    # tables

    def _fs(self):
        return self._at().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _versions(self, name: str) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._at(name)):
            return []
        found = [f.getPath() for f in fs.listStatus(self._at(name))]
        return sorted(int(p.getName()) for p in found if fs.exists(self._at(name, p.getName(), "_SUCCESS")))

    def _last(self, name: str) -> DataFrame:
        have = self._versions(name)
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}/{have[-1]}") if have else self.spark.createDataFrame([], _TABLES[name])

    def _encoded(self):
        """Where vectors are saved beside their last version, if there is one."""
        have = self._versions("embeddings")
        return self._at("embeddings", str(have[-1]), *_ENCODED) if have else None

    def table(self, name: str) -> DataFrame:
        rows = self._last(name)
        if name == "embeddings" and (at := self._encoded()) and self._fs().exists(at):
            return store.newest_vectors(rows, self.spark.read.schema(_TABLES[name]).parquet(at.toString()))
        return rows

    def _replace(self, name: str, rows: DataFrame) -> None:
        have = self._versions(name)
        rows.write.parquet(f"{self.path}/{name}/{have[-1] + 1 if have else 0}")
        for v in have:
            self._fs().delete(self._at(name, str(v)), True)

    def set_meta(self, key: str, value: str) -> None:
        self._replace("meta", store.set_meta(self.table("meta"), key, value))

    def commands(self) -> DataFrame:
        return store.commands_of(self.table("executions"), _now())

    # writes

    def add_batch(self, rows: DataFrame) -> int:
        """Append redacted executions (text, source and any details); all of them or, if one is refused, none."""
        wanted = {**dict.fromkeys(("text", "source", "redacted"), None), **dict.fromkeys(_DETAILS, None)}
        types = dict(self.table("executions").dtypes)
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(0 if c == "redacted" else None)).cast(types[c]).alias(c) for c in wanted])
        last = self.table("executions").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        rows, n = numbered(schemas.checked_executions(rows), "id", last + 1, "batch")
        have = self._versions("executions")
        rows.select(*types).write.mode("append").parquet(f"{self.path}/executions/{have[-1] if have else 0}")
        release(rows)
        return n

    def add(self, raw: str, source: str = "manual", **details) -> int:
        """One command; a private or empty one is silently left out."""
        rows = self.spark.createDataFrame([(raw,)], "raw string").where(~ignored(F.col("raw"))).withColumn("s", scrub("raw"))
        rows = rows.select(F.col("s.text").alias("text"), F.col("s.redactions").alias("redacted"), F.lit(source).alias("source"), *[F.lit(v).alias(k) for k, v in details.items()])
        return self.add_batch(rows.where(F.length("text") > 0))

    def import_files(self, paths: list[str], shell: str, force: bool = False) -> int:
        """History files that were not imported before; all are marked, in one write, behind the one that appends their entries."""
        return self.import_counted(paths, shell, force)["imported"]

    def import_default(self, shell: str, home: str, env: dict[str, str] | None = None, force: bool = False) -> dict[str, int]:
        """``import_counted`` of the shell's own history file.  One that does not exist yet is marked all the same: what
        the shell writes into it later has been captured live."""
        path = default_history(shell, home, env or {})
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.import_counted([path], shell, force)
        self._mark([path])
        return {"imported": 0, "redacted": 0, "skipped": 0}

    def import_counted(self, paths: list[str], shell: str, force: bool = False) -> dict[str, int]:
        """``import_files`` with its counts: entries imported, secrets redacted in them, entries skipped as private or empty."""
        files = self.spark.createDataFrame([(p,) for p in paths], "path string")
        todo = [r.path for r in store.new_files(files, self.table("meta"), force).collect()]
        if not todo:
            return {"imported": 0, "redacted": 0, "skipped": 0}
        # counted in the write itself: a history file may grow between two reads
        read, kept = Observation(), Observation()
        entries = read_history(self.spark, todo, shell).observe(read, F.count(F.lit(1)).alias("n"))
        n = self.add_batch(import_history(entries).observe(kept, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("redacted"), F.lit(0)).alias("redacted")))
        self._mark(todo)
        return {"imported": n, "redacted": kept.get["redacted"], "skipped": read.get["n"] - kept.get["n"]}

    def _mark(self, paths: list[str]) -> None:
        new = self.spark.createDataFrame([(f"imported:{p}", str(_now())) for p in paths], "key string, value string")
        self._replace("meta", self.table("meta").join(new.select("key"), "key", "left_anti").unionByName(new))

    def forget(self, part: str) -> int:
        """Delete all commands that hold ``part``, with their runs and vectors; returns the number of runs."""
        commands = self.commands()
        gone = store.find(commands, part).select("id", "text")
        runs = store.count_runs(self.table("executions"), gone).first()[0]
        vectors_left = self.table("embeddings").join(gone.select(F.col("id").alias("command_id")), "command_id", "left_anti")
        left = store.forget(gone, executions=self.table("executions"))["executions"]
        self._replace("embeddings", vectors_left)
        self._replace("executions", left)
        return runs

    def set_catalogue(self, rows: DataFrame) -> None:
        """Suggestions with their vectors: (id, tool, requires, command, cursor, desc, vector, model_id).

        Vectors of one model that differ in length, or hold nothing, are refused, and the catalogue stays as it was.
        """
        rows = materialize(rows.select(*self.table("catalogue").columns), "catalogue")
        odd = rows.groupBy("model_id").agg(F.min(F.coalesce(F.size("vector"), F.lit(0))).alias("a"), F.max(F.coalesce(F.size("vector"), F.lit(0))).alias("b")).where("a <> b OR a < 1")
        if odd.limit(1).count():
            raise ValueError("vectors of the catalogue differ in length")
        self._replace("catalogue", rows)

    def embed_pending(self, encoder: Callable[[list[str]], np.ndarray], model_id: str, batch: int = 100_000) -> int:
        """Encode every command that has no vector of this model, the last seen first; returns how many there were.

        Tasks encode parts of batches and save each before they go on.  The parts that all cores have in hand make one
        ``batch`` (or one row a core, if that is more), so a failure loses one at most.
        """
        commands = materialize(self.commands().select("id", "text", "last_seen"), "commands")
        if not (at := self._encoded()) or self._fs().exists(at):  # what a run that failed has saved
            self._replace("embeddings", self.table("embeddings").join(commands.select(F.col("id").alias("command_id")), "command_id", "left_semi"))
        todo = store.pending(commands, self._last("embeddings"), model_id).orderBy(F.desc("last_seen"), F.desc("id"))
        todo, n = numbered(todo, "pos", 0, "pending")
        if n:
            new = self._encode(todo, n, encoder, model_id, batch)
            self._replace("embeddings", store.save_embeddings(self._last("embeddings"), new, commands))
            release(new)
        release(todo, commands)
        return n

    def _encode(self, todo: DataFrame, n: int, encoder: Callable[[list[str]], np.ndarray], model_id: str, batch: int) -> DataFrame:
        """The vectors of the ``n`` rows of ``todo``, saved part by part beside their table's last version."""
        cores, where = self.spark.sparkContext.defaultParallelism, self._encoded()
        size = max(1, batch // cores)
        if (uri := self._fs().makeQualified(where).toUri()).getScheme() == "file":
            # parts are dealt to one task a core in turn, wave by wave, so that the last seen come first
            self._fs().mkdirs(where)
            part, wave = F.floor(F.col("pos") / size), cores * max(1, _TASK_ROWS // size)
            rows = todo.repartitionById(-(-n // (wave * size)) * cores, (F.floor(part / wave) * cores + part % cores).cast("int")).sortWithinPartitions("pos")
            return materialize(vectors.embed(rows, encoder, model_id, uri.getPath(), size), "encoded")
        for first in range(0, n, size * _TASKS):  # elsewhere only Spark can write: a part is a task
            last = min(n, first + size * _TASKS)
            rows = todo.where(F.col("pos").between(first, last - 1)).repartitionById(-(-(last - first) // size), F.floor((F.col("pos") - first) / size).cast("int"))
            # by the second version of the protocol a task's file is in its place when the task ends, whatever becomes of the job
            vectors.embed(rows, encoder, model_id).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(where.toString())
        return materialize(self.spark.read.schema(_TABLES["embeddings"]).parquet(where.toString()), "encoded")

    # queries

    def _texts(self, f: Filter) -> DataFrame:
        return filters.apply(self.commands(), self.table("executions"), f)

    def keyword(self, query: str, limit: int | None = 50, mode: str = "and", f: Filter = Filter()) -> DataFrame:
        """(pos, text, ...) of the best keyword matches, of all without a limit; weights come from all commands, whatever the filter."""
        commands = self.commands()
        marked = commands if f.is_zero else commands.join(self._texts(f).select("text", F.lit(True).alias("ok")), "text", "left")
        found = keyword_search(marked, query, mode, None if f.is_zero else F.col("ok"), limit, "id")
        if limit is None:
            ids, _ = numbered(found, "pos", 1, "matches-in-order")  # no single task sees them all
        else:
            ids = ranking.ranked(found, F.asc("bm25"), F.asc("id")).withColumnRenamed("rank", "pos")
        return store.hydrate(commands, self.table("executions"), ids)

    def recent(self, limit: int = 50, f: Filter = Filter()) -> DataFrame:
        top = store.recent(self._texts(f), limit).select("id", "last_seen")
        ids = ranking.ranked(top, F.desc("last_seen"), F.desc("id")).withColumnRenamed("rank", "pos")
        return store.hydrate(self.commands(), self.table("executions"), ids)

    def search(self, query: str, query_vector: list[float] | None = None, model_id: str = "", limit: int = 5, f: Filter = Filter(), params: Params = Params(), programs: DataFrame | None = None) -> DataFrame:
        """(pos, text, library): hybrid ranking with suggestions of installed programs; by keywords alone without a vector."""
        commands = self._texts(f) if not f.is_zero else self.commands()
        known = self.table("embeddings").where(F.col("model_id") == model_id).select(F.col("command_id").alias("vec_id"), F.col("vector").alias("embedding"))
        offered = self.table("catalogue").where(F.col("model_id") == model_id)
        offered = offered if programs is None else filters.installed(offered, programs)
        lib, libv = offered.select("id", F.col("command").alias("text")), offered.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
        where = None if f.is_zero else F.col("ok")
        every = self.commands() if f.is_zero else self.commands().join(commands.select("text", F.lit(True).alias("ok")), "text", "left")
        return ranking.search(every, known, lib, libv, query, query_vector, limit, params, where, "id")

    def details(self, results: DataFrame, home: str = "") -> DataFrame:
        """(text, line) as a result list shows them."""
        line = display.details(F.col("cwd"), F.col("last_run"), F.col("exit_code"), F.col("run_count"), home, F.lit(_now()))
        return results.select("pos", "text", line.alias("line")).orderBy("pos").drop("pos")

    def status(self, model_id: str = "") -> DataFrame:
        """One row: counts by source, redactions, the last live run, and how many commands wait for a vector."""
        waiting = store.pending(self.commands(), self.table("embeddings"), model_id).agg(F.count("*").alias("pending"))
        return store.stats(self.commands(), self.table("executions")).join(store.last_live_run(self.table("executions"))).join(waiting)


def default_path(home: str, env: dict[str, str]) -> str:
    """Where a store lies if nothing else is said; a relative data folder is ignored."""
    if env.get("STRANDLINE_STORE"):
        return env["STRANDLINE_STORE"]
    data = env.get("XDG_DATA_HOME", "")
    return f"{data if data.startswith('/') else home.rstrip('/') + '/.local/share'}/strandline/store"


def default_history(shell: str, home: str, env: dict[str, str]) -> str:
    """The history file of a shell."""
    return env.get("HISTFILE") or f"{home.rstrip('/')}/.{shell}_history"


def _now() -> int:
    return int(time.time() * 1000)
