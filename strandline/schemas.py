"""The store's tables.  Unknown values are null, never a sentinel; times and durations are milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

COMMANDS = "id long, text string, first_seen long, last_seen long, run_count long, redacted int"
EXECUTIONS = "id long, text string, cwd string, git_root string, exit_code int, duration_ms long, started_at long, session_id string, hostname string, source string, redacted int"
EMBEDDINGS = "command_id long, model_id string, dims int, vector array<float>"
META = "key string, value string"
CATALOGUE = "tool string, requires string, command string, cursor int, desc string"

SOURCES = ("live", "import", "manual")


def check_version(meta: DataFrame) -> int:
    """The store's version; a newer one than this code knows is refused."""
    found = meta.where(F.col("key") == "schema_version").agg(F.max(F.col("value").cast("int"))).first()[0]
    if found is not None and found > SCHEMA_VERSION:
        raise ValueError(f"the store has schema version {found}; this code knows {SCHEMA_VERSION}")
    return found or 0


def checked_executions(rows: DataFrame) -> DataFrame:
    """Executions with empty strings as null; a text that is empty or a source that is unknown fails the job."""
    for name in ("cwd", "git_root", "session_id", "hostname"):
        if name in rows.columns:
            rows = rows.withColumn(name, F.nullif(F.col(name), F.lit("")))
    text = F.when(F.length(F.trim("text")) > 0, F.col("text")).otherwise(F.raise_error(F.lit("empty command text")))
    source = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("unknown source "), F.coalesce("source", F.lit("null")))))
    return rows.withColumns({"text": text, "source": source})
