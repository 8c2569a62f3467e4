"""Evaluation sets, catalogues and the synthetic history that the bundled queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed "now" of queries that need one, in milliseconds (2024-02-01 UTC).
NOW_MS = 1706745600000

#: A history made of the ``events`` table; the same text serves Spark and DuckDB but for ``{millis}``.
EXECUTIONS_SQL = """
  SELECT event_id AS id, concat(event_type, ' --user ', CAST(user_id AS STRING)) AS text,
    CASE WHEN event_id % 20 BETWEEN 1 AND 3 THEN NULL ELSE {millis} END AS started_at,
    CAST(user_id AS STRING) AS session_id, concat('/srv/u', CAST(user_id % 10 AS STRING)) AS cwd,
    CASE WHEN user_id % 3 = 0 THEN concat('/srv/g', CAST(user_id % 10 AS STRING)) END AS git_root,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS exit_code,
    CASE WHEN event_id % 20 = 0 THEN 'manual' WHEN event_id % 20 < 4 THEN 'import' ELSE 'live' END AS source,
    CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS redacted
  FROM events"""


def executions_of(events: DataFrame) -> DataFrame:
    """The synthetic history over ``events``, as a plan that prunes to what a query uses."""
    names = EXECUTIONS_SQL.format(millis="unix_millis(CAST(ts AS TIMESTAMP))")
    return events.sparkSession.sql(names.replace("FROM events", "FROM {events}"), events=events)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected) of a JSON-lines evaluation set; blank lines are skipped."""
    rows = spark.read.schema("query string, expected array<string>").json(path)
    return rows.where(F.col("query").isNotNull()).withColumn("query_id", F.xxhash64("query"))
