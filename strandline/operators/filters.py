"""Metadata filters over commands, as semi-joins with their executions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.store import failed, latest


@dataclass(frozen=True)
class Filter:
    """All parts that are set must hold.  ``git_root`` widens ``dir`` and says nothing without it."""

    dir: str | None = None
    git_root: str | None = None
    session: str | None = None
    failed: bool = False

    @property
    def is_zero(self) -> bool:
        return self == Filter()


def preset(name: str, cwd: str | None = None, git_root: str | None = None, session: str | None = None) -> Filter:
    """The filters of the search panel: all, dir, session and failed."""
    return {"all": Filter(), "dir": Filter(dir=cwd, git_root=git_root), "session": Filter(session=session), "failed": Filter(failed=True)}[name]


def apply(commands: DataFrame, executions: DataFrame, f: Filter) -> DataFrame:
    """Commands that pass; a filter with nothing set adds no join."""
    if f.dir:
        inside = F.col("cwd") == f.dir
        inside = inside | (F.col("git_root") == f.git_root) if f.git_root else inside
        commands = commands.join(executions.where(inside).select("text"), "text", "left_semi")
    if f.session:
        commands = commands.join(executions.where(F.col("session_id") == f.session).select("text"), "text", "left_semi")
    if f.failed:
        commands = commands.join(latest(executions.select("id", "text", "started_at", "exit_code")).where(failed(F.col("exit_code"))).select("text"), "text", "left_semi")
    return commands


def installed(catalogue: DataFrame, programs: DataFrame) -> DataFrame:
    """Catalogue rows whose program (``requires``, or else ``tool``) is among ``programs(name)``."""
    need = F.coalesce(F.nullif("requires", F.lit("")), "tool")
    return catalogue.withColumn("__need", need).join(programs.select(F.col("name").alias("__need")).distinct(), "__need", "left_semi").drop("__need")
