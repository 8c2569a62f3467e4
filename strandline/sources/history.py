"""Shell history files as rows (path, seq, command, started_at, duration_ms); times in milliseconds.

Files go through Spark's readers.  Lines are grouped into entries by running sums over each file's line
numbers, so a file's sums run in one task, in a sort that spills; files run side by side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.epoch import valid_utf8
from strandline.plans.shared import copy_file, fresh_path


def _stamp(line: Column) -> Column:
    """Seconds of a ``#digits`` line that fit 64 bits, else null."""
    return F.when(line.rlike(r"^#[0-9]+\z"), F.substring(line, 2, 1 << 30).try_cast("long"))


def _blank(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\s\p{Z}]+", "")) == 0


def bash_entries(lines: DataFrame) -> DataFrame:
    """Entries of ``lines(path, line_no, line)``.

    Before a file's first time line every line that is not blank is a command; from there on, all lines up
    to the next time line are one command, without leading blank lines, dropped if nothing is left.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    rows = lines.withColumn("stamp", _stamp(F.col("line")))
    rows = rows.withColumn("entry", F.count("stamp").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    plain = rows.where("entry = 0").where(~_blank(F.col("line"))).select("path", F.col("line_no").alias("seq"), F.col("line").alias("command"), F.lit(None).cast("long").alias("started_at"))
    grouped = rows.where("entry > 0").groupBy("path", "entry").agg(
        F.min("line_no").alias("seq"),
        F.max("stamp").alias("stamp"),
        F.sort_array(F.collect_list(F.when(F.col("stamp").isNull(), F.struct("line_no", "line")))).alias("body"),
    )
    text = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["line"]), "\n"), r"^(?:[ \t\r\f]*\n)+", "")
    timed = grouped.select("path", "seq", text.alias("command"), (F.col("stamp") * 1000).alias("started_at")).where(~_blank(F.col("command")))
    return plain.union(timed).withColumn("duration_ms", F.lit(None).cast("long"))


def zsh_entries(lines: DataFrame) -> DataFrame:
    """Entries of ``lines(path, line_no, line)``: a line that ends in a backslash goes on in the next.

    ``: start:elapsed;command`` carries a time and a duration; anything else is a command as it stands.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    rows = lines.withColumn("open", F.col("line").endswith("\\"))
    starts = F.when(F.coalesce(F.lag("open").over(order), F.lit(False)), 0).otherwise(1)
    rows = rows.withColumn("starts", starts).withColumn("entry", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when(F.col("open"), F.concat(F.expr("left(line, length(line) - 1)"), F.lit("\n"))).otherwise(F.col("line"))
    grouped = rows.groupBy("path", "entry").agg(F.min("line_no").alias("seq"), F.sort_array(F.collect_list(F.struct("line_no", piece.alias("p")))).alias("body"))
    text = grouped.withColumn("text", F.array_join(F.transform("body", lambda x: x["p"]), ""))
    pattern = r"(?s)^: (-?[0-9]+):(-?[0-9]+);(.*)$"
    part = lambda k: F.regexp_extract("text", pattern, k)
    start, elapsed = part(1).try_cast("long"), part(2).try_cast("long")
    fits = start.isNotNull() & elapsed.isNotNull()
    out = text.select(
        "path", "seq",
        F.when(fits, part(3)).otherwise(F.col("text")).alias("command"),
        F.when(fits, start * 1000).alias("started_at"),
        F.when(fits, elapsed * 1000).alias("duration_ms"),
    )
    return out.where(~_blank(F.col("command")))


@F.pandas_udf(T.BinaryType())
def unmetafy(raw: pd.Series) -> pd.Series:
    """zsh's byte escape undone: 0x83 and a byte stand for that byte with bit 5 turned over."""

    def plain(b: bytes) -> bytes:
        if b"\x83" not in b:
            return b
        first, *rest = b.split(b"\x83")
        # a 0x83 behind another one is itself the escaped byte, and splits an empty part off
        out, k = [first], 0
        while k < len(rest):
            if rest[k] or k + 1 == len(rest):
                out.append(bytes([rest[k][0] ^ 0x20]) + rest[k][1:] if rest[k] else b"\x83")
                k += 1
            else:
                out.append(b"\xa3" + rest[k + 1])
                k += 2
        return b"".join(out)

    return pd.Series([None if b is None else plain(bytes(b)) for b in raw], dtype=object)


def _read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content).  Spark skips files whose names begin with a dot or an underscore, as history files' do: such
    files are copied under plain names first, and keep the path that was asked for."""
    hidden = [p for p in paths if p.rstrip("/").rsplit("/", 1)[-1][:1] in (".", "_")]
    files = [spark.read.format("binaryFile").load(p) for p in [[p for p in paths if p not in hidden]] if p]
    if hidden:
        names, folder = {}, fresh_path(spark, "history-files")
        for k, p in enumerate(hidden):
            copy_file(spark, p, f"{folder}/file-{k}")
            names[f"file-{k}"] = p
        asked = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        files.append(spark.read.format("binaryFile").load(folder).withColumn("path", asked[F.substring_index("path", "/", -1)]))
    out = files[0].select("path", "content")
    return out if len(files) == 1 else out.union(files[1].select("path", "content"))


def file_lines(spark: SparkSession, paths: list[str], zsh: bool = False) -> DataFrame:
    """(path, line_no, line) of history files; one line feed, then one carriage return, is cut off each line."""
    files = _read_files(spark, paths)
    body = unmetafy("content") if zsh else F.col("content")
    text = F.regexp_replace(valid_utf8(body), r"\n\z", "")  # a last line feed ends a line and starts none
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.regexp_replace("line", r"\r\z", ""))


def read_history(spark: SparkSession, paths: list[str], shell: str) -> DataFrame:
    lines = file_lines(spark, paths, shell == "zsh")
    return zsh_entries(lines) if shell == "zsh" else bash_entries(lines)


def import_history(entries: DataFrame) -> DataFrame:
    """Executions of imported entries: redacted; private and empty commands are left out."""
    from strandline.functions.redact import ignored, scrub

    rows = entries.where(~ignored(F.col("command"))).withColumn("s", scrub("command"))
    return rows.select(F.col("s.text").alias("text"), F.col("s.redactions").alias("redacted"), "started_at", "duration_ms", F.lit("import").alias("source")).where(F.length("text") > 0)
