"""Catalogue pages in Markdown: a name, a summary and example commands with placeholders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EXAMPLE = T.StructType([T.StructField("desc", T.StringType()), T.StructField("command", T.StringType()), T.StructField("cursor", T.IntegerType())])
PAGE = T.StructType([*(T.StructField(x, T.StringType()) for x in ("name", "summary", "requires")), T.StructField("examples", T.ArrayType(_EXAMPLE))])

_MNEMONIC = re.compile(r"\[([A-Za-z0-9]+)\]")
_PART_OF = re.compile(r"Part of `([^`]+)`")
#: An escaped pair of braces, or a placeholder: its inside holds no "}}" but behind a backslash, and takes a third brace.
_PIECE = re.compile(r"\\\{\\\{|\\\}\\\}|\{\{((?:\\.|(?!\}\}).)*)(\}*)\}\}", re.DOTALL)


def resolve(command: str) -> tuple[str, int]:
    """A command with its placeholders filled in, and the byte at which the first one starts (else its length)."""
    out, cursor, at = "", None, 0
    for m in _PIECE.finditer(command):
        out += command[at : m.start()]
        at = m.end()
        if m[1] is None:
            out += "{{" if m[0][1] == "{" else "}}"
            continue
        inner = (m[1] + m[2]).replace("\\{", "{").replace("\\}", "}")
        if inner[:1] == "[" and inner[-1:] == "]" and "|" in inner:
            out += inner[1:-1].split("|", 1)[0]  # an option in its short form
        else:
            cursor = len(out.encode()) if cursor is None else cursor
            out += inner
    out += command[at:]
    return out, len(out.encode()) if cursor is None else cursor


def parse_page(md: str) -> dict:
    page, desc = {"name": "", "summary": "", "requires": "", "examples": []}, ""
    for line in md.split("\n"):
        mark, rest = line[:2], line[2:].strip()
        if mark == "# ":
            page["name"] = page["name"] or rest
        elif mark == "> ":
            page["summary"] = page["summary"] or _MNEMONIC.sub(r"\1", rest)
            if (m := _PART_OF.search(rest)) and m[1].split():
                page["requires"] = m[1].split()[0]
        elif mark == "- ":
            desc = _MNEMONIC.sub(r"\1", rest.removesuffix(":"))
        elif desc and len(line) > 1 and line[0] == line[-1] == "`":
            command, cursor = resolve(line[1:-1])
            if not command.startswith("tldr "):
                page["examples"].append({"desc": desc, "command": command, "cursor": cursor})
            desc = ""
    return page


@F.pandas_udf(PAGE)
def parse(md: pd.Series) -> pd.DataFrame:
    made = [parse_page(x or "") for x in md]
    return pd.DataFrame({k: pd.Series([p[k] for p in made], dtype=object) for k in ("name", "summary", "requires", "examples")})


def catalogue(pages: DataFrame) -> DataFrame:
    """(tool, requires, command, cursor, desc, embed_text) of ``pages(dir_rank, path, md)``.

    A page name counts once: in the first directory, then the first path, that has it.
    """
    rows = pages.withColumn("p", parse("md")).select("dir_rank", "path", "p.*").where("name <> ''")
    place = F.row_number().over(Window.partitionBy("name").orderBy("dir_rank", "path"))
    rows = rows.withColumn("place", place).where("place = 1").withColumn("e", F.explode("examples"))
    text = F.concat(F.col("name"), F.lit(": "), F.col("e.desc"), F.lit(". "), F.col("summary"))
    return rows.select(F.split("name", r"\s+")[0].alias("tool"), "requires", "e.command", "e.cursor", "e.desc", text.alias("embed_text"))


def read_pages(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """(dir_rank, path, md) of all ``.md`` files under ``dirs``, earlier directories first."""
    parts: Iterator[DataFrame] = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(d, wholetext=True).select(F.lit(k).alias("dir_rank"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("md")) for k, d in enumerate(dirs)
    )
    out = next(parts)
    for p in parts:
        out = out.union(p)
    return out
