"""Display strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole units from the largest down, in seconds.
UNITS = ((365 * 86400, "year"), (30 * 86400, "month"), (7 * 86400, "week"), (86400, "day"), (3600, "hour"), (60, "minute"))


def _counted(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))


def relative_time(at_ms: Column, now_ms: Column) -> Column:
    """``3 weeks ago``: the largest whole unit; under a minute, or ahead of now, ``just now``."""
    seconds = F.floor((now_ms - at_ms) / 1000)
    out = F.when(at_ms.isNull(), F.lit(None).cast("string"))
    for size, unit in UNITS:
        out = out.when(seconds >= size, F.concat(_counted(F.floor(seconds / size), unit), F.lit(" ago")))
    return out.otherwise("just now")


def tilde_path(path: Column, home: str) -> Column:
    """The home directory written as ``~``."""
    if not home:
        return path
    inside = F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))
    return F.when(path == home, "~").when(path.startswith(home + "/"), inside).otherwise(path)


def details(cwd: Column, last_run_ms: Column, exit_code: Column, run_count: Column, home: str, now_ms: Column) -> Column:
    """``~/api · 3 weeks ago · exit 0 · 4 runs``; parts that are not known are left out."""
    return F.concat_ws(" · ", tilde_path(cwd, home), F.coalesce(relative_time(last_run_ms, now_ms), F.lit("imported")), F.concat(F.lit("exit "), exit_code.cast("string")), _counted(run_count, "run"))


def panel_row(text: Column, cwd: Column, last_run_ms: Column, exit_code: Column, run_count: Column, home: str, now_ms: Column) -> Column:
    """One line: the text with line feeds shown, its details, and a tick or cross for the last exit."""
    parts = F.concat_ws(" · ", tilde_path(cwd, home), F.coalesce(relative_time(last_run_ms, now_ms), F.lit("imported")), F.when(run_count > 1, F.concat(run_count.cast("string"), F.lit("×"))))
    mark = F.when(exit_code.isNull(), "").when(exit_code == 0, " ✓").otherwise(" ✗")
    return F.concat(F.replace(text, F.lit("\n"), F.lit(" ↵ ")), F.lit("  "), parts, mark)


def suggestion_line(desc: Column) -> Column:
    return F.concat(F.lit("suggested · "), desc)


def shell_quote(text: Column) -> Column:
    """Single-quoted for a POSIX shell."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def cursor_chars(command: Column, cursor_bytes: Column) -> Column:
    """A byte offset as a number of characters."""
    return F.length(F.decode(F.substring(F.encode(command, "UTF-8"), F.lit(1), cursor_bytes), "UTF-8"))


def comment_lines(text: Column) -> Column:
    """Every line as a shell comment, without line feeds at the end of the text or spaces at the end of a line."""
    lines = F.split(F.regexp_replace(text, r"\n+\z", ""), "\n")
    return F.array_join(F.transform(lines, lambda x: F.rtrim(F.concat(F.lit("# "), x))), "\n")
