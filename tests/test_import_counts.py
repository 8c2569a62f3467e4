"""Counts that an import reports."""

from strandline.store import Store


def test_import_counts(spark, tmp_path):
    (tmp_path / "h").write_bytes(b"ls\n private\nexport API_TOKEN=abc\nmake DB_PASSWORD=x1 API_KEY=y2\n  also private\n")
    (tmp_path / "none").write_bytes(b" private\n")
    s, path = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/h"
    assert s.import_counted([path], "bash") == {"imported": 3, "redacted": 3, "skipped": 2}
    assert s.import_counted([path], "bash") == {"imported": 0, "redacted": 0, "skipped": 0}
    assert s.import_counted([f"file://{tmp_path}/none"], "bash") == {"imported": 0, "redacted": 0, "skipped": 1}
    assert s.table("executions").count() == 3
