"""SQL names for the engine's functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandline.functions.redact import scrub
from strandline.sources.pages import parse


def register(spark: SparkSession) -> None:
    """``scrub(raw)``, ``parse_page(md)``, ``cosine(a, b)`` and ``relative_time(at_ms, now_ms)`` for this session.

    The last two are SQL functions: the optimizer sees through them.
    """
    spark.udf.register("scrub", scrub)
    spark.udf.register("parse_page", parse)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE "
        "RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, p) -> s + p) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, y) -> s + y * y))"
    )
    cases = " ".join(
        f"WHEN now_ms - at_ms >= {size}000 THEN concat((now_ms - at_ms) DIV {size}000, IF((now_ms - at_ms) DIV {size}000 = 1, ' {unit}', ' {unit}s'), ' ago')"
        for size, unit in ((31536000, "year"), (2592000, "month"), (604800, "week"), (86400, "day"), (3600, "hour"), (60, "minute"))
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION relative_time(at_ms BIGINT, now_ms BIGINT) RETURNS STRING RETURN CASE WHEN at_ms IS NULL THEN NULL {cases} ELSE 'just now' END")
