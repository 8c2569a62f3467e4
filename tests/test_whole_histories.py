"""The history queries over whole texts: the SQL's rows, and no line lost."""

from collections import Counter

import duckdb
import pytest

from strandline.plans.oracles import ORACLE_SQL
from strandline.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def turns():
    return duckdb.sql(f"SELECT conv_id, turn, coalesce(text, '') AS text FROM '{SF}/conversations.parquet' ORDER BY 1, 2").fetchall()


@pytest.mark.parametrize("name", ["parse_history", "parse_zsh_history"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert Counter(map(tuple, QUERIES[name](spark, SF).collect())) == Counter(want) and len(want) > 0


@pytest.mark.parametrize("name", ["parse_history", "parse_zsh_history"])
def test_every_line_is_there(spark, name, turns):
    filled = lambda texts: Counter(x for t in texts for x in t.split("\n") if x.strip())
    want, got = filled(t for _, _, t in turns), filled(r.command for r in QUERIES[name](spark, SF).collect())
    assert got == want and any("\n" in r.command.strip() for r in QUERIES[name](spark, SF).collect())
