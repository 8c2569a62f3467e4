"""The store from first command to last, and the functions under their SQL names."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.register import register
from strandline.operators.filters import Filter
from strandline.plans import parts
from strandline.sources.tensors import parse_tensors, read_tensors
from strandline.store import Store, default_path


def encoder(texts):
    out = np.array([[float("docker" in t), float("git" in t), 0.1] for t in texts])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def test_life_of_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    s = Store(spark, path)
    assert s.add("docker ps", "live", cwd="/w", exit_code=1, started_at=1_700_000_000_000, session_id="s1") == 1
    assert s.add("  docker ps\n".lstrip(), "live", cwd="/v", started_at=1_700_000_060_000) == 1
    assert s.add(" private") == 0 and s.add("make DB_PASSWORD=hunter2") == 1
    (tmp_path / "h").write_text("git status\ngit log\ngit status\n")
    assert s.import_files([f"file://{tmp_path}/h"], "bash") == 3 and s.import_files([f"file://{tmp_path}/h"], "bash") == 0
    s = Store(spark, path)  # another session
    assert {r.text: r.run_count for r in s.commands().collect()} == {"docker ps": 2, "make DB_PASSWORD=<REDACTED:secret-env>": 1, "git status": 2, "git log": 1}
    st = s.status("m").first()
    assert (st.commands, st.live, st.imported, st.other, st.redactions, st.last_live, st.pending) == (4, 2, 3, 1, 1, 1_700_000_060_000, 4)
    assert s.embed_pending(encoder, "m") == 4 and s.embed_pending(encoder, "m") == 0
    assert [(r.text, r.cwd, r.exit_code) for r in s.keyword("dock").collect()] == [("docker ps", "/v", None)]
    assert {r.text for r in s.keyword("git log", mode="or", f=Filter(dir="/w")).collect()} == set()
    assert [r.text for r in s.recent(9, Filter(session="s1")).collect()] == ["docker ps"]
    assert "1 run" in s.details(s.keyword("log")).first().line
    suggestions = [(100, "docker", "", "docker top", 10, "Show processes", [1.0, 0.0, 0.0], "m"), (101, "podman", "", "podman ps", 9, "List", [0.9, 0.1, 0.0], "m")]
    s.set_catalogue(spark.createDataFrame(suggestions, "id long, tool string, requires string, command string, cursor int, desc string, vector array<float>, model_id string"))
    query = encoder(["docker"])[0].tolist()
    shown = [(r.text, r.library) for r in s.search("docker", query, "m", 8).collect()]
    assert shown[0] == ("docker ps", False) and ("docker top", True) in shown and ("podman ps", True) in shown
    only = [r.text for r in s.search("docker", query, "m", 9, programs=spark.createDataFrame([("docker",)], "name string")).collect()]
    assert "docker top" in only and "podman ps" not in only
    assert not any(r.library for r in s.search("docker", query, "m", 4, Filter(dir="/v")).collect())
    assert [r.text for r in s.search("docker").collect()] == ["docker ps"]
    assert s.forget("git ") == 3 and s.forget("nothing like it") == 0
    assert {r.text for r in s.commands().collect()} == {"docker ps", "make DB_PASSWORD=<REDACTED:secret-env>"}
    assert s.table("embeddings").count() == 2
    raw = b"".join(p.read_bytes() for p in (tmp_path / "store").rglob("*") if p.is_file())
    assert b"docker ps" in raw and b"git status" not in raw and b"hunter2" not in raw


def test_keyword_search_of_a_store_without_a_limit(spark, tmp_path):
    """Every match, in order, however many there are; with a limit, the first of them."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, CASE WHEN i % 6 = 0 THEN 8 ELSE 7000 + i END AS user_id, 'click' AS event_type, 0.5::DOUBLE AS value, '{}' AS props FROM range(900) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.execute(parts.ORACLE_SQL["store_drain"]).fetchone()
    assert want[3] > 500
    assert tuple(parts.store_drain(spark, f"file://{tmp_path}").first()) == want
    s = Store(spark, f"file://{tmp_path}/store")
    s.add_batch(spark.createDataFrame([("git log" + " -v" * (i % 3) if i % 5 else "ls", "live", i) for i in range(40)], "text string, source string, started_at long"))
    every, some = s.keyword("git", limit=None).collect(), s.keyword("git", 2).collect()
    assert [r.pos for r in every] == [1, 2, 3] and [r.text for r in every] == ["git log", "git log -v", "git log -v -v"]
    assert some == every[:2] and s.keyword("", limit=None).count() == 0 and s.keyword("none", limit=None).count() == 0


def test_defaults_and_refusals(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    home = f"file://{tmp_path}"
    # the shell's own file is not there yet: marked, so that what is captured live is not imported again
    assert s.import_default("bash", home) == {"imported": 0, "redacted": 0, "skipped": 0}
    (tmp_path / ".bash_history").write_text("ls\n")
    assert s.import_default("bash", home)["imported"] == 0 and s.import_default("bash", home, force=True)["imported"] == 1
    (tmp_path / ".zsh_history").write_text("ls\nmake\n")
    assert s.import_default("zsh", home)["imported"] == 2
    assert sorted(r.id for r in s.table("executions").collect()) == [0, 1, 2]
    assert default_path("/h/", {}) == "/h/.local/share/strandline/store" and default_path("/h", {"XDG_DATA_HOME": "/d"}) == "/d/strandline/store"
    row = (1, "docker", "", "docker top", 10, "Show", [1.0, 0.0], "m")
    schema = "id long, tool string, requires string, command string, cursor int, desc string, vector array<float>, model_id string"
    s.set_catalogue(spark.createDataFrame([row], schema))
    with pytest.raises(ValueError, match="differ in length"):
        s.set_catalogue(spark.createDataFrame([row, (*row[:6], [1.0], "m")], schema))
    assert s.table("catalogue").count() == 1


def test_tensor_files(spark, tmp_path):
    head = b'{"a":{"dtype":"F16","shape":[2],"data_offsets":[0,4]},"b":{"dtype":"F32","shape":[1,1],"data_offsets":[4,8]}}'
    raw = len(head).to_bytes(8, "little") + head + np.array([1.5, -2], "<f2").tobytes() + np.array([0.25], "<f4").tobytes()
    (tmp_path / "x.tensors").write_bytes(raw)
    rows = read_tensors(spark, f"file://{tmp_path}/x.tensors").orderBy("name").collect()
    assert [(r.name, r.shape, r.data) for r in rows] == [("a", [2], [1.5, -2.0]), ("b", [1, 1], [0.25])]
    for bad in (raw[:4], raw[:-1], b"\xff" * 8 + raw[8:], raw.replace(b"F16", b"I64")):
        with pytest.raises(ValueError):
            parse_tensors(bad)


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT scrub('export API_TOKEN=abc').text AS t, parse_page('# x\n').name AS p, cosine(array(3D, 4D), array(6D, 8D)) AS c, relative_time(0L, 7200000L) AS r").first()
    assert (row.t, row.p, round(row.c, 12), row.r) == ("export API_TOKEN=<REDACTED:secret-env>", "x", 1.0, "2 hours ago")
    plan = spark.range(1).select(F.expr("relative_time(id, 5)"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
