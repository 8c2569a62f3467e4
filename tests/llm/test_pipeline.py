"""The pipeline, stage by stage, on each stage's own input, against brute force."""

import hashlib
import math

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strandline.llm import toxicity
from tests.llm.cases import documents
from tests.llm.test_mixing import plain_targets
from tests.llm.test_queries import WORD, plain_components, plain_fingerprint, plain_removal

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """[(input rows, output rows)] of every stage, written and read again between stages."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    where = tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{where}/{k}")
        made = spark.read.parquet(f"{where}/{k}")
        assert k == len(P.STAGES) - 1 or made.columns == COLUMNS
        out.append((docs.collect(), made.collect()))
        docs = made
    return out


def test_toxicity_drops_only_what_the_model_rejects(spark, sf, stages):
    before, after = stages[0]
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if model.severity(r.text)[1] < 0.3)


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    prints = {r.doc_id: (r.doc_id, plain_fingerprint(r.text)) for r in before}
    roots = plain_components(prints)
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if roots[r.doc_id] == r.doc_id)


def test_repeats_are_cut(stages):
    before, after = stages[2]
    want = {before[k].doc_id: [w for p, w in enumerate(words) if p not in gone] for k, (words, gone) in plain_removal([(r.doc_id, r.text) for r in before]).items()}
    want = {i: w for i, w in want.items() if w or not WORD.findall({r.doc_id: r.text for r in before}[i] or "")}
    assert {r.doc_id: WORD.findall(r.text or "") for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_mixture_hits_targets(stages):
    before, after = stages[3]
    sizes, got, texts = {}, {}, {r.doc_id: r.text for r in before}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    for r in after:
        got[r.source] = got.get(r.source, 0) + len(WORD.findall(r.text))
        assert set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    for s, target in plain_targets(sizes).items():
        assert abs(got.get(s, 0) - target) <= max(0.75, sizes[s] / 300)


def test_encoding(stages):
    import sentencepiece

    before, after = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, sp.encode(r.text or "", add_bos=True, add_eos=True)) for r in before)
    assert sorted((r.doc_id, r.ids) for r in after) == want
    assert all(r.decoded_sha256 == hashlib.sha256(sp.decode(r.ids).encode()).hexdigest() for r in after)


def test_awkward_rows(spark, sf):
    """Every stage on awkward rows, with further columns that are named like operators' own."""
    clash = {c: F.lit(f"clash {c}") for c in ("toxic", "severity", "p_toxic", "fp", "component_id", "root", "n_words", "n_removed", "spans", "shard", "order_key", "key", "rank", "offset", "size")}
    docs = documents(spark).select(*COLUMNS).withColumns(clash)
    for rows in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            rows = stage(spark, rows, sf)
            if name != "sentencepiece":
                assert rows.columns == docs.columns
                rows = spark.createDataFrame(rows.collect(), docs.schema)
            assert all(r[c] == f"clash {c}" for r in rows.collect() for c in clash)
        assert rows.count() >= 0 and "ids" in rows.columns


def test_near_copies_under_one_id(spark, sf):
    """Rows that share an id are told apart by their texts; copies without an id, or under one, leave one."""
    docs = documents(spark).select(*COLUMNS)
    kept = P.drop_near_copies(spark, docs, sf).collect()
    rows = docs.collect()
    prints = {k: (math.inf if r.doc_id is None else r.doc_id, plain_fingerprint(r.text)) for k, r in enumerate(rows)}
    groups = {}
    for k, root in plain_components({k: (k, p) for k, (_, p) in prints.items()}).items():
        groups.setdefault(root, []).append(k)
    assert len(kept) == len(groups)
    got = sorted((str(r.doc_id), plain_fingerprint(r.text)) for r in kept)
    least = [min(g, key=lambda k: prints[k][0]) for g in groups.values()]
    assert [i for i, _ in got] == sorted(str(rows[k].doc_id) for k in least)
    assert (7, "another text under the same id") in {(r.doc_id, r.text) for r in kept}
    same = spark.createDataFrame([(1, "a b c d", None, None, None)] * 3, docs.schema)
    assert P.drop_near_copies(spark, same, sf).count() == 1


def test_run_equals_stages(spark, sf, stages):
    got = P.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in got.collect()) == sorted((r.doc_id, r.ids_sha256) for r in stages[-1][1])
