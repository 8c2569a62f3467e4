"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, operator by operator."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat, langid, quality, simhash, spm, substrings, tokencount, topk
from strandline.plans.shared import fresh_path, materialize
from tests.llm.cases import SCHEMA, documents
from tests.llm.test_queries import WORD, plain_components, plain_fingerprint, plain_removal


def test_separator_scan_stitches_blocks(spark):
    rnd = random.Random(1)
    want, rows = set(), []
    for stream, lengths in enumerate([[3, 0, 0, 5000, 1], [0], [7] * 500, [], [2049]]):
        flat, at = [], 0
        for k, n in enumerate(lengths):
            want.add((stream, k, at, n, True))
            flat += [rnd.randint(0, 99) for _ in range(n)] + [100]
            at += n + 1
        if stream == 3:
            flat = [5] * 40
            want.add((stream, 0, 0, 40, False))
        for block in range(0, max(1, len(flat)), 16):
            rows.append((stream, block // 16, bytearray(np.array(flat[block : block + 16], "<u2").tobytes())))
    blocks = spark.createDataFrame(rows, tokencount.BLOCKS)
    got = tokencount.separator_scan(blocks, 100, group=4).collect()
    assert {tuple(r) for r in got} == want
    assert tokencount.separator_scan(blocks.limit(0), 100).count() == 0


def test_flat_files(spark, tmp_path):
    """Files in several splits, whose blocks different tasks read."""
    rnd = np.random.default_rng(1)
    want = {("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 5, 0, True), ("a.bin", 3, 6, 1, False)}
    (tmp_path / "a.bin").write_bytes(np.array([1, 2, 9, 3, 9, 9, 4], "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    long = np.where(rnd.random(5000) < 0.01, 9, 1000)
    (tmp_path / "c.bin").write_bytes(long.astype("<u2").tobytes())
    at = 0
    for k, end in enumerate([*np.flatnonzero(long == 9).tolist(), len(long)]):
        want.add(("c.bin", k, at, end - at, end < len(long)))
        at = end + 1
    blocks = tokencount.read_flat_files(spark, f"file://{tmp_path}", block_tokens=3)
    assert blocks.where("stream = 'c.bin'").select(F.spark_partition_id()).distinct().count() > 4
    got = tokencount.separator_scan(blocks.withColumn("size", F.lit("clash")), 9, group=10).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_flat_files_keep_ids(spark):
    docs = documents(spark)
    path, folder = public_tokenizers.path("byte_bpe_50k.tiktoken"), fresh_path(spark, "flat")
    encode = tokencount.bpe_encoder(path)
    named = materialize(tokencount.write_flat_files(docs, path, 50256, folder), "names")
    got = tokencount.separator_scan(tokencount.read_flat_files(spark, folder, block_tokens=64), 50256, group=3).where("closed").join(named, ["stream", "doc_no"])
    want = sorted((str(r.doc_id), len(encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.id), r.n_tokens) for r in got.collect()) == want
    with pytest.raises(Exception, match="does not fit"):
        tokencount.write_flat_files(docs, path, 70000, folder).count()
    assert tokencount.write_flat_files(docs.limit(0), path, 50256, folder).count() == 0


def test_sentencepiece_round_trip(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = documents(spark)
    got = spm.encode_decode(docs.withColumn("t", F.col("text")), path)
    rows = got.collect()
    assert len(rows) == docs.count() and "text" not in got.columns
    for r in rows:
        assert r.ids == sp.encode(r.t or "", add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
    assert spm.encode_decode(docs.limit(0), path).count() == 0
    small = spm.encode_decode(docs.withColumn("t", F.col("text")), path, pack_chars=300).collect()  # many packs give the same ids
    assert sorted((r.t or "", r.ids) for r in small) == sorted((r.t or "", r.ids) for r in rows)


def test_each_distinct_word_is_segmented_once(spark):
    """A word has one bucket, whose task segments it once, however many packs and documents it stands in."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs, codec = documents(spark), spm.Codec(path)
    packs = spm._packs(docs.select("doc_id", F.col("text").alias("__text")), ["doc_id"], open(path, "rb").read(), 300, fresh_path(spark, "packs"))
    rows = spm._requests(packs, 50).collect()
    asked = [(w, r.bucket) for r in rows for w in spm._parted(bytes(r.words))]
    want = {w for r in docs.collect() for w in codec.split(r.text or "")}
    assert {w for w, _ in asked} == want and len(set(asked)) == len(want) < len(asked) and len({b for _, b in asked}) > 40
    assert len({(r.bucket, r.part) for r in rows}) == len(rows)
    parts = {}
    for r in spm._answers(spm._requests(packs, 50), open(path, "rb").read()).collect():
        parts[r.part, r.first] = (r.n, spm._expand(bytes(r.ids)))
    for r in rows:
        made = [codec.segment(w) for w in spm._parted(bytes(r.words))]
        assert parts[r.part, r.first] == (len(made), np.array([len(x) for x in made], "<u4").tobytes() + b"".join(made))


def test_language_edges(spark):
    docs = documents(spark)
    profiles = langid.learn(spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert profiles.langs == ["de", "en"]
    got = langid.identify(docs, profiles)
    assert got.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "score"] and got.count() == docs.count()
    for r in got.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert langid.identify(docs.limit(0), profiles).count() == 0
    assert langid.learn(docs.limit(0)).predict("some text") == ("und", 0.0)


def test_marks_are_no_letters(spark):
    profiles = langid.learn(spark.createDataFrame([("der hund", "de"), ("the cat", "en")], "text string, lang string"))
    texts = ["\u0301", "\u0301 \u0302 12", "e\u0301", "日", "--"]
    rows = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles).collect()
    assert [r.lang_pred == "und" for r in sorted(rows)] == [True, True, False, False, True]


def plain_grams(text):
    """Counts of 1- to 3-grams, counted one by one, with a border before, between and behind words."""
    import unicodedata

    kinds = [unicodedata.category(c) for c in text.lower()]
    if not any(k[0] == "L" for k in kinds):
        return {}
    words = "".join(c if k[0] == "L" or k == "Mn" else " " for c, k in zip(text.lower(), kinds)).split()
    line, counts = " " + " ".join(words) + " ", {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            if n > 1 or line[i] != " ":
                counts[line[i : i + n]] = counts.get(line[i : i + n], 0) + 1
    return counts


def plain_rank(counts, size):
    number = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def test_out_of_place_against_brute_force(spark, sf):
    """Profiles and verdicts by the rule: ranks compared gram by gram, an unknown gram as far as a profile is long."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(-1, "e\u0301te\u0301 Éte", "fr"), (-2, "\u0301", None), (-3, "日本語 の 本", None), (-4, None, "en")]
    size, totals = 40, {}
    for _, text, lang in docs:
        if text is not None and lang is not None:
            own = totals.setdefault(lang, {})
            for g, n in plain_grams(text).items():
                own[g] = own.get(g, 0) + n
    ranked = {lang: {g: k for k, g in enumerate(plain_rank(totals[lang], size))} for lang in sorted(totals)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(frame, langid.learn(frame, size=size)).collect()}
    for i, text, _ in docs:
        own = plain_rank(plain_grams(text or ""), size)
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in ranked.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert got[i][0] == best and abs(got[i][1] - (1 - far[best] / (len(own) * size))) < 1e-12


def plain_quality(text):
    words = WORD.findall(text or "")
    grams, seen = [tuple(words[i : i + 5]) for i in range(len(words) - 4)], {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_edges(spark):
    docs = documents(spark)
    got = quality.quality(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and quality.quality(docs.limit(0)).count() == 0
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(r.text)
        assert not (r.kept and r.base_failed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def flips(rnd, base, n):
    for p in rnd.sample(range(64), n):
        base ^= 1 << p
    return base


def test_covering_finds_every_pair(spark):
    rnd = random.Random(3)
    masks = simhash.covering_masks(list(range(64)), 3)
    for _ in range(2000):
        a = rnd.getrandbits(64)
        b = flips(rnd, a, rnd.randint(0, 3))
        assert any((a & m) == (b & m) for m in ((x + (1 << 64)) % (1 << 64) for x in masks))


def test_dense_buckets_are_exact(spark):
    """Buckets over the gathering bound meet again under inner masks; the components stay the same."""
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    values = {flips(rnd, c, rnd.randint(0, 4)) for c in centres for _ in range(60)} | {rnd.getrandbits(64) for _ in range(50)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = plain_components({s: (s, s % (1 << 64)) for s in signed})
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    for gather in (2, 5, 4096):
        roots = {r.node: r.root for r in simhash.components(simhash.near_edges(frame, gather=gather)).collect()}
        assert {s: roots.get(s, s) for s in signed} == want


def test_simhash_edges(spark):
    docs = documents(spark)
    rows = docs.collect()
    prints = {k: (math.inf if r.doc_id is None else r.doc_id, plain_fingerprint(r.text)) for k, r in enumerate(rows)}
    roots = plain_components(prints)
    want = sorted((str(r.doc_id), prints[k][1], None if roots[k] == math.inf else roots[k]) for k, r in enumerate(rows))
    got = simhash.near_duplicates(docs)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got.collect()) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chat_windows(spark):
    rnd = random.Random(2)
    nasty = ["", None, "</s>", "<\\s>", "[INST]", "[\\\\TURN]", "<<SYS>> [/INST]<</SYS>>", "plain words here", "[TURN]user\nhi</s>", "日本 🎉"]
    rows = [(c, t, role, rnd.choice(nasty) if rnd.random() < 0.5 else " ".join(["w"] * rnd.randint(0, 90))) for c in range(12) for t, role in enumerate(["system"] * (c % 2) + [rnd.choice(["user", "assistant"]) for _ in range(rnd.randint(1, 20))])]
    rows += [(12, 0, "user", "tie"), (12, 0, "user", "tie"), (12, None, None, None), (None, 0, "assistant", "x"), (13, 0, "odd role\n[TURN]", "y"), (14, 0, "assistant", "z " * 5000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    got = chat.read_back(chat.windows(frame, budget=120, history_turns=2, history_tokens=40)).collect()
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        parts = sorted((r for r in got if r.conv_id == c), key=lambda r: r.window)
        assert [(t.role, t.text) for p in parts for t in p.turns] == [(r[2] or "", r[3] or "") for r in own]
        assert "".join(p.loss_text for p in parts) == "".join(r[3] or "" for r in own if r[2] == "assistant")
        weigh = lambda t: len(WORD.findall(t or "")) + 4
        for p in parts:
            assert p.formatted.count("[TURN]") == p.n_turns and p.n_turns - p.n_repeated == len(p.turns)
            assert p.n_repeated <= 2 + (own[0][2] == "system") and (p.window == 0) <= (p.n_repeated == 0)
            if own[0][2] == "system" and p.window:
                assert p.formatted.startswith("<s>[TURN]system\n")
            assert sum(weigh(t.text) for t in p.turns[:-1]) <= 120
    assert any(r.n_repeated > 0 for r in got) and chat.windows(frame.limit(0)).count() == 0
    assert "Python" not in chat.read_back(chat.windows(frame))._jdf.queryExecution().executedPlan().toString()


def test_substring_edges(spark):
    docs = documents(spark)
    rows = docs.collect()
    for width, gram in ((50, 16), (5, 3)):
        want = plain_removal([(r.doc_id, r.text) for r in rows], width)
        expected = sorted((str(rows[k].doc_id), str([w for p, w in enumerate(words) if p not in gone]), len(gone)) for k, (words, gone) in want.items())
        out = substrings.remove_repeats(docs, window=width, gram=gram)
        assert out.columns == [c for c in docs.columns if c not in ("n_words", "spans")] + ["n_words", "n_removed", "spans"]
        got = out.collect()
        assert sorted((str(r.doc_id), str(WORD.findall(r.text or "")), r.n_removed) for r in got) == expected
        assert sum(r.text is None for r in got) == sum(r.text is None for r in rows)
        assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_changed_passages(spark):
    """Passages that many documents share, whole, cut off and with words changed, against brute force."""
    rnd = random.Random(11)
    vocab = [f"w{k}" for k in range(200)]
    passages = [[rnd.choice(vocab) for _ in range(rnd.randint(20, 80))] for _ in range(5)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randint(0, 4)):
            part = list(rnd.choice(passages))
            for _ in range(rnd.choice([0, 0, 1, 3])):
                part[rnd.randrange(len(part))] = rnd.choice(vocab)
            words += part[rnd.choice([0, 0, 7]) :] + [rnd.choice(vocab) for _ in range(rnd.randint(0, 9))]
        rows.append((rnd.randrange(100), " ".join(words)))
    want = sorted((rows[k][0], [w for p, w in enumerate(words) if p not in gone]) for k, (words, gone) in plain_removal(rows, 12).items())
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=12, gram=5).collect()
    assert sorted((r.doc_id, WORD.findall(r.text)) for r in got) == want


def test_topk_edges(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 360)]  # ties
    rows += [(400, None), (500, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (800, [0.5] * 3), (900, [1e30] * 8), (None, [0.1] * 8), (1000, []), (0, rows[0][1]), (801, [0.25] * 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    fine = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in set(fine):
        if q % 100 == 0:
            found = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in fine if i != q and len(a) == len(b))[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    for tile in (16, 4096):
        got = topk.search(frame, F.col("vec_id") % 100 == 0, tile=tile, query_tile=2)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_work_is_spread(spark):
    """More product tasks than any fixed number of deals, and no broadcast."""
    rnd = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(6000, 4)))]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8), F.col("vec_id") % 10 == 0, k=3, tile=40, query_tile=20, cell_pairs=4)
    found = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("hashpartitioning(cell") >= 2
    assert {int(n) > 500 for n in re.findall(r"hashpartitioning\(cell#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)} == {True}
    whole = np.floor(1024 * np.array([v for _, v in rows]))
    for q in (0, 10, 5990):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(len(rows)), -scores))[:3]
        assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] == [(int(i), int(scores[i])) for i in best]


def test_grid_shapes():
    for tiles, asked in ((0, 0), (1, 1), (13, 11), (244_000, 20_000), (5, 400)):
        down, across = topk.grid(tiles, asked, 32, 16)
        assert 1 <= down <= max(1, tiles) and 1 <= across <= max(1, asked) and down * across >= min(tiles * asked, 16) // 2
