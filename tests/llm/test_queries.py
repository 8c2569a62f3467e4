"""Every query whose result SQL can't express, against a brute-force version over a whole small table."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from strandline.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark, sf, docs):
    from strandline.llm.tokencount import bpe_encoder

    encode = bpe_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = {r.doc_id: r.n_tokens for r in Q.op1_token_counts(spark, sf).collect()}
    assert got == {d["doc_id"]: len(encode(d["text"] or "")) for d in docs}


def test_op4(spark, sf, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = set()
    for d in docs:
        ids = sp.encode(d["text"] or "", add_bos=True, add_eos=True)
        want.add((d["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids))))
    assert {tuple(r) for r in Q.op4_sentencepiece(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op5(spark, sf, docs):
    rows = Q.op5_language_id(spark, sf).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    lang = {d["doc_id"]: d["lang"] for d in docs}
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{key: least id reachable} for {key: (id, print)}, by comparing all pairs."""
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = list(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), prints[k][0]), prints[k][0])
    return {k: least[find(k)] for k in keys}


def test_op7(spark, sf, docs):
    prints = {d["doc_id"]: (d["doc_id"], plain_fingerprint(d["text"])) for d in docs}
    roots = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.op7_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", roots[i]) for i, (_, f) in prints.items()}


def test_op8(spark, sf):
    turns = defaultdict(list)
    for r in pq.read_table(f"{sf}/conversations.parquet").to_pylist():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        want[c] = (len(rows), sha("".join(f"{role}\n{t}\n" for _, role, t in rows)), len(loss), sha(loss))
    got = {r.conv_id: r for r in Q.op8_chat_format(spark, sf).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    assert all(r.formatted_chars > r.loss_chars for r in got.values())


def plain_removal(docs, width=50):
    """{row: removed word positions} by holding every window's least id."""
    least, words = {}, {}
    for k, (i, text) in enumerate(docs):
        words[k] = WORD.findall(text or "")
        for p in range(len(words[k]) - width + 1):
            g = tuple(words[k][p : p + width])
            if i is not None:
                least[g] = min(least.get(g, i), i)
    out = {}
    for k, (i, _) in enumerate(docs):
        gone = set()
        for p in range(len(words[k]) - width + 1):
            if i is not None and least[tuple(words[k][p : p + width])] < i:
                gone.update(range(p, p + width))
        out[k] = (words[k], gone)
    return out


def test_op9(spark, sf, docs):
    want = set()
    for k, (words, gone) in plain_removal([(d["doc_id"], d["text"]) for d in docs]).items():
        want.add((docs[k]["doc_id"], len(words), len(gone), sha(" ".join(w for p, w in enumerate(words) if p not in gone))))
    assert sum(w[2] for w in want) > 0
    assert {tuple(r) for r in Q.op9_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()} == want


def test_op10(spark, sf):
    rows = pq.read_table(f"{sf}/embeddings.parquet").to_pylist()
    vectors = {r["vec_id"]: [math.floor(1024 * float(x)) for x in r["embedding"]] for r in rows}
    want = set()
    for q in vectors:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:10]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in Q.op10_topk(spark, sf).collect()} == want
