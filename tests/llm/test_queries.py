"""The queries without SQL, over whole tables: against the public library, plain arithmetic, held-out labels; the pipeline's stages one by one."""

import os
import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import bpe, queries
from tests.llm.test_copies import shingles, similar_by_force, words_of

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(MORE), reason="no test tables")


def table(sf, name, columns):
    return duckdb.connect().execute(f"SELECT {columns} FROM '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(queries.RANKS), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def told(ids):
    return sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_op3_is_the_library(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op3_byte_bpe"](spark, SMALL).collect()}
    want = {}
    for i, text in table(SMALL, "documents", "doc_id, coalesce(text, '')"):
        ids = library.encode_ordinary(text)
        want[i] = (len(ids), told(ids), sha256(text.encode()).hexdigest())
    assert got == want


def test_op4_counts_again(spark, library):
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"], r["edited_chars"], r["edited_tokens"]) for r in queries.QUERIES["op4_token_counts"](spark, SMALL).collect()}
    want = {}
    for i, text in table(SMALL, "documents", "doc_id, coalesce(text, '')"):
        n, now = len(text), text
        for start, end, new in ((n // 3, n // 3, " (edited 2026) "), (n // 2, n // 2 + 17, ""), (n * 3 // 4, n * 3 // 4 + 1, "n't\n")):
            start = min(start, len(now))
            now = now[:start] + new + now[min(max(end, start), len(now)) :]
        want[i] = (n, len(library.encode_ordinary(text)), len(now), len(library.encode_ordinary(now)))
    assert got == want


def test_op6_edits_and_estimates(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_fingerprint"](spark, SMALL).collect()}
    docs = sorted(table(SMALL, "documents", "doc_id, coalesce(text, '')"))
    off, prints = [], defaultdict(set)
    for k, (i, text) in enumerate(docs):
        after, cut = docs[(k + 1) % len(docs)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r, a, b = got[i], shingles(text), shingles(edited)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha256(edited.encode()).hexdigest())
        prints[text].add(r["fingerprint"])
        if len(a | b) > 100:
            off += [abs(r["near_edited"] - len(a & b) / len(a | b)), abs(r["in_edited"] - len(a & b) / len(a))]
    assert all(len(p) == 1 for p in prints.values()) and len(off) > 100 and sum(off) / len(off) < 0.06


def test_op1_knows_held_out_languages(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_language_id"](spark, MORE).collect()}
    docs = table(MORE, "documents", "doc_id, text, lang")
    for i, text, _ in docs:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (text is None or not regex.search(r"\p{L}", text))
    held = [(lang, got[i]) for i, _, lang in docs if lang and got[i]["held_out"] and got[i]["lang_pred"] != "und"]
    right = sum(lang == r["lang_pred"] for lang, r in held) / len(held)
    assert len(held) > 250 and right >= 0.98 and abs(right - sum(r["score"] for _, r in held) / len(held)) < 0.03


def test_op7_finds_what_is_labelled(spark):
    """On labelled documents, a part of which the model is fitted on."""
    labels = dict(table(MORE, "labels", "doc_id, toxic"))
    rows = [(labels[r["doc_id"]], r) for r in queries.QUERIES["op7_toxicity"](spark, MORE).collect() if r["doc_id"] in labels]
    assert sum(r["toxic"] for toxic, r in rows if toxic) >= 0.9 * sum(labels.values())
    assert sum(r["toxic"] for toxic, r in rows if not toxic) <= 0.01 * len(rows)
    assert all(0 <= r["severity"] <= 1 and r["grade"] in (0, 1) for _, r in rows)


def test_stages_one_by_one(spark, library, tmp_path):
    """Each stage on what the one before kept, against plain Python."""
    name, function = zip(*corpus_pipeline.STAGES, strict=True)
    assert name == ("language_id", "exact_dedup", "ngram_jaccard", "source_mix", "byte_bpe")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")

    def stage(k, rows):
        out = function[k](spark, rows, SMALL)
        assert k == 4 or out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    first = stage(0, docs)
    by_id, kept = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"]: r for r in first.collect()}
    assert all((r["text"], r["source"]) == (by_id[i]["text"], by_id[i]["source"]) and r["lang"] == (by_id[i]["lang"] or r["lang"]) for i, r in kept.items())
    assert all(r["lang"] for r in kept.values()) and sum(bool(r["text"]) and i not in kept for i, r in by_id.items()) <= 0.03 * len(by_id)

    second = stage(1, first)
    last = {}
    for i, r in kept.items():
        last[r["text"]] = max(i, last.get(r["text"], i))
    assert {r["doc_id"] for r in second.collect()} == set(last.values())

    third = stage(2, second)
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert {r["doc_id"] for r in third.collect()} == {i for i, _, root in similar_by_force(rows) if i == root}

    fourth = stage(3, third)
    before = {r["doc_id"]: r for r in third.collect()}
    third.write.parquet(f"{tmp_path}/documents.parquet")
    taken = {r["doc_id"]: r["taken"] for r in queries.QUERIES["op9_source_mix"](spark, str(tmp_path)).collect()}
    after = {r["doc_id"]: r for r in fourth.collect()}
    assert set(after) == {i for i, n in taken.items() if n}
    for i, r in after.items():
        mixed, own = words_of(r["text"]), words_of(before[i]["text"])
        assert len(mixed) == taken[i] <= 2 * len(own) and r["n_chars"] == len(r["text"]) and set(mixed) <= set(own)

    fifth = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stage(4, fourth).collect()}
    assert fifth == {i: (len(ids := library.encode_ordinary(r["text"])), told(ids), sha256(r["text"].encode()).hexdigest()) for i, r in after.items()}


def test_the_whole_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    rows = out.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 100 and out.where(F.col("n_tokens") < 1).count() == 0
