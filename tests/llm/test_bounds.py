"""What may reach the driver, very long texts, empty tables, clashing names."""

import random
from types import SimpleNamespace

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwork.llm import bpe, exact_dedup, fingerprint, html_text, jaccard, langid, mixing, queries, scratch, token_counts, toxicity

RANKS = public_tokenizers.path(queries.RANKS)
SAY = {"en": "the and of with there which that", "de": "der und nicht das eine sich aber", "fr": "le les des une avec pour dans"}


def said(lang, rnd, n=12):
    return " ".join(rnd.choice(SAY[lang].split()) for _ in range(n)) + f" {rnd.random()}"


@pytest.fixture
def fitted(monkeypatch):
    """The rows that the models are fitted on."""
    seen = []
    for module in (langid, toxicity):
        monkeypatch.setattr(module, "fit", lambda rows, *a, f=module.fit, **b: (seen.append(rows), f(rows, *a, **b))[1])
    return seen


def test_language_sample_is_bounded_though_one_id_repeats(spark, fitted):
    rnd = random.Random(5)
    rows = [(1, said("en", rnd), "en") for _ in range(3000)] + [(k, said("de", rnd), "de") for k in range(2, 60)] + [(None, said("fr", rnd), "fr") for _ in range(30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=150)
    assert model.languages == ["de", "en", "fr"] and 0 < len(fitted[0]) <= 150
    assert {label for *_, label in fitted[0]} == {0, 1, 2}
    fresh = spark.createDataFrame([(k, said(lang, rnd)) for k, lang in enumerate(SAY)], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(fresh, model).orderBy("doc_id").collect()] == list(SAY)


def test_equal_rows_do_not_hide_a_language(spark, fitted):
    """Rows equal in id and text fall to the calibration together; their language is fitted all the same."""
    rows = [(1, "the and of", "en")] * 500 + [(7, "der und nicht", "de")] * 500
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fit_rows=100)
    assert model.languages == ["de", "en"] and len(fitted[0]) <= 100 and {label for *_, label in fitted[0]} == {0, 1}


def test_samples_are_bounded_in_bytes(spark, fitted):
    rnd = random.Random(6)
    rows = [(k, said(lang, rnd, 400), lang) for k, lang in enumerate(list(SAY) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.train(docs, fit_bytes=40_000)
    assert 0 < sum(i.nbytes // 2 + v.nbytes for i, v, _ in fitted[-1]) <= 40_000
    labels = docs.select("doc_id", F.when(F.col("lang") == "en", 1).otherwise(0).alias("grade"))
    toxicity.train(docs.unionByName(docs), labels, fit_bytes=30_000)
    assert 0 < sum(i.nbytes + v.nbytes for i, v, _ in fitted[-1]) <= 30_000
    toxicity.train(docs.unionByName(docs).unionByName(docs), labels)
    assert len(fitted[-1]) == len(rows)  # one text an id


def test_even_samples(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 4900, "a").when(F.col("id") < 4990, "b").alias("g"))
    got = {r["g"]: (r["n"], r["last"]) for r in scratch.evenly(rows, "g", ["id"], 50, 3).groupBy("g").agg(F.count("*").alias("n"), F.max("_turn").alias("last")).collect()}
    assert got == {"a": (50, 50), "b": (50, 50), None: (10, 10)}
    same = rows.select(F.lit(1).alias("id"), "g")
    assert {r["g"]: r["count"] for r in scratch.evenly(same, "g", ["id"], 50, 2).groupBy("g").count().collect()} == {"a": 50, "b": 50}


def test_a_folder_that_executors_share_is_needed():
    def session(**settings):
        get = lambda key, default=None: settings.get(key.split(".")[1], default)
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(getConf=lambda: SimpleNamespace(get=get)))

    with pytest.raises(ValueError, match="checkpoint.dir"):
        scratch.scratch_dir(session(master="spark://host:7077"))
    assert scratch.scratch_dir(session(master="spark://host:7077", checkpoint="hdfs://shared/")) == "hdfs://shared"
    assert scratch.scratch_dir(session(master="local[4]")).startswith("file:")


def test_very_long_texts(spark):
    """A text of three million characters, whole, beside short ones."""
    long = " ".join(f"word{k % 9973} and" for k in range(250_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long, "en", "s"), (3, "der und nicht das", "de", None), (4, None, None, "s"), (5, "", "en", "")], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert out[1]["lang_pred"] == "en" and out[4]["lang_pred"] == langid.UNKNOWN
    trip = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert trip == {1: long, 2: long, 3: "der und nicht das", 4: "", 5: ""}
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1] == prints[2] != "" and prints[4] == prints[5] == ""
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert taken[1][0] == 500_000 and all(t <= 2 * n for n, t in taken.values())
    assert {r["doc_id"] for r in toxicity.severities(docs, toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("grade")).where("doc_id < 4"))).collect()} == {1, 2, 3, 4, 5}
    page = spark.createDataFrame([(1, "http://a.b/", f"<nav>x</nav><article><p>{long}</p></article>")], "page_id long, url string, html string")
    assert html_text.main_texts(page).collect()[0]["text"] == long


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("step", range(len(corpus_pipeline.STAGES)))
def test_stages_of_empty_tables(spark, step):
    assert corpus_pipeline.STAGES[step][1](spark, spark.createDataFrame([], EMPTY), "").count() == 0


def test_operators_of_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY + ", edits array<struct<start: long, end: long, text: string>>")
    assert token_counts.edited_counts(docs, RANKS, public_tokenizers.PATTERN).count() == 0
    assert mixing.mixed_texts(docs).count() == mixing.mix(docs).count() == 0
    assert exact_dedup.drop_exact_copies(docs).count() == jaccard.one_of_each(docs).count() == 0


def test_copies_that_repeat_the_id_too(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (2, "a b"), (None, "c"), (None, "c"), (3, "d"), (None, None), (4, ""), (5, "e")]
    names = "doc_id long, text string, exact_sha string, Exact_Top int, digest string, n int, top_id int, similar_id int, component_id int, stays boolean"
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5, True) for r in rows], names)
    for limits in ({}, {"slots": 1, "candidates": 1}):
        out = exact_dedup.drop_exact_copies(docs, **limits)
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, "a b"), (None, "c"), (3, "d"), (4, ""), (5, "e")], key=str)
        told = exact_dedup.exact_groups(docs, **limits).collect()
        assert sum(r["kept"] for r in told) == 5 and {r["group_size"] for r in told if r["keep_id"] == 2} == {4}
    assert jaccard.one_of_each(docs).columns == docs.columns


def test_predictions_beside_all_columns(spark):
    docs = spark.createDataFrame([(1, "the and of", "en", "kept"), (1, "der und nicht", "de", "too")], "doc_id long, text string, lang string, lang_pred string")
    out = langid.predict(docs, langid.train(docs), names=("told", "score"), carry=True).collect()
    assert [(r["doc_id"], r["lang"], r["lang_pred"], r["told"]) for r in out] == [(1, "en", "kept", "en"), (1, "de", "too", "de")]
