"""Language, chat format, tokens, counts, toxicity, pages, the pipeline."""

import hashlib
import os
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from siftwork.llm import bpe, chat, html_text, langid, queries, shingles, token_counts, toxicity

DOCS = "doc_id long, text string"
RANKS, PATTERN = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
ODD = "ab'srelvdtmL  \n\t1!é字\U0001f600-"


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read(), PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def odd_texts(n, seed=1, longest=200):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(longest))) for _ in range(n)]


def test_replay_equals_the_library(encoder, library):
    for text in [*odd_texts(600), "a" * 3000, "ab" * 2000, " " * 999, "", "the quick brown fox's jumps\n\n over"]:
        words = encoder.cut(text)
        encoder.learn(words)
        ids = np.frombuffer(encoder.encode(words), np.int32).tolist()
        assert ids == library.encode_ordinary(text) and encoder.vocabulary.decode(ids).decode() == text


def test_replay_of_a_vocabulary_whose_merges_fall_back():
    """A longer token of a lower rank than its part is merged before other places of the higher rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 301, b"ab": 302, b"abab": 260, b"cab": 299}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None)
    words = [bytes(random.Random(k).choices(b"abc", k=1 + k % 12)) for k in range(400)]
    assert bpe.replay(words, bpe.Vocabulary(ranks)) == [library.encode_ordinary(w.decode()) if w not in ranks else bpe.replay([w], bpe.Vocabulary(ranks))[0] for w in words]
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0})


def test_round_trip(spark, library, monkeypatch):
    rows = [*enumerate(odd_texts(80, 2)), (None, None), (5, ""), (5, "x")]
    out = bpe.round_trip(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int"), RANKS, PATTERN).collect()
    got = sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in out)
    assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert bpe.round_trip(spark.createDataFrame([], DOCS), RANKS, PATTERN).collect() == []


def test_trees_follow_edits(encoder, library):
    rnd = random.Random(3)
    for text in odd_texts(300, 4, 700):
        words = encoder.cut(text)
        encoder.learn(words)
        tree = token_counts.TokenTree(words, encoder, token_counts.CONTEXTS[PATTERN])
        for _ in range(rnd.randrange(5)):
            start, new = rnd.randrange(-1, len(text) + 2), rnd.choice(odd_texts(5, rnd.random(), 60))
            end = start + rnd.randrange(-1, 70)
            low = min(max(start, 0), len(text))
            high = min(max(end, low), len(text))
            text = text[:low] + new + text[high:]
            tree.edit(start, end, new)
            assert tree.text() == text and tree.total == len(library.encode_ordinary(text)) and tree.size == len(text)
            assert sum(tree.leaves, []) == encoder.cut(text)


def test_trees_of_a_pattern_that_looks_far_ahead(encoder):
    pattern = r"\s*[\r\n]+|\s+(?!\S)|\s+| ?\p{L}+| ?[^\s\p{L}]+"
    with open(RANKS, "rb") as f:
        other = bpe.Encoder(f.read(), pattern)
    rnd = random.Random(5)
    for text in odd_texts(60, 6, 400):
        words = other.cut(text)
        other.learn(words)
        tree = token_counts.TokenTree(words, other, token_counts.CONTEXTS.get(pattern))
        for _ in range(3):
            at, new = rnd.randrange(len(text) + 1), rnd.choice(["\n", " " * 9 + "\n", "x", ""])
            text = text[:at] + new + text[at + 2 :]
            tree.edit(at, at + 2, new)
            assert tree.text() == text and sum(tree.leaves, []) == other.cut(text)


def test_stored_trees_take_edits(spark, encoder, library):
    """Three batches of edits, each from the table that the one before gave."""
    rnd = random.Random(8)
    texts = {k: t for k, t in enumerate([*odd_texts(40, 9, 900), "plain words " * 4000, ""])}
    trees = token_counts.token_trees(spark.createDataFrame([*texts.items(), (99, None)], DOCS), RANKS, PATTERN)
    for _ in range(3):
        edits = {}
        for k, text in texts.items():
            edits[k] = []
            for _ in range(rnd.randrange(3)):
                start, new = rnd.randrange(len(text) + 1), rnd.choice(odd_texts(4, rnd.random(), 300))
                end = min(len(text), start + rnd.randrange(40))
                text = text[:start] + new + text[end:]
                edits[k].append((start, end, new))
            texts[k] = text
        table = spark.createDataFrame(list(edits.items()), "doc_id long, edits array<struct<start: long, end: long, text: string>>")
        trees = token_counts.edited_trees(trees.join(table, "doc_id", "left"), RANKS, PATTERN)
        out = {r["doc_id"]: r for r in trees.collect()}
        for k, text in texts.items():
            r = out[k]
            assert (r["text"], r["n_chars"], r["n_tokens"]) == (text, len(text), len(library.encode_ordinary(text)))
            assert sum(r["leaf_chars"]) == len(text) and sum(r["leaf_tokens"]) == r["n_tokens"] and 0 not in r["leaf_chars"]
        assert out[99]["n_tokens"] == 0 and out[40]["encoded_chars"] < 10_000 < len(texts[40])
        trees = spark.createDataFrame(trees.collect(), trees.schema)


def test_an_edit_reads_little_of_a_long_text(encoder):
    words = encoder.cut("some plain words here " * 5000)
    encoder.learn(words)
    tree = token_counts.TokenTree(words, encoder, token_counts.CONTEXTS[PATTERN])
    tree.edit(50_000, 50_004, "other")
    assert tree.encoded_chars < 200


def test_edited_counts(spark, library):
    kind = "doc_id long, text string, edits array<struct<start:long,end:long,text:string>>"
    rows = [(1, "one two", [(3, 7, " three"), (0, 0, "x")]), (2, None, [(0, 5, "new text")]), (3, "same", None), (4, "ab", [None, (1, None, None)])]
    out = {r["doc_id"]: (r["n_tokens"], r["n_edits"], r["edited_chars"], r["edited_tokens"]) for r in token_counts.edited_counts(spark.createDataFrame(rows, kind), RANKS, PATTERN).collect()}
    n = lambda t: len(library.encode_ordinary(t))
    assert out == {1: (n("one two"), 2, 10, n("xone three")), 2: (0, 1, 8, n("new text")), 3: (n("same"), 0, 4, n("same")), 4: (n("ab"), 1, 2, n("ab"))}


def test_shingle_hashes_stand_for_words():
    texts = [*odd_texts(500, 5), None, "", "A b\x0bC", " x "]
    words = {}
    for text, (hashes, own) in zip(texts, shingles.shingle_sets(pa.array(texts)), strict=True):
        found = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        assert len(found) == len(hashes) and len(own) == len({tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else ())
        for w, h in zip(found, hashes.tolist(), strict=True):
            assert words.setdefault(w, h) == h
    assert len(set(words.values())) == len(words)


def test_shingles_of_pieces(monkeypatch):
    texts = pa.array([*odd_texts(60, 6, 900), None, "y" * 500])
    whole = [s.tolist() for _, s in shingles.shingle_sets(texts)]
    monkeypatch.setattr(shingles, "PIECE", 64)
    shingles._powers.clear()
    assert [s.tolist() for _, s in shingles.shingle_sets(texts.slice(0))] == whole
    shingles._powers.clear()


SAMPLES = {"de": "und der die das nicht ist ein mit auch sich", "en": "the of and that with this from have they are", "es": "que los las una por para con como más pero"}


def language_rows(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rnd.choice(list(SAMPLES))
        rows.append((k, " ".join(rnd.choices(SAMPLES[lang].split(), k=rnd.randrange(3, 40))), lang))
    return rows


def test_language_of_held_out_texts(spark):
    docs = spark.createDataFrame(language_rows(400), DOCS + ", lang string")
    model = langid.train(docs, usable=F.col("doc_id") % 4 != 1)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 < r["score"] <= 1 for r in out)
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 1, "zz").otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.predict(hidden, langid.train(hidden, usable=F.col("doc_id") % 4 != 1)).collect())) == sorted(map(tuple, langid.predict(docs, model).collect()))


def test_language_edge_cases(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "und"), (None, "the")], DOCS)
    one = langid.train(spark.createDataFrame([(1, "abc", "en"), (2, None, None)], DOCS + ", lang string"))
    assert sorted((str(r[0]), r[1], r[2]) for r in langid.predict(odd, one).collect()) == [("1", "und", 0.0), ("2", "und", 0.0), ("3", "und", 0.0), ("4", "en", 1.0), ("None", "en", 1.0)]
    assert langid.train(spark.createDataFrame([], DOCS + ", lang string")) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(odd.where("false"), one).collect() == []


def test_temperature_calibrates():
    rnd = np.random.default_rng(1)
    true = rnd.normal(size=(4000, 3)) * 2
    chances = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    labels = np.array([rnd.choice(3, p=p) for p in chances])
    assert abs(langid.temperature_of(true * 5, labels) - 5) < 0.5 and langid.temperature_of(true[:3], labels[:3]) == 1.0


def test_counts_of_pieces_add_up(monkeypatch):
    text = "".join(random.Random(1).choices("abc déÄ 12", k=3000))
    monkeypatch.setattr(langid, "PIECE", 500)
    parts = langid.gram_counts(text)
    assert parts.sum() > 0 and (parts > 0).sum() >= 20


CHATS = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, template=chat.CHATML):
    out = chat.format_chats(spark.createDataFrame(rows, CHATS), template)
    return {r["conv_id"]: r for r in out.withColumn("turns", chat.read_back(F.col("formatted"), template)).withColumn("learned", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}


@pytest.mark.parametrize("template", [chat.CHATML, chat.Template(opener="<T>", closer="<T/>", control="<T", after="; ")])
@pytest.mark.parametrize("chunk", [chat.CHUNK, 2])
def test_chats_read_back_whatever_they_say(spark, monkeypatch, template, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rnd = random.Random(7)
    pieces = ["<|im_end|>", "<|im_start|>", "<|", "<T>", "<T/>; ", "<T", "\\", "\n", "<", "|", "a", "é", "assistant", " ", "$1", "\\n", "\r"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "odd\nrole\\", None]), rnd.choice([None, "", "".join(rnd.choices(pieces, k=rnd.randrange(9)))])) for c in range(60) for t in range(rnd.randrange(1, 6))]
    out = formatted(spark, rows, template)
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for cc, _, r, t in sorted(rows, key=lambda x: (x[0], x[1])) if cc == c]
        assert [tuple(t) for t in out[c]["turns"]] == turns
        assert out[c]["learned"] == "".join(t for r, t in turns if r == "assistant")
        assert "".join(s["text"] for s in out[c]["segments"]) == out[c]["formatted"]
        raw = out[c]["formatted"].encode()
        assert [raw[s["at"] - 1 :][: s["size"]].decode() for s in out[c]["loss_spans"]] == [s["text"] for s in out[c]["segments"] if s["loss"]]


@pytest.mark.parametrize(
    "how", [{"control": "<"}, {"control": "<<", "opener": "<<a", "closer": "<<b"}, {"opener": "[INST]", "closer": "[/INST]"}, {"closer": "<|im_start|>x"}, {"opener": "<|a<|"}, {"after": "\\"}, {"emits": {"answered": (("text", True),)}}]
)
def test_templates_that_texts_could_forge_are_refused(how):
    with pytest.raises(ValueError):
        chat.Template(**how)


def test_the_machine_emits_by_its_states(spark):
    """A template whose machine puts only the answer to a question that follows a system turn under the loss mask."""
    moves = {("start", "system"): "ready", ("ready", "user"): "asked", ("asked", "assistant"): "taught", ("taught", "user"): "free", ("free", "assistant"): "said", ("said", "user"): "free"}
    template = chat.Template(moves=moves, recover={}, final=("taught", "said"), emits={"taught": (("head", False), ("text", True), ("end", True))})
    rows = [(1, k, r, t) for k, (r, t) in enumerate([("system", "s"), ("user", "u"), ("assistant", "one"), ("user", "v"), ("assistant", "two")])]
    row = formatted(spark, rows, template)[1]
    assert row["valid_order"] and [s["text"] for s in row["segments"] if s["loss"]] == ["one", "<|im_end|>\n"]


@pytest.mark.parametrize(("roles", "ok"), [("user assistant", True), ("system user", True), ("user user", False), ("assistant user", False), ("system", False), ("user assistant user", True), ("user system", False), ("tool", False)])
def test_turn_order(spark, roles, ok):
    assert formatted(spark, [(1, k, r, "x") for k, r in enumerate(roles.split())])[1]["valid_order"] == ok


def test_chat_edge_cases(spark):
    out = formatted(spark, [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "b")])
    assert [t["text"] for t in out[1]["turns"]] == ["a", "a"] and out[None]["learned"] == "b"
    assert formatted(spark, []) == {}
    plans = chat.format_chats(spark.createDataFrame([], CHATS))._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans


def test_ordinal_grades():
    rnd = random.Random(8)
    bad, plain = ["vile", "nasty", "foul"], [f"word{k}" for k in range(60)]
    texts, grades = [], []
    for _ in range(700):
        g = rnd.choice([0, 0, 1, 2])
        texts.append(" ".join(rnd.sample(plain, 20) + rnd.choices(bad, k=[0, 2, 8][g])))
        grades.append(g)
    rows = [(*toxicity.vector(*toxicity.features(t)), g) for t, g in zip(texts, grades, strict=True)]
    model = toxicity.fit(rows[:500], 3, l1=1.0)
    assert list(model.thresholds) == sorted(model.thresholds) and (model.weights != 0).sum() < 2000
    z = np.array([float(model.weights[i] @ v) for i, v, _ in rows[500:]])
    severity = model.above(z).sum(axis=1)
    by = [severity[np.array(grades[500:]) == g].mean() for g in range(3)]
    assert by[0] < 0.3 and by[0] + 0.5 < by[1] < by[2] - 0.3


def test_toxicity_edge_cases(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "fine words")], DOCS)
    none = toxicity.train(odd, spark.createDataFrame([(4, 0), (1, None)], "doc_id long, grade int"))
    assert none is None and {(r["severity"], r["toxic"]) for r in toxicity.severities(odd, none).collect()} == {(0.0, False)}
    docs = spark.createDataFrame([(k, ("vile nasty " if k % 3 == 0 else "good kind ") * 9) for k in range(120)], DOCS)
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("grade")))
    assert all(r["toxic"] == (r["doc_id"] % 3 == 0) for r in toxicity.severities(docs, model).collect())
    assert not any(r["toxic"] for r in toxicity.severities(odd, model).collect()) and toxicity.severities(odd.where("false"), model).collect() == []


def test_toxicity_keeps_the_share_of_all_labels(spark):
    docs = spark.createDataFrame([(k, "plain words of no side") for k in range(1000)], DOCS)
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("grade"))
    for rows in (100, 4000):
        out = toxicity.severities(docs, toxicity.train(docs, labels, fit_rows=rows)).collect()
        assert all(abs(r["p_toxic"] - 0.1) < 0.05 and not r["toxic"] for r in out)
    three = toxicity.OrdinalModel(np.zeros(1, np.float32), np.array([0.0, 1.0]), 0.25)
    above = three.above(np.zeros(1))[0]
    assert abs(above[0] - 0.2) < 1e-9 and abs(above[1] / above[0] - 2 / (1 + np.e)) < 1e-9


PAGE = """<html><head><title>T &amp; x</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use</div>
<main><article><header><h1>Title</h1></header><p>One <i>two</i>
 three&nbsp;&lt;b&gt; &#233;&eacute; &am</p><div class=ad>Buy</div><aside>Side</aside><ul><li>x<li>y</ul><script>var a="</p>";</script><form><p>Name <input value="a>b"></form>
<section class="comments"><article class="comment"><p>nice!</p></article></section><p>end<br><p>last</article><div class="related">more</div></main><footer><p>foot</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "http://a/x", PAGE), (2, None, None), (3, "http://a/y", ""), (4, "http://b", "<p>only &lt;this"), (4, "http://b", "<p>only &lt;this")]
    out = sorted((r["page_id"], r["text"]) for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out == [(1, "Title\nOne two three <b> éé &am\nx\ny\nend\nlast"), (2, ""), (3, ""), (4, "only <this"), (4, "only <this")]
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_boilerplate_repeats_on_pages_of_a_host():
    pages = [html_text.parse(f"<div><p>Welcome to our great site dear friends of the world</p><p>story {i} a{i}</p><p>Share</p><p>x{i} this is the common tail of every page here y{i}</p></div>") for i in range(3)]
    out = html_text.unique_runs([0, 1, 2], [[k for k, _ in p] for p in pages], [[t for _, t in p] for p in pages])
    assert out == [f"story {i} a{i}\nx{i} y{i}" for i in range(3)]
    same = html_text.unique_runs([5, 5], [[k for k, _ in p] for p in (pages[0], pages[0])], [[t for _, t in p] for p in (pages[0], pages[0])])
    assert same[0].count("\n") == 3  # one page, twice: nothing repeats across pages


def test_articles_keep_what_repeats():
    page = "<nav><li>Go</nav><article><h1>Go</h1><p>the same news told on many pages of this very host</p></article>"
    blocks = html_text.parse(page)
    assert html_text.unique_runs([1, 2], [[k for k, _ in blocks]] * 2, [[t for _, t in blocks]] * 2) == ["Go\nthe same news told on many pages of this very host"] * 2


def test_host_runs_decide_inside_articles():
    line = "read on in our daily letter and tell all your friends"
    blocks = [[(html_text.ARTICLE, f"story {i} a{i} {line}" if i < 10 else f"story {i}"), (html_text.ARTICLE, "Share" if i % 2 else f"s{i}"), (html_text.CHROME, f"s{i}")] for i in range(20)]
    out = html_text.unique_runs(list(range(20)), [[k for k, _ in b] for b in blocks], [[t for _, t in b] for b in blocks])
    assert out == [(f"story {i} a{i}" if i < 10 else f"story {i}") + ("" if i % 2 else f"\ns{i}") for i in range(20)]
    few = [b if i != 9 else [(html_text.ARTICLE, "story 9")] for i, b in enumerate(blocks)]  # nine pages of twenty quote it
    assert html_text.unique_runs(list(range(20)), [[k for k, _ in b] for b in few], [[t for _, t in b] for b in few])[0] == f"story 0 a0 {line}\ns0"


def test_shards_of_a_host_do_not_change_its_texts(spark):
    seen, line = "please take note of our new terms of use today", "read on in our daily letter and tell all your friends"
    rows = [(i, "http://big/", f"<div><p>own{i} text{i}</p><p>{seen if i < 5 else f'w{i}'}</p></div>") for i in range(60)]
    rows += [(i, "http://big/", f"<article><p>story {i}</p><p>{line if i % 3 else f'v{i}'}</p></article>") for i in range(60, 100)]
    told = "a long page of which the host has copies under two more ids and nothing else at all"
    rows += [(i, "http://big/", f"<div><p>{told}</p></div>") for i in range(100, 103)] + [(103 + i, "http://big/", f"<p>x{i} this is quoted by just two pages of the host y{i}</p>") for i in range(2)]
    rows += [(110, "http://big/", f"<p>version {i} of one page that was read more than two times</p>") for i in range(4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    some, whole = (sorted((r["page_id"], r["text"]) for r in html_text.main_texts(frame, shard=n).collect()) for n in (8, 512))
    assert some == whole
    want = [(i, f"own{i} text{i}" + ("" if i < 5 else f"\nw{i}")) for i in range(60)] + [(i, f"story {i}" + ("" if i % 3 else f"\nv{i}")) for i in range(60, 100)]
    want += [(i, told) for i in range(100, 103)] + [(103 + i, f"x{i} this is quoted by just two pages of the host y{i}") for i in range(2)]
    assert some == want + [(110, f"version {i} of one page that was read more than two times") for i in range(4)]


def test_repeats_by_brute_force():
    rnd = random.Random(9)
    for _ in range(40):
        texts = [[" ".join(rnd.choices("abc", k=rnd.randrange(1, 30))) for _ in range(rnd.randrange(3))] for _ in range(4)]
        pages, run = [0, 1, 2, 2], 4
        grams: dict = {}
        for p, blocks in zip(pages, texts, strict=True):
            for t in blocks:
                w = t.split()
                for k in range(len(w) - run + 1):
                    grams.setdefault(tuple(w[k : k + run]), set()).add(p)
                if len(w) < run:
                    grams.setdefault(("whole", *w), set()).add(p)
        want = []
        for blocks in texts:
            lines = []
            for t in blocks:
                w = t.split()
                covered = [len(w) < run and len(grams[("whole", *w)]) > 1] * len(w)
                for k in range(len(w) - run + 1):
                    if len(grams[tuple(w[k : k + run])]) > 1:
                        covered[k : k + run] = [True] * run
                if line := " ".join(x for x, c in zip(w, covered, strict=True) if not c):
                    lines.append(line)
            want.append("\n".join(lines))
        assert html_text.unique_runs(pages, [[html_text.NEITHER] * len(b) for b in texts], texts, run) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n in queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda df: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf)
        assert now.columns == docs.columns, name
        now = corpus_pipeline.kept(now, name)
        if name == "exact_dedup":
            assert len({r["text"] for r in now.collect()}) == now.count() == len(set(texts.values()))
    said = {r["doc_id"]: r["text"] for r in now.collect()}
    out = {r["doc_id"]: r for r in entry.queries()["pipeline"](spark, sf).collect()}
    assert set(out) == set(said)
    for i, t in said.items():
        ids = library.encode_ordinary(t)
        assert (out[i]["n_tokens"], out[i]["ids_sha256"], out[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_language_stage(spark):
    rows = [(k, t, lang if k % 5 else None, "s", len(t)) for k, t, lang in language_rows(60)] + [(100, "123 ...", "en", "s", 7), (101, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert set(out) == set(range(60)) and all(out.values())


def test_stages_keep_columns_whose_names_clash(spark):
    rows = [(k, t, lang, "s", len(t), k, k, "x", k) for k, t, lang in language_rows(40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id long, size long, lang_pred string, component_id long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r["_id"] == r["size"] == r["component_id"] == r["doc_id"] for r in out.collect()), name


def test_toxicity_with_labels_of_other_documents(spark):
    """Labels without a document take no place in the sample."""
    docs = spark.createDataFrame([(k, ("vile nasty hateful scum " if k % 2 else "calm pleasant garden walk ") * 3 + f"w{k}") for k in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("grade")).unionByName(spark.range(10_000, 60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("grade")))
    model = toxicity.train(docs, labels, fit_rows=200)
    assert model is not None and all(r["toxic"] == bool(r["doc_id"] % 2) for r in toxicity.severities(docs, model).collect())


def test_a_replay_holds_few_bytes(library, monkeypatch):
    """However many words of a block are new, the lists of a replay follow REPLAY_BYTES; a longer word is replayed alone."""
    with open(RANKS, "rb") as f:
        encoder = bpe.Encoder(f.read(), PATTERN)
    sizes = []
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 500)
    monkeypatch.setattr(bpe, "replay", lambda words, v, f=bpe.replay: (sizes.append([len(w) for w in words]), f(words, v))[1])
    texts = [*odd_texts(120, 11), "é" * 900, "q" * 400]
    words = [w for t in texts for w in encoder.cut(t)]
    encoder.learn(words + words)
    assert len(sizes) > 3 and all(sum(s) <= 500 or len(s) == 1 for s in sizes)
    assert sum(map(len, sizes)) == len({w for w in words if w.encode() not in encoder.vocabulary.ranks})
    for t in texts:
        assert np.frombuffer(encoder.encode(encoder.cut(t)), np.int32).tolist() == library.encode_ordinary(t)


def test_learning_many_words_takes_little_memory():
    with open(RANKS, "rb") as f:
        encoder = bpe.Encoder(f.read(), PATTERN)
    words = [f"wxq{k:07d}zv" for k in range(50_000)]
    tracemalloc.start()
    encoder.learn(words)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(encoder.known) == 50_000 and peak - now < 30_000_000
