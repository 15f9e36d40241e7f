"""The pages query against a brute-force version, planted boilerplate, and names of classes."""

import random
import time
from collections import defaultdict

import pytest

from siftwork.llm import html_text, queries

PAGES = "page_id long, url string, html string"
WRAP = {
    "nav": "<nav>{}</nav>", "footer": "<footer>{}</footer>", "advert": '<div class="ad">{}</div>', "plain": "<div><p>{}</p></div>",
    "article": "<p>{}</p>", "suspect": '<div class="social-box">{}</div>',
}


def rendered(article, outside):
    """article: (kind, text) of the blocks of an article, None for a page without; outside: (kind, text) around it."""
    around = "".join(WRAP[k].format(t) for k, t in outside)
    return around + ("" if article is None else "<article>" + "".join(WRAP[k].format(t) for k, t in article) + "</article>")


def by_force(pages):
    """The main text of each (page id, host, article, outside), by counting every run in dictionaries."""

    def runs(text):
        w = text.split()
        return [(0, len(w), tuple(w))] if len(w) < html_text.RUN else [(k, k + html_text.RUN, tuple(w[k : k + html_text.RUN])) for k in range(len(w) - html_text.RUN + 1)]

    def mark(article, outside):
        return tuple(t for k, t in article if k == "article") if article is not None else tuple(t for k, t in outside if k == "plain")

    seen, articles = defaultdict(set), defaultdict(set)
    for _, host, article, outside in pages:
        own = (article is not None, mark(article, outside))
        if article is not None:
            articles[host].add(own)
        for kind, text in [*(article or []), *outside]:
            for *_, run in runs(text):
                seen[host, kind == "article", run].add(own)
    out = []
    for page, host, article, outside in pages:
        lines = []
        for kind, text in article if article is not None else [b for b in outside if b[0] == "plain"]:
            words, gone = text.split(), set()
            for start, end, run in runs(text):
                n = len(seen[host, kind == "article", run])
                if n >= html_text.INSIDE_LEAST and 2 * n >= len(articles[host]) if kind == "article" else n >= html_text.LEAST:
                    gone.update(range(start, end))
            if line := " ".join(w for k, w in enumerate(words) if k not in gone):
                lines.append(line)
        out.append((page, "\n".join(lines)))
    return sorted(out)


@pytest.mark.parametrize("shard", [html_text.SHARD, 8])
def test_query_by_brute_force(spark, tmp_path, monkeypatch, shard):
    rnd = random.Random(shard)
    pool = [" ".join(rnd.choices([f"v{k}" for k in range(40)], k=rnd.choice([2, 5, 9, 14]))) for _ in range(25)]

    def text():
        own = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 6)))
        return rnd.choice([own, rnd.choice(pool), f"{own} {rnd.choice(pool)} {own}"])

    pages = []
    for host, n in (("one.example", 30), ("two.example", 12), ("big.example", 60)):
        often = [" ".join(f"{host[:3]}{k}{j}" for j in range(10)) for k in range(3)]
        for k in range(n):
            article = None if rnd.random() < 0.4 else [("article", f"story {host} {k}"), *[(rnd.choice(["article", "article", "suspect"]), text()) for _ in range(rnd.randrange(4))]]
            if article and rnd.random() < 0.8:
                article.append(("article", f"{text()} {often[0]}"))
            outside = [("plain", f"lead {host} {k}"), *[(rnd.choice(["nav", "footer", "advert", "plain", "plain"]), rnd.choice([text(), rnd.choice(often)])) for _ in range(rnd.randrange(5))]]
            pages.append((len(pages), host, article, outside))
        pages += [(len(pages) + k, *pages[-1][1:]) for k in range(4)]  # copies under other ids
    frame = spark.createDataFrame([(i, f"https://{h}/x/{i}?q=1", rendered(a, o)) for i, h, a, o in pages], PAGES)
    frame.write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(html_text, "SHARD", shard)
    monkeypatch.setattr(html_text.main_texts, "__defaults__", tuple(shard if d == 512 else d for d in html_text.main_texts.__defaults__))
    out = queries.QUERIES["op10_html_text"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["text"]) for r in out) == by_force(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_planted_boilerplate_is_found_by_its_runs(spark):
    """Hosts whose pages have no article, no telling tag and no telling class: runs alone remove what was planted."""
    rnd = random.Random(4)
    rows, planted, own = [], {}, {}
    for host in range(6):
        plants = [" ".join(f"p{host}x{k}y{j}" for j in range(rnd.randrange(3, 30))) for k in range(12)]
        for k in range(30):
            page = host * 100 + k
            story = [" ".join(f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(12, 60))) for _ in range(6)]
            added = [p for j, p in enumerate(plants) if rnd.random() < (j + 2) / 14]
            blocks = [*[(t, 0) for t in story], *[(t, 1) for t in added]]
            rnd.shuffle(blocks)
            own[page], planted[page] = sum(len(t.split()) for t in story), sum(len(t.split()) for t in added)
            rows.append((page, f"http://h{host}.example/{k}", "".join(f"<div>{t}</div>" for t, _ in blocks)))
    out = {r["page_id"]: r["text"].split() for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    left = sum(w.startswith("p") for words in out.values() for w in words)
    stay = sum(w.startswith("w") for words in out.values() for w in words)
    assert 1 - left / sum(planted.values()) >= 0.99 and stay / sum(own.values()) >= 0.99


def test_names_alone_remove_nothing_inside_articles(spark):
    line = "<p class='social-history'>A social history.</p><h2 id='sharing'>Sharing</h2><p id='notice'>Take notice.</p><div class='related-work'>Related work.</div><section class='discussion'>Discussion.</section>"
    text = "A social history.\nSharing\nTake notice.\nRelated work.\nDiscussion."
    rows = [(1, "http://a/", f"<article>{line}<div class='ad'>Buy!</div><section id='comments'>Nice post</section><nav>Up</nav></article>")]
    rows += [(k, "http://b/", f"<article><p>Story {k} of its own</p><div class='share-box'>Tell all your friends</div><div class='share-box'>Shared {k}</div></article>") for k in range(2, 5)]
    rows += [(k, "http://c/", f"<div class='social-history'>History {k}</div><div class='cookie-note'>We use cookies</div>") for k in range(5, 8)]
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[1] == text
    assert all(out[k] == f"Story {k} of its own\nShared {k}" for k in range(2, 5))
    assert all(out[k] == f"History {k}" for k in range(5, 8))


def test_page_edge_cases(spark):
    rows = [(1, None, None, "x"), (2, "", "", "x"), (None, "http://a/", "<p>a &lt;b&gt; &amp;amp;</p>", "x"), (3, "http://a/", "<div>cut <a hre", "x"), (3, "http://a/", "<div>cut <a hre", "x")]
    out = html_text.main_texts(spark.createDataFrame(rows, PAGES + ", host string")).collect()
    assert sorted((str(r["page_id"]), r["text"]) for r in out) == [("1", ""), ("2", ""), ("3", "cut <a hre"), ("3", "cut <a hre"), ("None", "a <b> &amp;")]
    assert html_text.main_texts(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("tail", ["", '"', ">", "</p>"])
@pytest.mark.parametrize("sign", ["<a", '<a "', "a<b ", "<!-- x ", '<a ">" ', "<a ' \" >", "<a >", "</b>", "<a x='", "< ", "<p><i>", "<!x"])
def test_time_follows_the_page(sign, tail):
    page = sign * (1_000_000 // len(sign)) + tail
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 15


def test_tags_of_torn_pages():
    """Ends of tags against a plain scan of the same rule, on short torn pages."""
    rnd = random.Random(8)
    for _ in range(3000):
        page = "".join(rnd.choice(["<a", "<b ", ">", '"', "'", "x", " ", "</a", "<!", "<!--", "-->", "</"]) for _ in range(rnd.randrange(14)))
        tags, at, got = html_text.Tags(page), 0, []
        while found := tags.after(at):
            got.append(found[:2])
            at = found[1]
        assert got == plain_tags(page)


def plain_tags(page):
    out, at = [], 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?") and page[at + 1 : at + 2]:
            end = page.find(">", at + 2) + 1
        else:
            named = at + 2 if page.startswith("</", at) else at + 1
            if not page[named : named + 1].isalpha():
                at += 1
                continue
            while named < len(page) and not page[named].isspace() and page[named] not in "/>":
                named += 1
            quote, k = "", named
            while k < len(page) and (quote or page[k] != ">"):
                quote = "" if page[k] == quote else quote or (page[k] if page[k] in "\"'" else "")
                k += 1
            end = k + 1 if k < len(page) else page.find(">", named) + 1
        if end <= at:
            at += 1
            continue
        out.append((at, end))
        at = end
    return out


def test_blocks_go_on_around_inline_controls():
    assert html_text.parse("<article><p>I said <button>b</button> so</p><p>x</article>") == [(0, "b"), (2, "I said so"), (2, "x")]
    assert html_text.parse("<article><p>I said <button>b</p><p>x</p></article><nav>n") == [(0, "b"), (2, "I said"), (2, "x"), (0, "n")]


def test_shards_by_bytes(spark, monkeypatch):
    """Hosts with few but long pages are dealt to several tasks as well, with the same texts."""
    rows = [(k, f"http://h/{k}", f"<div>shared words that stand on every page here and there</div><p>{' '.join(f'w{k}x{j}' for j in range(50))}</p>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_text.main_texts(pages).collect()))
    monkeypatch.setattr(html_text, "SHARD_BYTES", 2000)
    assert sorted(map(tuple, html_text.main_texts(pages).collect())) == want and "shared" not in want[0][2]


def test_equal_tags_are_judged_once():
    html_text._kind_by_names.cache_clear()
    page = "<main>" + '<div class="sidebar">x</div><p class="lead">y</p><a href="/z">z</a>' * 1000 + "</main>"
    assert html_text.parse(page) == [(html_text.ARTICLE, t) if t != "x" else (html_text.CHROME, t) for _ in range(1000) for t in ("x", "y", "z")]
    assert html_text._kind_by_names.cache_info().misses <= 3
