"""Main text of web pages: host suffix arrays over page token streams, after a structural parse.

parse() cuts a page into blocks of decoded text and says what their elements are: chrome for certain (menus, headers,
footers, sidebars, adverts, forms, comments by their tag, role or a whole class), article, suspect (inside an article, an
element with a class or id such as notice, social or related), or neither. The pages of a host are joined into one token
stream; a suffix array, sorted to the depth of the shortest run that counts, shows which runs stand on several pages of
the host. Outside articles and in suspect elements what such runs cover is boilerplate and only the unique runs stay: a
name alone removes nothing there. Elsewhere inside articles a run is boilerplate if it stands inside the articles of at
least INSIDE_LEAST pages and of half of the host's pages that have one; rarer repeats are content: copies, quoted passages,
headings that adverts repeat. Two checks by tags follow: what is chrome for certain goes even where it is unique, and on a
page with an article element what is outside of it goes too.

A host with more than SHARD pages is dealt to shards by a hash of the page, so a task never holds more than about SHARD
pages; each shard has a suffix array of its own. Its groups of equal runs go out as 64-bit hashes, one row a run and page,
the different pages of a hash are counted over all shards, and each shard gets the counts of its own runs back. So the
number of shards does not change the result, but for two cases of negligible chance: equal hashes, and a run inside
articles of half of a host's pages of which a shard with FEW pages or more holds a single one (such runs are not sent).

Outside articles and in suspect elements a run is boilerplate on LEAST different pages. Pages with the same main text (article, or else what is
not chrome) are one page, whatever their ids, so copies do not empty each other; what three different pages without an
article share goes from them, and near copies are different pages.

Edge cases: null and empty html and pages without main text give the empty string; unclosed and stray tags are
tolerated; a page cut off in a tag or a reference keeps the rest as text; a null url is a host of its own; rows of a host
that repeat a page_id are the same page when pages are counted, so a page never makes itself boilerplate; an empty table
gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import html
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import held, kept, small_batches, tidy
from .shingles import mixed

#: Pages and bytes of a shard; tokens of the shortest run that counts (shorter blocks count when they repeat as a whole).
SHARD, SHARD_BYTES, RUN = 512, 64 << 20, 8
#: Inside articles a run is boilerplate on at least so many pages, if these are half of the host's pages with an article.
INSIDE_LEAST = 10
#: Outside articles a run is boilerplate on so many different pages of a host.
LEAST = 3
#: A shard with fewer pages that have an article tells all runs inside of them, others those on two pages.
FEW = 64
OUTSIDE, INSIDE, PAGES = 0, 1, 2
#: Of the compression of parsed pages.
LEVEL = 3
CHROME, NEITHER, ARTICLE, SUSPECT = 0, 1, 2, 3

_OPEN = regex.compile(r"<(?:(?P<note>!--)|[!?]|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+))")
_WHOLE = regex.compile(r"""<(?:(?P<note>!--)|[!?]|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?P<last>>)?)""")
_ATTR = regex.compile(r"""([a-zA-Z_:][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_NOT_WORD = regex.compile(r"[^a-z0-9]+")
_HIDDEN = regex.compile(r"(?i)(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|visibility\s*:\s*hidden")
_UNSHOWN = regex.compile(r"(?i)display\s*:\s*none")
_RAW = frozenset("script style noscript template textarea iframe svg math object title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CHROME_TAGS = frozenset("aside button dialog fieldset footer form head input label menu nav option select".split())
_CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements whose name tells something; what an attribute that tells something has in it.
_TELLING, _NAMED = _CHROME_TAGS | {"article", "header", "main"}, regex.compile(r"(?i)class|id|role|itemprop|display|visibility")
#: A whole class or id of a container that says for certain that it is not main text.
_CHROME_WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement comments disqus navbar sidebar".split())
_CONTAINERS = frozenset("center div dl figure ins ol section table ul".split())
#: Parts of a class or id that make an element inside an article suspect: what repeats of it on the host goes.
_SUSPECT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion gdpr login menu modal nav "
    "navigation newsletter notice notices overlay pagination paywall popup promo promoted promotion recommended related replies respond share sharing sidebar signup skip "
    "social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus replies respond".split())
_ARTICLE_WORDS = frozenset("article articlebody post entry story content maincontent".split())


@lru_cache(4096)
def _raw_end(name: str) -> regex.Pattern:
    return regex.compile(rf"</{regex.escape(name)}\s*>", regex.I)


def _kind_of(name: str, rest: str, inside: int) -> int | None:
    """What an element makes of its content; None if it leaves that as it is."""
    if not rest or not _NAMED.search(rest):
        if name not in _TELLING:
            return None
        rest = ""
    return _kind_by_names(name, rest, inside) if len(rest) <= 256 else _kind_by_names.__wrapped__(name, rest, inside)


@lru_cache(4096)
def _kind_by_names(name: str, rest: str, inside: int) -> int | None:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)} if "=" in rest else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower() if found else ""
    words = set(_NOT_WORD.split(names)) if names else set()
    role = found.get("role", "").lower()
    if name in ("html", "body", "main"):
        return ARTICLE if name == "main" else None
    if name == "article":
        return CHROME if words & _COMMENT_WORDS else ARTICLE
    if name in _CHROME_TAGS or role in _CHROME_ROLES:
        return CHROME
    if name == "header":
        return None if inside in (ARTICLE, SUSPECT) else CHROME
    if "hidden" in rest.lower() and _HIDDEN.search(rest) or "display" in rest and _UNSHOWN.search(rest):
        return CHROME
    if name in _CONTAINERS and _CHROME_WORDS & set(names.split()):
        return CHROME
    if inside in (ARTICLE, SUSPECT):
        return SUSPECT if words & _SUSPECT_WORDS else None
    if role == "main" or "articlebody" in found.get("itemprop", "").lower() or words & _ARTICLE_WORDS and not words & _SUSPECT_WORDS:
        return ARTICLE
    return None


class Tags:
    """The tags of a page in order, found in time that grows with its length whatever the page holds.

    A tag ends at the first > outside of its quotes, or at the first > if there is none outside. A search that finds none
    outside has looked at the whole rest of the page; from then on ends come from a table of all quotes and >, made once.
    """

    def __init__(self, page: str):
        self.page, self.ends = page, None

    def _table(self) -> tuple[list[int], list[int]]:
        """Places of quotes and >, and for each the end of a tag of which it is the first such sign; -1 without one."""
        at = [m.start() for m in regex.finditer("[>\"']", self.page)]
        ends, after = [-1] * (len(at) + 1), {}
        for k in range(len(at) - 1, -1, -1):
            sign = self.page[at[k]]
            if sign == ">":
                ends[k] = at[k]
            else:
                ends[k] = ends[after[sign] + 1] if sign in after else -1
                after[sign] = k
        return at, ends

    def _end(self, start: int) -> int:
        """The place of the > that ends the tag whose name ends at start; -1 if no > follows."""
        if self.ends is None:
            self.ends = self._table()
        at, ends = self.ends
        end = ends[bisect_left(at, start)]
        return end if end >= 0 else self.page.find(">", start)

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, name, / where it closes, rest) of the next tag; the name is empty for comments and declarations."""
        page = self.page
        while found := (_WHOLE if self.ends is None else _OPEN).search(page, at):
            start = found.start()
            if found.lastgroup == "last":
                _, closes, name, rest, _ = found.groups()
                return start, found.end(), name.lower(), closes, rest
            note, closes, name = found.group("note", "end", "name")
            if note:
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", "", ""
            named = found.end("name") if name else start + 2
            end = self._end(named) if name else page.find(">", named)
            if end >= 0:
                return start, end + 1, (name or "").lower(), closes or "", page[named:end] if name else ""
            # Nothing but a comment can follow without a >.
            at = page.find("<!--", start + 1)
            if at < 0:
                return None
        return None


def parse(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block that has text, in order."""
    page = page or ""
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool, list[str] | None]] = []
    opened: defaultdict[str, int] = defaultdict(int)
    pieces: list[str] = []
    kind, at, explicit = NEITHER, 0, False
    own: list[bool] = []
    in_article = False
    tags = Tags(page)

    def flush() -> None:
        if text := " ".join("".join(pieces).split()):
            blocks.append((kind, text))
            own.append(in_article)
        pieces.clear()

    def close(k: int) -> None:
        """Leaves the elements from the k-th on. The block around an inline control goes on after it."""
        nonlocal kind, in_article, pieces
        while len(stack) > k:
            name, before, article, around = stack.pop()
            opened[name] -= 1
            if pieces and (around is not None or before != kind):
                flush()
            pieces = pieces if around is None else around
            kind, in_article = before, article

    while True:
        tag = tags.after(at)
        end = tag[0] if tag else len(page)
        if end > at:
            piece = page[at:end]
            pieces.append(html.unescape(piece) if "&" in piece else piece)
        if not tag:
            break
        _, at, name, closes, rest = tag
        if not name:
            continue
        if closes:
            if pieces and name in _BLOCK:
                flush()
            if opened[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
            continue
        if name in _RAW:
            if not rest.rstrip().endswith("/"):
                found = _raw_end(name).search(page, at)
                at = found.end() if found else len(page)
            continue
        if name in _BLOCK:
            if pieces:
                flush()
        elif name == "br":
            pieces.append(" ")
        if name in _VOID:
            continue
        if name == "p" and stack and any(s[0] == "p" for s in stack[-4:]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
        new = _kind_of(name, rest, kind)
        changes, around = new is not None and kind != CHROME and new != kind and not (kind == SUSPECT and new == ARTICLE), None
        if changes and new == CHROME and name not in _BLOCK:
            pieces, around = [], pieces
        elif changes:
            flush()
        stack.append((name, kind, in_article, around))
        opened[name] += 1
        kind = new if changes else kind
        if name == "article" and kind in (ARTICLE, SUSPECT):
            flush()
            explicit = in_article = True
    flush()
    close(0)
    flush()
    if explicit:
        blocks = [(NEITHER if k in (ARTICLE, SUSPECT) and not a else k, t) for (k, t), a in zip(blocks, own, strict=True)]
    return blocks


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page, url, host, shard and the parsed blocks, packed; mark: equal for rows that count as one page of their host.

    Where lean is set, blocks that the tags remove are left out.
    """
    codec = pa.Codec("zstd", compression_level=LEVEL)
    for batch in batches:
        marks, blocks, sizes = [], [], []
        for page, source, again, lean in zip(*[batch.column(k).to_pylist() for k in (0, 2, 4, 7)], strict=True):
            found = parse(source)
            main = ARTICLE if any(k in (ARTICLE, SUSPECT) for k, _ in found) else NEITHER
            marks.append(_number(f"id {page!r}" if again else "\n".join(["text", *[t for k, t in found if k == main]])))
            packed = "\n".join(f"{k}{t}" for k, t in found if not lean or k == main or k == SUSPECT).encode("utf-8", "surrogatepass")  # a text holds no line break
            sizes.append(len(packed))
            blocks.append(codec.compress(packed, asbytes=True))
        columns = [batch.column(0), batch.column(1), batch.column(3), batch.column(5), batch.column(6), pa.array(marks, pa.int64()), pa.array(sizes, pa.int32()), pa.array(blocks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["page", "url", "host", "shard", "shards", "mark", "size", "blocks"])


def _unpacked(table: pa.Table) -> tuple[list[list[int]], list[list[str]]]:
    kinds, texts = [], []
    for size, packed in zip(table.column("size").to_pylist(), table.column("blocks").to_pylist(), strict=True):
        lines = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n") if size else []
        kinds.append([int(x[0]) for x in lines])
        texts.append([x[1:] for x in lines])
    return kinds, texts


class SuffixRanks:
    """The suffix array of a token stream by prefix doubling: ranks of the windows of 1, 2, 4 ... tokens at each place.

    Equal ranks at a depth mean equal windows; sorting the places by their ranks gives the suffixes in order, to that depth.
    Deeper sorting would not change what is covered: a longer repeat is a chain of windows of the shortest length that
    counts, each of which stands on at least the same pages.
    """

    def __init__(self, tokens: np.ndarray, depth: int):
        self.levels = [np.where(tokens < 0, len(tokens) + tokens, tokens)]  # tokens: 0, 1, 2 ..., and -1, -2 ... once each
        size = 1
        while size * 2 <= depth:
            now = self.levels[-1]
            shifted = np.full(len(now), -1, np.int64)
            shifted[: max(0, len(now) - size)] = now[size:]
            self.levels.append(np.unique(now * (len(now) + 2) + shifted + 1, return_inverse=True)[1].astype(np.int64))
            size *= 2

    def windows(self, places: np.ndarray, size: int) -> np.ndarray:
        """A number for the window of size tokens at each place; equal for equal windows of this size only."""
        level = size.bit_length() - 1
        now = self.levels[level]
        if size == 1 << level:
            return now[places]
        return now[places] * (len(now) + 2) + now[np.minimum(places + size - (1 << level), len(now) - 1)]


def _pages_with(keys: np.ndarray, pages: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal keys: the group of each key, the first key of each group, and on how many different pages a group
    stands outside and inside articles."""
    order = np.argsort(keys * (int(pages.max(initial=0)) + 1) + pages)
    k, p = keys[order], pages[order]
    key_starts = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
    pair_starts = np.flatnonzero(key_starts | np.concatenate(([True], p[1:] != p[:-1]))[: len(k)])
    group = np.cumsum(key_starts) - 1
    of_key = np.empty(len(k), np.int64)
    of_key[order] = group
    n = int(key_starts.sum())
    pairs = group[pair_starts]
    outer, inner = (np.maximum.reduceat(x, pair_starts) if len(k) else x for x in (~inside[order], inside[order]))
    return of_key, order[key_starts], np.bincount(pairs[outer], minlength=n), np.bincount(pairs[inner], minlength=n)


class Stream:
    """The token stream of pages (numbers, the same for rows that count as one page), and what of it may repeat: every window of run
    tokens of a block, and every block of fewer tokens as a whole."""

    def __init__(self, pages: list[int], kinds: list[list[int]], texts: list[list[str]], run: int):
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.kinds, self.texts, self.run = kinds, texts, run
        number, tokens, spans, block_pages, inside = self.number, [], [], [], []
        for page, own_kinds, own_texts in zip(pages, kinds, texts, strict=True):
            for kind, text in zip(own_kinds, own_texts, strict=True):
                words = text.split(" ")
                spans.append((len(tokens), len(words)))
                tokens.extend(map(number.__getitem__, words))
                tokens.append(-1 - len(spans))
                block_pages.append(page)
                inside.append(kind == ARTICLE)
        self.flat = np.array(tokens, np.int64)
        self.starts, self.sizes = np.array(spans, np.int64).reshape(-1, 2).T
        self.pages, self.of_page = np.unique(np.array(block_pages, np.int64), return_inverse=True)
        self.inside = np.array(inside, bool)
        self.article_pages = len(np.unique(self.of_page[self.inside]))

    def units(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, their blocks) of what may repeat."""
        block_of = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        left = (self.starts + self.sizes)[block_of] - np.arange(len(self.flat))
        for size in range(1, self.run):
            short = np.flatnonzero(self.sizes == size)
            if len(short):
                yield size, self.starts[short], short
        places = np.flatnonzero(left >= self.run)
        if len(places):
            yield self.run, places, block_of[places]

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By the suffix array, for each size: places, their groups, a place of each group, on how many pages it is outside and inside articles."""
        if len(self.flat):
            ranks = SuffixRanks(self.flat, self.run)
            for size, places, blocks in self.units():
                group, first, outer, inner = _pages_with(ranks.windows(places, size), self.of_page[blocks], self.inside[blocks])
                yield size, places, group, places[first], outer, inner

    def hashes(self, size: int, places: np.ndarray) -> np.ndarray:
        """64-bit hashes of the runs of size tokens at places, the same in every stream."""
        if not hasattr(self, "of_token"):
            self.of_token = np.array([_number(w) for w in self.number], np.int64).view(np.uint64)[np.maximum(self.flat, 0)]
        total = np.full(len(places), np.uint64(size))
        for k in range(size):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + self.of_token[places + k])
        return total.view(np.int64)

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a shard tells of its pages: (what, key, page, whether it is the first row of what and key) without repeats; the pages with an article stand under PAGES."""
        pages = np.unique(self.of_page[self.inside])
        out = [(np.full(len(pages), PAGES), np.zeros(len(pages), np.int64), pages)]
        own = {size: blocks for size, _, blocks in self.units()}
        for size, places, group, first, _, inner in self.counts():
            blocks = own[size]
            key = self.hashes(size, first)
            inside = self.inside[blocks]
            for what, which in ((OUTSIDE, ~inside), (INSIDE, inside & ((inner > 1) | (len(pages) < FEW))[group])):
                pairs = np.unique(group[which] * len(self.pages) + self.of_page[blocks][which])
                out.append((np.full(len(pairs), what), key[pairs // len(self.pages)], pairs % len(self.pages)))
        what, keys, pages = (np.concatenate(x) for x in zip(*out, strict=True))
        first = np.zeros(len(what), bool)
        for w in (OUTSIDE, INSIDE, PAGES):
            own = np.flatnonzero(what == w)
            first[own[np.unique(keys[own], return_index=True)[1]]] = True
        return what, keys, self.pages[pages], first

    def main_texts(self, found: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[str]:
        """The main text of each page; found: for each size, places, and whether what is there repeats outside and inside articles."""
        often, everywhere = np.zeros(len(self.flat) + 1, np.int64), np.zeros(len(self.flat) + 1, np.int64)
        for size, places, outside, inside in found:
            for edge, hits in ((often, places[outside]), (everywhere, places[inside])):
                np.add.at(edge, hits, 1)
                np.add.at(edge, hits + size, -1)
        often, everywhere = np.cumsum(often) > 0, np.cumsum(everywhere) > 0
        return _joined(self.kinds, self.texts, lambda b, kind: (everywhere if kind == ARTICLE else often)[self.starts[b] : self.starts[b] + self.sizes[b]])


def _joined(kinds: list[list[int]], texts: list[list[str]], covered: Callable[[int, int], np.ndarray] | None) -> list[str]:
    """The lines of each page that the tags leave, without the words that covered(number of the block, kind) marks."""
    out, b = [], 0
    for own_kinds, own_texts in zip(kinds, texts, strict=True):
        main, lines = ARTICLE if ARTICLE in own_kinds or SUSPECT in own_kinds else NEITHER, []
        for kind, text in zip(own_kinds, own_texts, strict=True):
            if kind == main or kind == SUSPECT:
                mask = covered(b, kind) if covered else None
                if mask is None or not mask.any():
                    lines.append(text)
                elif line := " ".join(w for w, c in zip(text.split(" "), mask, strict=True) if not c):
                    lines.append(line)
            b += 1
        out.append("\n".join(lines))
    return out


def repeats_inside(pages: np.ndarray, of: int) -> np.ndarray:
    """Whether what stands inside articles of so many pages is boilerplate, on a host with of pages that have an article."""
    return (pages >= INSIDE_LEAST) & (pages * 2 >= of)


def unique_runs(pages: list[int], kinds: list[list[int]], texts: list[list[str]], run: int = RUN, least: int = 2) -> list[str]:
    """The main text of each page of a host (or of a shard of it); pages: numbers, the same for rows of one page."""
    stream = Stream(pages, kinds, texts, run)
    return stream.main_texts((size, places, (outer >= least)[group], repeats_inside(inner, stream.article_pages)[group]) for size, places, group, _, outer, inner in stream.counts())


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shard: int = SHARD, run: int = RUN) -> DataFrame:
    """(id_col, url_col, text) for each page."""
    spark = pages.sparkSession
    small_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    ids = pages.select(host.alias("_host"), F.col(id_col).alias("_page"))
    sizes = pages.select(host.alias("_host"), F.octet_length(html_col).cast("long").alias("_bytes")).groupBy("_host").agg(F.count("*").alias("_n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("_bytes"))
    sizes = sizes.select("_host", F.greatest(F.ceil(F.col("_n") / shard), F.ceil(F.col("_bytes") / SHARD_BYTES)).alias("_shards"))
    hosts = held(kept(sizes.where(F.col("_shards") > 1), "hosts"))
    again = held(kept(ids.groupBy(F.col("_host").alias("_on"), "_page").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1).drop("_rows").withColumn("_again", F.lit(True)), "again"))
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = T.StructType(
        [T.StructField("page", kinds[id_col]), T.StructField("url", kinds[url_col]), T.StructField("host", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("shards", T.LongType())]
        + [T.StructField("mark", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("blocks", T.BinaryType())]
    )

    def parsed(how: str) -> DataFrame:
        last = how == "left"
        rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
        rows = rows.join(hosts, F.col("host") == F.col("_host"), how).join(again, (F.col("host") == F.col("_on")) & F.col("page").eqNullSafe(F.col("_page")), "left")
        shards = F.coalesce("_shards", F.lit(1)).cast("long")
        rows = rows.select("page", "url", "html", "host", F.coalesce("_again", F.lit(False)).alias("again"), F.pmod(F.xxhash64("page", "url"), shards).alias("shard"), shards.alias("shards"), (F.lit(last) & (shards > 1)).alias("lean"))
        rows = rows if last else rows.withColumn("url", F.lit(None).cast(kinds[url_col]))
        return rows.mapInArrow(tidy(_parsed), schema)

    def tell(table: pa.Table) -> pa.Table:
        what, keys, marks, first = Stream(table.column("mark").to_pylist(), *_unpacked(table), run).told()
        own = [pa.array([table.column(c)[0].as_py()] * len(what), t) for c, t in (("host", pa.string()), ("shard", pa.int64()))]
        return pa.table([*own, pa.array(what.astype(np.int32)), pa.array(keys), pa.array(marks), pa.array(first)], names=["host", "shard", "what", "key", "mark", "first"])

    def of_shard(table: pa.Table, answers: pa.Table) -> pa.Table:
        marks, (own_kinds, own_texts) = table.column("mark").to_pylist(), _unpacked(table)
        if not marks or table.column("shards")[0].as_py() == 1:
            texts = unique_runs(marks, own_kinds, own_texts, run, LEAST)
        else:
            what, keys, count = (answers.column(c).to_numpy() for c in ("what", "key", "n"))
            of = int(count[what == PAGES].max(initial=0))
            outside, inside = keys[(what == OUTSIDE) & (count >= LEAST)], keys[(what == INSIDE) & repeats_inside(count, of)]
            if len(inside) or len(outside) and any(ARTICLE not in k or SUSPECT in k for k in own_kinds):
                stream = Stream(marks, own_kinds, own_texts, run)
                hashed = ((size, places, stream.hashes(size, places)) for size, places, _ in stream.units())
                texts = stream.main_texts((size, places, np.isin(h, outside), np.isin(h, inside)) for size, places, h in hashed)
            else:
                texts = _joined(own_kinds, own_texts, None)
        return pa.table([table.column("page"), table.column("url"), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    told = kept(parsed("inner").groupBy("host", "shard").applyInArrow(tell, "host string, shard long, what int, key long, mark long, first boolean"), "runs")
    counted = told.select("host", "what", "key", "mark").distinct().groupBy("host", "what", "key").agg(F.count("*").alias("n"))
    counted = counted.where((F.col("what") == PAGES) | (F.col("n") >= F.when(F.col("what") == INSIDE, INSIDE_LEAST).otherwise(LEAST)))
    counted = held(kept(counted, "counts"))
    answers = told.where("first").join(counted, ["host", "what", "key"]).select("host", "shard", "what", "key", "n")
    out = T.StructType([T.StructField(id_col, kinds[id_col]), T.StructField(url_col, kinds[url_col]), T.StructField("text", T.StringType())])
    return parsed("left").groupBy("host", "shard").cogroup(answers.groupBy("host", "shard")).applyInArrow(of_shard, out)
