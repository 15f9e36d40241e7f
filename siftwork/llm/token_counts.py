"""Token counts that follow edits: only what an edit touches is encoded again.

Each document keeps a segment tree over its pre-tokens. A leaf is a run of pre-tokens with their token counts, a node
holds the sums of characters and tokens below it. An edit re-encodes from the last pre-token boundary that its
characters cannot have influenced (some characters before it, see CONTEXTS) up to the first boundary behind it that the old text
had too and that the new text cannot move any more; the touched leaves change and so do the sums above them. The known
pattern looks at most two characters past the end of a match and never back, so what lies outside is cut as before; for
other patterns nothing is known of that, and the whole text is cut again.

token_trees() gives a table of the trees, to be kept; edited_trees() takes it with edits and gives it back as edited, and
encodes the touched leaves only. edited_counts() builds, edits and drops the trees of a table in one pass.

Edge cases: a null or empty text has no tokens; null edits count as none and a null edit is skipped; bounds outside the
text are moved to its ends, an end before its start means an insertion at start, a null replacement is empty; edits are
applied in order, each in the coordinates that the earlier ones left; whole texts of any length; rows that repeat are
counted each; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BLOCK_CHARS, Encoder, shared_ranks, worker_encoder
from .scratch import small_batches, tidy

#: Pre-tokens of a new leaf.
LEAF = 64
#: By pattern, the characters before an edit whose boundaries are cut again: one more than the pattern looks ahead of a
#: match. Under another pattern an edit cuts its whole text again.
CONTEXTS = {public_tokenizers.PATTERN: 3}
EDITS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("text", T.StringType())]))


class TokenTree:
    """A segment tree over the pre-tokens of one text."""

    def __init__(self, words: list[str], encoder: Encoder, context: int | None = None):
        self.encoder, self.context, self.base, self.starts = encoder, context, "", [0, 0]
        self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        self.encoded_chars = 0
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(map(len, leaf)), self._count(leaf)
        for n in range(self.width - 1, 0, -1):
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    @classmethod
    def stored(cls, text: str, chars: list[int], tokens: list[int], encoder: Encoder, context: int | None = None) -> TokenTree:
        """The tree of text from what leaves() gave: no leaf is cut or encoded before an edit touches it."""
        if context is None:
            words = encoder.cut(text)
            encoder.learn(words)
            return cls(words, encoder)
        tree = cls([], encoder, context)
        tree.base, tree.starts = text, list(accumulate(chars, initial=0))
        tree.leaves = [None] * len(chars) or [[]]
        tree.width = 1 << (len(tree.leaves) - 1).bit_length()
        tree.chars, tree.tokens = ([0] * tree.width + list(x) + [0] * (tree.width - len(x)) for x in (chars, tokens))
        for n in range(tree.width - 1, 0, -1):
            tree.chars[n] = tree.chars[2 * n] + tree.chars[2 * n + 1]
            tree.tokens[n] = tree.tokens[2 * n] + tree.tokens[2 * n + 1]
        return tree

    def _leaf(self, k: int) -> list[str]:
        """The pre-tokens of a leaf; those of a stored one are cut and encoded now, from its own start on."""
        if self.leaves[k] is None:
            start, end = self.starts[k], self.starts[k + 1]
            own, at = [], start
            for word in self.encoder.cut(self.base[start : end + self.context]):
                if at == end:
                    break
                own.append(word)
                at += len(word)
            self.encoder.learn(own)
            self.encoded_chars += end - start
            self.leaves[k] = own
        return self.leaves[k]

    def stored_leaves(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of each leaf, without empty ones and with those that grew cut again."""
        chars, tokens = [], []
        for k, leaf in enumerate(self.leaves):
            if leaf is None or len(leaf) <= 2 * LEAF:
                if self.chars[self.width + k]:
                    chars.append(self.chars[self.width + k]), tokens.append(self.tokens[self.width + k])
                continue
            for i in range(0, len(leaf), LEAF):
                chars.append(sum(map(len, leaf[i : i + LEAF]))), tokens.append(self._count(leaf[i : i + LEAF]))
        return chars, tokens

    def _count(self, words: list[str]) -> int:
        known = self.encoder.known
        return sum([len(known[w]) for w in words]) >> 2

    def _set(self, leaf: int, words: list[str]) -> None:
        self.leaves[leaf] = words
        chars, tokens = sum(map(len, words)), self._count(words)
        n = self.width + leaf
        more, most = chars - self.chars[n], tokens - self.tokens[n]
        while n:
            self.chars[n] += more
            self.tokens[n] += most
            n >>= 1

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last leaf at the end of the text), and where that leaf starts."""
        n, start = 1, 0
        while n < self.width:
            n *= 2
            if at >= start + self.chars[n] and self.chars[n + 1]:
                start += self.chars[n]
                n += 1
        return n - self.width, start

    @property
    def size(self) -> int:
        return self.chars[1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def edit(self, start: int, end: int, text: str) -> None:
        """Replaces the characters from start to end by text."""
        start = min(max(start, 0), self.size)
        end = min(max(end, start), self.size)
        context = self.size + len(text) if self.context is None else self.context
        first, at = self._find(max(0, start - context))
        leaf = self._leaf(first)
        ends = list(accumulate(map(len, leaf), initial=at))
        keep = max(0, bisect_right(ends, max(start - context, at)) - 1) if leaf else 0
        begin = ends[keep]

        old, marks, where, last = [], [], begin, first  # old pre-tokens from begin on, and where each of them ends
        pending = leaf[keep:]

        def more(upto: int) -> bool:
            nonlocal pending, last, where
            while where < upto:
                while not pending:
                    if last + 1 >= len(self.leaves):
                        return False
                    last += 1
                    pending = self._leaf(last)
                word, pending = pending[0], pending[1:]
                old.append(word)
                where += len(word)
                marks.append(where)
            return True

        more(end)
        shift = len(text) - (end - start)
        reach = 32
        while True:
            whole = not more(end + reach) or (where == self.size)
            joined = "".join(old)
            buffer = joined[: start - begin] + text + joined[end - begin :]
            words = self.encoder.cut(buffer)
            edges, stop = {m: k for k, m in enumerate(marks)}, None
            place = begin
            for k, word in enumerate(words):
                place += len(word)
                mark = place - shift
                if mark >= end and mark in edges and (whole or place - begin + context <= len(buffer)):
                    stop = (k + 1, edges[mark] + 1)
                    break
            if stop or whole:
                break
            reach *= 4
        new, used = stop or (len(words), len(old))
        fresh = words[:new]
        self.encoder.learn(fresh)
        self.encoded_chars += sum(map(len, fresh))
        rest = old[used:] + pending
        if first == last:
            self._set(first, leaf[:keep] + fresh + rest)
        else:
            self._set(first, leaf[:keep] + fresh)
            for k in range(first + 1, last):
                self._set(k, [])
            self._set(last, rest)

    def text(self) -> str:
        return "".join(self.base[self.starts[k] : self.starts[k + 1]] if leaf is None else "".join(leaf) for k, leaf in enumerate(self.leaves))


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """One row for each document: id_col, n_chars, n_tokens, n_edits, edited_chars, edited_tokens, encoded_chars.

    edits_col is an array of structs (start, end, text) as in EDITS; encoded_chars is how many characters the edits
    made the encoder read again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = shared_ranks(spark, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)

        context = CONTEXTS.get(pattern)

        def rows(held: list, kind: pa.DataType) -> pa.RecordBatch:
            recent = {w for _, words, _ in held for w in words}
            encoder.learn(recent)
            out = []
            for i, words, edits in held:
                tree = TokenTree(words, encoder, context)
                before = (tree.size, tree.total)
                edits = [e for e in edits or [] if e is not None]
                for e in edits:
                    start = e["start"] or 0
                    tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                out.append((i, *before, len(edits), tree.size, tree.total, tree.encoded_chars))
            encoder.forget(recent)
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=NAMES)

        held, chars, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text, edits in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                held.append((i, encoder.cut(text or ""), edits))
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield rows(held, kind)
                    held, chars = [], 0
        if held:
            yield rows(held, kind)

    NAMES = [id_col, "n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "encoded_chars"]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in NAMES[1:]])
    return docs.select(id_col, text_col, edits_col).mapInArrow(tidy(run), schema)


def token_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col, n_chars, n_tokens, n_edits, encoded_chars, leaf_chars, leaf_tokens): the tree of each text, to be
    kept beside it: the characters and tokens of its leaves; the sums above them follow."""
    return _trees(docs.select(id_col, text_col, F.lit(None).cast(EDITS).alias("edits"), *[F.lit(None).cast("array<int>").alias(c) for c in LEAVES]), ranks_path, pattern, id_col, text_col)


def edited_trees(trees: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """The same after edits, from what token_trees() or this gave and edits_col, as in EDITS: the text as edited, with its tree.

    Only leaves that an edit touches are cut and encoded; encoded_chars says how many characters that were.
    """
    return _trees(trees.select(id_col, text_col, F.col(edits_col).alias("edits"), *LEAVES), ranks_path, pattern, id_col, text_col)


LEAVES = ("leaf_chars", "leaf_tokens")


def _trees(rows: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    spark = rows.sparkSession
    small_batches(spark)
    shared, context = shared_ranks(spark, ranks_path), CONTEXTS.get(pattern)
    names = [id_col, text_col, "n_chars", "n_tokens", "n_edits", "encoded_chars", *LEAVES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared.value, pattern)
        for batch in batches:
            out = []
            for i, text, edits, chars, tokens in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if chars is None:
                    words = encoder.cut(text or "")
                    encoder.learn(words)
                    tree = TokenTree(words, encoder, context)
                else:
                    tree = TokenTree.stored(text or "", chars, tokens, encoder, context)
                edits = [e for e in edits or [] if e is not None]
                for e in edits:
                    start = e["start"] or 0
                    tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                out.append((i, tree.text() if edits else text or "", tree.size, tree.total, len(edits), tree.encoded_chars, *tree.stored_leaves()))
                encoder.forget(())
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), T.StructField(text_col, T.StringType()), *[T.StructField(n, T.LongType()) for n in names[2:6]], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in LEAVES]])
    return rows.mapInArrow(tidy(run), schema)
