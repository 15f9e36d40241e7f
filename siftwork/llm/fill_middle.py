"""Fill-in-middle transformation: texts are cut in three by units and put together again in another order.

A unit is a word with the white space before it, or white space at the end of a text. A text is counted once, in
pieces of its UTF-8 bytes, and the count leaves a sparse index: the byte and code-point offsets after every EVERY-th
unit. A cut finds its checkpoint by binary search and scans the bytes from there to the next checkpoint at most, so
memory beside the text is a piece and some bytes for EVERY units, however long the text is.

Which texts are transformed, where they are cut and in which form they are put follows from a hash of a seed and the
id, so that reruns agree; no shuffle.

Edge cases: a null text counts as empty; an empty text and one that holds a sentinel stay plain, as do those that the
rate leaves out; cuts may fall together or on the ends (empty parts); white space alone is one unit; a null id is
hashed as an empty one; rows that repeat an id or a text are rows of their own; columns other than the named ones are
not read, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches, tidy

#: Units between two checkpoints, and bytes that are looked at in one step.
EVERY, PIECE = 256, 1 << 18
#: Signs before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _word_ends(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Offsets just after the words that end in data[start:stop]."""
    word = ~_SPACE[data[start : min(stop + 1, len(data))]]
    after = word[1:] if stop < len(data) else np.append(word[1:], False)
    return np.flatnonzero(word[: stop - start] & ~after) + start + 1


def _chars(data: np.ndarray, start: int, stop: int) -> int:
    """Code points that begin in data[start:stop]."""
    return int(np.count_nonzero((data[start:stop] & 0xC0) != 0x80))


@dataclass
class Checkpoints:
    """The sparse index of one text: unit marks[k] ends at byte at_bytes[k] and code point at_chars[k]."""

    data: np.ndarray
    units: int
    chars: int
    marks: np.ndarray
    at_bytes: np.ndarray
    at_chars: np.ndarray

    def cut(self, units: int) -> tuple[int, int]:
        """Byte and code-point offsets after so many units."""
        k = int(np.searchsorted(self.marks, units, "right")) - 1
        byte, char, missing = int(self.at_bytes[k]), int(self.at_chars[k]), units - int(self.marks[k])
        if not missing:
            return byte, char
        if units == self.units:
            return len(self.data), self.chars
        start, limit = byte, int(self.at_bytes[k + 1]) if k + 1 < len(self.marks) else len(self.data)
        while True:
            stop = min(start + PIECE, limit)
            ends = _word_ends(self.data, start, stop)
            if missing <= len(ends):
                end = int(ends[missing - 1])
                return end, char + _chars(self.data, byte, end)
            missing, start = missing - len(ends), stop


def counted(data: np.ndarray, every: int = EVERY) -> Checkpoints:
    """The units and code points of UTF-8 bytes, with checkpoints after every every-th unit; the text's start is one too."""
    marks, at_bytes, at_chars = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    units = chars = 0
    for start in range(0, len(data), PIECE):
        stop = min(start + PIECE, len(data))
        ends = _word_ends(data, start, stop)
        sums = np.cumsum((data[start:stop] & 0xC0) != 0x80)
        own = ends[every - 1 - units % every :: every]
        if len(own):
            at_bytes.append(own)
            at_chars.append(chars + sums[own - start - 1])
            marks.append(np.arange(1, len(own) + 1) * every + units // every * every)
        units, chars = units + len(ends), chars + int(sums[-1])
    if len(data) and _SPACE[data[-1]]:
        units += 1
    return Checkpoints(data, units, chars, *(np.concatenate(x) for x in (marks, at_bytes, at_chars)))


def _hashes(id_col: str, seed: int) -> list[Column]:
    """Four 32-bit numbers from the SHA-256 of the seed and the id."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(told, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80,
    sentinels: tuple[str, str, str] = SENTINELS, every: int = EVERY,
) -> DataFrame:
    """For each row: id_col, n, form, prefix_chars, middle_chars, output.

    n is the number of units; rate the percentage of texts that are transformed, spm_rate that of these that put the
    suffix first. Plain texts have no prefix_chars and middle_chars, and are their own output.
    """
    small_batches(docs.sparkSession)
    h1, h2, h3, h4 = _hashes(id_col, seed)
    form = F.when(h3 % 100 >= rate, PLAIN).when(h4 % 100 < spm_rate, SPM).otherwise(PSM)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    signs = [s.encode() for s in sentinels]
    names = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(k, v) for k, v in names.items()]])

    def one(text: bytes, form: str, h1: int, h2: int) -> tuple[int, str, int | None, int | None, bytes]:
        index = counted(np.frombuffer(text, np.uint8), every)
        n = index.units
        if form == PLAIN or not n or any(s in text for s in signs):
            return n, PLAIN, None, None, text
        (a, first), (b, second) = (index.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, suffix, middle = ((s, text[i:j]) for s, i, j in zip(signs, (0, b, a), (a, len(text), b), strict=True))
        order = (prefix, suffix, middle) if form == PSM else (suffix, prefix, middle)
        return n, form, first, second - first, b"".join(x for part in order for x in part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            n, forms, prefixes, middles, outputs = zip(*found, strict=True) if found else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())],
                names=schema.fieldNames(),
            )

    return rows.mapInArrow(tidy(run), schema)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text behind an output of that form. Parts hold no sentinel, so the sentinels alone tell them apart."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    joined = lambda *order: F.concat(*[F.try_element_at(parts, F.lit(k)) for k in order])
    return F.when(form == PSM, joined(2, 4, 3)).when(form == SPM, joined(3, 4, 2)).otherwise(output)
