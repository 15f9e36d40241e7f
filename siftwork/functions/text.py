"""Column expressions over text: identifiers, search text, hashes, line counts, token estimates, JSON in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as white space when lines and texts are trimmed (fixed values: Unicode White_Space and the separators).
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Line breaks of a source file as the scanner counts them (fixed values).
BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
#: Where an identifier parts into words, and what is no part of a word (fixed values).
ACRONYM, CAMEL, SEPARATORS = r"([A-Z]+)([A-Z][a-z])", r"([a-z0-9])([A-Z])", r"[^A-Za-z0-9]+"


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def split_identifier(name: Column) -> Column:
    """Lower-case words of an identifier: acronyms, camel case and punctuation all part words."""
    spaced = F.regexp_replace(F.regexp_replace(name, ACRONYM, "$1 $2"), CAMEL, "$1 $2")
    return F.lower(F.trim(F.regexp_replace(spaced, SEPARATORS, " ")))


def search_text(originals: list[Column], content: Column) -> Column:
    """Originals that are not empty, a line of words for each (empty for one without words), then the content."""
    given = F.filter(F.array(*originals), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.concat(given, F.transform(given, split_identifier), F.array(content)), "\n")


def normalize_content(content: Column) -> Column:
    """Line feeds only, no white space at line ends or at either end of the text."""
    lines = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return strip(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, rf"{SPACE}+\z", "")), "\n"))


def content_hash(content: Column) -> Column:
    """SHA-256 of the normalized content."""
    return F.sha2(normalize_content(content).cast("binary"), 256)


def joined_hash(*parts: Column, by: str = "\x00") -> Column:
    """SHA-256 of the parts' texts with by between them; no part may be null."""
    return F.sha2(F.concat_ws(by, *[p.cast("string") for p in parts]).cast("binary"), 256)


def chunk_fingerprint(path: Column, identity: Column, start: Column, end: Column, hashed: Column) -> Column:
    return joined_hash(path, identity, start, end, hashed)


def symbol_hash(path: Column, name: Column, start: Column, end: Column) -> Column:
    return joined_hash(path, name, start, end)


def issue_fingerprint(path: Column, start: Column, end: Column, rule: Column, evidence: Column) -> Column:
    return joined_hash(F.replace(path, F.lit("\\"), F.lit("/")), start, end, rule, F.sha2(evidence.cast("binary"), 256))


def run_key(node: Column, index: Column, round_: Column, retry: Column, calls: Column) -> Column:
    return joined_hash(node, index, round_, retry, calls, by=":")


def query_hash(query: Column) -> Column:
    """SHA-256 of the trimmed query."""
    return F.sha2(strip(query).cast("binary"), 256)


def query_preview(query: Column) -> Column:
    return F.substring(strip(query), 1, 256)


def occurrence_rank(text: Column, term: Column) -> Column:
    """How often term stands in text, in hundredths."""
    gone = F.char_length(text) - F.char_length(F.replace(text, term, F.lit("")))
    return gone.cast("double") / F.char_length(term) / 100


def token_estimate(text: Column) -> Column:
    """A quarter of the ASCII characters, rounded up, and all others; 1 at least."""
    ascii_chars = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.greatest(F.lit(1), (F.ceil(ascii_chars / 4) + F.char_length(text) - ascii_chars)).cast("long")


def token_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def lines_scanned(text: Column) -> Column:
    """Line count of the scan: every kind of line break ends a line, a last line without one counts."""
    parts = F.regexp_count(text, F.lit(BREAK))
    return (parts + F.when((text == "") | text.rlike(rf"(?:{BREAK})\z"), 0).otherwise(1)).cast("long")


def lines_cited(text: Column) -> Column:
    """Line count of the evidence check: line feeds, and one more for a text that is not empty."""
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when(text != "", 1).otherwise(0)).cast("long")


def evidence_text(text: Column) -> Column:
    """Line feeds only, and no white space at either end."""
    return strip(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8, with or without its mark; null where the bytes are not UTF-8."""
    text = F.when(F.is_valid_utf8(content), content.cast("string"))
    return F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def json_in(text: Column) -> Column:
    """JSON out of free text: a block fenced as json, else the outermost braces or brackets, else the text itself, trimmed."""
    fence, braces, brackets = r"(?s)```json[^\n]*\n(.*?)```", r"(?s)\{.*\}", r"(?s)\[.*\]"
    cut = F.when(text.rlike(braces), F.regexp_extract(text, braces, 0)).when(text.rlike(brackets), F.regexp_extract(text, brackets, 0)).otherwise(strip(text))
    return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(cut)


def parsed_json(text: Column, schema: T.StructType, required: list[str]) -> Column:
    """The struct of a JSON text; null if it does not parse or lacks a required field."""
    value = F.from_json(json_in(text), schema, {"mode": "PERMISSIVE"})
    complete = F.lit(True)
    for name in required:
        complete = complete & value[name].isNotNull()
    return F.when(complete, value)


def normalize_query(query: Column, language: Column) -> Column:
    """Member separators as dots: # in Java, :: in Python."""
    return F.when(language == "java", F.replace(query, F.lit("#"), F.lit("."))).when(language == "python", F.replace(query, F.lit("::"), F.lit("."))).otherwise(query)


def rewritten_query(keywords: Column, risk_focus: Column, feedback: Column) -> Column:
    """Keywords and focus words in one line, then a line of feedback each."""
    line = F.array_join(F.filter(F.concat(keywords, risk_focus), lambda x: x != ""), " ")
    return F.array_join(F.concat(F.array(line), F.filter(feedback, lambda x: x != "")), "\n")
