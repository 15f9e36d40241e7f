"""Chunks of files: line windows with identities, and parsers that name definitions and references."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import ship

MAX_LINES, OVERLAP = 120, 10
FALLBACK_CONFIDENCE = 0.35


def line_windows(files: DataFrame, id_col: str, path_col: str, text_col: str, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, path, part, start_line, end_line, content, content_hash, chunk_fingerprint): windows that overlap.

    A window starts every max_lines - overlap lines until one reaches the last line. A text without lines has none.
    """
    step = max_lines - overlap
    whole = F.when(F.col(text_col) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text_col, r"\n\z", ""), "\n", -1))
    rows = files.select(F.col(id_col), F.col(path_col).alias("path"), whole.alias("lines")).where(F.size("lines") > 0)
    last = F.greatest(F.size("lines") - overlap - 1, F.lit(0))
    rows = rows.select(id_col, "path", "lines", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("at", "offset"))
    rows = rows.select(
        id_col, "path", (F.col("at") + 1).alias("part"), (F.col("offset") + 1).alias("start_line"), F.least(F.col("offset") + max_lines, F.size("lines")).alias("end_line"),
        F.array_join(F.slice("lines", F.col("offset") + 1, F.lit(max_lines)), "\n").alias("content"),
    )
    rows = rows.withColumn("content_hash", text.content_hash(F.col("content")))
    identity = F.concat(F.lit("<fallback:"), F.col("start_line"), F.lit(">"))
    return rows.withColumn("chunk_fingerprint", text.chunk_fingerprint(F.col("path"), identity, F.col("start_line"), F.col("end_line"), F.col("content_hash")))


CHUNK = (
    "file_id long, path string, language string, kind string, symbol_type string, symbol_name string, qualified_name string, parent_symbol string, signature string, "
    "start_line int, end_line int, split_part int, content string, imports array<string>, source string, target string, relation string, confidence double, error string"
)
FIELDS = [f.split()[0] for f in CHUNK.split(", ")]
Row = dict


def _windows(lines: list[str], max_lines: int, overlap: int) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(lines):
        yield at, min(at + max_lines, len(lines))
        if at + max_lines >= len(lines):
            return
        at += max_lines - overlap


class _PythonParser:
    """Definitions and references of Python source by the standard library's syntax tree."""

    language = "python"
    extensions = (".py", ".pyi")
    _line = re.compile(r"(.*?(?:\r\n|\n|\r|$))", re.S)
    #: Nodes that hold neither definitions nor references.
    _leaves = (ast.expr_context, ast.Name, ast.Constant, ast.operator, ast.alias)

    def read(self, source: str) -> tuple[list[Row], list[Row], list[str]]:
        tree = ast.parse(source)
        lines = source.splitlines()
        found: list[Row] = []
        refs: list[tuple[str, str, str, float]] = []
        imports: list[str] = []
        split = self._line.findall(source)

        def segment(node: ast.AST) -> str:
            """The text of a node, whose columns count bytes; the lines are split once."""
            first, last = node.lineno - 1, node.end_lineno - 1
            if first == last:
                return split[first].encode()[node.col_offset : node.end_col_offset].decode()
            return "".join([split[first].encode()[node.col_offset :].decode(), *split[first + 1 : last], split[last].encode()[: node.end_col_offset].decode()])

        def visit(node: ast.AST, owner: Row | None) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, self._leaves):
                    continue
                inner = owner
                if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                    is_class = isinstance(child, ast.ClassDef)
                    qualified = f"{owner['qualified_name']}.{child.name}" if owner else child.name
                    kind = "class" if is_class else "method" if owner and owner["symbol_type"] == "class" else "function"
                    body = child.body[0]
                    head = "\n".join(lines[child.lineno - 1 : body.lineno]) if body.lineno == child.lineno else "\n".join(lines[child.lineno - 1 : body.lineno - 1])
                    inner = dict(
                        symbol_type=kind, symbol_name=child.name, qualified_name=qualified, parent_symbol=owner and owner["qualified_name"], start_line=child.lineno,
                        end_line=child.end_lineno, signature=head.split(":\n")[0].strip().removesuffix(":").strip(), content=segment(child),
                    )
                    found.append(inner)
                    if is_class:
                        refs.extend((qualified, segment(b), "extend", 0.8) for b in child.bases)
                elif isinstance(child, ast.Import | ast.ImportFrom):
                    imports.append(segment(child))
                    names = [a.name for a in child.names] if isinstance(child, ast.Import) else [f"{'.' * child.level}{child.module or ''}"]
                    refs.extend(("<module>", n, "import", 0.95) for n in names)
                elif isinstance(child, ast.Call) and owner:
                    refs.append((owner["qualified_name"], segment(child.func), "call", 0.75))
                visit(child, inner)

        visit(tree, None)
        return found, [dict(source=s, target=t, relation=r, confidence=c) for s, t, r, c in dict.fromkeys(refs)], list(dict.fromkeys(imports))


class _JavaParser:
    """Definitions and references of Java source by a tokenizer that matches braces.

    What encloses what is found by one sweep with a stack, because declarations nest as braces do; the time follows the
    length of a file. A comment or text block without an end is an error of the file.
    """

    language = "java"
    extensions = (".java",)
    _skip = re.compile(r'//[^\n]*|/\*(?:.*?\*/|.*)|"""(?:(?:\\.|[^\\])*?"""|.*)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
    _type = re.compile(r"\b(class|interface|enum|record|@interface)\s+(\w+)")
    _modifiers = re.compile(r"(?:@\w+(?:\([^)]*\))?\s*|\b(?:public|protected|private|static|final|abstract|sealed|strictfp)\b\s*)+")
    _head = re.compile(r"\b(\w+)\s*\([^(){};]*\)\s*(?:throws\s+[\w.,\s]+)?(\{|;)")
    #: What stands in no modifier, type or annotation before a method's name.
    _stop = re.compile(r"[^\w@<>\[\],.?&\s]")
    _space = re.compile(r"\s")
    #: A chain of names is taken whole, so that it is read once whether or not it is a call.
    _call = re.compile(r"\b((?:\w+\s*\.\s*)*\w+)\s*(\(?)")
    _no_name = frozenset("if for while switch catch synchronized return new throw else do try super this assert".split())

    def _blanked(self, m: re.Match) -> str:
        piece = m.group()
        if piece.startswith("/*") and (len(piece) < 4 or not piece.endswith("*/")) or piece.startswith('"""') and (len(piece) < 6 or not piece.endswith('"""')):
            raise SyntaxError("a comment or text block is not closed")
        return re.sub(r"[^\n]", " ", piece)

    def read(self, source: str) -> tuple[list[Row], list[Row], list[str]]:
        blank = self._skip.sub(self._blanked, source)
        close, stack, braces, depths = {}, [], [], [0]
        for m in re.finditer(r"[{}]", blank):
            braces.append(m.start())
            if m.group() == "{":
                stack.append(m.start())
            elif not stack:
                raise SyntaxError("a brace too many")
            else:
                close[stack.pop()] = m.start()
            depths.append(len(stack))
        if stack:
            raise SyntaxError("a brace is not closed")
        depth = lambda at: depths[bisect_left(braces, at)]
        breaks = [m.start() for m in re.finditer("\n", source)]
        line = lambda at: bisect_left(breaks, at) + 1
        ends = [m.start() for m in re.finditer(r"[;{}]", blank)]
        heads = [at for at in ends if blank[at] != "}"]
        items: list[tuple[int, int, str, str, str, str]] = []
        past = 0
        for m in self._type.finditer(blank):
            k = bisect_left(heads, m.end())
            if m.start() < past or k == len(heads) or blank[heads[k]] == ";":
                continue
            head, body = m.start(), heads[k]
            past = body + 1
            after = ends[k - 1] + 1 if (k := bisect_left(ends, head)) else 0
            start = next((w.start() for w in self._modifiers.finditer(blank, after, head) if w.end() == head), head)
            items.append((start, close[body], {"@interface": "annotation"}.get(m.group(1), m.group(1)), m.group(2), source[start:body].strip(), blank[m.end() : body]))
        kinds, stack, next_kind = sorted(items), [], 0
        stops, past = [m.start() for m in self._stop.finditer(blank)], 0
        for m in self._head.finditer(blank):
            name, at = m.group(1), m.start(1)
            while next_kind < len(kinds) and kinds[next_kind][0] < at:
                while stack and stack[-1][1] <= kinds[next_kind][0]:
                    stack.pop()
                stack.append(kinds[next_kind])
                next_kind += 1
            while stack and stack[-1][1] <= at:
                stack.pop()
            owner = stack[-1] if stack else None
            stop = stops[k - 1] if (k := bisect_left(stops, at)) else -1
            begin = max(stop + 1, past)  # what an earlier declaration took is no part of this one
            if begin < at and stop >= past and blank[stop] not in ";{}":
                begin = space.end() if (space := self._space.search(blank, begin, at)) else at
            lead = blank[begin:at]
            if lead and not lead[-1].isspace() or not lead and at and blank[at - 1] not in ";{}" and not blank[at - 1].isspace():
                continue
            past, words = m.end(), lead.split()
            if not owner or name in self._no_name or (not words and name != owner[3]) or set(words) & {"new", "return", "throw", "else"}:
                continue
            if depth(at) - depth(owner[0]) != 1:
                continue
            start = begin + len(lead) - len(lead.lstrip()) if words else at
            end = close[m.end() - 1] if m.group(2) == "{" else m.end() - 1
            items.append((start, end, "constructor" if name == owner[3] else "method", name, source[start : m.end() - 1].strip(), ""))
        items.sort(key=lambda i: (i[0], -i[1]))
        found, refs, outer = [], [], []
        for k, (start, end, kind, name, signature, heritage) in enumerate(items):
            while outer and items[outer[-1]][1] < end:
                outer.pop()
            parent = found[outer[-1]]["qualified_name"] if outer else None
            outer.append(k)
            qualified = f"{parent}.{name}" if parent else name
            found.append(dict(symbol_type=kind, symbol_name=name, qualified_name=qualified, parent_symbol=parent, start_line=line(start), end_line=line(end), signature=signature, content=source[start : end + 1]))
            for word, names in re.findall(r"\b(extends|implements)\s+([\w.<>,\s?&]+?)(?=\bextends\b|\bimplements\b|\bpermits\b|\Z)", heritage):
                refs += [(qualified, n.strip(), "extend" if word == "extends" else "implement", 0.85) for n in re.sub(r"<[^<>]*>", "", names).split(",") if n.strip()]
        bodies = [(body, i[1], k) for k, i in enumerate(items) if i[2] in ("method", "constructor") and (body := blank.find("{", i[0], i[1])) >= 0]
        inside, next_body = [], 0
        for m in self._call.finditer(blank):
            at = m.start()
            while next_body < len(bodies) and bodies[next_body][0] < at:
                while inside and inside[-1][1] <= bodies[next_body][0]:
                    inside.pop()
                inside.append(bodies[next_body])
                next_body += 1
            while inside and inside[-1][1] <= at:
                inside.pop()
            if not inside or not m.group(2):
                continue
            target = re.sub(r"\s", "", m.group(1))
            if target.split(".")[-1] not in self._no_name and not re.search(r"\bnew\s+\Z", blank[max(0, at - 8) : at]):
                refs.append((found[inside[-1][2]]["qualified_name"], target, "call", 0.75))
        imports = [m.group(1) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", blank, re.M)]
        refs = [("<compilation_unit>", i, "import", 0.95) for i in imports] + refs
        return found, [dict(source=s, target=t, relation=r, confidence=c) for s, t, r, c in dict.fromkeys(refs)], list(dict.fromkeys(imports))


#: Parsers by language; detect() resolves a path by extension first.
PARSERS: dict[str, object] = {"python": _PythonParser(), "java": _JavaParser()}
#: What a reviewer looks for in each language (fixed values).
RISK_HINTS = {
    "java": ["Runtime.exec", "ProcessBuilder", "Statement.execute", "ObjectInputStream", "SpelExpressionParser"],
    "python": ["eval", "exec", "pickle.loads", "subprocess", "shell=True", "yaml.load"],
}


def risk_hints(language: Column) -> Column:
    """The hints of a language, an empty list for others."""
    hints = F.create_map(*[x for name, words in RISK_HINTS.items() for x in (F.lit(name), F.array(*[F.lit(w) for w in words]))])
    return F.coalesce(F.try_element_at(hints, language), F.array().cast("array<string>"))


def detect(path: str) -> str | None:
    end = PurePosixPath(path).suffix.casefold()
    return next((name for name, p in PARSERS.items() if end in p.extensions), None)


@lru_cache(maxsize=1)
def _read(language: str, source: str) -> tuple[list[Row], list[Row], list[str]]:
    """What a parser reads; a text whose language was found by reading it is not read again."""
    return PARSERS[language].read(source)


def resolve(path: str, source: str) -> str | None:
    """The language of a file: by its extension, else the first whose parser finds definitions in its text."""
    if found := detect(path):
        return found
    for name in PARSERS:
        try:
            if _read(name, source)[0]:
                return name
        except (SyntaxError, ValueError, RecursionError, KeyError, MemoryError):
            continue
    return None


def parse_source(path: str, language: str, source: str, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> list[Row]:
    """Chunk and reference rows of one file; a file that does not parse falls back to line windows."""
    base = dict.fromkeys(FIELDS) | {"path": path, "language": language}
    try:
        found, refs, imports = _read(language, source)
    except (SyntaxError, ValueError, RecursionError, KeyError, MemoryError):  # the last when the parser's own stack is full
        error = "SYNTAX_ERROR" if language in PARSERS else "NO_PARSER"
        lines = source.splitlines(keepends=True)
        if not lines:
            return [base | {"kind": "error", "error": "EMPTY_SOURCE", "confidence": FALLBACK_CONFIDENCE}]
        return [
            base | {"kind": "chunk", "symbol_type": "line_window", "symbol_name": f"<fallback:{a + 1}>", "start_line": a + 1, "end_line": b, "content": "".join(lines[a:b]), "confidence": FALLBACK_CONFIDENCE, "error": error}
            for a, b in _windows(lines, max_lines, overlap)
        ]
    rows = []
    for d in found:
        if d["end_line"] - d["start_line"] + 1 <= max_lines:
            rows.append(base | d | {"kind": "chunk", "imports": imports, "confidence": 1.0})
            continue
        lines = d["content"].splitlines(keepends=True)
        for part, (a, b) in enumerate(_windows(lines, max_lines, overlap), 1):
            rows.append(base | d | {"kind": "chunk", "imports": imports, "confidence": 1.0, "split_part": part, "content": "".join(lines[a:b]), "start_line": d["start_line"] + a, "end_line": d["start_line"] + b - 1})
    if not found and source.strip():
        rows.append(base | {"kind": "chunk", "symbol_type": "module", "symbol_name": PurePosixPath(path).stem, "start_line": 1, "end_line": max(1, len(source.splitlines())), "content": source, "imports": imports, "confidence": 1.0})
    return rows + [base | r | {"kind": "reference"} for r in refs]


#: Characters of rows, 500 for each beside its content, that parsed() holds before it hands them on.
HANDED_ON = 2 << 20


def parsed(files: DataFrame, parse: Callable[[str, str, str], list[Row]] = parse_source) -> DataFrame:
    """Chunk and reference rows of files (file_id, path, language, text), with content hashes and fingerprints."""
    import pyarrow as pa
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CHUNK.split(", "))])
        for batch in batches:
            rows, size = [], 0
            for n in range(batch.num_rows):  # one file at a time, and what it gives is handed on by rows and bytes
                i, p, l, t = (c[n].as_py() for c in batch.columns)
                for r in parse(p, l, t or ""):
                    rows.append(r | {"file_id": i})
                    size += len(r["content"] or "") + 500
                    if size > HANDED_ON:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = files.select("file_id", "path", "language", "text").mapInArrow(run, CHUNK)
    hashed = F.when(F.col("kind") == "chunk", text.content_hash(F.col("content")))
    identity = F.when(F.col("symbol_type") == "module", "<module>").otherwise(F.coalesce("qualified_name", "symbol_name"))
    return out.withColumn("content_hash", hashed).withColumn("chunk_fingerprint", F.when(F.col("kind") == "chunk", text.chunk_fingerprint(F.col("path"), identity, F.col("start_line"), F.col("end_line"), F.col("content_hash"))))


#: What the table function gives: the columns of parsed() without those of the file.
PARSED = ", ".join(f for f in CHUNK.split(", ") if f.split()[0] not in ("file_id", "path"))


class ParseSource:
    """A table function for SQL: the chunks and references of one file, LATERAL parse_source(path, text).

    A null text is empty; a file of no known language is cut into line windows.
    """

    def eval(self, path: str, source: str) -> Iterator[tuple]:
        path, source = path or "", source or ""
        for row in parse_source(path, resolve(path, source) or "", source):
            yield tuple(row[f.split()[0]] for f in PARSED.split(", "))


def register(spark: SparkSession, name: str = "parse_source") -> None:
    """Makes the parsers a table function of the session's SQL."""
    ship(spark)
    spark.udtf.register(name, F.udtf(ParseSource, returnType=PARSED, useArrow=True))


def symbols_of(chunks: DataFrame) -> DataFrame:
    """One symbol for each named chunk, first part only, with its hash."""
    named = chunks.where("kind = 'chunk' and symbol_name is not null and coalesce(split_part, 1) = 1")
    name = F.coalesce("qualified_name", "symbol_name")
    return named.select("file_id", "path", "symbol_type", "symbol_name", "qualified_name", "start_line", "end_line", text.symbol_hash(F.col("path"), name, F.col("start_line"), F.col("end_line")).alias("symbol_hash"))
