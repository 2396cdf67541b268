"""Symbols, calls, routes and complexity of source files, outlines of markdown, and contracts, read from whole files.

A file is one row (path, language, content) and is read in one task; rows of results carry the path. Python is parsed; other
languages are read by patterns of definitions and the nesting of braces, which sees no macros and no generated code.
Null or empty contents, and Python that doesn't parse, have no rows.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SYMBOLS = "path string, name string, kind string, line long, end_line long, parent string"
CALLS = "path string, caller string, callee string, line long"
ROUTES = "path string, method string, route string, handler string, line long"
COMPLEXITY = "path string, branches long, loops long, returns long, max_nesting long, total long"
OUTLINE = "path string, name string, kind string, level long, line long, end_line long, parent string"
CONTRACT = "path string, kind string, name string, parent string"

#: Definitions by language: kind and the pattern whose group is the name.
_DEFINITIONS = {
    "rust": [("function", r"\bfn\s+(\w+)"), ("struct", r"\bstruct\s+(\w+)"), ("enum", r"\benum\s+(\w+)"), ("trait", r"\btrait\s+(\w+)"), ("module", r"\bmod\s+(\w+)\s*\{")],
    "javascript": [("function", r"\bfunction\s*\*?\s*(\w+)"), ("class", r"\bclass\s+(\w+)"), ("function", r"\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^()]*\)\s*=>")],
    "typescript": [("function", r"\bfunction\s*\*?\s*(\w+)"), ("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^()]*\)[^=;]*=>")],
    "go": [("function", r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)"), ("struct", r"\btype\s+(\w+)\s+struct"), ("interface", r"\btype\s+(\w+)\s+interface")],
    "java": [("class", r"\bclass\s+(\w+)"), ("interface", r"\binterface\s+(\w+)"), ("function", r"\b(?:public|private|protected|static)\s[\w<>\[\], ]*?\b(\w+)\s*\([^;{}]*\)[^;{}]*\{")],
}
_NOT_CALLED = {"if", "for", "while", "match", "switch", "return", "fn", "function", "func", "catch", "loop", "else", "sizeof", "new", "await", "typeof"}
_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
_NOISE = re.compile(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\'(?:\\.|[^\'\\\n])\'', re.S)


def _blank(text: str) -> str:
    """The text with strings and comments as spaces, lines kept."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _closing(text: str, at: int) -> int:
    """Where the block that opens at or after ``at`` closes; the statement's end if it has none."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m[0] == ";" and not depth:
            return m.start()
        depth += (m[0] == "{") - (m[0] == "}")
        if not depth and m[0] == "}":
            return m.start()
    return len(text)


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Attribute):
        return node.attr
    return node.id if isinstance(node, ast.Name) else None


def _python(content: str) -> ast.Module | None:
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _python_symbols(content: str) -> Iterator[tuple]:
    todo = [(_python(content), None)]
    while todo:
        node, parent = todo.pop()
        for child in ast.iter_child_nodes(node) if node else ():
            if isinstance(child, (*_DEF, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(node, ast.ClassDef) else "function"
                yield child.name, kind, child.lineno, child.end_lineno, parent
                todo.append((child, child.name))
            else:
                todo.append((child, parent))


def symbols_of(content: str, language: str) -> list[tuple]:
    """(name, kind, line, end_line, parent) in order of line; the parent is the innermost symbol around."""
    if language == "python":
        return sorted(_python_symbols(content), key=lambda s: (s[2], s[0]))
    text, found = _blank(content), {}
    for kind, pattern in _DEFINITIONS.get(language, []):
        for m in re.finditer(pattern, text):
            found.setdefault(m.start(1), (m[1], kind, _closing(text, m.end(1))))
    out, around = [], []
    for at, (name, kind, end) in sorted(found.items()):
        while around and around[-1][1] < at:
            around.pop()
        out.append((name, kind, _line(text, at), _line(text, end), around[-1][0] if around else None))
        around.append((name, end))
    return out


def calls_of(content: str, language: str) -> list[tuple]:
    """(caller, callee, line): the caller is the innermost symbol around, null at the top."""
    spans = [s for s in symbols_of(content, language) if s[1] in ("function", "method")]
    if language == "python":
        sites = [(_dotted(n.func), n.lineno) for n in ast.walk(_python(content) or ast.Module([], [])) if isinstance(n, ast.Call)]
    elif language in _DEFINITIONS:
        text = _blank(content)
        named = {m.start(1) for _, p in _DEFINITIONS[language] for m in re.finditer(p, text)}
        sites = [(m[1], _line(text, m.start())) for m in re.finditer(r"\b([A-Za-z_]\w*)\s*!?\(", text) if m.start(1) not in named and m[1] not in _NOT_CALLED]
    else:
        sites = []
    out = []
    for callee, line in sites:
        if callee:
            over = [(s[3] - s[2], s[0]) for s in spans if s[2] <= line <= s[3]]
            out.append((min(over)[1] if over else None, callee, line))
    return sorted(out, key=lambda c: (c[2], c[1]))


def routes_of(content: str, language: str) -> list[tuple]:
    """(method, route, handler, line) of decorated or attributed handlers and of calls of a router."""
    out, verbs = [], "|".join(_VERBS)
    if language == "python":
        for node in ast.walk(_python(content) or ast.Module([], [])):
            for d in node.decorator_list if isinstance(node, _DEF) else ():
                if isinstance(d, ast.Call) and _dotted(d.func) in (*_VERBS, "route") and d.args and isinstance(d.args[0], ast.Constant):
                    told = [k.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))]
                    methods = [e.value for t in told for e in t.elts if isinstance(e, ast.Constant)] if _dotted(d.func) == "route" else [_dotted(d.func)]
                    out += [(str(m).upper(), str(d.args[0].value), node.name, d.lineno) for m in methods or ["GET"]]
    elif language == "rust":
        for m in re.finditer(rf'#\[({verbs})\("([^"]*)"[^\]]*\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)', content):
            out.append((m[1].upper(), m[2], m[3], _line(content, m.start())))
        for m in re.finditer(rf'\.route\(\s*"([^"]*)"\s*,\s*({verbs})\(\s*([\w:]+)', content):
            out.append((m[2].upper(), m[1], m[3].rsplit("::", 1)[-1], _line(content, m.start())))
    elif language in ("javascript", "typescript"):
        for m in re.finditer(rf"""\b\w+\.({verbs})\(\s*["'`]([^"'`]*)["'`]\s*,\s*(?:\w+\s*,\s*)*([A-Za-z_]\w*)\s*\)""", content):
            out.append((m[1].upper(), m[2], m[3], _line(content, m.start())))
        for m in re.finditer(rf"""@({verbs.title()})\(\s*(?:["'`]([^"'`]*)["'`])?\s*\)\s*(?:(?:public|private|async)\s+)*(\w+)\s*\(""", content):
            out.append((m[1].upper(), m[2] or "", m[3], _line(content, m.start())))
    return sorted(out, key=lambda r: (r[3], r[0]))


def complexity_of(content: str, language: str) -> list[tuple]:
    """(branches, loops, returns, max_nesting, total) of a file; the nesting is of branches and loops, for others than Python of braces."""
    if language == "python":
        tree = _python(content)
        if tree is None:
            return []
        branch, loop = (ast.If, ast.IfExp, ast.Match, ast.Try), (ast.For, ast.AsyncFor, ast.While)
        n, deepest, todo = [0, 0, 0], 0, [(tree, 0)]
        while todo:
            node, depth = todo.pop()
            inner = depth + isinstance(node, branch + loop)
            deepest = max(deepest, inner)
            for k, kinds in enumerate((branch, loop, (ast.Return,))):
                n[k] += isinstance(node, kinds)
            todo += [(c, inner) for c in ast.iter_child_nodes(node)]
        return [(*n, deepest, sum(n))]
    if language not in _DEFINITIONS:
        return []
    text = _blank(content)
    n = [len(re.findall(p, text)) for p in (r"\b(?:if|match|switch)\b", r"\b(?:for|while|loop)\b", r"\breturn\b")]
    depth = deepest = 0
    for c in re.findall(r"[{}]", text):
        depth = max(0, depth + (1 if c == "{" else -1))
        deepest = max(deepest, depth)
    return [(*n, deepest, sum(n))]


def outline_of(content: str, language: str) -> list[tuple]:
    """(name, kind, level, line, end_line, parent) of a markdown's headings, lists and fences.

    A heading's section ends before the next heading of its level or a lesser one; the parent is the heading around.
    """
    if language != "markdown":
        return []
    lines, rows, fence, list_at = content.split("\n"), [], None, None
    for k, line in enumerate([*lines, ""], 1):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})\s*(\S*)", line)
        if fence:
            if mark and mark[1][0] == fence[0][0] and len(mark[1]) >= len(fence[0]) and not mark[2]:
                rows.append((fence[1], "fence", 0, fence[2], k))
                fence = None
            continue
        item = re.match(r"\s*(?:[-*+]|\d+[.)])\s+\S", line)
        if list_at and not item and not re.match(r"\s+\S", line):
            rows.append(("list", "list", 0, list_at, k - 1))
            list_at = None
        heading = re.match(r" {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line)
        if mark:
            fence = (mark[1], mark[2] or "fence", k)
        elif heading:
            rows.append((heading[2], "heading", len(heading[1]), k, None))
        elif item and not list_at:
            list_at = k
    if fence:
        rows.append((fence[1], "fence", 0, fence[2], len(lines)))
    rows.sort(key=lambda r: (r[3], r[1]))
    out, around = [], []
    ends = {}
    for name, kind, level, line, _ in rows:
        if kind == "heading":
            while around and around[-1][0] >= level:
                ends[around.pop()[1]] = line - 1
            around.append((level, line))
    around = []
    for name, kind, level, line, end in rows:
        if kind == "heading":
            while around and around[-1][0] >= level:
                around.pop()
        out.append((name, kind, level, line, ends.get(line, len(lines)) if kind == "heading" else end, around[-1][1] if around else None))
        if kind == "heading":
            around.append((level, name))
    return out


def contract_of(content: str, language: str) -> list[tuple]:
    """(kind, name, parent) of a JSON contract: operations of OpenAPI, channels of AsyncAPI, schemas and their properties."""
    try:
        doc = json.loads(content) if language == "json" else None
    except (ValueError, RecursionError):
        return []
    if not isinstance(doc, dict):
        return []
    of = lambda d, k: d[k] if isinstance(d, dict) and isinstance(d.get(k), dict) else {}
    out = []
    for route, item in of(doc, "paths").items():
        out += [("operation", f"{verb.upper()} {route}", str(op.get("operationId")) if isinstance(op, dict) and op.get("operationId") else None) for verb, op in (item.items() if isinstance(item, dict) else ()) if verb.lower() in _VERBS]
    out += [("channel", name, None) for name in of(doc, "channels")]
    schemas = {**of(doc, "definitions"), **of(doc, "$defs"), **of(of(doc, "components"), "schemas")}
    if "properties" in doc:
        schemas[str(doc.get("title") or "root")] = doc
    for name, schema in schemas.items():
        out.append(("schema", name, None))
        out += [("property", p, name) for p in of(schema, "properties")]
    return out


def _extract(files: DataFrame, schema: str, read: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [c.strip().split(" ") for c in schema.split(",")]
    kinds = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in names])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, language, content in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                rows = [(path, *r) for r in read(content, language or "")] if content else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return files.select("path", "language", files["content"].cast("string").alias("content")).mapInArrow(batches, schema)


def symbols(files: DataFrame) -> DataFrame:
    return _extract(files, SYMBOLS, symbols_of)


def calls(files: DataFrame) -> DataFrame:
    return _extract(files, CALLS, calls_of)


def routes(files: DataFrame) -> DataFrame:
    return _extract(files, ROUTES, routes_of)


def complexity(files: DataFrame) -> DataFrame:
    return _extract(files, COMPLEXITY, complexity_of)


def outline(files: DataFrame) -> DataFrame:
    return _extract(files, OUTLINE, outline_of)


def contracts(files: DataFrame) -> DataFrame:
    return _extract(files, CONTRACT, contract_of)
