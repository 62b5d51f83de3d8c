"""Table functions from a file to its symbols or sections. A file is parsed whole within one row of a batch; files are spread over tasks."""

from __future__ import annotations

import ast
import hashlib
import re
import textwrap
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docwarden.operators.batches import appended

CODE = "repo_id long, file_path string, symbol_name string, symbol_type string, start_line int, end_line int, source_text string, docstring string, ast_hash string, parse_error boolean"
DOCS = "repo_id long, file_path string, heading string, heading_level int, text string, code_blocks array<string>, start_line int, end_line int"


def code_chunks(source: str) -> tuple[list[tuple], bool]:
    """(name, type, start, end, source, docstring, hash) of every function and class at any depth, in order; and whether the text can't be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], True
    lines, seen, out = source.split("\n"), Counter(), []

    def visit(node: ast.AST, parent: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                visit(child, parent, in_class)
                continue
            name = f"{parent}.{child.name}" if parent else child.name
            seen[name] += 1
            is_class = isinstance(child, ast.ClassDef)
            kind = "class" if is_class else ("async_" if isinstance(child, ast.AsyncFunctionDef) else "") + ("method" if in_class else "function")
            start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
            digest = hashlib.sha256(ast.dump(child).encode()).hexdigest()
            out.append((name if seen[name] == 1 else f"{name}#{seen[name]}", kind, start, child.end_lineno, "\n".join(lines[start - 1 : child.end_lineno]), ast.get_docstring(child), digest))
            visit(child, name, is_class)

    try:
        visit(tree, "", False)
    except (RecursionError, MemoryError):  # deeper than the parser's own limit
        return [], True
    return out, False


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDER = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_ITEM = re.compile(r"^( {0,3}(?:[-+*]|\d{1,9}[.)]))( {1,4}(?! )| {1}(?= )|$)")
_RULE = re.compile(r"^ {0,3}(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")


class _Sections:
    """Collects a document's sections under a stack of headings."""

    def __init__(self, path: str):
        self.stack: list[tuple[int, str]] = []
        self.out: list[tuple] = []
        self.path, self.level, self.start, self.text, self.code = f"{path} (preamble)", 0, 1, [], []

    def close(self, end: int) -> None:
        text = "\n".join(self.text).strip()
        if self.level or text or self.code:
            self.out.append((self.path, self.level, text, self.code, self.start, end))

    def heading(self, level: int, title: str, first: int, last: int) -> None:
        self.close(first - 1)
        while self.stack and self.stack[-1][0] >= level:
            self.stack.pop()
        self.stack.append((level, title))
        self.path, self.level, self.start, self.text, self.code = " > ".join(t for _, t in self.stack), level, last + 1, [], []


def _open_containers(line: str, held: list[int]) -> tuple[str, list[int], bool]:
    """What a line holds within its block quotes (0) and list items (their indents), the containers that it is in, and whether it opened one.

    A blank line stays in list items, and leaves quotes."""
    line, now, k = line.expandtabs(4), [], 0
    while k < len(held):
        if held[k] == 0 and (m := _QUOTE.match(line)):
            line = line[m.end() :]
        elif held[k] and (not line.strip() or line.startswith(" " * held[k])):
            line = line[held[k] :]
        else:
            break
        now.append(held[k])
        k += 1
    opened = False
    while True:
        if m := _QUOTE.match(line):
            line, now, opened = line[m.end() :], [*now, 0], True
        elif not _RULE.match(line) and (m := _ITEM.match(line)):
            line, now, opened = line[m.end() :], [*now, m.end()], True
        else:
            return line, now, opened


def markdown_chunks(text: str, path: str) -> list[tuple]:
    """(heading path, level, text, code blocks, start, end) of each section, headings in block quotes and list items included.

    Fenced code is kept apart; a fence ends with its mark, its container or the text. A setext title may have several lines."""
    lines = text.splitlines()
    n, s = len(lines), _Sections(path)
    i, held, para = 0, [], []  # para: lines of the open paragraph, as they stand in their containers
    while i < n:
        inner, now, opened = _open_containers(lines[i], held)
        if para and not opened and inner.strip() and len(now) < len(held) and not (_FENCE.match(inner) or _ATX.match(inner) or _RULE.match(inner) or _UNDER.match(inner)):
            now = held  # a paragraph goes on without its containers' marks
        if now != held or opened:
            para = []
        held = now
        fence, atx = _FENCE.match(inner), _ATX.match(inner)
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            mark, info, j, body = fence[1], fence[2].strip(), i + 1, []
            close = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$")
            indent = len(inner) - len(inner.lstrip(" "))
            while j < n:
                row, within = _contained(lines[j], held)
                if not within:
                    j -= 1
                    break
                if close.match(row):
                    break
                body.append(row[min(indent, len(row) - len(row.lstrip(" "))) :])
                j += 1
            s.code.append((f"# lang: {info}\n" if info else "") + "".join(f"{x}\n" for x in body))
            i, para = j + 1, []
        elif atx:
            s.heading(len(atx[1]), (atx[2] or "").strip(), i + 1, i + 1)
            i, para = i + 1, []
        elif para and (under := _UNDER.match(inner)):
            first = i - len(para)
            s.text = s.text[: len(s.text) - len(para)]
            s.heading(1 if "=" in under[1] else 2, "\n".join(x.strip() for x in para), first + 1, i + 1)
            i, para = i + 1, []
        else:
            is_code = inner.startswith("    ") and not para
            para = [*para, inner] if inner.strip() and not is_code and not _RULE.match(inner) else []
            s.text.append(lines[i])
            i += 1
    s.close(n)
    return s.out


def _contained(line: str, held: list[int]) -> tuple[str, bool]:
    """A line of a fence within its containers, and whether it still is in all of them."""
    if not held:
        return line, True
    line = line.expandtabs(4)
    for k in held:
        if k == 0 and (m := _QUOTE.match(line)):
            line = line[m.end() :]
        elif k and (not line.strip() or line.startswith(" " * k)):
            line = line[k:]
        else:
            return line, False
    return line, True


def rst_chunks(text: str, path: str) -> list[tuple]:
    """Sections by underlines at least as long as their titles; levels by first appearance of the underline's sign."""
    lines = text.split("\n")
    n = len(lines) - (lines[-1] == "")
    s, levels, i = _Sections(path), {}, 0
    rule = re.compile(r"^([=~\-^\"'`:.*+#])\1*\s*$")
    while i < n:
        under = rule.match(lines[i + 1]) if i + 1 < n and lines[i].strip() and not rule.match(lines[i]) else None
        if under and len(lines[i + 1].rstrip()) >= len(lines[i].strip()):
            s.heading(levels.setdefault(under[1], len(levels) + 1), lines[i].strip(), i + 1, i + 2)
            i += 2
        else:
            s.text.append(lines[i])
            i += 1
    s.close(n)
    return s.out


def chunk_code(files: DataFrame) -> DataFrame:
    """files: (repo_id, file_path, text). A file that can't be parsed gives one row with parse_error and no symbol."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            rows = []
            for repo, path, text in zip(got.repo_id, got.file_path, got.text.fillna("")):
                found, bad = code_chunks(text)
                rows += [(repo, path, *x, False) for x in found] or ([(repo, path, None, None, None, None, None, None, None, True)] if bad else [])
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CODE.split(", ")])

    return files.select("repo_id", "file_path", "text").mapInPandas(run, CODE)


def chunk_docs(files: DataFrame) -> DataFrame:
    """files: (repo_id, file_path, text); .rst by underlines, all else as Markdown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for got in batches:
            rows = []
            for repo, path, text in zip(got.repo_id, got.file_path, got.text.fillna("")):
                rows += [(repo, path, *x) for x in (rst_chunks if path.lower().endswith(".rst") else markdown_chunks)(text, path)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in DOCS.split(", ")])

    return files.select("repo_id", "file_path", "text").mapInPandas(run, DOCS)


RESOLVED = "struct<resolution_method:string,parameters:array<struct<name:string,kind:string,has_default:boolean,default_repr:string,is_literal:boolean>>,return_annotation:string>"


def resolved(source: str | None) -> dict:
    """Parameters and return annotation of a symbol's own source; a class stands for its __init__."""
    failed = {"resolution_method": "failed", "parameters": None, "return_annotation": None}
    try:
        node = ast.parse(textwrap.dedent(source or "")).body[0]
    except (SyntaxError, ValueError, IndexError, RecursionError, MemoryError):
        return failed
    if isinstance(node, ast.ClassDef):
        node = next((x for x in node.body if isinstance(x, ast.FunctionDef) and x.name == "__init__"), None)
    if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return failed
    a = node.args
    kinds = [(x, "POSITIONAL_ONLY") for x in a.posonlyargs] + [(x, "POSITIONAL_OR_KEYWORD") for x in a.args]
    given: list = [None] * (len(kinds) - len(a.defaults)) + list(a.defaults)
    both = [(x.arg, kind, d) for (x, kind), d in zip(kinds, given)]
    both += [(a.vararg.arg, "VAR_POSITIONAL", None)] if a.vararg else []
    both += [(x.arg, "KEYWORD_ONLY", d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    both += [(a.kwarg.arg, "VAR_KEYWORD", None)] if a.kwarg else []
    params = []
    for name, kind, default in both:
        text, literal = None, default is not None
        if default is not None:
            try:
                text = repr(ast.literal_eval(default))
            except (ValueError, TypeError, SyntaxError):
                text, literal = ast.unparse(default), False
        params.append({"name": name, "kind": kind, "has_default": default is not None, "default_repr": text, "is_literal": literal})
    if params and params[0]["name"] in ("self", "cls"):
        params = params[1:]
    return {"resolution_method": "static", "parameters": params, "return_annotation": ast.unparse(node.returns) if node.returns else None}


def resolve_symbols(chunks: DataFrame) -> DataFrame:
    """chunks with a column `resolved`; symbols are read, never imported or run."""
    return appended(chunks, "resolved", RESOLVED, lambda columns: [resolved(x) for x in columns["source_text"]], ["source_text"])
