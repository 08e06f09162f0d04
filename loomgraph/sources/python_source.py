"""Symbols and calls of Python sources, by the standard library's syntax tree."""

from __future__ import annotations

import ast
import re

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def relative_module(module: str, level: int, file: str) -> str:
    """A module that is imported from ``level`` dots, seen from the file's folder."""
    if not level:
        return module
    folders = [p for p in file.replace("\\", "/").split("/")[:-1] if p not in ("", ".")]
    folders = folders[: max(0, len(folders) - (level - 1))]
    return ".".join([*folders, *([module] if module else [])])


def docstring(node: ast.AST, lines: list[str]) -> str | None:
    """The first string statement of the body, as written between its quotes."""
    for s in node.body:
        if isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str):
            a, b = s.value.lineno - 1, s.value.end_lineno - 1
            raw = [x.encode() for x in lines[a : b + 1]]
            raw[-1] = raw[-1][: s.value.end_col_offset]
            raw[0] = raw[0][s.value.col_offset :]
            return b"".join(raw).decode().strip("'\"")
    return None


def extract_python(text: str, file: str) -> tuple[list[dict], list[dict]]:
    """Functions, classes, their methods (also under if, try, with, for and while), the definitions right inside functions, and imports."""
    lines = text.splitlines(keepends=True)
    symbols: list[dict] = []
    calls: list[dict] = []

    def symbol(node, kind: str, parent: str | None) -> None:
        symbols.append({"type": kind, "name": node.name, "line": node.lineno, "column": node.col_offset, "end_line": node.end_lineno, "docstring": docstring(node, lines), "parent": parent})
        if kind == "function":
            names = {ast.unparse(c.func): None for s in node.body for c in ast.walk(s) if isinstance(c, ast.Call)}
            calls.extend({"caller_type": kind, "caller_line": node.lineno, "caller_name": node.name, "call_text": n} for n in names)

    def imported(node, name: str) -> None:
        symbols.append({"type": "import", "name": name, "line": node.lineno, "column": node.col_offset, "end_line": None, "docstring": None, "parent": None})

    def parts(node) -> list:
        """The statements of a compound statement's blocks."""
        out = []
        for f in ("body", "handlers", "orelse", "finalbody", "cases"):
            out += getattr(node, f, [])
        return out

    def methods(body: list, owner: str) -> None:
        for s in body:
            if isinstance(s, DEFS):
                symbol(s, "function", owner)
            elif not isinstance(s, ast.ClassDef):
                methods(parts(s), owner)

    def walk(body: list, parent: str | None) -> None:
        for s in body:
            if isinstance(s, DEFS):
                symbol(s, "function", parent)
                for inner in s.body:
                    if isinstance(inner, (*DEFS, ast.ClassDef)):
                        symbol(inner, "class" if isinstance(inner, ast.ClassDef) else "function", parent)
            elif isinstance(s, ast.ClassDef):
                symbol(s, "class", parent)
                methods(s.body, s.name)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    imported(s, a.asname or a.name)
            elif isinstance(s, ast.ImportFrom):
                module = relative_module(s.module or "", s.level, file)
                for a in s.names:
                    imported(s, f"{module}.{a.asname or a.name}")
            else:
                walk(parts(s), parent)

    walk(ast.parse(text).body, None)
    return symbols, calls


#: How Python begins a definition: used to find one again that has moved.
DEFINITION = re.compile(r"^\s*(?:async\s+def|def|class)\s+(\w+)")
