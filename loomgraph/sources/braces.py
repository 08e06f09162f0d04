"""Symbols and calls of TypeScript, Go, Rust, Java and C#, by descent over their tokens.

Each language has a reader that goes through declarations and passes over everything else by its brackets. What is found
follows one rule for all: functions, classes (structures, enumerations and records too), interfaces, types and imports;
bodies of functions are searched for calls, and in TypeScript alone for more declarations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .tokens import MARK, NAME, NUMBER, STRING, Tokens

#: Words that a parenthesis may follow without a call, in all of the languages and in some.
_WORDS = frozenset("if for while switch catch return function new throw else do try await case super yield".split())
_OWN_WORDS = {
    "typescript": frozenset(("typeof", "of", "in", "as", "void", "delete", "instanceof", "constructor")), "go": frozenset(("func", "go", "defer", "select", "range", "chan", "map", "struct", "interface")),
    "rust": frozenset(("fn", "match", "in", "as", "loop", "move", "let", "mut", "ref", "impl", "dyn", "where", "pub", "unsafe")), "java": frozenset(("synchronized", "assert", "this", "instanceof")),
    "csharp": frozenset(("using", "lock", "in", "is", "as", "not", "and", "or", "foreach", "sizeof", "typeof", "base", "this", "when", "checked", "unchecked", "fixed", "default", "stackalloc", "out", "ref", "var")),
}
_MODIFIERS = {
    "typescript": frozenset("public private protected static readonly abstract override async declare accessor get set".split()),
    "java": frozenset("public private protected static final abstract sealed synchronized native default strictfp transient volatile".split()),
    "csharp": frozenset("public private protected internal static abstract sealed partial readonly virtual override async extern unsafe new required volatile file const event".split()),
}
_JOINS = (".", "::", "?.")


def extract_braces(text: str, file: str, language: str) -> tuple[list[dict], list[dict]]:
    """(symbols, calls) of a source; see files.extract_source. Code that a reader can't follow is passed over, up to the next declaration it knows."""
    t = Tokens(text, language, markup=not file.lower().endswith((".ts", ".mts", ".cts")))
    reader = READERS[language](t, file)
    symbols: list[dict] = []
    calls: list[dict] = []
    for d in reader.declarations():
        at, end = t.start[d["from"]] if d["from"] < len(t) else len(text), d.get("to")
        line = t.line(at)
        last = None if d["type"] == "import" else t.line(t.end[min(end, len(t) - 1)] - 1) if end is not None else line
        symbols.append({"type": d["type"], "name": d["name"], "line": d.get("line", line), "column": t.column(at), "end_line": last, "docstring": d.get("doc") or None, "parent": d.get("parent")})
        if d["type"] == "function" and d.get("body"):
            calls += [{"caller_type": "function", "caller_line": line, "caller_name": d["name"], "call_text": n} for n in dict.fromkeys(calls_in(t, *d["body"]))]
    symbols.sort(key=lambda s: (s["line"], s["column"]))
    return symbols, calls


def calls_in(t: Tokens, i: int, j: int) -> Iterator[str]:
    """What is called between two tokens: names joined by dots as far as the callee is such. A Java call is known by its last name alone.

    Constructions, declarations and patterns are no calls; the arguments of a Rust macro are no code.
    """
    words = _WORDS | _OWN_WORDS[t.language]
    k, j = i, min(j, len(t))
    while k < j:
        if t.language == "rust" and t.text[k] == "!" and k + 1 < j and t.text[k + 1] in ("(", "[", "{") and t.kind[k - 1] == NAME and t.text[k - 1] not in words:
            k = t.after(k + 1)
            continue
        if t.kind[k] == MARK and t.text[k] == "(" and k > i and (name := _callee(t, i, k, words)):
            yield name
        elif t.language == "typescript" and t.kind[k] == STRING and t.text[k][:1] == "`" and k > i and t.kind[k - 1] == NAME and t.text[k - 1] not in words and t.end[k - 1] == t.start[k]:
            yield _chain(t, i, k - 1)[1]  # a tagged template
        k += 1


def _chain(t: Tokens, i: int, k: int) -> tuple[int, str]:
    """(first token, text) of the names that are joined up to a name."""
    first, parts = k, [t.text[k]]
    while first - 2 >= i and t.text[first - 1] in _JOINS and t.kind[first - 2] == NAME:
        first -= 2
        parts.append(t.text[first])
    return first, ".".join(reversed(parts))


def _callee(t: Tokens, i: int, k: int, words: frozenset) -> str | None:
    """What the parenthesis at k calls, if it does."""
    n = k - 1
    if t.text[n] == ">" and t.kind[n] == MARK:  # types between the name and the parenthesis
        depth, n = 0, n + 1
        while n > i:
            n -= 1
            depth += (t.text[n] == ">") - (t.text[n] == "<")
            if not depth or t.kind[n] == MARK and t.text[n] in (";", "{", "}", "(", ")") or t.kind[n] == NUMBER or t.text[n] in ("&", "|") and t.text[n] == t.text[n - 1]:
                break
        if depth or n <= i:
            return None
        n -= 2 if t.text[n - 1] == "::" else 1
    elif t.text[n] == "]" and t.language == "go" and n in t.match and all(t.kind[x] == NAME or t.text[x] in (".", ",", "*", "[", "]") for x in range(t.match[n], n)):
        n = t.match[n] - 1  # types of a Go function
    if t.text[n] == "?." and t.language == "typescript":
        n -= 1
    if n < i or t.kind[n] != NAME or t.text[n] in words and not (t.text[n - 1] in _JOINS and n > i):
        return None
    first, name = _chain(t, i, n)
    before = first - 1 if first > i else None
    prior = t.text[before] if before is not None else ""
    if prior in ("new", "function", "fn", "func", "class") and t.kind[before] == NAME:
        return None
    if before is not None and prior == "*" and before > i and t.text[before - 1] == "function":
        return None
    close = t.match.get(k, len(t))
    then = t.text[close + 1] if close + 1 < len(t) else ""
    if t.language == "rust" and (then == "=>" or t.text[n][:1].isupper() and then in ("=", "|", "if")):
        return None
    if t.language == "typescript" and then == "{" and not t.new_line(close + 1) and prior in ("{", "}", ",", ";", "async", "get", "set", "static", "*", ""):
        return None  # a method of an object or a class inside
    if t.language in ("java", "csharp") and before is not None and (t.kind[before] == NAME and prior not in words | _MODIFIERS[t.language] or prior in (">", "]") and then in ("{", "=>", "throws") and t.kind[before] == MARK):
        return None  # a type before the name: a declaration
    if t.language in ("java", "csharp") and prior in _MODIFIERS[t.language] and then == "{":
        return None
    if t.language == "go" and prior == "]":
        return None  # a conversion
    if t.language == "java":
        return t.text[n]
    if t.language == "csharp" and name == "nameof":
        return None
    return name


class Reader:
    def __init__(self, t: Tokens, file: str):
        self.t, self.file = t, file

    def at(self, k: int) -> str:
        return self.t.text[k] if k < len(self.t) else ""

    def is_name(self, k: int) -> bool:
        return k < len(self.t) and self.t.kind[k] == NAME

    def until(self, k: int, *stops: str) -> int:
        """The next of these tokens outside all brackets and lists of types, or the end of what is around."""
        while k < len(self.t):
            x = self.t.text[k]
            if self.t.kind[k] == MARK:
                if x in stops or x in (")", "]", "}"):
                    return k
                k = self.t.past_types(k) if x == "<" and self.t.angle(k) is not None else self.t.after(k)
            elif x in stops:
                return k
            else:
                k += 1
        return k

    def string(self, k: int) -> str:
        return self.t.text[k].strip("'\"`")

    def declarations(self) -> Iterator[dict]:
        raise NotImplementedError


class TypeScript(Reader):
    """Functions, classes and their methods, interfaces, types and imports, wherever they stand as statements."""

    def declarations(self) -> Iterator[dict]:
        t = self.t
        for k in range(len(t)):
            if t.kind[k] != NAME:
                continue
            x = t.text[k]
            if x == "function":
                yield from self.function(k)
            elif x == "class" and self.is_name(k + 1) and self.at(k + 1) not in ("extends", "implements"):
                yield from self.class_(k)
            elif x in ("interface", "type") and self.is_name(k + 1) and not t.new_line(k + 1):
                first = self.statement(k)
                if first is not None:
                    end = self.until(k + 2, "{") if x == "interface" else t.past_types(k + 2)
                    if x == "interface" and self.at(end) == "{":
                        yield {"type": "interface", "name": t.text[k + 1], "from": k, "to": t.after(end) - 1, "doc": self.doc(first)}
                    elif x == "type" and self.at(end) == "=":
                        yield {"type": "type", "name": t.text[k + 1], "from": k, "to": max(k, self.past_type(end + 1) - 1), "doc": self.doc(first)}
            elif x == "import" and self.at(k + 1) not in ("(", ".") and self.statement(k) is not None:
                yield from self.import_(k)

    def statement(self, k: int) -> int | None:
        """The first token of the statement whose keyword is at k, with its modifiers and decorators; None if k stands inside an expression."""
        t, first = self.t, k
        while first and t.kind[first - 1] == NAME and t.text[first - 1] in ("async", "abstract", "export", "default", "declare"):
            first -= 1
        if first and t.text[first - 1] in ("=", "(", ",", "=>", ":", "?", "&", "|", "+", "-", "!", "~", "*", "/", "%", "<", "[", "...", "."):
            return None
        if first and t.kind[first - 1] == NAME and (t.text[first - 1] in _WORDS - {"else", "do"} | _OWN_WORDS["typescript"] or not t.new_line(first)) and t.text[first - 1] not in ("else", "do"):
            return None
        if first and t.kind[first - 1] in (STRING, NUMBER) and not t.new_line(first):
            return None
        while True:  # decorators: @ a.b.c (...)
            i = first - 1
            if i > 0 and t.text[i] == ")" and i in t.match:
                i = t.match[i] - 1
            while i > 1 and t.kind[i] == NAME and t.text[i - 1] == ".":
                i -= 2
            if i < 1 or t.kind[i] != NAME or t.text[i - 1] != "@":
                return first
            first = i - 1

    def doc(self, k: int) -> str | None:
        said = self.t.said_before(k)
        return said[-1].replace("//", "").replace("/*", "").replace("*/", "").strip() if said else None

    def past_type(self, k: int) -> int:
        """The token after a type."""
        t, operand = self.t, True
        while k < len(t):
            x, kind = t.text[k], t.kind[k]
            if operand:
                if kind == NAME:
                    operand = x in ("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract")
                    k += 1
                elif kind in (STRING, NUMBER):
                    operand, k = False, k + 1
                elif x in ("(", "[", "{"):
                    operand, k = False, t.after(k)
                elif x == "<":
                    k = t.past_types(k) if t.angle(k) is not None else k + 1
                elif x in ("|", "&", "-", "..."):
                    k += 1
                else:
                    return k
            elif x in ("|", "&", "=>", ".") or x in ("is", "extends") and kind == NAME:
                operand, k = True, k + 1
            elif x == "<" and t.angle(k) is not None:
                k = t.past_types(k)
            elif x == "[" and not t.new_line(k):
                k = t.after(k)
            elif x == "?" or x == ":" and self.conditional:
                self.conditional += 1 if x == "?" else -1
                operand, k = True, k + 1
            elif kind == STRING and t.start[k] == t.end[k] or x == "{" and kind == MARK and t.kind[k - 1] == STRING:
                k = t.after(k)  # a template's types
            else:
                return k
        return k

    conditional = 0

    def signature(self, k: int) -> int | None:
        """From the parenthesis or the types of a function on: the bracket of its body, or None if it has none."""
        k = self.t.past_types(k)
        if self.at(k) != "(":
            return None
        k = self.t.after(k)
        if self.at(k) == ":":
            self.conditional = 0
            k = self.past_type(k + 1)
        return k if self.at(k) == "{" else None

    def function(self, k: int) -> Iterator[dict]:
        name = k + 2 if self.at(k + 1) == "*" else k + 1
        first = self.statement(k)
        if first is None or not self.is_name(name):
            return
        body = self.signature(name + 1)
        if body is not None:
            start = k - 1 if self.at(k - 1) == "async" and k else k
            yield {"type": "function", "name": self.t.text[name], "from": start, "to": self.t.after(body) - 1, "body": (body, self.t.after(body)), "doc": self.doc(first)}

    def class_(self, k: int) -> Iterator[dict]:
        t, first = self.t, self.statement(k)
        body = self.until(k + 2, "{")
        if first is None or self.at(body) != "{":
            return
        name, end = t.text[k + 1], t.after(body) - 1
        start = k - 1 if k and self.at(k - 1) == "abstract" else k
        if first < start and not {"export", "default", "declare"} & set(t.text[first:start]):
            start = first  # decorators belong to a class that isn't exported
        yield {"type": "class", "name": name, "from": start, "to": end, "doc": self.doc(first)}
        k = body + 1
        while k < end:
            k = yield from self.member(k, end, name)

    def member(self, k: int, end: int, owner: str):
        """One member of a class; the token after it."""
        t, first = self.t, k
        while self.at(k) == "@":
            k = k + 2
            while self.at(k) == ".":
                k += 2
            k = t.past_types(k)
            if self.at(k) == "(":
                k = t.after(k)
        start = k
        while self.is_name(k) and t.text[k] in _MODIFIERS["typescript"] and self.at(k + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}", ",") and not (t.text[k] == "async" and t.new_line(k + 1)):
            k += 1
        if self.at(k) == "*":
            k += 1
        if self.at(k) == "{" and self.at(k - 1) == "static":
            return t.after(k)
        if k >= end or t.kind[k] == MARK and t.text[k] != "[":
            return k + 1
        after = t.after(k)
        name = t.source[t.start[k] : t.end[after - 1]]
        k = after + 1 if self.at(after) in ("?", "!") else after
        if self.at(k) in ("(", "<"):
            body = self.signature(k)
            if body is not None:
                yield {"type": "function", "name": name, "from": start, "to": t.after(body) - 1, "body": (body, t.after(body)), "doc": self.doc(first), "parent": owner}
                return t.after(body)
        while k < end and self.at(k) != ";":  # a field or a signature: up to a semicolon, or a line that begins another member
            if t.new_line(k) and (t.kind[k] in (NAME, STRING) or self.at(k) in ("@", "[", "*")) and (t.kind[k - 1] != MARK or self.at(k - 1) in (")", "]", "}")) and self.at(k - 1) not in ("extends", "in", "instanceof"):
                return k
            k = t.after(k)
        return k + 1

    def import_(self, k: int) -> Iterator[dict]:
        t, i = self.t, k + 1
        while i < len(t) and t.kind[i] != STRING and t.text[i] != ";" and i - k < 5000:
            i += 1
        if i >= len(t) or t.kind[i] != STRING:
            return
        words = t.text[k + 1 : i]
        if "=" in words:  # import name = require("path")
            words = words[: words.index("=")]
        words = words[:-1] if words and words[-1] == "from" else words
        path = resolve_typescript(self.string(i), self.file)
        bound: list[list[str]] = [[]]
        for w in words:
            if w in ("{", "}", ","):
                bound.append([])
            else:
                bound[-1].append(w)
        names = [x[-1] for x in bound if x and x != ["type"]]
        for n in names or [None]:
            yield {"type": "import", "name": f"{path}.{n}" if n else path, "from": k}


def resolve_typescript(path: str, file: str) -> str:
    """A relative path from the file's folder, without its extension; packages as they are."""
    if not path.startswith(("./", "../")):
        return path
    folders = [p for p in file.split("/")[:-1] if p not in ("", ".")]
    for part in path.split("/"):
        if part == "..":
            folders = folders[:-1]
        elif part not in ("", "."):
            folders.append(part)
    return re.sub(r"\.(?:tsx?|jsx?)$", "", "/".join(folders))


class Go(Reader):
    """Declarations of the file itself; a method's parent is its receiver's type."""

    def declarations(self) -> Iterator[dict]:
        t, k = self.t, 0
        while k < len(t):
            if t.text[k] == "import" and t.kind[k] == NAME:
                k = yield from self.imports(k)
            elif t.text[k] == "func" and self.at(k + 1) != "{" and t.new_line(k):
                k = yield from self.function(k)
            elif t.text[k] == "type" and t.kind[k] == NAME:
                k = yield from self.types(k)
            else:
                k = t.after(k)

    def doc(self, k: int) -> str | None:
        said = self.t.said_before(k)
        return said[-1].removeprefix("//").removeprefix(" ").strip() if said else None

    def imports(self, k: int):
        t = self.t
        group = self.at(k + 1) == "("
        end = t.match.get(k + 1, len(t)) if group else min(len(t), k + 4)
        i = k + 2 if group else k + 1
        while i < end:
            first = i
            while i < end and t.kind[i] != STRING:
                if t.new_line(i):
                    first = i
                i += 1
            if i >= end:
                break
            yield {"type": "import", "name": self.string(i).strip().rstrip("/").rsplit("/", 1)[-1], "from": first}
            i += 1
            if not group:
                return i
        return end + 1 if group else i

    def function(self, k: int):
        t, i, parent = self.t, k + 1, None
        if self.at(i) == "(":
            close, j = t.match.get(i, len(t)), i + 1
            while j < close:
                if t.kind[j] == NAME:
                    parent = t.text[j]
                j = t.after(j)
            i = close + 1
        if not self.is_name(i):
            return t.after(k)
        name, i = t.text[i], i + 1
        if self.at(i) == "[":
            i = t.after(i)
        i = t.after(i) if self.at(i) == "(" else i
        while i < len(t) and not t.new_line(i):
            if t.text[i] == "{" and t.text[i - 1] not in ("struct", "interface"):
                yield {"type": "function", "name": name, "from": k, "to": t.after(i) - 1, "body": (i, t.after(i)), "doc": self.doc(k), "parent": parent}
                return t.after(i)
            i = t.after(i)
        yield {"type": "function", "name": name, "from": k, "doc": self.doc(k), "parent": parent}
        return i

    def types(self, k: int):
        t = self.t
        group = self.at(k + 1) == "("
        i, end = (k + 2, t.match.get(k + 1, len(t))) if group else (k + 1, len(t))
        while i < end and self.is_name(i):
            name, first, i = t.text[i], i, i + 1
            if self.at(i) == "[" and t.match.get(i, 0) > i + 2 and t.kind[i + 1] == NAME:
                i = t.after(i)
            alias = self.at(i) == "="
            i += alias
            kind = {"struct": "class", "interface": "interface"}.get(self.at(i), "type")
            i += 1
            while i < end and not (t.new_line(i) or t.text[i] == ";"):
                i = t.after(i)
            yield {"type": kind, "name": name, "from": first, "to": i - 1, "doc": self.doc(k)}
            if not group:
                return i
            i += self.at(i) == ";"
        return end + 1 if group else max(i, k + 1)


class Rust(Reader):
    """Items of the file and of its inline modules, and the functions of implementations, whose parent is the type."""

    def declarations(self) -> Iterator[dict]:
        yield from self.items(0, len(self.t), None)

    def doc(self, first: int, k: int) -> str | None:
        """The /// lines before an item, also those between its attributes."""
        lines: list[str] = []
        for c in (c for i in range(first, k + 1) for c in self.t.said_before(i)):
            lines = [*lines, c.lstrip("/").strip()] if c.startswith("///") else []
        return " ".join(x for x in lines if x)

    def items(self, k: int, end: int, parent: str | None) -> Iterator[dict]:
        t = self.t
        while k < end:
            first = k
            while self.at(k) == "#" and self.at(k + 1) in ("[", "!"):
                k = t.after(k + 1 if self.at(k + 1) == "[" else k + 2)
            start = k
            if self.at(k) == "pub":
                k = t.after(k + 1) if self.at(k + 1) == "(" else k + 1
            while self.at(k) in ("async", "unsafe", "default", "extern", "const", "auto", "safe") and (self.at(k) != "const" or self.at(k + 1) in ("fn", "unsafe", "async", "extern")) and (self.is_name(k + 1) or k + 1 < end and t.kind[k + 1] == STRING):
                k += 2 if t.kind[k + 1] == STRING else 1
            x = self.at(k) if k < end else ""
            if x == "fn" and self.is_name(k + 1):
                body = self.until(k + 2, "{", ";")
                while self.at(body) == "{" and self.at(body - 1) in ("=",):
                    body = self.until(t.after(body), "{", ";")
                if self.at(body) == "{":
                    yield {"type": "function", "name": t.text[k + 1], "from": start, "to": t.after(body) - 1, "body": (body, t.after(body)), "doc": self.doc(first, start), "parent": parent}
                k = t.after(body) if body < len(t) else body
            elif x in ("struct", "enum", "trait") and self.is_name(k + 1):
                body = self.until(k + 2, "{", ";")
                stop = t.after(body) if body < len(t) else body
                yield {"type": "interface" if x == "trait" else "class", "name": t.text[k + 1], "from": start, "to": stop - 1, "doc": self.doc(first, start), "parent": parent}
                k = stop
            elif x == "type" and self.is_name(k + 1):
                stop = self.until(k + 2, ";")
                yield {"type": "type", "name": t.text[k + 1], "from": start, "to": stop, "doc": self.doc(first, start), "parent": parent}
                k = stop + 1
            elif x == "impl":
                k = yield from self.implementation(k)
            elif x == "mod" and self.is_name(k + 1) and self.at(k + 2) == "{":
                yield from self.items(k + 3, t.match.get(k + 2, end), t.text[k + 1])
                k = t.after(k + 2)
            elif x == "use":
                stop = self.until(k + 1, ";")
                line = t.line(t.start[start])
                for i in self.leaves(k + 1, min(stop, end)):
                    yield {"type": "import", "name": t.text[i], "from": i, "line": line}
                k = stop + 1
            elif x == "macro_rules":
                k = t.after(k + 3)
            elif k >= end:
                break
            else:  # a constant, a macro or something unknown
                k = t.after(k)

    def implementation(self, k: int):
        t = self.t
        i = self.t.past_types(k + 1)
        begin, body = i, self.until(i, "{", ";")
        while i < body and self.at(i) != "where":
            if self.at(i) == "for" and self.at(i + 1) != "<":
                begin = i + 1
            i = t.past_types(i) if self.at(i) == "<" and t.angle(i) is not None else t.after(i)
        if self.at(body) != "{":
            return body + 1
        last = i - 1
        yield from self.items(body + 1, t.match.get(body, len(t)), t.source[t.start[begin] : t.end[last]] if begin <= last < len(t) else None)
        return t.after(body)

    def leaves(self, k: int, end: int) -> Iterator[int]:
        """The tokens of the names that a use tree binds; a star stands for the name before it."""
        t, last, skip = self.t, None, False
        while k < end:
            x = t.text[k]
            if x == "{":
                yield from self.leaves(k + 1, t.match.get(k, end))
                k, last = t.after(k), None
                continue
            if x == ",":
                if last is not None and not skip:
                    yield last
                last, skip = None, False
            elif t.kind[k] == NAME and x != "as":
                last, skip = k, x in ("self", "crate", "super", "_") and t.text[k - 1] != "as" or x == "_"
            k += 1
        if last is not None and not skip:
            yield last


class Members(Reader):
    """What Java and C# share: types with members, methods with a type before the name, constructors without."""

    types: dict[str, str] = {}

    def declarations(self) -> Iterator[dict]:
        yield from self.members(0, len(self.t), None)

    def head(self, k: int, end: int) -> int:
        """The token after annotations, attributes and modifiers."""
        raise NotImplementedError

    def doc(self, first: int, k: int) -> str | None:
        raise NotImplementedError

    def other(self, first: int, k: int, end: int, owner: str | None):
        """What only one of the languages has: (what is found, the token after it), or None."""
        return None

    def members(self, k: int, end: int, owner: str | None) -> Iterator[dict]:
        t = self.t
        while k < end:
            first = k
            k = self.head(k, end)
            if k >= end:
                return
            found = self.other(first, k, end, owner)
            if found:
                yield from found[0]
                k = max(found[1], k + 1)
                continue
            x = t.text[k]
            if x in self.types and t.kind[k] == NAME and self.is_name(name := self.type_name(k)):
                body = self.until(name + 1, "{", ";")
                stop = t.after(body) if body < len(t) else body
                yield {"type": self.types[x], "name": t.text[name], "from": first, "to": stop - 1, "doc": self.doc(first, k), "parent": owner}
                if self.at(body) == "{":
                    yield from self.members(self.first_member(x, body), t.match.get(body, end), t.text[name])
                k = stop
            elif x in (";", "}", ")", "]"):
                k += 1
            else:
                k = yield from self.member(first, k, end, owner)

    def type_name(self, k: int) -> int:
        return k + 1

    def first_member(self, kind: str, body: int) -> int:
        return body + 1

    def member(self, first: int, k: int, end: int, owner: str | None):
        """A method, a constructor, or what is passed over; the token after it."""
        t, head = self.t, k
        i, name = k, None
        if self.at(i) == "<":
            i = head = t.past_types(i)
        while i < end:
            x = t.text[i]
            if t.kind[i] == NAME:
                name, i = i, i + 1
            elif x == "<" and (close := t.angle(i)) is not None:
                i = close + 1
            elif x == "(" and name is not None and not (name == head and t.text[name] == "ref"):
                break
            elif x in ("(", "["):
                i = t.after(i)
            elif x in ("{", ";", "=", "=>"):
                break
            else:
                i += 1
        x = self.at(i) if i < end else ""
        if x == "{":
            i = t.after(i)
            return self.until(i, ";") + 1 if self.at(i) == "=" else i
        if x != "(" or "operator" in t.text[k:i] or self.at(name - 1) == "~":
            return self.until(i, ";") + 1
        body = self.until(t.after(i), "{", ";", "=>")
        stop = t.after(body) if self.at(body) == "{" else self.until(body, ";") + 1
        called = (body, t.after(body)) if self.at(body) == "{" else (body, stop) if self.at(body) == "=>" else None
        if owner is not None and (name > head or t.text[name] == owner):
            yield {"type": "function", "name": t.text[name], "from": first, "to": min(stop, len(t)) - 1, "body": called, "doc": self.doc(first, k), "parent": owner}
        return stop


class Java(Members):
    types = {"class": "class", "enum": "class", "record": "class", "interface": "interface"}

    def head(self, k: int, end: int) -> int:
        t = self.t
        while k < end:
            if t.text[k] == "@" and self.at(k + 1) != "interface":
                k += 2
                while self.at(k) == ".":
                    k += 2
                k = t.after(k) if self.at(k) == "(" else k
            elif t.kind[k] == NAME and t.text[k] in _MODIFIERS["java"]:
                k += 1
            elif t.text[k] == "non" and self.at(k + 1) == "-":
                k += 3
            else:
                break
        return k

    def doc(self, first: int, k: int) -> str | None:
        said = self.t.said_before(first)
        if not said or not said[-1].startswith("/**"):
            return None
        lines = (line.strip().lstrip("*").strip() for line in said[-1][3:].removesuffix("*/").split("\n"))
        return " ".join(x for x in lines if x)

    def other(self, first: int, k: int, end: int, owner: str | None):
        t, x = self.t, self.t.text[k]
        if x == "import" and owner is None:
            stop = self.until(k, ";")
            names = [w for i, w in enumerate(t.text[k + 1 : stop]) if t.kind[k + 1 + i] == NAME and w != "static"]
            return ([{"type": "import", "name": names[-1], "from": first}] if names else []), stop + 1
        if x == "package" and owner is None or x == "module":
            return [], self.until(k, ";", "{") + 1
        if x == "@":  # an annotation type
            return [], t.after(self.until(k + 3, "{"))
        return None

    def first_member(self, kind: str, body: int) -> int:
        if kind != "enum":
            return body + 1
        return self.until(body + 1, ";")  # constants come first


class CSharp(Members):
    types = {"class": "class", "struct": "class", "record": "class", "enum": "class", "interface": "interface"}

    def head(self, k: int, end: int) -> int:
        t = self.t
        while k < end:
            if t.text[k] == "[":
                k = t.after(k)
            elif t.kind[k] == NAME and (t.text[k] in _MODIFIERS["csharp"] or t.text[k] == "ref" and self.at(k + 1) in ("struct", "readonly", "partial")):
                k += 1
            else:
                break
        return k

    def doc(self, first: int, k: int) -> str | None:
        lines: list[str] = []
        for c in self.t.said_before(first):
            lines = [*lines, re.sub(r"<[^>]+>", "", c[3:].strip()).strip()] if c.startswith("///") else []
        return " ".join(x for x in lines if x)

    def type_name(self, k: int) -> int:
        return k + 2 if self.at(k) == "record" and self.at(k + 1) in ("class", "struct") else k + 1

    def first_member(self, kind: str, body: int) -> int:
        return self.t.match.get(body, len(self.t)) if kind == "enum" else body + 1

    def other(self, first: int, k: int, end: int, owner: str | None):
        t, x = self.t, self.t.text[k]
        if x == "namespace" and owner is None:
            body = self.until(k, "{", ";")
            return (self.members(body + 1, t.match.get(body, end), None), t.after(body)) if self.at(body) == "{" else ([], body + 1)
        if owner is None and (x == "using" or x == "global" and self.at(k + 1) == "using") and self.at(k + 1) != "(":
            stop = self.until(k, ";")
            words = [i for i in range(k, stop) if t.kind[i] == NAME and t.text[i] not in ("global", "using", "static", "unsafe")]
            plain = bool(words) and all(t.kind[i] == NAME or t.text[i] in (".", "=", "::") for i in range(k, stop)) and "var" not in t.text[k:stop]
            return ([{"type": "import", "name": t.text[words[-1]], "from": first}] if plain else []), stop + 1
        if x == "delegate" or x == "extern":
            return [], self.until(k, ";") + 1
        if x == "record" and not (self.is_name(k + 1)):
            return None
        return None


READERS = {"typescript": TypeScript, "go": Go, "rust": Rust, "java": Java, "csharp": CSharp}
