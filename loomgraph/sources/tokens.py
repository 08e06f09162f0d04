"""Tokens of five languages with braces: what is needed to tell code from strings, comments, patterns and markup, and to pair brackets.

Strings that hold expressions (templates, interpolated strings, markup) give the expressions' tokens between brackets of
their own, so calls inside them are seen. Comments stand apart, under the token that they come before.
"""

from __future__ import annotations

import re
from bisect import bisect_right

NAME, NUMBER, STRING, MARK = "name", "number", "string", "mark"

_SPACE = re.compile(r"\s+")
_COMMENT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
_NUMBER = re.compile(r"\d(?:[eEpP][+-]\d|\.(?=\d)|\w)*")
_MARKS = re.compile(r"=>|::|->|\?\.(?!\d)|\.\.\.|.", re.S)
_QUOTED = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}?", re.S) for q in "\"'"}
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_RUST_RAW = re.compile(r'(?:b|c)?r(#*)"')
_TAG = re.compile(r"<(?=[A-Za-z_$>])")
_TAG_NAME = re.compile(r"[\w$.:-]*")
#: Words after which an operand comes, so that a slash begins a pattern and a bracket markup.
_BEFORE_OPERAND = frozenset("return typeof case in of void delete throw new else do instanceof yield await default extends export".split())
_HEADS = frozenset(("if", "while", "for", "with"))
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Tokens:
    """kind, text, start and end of each token; match, the place of each bracket's partner; comments, (start, end) of those before a token."""

    def __init__(self, source: str, language: str, markup: bool = False):
        self.source, self.language, self.markup = source, language, markup
        self.kind: list[str] = []
        self.text: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.comments: dict[int, list[tuple[int, int]]] = {}
        self._heads: list[bool] = []  # of each open parenthesis: whether a statement's head, after which an operand comes
        self._after_head = False
        self._newlines = [m.start() for m in re.finditer("\n", source)]
        at = source.index("\n") if source.startswith("#!") and "\n" in source and language != "rust" else 0
        self._code(at, None)
        self.match = self._pairs()

    def __len__(self) -> int:
        return len(self.text)

    def line(self, at: int) -> int:
        return bisect_right(self._newlines, at - 1) + 1

    def column(self, at: int) -> int:
        """Bytes before a position in its line."""
        k = bisect_right(self._newlines, at - 1)
        return len(self.source[self._newlines[k - 1] + 1 if k else 0 : at].encode())

    def new_line(self, k: int) -> bool:
        """Whether a token is the first of its line."""
        return k == 0 or k >= len(self.text) or "\n" in self.source[self.end[k - 1] : self.start[k]]

    def _add(self, kind: str, start: int, end: int, text: str | None = None) -> int:
        self.kind.append(kind)
        self.text.append(self.source[start:end] if text is None else text)
        self.start.append(start)
        self.end.append(end)
        return end

    def _operand_next(self) -> bool:
        """Whether an operand may come next, not an operator."""
        if not self.text:
            return True
        kind, text = self.kind[-1], self.text[-1]
        if kind == NAME:
            return text in _BEFORE_OPERAND
        return kind == MARK and (text not in (")", "]", "}") or text == "}" or text == ")" and self._after_head)

    def _code(self, at: int, until: str | None) -> int:
        """Tokens from a position on; until: the bracket that ends them, which is left to the caller."""
        s, n, language, depth = self.source, len(self.source), self.language, 0
        while at < n:
            c = s[at]
            if c.isspace():
                at = _SPACE.match(s, at).end()
                continue
            if c == "/" and s[at + 1 : at + 2] in ("/", "*"):
                end = self._nested_comment(at) if language == "rust" and s[at + 1] == "*" else _COMMENT.match(s, at).end()
                self.comments.setdefault(len(self.text), []).append((at, end))
                at = end
                continue
            if c == "#" and language == "csharp" and not s[s.rfind("\n", 0, at) + 1 : at].strip():
                end = s.find("\n", at)  # a directive takes its line
                at = n if end < 0 else end
                continue
            end = self._string(at, c)
            if end is not None:
                at = end
                continue
            m = _NAME.match(s, at)
            if m:
                at = self._add(NAME, at, m.end())
                continue
            if c.isdigit():
                at = self._add(NUMBER, at, _NUMBER.match(s, at).end())
                continue
            if c == until and not depth:
                return at
            if until and c in "{}":
                depth += 1 if c == "{" else -1
            if c == "(":
                self._heads.append(bool(self.text) and self.text[-1] in _HEADS)
            elif c == ")":
                self._after_head = bool(self._heads) and self._heads.pop()
            at = self._add(MARK, at, _MARKS.match(s, at).end())
        return n

    def _nested_comment(self, at: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.source, at):
            depth += 1 if m.group() == "/*" else -1
            if not depth:
                return m.end()
        return len(self.source)

    def _string(self, at: int, c: str) -> int | None:
        """The end of a string, character, pattern or markup that begins here, or None."""
        s, language = self.source, self.language
        if language == "typescript":
            if c == "`":
                return self._parts(at, at + 1, "`", "${")
            if c == "/" and self._operand_next() and (m := _PATTERN.match(s, at)):
                return self._add(STRING, at, m.end())
            if c == "<" and self.markup and self._operand_next() and _TAG.match(s, at) and not re.match(r"<\s*\w+\s*(?:,|extends\b|=(?!\s*[{\"']))", s[at : at + 200]):
                return self._element(at)
            if c == "#" and (m := _NAME.match(s, at + 1)):
                return self._add(NAME, at, m.end())
        elif language == "go":
            if c == "`":
                end = s.find("`", at + 1)
                return self._add(STRING, at, len(s) if end < 0 else end + 1)
        elif language == "rust":
            if c in "rbc" and (m := _RUST_RAW.match(s, at)):
                end = s.find('"' + m[1], m.end())
                return self._add(STRING, at, len(s) if end < 0 else end + 1 + len(m[1]))
            if c == "r" and s.startswith("r#", at) and (m := _NAME.match(s, at + 2)):
                return self._add(NAME, at, m.end())
            if c in "bc" and s[at + 1 : at + 2] in ('"', "'"):
                return self._string(at + 1, s[at + 1])
            if c == '"':
                return self._add(STRING, at, re.compile(r'"(?:\\.|[^"\\])*"?', re.S).match(s, at).end())
            if c == "'":
                if m := re.compile(r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'", re.S).match(s, at):
                    return self._add(STRING, at, m.end())
                m = re.compile(r"'\w*").match(s, at)  # a lifetime
                return self._add(STRING, at, max(at + 1, m.end()))
        elif language == "csharp":
            if c in "$@" and (m := re.compile(r'(\$*)(@?)(\$?)("{3,}|")').match(s, at)) and (m[1] or m[2] or m[3]):
                return self._csharp_string(at, m)
            if c == '"' and s.startswith('"""', at):
                return self._csharp_string(at, re.compile(r'(\$*)(@?)(\$?)("{3,}|")').match(s, at))
            if c == "@" and (m := _NAME.match(s, at + 1)):
                return self._add(NAME, at, m.end())
        elif language == "java" and c == '"' and s.startswith('"""', at):
            m = re.compile(r'"""(?:\\.|[^\\])*?(?:"""|\Z)', re.S).match(s, at)
            return self._add(STRING, at, m.end())
        if c in _QUOTED and not (c == "'" and language == "rust"):
            return self._add(STRING, at, max(at + 1, _QUOTED[c].match(s, at).end()))
        return None

    def _csharp_string(self, at: int, m: re.Match) -> int:
        s, marks, verbatim, quote = self.source, len(m[1]) + len(m[3]), bool(m[2]), m[4]
        if len(quote) >= 3:  # raw: as many quotes end it, as many braces as dollars begin an expression
            if not marks:
                end = s.find(quote, m.end())
                return self._add(STRING, at, len(s) if end < 0 else end + len(quote))
            return self._parts(at, m.end(), quote, "{" * marks, raw=True)
        if not marks:
            return self._add(STRING, at, re.compile(r'(?:""|[^"])*"?', re.S).match(s, m.end()).end())
        return self._parts(at, m.end(), '"', "{", doubled=True, verbatim=verbatim)

    def _parts(self, start: int, at: int, quote: str, opening: str, raw: bool = False, doubled: bool = False, verbatim: bool = False) -> int:
        """A string with expressions in it: a string token, and each expression's tokens in brackets. doubled: two braces stand for one; verbatim: two quotes for one, and no backslashes."""
        s, n = self.source, len(self.source)
        self._add(STRING, start, at)
        while at < n:
            if not raw and not verbatim and s[at] == "\\":
                at += 2
            elif verbatim and s.startswith('""', at):
                at += 2
            elif s.startswith(quote, at):
                return at + len(quote)
            elif doubled and s[at] in "{}" and s.startswith(s[at] * 2, at):
                at += 2
            elif s.startswith(opening, at):
                self._add(MARK, at, at + len(opening), "{")
                at = self._code(at + len(opening), "}")
                self._add(MARK, at, min(n, at + 1), "}")
                at += len(opening) if raw else 1
                self._add(STRING, at, at)  # what comes after is not an operand's beginning
            elif not raw and not verbatim and quote == '"' and s[at] == "\n":
                return at  # never closed
            else:
                at += 1
        return n

    def _element(self, at: int) -> int:
        """Markup: a string token for the element, and the tokens of the expressions in its attributes and between its tags."""
        s, n, start = self.source, len(self.source), at
        open_ = 0
        self._add(STRING, at, at + 1)
        while at < n:
            if s.startswith("</", at):
                end = s.find(">", at)
                at, open_ = (n if end < 0 else end + 1), open_ - 1
            elif s[at] == "<":
                at = _TAG_NAME.match(s, at + 1).end()
                closed, at = self._attributes(at)
                open_ += not closed
            elif s[at] == "{":
                at = self._expression(at)
            else:  # text between tags
                m = re.compile(r"[^<{]+").match(s, at)
                at = m.end() if m else at + 1
                continue
            if open_ <= 0:
                break
        self._add(STRING, max(start, at), at)
        return at

    def _attributes(self, at: int) -> tuple[bool, int]:
        """(whether the tag closes itself, where it ends)."""
        s, n = self.source, len(self.source)
        while at < n:
            if s.startswith("/>", at):
                return True, at + 2
            if s.startswith("//", at) or s.startswith("/*", at):
                at = _COMMENT.match(s, at).end()
            elif s[at] == ">":
                return False, at + 1
            elif s[at] == "{":
                at = self._expression(at)
            elif s[at] in "\"'":
                end = s.find(s[at], at + 1)
                at = n if end < 0 else end + 1
            elif s[at] == "<":  # types of a generic element
                depth = 0
                for m in re.compile(r"[<>]").finditer(s, at):
                    depth += 1 if m.group() == "<" else -1
                    if not depth:
                        break
                at = m.end()
            else:
                at += 1
        return True, n

    def _expression(self, at: int) -> int:
        self._add(MARK, at, at + 1, "{")
        at = self._code(at + 1, "}")
        self._add(MARK, at, min(len(self.source), at + 1), "}")
        return at + 1

    def _pairs(self) -> dict[int, int]:
        """Brackets' partners both ways; those never closed are paired with the end, and closers without an opener with nothing."""
        out: dict[int, int] = {}
        open_: list[int] = []
        for k, (kind, t) in enumerate(zip(self.kind, self.text, strict=True)):
            if kind != MARK:
                continue
            if t in _OPEN:
                open_.append(k)
            elif t in _CLOSE:
                if any(self.text[i] == _CLOSE[t] for i in open_[-50:]):
                    while self.text[open_[-1]] != _CLOSE[t]:
                        out[open_.pop()] = k
                    i = open_.pop()
                    out[i], out[k] = k, i
        return out | dict.fromkeys(open_, len(self.text))

    def after(self, k: int) -> int:
        """The token after the partner of a bracket, or after any other token."""
        return min(len(self.text), max(k, self.match.get(k, k)) + 1 if self.text[k] in _OPEN else k + 1)

    def angle(self, k: int) -> int | None:
        """The bracket that ends a list of types which begins at ``<``, or None if it isn't one."""
        depth, i, n = 0, k, len(self.text)
        while i < n:
            t = self.text[i]
            if t == "<" and self.kind[i] == MARK:
                depth += 1
            elif t == ">" and self.kind[i] == MARK:
                depth -= 1
                if not depth:
                    return i
            elif t == ";" or t in _CLOSE and self.kind[i] == MARK:
                return None
            i = self.after(i) if t in _OPEN else i + 1
        return None

    def past_types(self, k: int) -> int:
        """The token after a list of types, if one begins here."""
        if k < len(self.text) and self.text[k] == "<" and (end := self.angle(k)) is not None:
            return end + 1
        return k

    def said_before(self, k: int) -> list[str]:
        """The comments before a token."""
        return [self.source[a:b] for a, b in self.comments.get(k, ())]
