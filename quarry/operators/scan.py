"""A scanner for languages with brackets: words, brackets, strings and comments, and what they make up.

Brackets are matched once, strings and comments aside, so the end of a body, the
arguments of a call and nesting are looked up, not searched for. Time is in proportion
to the source.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_COMMENT = {"php": r"//[^\n]*|\#(?!\[)[^\n]*|/\*.*?\*/", "css": r"/\*.*?\*/", "blade": r"\{\{--.*?--\}\}|<!--.*?-->"}
_STRING = {"blade": r"'[^'\n]*'", "css": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", "rust": r"\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\])'"}
_OPEN, _CLOSE = "([{", ")]}"


@dataclass(frozen=True)
class Token:
    text: str
    start: int
    end: int
    #: word, string, open, close or mark
    kind: str


@dataclass(frozen=True)
class Call:
    """name(arguments), with what stands before -> or ::, if anything does; parts of one chain follow each other."""

    name: str
    on: str
    arguments: str
    start: int
    end: int

    def strings(self) -> list[str]:
        """The literal strings among the arguments, in order."""
        return [m[1] if m[1] is not None else m[2] for m in re.finditer(r"'((?:\\.|[^'\\])*)'|\"((?:\\.|[^\"\\])*)\"", self.arguments)]


class Scan:
    """A source's tokens without white space and comments, and which bracket closes which."""

    def __init__(self, source: str, language: str):
        self.source = source
        comment = _COMMENT.get(language, r"//[^\n]*|/\*.*?\*/")
        string = _STRING.get(language, r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"" + ("" if language == "php" else r"|`(?:\\.|[^`\\])*`"))
        rule = re.compile(rf"(?P<gone>{comment}|\s+)|(?P<string>{string})|(?P<word>[\w$\\@]+)|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<mark>\?->|->|::|=>|.)", re.S)
        self.tokens = [Token(m[0], m.start(), m.end(), m.lastgroup or "") for m in rule.finditer(source) if m.lastgroup != "gone"]
        #: Of an opening bracket's token, its closing one's.
        self.closes: dict[int, int] = {}
        #: Of each token, the bracket it stands in, or -1.
        self.inside: list[int] = []
        open_: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind == "close":
                while open_:
                    o = open_.pop()
                    self.closes[o] = k
                    if _OPEN.index(self.tokens[o].text) == _CLOSE.index(t.text):
                        break
            self.inside.append(open_[-1] if open_ else -1)
            if t.kind == "open":
                open_.append(k)
        for o in open_:
            self.closes[o] = len(self.tokens) - 1
        self._lines = [m.start() for m in re.finditer("\n", source)]

    def line(self, at: int) -> int:
        return bisect_right(self._lines, at - 1) + 1

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def within(self, o: int) -> str:
        """What stands between a bracket and the one that closes it."""
        return self.source[self.tokens[o].end : self.tokens[self.closes[o]].start]

    def parts(self, o: int) -> list[str]:
        """What stands between commas in a bracket, nested ones aside."""
        out, start = [], self.tokens[o].end
        for k in range(o + 1, self.closes[o] + 1):
            if k == self.closes[o] or (self.tokens[k].text == "," and self.inside[k] == o):
                out.append(self.source[start : self.tokens[k].start].strip())
                start = self.tokens[k].end
        return [p for p in out if p]

    def body(self, k: int) -> int | None:
        """The first brace from token k on, before the statement ends."""
        while k < len(self.tokens):
            t = self.tokens[k].text
            if t == "{":
                return k
            if t == ";" or t == "}":
                return None
            k = self.closes[k] + 1 if k in self.closes else k + 1
        return None

    def past(self, k: int) -> int:
        """What follows the angle brackets that begin at token k, whatever is between them; k itself if there are none, or if they don't close."""
        depth, j = 0, k
        while j < len(self.tokens) and (t := self.tokens[j].text) != ";":
            depth += (t == "<") - (t == ">")
            j = self.closes[j] + 1 if j in self.closes else j + 1
            if not depth:
                return j if j > k + 1 else k
        return k

    def find(self, k: int, mark: str) -> int | None:
        """The first such mark from token k on, outside of all brackets, before the statement ends."""
        while k < len(self.tokens):
            t = self.tokens[k].text
            if t == mark:
                return k
            if t in (";", ")", "]", "}"):
                return None
            k = self.closes[k] + 1 if k in self.closes else max(k + 1, self.past(k) if t == "<" else 0)
        return None

    def arguments(self, k: int) -> int | None:
        """The round bracket at token k, behind type parameters if there are any."""
        k = self.past(k) if self.text(k) == "<" else self.closes[k] + 1 if self.text(k) == "[" else k
        return k if self.text(k) == "(" and k in self.closes else None

    def calls(self, first: int = 0, last: int | None = None) -> list[Call]:
        """Calls among the tokens from first to last, in order of their names."""
        out = []
        for o in range(first + 1, len(self.tokens) if last is None else last):
            if self.tokens[o].text == "(" and self.tokens[o - 1].kind == "word" and o in self.closes:
                on = self.text(o - 3) if self.text(o - 2) in ("->", "?->", "::") else ""
                out.append(Call(self.tokens[o - 1].text, on, self.within(o), self.tokens[o - 1].start, self.tokens[self.closes[o]].end))
        return out


#: Words before a bracket that call nothing.
CONTROL = frozenset("if for while switch catch return function foreach match fn elseif with await typeof new array list isset empty".split())
#: Of each language: words that begin a function, and words that begin a type.
WORDS = {
    "php": ({"function"}, {"class", "interface", "trait", "enum"}),
    "javascript": ({"function"}, {"class"}),
    "typescript": ({"function"}, {"class", "interface", "enum"}),
    "go": ({"func"}, {"struct", "interface"}),
    "rust": ({"fn"}, {"struct", "trait", "enum"}),
}


def nodes(source: str, language: str) -> list[tuple]:
    """(category, name, type, start, end, parameters, scope, statement) of functions, types, imports and exports, in order of the text."""
    if language not in WORDS:
        return []
    functions, types = WORDS[language]
    scan = Scan(source, language)
    found: list[tuple[int, int, str, str, str, list[str]]] = []  # first and last token, category, name, type, parameters
    for k, t in enumerate(scan.tokens):
        if t.kind != "word" or scan.text(k - 1) in ("->", "?->", "::", "."):
            continue
        if t.text in functions:
            j = k + 1
            if language == "go" and scan.text(j) == "(":  # a receiver
                j = scan.closes[j] + 1
            j += scan.text(j) in ("&", "*")
            name, o = scan.text(j), scan.arguments(j + 1)
            if o and re.fullmatch(r"[\w$]+", name) and name != t.text:
                b = scan.body(scan.closes[o] + 1)
                found.append((k, scan.closes[b] if b is not None else scan.closes[o], "functions", name, "function", scan.parts(o)))
        elif t.text in types and language == "go":
            if scan.text(k - 2) == "type" and (b := scan.body(k)) is not None:
                found.append((k - 2, scan.closes[b], "classes", scan.text(k - 1), t.text, []))
        elif t.text in types and re.fullmatch(r"[A-Za-z_]\w*", scan.text(k + 1)) and scan.text(k + 1) not in ("extends", "implements"):
            b = scan.body(k + 1)
            found.append((k, scan.closes[b] if b is not None else k + 1, "classes", scan.text(k + 1), t.text, []))
        elif language in ("javascript", "typescript"):
            if t.text in ("const", "let", "var") and scan.text(k + 2) in ("=", ":"):
                j = scan.find(k + 2, "=") or k
                o = scan.arguments(j + 1 + (scan.text(j + 1) == "async")) if scan.text(j) == "=" else None
                if o and (arrow := _arrow(scan, scan.closes[o] + 1)):
                    b = scan.closes[arrow + 1] if scan.text(arrow + 1) == "{" else arrow + 1
                    found.append((k, b, "functions", scan.text(k + 1), "function", scan.parts(o)))
            elif scan.text(k + 1) in ("(", "<") and t.text not in CONTROL and scan.text(scan.inside[k] if scan.inside[k] >= 0 else -1) == "{" and (o := scan.arguments(k + 1)):
                after = scan.closes[o] + 1
                if (b := after if scan.text(after) == "{" else scan.body(after) if scan.text(after) == ":" else None) is not None:
                    found.append((k, scan.closes[b], "functions", t.text, "member", scan.parts(o)))
    out, open_ = [], []
    for a, z, category, name, kind, parameters in sorted(found):
        while open_ and open_[-1][0] < a:
            open_.pop()
        around = [n for _, n in open_]
        if category == "classes":
            open_.append((z, name))
        out.append((category, name, "member" if kind == "function" and around and language != "go" else kind, scan.line(scan.tokens[a].start), scan.line(scan.tokens[z].start), parameters, ".".join(around), None))
    return sorted(out + _statements(scan, language), key=lambda n: (n[3], n[0], n[1]))


def _arrow(scan: Scan, k: int) -> int | None:
    """The arrow at token k, or behind the return type that begins there."""
    return k if scan.text(k) == "=>" else scan.find(k + 1, "=>") if scan.text(k) == ":" else None


def _statements(scan: Scan, language: str) -> list[tuple]:
    """Imports and exports, by the word that begins their line."""
    out = []
    for k, t in enumerate(scan.tokens):
        head = scan.source.rfind("\n", 0, t.start) + 1
        if t.kind != "word" or scan.source[head : t.start].strip():
            continue
        stop = scan.source.find("\n", t.start)
        line = scan.source[head : stop if stop >= 0 else len(scan.source)].strip()
        required = t.text in ("const", "let", "var") and "require(" in line
        if t.text == "import" or required or (t.text == "use" and language in ("php", "rust") and scan.inside[k] < 0):
            out.append(("imports", "", "import", scan.line(t.start), scan.line(t.start), [], "", line))
        elif t.text == "export":
            out.append(("exports", "", "export", scan.line(t.start), scan.line(t.start), [], "", line))
    return out
