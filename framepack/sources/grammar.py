"""The text format: tokens and a parser from text to values.

A document is a table in one of four layouts (rows, columnar, stream, sparse), a list of scalars, a nested object, or a scalar. Strings that
could be taken for something else are quoted, so a bare literal tells its own type; where a header declares a type, that type decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple

from framepack.errors import ParseError

#: A string of this form stands for itself; all others are quoted.
BARE = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*")
KEYWORDS = {"true", "false", "null"}
ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "t": "\t", "r": "\r"}
INTEGER_TYPES = {"u8", "u16", "u32", "u64", "i8", "i16", "i32", "i64"}

_TOKEN = re.compile(
    r"""(?P<SPACE>[ \t\r]+)|(?P<NEWLINE>\n)|(?P<COMMENT>\#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<STRING>"[^"\\]*(?:\\.[^"\\]*)*")"""
    r"""|(?P<NUMBER>-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![A-Za-z_]))|(?P<WORD>[^\W\d][\w.\-@/]*)"""
    r"""|(?P<DOUBLE_COLON>::)|(?P<STREAM>>>)|(?P<MARK>[\[\]{}():|,@?~*+\-!=<>;$.])""",
    re.S,
)


class Token(NamedTuple):
    type: str
    value: str
    line: int
    column: int


def tokenize(text: str) -> list[Token]:
    """The tokens of a text, white space and comments left out; positions count from 1. An end token closes the list."""
    return scanned(text)[0]


def scanned(text: str) -> tuple[list[Token], set[int]]:
    """The tokens, and which of them follow white space with a tab."""
    out, at, line, start = [], 0, 1, 0
    tabs: set[int] = set()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r}", line, at - start + 1, text[at])
        kind, value = m.lastgroup, m[0]
        if kind not in ("SPACE", "COMMENT"):
            name = "BOOLEAN" if kind == "WORD" and value in ("true", "false") else "NULL" if kind == "WORD" and value == "null" else kind
            out.append(Token(name, unescaped(value[1:-1]) if kind == "STRING" else value, line, at - start + 1))
        elif kind == "SPACE" and "\t" in value:
            tabs.add(len(out))
        if n := value.count("\n"):
            line, start = line + n, at + value.rindex("\n") + 1
        at = m.end()
    out.append(Token("END", "", line, at - start + 1))
    return out, tabs


def unescaped(body: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[1]), body, flags=re.S)


def quoted(s: str) -> str:
    body = s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f'"{body}"'


def scalar_text(v: Any) -> str:
    """A scalar, list or mapping as one cell."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return number(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(scalar_text(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{key_text(k)}: {scalar_text(x)}" for k, x in v.items()) + "}"
    s = str(v)
    return s if BARE.fullmatch(s) and s not in KEYWORDS else quoted(s)


def key_text(k: str) -> str:
    return k if BARE.fullmatch(k) and k not in KEYWORDS else quoted(k)


def number(x: float) -> str:
    """A float in the shortest usual notation; those that are no number are written as words and read back by their column's type."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else quoted("-Infinity")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" in text:
        mantissa, power = text.split("e")
        p = int(power)
        if -7 <= p < 0:
            digits = mantissa.replace(".", "").lstrip("-")
            return ("-" if x < 0 else "") + "0." + "0" * (-p - 1) + digits
        return f"{mantissa}e{'+' if p > 0 else '-'}{abs(p)}"
    return text


def typed(v: Any, kind: str | None) -> Any:
    """A literal as its declared type wants it."""
    if v is None or kind is None:
        return v
    if kind in ("f32", "f64"):
        return float(v)
    if kind in INTEGER_TYPES:
        return int(v)
    if kind == "bool" and isinstance(v, str):
        return v == "true"
    if kind == "str" and not isinstance(v, (str, list, dict)):
        return scalar_text(v)
    return v


class Parser:
    """Recursive descent over the tokens of one document."""

    def __init__(self, text: str):
        self.tokens, self.tabs = scanned(text)
        self.at, self.delimiter = 0, "|"

    # -- tokens ------------------------------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self, *values: str) -> Token:
        t = self.now
        if values and t.value not in values and t.type not in values:
            raise ParseError(f"expected {' or '.join(values)}, found {t.value or t.type!r}", t.line, t.column, t.value)
        self.at += 1
        return t

    def got(self, value: str) -> bool:
        if self.now.type != "STRING" and (self.now.value == value or self.now.type == value):
            self.at += 1
            return True
        return False

    def skip_lines(self) -> None:
        while self.now.type == "NEWLINE":
            self.at += 1

    # -- documents ---------------------------------------------------------------------------------------------------------------

    def document(self) -> Any:
        self.skip_lines()
        value = self._root()
        self.skip_lines()
        if self.now.type != "END":
            raise ParseError(f"unexpected {self.now.value!r} after the document", self.now.line, self.now.column, self.now.value)
        return value

    def _root(self) -> Any:
        t, nxt = self.now, self.ahead()
        if t.type in ("WORD", "STRING") and nxt.type == "DOUBLE_COLON":
            name = self.take().value
            self.take("DOUBLE_COLON")
            return {name: self._array()}
        if t.type == "DOUBLE_COLON":
            self.take()
            return self._array()
        if t.value == "[" and t.type == "MARK" and nxt.type == "NUMBER" and self.ahead(2).value == "]" and self.ahead(3).type != "END":
            return self._array()
        if t.value == "[" and t.type == "MARK" and not (nxt.type == "NUMBER" and self.ahead(2).value == "]" and self.ahead(3).value == ":"):
            return self.value()
        if t.type in ("WORD", "STRING") and nxt.value == ":":
            return self._fields("END")
        return self.value()

    def _array(self) -> list:
        self.take("[")
        n = int(self.take("NUMBER").value)
        self.take("]")
        if self.got("@"):
            layout = self.take("WORD").value
            if layout not in ("columnar", "stream", "sparse"):
                raise ParseError(f"unknown layout {layout!r}", self.now.line, self.now.column)
            return getattr(self, f"_{layout}")(n)
        if self.got(":"):
            return self._list(n)
        return self._rows(n)

    def _list(self, n: int) -> list:
        out = []
        while len(out) < n:
            if out:
                self.take(",")
            out.append(self.value())
        return out

    def _field(self) -> tuple[str, str | None]:
        name, kind = self.take("WORD", "STRING").value, None
        if self.got(":"):
            kind = self.take("WORD").value.split("@")[0]
            if self.got("("):
                kind += "(" + "".join(self._until(")")) + ")"
        if self.got("@"):
            self.take("WORD")
        return name, kind

    def _until(self, close: str) -> Iterator[str]:
        while not self.got(close):
            if self.now.type == "END":
                raise ParseError(f"expected {close}", self.now.line, self.now.column)
            yield self.take().value

    def _delimited(self, one) -> list:
        out = [one()]
        self.delimiter = self.now.value if self.now.value in ("|", ",") and self.now.type == "MARK" else "\t" if self._tabbed() else "|"
        while self._next():
            out.append(one())
        return out

    def _tabbed(self) -> bool:
        return self.at in self.tabs and self.now.type not in ("NEWLINE", "END")

    def _next(self) -> bool:
        """Goes past a delimiter, if one follows; a tab is no token of its own."""
        return self._tabbed() if self.delimiter == "\t" else self.got(self.delimiter)

    def _rows(self, n: int) -> list[dict]:
        """The compact layout: typed header, directives for compressed columns, rows."""
        fields = self._delimited(self._field) if self.now.type not in ("NEWLINE", "END") else []
        kinds = dict(fields)
        columns: dict[str, list] = {}
        entries: dict[str, list] = {}
        rows: list[list] = []
        while True:
            self.skip_lines()
            if self.now.value == "@" and self.now.type == "MARK":
                self._directive(columns, entries, kinds)
            elif len(rows) < n and self.now.type != "END":
                rows.append(self._cells(len(fields)))
            else:
                break
        out = []
        for f, values in columns.items():
            if len(values) != n:
                raise ParseError(f"column {f!r} has {len(values)} values, not {n}")
        if len(columns) < len(fields) and len(rows) != n:
            raise ParseError(f"{len(rows)} rows, not {n}", self.now.line, self.now.column)
        for i in range(n):
            out.append({f: typed(columns[f][i] if f in columns else rows[i][k], kinds[f]) for k, (f, _) in enumerate(fields)})
        return out

    def _cells(self, width: int, empty: bool = False) -> list:
        out: list = []
        while True:
            if empty and self.now.value == "|" and self.now.type == "MARK" or self.now.type in ("NEWLINE", "END"):
                out.append(None)
            elif self.got("~"):
                out.append(None)
            else:
                out.append(self.value())
            if not self._next():
                break
        if len(out) != width:
            raise ParseError(f"{len(out)} cells, not {width}", self.now.line, self.now.column)
        if self.now.type not in ("NEWLINE", "END"):
            raise ParseError(f"unexpected {self.now.value!r} in a row", self.now.line, self.now.column, self.now.value)
        return out

    def _directive(self, columns: dict, entries: dict, kinds: dict) -> None:
        self.take("@")
        kind = self.take("WORD").value
        self.take(":")
        f = self.take("WORD", "STRING").value
        if kind == "dict":
            self.take("[")
            entries[f] = []
            while not self.got("]"):
                if entries[f]:
                    self.take(",")
                entries[f].append(self.value())
        elif kind == "idx":
            at = [int(self.take("NUMBER").value)]
            while self.got(","):
                at.append(int(self.take("NUMBER").value))
            if any(i >= len(entries[f]) for i in at):
                raise ParseError(f"index beyond the dictionary of {f!r}", self.now.line, self.now.column)
            columns[f] = [entries[f][i] if i >= 0 else None for i in at]
        elif kind == "rle":
            columns[f] = []
            while True:
                v = self.value()
                columns[f] += [v] * (int(self.take("NUMBER").value) if self.got("*") else 1)
                if not self.got("|"):
                    break
        elif kind == "delta":
            v = int(self.take("NUMBER").value)
            columns[f] = [v]
            while self.got("|"):
                self.got("+")
                v += int(self.take("NUMBER").value)
                columns[f].append(v)
        elif kind == "bits":
            digits = self.take("WORD", "NUMBER", "STRING").value
            n = int(self.take("NUMBER").value)
            columns[f] = [b == "1" for b in "".join(f"{int(d, 16):04b}" for d in digits)[:n]]
        else:
            raise ParseError(f"unknown directive {kind!r}", self.now.line, self.now.column)

    def _columnar(self, n: int) -> list[dict]:
        columns: dict[str, list] = {}
        if n == 0 and (self.got(":") or self.now.type in ("NEWLINE", "END")):
            return []
        self.take("{")
        while True:
            self.skip_lines()
            if self.got("}"):
                break
            name = self.take("WORD", "STRING").value
            self.take(":")
            kind = self.take("WORD").value
            self.take(":")
            columns[name] = [typed(v, kind) for v in self._bracketed()]
            if len(columns[name]) != n:
                raise ParseError(f"column {name!r} has {len(columns[name])} values, not {n}", self.now.line, self.now.column)
        return [{f: v[i] for f, v in columns.items()} for i in range(n)]

    def _plain(self, n: int, mark: bool) -> list[dict]:
        if n == 0 and (self.got(":") or self.now.type in ("NEWLINE", "END")):
            return []

        def one() -> tuple[str, str | None]:
            f = self._field()
            if mark:
                self.got("?")
            return f

        fields = self._delimited(one)
        out = []
        for _ in range(n):
            self.take("NEWLINE")
            cells = self._cells(len(fields), mark)
            out.append({f: typed(c, k) for (f, k), c in zip(fields, cells)})
        return out

    def _stream(self, n: int) -> list[dict]:
        return self._plain(n, False)

    def _sparse(self, n: int) -> list[dict]:
        return self._plain(n, True)

    # -- values --------------------------------------------------------------------------------------------------------------------

    def value(self) -> Any:
        t = self.now
        if t.type in ("STRING", "WORD"):
            self.at += 1
            return t.value
        if t.type == "NUMBER":
            self.at += 1
            return float(t.value) if re.search("[.eE]", t.value) else int(t.value)
        if t.type == "BOOLEAN":
            self.at += 1
            return t.value == "true"
        if t.type == "NULL":
            self.at += 1
            return None
        if t.value == "[" and t.type == "MARK":
            if self.ahead().type == "NUMBER" and self.ahead(2).value == "]" and self.ahead(3).value == ":" and self.ahead(3).type == "MARK":
                return self._array()
            return self._bracketed()
        if t.value == "{" and t.type == "MARK":
            self.take()
            return self._fields("}")
        raise ParseError(f"unexpected {t.value or t.type!r}", t.line, t.column, t.value)

    def _bracketed(self) -> list:
        self.take("[")
        out: list = []
        self.skip_lines()
        while not self.got("]"):
            if out:
                self.take(",")
                self.skip_lines()
            out.append(self.value())
            self.skip_lines()
        return out

    def _fields(self, close: str) -> dict:
        out: dict[str, Any] = {}
        while True:
            while self.now.type == "NEWLINE" or self.now.value == "," and self.now.type == "MARK":
                self.at += 1
            if self.got(close) or close == "END" and self.now.type == "END":
                return out
            key = self.take("WORD", "STRING").value
            if self.got("DOUBLE_COLON"):
                out[key] = self._array()
                continue
            self.take(":")
            kind = None
            if self.now.type in ("WORD", "NULL") and self.ahead().value == ":" and self.ahead().type == "MARK":
                kind = self.take().value
                self.take(":")
            self.got(":")
            out[key] = typed(self.value(), kind)


def decode(text: str) -> Any:
    """The value of a document: {name: rows} for a named table, a list for a bare one, an object or a scalar. Text after it is an error."""
    return Parser(text).document()
