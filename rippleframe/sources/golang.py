"""Functions, calls and references of Go sources, read by tokens over whole files.

A file is cut into tokens once: comments, strings, runes and raw strings are tokens of their
own, so nothing inside them is code, and brackets are matched over lines. Texts with brackets
that never close are read as if they closed at the end. Files go through tasks as Arrow
batches, one file at a time; texts(id, text), a null text is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"(?P<skip>[ \t\r]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>`[^`]*(?:`|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<name>[^\W\d]\w*)|(?P<number>\.?[0-9](?:[eEpP][+-]|[\w.])*)|(?P<line>\n)|(?P<sign>\.\.\.|.)",
    re.DOTALL,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
# The language's keywords, and names that stub texts use without declaring them.
KEYWORDS = frozenset(
    ["break", "case", "chan", "const", "continue", "default", "defer", "else", "fallthrough", "for", "func", "go", "goto", "if", "import", "interface", "map", "package", "range", "return", "select", "struct", "switch", "type", "var"]
)
KNOWN = frozenset(
    ["nil", "true", "false", "err", "error", "string", "int", "bool", "byte", "any", "make", "len", "cap", "append", "copy", "close", "delete", "new", "panic", "recover", "print", "println", "fmt"]
)


class GoFile:
    """Tokens of a file as (kind, text, line), the partner of each bracket, and the functions it declares."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str, int]] = []
        line = 1
        for m in _TOKEN.finditer(text):
            kind, said = m.lastgroup, m.group()
            # A line that ends in a dot goes on in the next.
            if kind != "skip" and not (kind == "line" and self.tokens and self.tokens[-1][1] == "."):
                self.tokens.append((kind, said, line))
            line += said.count("\n")
        self.partner: dict[int, int] = {}
        held: list[int] = []
        for i, (kind, said, _) in enumerate(self.tokens):
            if kind != "sign":
                continue
            if said in _OPEN:
                held.append(i)
            elif said in _CLOSE:
                while held and self.tokens[held[-1]][1] != _CLOSE[said]:
                    self.partner[held.pop()] = i
                if held:
                    self.partner[i], self.partner[held[-1]] = held[-1], i
                    held.pop()
        for i in held:
            self.partner[i] = len(self.tokens)
        self._operands: dict[int, tuple[str, int]] = {}

    def said(self, i: int) -> str:
        """The token at ``i``, empty beyond the file and for strings."""
        return self.tokens[i][1] if 0 <= i < len(self.tokens) and self.tokens[i][0] != "text" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "name" and self.tokens[i][1] not in KEYWORDS

    def segments(self, opened: int) -> list[list[int]]:
        """What stands between the commas of a bracket, without empty parts and line ends."""
        parts: list[list[int]] = [[]]
        i, end = opened + 1, self.partner.get(opened, len(self.tokens))
        while i < end:
            if self.said(i) == "," and self.tokens[i][0] == "sign":
                parts.append([])
            elif self.tokens[i][0] != "line":
                stop = self.partner.get(i, i) if self.said(i) in _OPEN else i
                parts[-1].extend(range(i, min(stop, end - 1) + 1))
                i = max(i, stop)
            i += 1
        return [p for p in parts if p]

    def _declared_names(self, parts: list[list[int]]) -> list[str]:
        """Names that a list of parameters gives; none where it only has types."""

        def has_type(p: list[int]) -> bool:
            if len(p) < 2 or not self.is_name(p[0]) or self.said(p[1]) == ".":
                return False
            # a []int has a name, List[int] is a type alone.
            return self.said(p[1]) != "[" or self.partner.get(p[1], p[-1]) < p[-1]

        if not any(map(has_type, parts)):
            return []
        return [self.said(p[0]) for p in parts if self.is_name(p[0])]

    def functions(self) -> list[dict]:
        """Declared functions in order, with the tokens of their bodies."""
        found, i = [], 0
        while i < len(self.tokens):
            if self.said(i) in _OPEN and self.tokens[i][0] == "sign":
                i = self.partner.get(i, i) + 1
                continue
            if self.said(i) != "func" or self.tokens[i][0] != "name":
                i += 1
                continue
            line, at = self.tokens[i][2], i + 1
            receiver, names = "", []
            if self.said(at) == "(":
                own = self.segments(at)
                names = self._declared_names(own)
                typed = [k for k in (own[0] if own else []) if self.is_name(k)]
                if typed:
                    # (s *Srv[T]) is of Srv: the name before the brackets or the last one.
                    bracket = next((k for k in own[0] if self.said(k) == "["), own[0][-1] + 1)
                    receiver = self.said([k for k in typed if k < bracket][-1])
                at = self.partner.get(at, len(self.tokens)) + 1
            if not self.is_name(at):
                i += 1
                continue
            name, at = self.said(at), at + 1
            if self.said(at) == "[":
                at = self.partner.get(at, len(self.tokens)) + 1
            if self.said(at) != "(":
                i = at
                continue
            params = self.segments(at)
            names += self._declared_names(params)
            at = self.partner.get(at, len(self.tokens)) + 1
            results = 0
            if self.said(at) == "(":
                outs = self.segments(at)
                names += self._declared_names(outs)
                results, at = len(outs), self.partner.get(at, len(self.tokens)) + 1
            elif at < len(self.tokens) and self.said(at) != "{" and self.tokens[at][0] != "line":
                results = 1
                while at < len(self.tokens) and self.tokens[at][0] != "line" and (self.said(at) != "{" or self.said(at - 1) in ("struct", "interface")):
                    at = self.partner.get(at, len(self.tokens)) + 1 if self.said(at) in _OPEN else at + 1
            body = range(0)
            if self.said(at) == "{":
                body = range(at + 1, min(self.partner.get(at, len(self.tokens)), len(self.tokens)))
                at = body.stop + 1
            found.append({"line": line, "name": name, "receiver": receiver, "params": len(params), "results": results, "body": body, "locals": {name, *names}})
            i = max(at, i + 1)
        return found

    def _operand(self, j: int) -> tuple[str, int]:
        """What ends at a token: its name with selectors, empty for anything but names, and where it begins."""
        if j not in self._operands:
            self._operands[j] = self._read_operand(j)
        return self._operands[j]

    def _read_operand(self, j: int) -> tuple[str, int]:
        said = self.said(j)
        if self.is_name(j):
            if self.said(j - 1) == ".":
                before, start = self._operand(j - 2)
                return (f"{before}.{said}" if before else said), start
            # []byte(x) turns one type into another.
            return ("", j - 1) if self.said(j - 1) == "]" else (said, j)
        opened = self.partner.get(j, -1) if said in _CLOSE else -1
        if opened < 0:
            return "", j
        if said == "]":
            return self._operand(opened - 1) if self.is_name(opened - 1) or self.said(opened - 1) in _CLOSE else ("", opened)
        if self.said(opened - 1) == ".":
            return "", self._operand(opened - 2)[1]
        if self.is_name(opened - 1) or self.said(opened - 1) in (")", "]"):
            return "", self._operand(opened - 1)[1]
        return "", opened

    def calls(self, body: range) -> list[tuple[int, str, int]]:
        """Line, callee with its selectors and number of arguments of each call."""
        found, i = [], body.start
        while i < body.stop:
            if self.said(i) == "interface" and self.said(i + 1) == "{":
                # Methods of an interface look like calls.
                i = self.partner.get(i + 1, i + 1) + 1
                continue
            if self.said(i) == "(" and (self.is_name(i - 1) or self.said(i - 1) == "]"):
                callee, start = self._operand(i - 1)
                if callee and self.said(start - 1) != "func":
                    found.append((self.tokens[start][2], callee, len(self.segments(i))))
            i += 1
        return found

    def references(self) -> tuple[str, str, list[str]] | None:
        """Name, receiver and what the first function refers to: selectors, and names but its parameters and known ones."""
        declared = self.functions()
        if not declared:
            return None
        first = declared[0]
        own, found = first["locals"], set()
        for i in first["body"]:
            if not self.is_name(i):
                continue
            said = self.said(i)
            if self.said(i + 1) == "." and self.is_name(i + 2) and self.said(i - 1) != ".":
                found.add(self.said(i + 2) if said in own else f"{said}.{self.said(i + 2)}")
            if said not in own and said not in KNOWN and len(said) > 1:
                found.add(said)
        return first["name"], first["receiver"], sorted(found)


def _rows(schema: str, of):
    """A task that gives the rows of ``of(id, text)`` for each file."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(of(ident, text or ""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[s.split()[1]]) for c, s in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)

    return run


def _read(texts: DataFrame, schema: str, of) -> DataFrame:
    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(_rows(schema, of), schema)


def functions(texts: DataFrame) -> DataFrame:
    """id, line, name, receiver, params, results of each declared function; grouped and unnamed ones are counted alike."""

    def of(ident, text):
        return ((ident, f["line"], f["name"], f["receiver"], f["params"], f["results"]) for f in GoFile(text).functions())

    return _read(texts, "id string, line int, name string, receiver string, params int, results int", of)


def calls(texts: DataFrame) -> DataFrame:
    """id, line, caller, callee, full, args: calls in declared functions; ``full`` keeps the selectors, callee is its last part."""

    def of(ident, text):
        file = GoFile(text)
        return ((ident, line, f["name"], full.rsplit(".", 1)[-1], full, args) for f in file.functions() for line, full, args in file.calls(f["body"]))

    return _read(texts, "id string, line int, caller string, callee string, full string, args int", of)


def names(texts: DataFrame) -> DataFrame:
    """id, kind, name: declared functions (kind function) and calls in them (kind call, the callee's last part), in one reading.

    Texts are dealt to four tasks a core: few large ones would otherwise be read by one or two.
    """

    def of(ident, text):
        file = GoFile(text)
        for f in file.functions():
            yield ident, "function", f["name"]
            for _, full, _ in file.calls(f["body"]):
                yield ident, "call", full.rsplit(".", 1)[-1]

    dealt = texts.select("id", "text").repartition(4 * texts.sparkSession.sparkContext.defaultParallelism)
    return _read(dealt, "id string, kind string, name string", of)


def stub_references(texts: DataFrame) -> DataFrame:
    """id, name, receiver, references: what the first function of a stub needs that it does not declare."""

    def of(ident, text):
        found = GoFile(text).references()
        return [(ident, *found)] if found else []

    return _read(texts, "id string, name string, receiver string, references array<string>", of)
