"""Java sources to nodes, edges, symbols and queued calls.

A small lexer and a recursive-descent reader of declarations: packages,
imports, types, methods, constructors, lambdas and invocations.  Statements are
not parsed, only scanned for invocations and lambdas within balanced brackets.
Every declaration is visited once.  A file that does not parse gives an error
and no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from symgraph.extract import common
from symgraph.extract.common import BLANK_NODE, Parsed
from symgraph.schema import synthetic_usr

# Fixed values of the Java language.
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non-sealed".split())
_NOT_CALLS = frozenset("if for while switch catch synchronized return throw assert new super this else do try instanceof case yield".split())
_PRIMITIVES = frozenset("void boolean byte short char int long float double var".split())

_LEXER = re.compile(
    r"(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<number>\d[\w.]*)|(?P<word>non-sealed|[^\W\d][\w$]*)|(?P<arrow>->)|(?P<sign>::|\.\.\.|.)", re.S
)


class SyntaxTrouble(ValueError):
    """A source that cannot be read as Java."""


@dataclass
class Token:
    text: str
    kind: str
    line: int


def tokens_of(source: str) -> list[Token]:
    out, line = [], 1
    for m in _LEXER.finditer(source):
        if m.lastgroup != "space":
            if m.lastgroup == "sign" and m[0] in "\"'":
                raise SyntaxTrouble(f"line {line}: an open literal")
            out.append(Token(m[0], m.lastgroup, line))
        elif m[0].startswith("/*") and not m[0].endswith("*/"):
            raise SyntaxTrouble(f"line {line}: an open comment")
        line += m[0].count("\n")
    return out


class _Reader:
    def __init__(self, source: str, file: str):
        self.t, self.i, self.file, self.out = tokens_of(source), 0, file, Parsed()
        self.package, self.imports, self.lambdas = "", [], 0
        self._match()

    def _match(self) -> None:
        """For each opening bracket the place of its closing one."""
        pairs, stack, self.close = {"(": ")", "{": "}", "[": "]"}, [], {}
        for k, token in enumerate(self.t):
            if token.kind != "sign":
                continue
            if token.text in pairs:
                stack.append(k)
            elif token.text in ")}]":
                if not stack or pairs[self.t[stack[-1]].text] != token.text:
                    raise SyntaxTrouble(f"line {token.line}: a stray {token.text}")
                self.close[stack.pop()] = k
        if stack:
            raise SyntaxTrouble(f"line {self.t[stack[-1]].line}: an open {self.t[stack[-1]].text}")

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def _dotted(self) -> str:
        parts = []
        while self.i < len(self.t):
            if self.t[self.i].kind == "word" or self.at() == "*":
                parts.append(self.at())
                self.i += 1
                if self.at() == ".":
                    self.i += 1
                    continue
            break
        return ".".join(parts)

    def _annotations(self) -> list[str]:
        """Skip annotations and modifiers; all their words."""
        found = []
        while self.i < len(self.t):
            if self.at() == "@" and self.at(1) != "interface":
                self.i += 1
                found.append("@" + self._dotted())
                if self.at() == "(":
                    self.i = self.close[self.i] + 1
            elif self.at() in _MODIFIERS and not (self.at() in ("sealed", "default") and self.at(1) in ("(", "=", ".", ":", "->")):
                found.append(self.at())
                self.i += 1
            else:
                return found
        return found

    def _generics(self) -> None:
        if self.at() != "<":
            return
        depth = 0
        while self.i < len(self.t):
            depth += {"<": 1, ">": -1}.get(self.at(), 0)
            self.i += 1
            if depth == 0:
                return
        raise SyntaxTrouble("an open <")

    def _type(self) -> str:
        """A type's simple name, without arguments and dimensions."""
        self._annotations()
        name = ""
        while self.i < len(self.t) and (self.t[self.i].kind == "word" or self.at() == "?"):
            name = self.at()
            self.i += 1
            self._generics()
            if self.at() == "." and self.i + 1 < len(self.t) and self.t[self.i + 1].kind == "word":
                self.i += 1
                continue
            break
        while self.at() == "[" and self.at(1) == "]":
            self.i += 2
        return name

    def _full_type(self) -> str:
        start, parts = self.i, []
        while self.i < len(self.t) and self.t[self.i].kind == "word":
            parts.append(self.at())
            self.i += 1
            self._generics()
            if self.at() != ".":
                break
            self.i += 1
        if self.i == start:
            raise SyntaxTrouble(f"line {self.t[min(start, len(self.t) - 1)].line}: a type is missing")
        return ".".join(parts)

    def _types(self, *stops: str) -> list[str]:
        found = []
        while self.at() not in stops and self.i < len(self.t):
            self._annotations()
            found.append(self._full_type())
            if self.at() in (",", "&"):
                self.i += 1
        return found

    def type_fqn(self, name: str) -> str:
        """A type name by the rules of one file: dotted, imported, first package import, own package."""
        if "." in name:
            return name
        for imported in self.imports:
            if imported.endswith("." + name):
                return imported
            if imported.endswith(".*"):
                return imported[:-1] + name
        return f"{self.package}.{name}" if self.package else name

    def file_unit(self) -> Parsed:
        self._annotations()
        if self.at() == "package":
            self.i += 1
            self.package = self._dotted()
            self._semicolon()
        while self.at() == "import":
            self.i += 1
            if self.at() == "static":
                self.i += 1
            self.imports.append(self._dotted())
            self._semicolon()
        while self.i < len(self.t):
            if self.at() == ";":
                self.i += 1
                continue
            words = self._annotations()
            if not self._type_declaration(words, None, None):
                raise SyntaxTrouble(f"line {self.t[min(self.i, len(self.t) - 1)].line}: a type declaration is missing")
        return self.out

    def _semicolon(self) -> None:
        if self.at() != ";":
            raise SyntaxTrouble(f"line {self.t[min(self.i, len(self.t) - 1)].line}: a semicolon is missing")
        self.i += 1

    def _edge(self, source: str, target: str, relationship: str, line: int) -> None:
        self.out.edges.append({"source_usr": source, "target_usr": target, "relationship": relationship, "file": self.file, "line": line})

    def _node(self, label: str, **row) -> None:
        self.out.nodes.append({"label": label, **BLANK_NODE, "file": self.file, "language": "java", **row})

    def _type_declaration(self, words: list[str], outer: str | None, outer_usr: str | None) -> bool:
        keyword = self.at()
        if keyword == "@" and self.at(1) == "interface":
            self.i += 1
            keyword = "interface"
        if keyword not in ("class", "interface", "enum", "record") or self.i + 1 >= len(self.t) or self.t[self.i + 1].kind != "word" or keyword == "record" and self.at(2) not in ("(", "<"):
            return False
        line, name = self.t[self.i].line, self.at(1)
        self.i += 2
        fqn = f"{outer}.{name}" if outer else f"{self.package}.{name}" if self.package else name
        usr = synthetic_usr(fqn, self.file, line)
        kind = "interface" if keyword == "interface" else "class"
        self._node("Class", usr=usr, name=name, fqn=fqn, namespace=self.package, line=line, kind=kind, is_abstract=kind == "interface" or "abstract" in words)
        self.out.symbols.append({"fqn": fqn, "usr": usr, "kind": kind, "file": self.file, "line": line, "language": "java", "signature": None, "parent_fqn": outer or self.package or None})
        self._generics()
        if self.at() == "(":
            self.i = self.close[self.i] + 1
        while self.at() in ("extends", "implements", "permits"):
            word = self.at()
            self.i += 1
            for base in self._types("{", "extends", "implements", "permits"):
                if word != "permits":
                    # the target is a name until the symbol table knows its place
                    self._edge(usr, synthetic_usr(self.type_fqn(base), "", 0), "INHERITS_FROM" if word == "extends" else "IMPLEMENTS", line)
                    self.out.calls.append(self._call(None, self.type_fqn(base), 0, usr, fqn, fqn, line, False) | {"kind": "INHERITS_FROM" if word == "extends" else "IMPLEMENTS"})
        if self.at() != "{":
            raise SyntaxTrouble(f"line {line}: the body of {name} is missing")
        self._members(name, fqn, usr, self.close[self.i], keyword)
        return True

    def _members(self, name: str, fqn: str, usr: str, end: int, keyword: str) -> None:
        self.i += 1
        if keyword == "enum":
            while self.i < end and self.at() != ";":
                self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
        while self.i < end:
            if self.at() == ";":
                self.i += 1
                continue
            words = self._annotations()
            if self.at() == "{":
                self.i = self.close[self.i] + 1
                continue
            if self._type_declaration(words, fqn, usr):
                continue
            self._generics()
            if self.at() == name and self.at(1) == "(":
                self._method(words, name, fqn, usr, keyword, constructor=True)
                continue
            before = self.i
            if not self._type():
                raise SyntaxTrouble(f"line {self.t[self.i].line}: a member is missing")
            if self.i < end and self.t[self.i].kind == "word" and self.at(1) == "(":
                self._method(words, self.at(), fqn, usr, keyword, constructor=False)
            elif self.at() == "{" and keyword == "record" and self.t[before].text == name:
                self.i = self.close[self.i] + 1
            else:  # a field
                while self.i < end and self.at() != ";":
                    self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
        self.i = end + 1

    def _parameters(self) -> list[str]:
        end, found = self.close[self.i], []
        self.i += 1
        while self.i < end:
            kind = self._type()
            if self.at() == "...":
                self.i += 1
            if kind and self.at() != "." and not (self.at() == "this"):
                found.append(kind)
            while self.i < end and self.at() != ",":
                self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
            self.i += 1
        self.i = end + 1
        return found

    def _method(self, words: list[str], name: str, class_fqn: str, class_usr: str, keyword: str, constructor: bool) -> None:
        line = self.t[self.i].line
        self.i += 1
        signature = ", ".join(self._parameters())
        while self.at() not in ("{", ";", "default", ""):
            self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
        if self.at() == "default":
            while self.at() not in (";", ""):
                self.i = self.close[self.i] + 1 if self.i in self.close else self.i + 1
        fqn = f"{class_fqn}.{name}({signature})"
        usr = synthetic_usr(fqn, self.file, line)
        static = "static" in words
        pure = not constructor and ("abstract" in words or keyword == "interface" and self.at() == ";" and not static)
        virtual = not constructor and not static and not {"final", "private"} & set(words)
        self._node("Function", usr=usr, name=name, fqn=fqn, line=line, kind="constructor" if constructor else "function", signature=signature, parent_fqn=class_fqn, is_virtual=virtual, is_pure_virtual=pure, is_static=static, is_const=False)
        self._edge(class_usr, usr, "DEFINES", line)
        self.out.symbols.append({"fqn": fqn, "usr": usr, "kind": "constructor" if constructor else "method", "file": self.file, "line": line, "language": "java", "signature": signature, "parent_fqn": class_fqn})
        if "@Override" in words:
            self.out.calls.append(self._call("super", name, len(signature.split(",")) if signature else 0, usr, fqn, class_fqn, line, False) | {"kind": "OVERRIDES"})
        if self.at() == "{":
            end = self.close[self.i]
            self.lambdas = 0
            self._body(self.i + 1, end, usr, fqn, class_fqn, fqn)
            self.i = end + 1
        elif self.at() == ";":
            self.i += 1

    def _call(self, qualifier, member, count, usr, fqn, class_fqn, line, constructor) -> dict:
        return {
            "qualifier": qualifier, "member": member, "arguments_count": count, "caller_usr": usr, "caller_fqn": fqn, "class_fqn": class_fqn, "package": self.package,
            "imports": list(self.imports), "file": self.file, "line": line, "is_constructor": constructor, "kind": "CALLS",
        }

    def _count(self, opening: int) -> int:
        """Arguments between a bracket and its closing one."""
        k, end, commas, angle = opening + 1, self.close[opening], 0, 0
        if k == end:
            return 0
        while k < end:
            if k in self.close:
                k = self.close[k]
            elif self.t[k].text == "<" and k + 1 < end and self.t[k - 1].kind == "word" and self.t[k - 1].text[:1].isupper():
                angle += 1
            elif self.t[k].text == ">" and angle:
                angle -= 1
            elif self.t[k].text == "," and not angle:
                commas += 1
            k += 1
        return commas + 1

    def _qualifier(self, k: int) -> str | None:
        """The names before a dot at ``k``: a.b of a.b.c(, or None if an expression stands there."""
        parts = []
        while k > 0 and self.t[k].text == "." and self.t[k - 1].kind == "word":
            parts.append(self.t[k - 1].text)
            k -= 2
        if k >= 0 and self.t[k].text == ".":
            return ""
        return ".".join(reversed(parts)) or None

    def _body(self, k: int, end: int, usr: str, fqn: str, class_fqn: str, method_fqn: str) -> None:
        """Invocations and lambdas of a stretch of code."""
        while k < end:
            token = self.t[k]
            follows = self.t[k + 1].text if k + 1 < end else ""
            if token.kind == "arrow" and self._is_lambda(k):
                k = self._lambda(k, end, usr, class_fqn, method_fqn)
                continue
            if token.kind == "word" and token.text == "new":
                j, parts = k + 1, []
                while j < end and self.t[j].kind == "word":
                    parts.append(self.t[j].text)
                    j += 1
                    if j < end and self.t[j].text == "<":
                        depth = 0
                        while j < end:
                            depth += {"<": 1, ">": -1}.get(self.t[j].text, 0)
                            j += 1
                            if not depth:
                                break
                    if j < end and self.t[j].text == ".":
                        j += 1
                        continue
                    break
                if j < end and self.t[j].text == "(" and parts and parts[-1] not in _PRIMITIVES:
                    self.out.calls.append(self._call(None, ".".join(parts), self._count(j), usr, fqn, class_fqn, token.line, True))
                    k = j
                    continue
            elif token.kind == "word" and follows == "(" and (token.text not in _NOT_CALLS or token.text in ("this", "super")):
                before = self.t[k - 1].text
                if token.text in ("this", "super"):
                    if before != ".":  # a constructor calls another
                        own = class_fqn if token.text == "this" else "super"
                        self.out.calls.append(self._call("super" if token.text == "super" else None, own if token.text == "this" else "super", self._count(k + 1), usr, fqn, class_fqn, token.line, token.text == "this"))
                elif before == ".":
                    qualifier = self._qualifier(k - 1)
                    self.out.calls.append(self._call(qualifier if qualifier != "" else "()", token.text, self._count(k + 1), usr, fqn, class_fqn, token.line, False))
                elif self.t[k - 1].kind != "word" or before in _NOT_CALLS:
                    self.out.calls.append(self._call(None, token.text, self._count(k + 1), usr, fqn, class_fqn, token.line, False))
            k += 1

    def _is_lambda(self, k: int) -> bool:
        """An arrow after parameters; not one of a switch."""
        if self.t[k - 1].text == ")":
            return True
        j = k - 1
        return self.t[j].kind == "word" and self.t[j - 1].text not in ("case", "default", ",", ".") and self.t[j].text != "default" or self.t[j].kind == "word" and self.t[j - 1].text == "," and "case" not in [x.text for x in self.t[max(0, j - 8) : j]]

    def _lambda(self, k: int, end: int, usr: str, class_fqn: str, method_fqn: str) -> int:
        line, number = self.t[k].line, self.lambdas
        self.lambdas += 1
        fqn = f"{method_fqn}::lambda${number}@L{line}"
        own = synthetic_usr(fqn, self.file, line)
        self._node("Function", usr=own, name=f"lambda${number}", fqn=fqn, line=line, kind="lambda", signature="", parent_fqn=class_fqn, is_virtual=False, is_pure_virtual=False, is_static=False, is_const=False)
        self._edge(usr, own, "CALLS", line)
        j = k + 1
        if j < end and self.t[j].text == "{":
            stop = self.close[j]
            self._body(j + 1, stop, own, fqn, class_fqn, method_fqn)
            return stop + 1
        stop = j
        while stop < end and self.t[stop].text not in (",", ";", ")", "}"):
            stop = self.close[stop] + 1 if stop in self.close else stop + 1
        self._body(j, min(stop, end), own, fqn, class_fqn, method_fqn)
        return stop


def parse(source: bytes | str, file: str) -> Parsed:
    """What one source holds; on a syntax error no rows and the error."""
    text = source.decode("utf-8", errors="replace") if isinstance(source, bytes | bytearray) else source
    try:
        return _Reader(text, file).file_unit()
    except (SyntaxTrouble, IndexError, KeyError, RecursionError) as error:
        return Parsed(errors=[f"{file}: {error or type(error).__name__}"], diagnostics=[{"severity": "fatal", "line": 0, "message": str(error) or type(error).__name__}])


def extract(files: DataFrame) -> DataFrame:
    """One row for each Java file (path, content), as ``common.extract`` gives it."""
    return common.extract(files, parse)
