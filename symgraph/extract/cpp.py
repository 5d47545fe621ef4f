"""C++ sources to nodes, edges, symbols and queued references.

A lexer and a tolerant reader of declarations, without a preprocessor and
without types but those it sees declared: namespaces, classes, functions with
their qualifiers, bases, lambdas, and calls in bodies.  What it cannot read it
passes over with a diagnostic.  A declaration is visited once, and belongs to
the class that its qualified name says, wherever it is defined.

A reference is queued with the scopes that its name may belong to, innermost
first; which of them has it is decided by joins with the symbol table
(``symbols.resolve_scoped``).  The receiver of a member call is known if it is
``this``, a parameter, a local variable or a field of the class in this file.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from symgraph.extract import common
from symgraph.extract.common import BLANK_NODE, Parsed

# Fixed values of the language.
_KEYWORDS = frozenset(
    "alignas alignof and asm auto bool break case catch char class const constexpr const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept not nullptr operator or private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this throw true try typedef typeid typename union unsigned using virtual void volatile while".split()
)
_TYPE_WORDS = frozenset("void bool char short int long float double signed unsigned auto const volatile struct class enum typename constexpr".split())
_SPECIFIERS = frozenset("static virtual inline explicit constexpr extern friend mutable register typename".split())
_OPENING = {"(": ")", "{": "}", "[": "]"}

_LEXER = re.compile(
    r'(?P<space>\s+|\\\r?\n|//[^\n]*|/\*.*?(?:\*/|$))|(?P<hash>(?<![^\n])[ \t]*\#(?:\\\r?\n|[^\n])*)|(?P<raw>(?:u8|[uUL])?R"(?P<mark>[^\s()\\]{0,16})\(.*?\)(?P=mark)")'
    r'|(?P<text>(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?)|(?P<number>\.?\d(?:[\w.\']|[eEpP][+-])*)|(?P<word>[^\W\d]\w*)|(?P<sign>::|->|\.\.\.|<<=|&&|\|\||.)',
    re.S,
)


class Token:
    __slots__ = ("column", "kind", "line", "text")

    def __init__(self, text: str, kind: str, line: int, column: int):
        self.text, self.kind, self.line, self.column = text, kind, line, column


def tokens_of(source: str) -> list[Token]:
    out, line, begin = [], 1, 0
    for m in _LEXER.finditer(source):
        kind = m.lastgroup if m.lastgroup != "mark" else "raw"
        if kind not in ("space", "hash"):
            out.append(Token(m[0], "text" if kind == "raw" else kind, line, m.start() - begin + 1))
        if "\n" in m[0]:
            line += m[0].count("\n")
            begin = m.start() + m[0].rindex("\n") + 1
    return out


def usr_of(fqn: str, signature: str | None = None, file: str = "") -> str:
    """The same for all declarations of a class or function; ``file`` only for what is private to one."""
    return "cpp@" + hashlib.sha256(f"{fqn}({signature})::{file}".encode() if signature is not None else fqn.encode()).hexdigest()[:24]


def _joined(*parts: str) -> str:
    return "::".join(p for p in parts if p)


def _spelled(tokens: list[Token]) -> str:
    """Tokens of a type as they are usually written."""
    out = ""
    for t in tokens:
        if t.text in ("::", "<", ">", ",", "...") or out.endswith(("::", "<")) or not out:
            out += t.text + (" " if t.text == "," else "")
        elif t.text in "*&" or t.text == "&&":
            out += t.text if out[-1] in "*&" else f" {t.text}"
        elif t.kind in ("word", "number"):
            out += t.text if out.endswith(", ") else f" {t.text}"
        else:
            out += t.text
    return out


class _Scope:
    """Where a declaration stands: namespaces, classes (by name and usr) and the namespaces in use."""

    def __init__(self, namespace: str = "", name: str | None = None, usr: str | None = None, using: tuple[str, ...] = (), fields: dict[str, str] | None = None):
        self.namespace, self.name, self.usr, self.using, self.fields = namespace, name, usr, using, fields or {}

    def around(self) -> list[str]:
        """The scopes that a name is looked for in: classes and namespaces from the inside out, the global one, those in use."""
        own, found = self.name or self.namespace, []
        while own:
            found.append(own)
            own = own.rpartition("::")[0]
        return list(dict.fromkeys([*found, "", *self.using]))


class _Reader:
    def __init__(self, source: str, file: str):
        self.t, self.i, self.file, self.out = tokens_of(source), 0, file, Parsed()
        self.close: dict[int, int] = {}
        self.classes: set[str] = set()
        self.namespaces: set[str] = set()
        self.angle: dict[int, int] = {}
        self.fields: dict[str, dict[str, str]] = {}
        self._match()
        self._match_angles()

    def _note(self, severity: str, line: int, message: str) -> None:
        self.out.diagnostics.append({"severity": severity, "line": line, "message": message})

    def _match(self) -> None:
        """For each opening bracket its closing one; what is left open ends with the file, what is stray is passed over."""
        stack: list[int] = []
        for k, token in enumerate(self.t):
            if token.kind != "sign":
                continue
            if token.text in _OPENING:
                stack.append(k)
            elif token.text in ")}]":
                depth = next((d for d in range(len(stack) - 1, max(-1, len(stack) - 4), -1) if _OPENING[self.t[stack[d]].text] == token.text), None)
                if depth is None:
                    self._note("error", token.line, f"a stray {token.text}")
                    continue
                for k_open in stack[depth + 1 :]:
                    self._note("error", self.t[k_open].line, f"an open {self.t[k_open].text}")
                    self.close[k_open] = k
                del stack[depth + 1 :]
                self.close[stack.pop()] = k
        for k_open in stack:
            self._note("error", self.t[k_open].line, f"an open {self.t[k_open].text}")
            self.close[k_open] = len(self.t)

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def _match_angles(self) -> None:
        """For each ``<`` that may open template arguments its ``>``, in one pass: no statement, block or bracket lies between them by halves."""
        levels: list[list[int]] = [[]]
        ends = {k_close for k_close in self.close.values()}
        for k, token in enumerate(self.t):
            if token.text == "<":
                levels[-1].append(k)
            elif token.text == ">":
                if levels[-1]:
                    self.angle[levels[-1].pop()] = k
            elif token.text in (";", "{", "}", "||"):
                levels[-1].clear()
            if k in ends and len(levels) > 1 and token.text in (")", "]"):
                levels.pop()
            elif token.kind == "sign" and token.text in ("(", "["):
                levels.append([])

    def _angles(self, k: int, end: int) -> int:
        """The place behind a template argument list that opens at ``k``, or ``k`` if it is none."""
        close = self.angle.get(k, end)
        return close + 1 if close < end else k

    def _name(self, k: int, end: int) -> tuple[str, int]:
        """A qualified name at ``k`` without template arguments, and the place behind it."""
        parts: list[str] = []
        j = k
        if j < end and self.t[j].text == "::":
            j += 1
        while j < end and self.t[j].kind == "word":
            parts.append(self.t[j].text)
            j += 1
            if j < end and self.t[j].text == "<":
                j = self._angles(j, end)
            if j + 1 < end and self.t[j].text == "::" and self.t[j + 1].kind == "word":
                j += 1
                continue
            break
        return "::".join(parts), j

    def _skip(self, end: int) -> None:
        """Behind the declaration that stands here."""
        while self.i < end:
            text = self.at()
            if text in _OPENING:
                self.i = self.close[self.i] + 1
                if text == "{" and self.at() not in (";", ",", "=", "*", "&") and not (self.i < end and self.t[self.i].kind == "word" and self.at(1) in (";", ",", "=", "[")):
                    return
                continue
            self.i += 1
            if text == ";":
                return

    def unit(self) -> Parsed:
        self.block(len(self.t), _Scope())
        return self.out

    def block(self, end: int, scope: _Scope) -> None:
        """The declarations up to ``end``."""
        while self.i < end:
            before, text = self.i, self.at()
            if text == ";" or text in ("public", "private", "protected", "signals", "slots") and self.at(1) in (":", "slots", "Q_SLOTS"):
                self.i += 1
                while text != ";" and self.i < end and self.t[self.i - 1].text != ":":
                    self.i += 1
            elif text == "inline" and self.at(1) == "namespace":
                self.i += 1
            elif text == "namespace":
                self._namespace(end, scope)
            elif text == "extern" and self.i + 2 < end and self.t[self.i + 1].kind == "text" and self.at(2) == "{":
                stop = self.close[self.i + 2]
                self.i += 3
                self.block(min(stop, end), scope)
                self.i = stop + 1
            elif text == "using":
                if self.at(1) == "namespace":
                    name, _ = self._name(self.i + 2, end)
                    scope.using = (*scope.using, *(_joined(s, name) for s in _Scope(scope.namespace).around()))
                self._skip(end)
            elif text == "template":
                self.i = self._angles(self.i + 1, end)
                if self.i == before + 1 or self.i == before:
                    self.i = before + 1
            elif text in ("typedef", "enum", "union", "static_assert", "asm", "friend"):
                self._skip(end)
            elif text in ("class", "struct") and self._class(end, scope):
                pass
            elif text in ("}", ")", "]"):
                self.i += 1
            else:
                self._declaration(end, scope)
            if self.i <= before:
                self.i = before + 1

    def _namespace(self, end: int, scope: _Scope) -> None:
        name, j = self._name(self.i + 1, end)
        while j < end and self.t[j].text == "[":
            j = self.close[j] + 1
        if j >= end or self.t[j].text != "{":
            self._skip(end)
            return
        own, stop = _joined(scope.namespace, name), self.close[j]
        self.namespaces.add(own)
        self.i = j + 1
        self.block(min(stop, end), _Scope(own, None, None, scope.using))
        self.i = stop + 1

    def _class(self, end: int, scope: _Scope) -> bool:
        """A class with its body, if that is what stands here."""
        j, line, name = self.i + 1, self.t[self.i].line, ""
        while j < end and self.t[j].text not in ("{", ";", ":", "(", "=", ")", ",", ">"):
            if self.t[j].text == "[":
                j = self.close[j] + 1
            elif self.t[j].text == "alignas" and j + 1 < end and self.t[j + 1].text == "(":
                j = self.close[j + 1] + 1
            elif self.t[j].kind == "word" and self.t[j].text != "final":
                line = self.t[j].line
                name, j = self._name(j, end)
            elif self.t[j].text == "final":
                j += 1
            else:
                return False
        if j >= end or self.t[j].text not in ("{", ":", ";"):
            return False
        if self.t[j].text == ";" or not name:
            if self.t[j].text == ";":
                self.i = j + 1
            else:
                self._skip(end)
            return True
        bases = []
        if self.t[j].text == ":":
            j += 1
            while j < end and self.t[j].text not in ("{", ";"):
                if self.t[j].text in ("public", "private", "protected", "virtual", ","):
                    j += 1
                elif self.t[j].kind == "word" or self.t[j].text == "::":
                    base, after = self._name(j, end)
                    bases.append((base, self.t[j].line))
                    j = max(after, j + 1)
                else:
                    j += 1
            if j >= end or self.t[j].text != "{":
                return False
        fqn = _joined(scope.name or scope.namespace, name)
        usr, stop = usr_of(fqn), min(self.close[j], end)
        self.classes.add(fqn)
        fields = self.fields[fqn] = self._fields(j + 1, stop)
        inner = _Scope(scope.namespace, fqn, usr, scope.using, fields)
        node = {"label": "Class", **BLANK_NODE, "usr": usr, "name": name.rpartition("::")[2], "fqn": fqn, "namespace": scope.namespace, "file": self.file, "line": line, "language": "cpp", "kind": "class", "is_abstract": False}
        self.out.nodes.append(node)
        self.out.symbols.append({"fqn": fqn, "usr": usr, "kind": "class", "file": self.file, "line": line, "language": "cpp", "signature": None, "parent_fqn": scope.namespace or None})
        for base, at in bases:
            outer, _, last = base.rpartition("::")
            self._queue("INHERITS_FROM", outer or None, last, 0, usr, fqn, fqn, scope, at, [_joined(s, outer) for s in scope.around()])
        first = len(self.out.nodes)
        self.i = j + 1
        self.block(stop, inner)
        node["is_abstract"] = any(n["is_pure_virtual"] and n["parent_fqn"] == fqn for n in self.out.nodes[first:])
        self.i = stop + 1
        return True

    def _fields(self, k: int, end: int) -> dict[str, str]:
        """Types of the fields of a class body."""
        found: dict[str, str] = {}
        while k < end:
            if self.t[k].text in _OPENING:
                k = self.close[k] + 1
                continue
            k = self._variable(k, end, found, (";", "=", "{", "["))
        return found

    def _variable(self, k: int, end: int, found: dict[str, str], stops: tuple[str, ...]) -> int:
        """Take up the variable that is declared at ``k``, if one is; the next place to look at."""
        if self.t[k].kind != "word" or k and self.t[k - 1].text not in ("{", "}", ";", ":", "(", ",", "const", "static", "mutable", "constexpr", "&"):
            return k + 1
        if self.t[k].text in _KEYWORDS:
            return k + 1
        name, j = self._name(k, end)
        if name.endswith(("shared_ptr", "unique_ptr", "weak_ptr")) and self.t[j - 1].text == ">":
            inside = next((x for x in range(k, j) if self.t[x].text == "<"), k)
            name = self._name(inside + 1, j)[0] or name
        while j < end and self.t[j].text in ("*", "&", "&&", "const"):
            j += 1
        if j < end and self.t[j].kind == "word" and self.t[j].text not in _KEYWORDS and j + 1 <= end and (j + 1 == end or self.t[j + 1].text in stops):
            found[self.t[j].text] = name
            return j + 1
        return k + 1

    def _parameters(self, opening: int) -> tuple[list[str], dict[str, str], int]:
        """Types of a parameter list, types by names, and how many parameters must be given."""
        end, types, named, needed = self.close[opening], [], {}, 0
        k = opening + 1
        while k < end:
            part: list[Token] = []
            start, given = k, False
            while k < end and self.t[k].text != ",":
                text = self.t[k].text
                if text == "=":
                    given = True
                if text == "<" and (after := self._angles(k, end)) > k:
                    part += [] if given else self.t[k:after]
                    k = after
                elif text in _OPENING:
                    after = self.close[k] + 1
                    if text == "[" and part and self.t[k + 1].text == "[":
                        pass
                    elif not given:
                        part += self.t[k:after]
                    k = after
                else:
                    part += [] if given else [self.t[k]]
                    k += 1
            k += 1
            words = [x for x in part if x.text not in ("register", "typename")]
            array = 0
            while len(words) > 2 and words[-1].text == "]":
                at = max(x for x in range(len(words)) if words[x].text == "[")
                words, array = words[:at], array + 1
            if len(words) > 1 and words[-1].kind == "word" and words[-1].text not in _TYPE_WORDS and words[-2].text != "::" and not all(w.text in ("const", "volatile") for w in words[:-1]):
                name = words.pop()
                self._variable_of(words, name.text, named, start, end)
            spelled = _spelled(words) + " *" * array
            if spelled and not (spelled == "void" and not types and k >= end):
                types.append(spelled)
                needed += not given
        return types, named, needed

    def _variable_of(self, words: list[Token], name: str, named: dict[str, str], start: int, end: int) -> None:
        at = start
        while at < end and (self.t[at].text in _TYPE_WORDS or self.t[at].kind != "word"):
            at += 1
        kind, j = self._name(at, end)
        if kind.endswith(("shared_ptr", "unique_ptr", "weak_ptr")) and self.t[j - 1].text == ">":
            inside = next((x for x in range(at, j) if self.t[x].text == "<"), at)
            kind = self._name(inside + 1, j)[0] or kind
        if kind and any(w.kind == "word" and w.text == kind.rpartition("::")[2] for w in words):
            named[name] = kind

    def _declaration(self, end: int, scope: _Scope) -> None:
        """A function, or something else that is passed over."""
        j, specifiers = self.i, set()
        while j < end:
            token = self.t[j]
            if token.text == "[" and j + 1 < end and self.t[j + 1].text == "[":
                j = self.close[j] + 1
            elif token.text in _SPECIFIERS:
                specifiers.add(token.text)
                j += 1
            elif token.text in ("alignas", "decltype", "__attribute__", "noexcept") and j + 1 < end and self.t[j + 1].text == "(":
                j = self.close[j + 1] + 1
            elif token.text == "<":
                after = self._angles(j, end)
                j = after if after > j else j + 1
            elif token.text == "operator":
                if self._function(j, end, scope, specifiers):
                    return
                break
            elif token.text == "(":
                if self._function(j, end, scope, specifiers):
                    return
                break
            elif token.text in ("{", ";", "=", "}"):
                break
            else:
                j += 1
        self._skip(end)

    def _function(self, j: int, end: int, scope: _Scope, specifiers: set[str]) -> bool:
        """The function whose parameters open at ``j`` (or whose name is the operator there)."""
        if self.t[j].text == "operator":
            first, k = j, j + 1
            while k < end and self.t[k].text != "(" or k < end and k == j + 1 and self.t[k].text == "(":
                k = self.close[k] + 1 if self.t[k].text == "(" else k + 1
            if k >= end:
                return False
            spelled = "operator" + (" " if self.t[j + 1].kind == "word" else "") + "".join(x.text for x in self.t[j + 1 : k])
            name_at, opening = self.t[j], k
        else:
            if j <= self.i:
                return False
            first, opening = j - 1, j
            if self.t[first].text == ">":
                depth = 0
                while first > self.i:
                    depth += {">": 1, "<": -1}.get(self.t[first].text, 0)
                    first -= 1
                    if not depth:
                        break
            if self.t[first].kind != "word" or self.t[first].text in _KEYWORDS:
                return False
            spelled, name_at = self.t[first].text, self.t[first]
            if first > self.i and self.t[first - 1].text == "~":
                first, spelled = first - 1, "~" + spelled
        outer: list[str] = []
        while first - 1 > self.i and self.t[first - 1].text == "::":
            k = first - 2
            if self.t[k].text == ">":
                depth = 0
                while k > self.i:
                    depth += {">": 1, "<": -1}.get(self.t[k].text, 0)
                    k -= 1
                    if not depth:
                        break
            if self.t[k].kind != "word":
                break
            outer.insert(0, self.t[k].text)
            first = k
        closing = self.close[opening]
        if closing >= end or closing > opening + 1 and self.t[opening + 1].kind in ("number", "text"):
            return False
        owner = _joined(scope.name or scope.namespace, *outer)
        inside = scope.name is not None or bool(outer) and (owner in self.classes or owner not in self.namespaces)
        simple = owner.rpartition("::")[2]
        structor = inside and spelled.lstrip("~") == simple
        typed = [x for x in self.t[self.i : first] if x.text not in _SPECIFIERS and x.text not in ("::", "[", "]")]
        if not typed and not structor and self.t[j].text != "operator":
            # a macro that is called, or a constructor of a class that is not known
            self.i = closing + 1
            if self.at() == ";":
                self.i += 1
            return True
        k, const, virtual, pure = closing + 1, False, "virtual" in specifiers, False
        while k < end and self.t[k].text not in ("{", ";", ":", "="):
            const |= self.t[k].text == "const"
            virtual |= self.t[k].text in ("override", "final")
            if self.t[k].text in (",", ")", "}"):
                return False
            k = self.close[k] + 1 if self.t[k].text in ("(", "[") else k + 1
        if k < end and self.t[k].text == "=":
            pure = self.t[k + 1].text == "0" if k + 1 < end else False
            while k < end and self.t[k].text != ";":
                k += 1
        body = None
        if k < end and self.t[k].text == ":":
            k += 1
            while k < end and self.t[k].text != "{":
                _, after = self._name(k, end)
                k = max(after, k + 1) if self.t[k].kind == "word" or self.t[k].text == "::" else k + 1
                if after > 0 and k < end and self.t[k].text in ("(", "{") and self.t[k - 1].text not in (",", ":"):
                    k = self.close[k] + 1
                    if k < end and self.t[k].text == "...":
                        k += 1
                    if k < end and self.t[k].text == ",":
                        k += 1
                        continue
                    break
        if k < end and self.t[k].text == "{":
            body = k
        types, named, _ = self._parameters(opening)
        signature = ", ".join(types)
        signature = (f"{signature} const" if signature else "const") if const else signature
        static = "static" in specifiers
        fqn, line = _joined(owner, spelled), name_at.line
        usr = usr_of(fqn, signature, self.file if static and not inside else "")
        parent = owner if inside else None
        kind = "constructor" if structor and not spelled.startswith("~") else "function"
        method = inside and kind == "function"
        flags = {"is_virtual": method and (virtual or pure), "is_pure_virtual": method and pure, "is_static": static and kind == "function", "is_const": const}
        self.out.nodes.append({"label": "Function", **BLANK_NODE, "usr": usr, "name": spelled, "fqn": fqn, "file": self.file, "line": line, "language": "cpp", "kind": kind, "signature": signature, "parent_fqn": parent, **flags})
        self.out.symbols.append({"fqn": fqn, "usr": usr, "kind": kind, "file": self.file, "line": line, "language": "cpp", "signature": signature, "parent_fqn": parent})
        own_usr = scope.usr if scope.name is not None and not outer else usr_of(owner)
        if inside:
            self.out.edges.append({"source_usr": own_usr, "target_usr": usr, "relationship": "DEFINES", "file": self.file, "line": line})
            if flags["is_virtual"] and not spelled.startswith("~"):
                self._queue("OVERRIDES", signature, spelled, len(types), usr, fqn, owner, scope, line, [owner])
        if body is not None:
            stop = min(self.close[body], end)
            inner = scope if not outer else _Scope(scope.namespace, owner if inside else None, own_usr, (*scope.using, *([] if inside else [owner])), self.fields.get(owner))
            self._body(body + 1, stop, usr, fqn, inner, inner.fields | named)
            self.i = stop + 1
        else:
            self.i = min(k + 1, end)
        return True

    def _queue(self, kind: str, qualifier: str | None, member: str, count: int, usr: str, fqn: str, owner: str | None, scope: _Scope, line: int, scopes: list[str]) -> None:
        self.out.calls.append({
            "qualifier": qualifier, "member": member, "arguments_count": count, "caller_usr": usr, "caller_fqn": fqn, "class_fqn": owner, "package": scope.namespace,
            "imports": list(dict.fromkeys(scopes)), "file": self.file, "line": line, "is_constructor": False, "kind": f"CPP_{kind}",
        })

    def _count(self, opening: int) -> int:
        k, end = opening + 1, self.close[opening]
        commas, some = 0, k < end
        while k < end:
            text = self.t[k].text
            if text == "<" and self.t[k - 1].kind == "word" and (after := self._angles(k, end)) > k:
                k = after
                continue
            k = self.close[k] if text in _OPENING else k
            commas += text == ","
            k += 1
        return commas + 1 if some else 0

    def _body(self, k: int, end: int, usr: str, fqn: str, scope: _Scope, known: dict[str, str]) -> None:
        """Calls and lambdas of a stretch of code."""
        known = dict(known)
        while k < end:
            token = self.t[k]
            if token.text == "[" and (self.t[k - 1].kind not in ("word", "text") or self.t[k - 1].text in ("return", "case", "else")) and self.t[k - 1].text not in (")", "]"):
                after = self.close[k] + 1
                if after < end and self.t[after].text == "[":
                    k = self.close[after] + 1
                    continue
                if after < end and self.t[after].text in ("(", "{", "mutable", "<", "->", "noexcept"):
                    k = self._lambda(k, after, end, scope, known)
                    continue
            if token.kind != "word":
                k += 1
                continue
            if token.text == "new":
                j = k + 1
                if j < end and self.t[j].text == "(":
                    j = self.close[j] + 1
                name, after = self._name(j, end)
                if name and after < end and self.t[after].text in ("(", "{") and name not in _TYPE_WORDS:
                    self._construct(name, after, usr, fqn, scope, token.line)
                k = max(after, k + 1)
                continue
            if token.text in _KEYWORDS:
                k += 1
                continue
            before = self.t[k - 1]
            name, after = self._name(k, end)
            opens = self.t[after].text if after < end else ""
            if opens == "(" and (before.kind != "word" or before.text in _KEYWORDS - _TYPE_WORDS):
                outer, _, last = name.rpartition("::")
                if before.text in (".", "->"):
                    receiver = self.t[k - 2]
                    kind = scope.name if receiver.text == "this" else known.get(receiver.text) if receiver.kind == "word" and self.t[k - 3].text not in (".", "->") else None
                    if kind is not None:
                        scopes = [kind] if receiver.text == "this" else [_joined(s, kind) for s in scope.around()]
                        self._queue("CALLS", receiver.text, last, self._count(after), usr, fqn, scope.name, scope, token.line, scopes)
                elif outer:
                    self._queue("CALLS", outer, last, self._count(after), usr, fqn, scope.name, scope, token.line, [_joined(s, outer) for s in scope.around()])
                else:
                    # a function, or a value of a class that is made
                    self._queue("CALLS", None, last, self._count(after), usr, fqn, scope.name, scope, token.line, [x for s in scope.around() for x in (s, _joined(s, last))])
                k = after
                continue
            found: dict[str, str] = {}
            moved = self._variable(k, end, found, (";", "=", "(", "{", ",", ")", ":", "["))
            if found:
                variable, kind = next(iter(found.items()))
                known[variable] = kind
                if moved < end and self.t[moved].text in ("(", "{") or moved < end and self.t[moved].text == ";" and self.t[moved - 2].text not in ("*", "&", "&&"):
                    opening = moved if self.t[moved].text in ("(", "{") else None
                    self._construct(kind, opening, usr, fqn, scope, token.line)
                k = moved
                continue
            k = max(after, k + 1)

    def _construct(self, name: str, opening: int | None, usr: str, fqn: str, scope: _Scope, line: int) -> None:
        last = name.rpartition("::")[2]
        self._queue("CALLS", name, last, 0 if opening is None else self._count(opening), usr, fqn, scope.name, scope, line, [_joined(s, name) for s in scope.around()])

    def _lambda(self, k: int, after: int, end: int, scope: _Scope, known: dict[str, str]) -> int:
        token, named = self.t[k], {}
        if self.t[after].text == "<":
            after = max(self._angles(after, end), after + 1)
        if after < end and self.t[after].text == "(":
            _, named, _ = self._parameters(after)
            after = self.close[after] + 1
        while after < end and self.t[after].text not in ("{", ";", ")"):
            after = self.close[after] + 1 if self.t[after].text in ("(", "[") else after + 1
        if after >= end or self.t[after].text != "{":
            return k + 1
        usr, name = f"lambda@{self.file}:{token.line}:{token.column}", f"lambda@L{token.line}"
        fqn, stop = _joined(scope.name or "global", name), min(self.close[after], end)
        flags = {"is_virtual": False, "is_pure_virtual": False, "is_static": False, "is_const": False}
        self.out.nodes.append({"label": "Function", **BLANK_NODE, "usr": usr, "name": name, "fqn": fqn, "file": self.file, "line": token.line, "language": "cpp", "kind": "lambda", "parent_fqn": scope.name, **flags})
        self._body(after + 1, stop, usr, fqn, scope, known | named)
        return stop + 1


def parse(source: bytes | str, file: str) -> Parsed:
    """What one source holds; never an error, only diagnostics."""
    text = source.decode("utf-8", errors="replace") if isinstance(source, bytes | bytearray) else source
    reader = _Reader(text, file)
    try:
        return reader.unit()
    except (IndexError, KeyError, RecursionError) as error:
        reader._note("fatal", reader.t[min(reader.i, len(reader.t) - 1)].line if reader.t else 0, type(error).__name__)
        reader.out.errors.append(f"{file}: {type(error).__name__}")
        return reader.out


def extract(files: DataFrame) -> DataFrame:
    """One row for each C++ file (path, content), as ``common.extract`` gives it."""
    return common.extract(files, parse)
