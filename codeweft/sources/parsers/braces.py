"""JavaScript, TypeScript, Go, Java, Rust, C and C++: one tokenizer, and rules that recognise definitions.

Definitions are found by their keywords and by the shape name(...) {...} where
a language has no keyword for functions. Everything else is walked through, so
an unknown construct costs its own symbols only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from codeweft.sources.parsers.common import Parsed

SCRIPT = ("javascript", "typescript", "tsx")
TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<string>"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)*')
    |(?P<life>'[A-Za-z_]\w*(?!'))
    |(?P<name>[^\W\d][\w$]*|[$#@][^\W\d][\w$]*|\$)
    |(?P<number>\d[\w.]*)
    |(?P<sign>=>|->|::|[-+*/%&|^!=<>]=|[{}()\[\];,.:<>=*&?!~|^/%+-])
    |(?P<line>\n)""",
    re.VERBOSE | re.DOTALL,
)
#: Words before a bracket that are no callee, in all languages and by language.
NO_CALL = set("if for while switch return catch sizeof else do case".split())
KEYWORDS = {
    "script": set("function typeof await async new in of instanceof throw yield void delete super import with class".split()),
    "go": set("func go defer select range interface struct chan map type var const make".split()) - {"make"},
    "java": set("new super synchronized throw try finally assert instanceof class this".split()),
    "rust": set("fn match loop unsafe move where as in impl let use pub crate".split()),
    "c": set("alignof decltype static_assert noexcept throw new delete operator template alignas __attribute__ defined".split()),
}
OPEN, CLOSE = "({[", ")}]"


@dataclass
class Token:
    kind: str
    text: str
    line: int
    pair: int = -1  # the matching bracket


def tokenize(text: str, language: str) -> list[Token]:
    out: list[Token] = []
    line, stack = 1, []
    if language == "rust":  # a lifetime is not the beginning of a string
        text = re.sub(r"(?<=[<&,\s(])'([a-z_]\w*)(?=[\s,>:)])(?!')", r" \1", text)
    if language in ("c", "cpp"):
        text = re.sub(r"^[ \t]*#[^\n]*(?:\\\n[^\n]*)*", lambda m: "\n" * m.group().count("\n"), text, flags=re.MULTILINE)
    for m in TOKEN.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind not in ("comment", "line"):
            t = Token(kind, value, line)
            if kind == "sign" and value in OPEN:
                stack.append(len(out))
            elif kind == "sign" and value in CLOSE and stack:
                want = OPEN[CLOSE.index(value)]
                if any(out[k].text == want for k in stack):
                    while out[stack[-1]].text != want:
                        stack.pop()
                    t.pair = stack.pop()
                    out[t.pair].pair = len(out)
            out.append(t)
        line += value.count("\n")
    for k in stack:  # what is never closed reaches to the end
        out[k].pair = len(out)
    return out


class Walker:
    def __init__(self, text: str, out: Parsed) -> None:
        self.out, self.language = out, out.language
        self.toks = tokenize(text, out.language)
        family = {"cpp": "c"}.get(out.language, out.language if out.language in KEYWORDS else "script")
        self.no_call = NO_CALL | KEYWORDS[family]

    # -- small helpers

    def text(self, i: int) -> str:
        return self.toks[i].text if 0 <= i < len(self.toks) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "name"

    def last_line(self, i: int) -> int:
        return self.toks[min(i, len(self.toks) - 1)].line if self.toks else 1

    def find(self, i: int, end: int, signs: str | tuple[str, ...]) -> int:
        """The first of these signs from i on, brackets skipped; end if there is none."""
        while i < end:
            t = self.toks[i]
            if t.text in signs and t.kind == "sign":
                return i
            i = t.pair + 1 if t.text in OPEN and t.kind == "sign" and t.pair > i else i + 1
        return end

    def generics(self, i: int) -> int:
        """Past <...> at i."""
        if self.text(i) != "<":
            return i
        depth = 0
        while i < len(self.toks) and self.text(i) != ";":
            t = self.toks[i]
            depth += {"<": 1, ">": -1}.get(t.text, 0)
            i = t.pair + 1 if t.text in OPEN and t.pair > i else i + 1
            if depth <= 0:
                break
        return i

    def path(self, i: int, seps: tuple[str, ...]) -> tuple[str, int]:
        """A name with its qualifiers from i on, and what follows it."""
        parts = [self.text(i)]
        i += 1
        while self.text(i) in seps and self.is_name(i + 1):
            parts += [self.text(i), self.text(i + 1)]
            i += 2
        return "".join(parts), i

    def names(self, i: int, end: int, seps: tuple[str, ...] = (".", "::")) -> list[str]:
        """The names, by commas, between i and end; what is generic or in brackets is left out."""
        found = []
        while i < end:
            if self.is_name(i):
                name, i = self.path(i, seps)
                found.append(name)
                i = self.generics(i)
                i = self.find(i, end, ",") + 1
            else:
                i += 1
        return found

    # -- walking

    def walk(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str = "") -> None:
        """Definitions, imports and (inside a function) calls from i to end. inside: "class" directly in a class body."""
        while i < end:
            t = self.toks[i]
            step = self.definition(i, end, scope, parent, caller, inside)
            if step > i:
                i = step
                continue
            if t.kind == "sign" and t.text == "(" and caller:
                self.call(i, caller)
            if t.kind == "sign" and t.text in OPEN and t.pair > i:
                self.walk(i + 1, min(t.pair, end), scope, parent, caller, "enum" if inside == "class" and t.text != "{" else "")
                i = min(t.pair, end) + 1
            else:
                i += 1

    def call(self, i: int, caller: str) -> None:
        k = i - 1
        if self.text(k) == ">" and self.language in ("rust", "typescript", "tsx", "java", "cpp", "go"):
            depth, j = 0, k
            while j >= 0 and k - j < 40:
                depth += {">": 1, "<": -1}.get(self.text(j), 0)
                j -= 1
                if depth == 0:
                    break
            if depth == 0 and (self.is_name(j) or self.text(j) == "::"):
                k = j - 1 if self.text(j) == "::" else j
        if not self.is_name(k) or self.text(k) in self.no_call:
            return
        parts, line = [self.text(k)], self.toks[k].line
        while self.text(k - 1) in (".", "::", "->") and (self.is_name(k - 2) or self.text(k - 2) in (")", "]")):
            if not self.is_name(k - 2):  # a call or an index before it: its own last name
                pair = self.toks[k - 2].pair
                if pair > 0 and self.is_name(pair - 1):
                    parts = [self.text(pair - 1), "(…)" if self.text(k - 2) == ")" else "[…]", self.text(k - 1), *parts]
                break
            parts = [self.text(k - 2), self.text(k - 1), *parts]
            k -= 2
        before = self.text(k - 1)
        if before in ("function", "fn", "func", "def", "class") or (before == "new" and self.language in SCRIPT) or parts[0].startswith("@"):
            return
        if self.text(k - 1) == "!" and self.language == "rust":
            return
        self.out.calls.append((caller, "".join(parts), line))

    def function(self, name: str, i: int, body: int, scope: list[str], parent: str, close: int | None = None) -> int:
        """Adds a function whose text begins at i and whose body's bracket is at body (or that ends at close); what follows it."""
        inner = [*scope, name]
        end = self.toks[body].pair if close is None else close
        q = self.out.define("Function", inner, self.toks[i].line, self.last_line(end), parent)
        if close is None:
            self.walk(body + 1, min(end, len(self.toks)), inner, q, q)
        return end + 1

    def type(self, kind: str, name: str, i: int, body: int, scope: list[str], parent: str, bases: list[tuple[str, str]]) -> int:
        inner = [*scope, name]
        has = self.text(body) == "{"
        end = self.toks[body].pair if has else body
        q = self.out.define(kind, inner, self.toks[i].line, self.last_line(end), parent)
        self.out.edges += [(relation, q, base) for relation, base in bases]
        if has:
            self.walk(body + 1, min(end, len(self.toks)), inner, q, None, "class")
        return end + 1

    def definition(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str) -> int:
        """Handles a definition or import that begins at i; what follows it, or i if there is none."""
        if self.toks[i].kind != "name" and self.text(i) not in ("*", "~"):
            return i
        if self.text(i - 1) in (".", "->") or (self.text(i - 1) == "::" and self.language not in ("cpp", "c")):
            return i
        rule = {"go": self.go, "java": self.java, "rust": self.rust, "c": self.c, "cpp": self.c}.get(self.language, self.script)
        return rule(i, end, scope, parent, caller, inside)

    # -- JavaScript and TypeScript

    def script(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str) -> int:
        word = self.text(i)
        if word == "import" and not scope and self.text(i + 1) not in ("(", "."):
            return self.script_import(i, end)
        if word == "class" and self.is_name(i + 1) and self.text(i + 1) not in ("extends", "implements"):
            body = self.find(i, end, "{")
            return self.type("Class", self.text(i + 1), i, body, scope, parent, self.heritage(i + 2, body)) if body < end else i
        if word == "interface" and self.is_name(i + 1) and self.language != "javascript":
            body = self.find(i, end, "{")
            return self.type("Interface", self.text(i + 1), i, body, scope, parent, self.heritage(i + 2, body)) if body < end else i
        if word == "function":
            k = i + 1 + (self.text(i + 1) == "*")
            if self.is_name(k):
                body = self.after_parameters(self.generics(k + 1), end)
                return self.function(self.text(k), i, body, scope, parent) if body else i
            return i
        if inside == "class" and self.is_name(i):
            k = self.generics(i + 1)
            if self.text(k) == "(" and word not in self.no_call:
                body = self.after_parameters(k, end)
                if body:
                    return self.function(word.lstrip("#"), i, body, scope, parent)
        if (word in ("const", "let", "var") and self.is_name(i + 1)) or (inside == "class" and self.text(i + 1) in ("=", ":")):
            name = i + 1 if word in ("const", "let", "var") else i
            k = name + 1
            if self.text(k) == ":":
                k = self.find(k, end, ("=", ";", "}"))
            if self.text(k) == "=":
                k += 1 + (self.text(k + 1) == "async")
                if self.text(k) == "function":
                    body = self.find(k, end, "{")
                    return self.function(self.text(name), i, body, scope, parent) if body < end else i
                arrow = self.toks[k].pair + 1 if self.text(k) == "(" else k + 1
                if self.text(arrow) == ":":
                    arrow = self.find(arrow, end, ("=>", ";", "{"))
                if self.text(arrow) == "=>":
                    if self.text(arrow + 1) == "{":
                        return self.function(self.text(name), i, arrow + 1, scope, parent)
                    stop = self.find(arrow + 1, end, (";", ","))
                    inner = [*scope, self.text(name)]
                    q = self.out.define("Function", inner, self.toks[i].line, self.last_line(stop - 1), parent)
                    self.walk(arrow + 1, stop, inner, q, q)
                    return stop
        return i

    def after_parameters(self, i: int, end: int) -> int:
        """The body's bracket after parameters at i and a return type; 0 if there is none."""
        if self.text(i) != "(" or self.toks[i].pair < i:
            return 0
        k = self.toks[i].pair + 1
        if self.text(k) == ":":  # a return type, which may itself be in braces
            k = k + 1
            if self.text(k) == "{" and self.toks[k].pair > 0:
                k = self.toks[k].pair + 1
            k = self.find(k, end, ("{", ";", "}", "=", "<"))
            if self.text(k) == "<":
                k = self.find(self.generics(k), end, ("{", ";", "}", "="))
        return k if k < end and self.text(k) == "{" else 0

    def heritage(self, i: int, body: int) -> list[tuple[str, str]]:
        """(relation, base) of extends and implements between i and body."""
        marks = [k for k in range(i, body) if self.text(k) in ("extends", "implements")]
        out = []
        for k, stop in zip(marks, [*marks[1:], body], strict=False):
            relation = "INHERITS" if self.text(k) == "extends" else "IMPLEMENTS"
            out += [(relation, n) for n in self.names(k + 1, stop)]
        return out

    def script_import(self, i: int, end: int) -> int:
        k = i + 1
        while k < end and self.toks[k].kind != "string" and self.text(k) != ";":
            k += 1
        if k >= end or self.toks[k].kind != "string":
            return k
        source = self.text(k)[1:-1]
        self.out.imported(source)
        j = i + 1 + (self.text(i + 1) == "type" and self.text(i + 2) not in ("from", ","))
        while j < k:
            if self.text(j) == "{":
                for item in self.commas(j + 1, self.toks[j].pair):
                    item = [x for x in item if x != "type" or len(item) == 1]
                    if item:
                        self.out.imports[item[-1]] = f"{source}::{item[0]}"
                j = self.toks[j].pair + 1
            elif self.text(j) == "*" and self.text(j + 1) == "as":
                self.out.imports[self.text(j + 2)] = source
                j += 3
            else:
                if self.is_name(j) and self.text(j) != "from":
                    self.out.imports[self.text(j)] = f"{source}::default"
                j += 1
        return k + 1

    def commas(self, i: int, end: int) -> list[list[str]]:
        """The tokens between i and end, split at commas outside of brackets."""
        out: list[list[str]] = [[]]
        while i < end:
            if self.text(i) == ",":
                out.append([])
            else:
                out[-1].append(self.text(i))
            i += 1
        return [x for x in out if x]

    # -- Go

    def go(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str) -> int:
        word = self.text(i)
        if word == "import" and not scope:
            if self.text(i + 1) == "(":
                stop = self.toks[i + 1].pair
                for k in range(i + 2, min(stop, end)):
                    self.go_import(k)
                return stop + 1
            k = i + 1 if self.toks[min(i + 1, end - 1)].kind == "string" else i + 2
            self.go_import(k)
            return k + 1
        if word == "type" and (self.is_name(i + 1) or self.text(i + 1) == "("):
            if self.text(i + 1) != "(":
                return self.go_type(i, i + 1, end, scope, parent)
            k, stop = i + 2, min(self.toks[i + 1].pair, end)
            while k < stop:
                k = self.go_type(k, k, stop, scope, parent) if self.is_name(k) else k + 1
            return stop + 1
        if word == "func":
            k, receiver = i + 1, []
            if self.text(k) == "(" and self.is_name(self.toks[k].pair + 1):
                inner = [self.text(j) for j in range(k + 1, self.toks[k].pair) if self.is_name(j)]
                generic = next((j for j in range(k + 1, self.toks[k].pair) if self.text(j) == "["), None)
                names = [self.text(j) for j in range(k + 1, generic or self.toks[k].pair) if self.is_name(j)] or inner
                receiver = names[-1:]
                k = self.toks[k].pair + 1
            if self.is_name(k):
                params = self.find(k + 1, end, "(")
                body = self.go_body(self.toks[params].pair + 1, end) if params < end else end
                full = [*scope, *(receiver if not scope or scope[-1:] != receiver else [])]
                owner = self.out.qname(full) if receiver else parent
                if body < end:
                    return self.function(self.text(k), i, body, full, owner)
                return self.function(self.text(k), i, params, full, owner, close=self.toks[params].pair) if params < end else i
        return i

    def go_body(self, i: int, end: int) -> int:
        """The bracket of a function's body after its parameters; a result type may hold braces of its own."""
        while i < end:
            if self.text(i) in ("interface", "struct") and self.text(i + 1) == "{":
                i = self.toks[i + 1].pair + 1
            elif self.text(i) == "{":
                return i
            elif self.text(i) in ("func", "type", "var", "const", "import") and self.text(i - 1) in (")", "}"):
                return end
            else:
                i = self.toks[i].pair + 1 if self.text(i) in "([" and self.toks[i].pair > i else i + 1
        return end

    def go_type(self, first: int, name: int, end: int, scope: list[str], parent: str) -> int:
        k = name + 1
        if self.text(k) == "[" and self.is_name(k + 1) and self.is_name(k + 2):
            k = self.toks[k].pair + 1
        k += self.text(k) == "="
        if self.text(k) in ("struct", "interface") and self.text(k + 1) == "{":
            stop = self.toks[k + 1].pair
        else:
            line = self.toks[min(k, end - 1)].line
            stop = k
            while stop + 1 < end and self.toks[stop + 1].line == line:
                stop += 1
        self.out.define("Class", [*scope, self.text(name)], self.toks[first].line, self.last_line(stop), parent)
        return stop + 1

    def go_import(self, k: int) -> None:
        if k >= len(self.toks) or self.toks[k].kind != "string":
            return
        path = self.text(k)[1:-1]
        alias = self.text(k - 1) if self.is_name(k - 1) and self.text(k - 1) != "import" and self.toks[k - 1].line == self.toks[k].line else path.rsplit("/", 1)[-1]
        self.out.imports[alias] = path
        self.out.imported(path)

    # -- Java

    def java(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str) -> int:
        word = self.text(i)
        if word == "import" and not scope:
            stop = self.find(i, end, ";")
            path = "".join(self.text(k) for k in range(i + 1 + (self.text(i + 1) == "static"), stop))
            if path:
                name = path.rsplit(".", 1)[-1]
                self.out.imports[path if name == "*" else name] = path
                self.out.imported(path)
            return stop + 1
        if word in ("class", "interface", "enum", "record", "@interface") and self.is_name(i + 1):
            body = self.find(i, end, "{")
            if body < end:
                bases = self.heritage(i + 2, body)
                return self.type("Class", self.text(i + 1), i, body, scope, parent, bases)
        if inside == "class" and self.text(i + 1) == "(" and word not in self.no_call and not word.startswith("@") and self.text(i - 1) not in ("new", "=", "return"):
            close = self.toks[i + 1].pair
            stop = self.find(close + 1, end, ("{", ";", "=", ",")) if close > 0 else end
            typed = self.is_name(i - 1) or self.text(i - 1) in (">", "]") or (scope and word == scope[-1])
            if stop < end and self.text(stop) == "{" and typed:
                return self.function(word, i, stop, scope, parent)
            if stop < end and self.text(stop) == ";" and typed:
                return self.function(word, i, i, scope, parent, close=stop)
        return i

    # -- Rust

    def rust(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str) -> int:
        word = self.text(i)
        if word == "use":
            stop = self.find(i, end, ";")
            self.rust_use([], i + 1, stop)
            return stop + 1
        if word in ("struct", "enum", "trait", "union") and self.is_name(i + 1):
            stop = self.find(i, end, ("{", ";"))
            if stop < end:
                return self.type("Class", self.text(i + 1), i, stop, scope, parent, [])
        if word == "impl":
            body = self.find(i, end, "{")
            if body < end:
                k = self.generics(i + 1)
                marks = [j for j in range(k, body) if self.text(j) == "for" and self.text(j + 1) != "<"]
                where = next((j for j in range(k, body) if self.text(j) == "where"), body)
                target = self.names((marks[0] + 1) if marks else k, where, ("::",))[:1] or ["impl"]
                name = target[0].rsplit("::", 1)[-1]
                if marks:
                    trait = self.names(k, marks[0], ("::",))[:1]
                    self.out.edges += [("INHERITS", self.out.qname([name]), t) for t in trait]
                self.walk(body + 1, min(self.toks[body].pair, end), [*scope, name], parent, None, "class")
                return self.toks[body].pair + 1
        if word == "fn" and self.is_name(i + 1):
            stop = self.find(i + 2, end, ("{", ";"))
            if stop < end:
                if self.text(stop) == "{":
                    return self.function(self.text(i + 1), i, stop, scope, parent)
                return self.function(self.text(i + 1), i, i, scope, parent, close=stop)
        return i

    def rust_use(self, prefix: list[str], i: int, end: int) -> None:
        """Bindings of a use tree between i and end."""
        parts, k = list(prefix), i
        while k < end:
            t = self.text(k)
            if t == "{":
                stop, start = self.toks[k].pair, k + 1
                while start < stop:
                    comma = self.find(start, stop, ",")
                    self.rust_use(parts, start, comma)
                    start = comma + 1
                return
            if t == "as":
                self.rust_bind(parts, self.text(k + 1))
                return
            if self.is_name(k) or t == "*":
                parts.append(t)
            k += 1
        if len(parts) > len(prefix):
            self.rust_bind(parts, parts[-1])

    def rust_bind(self, parts: list[str], alias: str) -> None:
        if parts and parts[-1] == "self":
            alias, parts = (parts[-2] if alias == "self" and len(parts) > 1 else alias), parts[:-1]
        if not parts or parts[-1] == "*":
            return
        full = "::".join(parts)
        self.out.imports[alias] = full
        self.out.imported(full)

    # -- C and C++

    def c(self, i: int, end: int, scope: list[str], parent: str, caller: str | None, inside: str) -> int:
        word = self.text(i)
        if word in ("struct", "union", "class") and self.text(i - 1) != "enum":
            k = i + 1
            name = self.text(k) if self.is_name(k) else ""
            while name and self.is_name(k + 1) and self.text(k + 1) != "final":  # macros before the name
                k += 1
                name = self.text(k)
            derived = self.text(k + 1 + (self.text(k + 1) == "final")) == ":"
            stop = self.find(k, end, ("{", ";") if derived else ("{", ";", "(", ")", "=", ",", "*", "&"))
            if stop < end and self.text(stop) == "{" and (name or self.text(i - 1) == "typedef" or self.language == "c"):
                close = self.toks[stop].pair
                alias = self.text(close + 1) if self.text(i - 1) == "typedef" and self.is_name(close + 1) else ""
                colon = self.find(k, stop, ":")
                bases = [("INHERITS", n) for n in self.bases(colon + 1, stop)]
                if name or alias:
                    return self.type("Class", name or alias, i, stop, scope, parent, bases)
        if caller is None and self.is_name(i) and word not in self.no_call and word != "operator":
            name, k = self.path(i, ("::",))
            if self.text(k) == "::" and self.text(k + 1) == "~" and self.is_name(k + 2):
                name, k = f"{name}::~{self.text(k + 2)}", k + 3
            if self.text(i - 1) == "~":
                name = f"~{name}"
            if self.text(k) == "(" and self.toks[k].pair > k:
                stop = self.find(self.toks[k].pair + 1, end, ("{", ";", "=", ","))
                between = range(self.toks[k].pair + 1, stop)
                colon = next((j for j in between if self.text(j) == ":"), None)
                if colon is not None and stop < end:  # members set before the body
                    stop = self.initialised(colon + 1, end)
                if stop < end and self.text(stop) == "{":
                    parts = name.split("::")
                    return self.function(parts[-1], i, stop, [*scope, *parts[:-1]], parent)
            if k > i + 1:
                return k
        return i

    def bases(self, i: int, end: int) -> list[str]:
        """The base classes between i and end; words of access stand before the names."""
        out = []
        while i < end:
            stop = self.find(i, end, ",")
            k = i
            while k < stop and self.text(k) in ("public", "private", "protected", "virtual"):
                k += 1
            if self.is_name(k):
                out.append(self.path(k, ("::",))[0])
            i = stop + 1
        return out

    def initialised(self, i: int, end: int) -> int:
        """The body's bracket after a constructor's list of initialisers at i."""
        while i < end:
            if self.is_name(i):
                _, i = self.path(i, ("::",))
                i = self.generics(i)
                if self.text(i) in ("(", "{") and self.toks[i].pair > i:
                    i = self.toks[i].pair + 1
                    if self.text(i) != ",":
                        return i if self.text(i) == "{" else end
            i += 1
        return end


INCLUDE = re.compile(r'^[ \t]*#[ \t]*include[ \t]*(?:<([^>\n]+)>|"([^"\n]+)")', re.MULTILINE)


def parse(text: str, out: Parsed) -> None:
    if out.language in ("c", "cpp"):
        for m in INCLUDE.finditer(text):
            header = m[1] or m[2]
            out.imports[header.split(".")[0]] = header
            out.imported(header)
    w = Walker(text, out)
    w.walk(0, len(w.toks), [], out.rel_path, None)
