import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.sources.parsers import LANGUAGES, parse


def found(text, path, language):
    p = parse(text, path, language)
    return {(k, q) for k, _, q, _, _ in p.symbols}, {e for e in p.edges}, {(c, r) for c, r, _ in p.calls}, p.imports


def test_python():
    text = "import os, a.b as c\nfrom pathlib import Path\nfrom m import *\n@d\nclass A(Base):\n  def login(self):\n    self._i(Path())\n    def inner(): go()\ndef test_login(): pass\n"
    symbols, edges, calls, imports = found(text, "auth.py", "python")
    assert {("File", "auth.py"), ("Class", "auth.py::A"), ("Function", "auth.py::A.login"), ("Test", "auth.py::test_login")} <= symbols
    assert {("CONTAINS", "auth.py", "auth.py::A"), ("CONTAINS", "auth.py::A", "auth.py::A.login"), ("INHERITS", "auth.py::A", "Base"), ("IMPORTS", "auth.py", "pathlib"), ("IMPORTS", "auth.py", "os")} <= edges
    assert calls == {("auth.py::A.login", "self._i"), ("auth.py::A.login", "Path"), ("auth.py::A.login.inner", "go")}
    assert imports == {"os": "os", "c": "a.b", "Path": "pathlib.Path", "m.*": "m"}


def test_test_folders():
    assert ("Test", "tests/h.py::my_helper") in found("def my_helper(): pass", "tests/h.py", "python")[0]
    assert ("Function", "lib.go::F") in found("package a\nfunc F() {}", "lib.go", "go")[0]


def test_broken_python_keeps_the_rest():
    p = parse("def a(:\n  pass\ndef b():\n  c()\n", "x.py", "python")
    assert p.error and ("Function", "b", "x.py::b", 3, 4) in p.symbols and ("x.py::b", "c", 4) in p.calls


@pytest.mark.parametrize(
    "language,path,text,symbols,edges,calls",
    [
        ("javascript", "a.js", "import { foo } from './utils';\nclass Dog extends Animal { constructor(n) { init(n); } speak() { this.x.y(); } }\nfunction greet() {}", {"a.js::Dog", "a.js::Dog.constructor", "a.js::Dog.speak", "a.js::greet"}, {("INHERITS", "a.js::Dog", "Animal"), ("IMPORTS", "a.js", "./utils")}, {("a.js::Dog.constructor", "init"), ("a.js::Dog.speak", "this.x.y")}),
        ("typescript", "t.ts", "interface I extends B { m(): void }\nclass C<T> extends D<T> implements I, J { f(): P<{a: number}> { return this.z(); } }", {"t.ts::I", "t.ts::C", "t.ts::C.f"}, {("INHERITS", "t.ts::I", "B"), ("INHERITS", "t.ts::C", "D"), ("IMPLEMENTS", "t.ts::C", "I"), ("IMPLEMENTS", "t.ts::C", "J")}, {("t.ts::C.f", "this.z")}),
        ("go", "main.go", 'package main\nimport "fmt"\ntype Dog struct{}\nfunc (d *Dog) Sound() { fmt.Println(d) }\nfunc main() { go run() }', {"main.go::Dog", "main.go::Dog.Sound", "main.go::main"}, {("IMPORTS", "main.go", "fmt"), ("CONTAINS", "main.go::Dog", "main.go::Dog.Sound")}, {("main.go::Dog.Sound", "fmt.Println"), ("main.go::main", "run")}),
        ("rust", "lib.rs", "use std::{fmt, io::Read};\npub struct Dog;\nimpl Dog { fn new() -> Self { Dog::make() } }\nimpl fmt::Display for Dog { fn fmt(&self) {} }", {"lib.rs::Dog", "lib.rs::Dog.new", "lib.rs::Dog.fmt"}, {("IMPORTS", "lib.rs", "std::fmt"), ("IMPORTS", "lib.rs", "std::io::Read"), ("INHERITS", "lib.rs::Dog", "fmt::Display"), ("CONTAINS", "lib.rs", "lib.rs::Dog.new")}, {("lib.rs::Dog.new", "Dog::make")}),
        ("java", "A.java", "import java.util.List;\npublic class A extends B implements C { A() {} int f(int x) { return new Foo(x).bar(o.p()); } }", {"A.java::A", "A.java::A.A", "A.java::A.f"}, {("INHERITS", "A.java::A", "B"), ("IMPLEMENTS", "A.java::A", "C"), ("IMPORTS", "A.java", "java.util.List")}, {("A.java::A.f", "Foo"), ("A.java::A.f", "o.p")}),
        ("c", "a.c", '#include <stdio.h>\ntypedef struct { int a; } P;\nint *f(int a) { return g(s->h(a)); }', {"a.c::P", "a.c::f"}, {("IMPORTS", "a.c", "stdio.h")}, {("a.c::f", "g"), ("a.c::f", "s->h")}),
        ("cpp", "a.cpp", "class Foo : public Bar, private ns::Baz { public: Foo(int a) : x(a) { init(); } int get() const { return std::max(x, 1); } int x; };\nvoid Foo::run() { go(); }", {"a.cpp::Foo", "a.cpp::Foo.Foo", "a.cpp::Foo.get", "a.cpp::Foo.run"}, {("INHERITS", "a.cpp::Foo", "Bar"), ("INHERITS", "a.cpp::Foo", "ns::Baz")}, {("a.cpp::Foo.Foo", "init"), ("a.cpp::Foo.get", "std::max"), ("a.cpp::Foo.run", "go")}),
    ],
)
def test_languages(language, path, text, symbols, edges, calls):
    s, e, c, _ = found(text, path, language)
    assert symbols <= {q for _, q in s} and edges <= e and calls <= c


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abf(){}[]<>:;,.'\"`/*# \n=class fn import def", max_size=120), st.sampled_from(LANGUAGES))
def test_nothing_raises(text, language):
    assert parse(text, "x", language).symbols[0][0] == "File"


def test_deep_nesting():
    for language in LANGUAGES:
        assert parse("{(" * 5000, "x", language).symbols
        assert parse("x" + "(a, " * 400 + "y" + ")" * 400 + " = 1", "x", language).symbols
