"""Small sources in every language with what is to be found in them; {N} stands for a number, @ for the file's path.

Symbols are written kind, name, scope (or - for none), first and last line; edges
kind, source scope, target (a scope with @::, or raw); calls scope, callee, line; imports name, module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PYTHON = """import os
from shop.tax import rate as r

@wrap
class Cart{N}(Base{N}):
    def total(self):
        self.add(r(1))
        return os.path.join("a")

def test_cart{N}():
    Cart{N}().total()
"""
JAVASCRIPT = """import axis, { rate as r } from "./tax";
import * as all from "all";
class Cart{N} extends Base{N} {
  total() { return this.add(r(1)); }
}
function show{N}() { all.run(); }
"""
TYPESCRIPT = """import { T } from "./t";
interface Shape{N} extends Base{N} { area(): number }
class Cart{N} extends Base{N} implements Shape{N} {
  area(): number { return go{N}(); }
}
"""
TSX = """import React from "react";
function App{N}() { render{N}(); return null; }
"""
GO = """package shop
import (
  "fmt"
  t "shop/tax"
)
type Cart{N} struct{}
func (c *Cart{N}) Total() { fmt.Println(t.Rate()) }
func Main{N}() { Open{N}() }
"""
RUST = """use std::{fmt, io::Read};
pub struct Cart{N};
impl Cart{N} { fn new() -> Self { Cart{N}::make() } }
impl fmt::Display for Cart{N} { fn fmt(&self) { go{N}() } }
"""
JAVA = """import java.util.List;
public class Cart{N} extends Base{N} implements Shape{N} {
  int total(int x) { return add(tax.rate(x)); }
}
"""
C = """#include <stdio.h>
typedef struct { int a; } Point{N};
int total{N}(int a) { return rate{N}(p->tax(a)); }
"""
CPP = """#include <vector>
class Cart{N} : public Base{N} {
 public:
  int get() const { return std::max(x, go{N}()); }
  int x;
};
void Cart{N}::run() { stop{N}(); }
"""
#: suffix, source, symbols, edges, calls, imports
SAMPLES: dict[str, tuple[str, str, str, str, str, str]] = {
    "python": ("py", PYTHON,
        "File m{N}.py - 1 12;Class Cart{N} Cart{N} 4 8;Function total Cart{N}.total 6 8;Test test_cart{N} test_cart{N} 10 11",
        "IMPORTS - os;IMPORTS - shop.tax;CONTAINS - @::Cart{N};INHERITS Cart{N} Base{N};CONTAINS Cart{N} @::Cart{N}.total;CONTAINS - @::test_cart{N}",
        "Cart{N}.total self.add 7;Cart{N}.total r 7;Cart{N}.total os.path.join 8;test_cart{N} Cart{N}().total 11;test_cart{N} Cart{N} 11",
        "os os;r shop.tax.rate"),
    "javascript": ("js", JAVASCRIPT,
        "File m{N}.js - 1 7;Class Cart{N} Cart{N} 3 5;Function total Cart{N}.total 4 4;Function show{N} show{N} 6 6",
        "IMPORTS - ./tax;IMPORTS - all;CONTAINS - @::Cart{N};INHERITS Cart{N} Base{N};CONTAINS Cart{N} @::Cart{N}.total;CONTAINS - @::show{N}",
        "Cart{N}.total this.add 4;Cart{N}.total r 4;show{N} all.run 6",
        "axis ./tax::default;r ./tax::rate;all all"),
    "typescript": ("ts", TYPESCRIPT,
        "File m{N}.ts - 1 6;Interface Shape{N} Shape{N} 2 2;Class Cart{N} Cart{N} 3 5;Function area Cart{N}.area 4 4",
        "IMPORTS - ./t;CONTAINS - @::Shape{N};INHERITS Shape{N} Base{N};CONTAINS - @::Cart{N};INHERITS Cart{N} Base{N};IMPLEMENTS Cart{N} Shape{N};CONTAINS Cart{N} @::Cart{N}.area",
        "Cart{N}.area go{N} 4",
        "T ./t::T"),
    "tsx": ("tsx", TSX, "File m{N}.tsx - 1 3;Function App{N} App{N} 2 2", "IMPORTS - react;CONTAINS - @::App{N}", "App{N} render{N} 2", "React react::default"),
    "go": ("go", GO,
        "File m{N}.go - 1 9;Class Cart{N} Cart{N} 6 6;Function Total Cart{N}.Total 7 7;Function Main{N} Main{N} 8 8",
        "IMPORTS - fmt;IMPORTS - shop/tax;CONTAINS - @::Cart{N};CONTAINS Cart{N} @::Cart{N}.Total;CONTAINS - @::Main{N}",
        "Cart{N}.Total fmt.Println 7;Cart{N}.Total t.Rate 7;Main{N} Open{N} 8",
        "fmt fmt;t shop/tax"),
    "rust": ("rs", RUST,
        "File m{N}.rs - 1 5;Class Cart{N} Cart{N} 2 2;Function new Cart{N}.new 3 3;Function fmt Cart{N}.fmt 4 4",
        "IMPORTS - std::fmt;IMPORTS - std::io::Read;CONTAINS - @::Cart{N};CONTAINS - @::Cart{N}.new;INHERITS Cart{N} fmt::Display;CONTAINS - @::Cart{N}.fmt",
        "Cart{N}.new Cart{N}::make 3;Cart{N}.fmt go{N} 4",
        "fmt std::fmt;Read std::io::Read"),
    "java": ("java", JAVA,
        "File m{N}.java - 1 5;Class Cart{N} Cart{N} 2 4;Function total Cart{N}.total 3 3",
        "IMPORTS - java.util.List;CONTAINS - @::Cart{N};INHERITS Cart{N} Base{N};IMPLEMENTS Cart{N} Shape{N};CONTAINS Cart{N} @::Cart{N}.total",
        "Cart{N}.total add 3;Cart{N}.total tax.rate 3",
        "List java.util.List"),
    "c": ("c", C, "File m{N}.c - 1 4;Class Point{N} Point{N} 2 2;Function total{N} total{N} 3 3", "IMPORTS - stdio.h;CONTAINS - @::Point{N};CONTAINS - @::total{N}", "total{N} rate{N} 3;total{N} p->tax 3", "stdio stdio.h"),
    "cpp": ("cpp", CPP,
        "File m{N}.cpp - 1 8;Class Cart{N} Cart{N} 2 6;Function get Cart{N}.get 4 4;Function run Cart{N}.run 7 7",
        "IMPORTS - vector;CONTAINS - @::Cart{N};INHERITS Cart{N} Base{N};CONTAINS Cart{N} @::Cart{N}.get;CONTAINS - @::Cart{N}.run",
        "Cart{N}.get std::max 4;Cart{N}.get go{N} 4;Cart{N}.run stop{N} 7",
        "vector vector"),
}


def path_of(language: str) -> str:
    return f"src/m{{N}}.{SAMPLES[language][0]}"


def expected(which: str) -> list[tuple]:
    """The rows of symbols, edges, calls or imports that all samples hold, {N} left in them."""
    out = []
    for language, (_, _, *found) in SAMPLES.items():
        path = path_of(language)
        full = lambda scope: path if scope == "-" else f"{path}::{scope}"  # noqa: B023, E731
        for row in filter(None, found[["symbols", "edges", "calls", "imports"].index(which)].split(";")):
            f = row.split(" ")
            if which == "symbols":
                out.append((language, f[0], f[1], full(f[2]), int(f[3]), int(f[4])))
            elif which == "edges":
                out.append((f[0], full(f[1]), f[2].replace("@", path)))
            elif which == "calls":
                out.append((full(f[0]), f[1], int(f[2]), path))
            else:
                out.append((path, f[0], f[1]))
    return out


def values(which: str) -> str:
    """expected() as a list of SQL rows."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in expected(which))


def sample_files(spark: SparkSession, numbers: DataFrame) -> DataFrame:
    """(path, rel_path, length, content): every sample for each number of numbers(n)."""
    few = spark.createDataFrame([(path_of(k), s[1]) for k, s in SAMPLES.items()], "path string, text string")  # one row per language
    named = lambda c: F.replace(F.col(c), F.lit("{N}"), F.col("n").cast("string"))
    rows = numbers.crossJoin(F.broadcast(few)).select(named("path").alias("path"), named("text").cast("binary").alias("content"))
    return rows.select("path", F.col("path").alias("rel_path"), F.octet_length("content").cast("long").alias("length"), "content")
