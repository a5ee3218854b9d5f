"""What parsers collect."""

from __future__ import annotations

from dataclasses import dataclass, field

from codeweft import schema

#: Languages whose functions are tests by the beginning of their name.
TEST_NAMES = {"python": ("test_", "Test"), "javascript": ("test", "spec"), "typescript": ("test", "spec"), "tsx": ("test", "spec"), "java": ("test",)}


@dataclass
class Parsed:
    rel_path: str
    language: str
    symbols: list[tuple[str, str, str, int, int]] = field(default_factory=list)  # kind, name, qualified name, first and last line
    edges: list[tuple[str, str, str]] = field(default_factory=list)  # kind, source, target
    calls: list[tuple[str, str, int]] = field(default_factory=list)  # caller, callee as written, line
    imports: dict[str, str] = field(default_factory=dict)  # local name -> module
    error: str | None = None

    def qname(self, scope: list[str]) -> str:
        return f"{self.rel_path}::{'.'.join(scope)}" if scope else self.rel_path

    def is_test(self, name: str) -> bool:
        parts = {p.lower() for p in self.rel_path.split("/")}
        return name.startswith(TEST_NAMES.get(self.language, ())) if not parts & {*schema.TEST_FOLDERS} and self.language in TEST_NAMES else bool(parts & {*schema.TEST_FOLDERS})

    def define(self, kind: str, scope: list[str], first: int, last: int, parent: str) -> str:
        """Adds a symbol and its CONTAINS edge; kind Function becomes Test where the name or folder says so."""
        if kind == "Function" and self.is_test(scope[-1]):
            kind = "Test"
        q = self.qname(scope)
        self.symbols.append((kind, scope[-1], q, first, last))
        self.edges.append(("CONTAINS", parent, q))
        return q

    def imported(self, target: str) -> None:
        self.edges.append(("IMPORTS", self.rel_path, target))
