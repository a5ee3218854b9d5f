"""Tolerant parsers, one text in, symbols and relations out. Pure Python; none of them raises on bad input.

parse(text, rel_path, language) gives a Parsed value; python goes through the
ast module, the other languages through one tokenizer that knows strings,
comments and matching brackets.
"""

from __future__ import annotations

from codeweft import schema
from codeweft.sources.parsers.common import Parsed


def parse(text: str, rel_path: str, language: str) -> Parsed:
    """The file's symbols, edges, call sites and import bindings; a File symbol is always there."""
    from codeweft.sources.parsers import braces, python

    out = Parsed(rel_path, language)
    out.symbols.append(("File", rel_path.rsplit("/", 1)[-1], rel_path, 1, text.count("\n") + 1))
    try:
        (python.parse if language == "python" else braces.parse)(text, out)
    except (RecursionError, MemoryError):  # the ast module raises the latter, too, when its stack is full
        out.error = "nested too deeply"  # what was found before stays
    return out


LANGUAGES = sorted(set(schema.LANGUAGES.values()))
