"""Schemas and fixed domains of a code property graph."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

NODE = StructType([
    StructField("kind", StringType()),
    StructField("name", StringType()),
    StructField("qualified_name", StringType()),  # null on External
    StructField("node_id", StringType()),  # qualified_name, or the raw target of an External
    StructField("file_path", StringType()),
    StructField("file_rel_path", StringType()),  # '' on External
    StructField("line_start", IntegerType()),
    StructField("line_end", IntegerType()),
    StructField("language", StringType()),
    StructField("file_hash", StringType()),
    StructField("external", BooleanType()),
])
EDGE = StructType([StructField("kind", StringType()), StructField("source", StringType()), StructField("target", StringType())])
CALL_SITE = StructType([
    StructField("caller_qname", StringType()),
    StructField("raw_callee", StringType()),
    StructField("line", IntegerType()),
    StructField("file_rel_path", StringType()),
])
IMPORT = StructType([StructField("file_rel_path", StringType()), StructField("local_name", StringType()), StructField("module", StringType())])
#: One parsed file: what the parsers return, exploded into the tables above.
SYMBOL = StructType([
    StructField("kind", StringType()),
    StructField("name", StringType()),
    StructField("qualified_name", StringType()),
    StructField("line_start", IntegerType()),
    StructField("line_end", IntegerType()),
])
PARSED = StructType([
    StructField("file_path", StringType()),
    StructField("file_rel_path", StringType()),
    StructField("language", StringType()),
    StructField("file_hash", StringType()),
    StructField("symbols", ArrayType(SYMBOL)),
    StructField("edges", ArrayType(EDGE)),
    StructField("calls", ArrayType(CALL_SITE)),
    StructField("imports", MapType(StringType(), StringType())),
    StructField("error", StringType()),
])
CHANGE = StructType([StructField("status", StringType()), StructField("old_path", StringType()), StructField("path", StringType())])

EDGE_KINDS = ["CALLS", "IMPORTS", "INHERITS", "IMPLEMENTS", "CONTAINS"]
#: The order of kinds among symbols at the same distance; others come last.
KIND_PRIORITY = {"Class": 0, "Interface": 1, "Function": 2, "Test": 3, "File": 4}
OTHER_PRIORITY = 99
#: Suffixes and their languages; .h counts as c unless its text looks like C++.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "tsx",
    ".go": "go", ".java": "java", ".rs": "rust",
    ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
}
#: Folders that are never scanned.
SKIPPED_FOLDERS = [
    ".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".env", "dist", "build",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target", "vendor",
]
#: A header with one of these in its first SNIFFED bytes is C++.
CPP_SIGNS = ["class ", "namespace ", "template<", "template <", "public:", "private:", "protected:", "::"]
SNIFFED = 4096
#: Larger files are skipped; path parts that make a file's functions tests.
MOST_BYTES = 1_000_000
TEST_FOLDERS = ["test", "tests", "spec", "specs", "__tests__"]
