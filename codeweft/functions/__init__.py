"""Column expressions over paths, qualified names and kinds, and their SQL names."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from codeweft import schema


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def file_of(qname: str | Column) -> Column:
    """The file of a qualified name: what stands before the first '::'."""
    return F.substring_index(_col(qname), "::", 1)


def last_segment(name: str | Column) -> Column:
    """What stands after the last '::', then after the last '.'."""
    return F.substring_index(F.substring_index(_col(name), "::", -1), ".", -1)


def short_name(qname: str | Column) -> Column:
    """The name a definition is looked up by: its last segment, or a file's base name."""
    q = _col(qname)
    return F.when(F.contains(q, F.lit("::")), last_segment(q)).otherwise(F.substring_index(q, "/", -1))


def suffix(path: str | Column) -> Column:
    """The lower-cased suffix of a path with its dot; '' without one."""
    return F.lower(F.regexp_extract(F.substring_index(_col(path), "/", -1), r"^.+(\.[^.]*)$", 1))


def language_of(path: str | Column) -> Column:
    """The language of a path by its suffix, null if it is none of ours."""
    known = F.create_map(*[F.lit(x) for pair in schema.LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix(path))


def in_skipped_folder(path: str | Column, folders: list[str] | None = None) -> Column:
    """Whether a part of a relative path is one of folders (case counts)."""
    names = schema.SKIPPED_FOLDERS if folders is None else folders
    if not names:
        return F.lit(False)
    return F.arrays_overlap(F.split(_col(path), "/"), F.array(*[F.lit(x) for x in names]))


def is_supported(path: str | Column, folders: list[str] | None = None) -> Column:
    return language_of(path).isNotNull() & ~in_skipped_folder(path, folders)


def line_count(text: str | Column) -> Column:
    """Line ends plus one."""
    return F.regexp_count(_col(text), F.lit("\n")) + 1


def in_test_folder(path: str | Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(_col(path)), "/"), F.array(*[F.lit(x) for x in schema.TEST_FOLDERS]))


def kind_priority(kind: str | Column) -> Column:
    k, out = _col(kind), F.lit(schema.OTHER_PRIORITY)
    for name, rank in schema.KIND_PRIORITY.items():
        out = F.when(k == name, rank).otherwise(out)
    return out


def register(spark: SparkSession) -> None:
    """SQL functions file_of, short_name, last_segment and kind_priority, as temporary SQL functions that Catalyst inlines."""
    ranks = " ".join(f"WHEN '{k}' THEN {v}" for k, v in schema.KIND_PRIORITY.items())
    bodies = {
        "file_of(q STRING)": "substring_index(q, '::', 1)",
        "last_segment(q STRING)": "substring_index(substring_index(q, '::', -1), '.', -1)",
        "short_name(q STRING)": "CASE WHEN contains(q, '::') THEN substring_index(substring_index(q, '::', -1), '.', -1) ELSE substring_index(q, '/', -1) END",
        "kind_priority(k STRING)": f"CASE k {ranks} ELSE {schema.OTHER_PRIORITY} END",
    }
    for head, body in bodies.items():
        kind = "INT" if head.startswith("kind") else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
