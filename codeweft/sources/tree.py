"""Source trees: a parallel scan of files, their language, dialect and hash as columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import schema
from codeweft.functions import in_skipped_folder, language_of, suffix
from codeweft.staging import staged


def _base(root: str) -> str:
    return (root if "://" in root or root.startswith("file:") else f"file:{root}").rstrip("/")


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with a scheme, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def empty_files(spark: SparkSession, base: str) -> DataFrame:
    """(rel_path): the empty files under a folder, listed by tasks, one level of folders after the other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(base)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = fs.get_file_info(pafs.FileSelector(f"{top}/{folder}" if folder else top, allow_not_found=True))
                kept = [(x.path[len(top) + 1 :], x.type == pafs.FileType.Directory) for x in found if x.type == pafs.FileType.Directory or (x.is_file and not x.size)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kept], pa.string()), pa.array([d for _, d in kept], pa.bool_())], names=["rel_path", "folder"])

    level, found = spark.createDataFrame([("",)], "rel_path string"), []
    while True:
        listed = staged(level.mapInArrow(each, "rel_path string, folder boolean"), "listed")
        found.append(listed.where("NOT folder").select("rel_path"))
        level = listed.where("folder").select("rel_path")
        n = level.count()
        if not n:
            return reduce(DataFrame.unionByName, found)
        level = level.repartition(min(n, spark.sparkContext.defaultParallelism * 4))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, length, content) of all files under root, by Spark's binaryFile source.

    rel_path is relative to root. A filter on length reaches the source, and content is
    only read where it is selected. That source leaves out empty files; they are listed apart.
    """
    base = _base(root)
    bare = base.split(":", 1)[1].lstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "")
    full = files.select("path", F.substring(plain, len(bare) + 2, 1_000_000).alias("rel_path"), "length", "content")
    empty = empty_files(spark, base).where(language_of("rel_path").isNotNull())
    return full.unionByName(empty.select(F.concat(F.lit(f"{base}/"), "rel_path").alias("path"), "rel_path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def write_files(files: DataFrame, root: str) -> int:
    """Writes files(path, content) under a folder, how many; a task that is run again writes the same."""
    base = _base(root)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(base)
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                fs.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with fs.open_output_stream(f"{top}/{path}") as out:
                    out.write(content.as_py() or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    return files.select("path", F.col("content").cast("binary")).mapInArrow(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def is_cpp(content: Column) -> Column:
    """Whether the first bytes of a header hold a sign of C++."""
    head = F.substring(content, 1, schema.SNIFFED)
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(s).cast("binary")) for s in schema.CPP_SIGNS])


def selected(files: DataFrame, folders: list[str] | None = None, most_bytes: int = schema.MOST_BYTES, rel: str = "rel_path") -> DataFrame:
    """Files of a known language outside skipped folders and not over most_bytes, with language and file_hash (md5).

    The cheap predicates come first, so that other files' contents are never looked at.
    """
    kept = files.where((F.col("length") <= most_bytes) & language_of(rel).isNotNull() & ~in_skipped_folder(rel, folders))
    dialect = F.when((suffix(rel) == ".h") & F.coalesce(is_cpp(F.col("content")), F.lit(False)), "cpp").otherwise(language_of(rel))
    return kept.withColumns({"language": dialect, "file_hash": F.md5("content")})


def cache_split(files: DataFrame, nodes: DataFrame, rel: str = "rel_path") -> tuple[DataFrame, DataFrame]:
    """(unchanged, changed) files: unchanged ones have a File node of the same path and the same, non-empty, hash."""
    known = nodes.where("kind = 'File' AND file_hash <> ''").select(F.col("file_rel_path").alias(rel), "file_hash").distinct()
    return files.join(known, [rel, "file_hash"], "left_semi"), files.join(known, [rel, "file_hash"], "left_anti")
