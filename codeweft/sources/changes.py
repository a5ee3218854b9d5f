"""Change feeds: name-status lines of a version control diff, decoded by column expressions."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StringType, StructField, StructType

from codeweft.functions import is_supported


class NotARepository(RuntimeError):
    """The folder is under no version control that git knows, or git is missing."""


def diff_lines(root: str, base_ref: str = "HEAD") -> list[str]:
    """The lines of git's name-status diff against base_ref; untracked files are not in it.

    With -z names come unquoted, so a status and its one or two names are put back on one line.
    """
    try:
        done = subprocess.run(["git", "diff", "--name-status", "-z", base_ref], cwd=root, capture_output=True)
    except FileNotFoundError as e:
        raise NotARepository(f"git was not found, or {root} does not exist") from e
    if done.returncode:
        message = done.stderr.decode(errors="replace")
        if "not a git repository" in message.lower():
            raise NotARepository(message.strip())
        raise subprocess.CalledProcessError(done.returncode, done.args, done.stdout, done.stderr)
    fields = iter(done.stdout.decode(errors="surrogateescape").split("\0"))
    lines = []
    for status in fields:
        if status:
            names = [next(fields, "") for _ in range(2 if status[0] in "RC" else 1)]
            lines.append("\t".join([status, *names]))
    return lines


class GitDiffSource(DataSource):
    """spark.read.format("gitdiff").option("base_ref", "HEAD").load(root): one row per line of the diff."""

    @classmethod
    def name(cls) -> str:
        return "gitdiff"

    def schema(self) -> StructType:
        return StructType([StructField("line", StringType())])

    def reader(self, schema: StructType) -> DataSourceReader:
        return GitDiffReader(self.options)


class GitDiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.base_ref = options.get("path", "."), options.get("base_ref", "HEAD")

    def read(self, partition) -> Iterator[tuple[str]]:
        return ((line,) for line in diff_lines(self.root, self.base_ref))


def read_diff(spark: SparkSession, root: str, base_ref: str = "HEAD") -> DataFrame:
    """The decoded changes of a working tree. The diff runs on the driver, where the working tree is."""
    return decode(spark.createDataFrame([(x,) for x in diff_lines(root, base_ref)], "line string"))


def decode(lines: DataFrame, line: str = "line", folders: list[str] | None = None) -> DataFrame:
    """(status, old_path, path) of name-status lines: A, M, D and R, of supported files only.

    A rename from an unsupported name is an addition, one to an unsupported name a
    deletion; copies and other statuses, lines with too few fields and blank lines are left out.
    """
    f = F.split(F.trim(F.col(line)), "\t")
    code, one, two = F.trim(F.get(f, F.lit(0))), F.trim(F.get(f, F.lit(1))), F.trim(F.get(f, F.lit(2)))
    rows = lines.select(code.alias("code"), one.alias("one"), two.alias("two"))
    # columns of their own: what is used in several branches is made once
    rows = rows.withColumns({"_first": is_supported("one", folders), "_second": is_supported("two", folders)})
    first, second = F.col("_first"), F.col("_second")
    renamed = F.col("code").startswith("R") & F.col("two").isNotNull()
    status = (
        F.when(F.col("code").isin("A", "M", "D") & first, F.col("code"))
        .when(renamed & first & second, "R")
        .when(renamed & first, "D")
        .when(renamed & second, "A")
    )
    rows = rows.withColumns({"status": status, "_renamed": renamed})
    path = F.when(F.col("_renamed") & F.col("status").isin("R", "A"), F.col("two")).otherwise(F.col("one"))
    return rows.where("status IS NOT NULL").select("status", F.when(F.col("status") == "R", F.col("one")).alias("old_path"), path.alias("path"))


def to_process(changes: DataFrame) -> DataFrame:
    """(path): added, modified and new names of renamed files."""
    return changes.where(F.col("status").isin("A", "M", "R")).select("path").distinct()


def to_purge(changes: DataFrame) -> DataFrame:
    """(path): modified, deleted and old names of renamed files."""
    old = F.when(F.col("status") == "R", F.col("old_path")).otherwise(F.col("path"))
    return changes.where(F.col("status").isin("M", "D", "R")).select(old.alias("path")).distinct()
