"""Shared helpers of the corpus operators.

Conventions that hold for every operator of this subpackage:

* it reads only the columns it names, so extra columns, also ones whose names
  clash with its own, do no harm;
* a null text counts as empty and a null id stays null;
* repeated rows are repeated in the result (one result row for each input row)
  unless the operator's docstring says otherwise;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import staging
from codeweft.staging import discard, fresh_path, shared_folder

__all__ = ["NOT_SPACE", "SPACE", "bounded_ids", "discard", "fresh_path", "looked_up", "lower_ascii", "shared_folder", "small_batches", "staged", "table", "words_of"]

#: Fixed value: a word is a run of characters other than these, as a Java and Python class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes, as Spark estimates them, that it may broadcast without a hint while a table is staged.
MOST_BROADCAST = 1 << 20
#: Rows and bytes of a batch that goes to Python, at most, after small_batches().
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
_THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """staging.staged(), where Spark broadcasts of its own accord only what it takes for MOST_BROADCAST bytes at most.

    The driver builds each broadcast table, several at a time, and rows that are exploded
    or well compressed take many times the bytes that Spark estimates.
    """
    spark = df.sparkSession
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {k: spark.conf.get(k, None) for k in _THRESHOLDS}
    for k in _THRESHOLDS[: 1 + (before[_THRESHOLDS[1]] is not None)]:  # the second follows the first where it is unset
        if not (now := spark.conf.get(k)).startswith("-"):  # none at all
            spark.conf.set(k, min(bytes_of(now), MOST_BROADCAST))
    try:
        return staging.staged(df, name, instead_of)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends rows to Python in batches of at most BATCH_ROWS rows and about BATCH_BYTES; lower settings stay.

    By default a batch is up to 10,000 texts: the JVM writes, and reads back, a task's whole text
    outside its heap, for every task at once, and keeps much of that memory, as the Python workers do.
    The setting stays, because a stage's result is computed only when its caller writes it.
    """
    for k, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{k}"
        now = spark.conf.get(name, None) or "0"  # 0 or less: no limit
        if now.startswith("-") or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
            spark.conf.set(name, most)


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; empty for null or blank."""
    parts = F.split(text, SPACE + "+", -1)
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_ids(ids: DataFrame, limit: int) -> DataFrame:
    """At most limit rows of ids (first column: the id), the same on every run: those of smallest hash.

    A threshold on the hash, set from the exact count, keeps what meets in one
    task near the limit however many rows there are.
    """
    key, order = ids.columns[0], F.xxhash64(ids.columns[0])
    rows = ids.count()
    if rows > limit:
        share = min(1.0, 1.2 * limit / rows + 1e-3)
        ids = ids.where(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)))
    return ids.orderBy(F.pmod(order, F.lit(1 << 20)), order, key, *ids.columns[1:]).limit(limit)


def looked_up(rows: DataFrame, names: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with names on key, which names has once each; n is how many of rows have it, and is left out.

    Keys of more than a thousandth of all rows, so at most a thousand of them, are
    broadcast: a key that a third of the rows share doesn't meet in one task. The other
    names never are, as they may be as many as rows. Both sides are read twice and should be tables.
    """
    total = names.agg(F.sum(n)).first()[0] or 0
    hot = names.where(F.col(n) > max(1_000, total // 1_000)).drop(n)
    rare = names.where(F.col(n) <= max(1_000, total // 1_000)).drop(n)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(rare.hint("merge"), key))
