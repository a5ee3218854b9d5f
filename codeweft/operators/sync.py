"""Builds and keeps a stored graph: full builds with a hash cache, and change sets.

Both end in the same place: files are replaced or removed, and the calls that this can
have changed are resolved again from the stored call sites, so an updated graph
equals a rebuilt one, calls from unchanged files into changed ones included. A
call can have changed if a name it is looked up by is defined in a changed file, before
or after.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft import schema
from codeweft.functions import last_segment, short_name
from codeweft.operators import store as stores
from codeweft.operators.resolve import bound_sites, call_edges
from codeweft.operators.store import GraphStore
from codeweft.sources import changes as feed
from codeweft.sources.parse import exploded, parse_files
from codeweft.sources.tree import cache_split, read_tree, selected
from codeweft.staging import staged

#: Stage, files or sites done, of how many.
Progress = Callable[[str, int, int], None]
#: Problems that a result names; problems has them all.
NAMED = 100


@dataclass(frozen=True)
class SyncResult:
    """What a build or update did. Counts of nodes and edges are those of the parsed files, before they are merged.

    problems is a table (file_rel_path, problem) of all files that are missing, too
    large or can't be parsed whole; errors are its first NAMED rows, without those too large.
    """

    files_parsed: int = 0
    files_deleted: int = 0
    files_skipped_hash: int = 0
    files_missing: int = 0
    files_too_large: int = 0
    files_with_errors: int = 0
    nodes_added: int = 0
    edges_added: int = 0
    calls: int = 0
    errors: tuple[str, ...] = ()
    base_ref: str = ""
    problems: DataFrame | None = field(default=None, compare=False, repr=False)


def looked_up_by(sites: DataFrame) -> Column:
    """array<string>: the short names that decide what a bound site calls, each of the rules' targets having one of them."""
    own = [short_name("raw"), F.col("raw"), last_segment(F.substring_index("method", ".", -1)), short_name(F.concat_ws("::", "module", "method")), short_name(F.concat_ws(".", "module", "method"))]
    return F.array_distinct(F.array_compact(F.array(*own)))


def _store(store: GraphStore, gone_files: DataFrame, parsed: DataFrame, missing: DataFrame, too_large: DataFrame, progress: Progress, **counts: object) -> SyncResult:
    """Writes a version without the files gone_files(file_rel_path) and with the parsed ones, their calls and calls of their names resolved."""
    parsed = staged(parsed, "parsed")
    n_parsed = parsed.count()
    progress("extracting", n_parsed, n_parsed)
    nodes, edges, sites, imports = exploded(parsed)
    files = staged(gone_files.select("file_rel_path").unionByName(parsed.select("file_rel_path")).distinct(), "replaced")
    gone, added = stores.replaced(store, files, nodes, edges, sites, imports)
    gone, added = ({n: staged(df, n) for n, df in d.items()} for d in (gone, added))

    # the tables as they will be, and the callers whose calls can have changed
    after = {n: store.table(n).join(gone[n].select(*stores.KEYS[n]).distinct(), stores.KEYS[n], "left_anti").select(*stores.TABLES[n].names).unionByName(added[n]) for n in stores.TABLES}
    names = gone["nodes"].unionByName(added["nodes"]).where("kind <> 'External'").select(short_name("qualified_name").alias("short")).distinct()
    bound = staged(bound_sites(after["call_sites"], after["imports"]), "bound")
    hit = bound.select("caller_qname", F.explode(looked_up_by(bound)).alias("short")).join(names, "short", "left_semi").select("caller_qname")
    callers = staged(hit.unionByName(bound.join(files, "file_rel_path", "left_semi").select("caller_qname")).distinct(), "callers")
    again = staged(after["call_sites"].join(callers, "caller_qname", "left_semi").select(*schema.CALL_SITE.names), "sites")
    total = again.count()
    progress("resolving_calls", 0, total)
    wanted = bound.join(callers, "caller_qname", "left_semi").select(F.explode(looked_up_by(bound)).alias("short")).distinct()
    defined = after["nodes"].where("kind <> 'External'").withColumn("short", short_name("qualified_name")).join(wanted, "short", "left_semi").drop("short")
    calls = staged(call_edges(again, defined, after["imports"]), "calls")
    progress("resolving_calls", total, total)

    # calls of these callers go and come; an External that no other edge names any more goes too
    before = store.table("edges").where("kind = 'CALLS'").join(callers.withColumnRenamed("caller_qname", "source"), "source", "left_semi").select(*schema.EDGE.names)
    dropped = gone["edges"].where("kind <> 'CALLS'").select(F.col("target").alias("node_id")).distinct()
    named = after["edges"].where("kind <> 'CALLS'").select(F.col("target").alias("node_id"))
    orphans = after["nodes"].where("kind = 'External'").join(dropped, "node_id", "left_semi").join(named, "node_id", "left_anti").select(*schema.NODE.names)
    # edges into replaced files come back as placeholders if the name is gone
    lost = external_targets(after["edges"], gone["nodes"], after["nodes"])
    gone |= {"edges": gone["edges"].unionByName(before).distinct(), "nodes": gone["nodes"].unionByName(orphans)}
    added |= {"edges": added["edges"].unionByName(calls), "nodes": added["nodes"].unionByName(lost)}
    store.change(gone, added)

    broken = parsed.where("error IS NOT NULL").select("file_rel_path", F.col("error").alias("problem"))
    absent = missing.select("file_rel_path", F.lit("not found").alias("problem"))
    large = too_large.select("file_rel_path", F.lit("too large").alias("problem"))
    problems = staged(broken.unionByName(absent).unionByName(large), "problems")
    by = {r.problem: r.n for r in problems.groupBy(F.when(F.col("problem").isin("not found", "too large"), F.col("problem")).alias("problem")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first = problems.where("problem <> 'too large'").orderBy("file_rel_path", "problem").limit(NAMED).collect()
    return SyncResult(
        files_parsed=n_parsed, files_missing=by.get("not found", 0), files_too_large=by.get("too large", 0), files_with_errors=by.get(None, 0),
        nodes_added=nodes.count(), edges_added=edges.count(), calls=calls.count(), errors=tuple(f"{r.file_rel_path}: {r.problem}" for r in first), problems=problems, **counts,
    )


def external_targets(edges: DataFrame, removed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placeholders for removed nodes that edges other than CALLS still name."""
    named = edges.where("kind <> 'CALLS'").join(removed.select(F.col("node_id").alias("target")).distinct(), "target", "left_semi").select("target")
    return stores.external_nodes(named, nodes)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "file_rel_path string")


def build(spark: SparkSession, root: str, store: GraphStore, folders: list[str] | None = None, most_bytes: int = schema.MOST_BYTES, progress: Progress = lambda *_: None) -> SyncResult:
    """Brings the store up to date with a source tree: changed files are parsed, vanished ones removed, the rest kept.

    progress is called with the stages discovering, checking_cache, extracting and resolving_calls.
    """
    files = selected(read_tree(spark, root), folders, most_bytes)
    found = staged(files.select(F.col("rel_path").alias("file_rel_path")), "found")
    total = found.count()
    progress("discovering", total, total)
    same, changed = cache_split(files, store.table("nodes"))
    stored = store.table("nodes").where("kind = 'File'").select("file_rel_path").distinct()
    gone = staged(stored.join(found, "file_rel_path", "left_anti"), "gone")
    kept = same.select("rel_path").count()
    progress("checking_cache", total, total)
    progress("extracting", 0, total - kept)
    return _store(store, gone, parse_files(changed), _none(spark), _none(spark), progress, files_skipped_hash=kept, files_deleted=gone.count())


def apply_changes(spark: SparkSession, root: str, store: GraphStore, delta: DataFrame, folders: list[str] | None = None, most_bytes: int = schema.MOST_BYTES, base_ref: str = "", progress: Progress = lambda *_: None) -> SyncResult:
    """Applies decoded changes (status, old_path, path) of a tree.

    A file to process that is missing is an error, one that is too large keeps its
    old rows, one whose stored hash is the same is skipped.
    """
    delta = staged(delta.select(*schema.CHANGE.names), "delta")
    wanted = feed.to_process(delta)
    tree = read_tree(spark, root).join(wanted.withColumnRenamed("path", "rel_path"), "rel_path", "left_semi")
    sizes = staged(tree.select(F.col("rel_path").alias("file_rel_path"), "length"), "sizes")
    progress("discovering", sizes.count(), wanted.count())
    same, changed = cache_split(selected(tree, folders, most_bytes), store.table("nodes"))
    missing = wanted.select(F.col("path").alias("file_rel_path")).join(sizes, "file_rel_path", "left_anti")
    old = F.when(F.col("status") == "R", F.col("old_path")).otherwise(F.col("path"))
    gone = delta.where("status IN ('D', 'R')").select(old.alias("file_rel_path")).distinct()
    kept = same.select("rel_path").count()
    progress("checking_cache", kept, kept)
    return _store(store, gone, parse_files(changed), missing, sizes.where(F.col("length") > most_bytes), progress, files_skipped_hash=kept, files_deleted=gone.count(), base_ref=base_ref)


def sync(spark: SparkSession, root: str, store: GraphStore, base_ref: str = "HEAD", **options: object) -> SyncResult:
    """Applies what git says changed against base_ref."""
    return apply_changes(spark, root, store, feed.read_diff(spark, root, base_ref), base_ref=base_ref, **options)
