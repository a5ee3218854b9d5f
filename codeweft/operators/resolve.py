"""Call resolution: rules as joins, tried in order; the first rule with a hit wins for each call site.

A site leaves the race with its first hit, so each rule meets only what the rules
before it left. Short names that many definitions share are the hot keys here. The rules
with a cap of k need only the first k + 1 definitions of a name (one may be the
caller itself): these stand as one short array per name, so a site meets one row.
Only definitions of a name that a site left over asks for take part in that.
Imports meet definitions once per distinct name and folder (or module and method), not once per site. The pairs of
both, which grow with the square of a name's frequency, are dealt out by their number
and come last: nothing shuffles or compares them, and a site meets its definitions in arrays, not one by one.
"""

from __future__ import annotations

import math
from collections.abc import Collection
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.functions import file_of, last_segment, short_name
from codeweft.staging import discard, staged

FUZZY_CAP, AMBIGUOUS_CAP = 3, 5
#: Pairs of sites and imported definitions in a share of one name and folder, and in a task, about.
PAIRS_A_SHARE, PAIRS_A_TASK = 8_000_000, 8_000_000
#: Imported definitions in an array that a site meets, about.
TARGETS_A_ROW = 1_000
#: Rules in the order they are tried.
EXACT, IMPORT_SCOPE, IMPORT_DOT, FUZZY, IMPORTED, SAME_FILE, SINGLE, AMBIGUOUS = RULES = tuple(range(1, 9))


def prepared(call_sites: DataFrame) -> DataFrame:
    """Distinct call sites with raw (trimmed, without a leading self. or this.), prefix and method at the first separator.

    A dot is looked for before '::'. Blank callees are dropped.
    """
    raw = F.trim(F.col("raw_callee"))
    bare = F.when(raw.startswith("self.") | raw.startswith("this."), F.substring(raw, 6, 1_000_000)).otherwise(raw)
    sites = call_sites.select("caller_qname", "file_rel_path", bare.alias("raw"), (raw != "").alias("some")).where("some").drop("some").distinct()
    dot, scope = F.locate(".", F.col("raw")), F.locate("::", F.col("raw"))
    at = F.when(dot > 0, dot).otherwise(scope)
    width = F.when(dot > 0, 1).otherwise(2)
    sites = sites.withColumns({"_at": at, "_width": width})
    parts = {
        "prefix": F.when(F.col("_at") > 0, F.expr("substring(raw, 1, _at - 1)")),
        "method": F.when(F.col("_at") > 0, F.expr("substring(raw, _at + _width)")),
    }
    return sites.withColumns(parts).drop("_at", "_width")


def first_of_name(definitions: DataFrame, cap: int) -> DataFrame:
    """(short, targets): the first cap definitions of each short name, by qualified name, as an array."""
    w = Window.partitionBy("short").orderBy("target")
    first = definitions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap)
    return first.groupBy("short").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def definitions_of(nodes: DataFrame) -> DataFrame:
    """(target, short, target_file) of the nodes that can be called."""
    named = nodes.where("kind <> 'External' AND qualified_name IS NOT NULL AND qualified_name <> ''")
    return named.select("qualified_name").distinct().select(F.col("qualified_name").alias("target"), short_name("qualified_name").alias("short"), file_of("qualified_name").alias("target_file"))


def bound_to(sites: DataFrame, imports: DataFrame) -> DataFrame:
    """sites of prepared() with the module that their file binds the prefix, or the bare name, to; the greatest if it binds it twice."""
    bound = imports.groupBy("file_rel_path", "local_name").agg(F.max("module").alias("module"))
    return sites.withColumn("local_name", F.coalesce("prefix", "raw")).join(bound, ["file_rel_path", "local_name"], "left").drop("local_name")


def bound_sites(call_sites: DataFrame, imports: DataFrame) -> DataFrame:
    """bound_to() of the prepared() call sites."""
    return bound_to(prepared(call_sites), imports)


class Hits(NamedTuple):
    """few: (caller_qname, file_rel_path, raw, rule, targets), an array, of all rules but IMPORTED, whose sites are in bound
    (the first three and folder) and whose definitions are in imported (raw, folder, target)."""

    few: DataFrame
    bound: DataFrame
    imported: DataFrame


def paired(bound: DataFrame, imported: DataFrame) -> DataFrame:
    """The inner join on raw and folder, with the definitions in arrays (targets), in tasks of about as many pairs each.

    Both sides are small beside their pairs, so their bytes don't tell how many tasks are needed: a name and
    folder with many pairs is cut into shares of its sites, each with all of its definitions. A row
    has about TARGETS_A_ROW of them; whoever reads its array makes the pairs.
    """
    key = ["raw", "folder"]
    count = lambda df, name: df.groupBy(*key).agg(F.count(F.lit(1)).alias(name))
    sizes = staged(count(bound, "_sites").join(count(imported, "_targets"), key), "sizes")
    pairs = sizes.agg(F.sum(F.col("_sites").cast("double") * F.col("_targets"))).first()[0] or 0.0
    tasks = max(math.ceil(pairs / PAIRS_A_TASK), bound.sparkSession.sparkContext.defaultParallelism)
    shares = F.least("_sites", F.ceil(F.col("_sites").cast("double") * F.col("_targets") / PAIRS_A_SHARE)).cast("int")
    sizes = sizes.select(*key, shares.alias("_shares"), F.ceil(F.col("_targets") / TARGETS_A_ROW).cast("int").alias("_arrays"))
    site = F.xxhash64(*[c for c in bound.columns if c not in key])
    sites = bound.join(sizes, key).withColumn("_share", F.pmod(site, F.col("_shares")).cast("int")).drop("_shares", "_arrays")
    arrays = imported.join(sizes, key).groupBy(*key, "_shares", F.pmod(F.xxhash64("target"), F.col("_arrays")).alias("_array")).agg(F.collect_list("target").alias("targets"))
    targets = arrays.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares", "_array")
    key = [*key, "_share"]
    # never broadcast: Spark would judge targets by the bytes they had before they were repeated
    return sites.repartition(tasks, *key).join(targets.repartition(tasks, *key).hint("merge"), key).drop("_share")


def tried(call_sites: DataFrame, nodes: DataFrame, imports: DataFrame, rules: Collection[int] = RULES) -> Hits:
    """The hits of each distinct call site, those of the import rule not yet paired.

    imports are (file_rel_path, local_name, module); if a file binds a name twice, the greatest module counts.
    Nothing is made that only hits of rules other than these need.
    """
    asked = lambda *some: not set(some).isdisjoint(rules)
    defs = staged(definitions_of(nodes), "definitions")
    targets = defs.select("target")
    site = ["caller_qname", "file_rel_path", "raw"]

    def hits(rows: DataFrame, rule: Column | int, found: Column) -> DataFrame:
        return rows.select(*site, (F.lit(rule) if isinstance(rule, int) else rule).alias("rule"), found.alias("targets"))

    exact = targets.select(F.col("target").alias("raw"), F.lit(True).alias("exact"))
    # written in between, as shuffle files lie until a write ends
    ready = staged(prepared(call_sites), "prepared")
    bound = staged(bound_to(ready, imports), "bound")
    discard(ready)
    sites = staged(bound.join(exact, "raw", "left"), "sites")
    discard(bound)
    rest = sites.where("exact IS NULL").drop("exact")
    if asked(FUZZY, SAME_FILE, SINGLE, AMBIGUOUS):
        called = last_segment(F.substring_index("method", ".", -1))
        wanted = rest.select(F.when(F.col("prefix").isNotNull(), called).otherwise(F.col("raw")).alias("short")).distinct()
        defs = staged(defs.join(wanted, "short", "left_semi"), "wanted")
        names = staged(first_of_name(defs.select("short", "target"), max(FUZZY_CAP + 1, AMBIGUOUS_CAP)), "names")
    dotted, plain = rest.where("prefix IS NOT NULL"), rest.where("prefix IS NULL")
    out = [hits(sites.where("exact"), EXACT, F.array("raw"))]

    if asked(IMPORT_SCOPE, IMPORT_DOT, FUZZY):
        by = ["module", "method"]
        through = dotted.where("module IS NOT NULL")
        ways = F.array(*[F.struct(F.lit(rule).alias("rule"), F.concat_ws(sep, *by).alias("target")) for rule, sep in ((IMPORT_SCOPE, "::"), (IMPORT_DOT, "."))])
        tries = through.select(*by).distinct().select(*by, F.explode(ways).alias("way")).select(*by, "way.*")
        found = staged(tries.join(targets, "target").groupBy(*by).agg(F.min(F.struct("rule", "target")).alias("hit")), "through")
        out.append(hits(through.join(found, by), F.col("hit.rule"), F.array("hit.target")))
    if asked(FUZZY):
        left = through.join(found.select(*by), by, "left_anti").unionByName(dotted.where("module IS NULL"))
        fuzzy = left.withColumn("short", called).join(names, "short")
        out.append(hits(fuzzy, FUZZY, F.slice(F.filter("targets", lambda t: t != F.col("caller_qname")), 1, FUZZY_CAP)))

    folder = F.replace(F.replace("module", F.lit("."), F.lit("/")), F.lit("::"), F.lit("/"))
    bound = plain.where("module IS NOT NULL").withColumn("folder", folder)
    imported = bound.select(F.col("raw").alias("short"), "folder").distinct().join(defs.select("short", "target"), "short").where(F.startswith("target", F.col("folder")))
    imported = imported.select(F.col("short").alias("raw"), "folder", "target")
    if asked(IMPORTED, SAME_FILE, SINGLE, AMBIGUOUS):
        imported = staged(imported, "imported")
    if asked(SAME_FILE, SINGLE, AMBIGUOUS):
        left = bound.join(imported.select("raw", "folder").distinct(), ["raw", "folder"], "left_anti").drop("folder").unionByName(plain.where("module IS NULL"))
        own = defs.groupBy(F.col("short").alias("raw"), F.col("target_file").alias("file_rel_path")).agg(F.collect_list("target").alias("own"))  # of one file
        left = left.join(own, ["raw", "file_rel_path"], "left").join(names.withColumnRenamed("short", "raw"), "raw", "left")
        rule = F.when(F.col("own").isNotNull(), SAME_FILE).when(F.size("targets") == 1, SINGLE).otherwise(AMBIGUOUS)
        out.append(hits(left, rule, F.coalesce("own", F.slice("targets", 1, AMBIGUOUS_CAP))))
    few = reduce(DataFrame.unionByName, out)
    return Hits(few, bound.select(*site, "folder"), imported)


def resolve(call_sites: DataFrame, nodes: DataFrame, imports: DataFrame, rules: Collection[int] = RULES) -> DataFrame:
    """(caller_qname, file_rel_path, raw, rule, target): the targets of each distinct call site whose first hit is by one of rules; arguments as tried() has them."""
    few, bound, imported = tried(call_sites, nodes, imports, rules)
    found = few.where(F.col("rule").isin(*rules))
    if IMPORTED in rules:
        found = found.unionByName(paired(bound, imported).withColumn("rule", F.lit(IMPORTED)).select(*few.columns))
    # above the union: arrays go through it, and their rows straight to whatever reads them
    return found.select(*few.drop("targets").columns, F.explode("targets").alias("target"))


def call_edges(call_sites: DataFrame, nodes: DataFrame, imports: DataFrame) -> DataFrame:
    """CALLS edges of resolve()'s rows, duplicates collapsed before the import rule's sites meet their definitions.

    A definition has one name, and folders it starts with start with each other. So for a caller and a name
    only folders that no other of its folders begins count, and no pair comes twice; what other
    rules found is dropped where such a folder has it.
    """
    few, bound, imported = tried(call_sites, nodes, imports)
    named = bound.where("caller_qname <> ''").groupBy("caller_qname", "raw").agg(F.collect_set("folder").alias("folders"))
    within = lambda f: F.exists("folders", lambda g: (g != f) & F.startswith(f, g))
    named = staged(named.select("caller_qname", "raw", F.explode(F.filter("folders", lambda f: ~within(f))).alias("folder")), "named")
    other = few.select("caller_qname", F.explode("targets").alias("target")).where("caller_qname <> '' AND target <> ''").distinct()
    other = staged(other, "other").withColumn("short", short_name("target"))
    b = named.select(F.col("caller_qname").alias("_caller"), "raw", "folder")
    has = (F.col("caller_qname") == F.col("_caller")) & (F.col("short") == F.col("raw")) & F.startswith("target", F.col("folder"))
    pairs = paired(named, imported).select("caller_qname", F.explode("targets").alias("target")).unionByName(other.join(b, has, "left_anti").select("caller_qname", "target"))
    return pairs.select(F.lit("CALLS").alias("kind"), F.col("caller_qname").alias("source"), "target")
