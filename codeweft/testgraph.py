"""A code graph made from the driver's star-schema tables, so that every operator has a SQL oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.graph import CodeGraph, external_nodes
from codeweft.staging import keep, staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_file() -> Column:
    return F.concat(F.lit("crm/n"), F.col("c_nationkey"), F.lit(".py"))


def order_file() -> Column:
    return F.concat(F.lit("sales/"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".go"))


def part_file() -> Column:
    return F.concat(F.lit("cat/"), F.col("p_brand"), F.lit(".ts"))


def supplier_file() -> Column:
    return F.concat(F.lit("supply/n"), F.col("s_nationkey"), F.lit(".rs"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, name, file, qname, key, of): a symbol per customer, order, part and supplier."""
    def of(name: str, kind: str, key: str, file: Column, short: Column, local: Column) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.lit(kind).alias("kind"), short.alias("name"), file.alias("file"), F.concat(file, F.lit("::"), local).alias("qname"), F.col(key).alias("key"), F.lit(name).alias("of")
        )

    tag = lambda letter, key: F.concat(F.lit(letter), F.col(key))
    parts = [
        of("customer", "Class", "c_custkey", customer_file(), tag("C", "c_custkey"), tag("C", "c_custkey")),
        of("orders", "Function", "o_orderkey", order_file(), tag("O", "o_orderkey"), tag("O", "o_orderkey")),
        of("part", "Function", "p_partkey", part_file(), F.col("p_name"), F.concat(tag("P", "p_partkey"), F.lit("."), F.col("p_name"))),
        of("supplier", "Interface", "s_suppkey", supplier_file(), tag("S", "s_suppkey"), tag("S", "s_suppkey")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def star_graph(spark: SparkSession, sf_dir: str, least_quantity: float = 0.0) -> CodeGraph:
    """Files contain symbols; customers call orders, orders parts, parts suppliers; customers inherit from their segment (External).

    Only lines of at least least_quantity make calls from orders to parts.
    """
    named = symbols(spark, sf_dir)
    pick = lambda name, alias: named.where(F.col("of") == name).select("key", F.col("qname").alias(alias))
    def node(kind: Column, name: Column, qname: Column, file: Column) -> list[Column]:
        return [kind.alias("kind"), name.alias("name"), qname.alias("qualified_name"), qname.alias("node_id"), F.concat(F.lit("/proj/"), file).alias("file_path"), file.alias("file_rel_path"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.substring_index(file, ".", -1).alias("language"), F.md5(file.cast("binary")).alias("file_hash"), F.lit(False).alias("external")]

    nodes = named.select(*node(F.col("kind"), F.col("name"), F.col("qname"), F.col("file")))
    files = named.select("file").distinct().select(*node(F.lit("File"), F.substring_index("file", "/", -1), F.col("file"), F.col("file")))
    contains = named.select(F.lit("CONTAINS").alias("kind"), F.col("file").alias("source"), F.col("qname").alias("target"))
    orders, lines, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    edge = lambda df: df.select(F.lit("CALLS").alias("kind"), "source", "target").distinct()
    ordered = orders.join(pick("customer", "source"), orders["o_custkey"] == F.col("key")).drop("key").join(pick("orders", "target"), F.col("o_orderkey") == F.col("key"))
    bought = lines.where(F.col("l_quantity") >= least_quantity).join(pick("orders", "source"), F.col("l_orderkey") == F.col("key")).drop("key").join(pick("part", "target"), F.col("l_partkey") == F.col("key"))
    supplied = lines.join(pick("part", "source"), F.col("l_partkey") == F.col("key")).drop("key").join(pick("supplier", "target"), F.col("l_suppkey") == F.col("key"))
    inherits = customers.join(pick("customer", "source"), F.col("c_custkey") == F.col("key")).select(F.lit("INHERITS").alias("kind"), "source", F.col("c_mktsegment").alias("target"))
    edges = contains.unionByName(edge(ordered)).unionByName(edge(bought)).unionByName(edge(supplied)).unionByName(inherits)
    known = files.unionByName(nodes)
    return CodeGraph(known.unionByName(external_nodes(inherits.select("target"), known)), edges)


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """nodes or edges of star_graph, written once for each application and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = keep(staged(getattr(star_graph(spark, sf_dir), name), name))
    return _STAGED[key]


def staged_star(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """star_graph, written once for each application and folder."""
    return CodeGraph(_once(spark, sf_dir, "nodes"), _once(spark, sf_dir, "edges"))


def nation_graph(spark: SparkSession, sf_dir: str, share: float = 0.0017) -> CodeGraph:
    """A cyclic graph: a nation calls another whose suppliers sold its customers at least this share of all lines."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = sold.groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    total = lines.agg(F.count(F.lit(1)).alias("total"))
    edges = counts.crossJoin(F.broadcast(total)).where(F.col("n") >= F.lit(share) * F.col("total"))
    name = lambda c: F.concat(F.lit("N"), F.col(c))
    nodes = table(spark, sf_dir, "nation").select(
        F.lit("Function").alias("kind"), F.col("n_name").alias("name"), name("n_nationkey").alias("qualified_name"), name("n_nationkey").alias("node_id"),
        F.lit("/proj/n.py").alias("file_path"), F.lit("n.py").alias("file_rel_path"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), F.lit("python").alias("language"), F.lit("h").alias("file_hash"), F.lit(False).alias("external"),
    )
    return CodeGraph(nodes, edges.select(F.lit("CALLS").alias("kind"), name("s_nationkey").alias("source"), name("c_nationkey").alias("target")))


def star_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites, a row per line, four spellings in turn by line number: a part's qualified name, obj.name, its bare name, self. and a supplier's name."""
    named = symbols(spark, sf_dir)
    pick = lambda name, *cols: named.where(F.col("of") == name).select(*cols)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = lines.join(pick("orders", F.col("key").alias("l_orderkey"), F.col("qname").alias("caller_qname"), F.col("file").alias("file_rel_path")), "l_orderkey")
    rows = rows.join(pick("part", F.col("key").alias("l_partkey"), F.col("qname").alias("part"), F.col("name").alias("part_name")), "l_partkey")
    m = F.col("l_linenumber") % 5
    raw = F.when(m == 0, F.col("part")).when(m == 1, F.concat(F.lit("obj."), F.col("part_name"))).when(m == 2, F.concat(F.lit(" "), F.col("part_name"))).when(m == 3, F.concat(F.lit("self.S"), F.col("l_suppkey"))).otherwise(F.concat(F.lit("cat."), F.col("part_name")))
    return rows.select("caller_qname", raw.alias("raw_callee"), F.col("l_linenumber").alias("line"), "file_rel_path")


def star_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import bindings: files of even years bind each part name of brand 1 to cat.Brand#1, all bind cat to a name nothing has."""
    files = symbols(spark, sf_dir).where("of = 'orders'").select(F.col("file").alias("file_rel_path")).distinct()
    names = table(spark, sf_dir, "part").where("p_brand = 'Brand#1'").select(F.col("p_name").alias("local_name")).distinct()
    even = files.where(F.substring("file_rel_path", 7, 4).cast("int") % 2 == 0)
    bound = even.crossJoin(F.broadcast(names)).withColumn("module", F.lit("cat.Brand#1"))
    return bound.unionByName(files.withColumns({"local_name": F.lit("cat"), "module": F.lit("cat/none.ts")}))


def bound_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(call sites, imports): an order calls its parts through their bound file, through a bound part, or calls itself by its bare name, in turn by line number."""
    named = symbols(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") % 3).alias("m"))
    rows = lines.join(named.where("of = 'orders'").select(F.col("key").alias("l_orderkey"), F.col("qname").alias("caller_qname"), F.col("file").alias("file_rel_path")), "l_orderkey")
    rows = rows.join(named.where("of = 'part'").select(F.col("key").alias("l_partkey"), F.col("file").alias("part_file"), F.col("name").alias("part_name")), "l_partkey")
    m, part = F.col("m"), F.concat(F.lit("P"), F.col("l_partkey"))
    file_name, part_name = F.concat(F.lit("m"), F.col("l_partkey")), F.concat(F.lit("k"), F.col("l_partkey"))
    raw = F.when(m == 0, F.concat_ws(".", file_name, part, "part_name")).when(m == 1, F.concat_ws(".", part_name, "part_name")).otherwise(F.concat(F.lit("O"), F.col("l_orderkey")))
    imports = rows.where("m < 2").select("file_rel_path", F.when(m == 0, file_name).otherwise(part_name).alias("local_name"), F.when(m == 0, F.col("part_file")).otherwise(F.concat_ws("::", "part_file", part)).alias("module")).distinct()
    return rows.select("caller_qname", raw.alias("raw_callee"), F.lit(1).alias("line"), "file_rel_path").distinct(), imports


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, length): a file per document; its suffix follows the language, its folder the source."""
    suffix = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".h").when(F.col("lang") == "fr", ".TS").otherwise(".txt")
    folder = F.when(F.col("source") == "src3", F.lit("node_modules")).otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(folder, F.lit("/d"), F.col("doc_id"), suffix).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): a name-status line per document, of each kind in turn."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/d"), F.col("doc_id"), F.when(F.col("lang") == "es", ".md").otherwise(".py"))
    new = F.concat(F.lit("new/d"), F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".go"))
    k = F.col("doc_id") % 7
    tab = F.lit("\t")
    line = F.when(k == 0, F.concat(F.lit("A"), tab, path)).when(k == 1, F.concat(F.lit("M"), tab, path)).when(k == 2, F.concat(F.lit("D"), tab, path)).when(k == 3, F.concat(F.lit("R100"), tab, path, tab, new)).when(k == 4, F.concat(F.lit("C75"), tab, path, tab, new)).when(k == 5, F.lit("")).otherwise(F.concat(F.lit("R050"), tab, path))
    return docs.select(line.alias("line"))
