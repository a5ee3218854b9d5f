"""Lowers parsed Cypher to DataFrame joins, filters and sums.

A node variable v becomes the columns v.<property> of the node table, an edge
variable those of the edge table; a shared variable is an equality join on
node_id. A path of variable length is expanded level by level, from the end that
is already bound: every walk that repeats no edge is a row. Where the result can't
tell how many walks join two nodes (EXISTS, DISTINCT, sums that ignore repeats),
distinct (start, end) pairs are expanded instead, until nothing new is reached.
"""

from __future__ import annotations

import itertools
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from codeweft.operators.graph import CodeGraph
from codeweft.plans.cypher.parser import Edge, Match, Node, Pattern, Project, Query, QueryError, Unwind, parse
from codeweft.staging import staged

NODE_COLUMNS = ["kind", "name", "qualified_name", "node_id", "file_path", "file_rel_path", "line_start", "line_end", "language", "file_hash", "external"]
EDGE_COLUMNS = ["kind", "source", "target"]
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}


class Scope:
    """Rows so far, and what its variables are: node, edge, path or value."""

    def __init__(self, df: DataFrame | None, kinds: dict[str, str]) -> None:
        self.df, self.kinds = df, kinds


class Planner:
    def __init__(self, graph: CodeGraph, params: dict[str, Any]) -> None:
        self.graph, self.params, self.fresh = graph, params, itertools.count()
        #: Whether the clause at hand may join two nodes once, however many walks do.
        self.once = False
        #: Edge variables of the MATCH at hand: none may stand for the same edge as another.
        self.matched: list[str] = []

    # -- clauses

    def query(self, q: Query) -> DataFrame:
        frames = [self.branch(b) for b in q.branches]
        out = frames[0]
        for frame, everything in zip(frames[1:], q.everything, strict=True):
            if out.columns != frame.columns:
                raise QueryError("the branches of a UNION return different columns")
            out = out.union(frame)
            if not everything:
                out = out.distinct()
        return out

    def branch(self, clauses: list[Any]) -> DataFrame:
        scope = Scope(None, {})
        for at, c in enumerate(clauses):
            if isinstance(c, Match):
                after = next((x for x in clauses[at:] if isinstance(x, Project)), None)
                self.once = after is not None and blind_to_repeats(after)
                scope = self.match(scope, c)
            elif isinstance(c, Unwind):
                df = scope.df if scope.df is not None else self.graph.nodes.sparkSession.range(1).select()
                values = self.expr(scope, c.expr)
                scope = Scope(df.select(*[F.col(f"`{x}`") for x in df.columns], F.explode(values).alias(c.var)), scope.kinds | {c.var: "value"})
            else:
                scope = self.project(scope, c)
        return scope.df

    def match(self, scope: Scope, m: Match) -> Scope:
        self.matched = []
        if m.optional and scope.df is not None:
            # matched against the distinct bound variables, then joined to the rows, kept also without a match
            row = f"_row{next(self.fresh)}"
            base = staged(scope.df.withColumn(row, F.monotonically_increasing_id()), "optional")
            found = Scope(base, dict(scope.kinds))
            for p in m.patterns:
                found = self.add(found, p)
            if m.where is not None:
                found = self.where(found, m.where)
            new = [c for c in found.df.columns if c not in base.columns]
            right = found.df.select(F.col(f"`{row}`"), *[F.col(f"`{c}`") for c in new])
            return Scope(base.join(right, row, "left").drop(row), found.kinds)
        for p in m.patterns:
            scope = self.add(scope, p)
        return self.where(scope, m.where) if m.where is not None else scope

    def where(self, scope: Scope, e: Any) -> Scope:
        """Conjuncts one by one: patterns as semi or anti joins, the rest as filters."""
        if e[0] == "and":
            return self.where(self.where(scope, e[1]), e[2])
        inner, how = (e[1], "left_anti") if e[0] == "not" else (e, "left_semi")
        if inner[0] in ("pattern", "pattern where"):
            return Scope(self.exists(scope, inner, how), scope.kinds)
        flags: list[str] = []

        def replaced(x: Any) -> Any:
            """x with each pattern in it turned into a column that says whether it was found."""
            nonlocal scope
            if isinstance(x, tuple) and x and x[0] in ("pattern", "pattern where"):
                found, ids = self.matches(scope, x)
                flags.append(f"_flag{next(self.fresh)}")
                scope = Scope(scope.df.join(found.withColumn(flags[-1], F.lit(True)), ids, "left"), scope.kinds)
                return ("flag", flags[-1])
            return type(x)(replaced(y) for y in x) if isinstance(x, tuple | list) else x

        e = replaced(e)
        return Scope(scope.df.where(self.expr(scope, e)).drop(*flags), scope.kinds)

    def matches(self, scope: Scope, e: Any) -> tuple[DataFrame, list[str]]:
        """The distinct ids of the pattern's bound variables for which it is found, and their columns."""
        pattern = e[1]
        bound = [n.var for n in pattern.nodes if n.var in scope.kinds]
        if not bound:
            raise QueryError("a pattern in WHERE needs a variable of MATCH")
        ids = [f"{v}.node_id" for v in dict.fromkeys(bound)]
        keys = scope.df.select(*[F.col(f"`{c}`") for c in ids]).distinct()
        nodes = Scope(None, {})
        for v in dict.fromkeys(bound):
            nodes = self.add_node(nodes, Node(v, [], {}))
        outer, self.matched, self.once, before = self.matched, [], True, self.once
        have = nodes.df.join(keys, ids, "left_semi") if len(ids) == 1 else nodes.df.join(keys, ids)
        found = self.add(Scope(have, nodes.kinds), pattern)
        if e[0] == "pattern where":
            found = self.where(found, e[2])
        self.matched, self.once = outer, before
        return found.df.select(*[F.col(f"`{c}`") for c in ids]).distinct(), ids

    def exists(self, scope: Scope, e: Any, how: str) -> DataFrame:
        found, ids = self.matches(scope, e)
        return scope.df.join(found, ids, how)

    # -- patterns

    def column(self, var: str, prop: str) -> Column:
        return F.col(f"`{var}.{prop}`")

    def node_rows(self, n: Node, var: str) -> DataFrame:
        rows = self.graph.nodes
        for label in n.labels:
            rows = rows.where(F.col("kind") == label)
        for key, value in n.props.items():
            if key not in NODE_COLUMNS:
                raise QueryError(f"nodes have no property {key}")
            rows = rows.where(F.col(key) == self.expr(Scope(None, {}), value))
        return rows.select(*[F.col(c).alias(f"{var}.{c}") for c in NODE_COLUMNS])

    def add_node(self, scope: Scope, n: Node) -> Scope:
        var = n.var or f"_n{next(self.fresh)}"
        n.var = var
        if var in scope.kinds:
            if scope.kinds[var] != "node":
                raise QueryError(f"{var} is not a node")
            df = scope.df
            for label in n.labels:
                df = df.where(self.column(var, "kind") == label)
            for key, value in n.props.items():
                df = df.where(self.column(var, key) == self.expr(scope, value))
            return Scope(df, scope.kinds)
        rows = self.node_rows(n, var)
        df = rows if scope.df is None else scope.df.crossJoin(rows)
        return Scope(df, scope.kinds | {var: "node"})

    def add(self, scope: Scope, p: Pattern) -> Scope:
        """The rows joined with a path; the expansion starts at a bound node, else at the most restricted one."""
        for n in p.nodes:
            n.var = n.var or f"_n{next(self.fresh)}"
        bound = [i for i, n in enumerate(p.nodes) if n.var in scope.kinds]
        start = bound[0] if bound else max(range(len(p.nodes)), key=lambda i: (len(p.nodes[i].props), len(p.nodes[i].labels), -i))
        scope = self.add_node(scope, p.nodes[start])
        used: list[str] = []
        for i in range(start, len(p.edges)):
            scope = self.step(scope, p.nodes[i], p.edges[i], p.nodes[i + 1], True, used, bool(p.var))
        for i in range(start - 1, -1, -1):
            scope = self.step(scope, p.nodes[i + 1], p.edges[i], p.nodes[i], False, used, bool(p.var))
        if p.var:
            lengths = [F.col(f"`{u}`") for u in used]
            total = reduce(lambda a, b: a + b, lengths, F.lit(0))
            scope = Scope(scope.df.withColumn(p.var, total), scope.kinds | {p.var: "path"})
        return scope

    def step(self, scope: Scope, a: Node, e: Edge, b: Node, forward: bool, used: list[str], named: bool) -> Scope:
        """One edge or walk from the bound node a to b, in the order of expansion; named: the path has a variable, so its length counts."""
        direction = e.direction if forward else {"out": "in", "in": "out", "both": "both"}[e.direction]
        edges = self.graph.edges.select(*EDGE_COLUMNS)
        if e.kinds:
            edges = edges.where(F.col("kind").isin(e.kinds))
        for key, value in e.props.items():
            edges = edges.where(F.col(key) == self.expr(Scope(None, {}), value))
        ends = {"out": ("source", "target"), "in": ("target", "source")}
        def oriented(d: str) -> DataFrame:
            return edges.select(F.col(ends[d][0]).alias("_from"), F.col(ends[d][1]).alias("_to"), *EDGE_COLUMNS)

        # a self loop is one edge, also where the direction is open
        rows = oriented(direction) if direction != "both" else oriented("out").unionByName(oriented("in").where("source <> target"))
        length = f"_len{next(self.fresh)}"
        kinds, keep = dict(scope.kinds), []
        if e.walk:
            if e.var:
                raise QueryError("the edges of a walk can't be named")
            starts = scope.df.select(self.column(a.var, "node_id").alias("_start")).distinct()
            rows = self.walks(rows, starts, e.least, e.most, self.once and e.least <= 1 and not named).withColumnsRenamed({"_start": "_from", "_end": "_to", "_steps": length})
        else:
            rows = rows.withColumn(length, F.lit(1))
            var = e.var or f"_e{next(self.fresh)}"
            rows = rows.withColumnsRenamed({c: f"{var}.{c}" for c in EDGE_COLUMNS})
            if e.var:
                if e.var in kinds:
                    raise QueryError(f"{e.var} is bound twice")
                kinds[e.var] = "edge"
            keep = [f"{var}.{c}" for c in EDGE_COLUMNS]
        used.append(length)
        rows = rows.select("_from", "_to", length, *[F.col(f"`{c}`") for c in keep])
        df = scope.df.join(rows, self.column(a.var, "node_id") == F.col("_from")).drop("_from")
        if not e.walk:
            for other in self.matched:
                df = df.where(~reduce(lambda x, y: x & y, [F.col(f"`{var}.{c}`") == F.col(f"`{other}.{c}`") for c in EDGE_COLUMNS]))
            self.matched.append(var)
        if b.var in kinds:
            df = df.where(self.column(b.var, "node_id") == F.col("_to")).drop("_to")
            scope = self.add_node(Scope(df, kinds), b)
        else:
            df = df.join(self.node_rows(b, b.var), F.col("_to") == self.column(b.var, "node_id")).drop("_to")
            scope = Scope(df, kinds | {b.var: "node"})
        return scope

    def walks(self, edges: DataFrame, starts: DataFrame, least: int, most: int | None, once: bool) -> DataFrame:
        """(_start, _end, _steps): a row for each walk of least to most edges (most None: no bound) that repeats no edge; once: a row for each pair of ends, with its fewest steps.

        Fewest steps never repeat an edge, so once needs no memory of edges; it is for least 0 or 1.
        """
        steps = staged(edges.select("_from", "_to", "kind", "source", "target").distinct(), "steps")
        if once:
            steps = steps.select("_from", "_to").distinct()
            level = staged(starts.select("_start", F.col("_start").alias("_end"), F.lit(0).alias("_steps")), "walks")
            none, found = level.limit(0), [level] if least == 0 else []
            seen = level.select("_start", "_end") if least == 0 else none.select("_start", "_end")
            for k in itertools.count(1) if most is None else range(1, most + 1):
                new = level.join(steps, F.col("_end") == F.col("_from")).select("_start", F.col("_to").alias("_end")).distinct()
                level = staged(new.join(seen, ["_start", "_end"], "left_anti").withColumn("_steps", F.lit(k)), "walks")
                if level.isEmpty():
                    break
                found.append(level)
                seen = seen.unionByName(level.select("_start", "_end"))
                if k % 16 == 0:
                    seen = staged(seen, "seen")
            return reduce(DataFrame.unionByName, found, none)
        edge = F.xxhash64("kind", "source", "target")
        level = starts.select("_start", F.col("_start").alias("_end"), F.array().cast("array<bigint>").alias("_edges"))
        out = [level] if least == 0 else []
        for k in itertools.count(1) if most is None else range(1, most + 1):
            level = level.join(steps, F.col("_end") == F.col("_from")).where(~F.array_contains("_edges", edge)).select("_start", F.col("_to").alias("_end"), F.array_append("_edges", edge).alias("_edges"))
            level = staged(level, "walks")
            if level.isEmpty():
                break
            if k >= least:
                out.append(level)
        return reduce(DataFrame.unionByName, out, level.limit(0)).select("_start", "_end", F.size("_edges").alias("_steps"))

    # -- projections

    def project(self, scope: Scope, p: Project) -> Scope:
        items = list(p.items)
        if p.everything:
            items = [(("var", v), v) for v in scope.kinds if not v.startswith("_")] + items
        if scope.df is None:
            scope = Scope(self.graph.nodes.sparkSession.range(1).select(F.lit(1).alias("_one")), {})
        kinds: dict[str, str] = {}
        grouped = any(has_aggregate(e) for e, _ in items)
        whole: list[tuple[str, str]] = []
        cols: list[tuple[str, Column, Any]] = []
        for e, name in items:
            if e[0] == "var" and scope.kinds.get(e[1]) in ("node", "edge") and not p.last:
                whole.append((e[1], name))
                kinds[name] = scope.kinds[e[1]]
            else:
                kinds[name] = "path" if e[0] == "var" and scope.kinds.get(e[1]) == "path" else "value"
                cols.append((name, self.expr(scope, e), e))
        carried = [F.col(f"`{v}.{c}`").alias(f"{name}.{c}") for v, name in whole for c in (NODE_COLUMNS if scope.kinds[v] == "node" else EDGE_COLUMNS)]
        carried_names = [f"{name}.{c}" for v, name in whole for c in (NODE_COLUMNS if scope.kinds[v] == "node" else EDGE_COLUMNS)]
        names = carried_names + [n for n, _, _ in cols]
        if grouped:
            keys = carried + [c.alias(n) for n, c, e in cols if not has_aggregate(e)]
            sums = [c.alias(n) for n, c, e in cols if has_aggregate(e)]
            df = scope.df.groupBy(*keys).agg(*sums) if keys else scope.df.agg(*sums)
            df = df.select(*[F.col(f"`{n}`") for n in names])
            after = Scope(df, kinds)
            order = [(self.order_key(after, scope, e, items), down) for e, down in p.order]
        else:
            after_names = {n: c for n, c, _ in cols}
            order, extra = [], []
            for k, (e, down) in enumerate(p.order):
                match = next((n for x, n in items if x == e or (e[0] == "var" and e[1] == n)), None)
                if match is not None and match in after_names:
                    order.append((F.col(f"`{match}`"), down))
                else:
                    extra.append(self.expr(scope, e).alias(f"_o{k}"))
                    order.append((F.col(f"_o{k}"), down))
            df = scope.df.select(*carried, *[c.alias(n) for n, c, _ in cols], *([] if p.distinct else extra))
        if p.distinct:
            df = df.distinct()
        if order:
            df = df.orderBy(*[c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in order])
        if p.skip is not None:
            df = df.offset(self.number(p.skip))
        if p.limit is not None:
            df = df.limit(self.number(p.limit))
        df = df.select(*[F.col(f"`{n}`") for n in names])
        out = Scope(df, kinds)
        return self.where(out, p.where) if p.where is not None else out

    def order_key(self, after: Scope, before: Scope, e: Any, items: list[tuple[Any, str]]) -> Column:
        for x, n in items:
            if x == e or (e[0] == "var" and e[1] == n):
                return F.col(f"`{n}`")
        raise QueryError("ORDER BY after a sum may only name what is returned")

    def number(self, e: Any) -> int:
        value = self.params.get(e[1]) if e[0] == "param" else e[1] if e[0] == "lit" else None
        if not isinstance(value, int) or value < 0:
            raise QueryError("SKIP and LIMIT take a whole number")
        return value

    # -- expressions

    def expr(self, scope: Scope, e: Any) -> Column:
        op = e[0]
        if op == "lit":
            return F.lit(e[1])
        if op == "param":
            if e[1] not in self.params:
                raise QueryError(f"parameter ${e[1]} is not given")
            v = self.params[e[1]]
            return F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else F.lit(v)
        if op == "list":
            return F.array(*[self.expr(scope, x) for x in e[1]])
        if op == "var":
            kind = scope.kinds.get(e[1])
            if kind is None:
                raise QueryError(f"{e[1]} is not defined")
            if kind in ("node", "edge"):
                names = NODE_COLUMNS if kind == "node" else EDGE_COLUMNS
                key = self.column(e[1], "node_id" if kind == "node" else "source")
                return F.when(key.isNotNull(), F.struct(*[self.column(e[1], c).alias(c) for c in names]))
            return F.col(f"`{e[1]}`")
        if op == "prop":
            if e[1][0] == "var" and scope.kinds.get(e[1][1]) in ("node", "edge"):
                names = NODE_COLUMNS if scope.kinds[e[1][1]] == "node" else [*EDGE_COLUMNS]
                return self.column(e[1][1], e[2]) if e[2] in names else F.lit(None).cast("string")
            return self.expr(scope, e[1])[e[2]]
        if op == "at":
            return F.get(self.expr(scope, e[1]), self.expr(scope, e[2]))
        if op in ("and", "or"):
            a, b = self.expr(scope, e[1]), self.expr(scope, e[2])
            return a & b if op == "and" else a | b
        if op == "xor":
            return self.expr(scope, e[1]) != self.expr(scope, e[2])
        if op == "not":
            return ~self.expr(scope, e[1])
        if op == "neg":
            return -self.expr(scope, e[1])
        if op == "is null":
            inner = e[1]
            if inner[0] == "var" and scope.kinds.get(inner[1]) == "node":
                return self.column(inner[1], "node_id").isNull()
            return self.expr(scope, inner).isNull()
        if op == "case":
            out = self.expr(scope, e[2])
            for test, value in reversed(e[1]):
                out = F.when(self.expr(scope, test), self.expr(scope, value)).otherwise(out)
            return out
        if op == "flag":
            return F.coalesce(F.col(e[1]), F.lit(False))
        if op == "call":
            return self.call(scope, e)
        if op in ("=", "<>") and all(x[0] == "var" and scope.kinds.get(x[1]) == "node" for x in e[1:]):
            a, b = (self.column(x[1], "node_id") for x in e[1:])
            return a == b if op == "=" else a != b
        if len(e) == 3:
            a, b = self.expr(scope, e[1]), self.expr(scope, e[2])
            two = {
                "=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b,
                "+": lambda: F.concat(a, b) if any(x[0] == "lit" and isinstance(x[1], str) for x in walk(e)) else a + b,
                "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.call_function("div", a, b) if self.whole(scope, a) and self.whole(scope, b) else a / b, "%": lambda: a % b, "^": lambda: F.pow(a, b),
                "starts with": lambda: F.startswith(a, b), "ends with": lambda: F.endswith(a, b), "contains": lambda: F.contains(a, b),
                "in": lambda: F.array_contains(b, a), "=~": lambda: F.regexp_like(a, F.concat(F.lit("^(?:"), b, F.lit(")$"))),
            }
            if op in two:
                return two[op]()
        raise QueryError(f"{op} can't stand here")

    def whole(self, scope: Scope, value: Column) -> bool:
        """Whether an expression over the rows so far is a whole number."""
        rows = scope.df if scope.df is not None else self.graph.nodes.sparkSession.range(1)
        try:
            return isinstance(rows.select(value).schema[0].dataType, IntegralType)
        except AnalysisException:
            return False

    def call(self, scope: Scope, e: Any) -> Column:
        _, name, args, distinct = e
        if name in AGGREGATES:
            if name == "count" and args and args[0][0] == "star":
                return F.count(F.lit(1))
            (arg,) = args
            value = self.column(arg[1], "node_id") if name == "count" and arg[0] == "var" and scope.kinds.get(arg[1]) == "node" else self.expr(scope, arg)
            if name == "collect":
                return F.array_sort(F.collect_set(value) if distinct else F.collect_list(value))
            if distinct and name == "avg":
                return F.sum_distinct(value) / F.nullif(F.count_distinct(value), F.lit(0))
            if distinct:
                return {"count": F.count_distinct, "sum": F.sum_distinct, "min": F.min, "max": F.max}[name](value)
            return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](value)
        if name in ("type", "labels", "id", "properties", "startnode", "endnode") and args and args[0][0] == "var":
            var = args[0][1]
            kind = scope.kinds.get(var)
            if name == "type" and kind == "edge":
                return self.column(var, "kind")
            if name == "labels" and kind == "node":
                return F.array(self.column(var, "kind"))
            if name == "id" and kind == "node":
                return self.column(var, "node_id")
            if name == "properties":
                return self.expr(scope, args[0])
        values = [self.expr(scope, a) for a in args]
        simple = {
            "length": lambda x: x if args[0][0] == "var" and scope.kinds.get(args[0][1]) == "path" else F.char_length(x),
            "size": lambda x: F.size(x) if args[0][0] in ("list", "param") or (args[0][0] == "call" and args[0][1] in ("collect", "split", "labels")) else F.char_length(x),
            "tolower": F.lower, "toupper": F.upper, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
            "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "round": F.round, "sqrt": F.sqrt, "sign": F.signum, "log": F.log, "exp": F.exp,
            "tostring": lambda x: x.cast("string"), "tointeger": lambda x: x.try_cast("bigint"), "tofloat": lambda x: x.try_cast("double"), "toboolean": lambda x: x.try_cast("boolean"),
            "coalesce": F.coalesce, "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)),
            "split": lambda x, y: F.split(x, F.concat(F.lit("\\Q"), y, F.lit("\\E"))), "replace": F.replace,
            "substring": lambda x, a, n=None: F.substr(x, a + 1) if n is None else F.substr(x, a + 1, n), "left": F.left, "right": F.right,
            "range": lambda a, b, *s: F.sequence(a, b, *s),
        }
        if name not in simple:
            raise QueryError(f"unknown function {name}")
        return simple[name](*values)


def walk(e: Any):
    """All tuples of an expression."""
    if isinstance(e, tuple):
        yield e
        for x in e[1:]:
            yield from walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from walk(x)


def has_aggregate(e: Any) -> bool:
    return any(x and x[0] == "call" and x[1] in AGGREGATES for x in walk(e))


def blind_to_repeats(p: Project) -> bool:
    """Whether a projection gives the same rows however often its input repeats one."""
    sums = [x for e, _ in p.items for x in walk(e) if x and x[0] == "call" and x[1] in AGGREGATES]
    return all(x[1] in ("min", "max") or x[3] for x in sums) if sums else p.distinct


def run(graph: CodeGraph, text: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The rows of a query as a DataFrame whose columns are named as RETURN says ('n.name' without AS)."""
    return Planner(graph, params or {}).query(parse(text))
