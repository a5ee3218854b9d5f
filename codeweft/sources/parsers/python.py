"""Python, by its own grammar; a file that doesn't parse is read again without its broken lines."""

from __future__ import annotations

import ast
import warnings

from codeweft.sources.parsers.common import Parsed

#: Broken lines that are blanked before giving a file up.
REPAIRS = 50
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def tree_of(text: str, out: Parsed) -> ast.Module | None:
    lines = text.replace("\0", " ").split("\n")
    for _ in range(REPAIRS):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse("\n".join(lines))
        except (SyntaxError, ValueError) as e:
            out.error = out.error or f"line {getattr(e, 'lineno', 0)}: {e.args[0]}"
            k = min(max((getattr(e, "lineno", 1) or 1) - 1, 0), len(lines) - 1)
            while k > 0 and not lines[k].strip():
                k -= 1
            if not lines[k].strip():
                return None
            indent = len(lines[k]) - len(lines[k].lstrip())
            lines[k] = " " * indent + "pass" if lines[k].strip() != "pass" else ""
    return None


def parse(text: str, out: Parsed) -> None:
    tree = tree_of(text, out)
    if tree is not None:
        visit(tree.body, [], out.rel_path, out)


def visit(body: list[ast.AST], scope: list[str], parent: str, out: Parsed) -> None:
    """Definitions and imports below these nodes, in order."""
    for node in body:
        if isinstance(node, DEFS):
            inner = [*scope, node.name]
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            is_class = isinstance(node, ast.ClassDef)
            q = out.define("Class" if is_class else "Function", inner, first, node.end_lineno or node.lineno, parent)
            if is_class:
                for b in node.bases:
                    if isinstance(b, ast.Name | ast.Attribute):
                        out.edges.append(("INHERITS", q, ast.unparse(b)))
            else:
                for statement in node.body:
                    calls(statement, q, out)
            visit(node.body, inner, q, out)
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.imported(a.name)
                if a.asname:
                    out.imports[a.asname] = a.name
                else:
                    out.imports[a.name.split(".")[0]] = a.name
                    out.imports[a.name] = a.name
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            out.imported(module)
            for a in node.names:
                if a.name == "*":
                    out.imports[f"{module}.*"] = module
                else:
                    out.imports[a.asname or a.name] = f"{module}.{a.name}" if module else a.name
        else:
            visit(list(ast.iter_child_nodes(node)), scope, parent, out)


def calls(node: ast.AST, caller: str, out: Parsed) -> None:
    """Calls below a node, but for those inside nested definitions."""
    if isinstance(node, DEFS):
        return
    if isinstance(node, ast.Call):
        f = node.func
        if isinstance(f, ast.Name | ast.Attribute):
            out.calls.append((caller, ast.unparse(f), node.lineno))
    for child in ast.iter_child_nodes(node):
        calls(child, caller, out)
