"""Small graphs for tests."""

from codeweft import schema
from codeweft.operators.graph import CodeGraph


def graph(spark, nodes, edges):
    """nodes: (kind, name, qualified name, first line, last line); edges: (kind, source, target)."""
    rows = []
    for kind, name, q, a, b in nodes:
        file = "" if kind == "External" else q.split("::")[0]
        rows.append((kind, name, None if kind == "External" else q, q, f"/proj/{file}", file, a, b, "typescript" if file.endswith(".ts") else "python", "h", kind == "External"))
    return CodeGraph(spark.createDataFrame(rows, schema.NODE), spark.createDataFrame(edges, schema.EDGE))


#: A shop in two languages: two ways from total to round_up, and a cycle in the page.
SHOP_NODES = [
    ("File", "cart.py", "orders/cart.py", 1, 50), ("File", "tax.py", "lib/tax.py", 1, 50), ("File", "app.ts", "web/app.ts", 1, 50),
    ("Class", "Cart", "orders/cart.py::Cart", 1, 40), ("Function", "Cart.total", "orders/cart.py::Cart.total", 5, 18), ("Function", "Cart.add", "orders/cart.py::Cart.add", 20, 28),
    ("Function", "rate", "lib/tax.py::rate", 3, 9), ("Function", "round_up", "lib/tax.py::round_up", 11, 14),
    ("Function", "show", "web/app.ts::show", 2, 12), ("Function", "refresh", "web/app.ts::refresh", 14, 20),
]
SHOP_EDGES = [
    ("CONTAINS", "orders/cart.py", "orders/cart.py::Cart"), ("CONTAINS", "orders/cart.py::Cart", "orders/cart.py::Cart.total"), ("CONTAINS", "orders/cart.py::Cart", "orders/cart.py::Cart.add"),
    ("CONTAINS", "lib/tax.py", "lib/tax.py::rate"), ("CONTAINS", "lib/tax.py", "lib/tax.py::round_up"), ("CONTAINS", "web/app.ts", "web/app.ts::show"), ("CONTAINS", "web/app.ts", "web/app.ts::refresh"),
    ("CALLS", "orders/cart.py::Cart.total", "lib/tax.py::rate"), ("CALLS", "orders/cart.py::Cart.total", "lib/tax.py::round_up"), ("CALLS", "lib/tax.py::rate", "lib/tax.py::round_up"),
    ("CALLS", "web/app.ts::show", "orders/cart.py::Cart.total"), ("CALLS", "web/app.ts::show", "web/app.ts::refresh"), ("CALLS", "web/app.ts::refresh", "web/app.ts::show"), ("CALLS", "web/app.ts::refresh", "orders/cart.py::Cart.add"),
]


def shop(spark):
    return graph(spark, SHOP_NODES, SHOP_EDGES)
