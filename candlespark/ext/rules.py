"""Rule trees over indicator columns, compiled to columns (an extension)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespark.ext.indicators import by_symbol


def operand(node) -> Column:
    """A number, a column name, or {"ref": name, "back": n}."""
    if isinstance(node, int | float):
        return F.lit(float(node))
    if isinstance(node, str):
        return F.col(node)
    return F.lag(node["ref"], int(node.get("back", 0))).over(by_symbol()) if node.get("back") else F.col(node["ref"])


def compile_rule(node: dict) -> Column:
    """A Boolean column for a rule: all, any, not, or a comparison of ``left`` and ``right``."""
    if "all" in node:
        return reduce(lambda a, b: a & b, map(compile_rule, node["all"]))
    if "any" in node:
        return reduce(lambda a, b: a | b, map(compile_rule, node["any"]))
    if "not" in node:
        return ~compile_rule(node["not"])
    op, left = node["op"], operand(node["left"])
    if op in ("rising", "falling"):
        before = F.lag(left, int(node.get("bars", 1))).over(by_symbol())
        return F.coalesce(left > before if op == "rising" else left < before, F.lit(False))
    if op == "between":
        return left.between(operand(node["low"]), operand(node["high"]))
    right = operand(node["right"])
    if op in ("crosses_above", "crosses_below"):
        a, b = F.lag(left).over(by_symbol()), F.lag(right).over(by_symbol())
        return F.coalesce((a <= b) & (left > right) if op == "crosses_above" else (a >= b) & (left < right), F.lit(False))
    return {"gt": left > right, "lt": left < right, "gte": left >= right, "lte": left <= right, "eq": left == right}[op]
