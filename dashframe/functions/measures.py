"""Measure expressions: ``[Column]`` references, + - * /, unary minus,
parentheses and numbers.  Parsed through a whitelist walk of Python's ``ast``
into a Spark ``Column``; nothing is evaluated.  Division by zero and integer
overflow yield NULL.  An expression without a column is no measure.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from dashframe.functions.columns import col

# Fixed value: how an expression names a column.
_REF = re.compile(r"\[([^\]]+)\]")


class MeasureError(ValueError):
    pass


def referenced_columns(expression: str) -> list[str]:
    return _REF.findall(expression or "")


def parse_measure(expression: str) -> Column:
    """Turn ``[a] * (1 - [b])`` into a Column; raise MeasureError if not allowed."""
    if not expression or not expression.strip():
        raise MeasureError("empty expression")
    names: list[str] = []

    def _slot(m: re.Match) -> str:
        names.append(m.group(1))
        return f"__ref{len(names) - 1}__"

    source = _REF.sub(_slot, expression.strip())
    if not names:
        raise MeasureError("no column in the expression")
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as exc:
        raise MeasureError(f"syntax: {exc.msg}") from exc

    def walk(node) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.BinOp):
            left, right = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Add):
                return F.try_add(left, right)
            if isinstance(node.op, ast.Sub):
                return F.try_subtract(left, right)
            if isinstance(node.op, ast.Mult):
                return F.try_multiply(left, right)
            if isinstance(node.op, ast.Div):
                return F.try_divide(left, right)
            raise MeasureError(f"operator not allowed: {type(node.op).__name__}")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            inner = walk(node.operand)
            return -inner if isinstance(node.op, ast.USub) else inner
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) \
                and not isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and re.fullmatch(r"__ref\d+__", node.id):
            return col(names[int(node.id[5:-2])])
        raise MeasureError(f"element not allowed: {type(node).__name__}")

    return walk(tree)


OPERATORS = "+-*/"


def compose_expression(parts: list[dict]) -> str:
    """M3: a flat expression from picked columns, ``{"op": "+", "col": "name"}``
    each; what comes first needs no operator, and a part that names no column
    has no say."""
    picked = [(p.get("op") or "+", p["col"]) for p in parts if p.get("col")]
    wrong = [op for op, _ in picked[1:] if len(op) != 1 or op not in OPERATORS]
    if wrong:
        raise MeasureError(f"operator not allowed: {wrong[0]!r}")
    text = "".join(f" {op} [{name}]" for op, name in picked)
    return text[3:]
