"""Item filters written as Python expressions in ``n``, turned into Columns."""

from __future__ import annotations

import ast
import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {
    ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt,
    ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
}


def _floor_div(a, b):
    return F.floor(a / b)


def _floor_mod(a, b):
    return a - b * F.floor(a / b)


ARITHMETIC = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul,
    ast.Div: operator.truediv, ast.FloorDiv: _floor_div, ast.Mod: _floor_mod,
}


def item_filter(expression: str, n: Column) -> Column:
    """Arithmetic, comparisons, and/or/not over ``n`` and integers; anything else is refused."""

    def value(node) -> Column:
        match node:
            case ast.Name(id="n"):
                return n
            case ast.Constant(value=int() | float()) if not isinstance(node.value, bool):
                return F.lit(node.value)
            case ast.UnaryOp(op=ast.USub()):
                return -value(node.operand)
            case ast.BinOp() if type(node.op) in ARITHMETIC:
                return ARITHMETIC[type(node.op)](value(node.left), value(node.right))
        raise ValueError(f"not allowed in an item filter: {ast.unparse(node)}")

    def truth(node) -> Column:
        match node:
            case ast.BoolOp():
                join = operator.and_ if isinstance(node.op, ast.And) else operator.or_
                return reduce(join, map(truth, node.values))
            case ast.UnaryOp(op=ast.Not()):
                return ~truth(node.operand)
            case ast.Compare() if all(type(op) in COMPARE for op in node.ops):
                sides = [value(x) for x in (node.left, *node.comparators)]
                steps = [COMPARE[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:])]
                return reduce(operator.and_, steps)
        return value(node) != 0

    return truth(ast.parse(expression, mode="eval").body)
