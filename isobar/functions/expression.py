"""Calculations given as text: out=expression, over variables with + - * / and a few functions."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from isobar.errors import DefinitionError

CALLS = {"exp": F.exp, "log": F.ln, "abs": F.abs, "power": F.pow}


def parse(text: str, variables: tuple[str, ...]) -> tuple[str, Column]:
    """The output's name and its column. The expression is checked as a tree, so names are never mixed up with functions."""
    name, sep, body = text.partition("=")
    if not sep or not name.strip().isidentifier():
        raise DefinitionError(f"expression needs the form out=...: {text}")
    try:
        tree = ast.parse(body.strip(), mode="eval").body
    except SyntaxError as e:
        raise DefinitionError(f"expression: {text}") from e
    return name.strip(), built(tree, variables)


def built(node: ast.expr, variables: tuple[str, ...]) -> Column:
    go = lambda x: built(x, variables)
    match node:
        case ast.Constant(value=int() | float()):
            return F.lit(float(node.value))
        case ast.Name() if node.id in variables:
            return F.col(node.id)
        case ast.UnaryOp(op=ast.USub()):
            return -go(node.operand)
        case ast.UnaryOp(op=ast.UAdd()):
            return go(node.operand)
        case ast.BinOp(op=ast.Add()):
            return go(node.left) + go(node.right)
        case ast.BinOp(op=ast.Sub()):
            return go(node.left) - go(node.right)
        case ast.BinOp(op=ast.Mult()):
            return go(node.left) * go(node.right)
        case ast.BinOp(op=ast.Div()):
            return go(node.left) / F.nullif(go(node.right), F.lit(0.0))
        case ast.BinOp(op=ast.Pow()):
            return F.pow(go(node.left), go(node.right))
        case ast.Call(func=ast.Name(id=called)) if called in CALLS and not node.keywords:
            return CALLS[called](*map(go, node.args))
    raise DefinitionError(f"expression: {ast.unparse(node)}")
