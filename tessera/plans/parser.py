"""Factor text and JSON to trees and back, with arity and type checks."""

from __future__ import annotations

import ast
import json

from ..errors import ParseError
from ..model import FactorNode, canonical_json
from ..operators import get_operator_arg_types, has_operator

_BINARY_SIGNS = (ast.UAdd, ast.USub)


def parse_string(source: str) -> FactorNode:
    """Reads ``op(arg, ...)``; only calls by name, strings and numbers are allowed."""
    try:
        tree = ast.parse(source.strip(), mode="eval")
    except (SyntaxError, ValueError) as e:
        raise ParseError(f"not a factor expression: {e}") from None
    node = _read(tree.body)
    if not isinstance(node, FactorNode):
        raise ParseError("a factor must be an operator call")
    return node


def _read(e: ast.expr):
    match e:
        case ast.Constant(value=bool() | int() | float() | str() as v):
            return v
        case ast.UnaryOp(op=sign, operand=ast.Constant(value=v)) if isinstance(sign, _BINARY_SIGNS) and isinstance(v, int | float) and not isinstance(v, bool):
            return -v if isinstance(sign, ast.USub) else v
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
            return checked(FactorNode(name, tuple(_read(a) for a in args)))
        case ast.Call(keywords=[_, *_]):
            raise ParseError("arguments must be positional")
    raise ParseError(f"{type(e).__name__} is not allowed in a factor")


def checked(node: FactorNode) -> FactorNode:
    """The node, if its operator exists and its arguments fit."""
    if not has_operator(node.operator):
        raise ParseError(f"unknown operator {node.operator}")
    types = get_operator_arg_types(node.operator)
    if len(types) != len(node.args):
        raise ParseError(f"{node.operator} takes {len(types)} arguments, got {len(node.args)}")
    for i, (tag, a) in enumerate(zip(types, node.args, strict=True)):
        flag, number = isinstance(a, bool), isinstance(a, int | float) and not isinstance(a, bool)
        series = isinstance(a, FactorNode | str)
        fits = {"series": series, "int": isinstance(a, int) and not flag, "float": number, "bool": flag, "series_or_scalar": series or number}[tag]
        if not fits:
            raise ParseError(f"argument {i + 1} of {node.operator} must be {tag}, got {a!r}")
    return node


def parse_json(source: str) -> FactorNode:
    try:
        data = json.loads(source)
    except json.JSONDecodeError as e:
        raise ParseError(f"not JSON: {e}") from None
    node = node_of(data)
    if not isinstance(node, FactorNode):
        raise ParseError("a factor must be an operator object")
    return node


def node_of(data, check: bool = True):
    """A tree from its canonical form; ``check`` its operators, or read them as they stand."""
    if isinstance(data, dict):
        if set(data) != {"op", "args", "kwargs"} or not isinstance(data["op"], str) or not isinstance(data["args"], list) or not isinstance(data["kwargs"], dict):
            raise ParseError("a node has exactly op, args and kwargs")
        node = FactorNode(data["op"], tuple(node_of(a, check) for a in data["args"]), {k: node_of(v, check) for k, v in data["kwargs"].items()})
        return checked(node) if check else node
    if isinstance(data, str | bool | int | float):
        return data
    raise ParseError(f"not a factor argument: {data!r}")


def serialise_to_json(node: FactorNode) -> str:
    return canonical_json(node)


def serialise_to_string(node: FactorNode) -> str:
    """Text that parses back to the same tree."""
    shown = lambda a: serialise_to_string(a) if isinstance(a, FactorNode) else json.dumps(a) if isinstance(a, str) else repr(a)
    return f"{node.operator}({', '.join(map(shown, node.args))})"
