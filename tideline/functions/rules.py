"""The computed-rule language: Python expression syntax over a window's rows.

A rule is parsed once into Spark columns. Its root is one window summary, which may
be scaled or shifted by numbers, or guarded by `summary if guard else None`.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARIES = {"first", "last", "sum", "mean", "std", "count_true", "count_non_null"}
GUARD_ONLY = {"any", "all", "min", "max"}
ROW_FUNCTIONS = {"contains", "contains_any", "abs", "coalesce", "lower"}


class RuleError(ValueError):
    pass


def _is_number(node: ast.expr) -> bool:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        node = node.operand
    return isinstance(node, ast.Constant) and type(node.value) in (int, float)


def _calls(node: ast.AST) -> list[str]:
    return [n.func.id for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)]


def _reductions(node: ast.AST) -> list[str]:
    return [c for c in _calls(node) if c in SUMMARIES | GUARD_ONLY]


def check_root(node: ast.expr) -> str:
    """The rule's one summary; raises if the root isn't a legal shape of it."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return check_root(node.operand)
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
        if _is_number(node.right):
            return check_root(node.left)
        if _is_number(node.left) and not isinstance(node.op, ast.Div):
            return check_root(node.right)
        raise RuleError("a summary can only be combined with a number, which it may not divide")
    if isinstance(node, ast.IfExp) and isinstance(node.orelse, ast.Constant) and node.orelse.value is None:
        check_guard(node.test)
        return check_root(node.body)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in SUMMARIES:
        for argument in node.args:
            if _reductions(argument):
                raise RuleError("summaries can't be nested")
        return node.func.id
    raise RuleError("a rule must be one window summary")


def check_guard(node: ast.expr) -> None:
    """Raises unless a guard is one value per window: columns occur in its summaries
    only, and these aren't nested."""
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in SUMMARIES | GUARD_ONLY:
        if any(_reductions(a) for a in node.args):
            raise RuleError("summaries can't be nested")
        return
    if isinstance(node, ast.Name):
        raise RuleError(f"a guard is one value per window, which column {node.id} isn't")
    for child in node.args if isinstance(node, ast.Call) else ast.iter_child_nodes(node):
        check_guard(child)


def columns_of(rule: str) -> list[str]:
    tree = ast.parse(rule, mode="eval")
    functions = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in functions})


class Rule:
    """A parsed rule. order: the column that first and last go by, and the one
    that breaks its ties."""

    def __init__(self, text: str, columns: list[str]):
        self.text, self.known = text, set(columns)
        try:
            self.tree = ast.parse(text.strip(), mode="eval").body
        except SyntaxError as e:
            raise RuleError(str(e)) from None
        self.summary = check_root(self.tree)

    def column(self, order: Column) -> Column:
        return self._fold(self.tree, order)

    def _fold(self, node: ast.expr, order: Column) -> Column:
        fold = lambda n: self._fold(n, order)
        match node:
            case ast.Constant(value=None):
                return F.lit(None)
            case ast.Constant(value=value) if isinstance(value, (bool, int, float, str)):
                return F.lit(value)
            case ast.Name(id=name):
                if name not in self.known:
                    raise RuleError(f"unknown column {name}")
                return F.col(name)
            case ast.UnaryOp(op=ast.Not(), operand=x):
                return ~F.coalesce(fold(x), F.lit(False))
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -fold(x)
            case ast.UnaryOp(op=ast.UAdd(), operand=x):
                return fold(x)
            case ast.BoolOp(op=op, values=values):
                parts = [fold(v) for v in values]
                return reduce(lambda a, b: a & b if isinstance(op, ast.And) else a | b, parts)
            case ast.BinOp(left=a, op=op, right=b):
                return _binary(op, fold(a), fold(b))
            case ast.IfExp(test=c, body=a, orelse=b):
                return F.when(fold(c), fold(a)).otherwise(fold(b))
            case ast.Compare(left=left, ops=ops, comparators=rights):
                out = []
                for op, right in zip(ops, rights):
                    out.append(self._compare(left, op, right, fold))
                    left = right
                return reduce(lambda a, b: a & b, out)
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                return self._call(name, args, fold, order)
        raise RuleError(f"{ast.unparse(node)} isn't part of the rule language")

    def _compare(self, left, op, right, fold) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(right, ast.Constant) and right.value is None):
                raise RuleError("is only compares with None")
            return fold(left).isNull() if isinstance(op, ast.Is) else fold(left).isNotNull()
        if isinstance(op, (ast.In, ast.NotIn)):
            found = fold(left).isin([v for v in _literals(right) if v is not None])
            return found if isinstance(op, ast.In) else ~found
        a, b = fold(left), fold(right)
        table: dict[type, Callable[[], Column]] = {
            ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b,
            ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b,
        }
        return table[type(op)]()

    def _call(self, name: str, args: list[ast.expr], fold, order: Column) -> Column:
        if name == "coalesce":
            if len(args) < 2:
                raise RuleError("coalesce takes two values or more")
            return F.coalesce(*map(fold, args))
        if name in ("contains", "contains_any"):
            if len(args) != 2:
                raise RuleError(f"{name} takes a column and text")
            words = _literals(args[1]) if name == "contains_any" else [_text(args[1])]
            low = F.lower(fold(args[0]).cast("string"))
            return reduce(lambda a, b: a | b, [F.contains(low, F.lit(str(w).lower())) for w in words])
        if len(args) != 1:
            raise RuleError(f"{name} takes one value")
        x = fold(args[0])
        if name in ("sum", "mean", "std", "min", "max"):
            x = _no_nan(x)
        table: dict[str, Callable[[], Column]] = {
            "abs": lambda: F.abs(x), "lower": lambda: F.lower(x.cast("string")),
            "first": lambda: F.min_by(x, F.when(x.isNotNull(), order)), "last": lambda: F.max_by(x, F.when(x.isNotNull(), order)),
            "sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "std": lambda: F.stddev_samp(x), "min": lambda: F.min(x), "max": lambda: F.max(x),
            "count_true": lambda: F.count_if(x), "count_non_null": lambda: F.count(x),
            "any": lambda: F.coalesce(F.bool_or(x), F.lit(False)),
            "all": lambda: F.when(F.count(x) > 0, F.bool_and(F.coalesce(x, F.lit(False)))),
        }
        if name not in table:
            raise RuleError(f"unknown function {name}")
        return table[name]()


def _no_nan(x: Column) -> Column:
    """Numbers as doubles, NaN as null."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _literals(node: ast.expr) -> list:
    if not isinstance(node, (ast.List, ast.Tuple, ast.Set)) or not all(isinstance(e, ast.Constant) for e in node.elts):
        raise RuleError("a list of literals is needed")
    return [e.value for e in node.elts]


def _text(node: ast.expr) -> str:
    if not (isinstance(node, ast.Constant) and isinstance(node.value, str)):
        raise RuleError("contains takes literal text")
    return node.value


def _binary(op: ast.operator, a: Column, b: Column) -> Column:
    """Numbers are doubles; dividing by zero and its remainder give null."""
    a, b = a.cast("double"), b.cast("double")
    match op:
        case ast.Add():
            return a + b
        case ast.Sub():
            return a - b
        case ast.Mult():
            return a * b
        case ast.Div():
            return F.when(b != 0, a / F.when(b != 0, b))
        case ast.Mod():
            d = F.when(b != 0, b)
            return a - d * F.floor(a / d)
        case ast.Pow():
            return F.pow(a, b)
    raise RuleError("unknown operator")
