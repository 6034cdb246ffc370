"""A small safe formula language over Spark Columns.

Numbers, paths (``signals.x``, ``workload.x``, ``metadata.a.b``), ``+ - * / % ^``, comparisons
inside ``if`` and the functions of ``FUNCTIONS``. Texts are read by Python's own expression parser
(``^`` stands for its power); only the kinds of nodes below are translated, all others are refused,
so a formula never runs code: it becomes a Catalyst expression.

Two ways to evaluate one:

* :func:`exact`: decimals of 34 digits, rounded half to even after each step. Inputs are taken as they are written
  (a double by its shortest digits), results are fixed-point texts, so nothing is lost on the way to a
  decimal column. Batches of rows go through the tree once, as lists.
* :func:`approximate`: doubles inside Catalyst expressions, for sums over many rows where 15 digits will do.

A missing input or an arithmetic error (division by zero, 0^0, the root of a negative number, a result
out of bounds) makes the result null, never infinite. Only ``coalesce`` may meet missing values, and of
``if`` only the branch taken counts.
"""

from __future__ import annotations

import ast
import operator
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import ROUND_CEILING, ROUND_FLOOR, Context, Decimal, DivisionByZero, InvalidOperation, Overflow, localcontext
from functools import reduce
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The language's limits.
MAX_CHARS, MAX_DEPTH, MAX_NODES, MAX_LITERAL, MAX_EXPONENT, MAX_EXP, MAX_PLACES = 4096, 128, 2048, 128, 1000, 2300, 1000
DIGITS, MAX_MAGNITUDE, MAX_SHOWN = 34, 1000, 4096
ROOTS = ("signals", "workload", "metadata")
FUNCTIONS = {
    "abs": (1, 1), "min": (1, None), "max": (1, None), "mean": (1, None), "clamp": (3, 3), "sqrt": (1, 1), "log": (1, 1),
    "exp": (1, 1), "floor": (1, 1), "ceil": (1, 1), "round": (1, 2), "coalesce": (1, None), "if": (3, 3),
}
_IF = "_if"
_CHARACTERS = re.compile(r"[A-Za-z0-9_.,()+\-*/%^<>=!\s]*")
#: What Python would read and the language does not know.
_FOREIGN = re.compile(r"\*\*|//|<<|>>|->|:=|\d_|0[xXoObB]|[^=!<>]=[^=]|\b_")
_NUMBER = re.compile(r"[\d.]+(?:[eE][+-]?\d+)?")


class FormulaError(ValueError):
    """The text is no formula, or breaks a limit."""


@dataclass(frozen=True)
class Formula:
    """A checked formula."""

    text: str
    tree: ast.expr
    #: The text that Python read; literals are taken from it.
    read: str = ""

    def paths(self) -> frozenset[str]:
        """All paths written in the formula, in lazy branches too."""
        return frozenset(_paths(self.tree))


def _path(node: ast.AST) -> str | None:
    """``signals.x`` of an attribute chain that begins at one of the roots."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if parts and isinstance(node, ast.Name) and node.id in ROOTS:
        return ".".join([node.id, *reversed(parts)])
    return None


def _paths(node: ast.AST) -> Iterator[str]:
    if path := _path(node):
        yield path
        return
    for below in ast.iter_child_nodes(node):
        yield from _paths(below)


def _name(call: ast.Call) -> str:
    name = call.func.id if isinstance(call.func, ast.Name) else ""
    return "if" if name == _IF else name


def _check(node: ast.expr, depth: int, condition: bool = False) -> int:
    """Number of nodes; FormulaError for anything that is not part of the language."""
    if depth > MAX_DEPTH:
        raise FormulaError("formula is nested too deeply")
    below = lambda *nodes: 1 + sum(_check(n, depth + 1) for n in nodes)
    if isinstance(node, ast.Compare):
        if not condition or len(node.ops) != 1 or not isinstance(node.ops[0], (ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE)):
            raise FormulaError("only if() takes a comparison, and one")
        return below(node.left, node.comparators[0])
    if condition:
        raise FormulaError("if() needs a comparison")
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return 1
    if _path(node):
        return 1
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return below(node.operand)
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Pow)):
        # A chain of signs nests to the left without being deep.
        return 1 + _check(node.left, depth) + _check(node.right, depth + 1)
    if isinstance(node, ast.Call) and not node.keywords and _name(node) in FUNCTIONS:
        least, most = FUNCTIONS[_name(node)]
        if len(node.args) < least or most is not None and len(node.args) > most:
            raise FormulaError("function has a wrong number of arguments")
        if _name(node) == "round" and len(node.args) > 1 and _literal(node.args[1]) and _whole(node.args[1], MAX_PLACES) is None:
            raise FormulaError("places must be a small whole number")
        if _name(node) == "if":
            return _check(node.args[0], depth + 1, True) + below(*node.args[1:])
        return below(*node.args)
    raise FormulaError("formula names no known path, sign or function")


def _literal(node: ast.expr) -> bool:
    return isinstance(node, ast.Constant) or isinstance(node, ast.UnaryOp) and _literal(node.operand)


def _whole(node: ast.expr, most: int) -> int | None:
    """A written whole number."""
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        inner = _whole(node.operand, most)
        return None if inner is None else -inner
    value = node.value if isinstance(node, ast.Constant) else None
    return int(value) if type(value) in (int, float) and float(value).is_integer() and abs(value) <= most else None


def parse(text: str) -> Formula:
    """The checked formula, or FormulaError."""
    if len(text) > MAX_CHARS:
        raise FormulaError("formula is too long")
    if not _CHARACTERS.fullmatch(text) or _FOREIGN.search(text):
        raise FormulaError("formula has an unknown character or sign")
    if any(len(n) > MAX_LITERAL for n in _NUMBER.findall(text)):
        raise FormulaError("number is too long")
    if max(accumulate(map({"(": 1, ")": -1}.get, re.sub(r"[^()]", "", text))), default=0) > MAX_DEPTH:
        raise FormulaError("formula is nested too deeply")
    readable = re.sub(r"\bif(?=\s*\()", _IF, " ".join(text.split())).replace("^", "**")
    readable = re.sub(r"(?<![\w.])0+(?=\d)", "", readable)
    try:
        tree = ast.parse(readable, mode="eval").body
        nodes = _check(tree, 0)
    except (SyntaxError, MemoryError, RecursionError) as error:
        raise FormulaError("text is no formula") from error
    if nodes > MAX_NODES:
        raise FormulaError("formula has too many parts")
    return Formula(text, tree, readable)


def _finite(value: Column) -> Column:
    """Null for an infinity."""
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


def _power(base: Column, exponent: Column) -> Column:
    allowed = (F.abs(exponent) <= MAX_EXPONENT) & (exponent == F.floor(exponent)) & ((exponent != 0) | (base != 0))
    return F.when(allowed, _finite(F.pow(base, exponent)))


def _rounded(x: Column, places: int) -> Column:
    """Half to even. What is too large for the decimal has no digit at the place that is rounded."""
    scale = min(max(places + 3, 12), 37)
    return F.coalesce(F.bround(x.try_cast(f"decimal(38,{scale})"), places).cast("double"), x)


def _built(node: ast.expr, lookup: Callable[[str], Column]) -> Column:
    build = lambda n: _built(n, lookup)
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value))
    if path := _path(node):
        return lookup(path).cast("double")
    if isinstance(node, ast.UnaryOp):
        return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
    if isinstance(node, ast.Compare):
        x, y = build(node.left), build(node.comparators[0])
        kind = type(node.ops[0])
        return {ast.Eq: x == y, ast.NotEq: x != y, ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[kind]
    if isinstance(node, ast.BinOp):
        x, y, kind = build(node.left), build(node.right), type(node.op)
        if kind is ast.Pow:
            return _power(x, y)
        if kind is ast.Mod:
            return F.try_mod(x, y)
        return _finite(F.try_divide(x, y) if kind is ast.Div else {ast.Add: x + y, ast.Sub: x - y, ast.Mult: x * y}[kind])
    return _called(_name(node), node.args, build)


def _called(name: str, nodes: list[ast.expr], build: Callable[[ast.expr], Column]) -> Column:
    args = [build(a) for a in nodes]
    x = args[0]
    if name == "if":
        return F.when(x.isNotNull(), F.when(x, args[1]).otherwise(args[2]))
    if name == "coalesce":
        return F.coalesce(*args)
    all_there = reduce(lambda a, b: a & b, [a.isNotNull() for a in args])
    if name in ("min", "max"):
        # least and greatest skip nulls; a missing argument must not be skipped.
        pick = x if len(args) == 1 else (F.least if name == "min" else F.greatest)(*args)
        return F.when(all_there, pick)
    if name == "mean":
        return _finite(reduce(lambda a, b: a + b, args)) / F.lit(float(len(args)))
    if name == "clamp":
        return F.when(all_there & (args[1] <= args[2]), F.greatest(args[1], F.least(x, args[2])))
    if name == "round":
        places = _whole(nodes[1], MAX_PLACES) if len(nodes) > 1 else 0
        if places is None:
            raise FormulaError("doubles are rounded to a written number of places")
        return _rounded(x, places)
    if name == "sqrt":
        return F.when(x >= 0, F.sqrt(x))
    if name == "log":
        return F.when(x > 0, F.log(x))
    if name == "exp":
        return F.when(F.abs(x) <= MAX_EXP, _finite(F.exp(x)))
    if name == "abs":
        return F.abs(x)
    # Whole numbers beyond 2^53 are whole already; a bigint would not hold them.
    return F.when(F.abs(x) >= 2.0**53, x).otherwise((F.floor if name == "floor" else F.ceil)(x).cast("double"))


def approximate(text: str, lookup: Callable[[str], Column]) -> Column:
    """A double Column of doubles; ``lookup`` gives the Column of a path."""
    return _built(parse(text).tree, lookup)


# Exact decimals over batches of rows. A value is a decimal, NaN after an error, or None where it is missing.

_NAN = Decimal("NaN")
_SIGNS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_TESTS = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
#: Errors that end an evaluation; they are collected instead of raised.
_ERRORS = (InvalidOperation, DivisionByZero, Overflow)


def _number(value: Any) -> Decimal | None:
    if value is None or type(value) is Decimal:
        return value
    text = repr(value) if isinstance(value, float) else str(value)
    if isinstance(value, bool) or len(text) > MAX_LITERAL:
        return _NAN
    try:
        found = Decimal(text)
    except InvalidOperation:
        return _NAN
    exponent = found.as_tuple().exponent
    return found if isinstance(exponent, int) and abs(exponent) <= MAX_EXPONENT else _NAN


class _Batch:
    """One evaluation of a tree for some rows: every node once, lazy branches for the rows that take them."""

    def __init__(self, formula: Formula, columns: dict[str, Sequence[Any]], n: int):
        self.formula, self.columns, self.n = formula, {k: [_number(v) for v in c] for k, c in columns.items()}, n
        self.bit = {path: 1 << k for k, path in enumerate(sorted(columns))}
        self.read = [0] * n
        self.context = Context(prec=DIGITS, traps=[])

    def evaluate(self) -> list[Decimal | None]:
        with localcontext(self.context) as self.context:
            return self.of(self.formula.tree, range(self.n))

    def there(self, node: ast.expr, rows: Sequence[int]) -> list[Decimal]:
        """Values of a node that must not be missing."""
        found = self.of(node, rows)
        return [_NAN if v is None else v for v in found] if None in found else found

    def checked(self, values: list[Decimal]) -> list[Decimal]:
        """Infinities that an error left become errors themselves."""
        flags = self.context.flags
        if flags[Overflow] or flags[DivisionByZero]:
            values = [v if v.is_finite() else _NAN for v in values]
        self.context.clear_flags()
        return values

    def of(self, node: ast.expr, rows: Sequence[int]) -> list[Decimal | None]:
        if isinstance(node, ast.Constant):
            return [Decimal(ast.get_source_segment(self.formula.read, node))] * len(rows)
        if path := _path(node):
            bit, read, column = self.bit[path], self.read, self.columns[path]
            for r in rows:
                read[r] |= bit
            return [column[r] for r in rows] if len(rows) < self.n else column
        if isinstance(node, ast.UnaryOp):
            found = self.there(node.operand, rows)
            return [-v for v in found] if isinstance(node.op, ast.USub) else found
        if isinstance(node, ast.BinOp):
            x, y = self.there(node.left, rows), self.there(node.right, rows)
            if isinstance(node.op, ast.Pow):
                return self.checked([a ** int(b) if b.is_finite() and abs(b) <= MAX_EXPONENT and b == b.to_integral_value() else _NAN for a, b in zip(x, y)])
            return self.checked(list(map(_SIGNS[type(node.op)], x, y)))
        name = _name(node)
        if name == "coalesce":
            return self.first_there(node.args, rows)
        if name == "if":
            return self.chosen(node.args, rows)
        return self.checked(self.called(name, [self.there(a, rows) for a in node.args]))

    def first_there(self, nodes: list[ast.expr], rows: Sequence[int]) -> list[Decimal | None]:
        out: list[Decimal | None] = [None] * len(rows)
        left = list(range(len(rows)))
        for node in nodes:
            if not left:
                break
            for k, v in zip(left, self.of(node, [rows[k] for k in left])):
                out[k] = v
            left = [k for k in left if out[k] is None]
        return out

    def chosen(self, nodes: list[ast.expr], rows: Sequence[int]) -> list[Decimal | None]:
        test, yes, no = nodes
        x, y = self.there(test.left, rows), self.there(test.comparators[0], rows)
        holds = _TESTS[type(test.ops[0])]
        said = [None if a.is_nan() or b.is_nan() else holds(a, b) for a, b in zip(x, y)]
        out: list[Decimal | None] = [_NAN] * len(rows)
        for node, side in ((yes, True), (no, False)):
            taken = [k for k, v in enumerate(said) if v is side]
            for k, v in zip(taken, self.of(node, [rows[k] for k in taken]) if taken else ()):
                out[k] = v
        return out

    def called(self, name: str, args: list[list[Decimal]]) -> list[Decimal]:
        x = args[0]
        if name in ("sqrt", "log", "exp"):
            if name == "exp":
                return [v.exp() if abs(v) <= MAX_EXP else _NAN for v in x]
            return [v.sqrt() if name == "sqrt" else v.ln() for v in x]
        if name == "abs":
            return [abs(v) for v in x]
        if name in ("floor", "ceil"):
            return [v.to_integral_value(rounding=ROUND_FLOOR if name == "floor" else ROUND_CEILING) for v in x]
        if name == "round":
            places = args[1] if len(args) > 1 else [Decimal(0)] * len(x)
            fine = lambda p: p.is_finite() and p == p.to_integral_value() and abs(p) <= MAX_PLACES
            return [v.quantize(Decimal(1).scaleb(-int(p))) if fine(p) else _NAN for v, p in zip(x, places)]
        whole = [None if any(v.is_nan() for v in t) else t for t in zip(*args)]
        if name == "clamp":
            return [_NAN if t is None or t[1] > t[2] else max(t[1], min(t[0], t[2])) for t in whole]
        if name == "mean":
            return [_NAN if t is None else sum(t, Decimal(0)) / len(t) for t in whole]
        pick = min if name == "min" else max
        return [_NAN if t is None else pick(t) for t in whole]


def _shown(value: Decimal | None) -> str | None:
    """Fixed-point text of a result within bounds."""
    if value is None or not value.is_finite() or abs(value.adjusted()) > MAX_MAGNITUDE:
        return None
    text = format(value, "f")
    if "." in text:
        text = text.rstrip("0").rstrip(".")
    return None if len(text) > MAX_SHOWN else "0" if text == "-0" else text


def evaluate(text: str, columns: dict[str, Sequence[Any]], n: int) -> list[tuple[str | None, tuple[str, ...]]]:
    """Result and the paths that were read, of ``n`` rows given as columns by path."""
    batch = _Batch(parse(text), columns, n)
    names: dict[int, tuple[str, ...]] = {}

    def paths(bits: int) -> tuple[str, ...]:
        if bits not in names:
            names[bits] = tuple(p for p in sorted(columns) if bits & batch.bit[p])
        return names[bits]

    return [(_shown(v), paths(b)) for v, b in zip(batch.evaluate(), batch.read)]


def exact(text: str, lookup: Callable[[str], Column]) -> Column:
    """A fixed-point text of the exact result; cast it to the decimal that is wanted."""
    return _exact(text, lookup, False)


def exact_with_paths(text: str, lookup: Callable[[str], Column]) -> Column:
    """``value`` as of :func:`exact`, and ``used``: the paths that a row's evaluation really read, sorted."""
    return _exact(text, lookup, True)


def _exact(text: str, lookup: Callable[[str], Column], with_paths: bool) -> Column:
    names = sorted(parse(text).paths())
    kind: T.DataType = T.StringType()
    if with_paths:
        kind = T.StructType([T.StructField("value", T.StringType()), T.StructField("used", T.ArrayType(T.StringType()))])

    @F.arrow_udf(kind)
    def evaluated(*arrays: pa.Array) -> pa.Array:
        found = evaluate(text, {p: a.to_pylist() for p, a in zip(names, arrays)}, len(arrays[0]))
        values = pa.array([v for v, _ in found], pa.string())
        if not with_paths:
            return values
        return pa.StructArray.from_arrays([values, pa.array([u for _, u in found], pa.list_(pa.string()))], ["value", "used"])

    # A formula without paths still needs to know its rows.
    return evaluated(*([lookup(p) for p in names] or [F.lit(0)]))
